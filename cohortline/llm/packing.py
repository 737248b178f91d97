"""Pack token sequences into windows of a fixed length by best fit decreasing.

A document longer than a window is first cut into full windows; what remains is shorter than one. The remainders are dealt to shards of
about `SHARD_TOKENS` tokens by hash, so no task sees more, whatever the corpus. In a shard they are taken from long to short, and each goes to the
open window with the least room that holds it, found in a segment tree over the remaining capacities. A shard leaves at most a few
windows part full.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable
from .words import encoded, slices, span_hashes

WINDOW = 4096
SHARD_TOKENS = 8_000_000
#: Bytes of texts whose ids are found at a time (some 75 bytes of memory for each).
READ = 2_000_000
#: Pieces of text between blanks whose ids a worker remembers.
REMEMBERED = 1_000_000
_WORKER: dict = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str | None):
    """The tokenizer of a file, once in a worker; the default is found on the worker itself."""
    path = path or tokenizer_path()
    if ("tokenizer", path) not in _WORKER:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_padding()
        made.no_truncation()
        _WORKER["tokenizer", path] = made
    return _WORKER["tokenizer", path]


def blank_parts(text: str | None) -> list[str]:
    """A text cut at spaces and line feeds. This tokenizer drops white space and never looks across it, so parts encode on their own."""
    return (text or "").replace("\n", " ").split(" ")


#: What may follow a word of letters in a part that is put together from the ids of both, and words encoded as one string.
_TRAILING = ".,;:!?&%$#*|()-"
_TOGETHER = 1000
_IS_TRAILING = np.isin(np.arange(256), list(_TRAILING.encode()))
_IS_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) < 128) | (np.arange(256) >= 128)
_WORD, _TAIL, _WHOLE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _Store:
    """Sequences of ids by 64-bit keys, one behind the other; place 0 has none."""

    def __init__(self):
        self.keys, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.ids, self.start = np.empty(0, np.uint32), np.zeros(2, np.int64)
        #: Which sequences were asked for since the last `forget`.
        self.asked = np.zeros(1, dtype=bool)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.places[at], -1)

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Keys that are not there yet, each once."""
        first = len(self.start) - 1
        keys, places = np.concatenate((self.keys, keys)), np.concatenate((self.places, np.arange(first, first + len(keys))))
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], places[order]
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids))
        self.asked = np.concatenate((self.asked, np.zeros(len(sizes), dtype=bool)))

    def get(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at the places, one after the other, and their numbers."""
        self.asked[places] = True
        size = self.start[places + 1] - self.start[places]
        upto = np.cumsum(size)
        total = int(upto[-1]) if len(upto) else 0
        return self.ids[np.repeat(self.start[places] - (upto - size), size) + np.arange(total)], size

    def forget(self) -> None:
        """Keep what was asked for since the last time, or nothing if that is more than half of what may be remembered."""
        kept = self.asked[self.places] if len(self.places) else np.zeros(0, dtype=bool)
        if int(kept.sum()) > REMEMBERED // 2:
            kept[:] = False
        keys, (ids, sizes) = self.keys[kept], self.get(self.places[kept])
        self.__init__()
        self.add(keys, ids, sizes)


class PartIds:
    """Ids of texts by those of their parts between blanks, each encoded once as long as it is remembered.

    Parts are found and told apart by 64-bit hashes in numpy; only those not met before become strings. Where the tokenizer marks the ends of words,
    a part of letters with punctuation behind has the ids of the word in lower case and of the rest; words are
    encoded many at a time and told apart by the marks, which is checked by their number. All other parts are encoded by themselves.
    """

    def __init__(self, path: str | None):
        self.tokenizer = load_tokenizer(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        names = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for x, i in names.items() if x.endswith(suffix)]] = True
        self.known = _Store()
        #: Keys of stems of letters that are not encoded as words in lower case.
        self.odd = np.empty(0, np.uint64)

    def _alone(self, keys: np.ndarray, names: list[str]) -> None:
        found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(names, add_special_tokens=False)]
        if found:
            self.known.add(keys, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def _together(self, keys: np.ndarray, words: list[str]) -> None:
        groups = [slice(a, a + _TOGETHER) for a in range(0, len(words), _TOGETHER)]
        added: list[tuple] = []
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(words[g]) for g in groups], add_special_tokens=False)):
            ids, n = np.array(e.ids, np.uint32), len(words[group])
            last = np.flatnonzero(self.ends[ids])
            if len(last) == n and last[-1] == len(ids) - 1:
                added.append((keys[group], ids, np.diff(np.concatenate(([-1], last)))))
            else:
                self._alone(keys[group], words[group])
        if added:
            self.known.add(*(np.concatenate(x) for x in zip(*added)))

    def _new(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys not known yet, each once; where each is first met)."""
        distinct, first = np.unique(keys, return_index=True)
        new = self.known.find(distinct) < 0
        return distinct[new], first[new]

    def _learn_stems(self, keys: np.ndarray, low: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        new, first = self._new(keys)
        new, first = (x[~np.isin(new, self.odd)] for x in (new, first))
        good, odd, words = [], [], []
        for i, a, b in zip(range(len(new)), starts[first].tolist(), ends[first].tolist()):
            raw = low[a:b]
            if raw.isascii():
                word = raw.decode()
            else:
                # Lower case by character, as the tokenizer has it, differs from that of a string for one letter only.
                word = raw.decode("utf-8", "surrogatepass")
                lower = word.lower()
                if not (word.isalpha() and "\u03a3" not in word and is_normalized("NFC", word) and lower.isalpha()):
                    odd.append(i)
                    continue
                word = lower
            good.append(i)
            words.append(word)
        self.odd = np.concatenate((self.odd, new[odd]))
        self._together(new[good], words)

    def _learn(self, keys: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        new, first = self._new(keys)
        self._alone(new, [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[first].tolist(), ends[first].tolist())])

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin; one more entry ends the last."""
        if len(self.known.keys) > REMEMBERED:
            self.known.forget()
        if len(self.odd) > REMEMBERED:
            self.odd = self.odd[:0]
        raw = encoded(texts)
        joined = b" ".join(raw) + b" "
        low = joined.lower()
        data = np.frombuffer(joined, dtype=np.uint8)
        blank = (data == 32) | (data == 10)
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[0::2], edge[1::2]
        key = span_hashes(data, starts, ends) ^ _WHOLE
        places = np.zeros((len(starts), 2), dtype=np.int64)
        plain = np.zeros(len(starts), dtype=bool)
        if self.ends.any() and len(starts):
            other = np.flatnonzero(~_IS_LETTER[data])
            stem = np.minimum(other[np.searchsorted(other, starts)], ends)
            tails = np.concatenate(([0], np.cumsum(_IS_TRAILING[data], dtype=np.int64)))
            plain = (stem > starts) & (tails[ends] - tails[stem] == ends - stem)
            word = span_hashes(np.frombuffer(low, dtype=np.uint8), starts, stem) ^ _WORD
            at = np.flatnonzero(plain)
            self._learn_stems(word[at], low, starts[at], stem[at])
            found = self.known.find(word[at])
            plain[at] = found >= 0
            at, found = at[found >= 0], found[found >= 0]
            places[at, 0] = found
            at = at[ends[at] > stem[at]]
            tail = span_hashes(data, stem[at], ends[at]) ^ _TAIL
            self._learn(tail, joined, stem[at], ends[at])
            places[at, 1] = self.known.find(tail)
        at = np.flatnonzero(~plain)
        self._learn(key[at], joined, starts[at], ends[at])
        places[at, 0] = self.known.find(key[at])
        ids, size = self.known.get(places.ravel())
        total = np.concatenate(([0], np.cumsum(size)))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        return ids, total[2 * np.searchsorted(starts, begin)]


def part_ids(path: str | None) -> PartIds:
    """The worker's ids of parts: what one task has learned serves the next."""
    if ("parts", path) not in _WORKER:
        _WORKER["parts", path] = PartIds(path)
    return _WORKER["parts", path]


def _pieces(path: str | None, end_id: int, window: int, with_ids: bool):
    fields = [pa.field(x, pa.int64()) for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
    schema = pa.schema([*fields, *[pa.field("ids", pa.list_(pa.int32()))] * with_ids])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = part_ids(path)
        for batch in slices(batches, limit=READ):
            ids, edge = encode(batch.column("text").to_pylist())
            rows, kept = [], []
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), edge[:-1], edge[1:]):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), window):
                    piece = own[start : start + window]
                    rows.append((doc_id, start, len(piece), zlib.crc32(piece.tobytes()), len(own)))
                    if with_ids:
                        kept.append(piece.astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(kept, pa.list_(pa.int32()))] * with_ids], schema=schema)

    return pieces


class OpenWindows:
    """Open windows by the room they have left: a segment tree of counts over the capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.names: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        i = self.size + room
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, name: int) -> None:
        self.names[room].append(name)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The window with the least room of at least `need`: (room, name)."""
        count, i = self.count, self.size + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.names[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset there of each length (1 to `window`). Equal lengths are taken in the order given."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, made = OpenWindows(window), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_windows.take(need)
        if found is None:
            room, name, made = window, made, made + 1
        else:
            room, name = found
        where[i], offset[i] = name, window - room
        if room > need:
            open_windows.put(room - need, name)
    return where, offset


def _packed(window: int, shards: int):
    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        where, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        shard = table.column("shard")[0].as_py()
        table = table.drop_columns(["shard"]).append_column("sequence_id", pa.array(where * shards + shard))
        return table.append_column("offset", pa.array(offset))

    return packed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and `ids` if asked for.

    A document's ids are those of its text, then `end_id`; a missing or empty text has `end_id` alone. Pieces of a sequence lie in it without
    gaps from 0; what is left up to `window` is padding. Repeated rows are packed as often as they occur, and a missing doc_id stays missing. `tokenizer` is a file of
    the tokenizers library on every machine; its pre-tokenizer must drop white space and split at it.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    pieces = durable(texts.mapInArrow(_pieces(tokenizer, end_id, window, with_ids), schema))
    total = int(pieces.agg(F.sum("length")).first()[0] or 0)
    shards = max(1, -(-total // SHARD_TOKENS))
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)).alias("shard")
    out = schema + ", sequence_id long, offset long"
    return pieces.select(*pieces.columns, shard).groupBy("shard").applyInArrow(_packed(window, shards), out)
