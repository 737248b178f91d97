"""BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

The words of all documents are counted. The most frequent are compiled into the minimal acyclic automaton of their bytes, whose
edges carry numbers that add up to a word's place in the table of id sequences. The automaton is written to the shared folder, Spark
hands the file to every executor, and workers map it into memory. A batch's distinct words walk the automaton together, a byte at a time.
Words that it lacks are merged exactly, many words at once: in every word the pair of lowest rank, leftmost first, until none is left.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable, scratch_folder
from .frequent import most_frequent
from .packing import blank_parts, load_tokenizer, tokenizer_path
from .words import slices

#: Words in the lexicon; its file is some 100 bytes a word at most.
LEXICON_WORDS = 65_536
REMEMBERED = 200_000
#: Bytes from which a word is merged by itself with a heap.
LONG_WORD = 200
_NONE = np.iinfo(np.int32).max
# The splitting rule of the tokenizer file for texts below U+0250; white space has become spaces before. Beyond, tables of
# letters differ between versions of Unicode, and the tokenizer's own rule is asked.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^ \p{L}\p{N}]+")
_LETTERS = regex.compile(r"\p{L}+")
#: Punctuation behind a word of letters that the splitting rule keeps as one run.
_TRAILING = ".,;:!?&%$#*|()-"


def _byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [out[b] for b in range(256)]


class Merges:
    """A tokenizer file's merges as sorted arrays, and exact merging of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: x for x, i in [*vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[x] for x in symbols], dtype=np.int64)
        self.final = np.array([vocab[x + end] for x in symbols], dtype=np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        # A pair that is listed again keeps its last rank, as in a map.
        key, last = np.unique(key[::-1], return_index=True)
        rank = len(made) - 1 - last
        self.key, self.rank, self.made = key, rank.astype(np.int32), made[rank]
        self.by_rank = made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (a >= 0) & (b >= 0), self.rank[at], _NONE)

    def words(self, words: Sequence[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = np.flatnonzero((size > 0) & (size <= LONG_WORD))
        short = short[np.argsort(size[short], kind="stable")]
        at = 0
        while at < len(short):
            # Words of like length together; the widest sets the width of the block.
            stop = min(at + 20_000, int(np.searchsorted(size[short], size[short[at]] * 1.25 + 1)))
            for i, ids in zip(short[at:stop].tolist(), self._block([words[i] for i in short[at:stop]])):
                out[i] = ids
            at = stop
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = self._long(words[i])
        return out

    def _block(self, words: list[bytes]) -> list[list[int]]:
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        width = int(size.max())
        column = np.arange(width)
        filled = column < size[:, None]
        raw = np.zeros((n, width), dtype=np.uint8)
        raw[filled] = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = np.where(filled, self.inner[raw], -1)
        sym[np.arange(n), size - 1] = self.final[raw[np.arange(n), size - 1]]
        sym = np.concatenate((sym, np.full((n, 1), -1)), axis=1)
        rank = np.full((n, width + 1), _NONE, dtype=np.int32)
        rank[:, :-1] = self.ranks(sym[:, :-1], sym[:, 1:])
        active = np.arange(n)
        wide = np.arange(width + 1)
        while len(active):
            part = rank[active]
            at = part.argmin(axis=1)
            least = part[np.arange(len(active)), at]
            go = least != _NONE
            active, at, least = active[go], at[go], least[go]
            if not len(active):
                break
            shift = np.minimum(wide + (wide > at[:, None]), width)
            s = np.take_along_axis(sym[active], shift, axis=1)
            r = np.take_along_axis(rank[active], shift, axis=1)
            row = np.arange(len(active))
            s[row, at] = self.by_rank[least]
            s[:, -1], r[:, -1] = -1, _NONE
            r[row, at] = self.ranks(s[row, at], s[row, np.minimum(at + 1, width)])
            before = at > 0
            r[row[before], at[before] - 1] = self.ranks(s[row[before], at[before] - 1], s[row[before], at[before]])
            sym[active], rank[active] = s, r
        return [x[x >= 0].tolist() for x in sym]

    @lru_cache(maxsize=1)
    def _table(self) -> dict[int, tuple[int, int]]:
        return {k: (r, m) for k, r, m in zip(self.key.tolist(), self.rank.tolist(), self.made.tolist())}

    def _long(self, word: bytes) -> list[int]:
        table = self._table()
        sym = [int(self.inner[b]) for b in word[:-1]] + [int(self.final[word[-1]])]
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = [(*table[k], i) for i in range(len(sym) - 1) if (k := sym[i] << 20 | sym[i + 1]) in table]
        heap = [(r, i, m) for r, m, i in heap]
        heapq.heapify(heap)
        while heap:
            r, i, made = heapq.heappop(heap)
            j = after[i]
            if sym[i] < 0 or j >= len(sym) or table.get(sym[i] << 20 | sym[j]) != (r, made):
                continue
            sym[i], sym[j], after[i] = made, -1, after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(sym) and (found := table.get(sym[a] << 20 | sym[b])):
                    heapq.heappush(heap, (found[0], a, found[1]))
        return [x for x in sym if x >= 0]


def compile_lexicon(words: Iterable[bytes], ids: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of the words, as bytes that `Lexicon` maps.

    Words are added in order, and a state is merged with an equal one as soon as no later word can change it.
    """
    words = sorted(set(words))
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []
    accepts: list[bool] = []
    path: list[list] = [[False, []]]  # of the last word: whether a state accepts, and its edges so far

    def close(keep: int) -> None:
        while len(path) > keep + 1:
            accept, out = path.pop()
            state = (accept, tuple(out))
            if state not in register:
                register[state] = len(edges)
                edges.append(state[1])
                accepts.append(accept)
            label, _ = path[-1][1][-1]
            path[-1][1][-1] = (label, register[state])

    last = b""
    for word in words:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        close(common)
        for b in word[common:]:
            path[-1][1].append((b, -1))
            path.append([False, []])
        path[-1][0] = True
        last = word
    close(0)
    root = len(edges)
    edges.append(tuple(path[0][1]))
    accepts.append(path[0][0])
    below = [0] * len(edges)  # words that each state accepts; targets come before
    keys, targets, numbers = [], [], []
    for s, out in enumerate(edges):
        total = int(accepts[s])
        for label, target in out:
            keys.append(s << 8 | label)
            targets.append(target)
            numbers.append(total)
            total += below[target]
        below[s] = total
    flat = [ids[w] for w in words]
    start = np.concatenate(([0], np.cumsum([len(x) for x in flat]))).astype(np.int64)
    columns = [
        np.array(keys, np.int64), np.array(targets, np.int64), np.array(numbers, np.int64),
        np.array(accepts, np.int64), start, np.array([x for y in flat for x in y], np.int64),
    ]
    head = np.array([root, len(columns), *map(len, columns)], np.int64)
    return b"".join(x.tobytes() for x in (head, *columns))


class Lexicon:
    """A compiled lexicon, mapped from its file."""

    def __init__(self, path: str):
        data = np.memmap(path, dtype=np.int64, mode="r").view(np.ndarray)
        self.root, n = int(data[0]), int(data[1])
        sizes, at, columns = data[2 : 2 + n].tolist(), 2 + n, []
        for size in sizes:
            columns.append(data[at : at + size])
            at += size
        self.keys, self.targets, self.numbers, self.accepts, self.start, self.ids = columns

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """The place of each word, -1 if it isn't there."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        begin = np.cumsum(size) - size
        state, number = np.full(len(words), self.root), np.zeros(len(words), np.int64)
        out = np.full(len(words), -1, dtype=np.int64)
        active, step = np.arange(len(words)), 0
        while len(active) and len(self.keys):
            ended = size[active] == step
            done = active[ended]
            out[done] = np.where(self.accepts[state[done]] != 0, number[done], -1)
            active = active[~ended]
            key = (state[active] << 8) | data[begin[active] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[at] == key
            active, at = active[on], at[on]
            number[active] += self.numbers[at]
            state[active] = self.targets[at]
            step += 1
        return out

    def sequence(self, place: int) -> list[int]:
        return self.ids[self.start[place] : self.start[place + 1]].tolist()


def _plain(part: str) -> tuple[str, str] | None:
    """Letters in lower case and the punctuation behind them, where the tokenizer's rules do no more than that; else nothing."""
    stem = part.rstrip(_TRAILING)
    if not stem.isalpha():
        return None
    # Below U+0250 a letter is in normal form as it stands; lower case must not add a mark.
    if not stem.isascii() and (max(stem) >= "\u0250" or not stem.lower().isalpha()):
        return None
    return stem.lower(), part[len(stem) :]


class Encoder:
    """Ids of texts, part by part."""

    def __init__(self, merges: Merges, tokenizer, lexicon: Lexicon | None):
        self.merges, self.lexicon = merges, lexicon
        self.normal, self.own_split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None
        self.decimal = [str(i) for i in range(len(merges.names))]
        # Ids in decimal and decoded text of the lexicon's words met so far; never more than it holds.
        self.frequent: dict[str, tuple[str, str]] = {"": ("", "")}
        self.forget()

    def forget(self) -> None:
        self.shown: dict[str, str] = {"": ""}
        self.decoded: dict[str, str] = {"": ""}

    def _split(self, text: str) -> list[str]:
        low = text.lower() if text.isascii() and text.isprintable() else self.normal(text)
        if low.isascii() or max(low) < "\u0250":
            return _SPLIT.findall(low)
        return [low[a:b] for _, (a, b) in self.own_split(low)]

    def _units(self, part: str) -> list:
        """Words, and ids of special tokens."""
        if self.special is None or "<" not in part:
            return self._split(part)
        out = []
        for piece in self.special.split(part):
            out.extend([self.merges.special[piece]] if piece in self.merges.special else self._split(piece))
        return out

    def _written(self, ids: Sequence[int]) -> tuple[str, str]:
        return " ".join([self.decimal[i] for i in ids]), " ".join([self.merges.names[i] for i in ids])

    def _words(self, words: Sequence[str]) -> dict[str, tuple[str, str]]:
        """Ids in decimal and decoded text of words that are not in `frequent`, which gains those of the lexicon."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        place = self.lexicon.find(raw) if self.lexicon is not None else np.full(len(raw), -1)
        for i in np.flatnonzero(place >= 0).tolist():
            self.frequent[words[i]] = self._written(self.lexicon.sequence(place[i]))
        unseen = np.flatnonzero(place < 0).tolist()
        return {words[i]: self._written(ids) for i, ids in zip(unseen, self.merges.words([raw[i] for i in unseen]))}

    def learn(self, parts: Iterable[str]) -> None:
        """Encode the parts that are not remembered."""
        if len(self.shown) > REMEMBERED:
            self.forget()
        frequent = self.frequent
        units = {x: _plain(x) or self._units(x) for x in parts if x not in self.shown}
        rare = self._words(list({u for own in units.values() for u in own if isinstance(u, str) and u not in frequent}))
        for part, own in units.items():
            found = [self._written([u]) if isinstance(u, int) else frequent.get(u) or rare[u] for u in own if u != ""]
            if len(found) == 1:
                self.shown[part], self.decoded[part] = found[0]
            else:
                self.shown[part], self.decoded[part] = " ".join([x for x, _ in found]), " ".join([x for _, x in found])

    def texts(self, texts: Sequence[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids in decimal joined by spaces, decoded text) of each."""
        parts = [blank_parts(x) for x in texts]
        self.learn({x for own in parts for x in own})
        for own in parts:
            ids = " ".join(filter(None, map(self.shown.__getitem__, own)))
            yield (ids.count(" ") + 1 if ids else 0), ids, " ".join(filter(None, map(self.decoded.__getitem__, own)))


def _counted(tokenizer: str | None):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                parts.update((text or "").lower().split())
            words: Counter = Counter()
            for part, n in parts.items():
                stem = part.rstrip(_TRAILING)
                for word in (stem,) if stem.isascii() and stem.isalpha() else _LETTERS.findall(part):
                    words[word] += n
            yield pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    return counted


def _encoded(tokenizer: str | None, lexicon: str, with_ids: bool):
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] * with_ids

    def encoded_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer or tokenizer_path()
        encoder = Encoder(Merges(path), load_tokenizer(path), Lexicon(SparkFiles.get(lexicon)))
        for batch in slices(batches):
            rows = []
            for n, ids, decoded in encoder.texts(batch.column("text").to_pylist()):
                digests = (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                rows.append((*digests, [int(x) for x in ids.split()], decoded) if with_ids else digests)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), fields[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=pa.schema(fields))

    return encoded_texts


def publish(spark, data: bytes, name: str) -> str:
    """Write bytes to the shared folder and have Spark copy the file to every executor, also to those that start later. Returns its name there."""
    path = f"{scratch_folder(spark)}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path)
    return name


def build_lexicon(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, size: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words of all documents, at most `size`; words of like frequency are in it together or not at all."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    counts = texts.mapInArrow(_counted(tokenizer), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = most_frequent(durable(counts.where(F.octet_length("word") <= LONG_WORD)), size).toArrow()
    words = [x.encode() for x in top.column("word").to_pylist()]
    ids = dict(zip(words, Merges(tokenizer or tokenizer_path()).words(words)))
    return compile_lexicon(words, ids)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, lexicon_words: int = LEXICON_WORDS, with_ids: bool = False) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` the ids and the decoded text.

    A missing or empty text has no ids and decodes to nothing. The strings of special tokens in a text become their ids. Decoding
    joins the tokens by spaces, as the tokenizer file names no decoder. Other columns are ignored, whatever their names, repeated rows returned as they are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    name = publish(spark, build_lexicon(docs, text_col, tokenizer, lexicon_words), f"lexicon-{uuid4().hex}")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return texts.mapInArrow(_encoded(tokenizer, name, with_ids), schema)
