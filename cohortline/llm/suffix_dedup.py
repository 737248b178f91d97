"""Repeated substrings across documents, by suffix buckets and difference-cover ranks.

A window is `length` bytes (50) of one document; it is a repeat if the same bytes also start in a document with a smaller id. All bytes
of repeats are removed. The suffixes of all texts are never sorted together; they are dealt to buckets, and a task sorts one bucket:

1. Every window has an anchor, the k-byte substring in it with the least hash (leftmost). Equal windows have equal anchors at the same
   place, so suffixes meet in the bucket of their anchor. Successive windows with one anchor form a run of at most length - k + 1 windows;
   only runs are dealt out, with a 64-bit hash of their bytes: one for about 18 bytes of text. Of equal runs in one slice of the rows only that of the
   smallest id is: the others are repeats already, and a passage that very many documents share costs one record a slice.
2. Runs with equal bytes are repeats as a whole in all documents but the first. If the runs of an anchor differ, their documents are asked
   for the bytes, one document for each different run. Long passages are settled here; step 3 sees their ends and edited places.
3. A bucket's runs are laid out with their anchors at one offset. Suffixes that start at cover positions (a difference cover modulo 7) are
   sorted and ranked, one column of the layout at a time, eight bytes by eight bytes among those still tied. Any other suffix reaches a cover position within
   three bytes, so windows compare by the rank found there and three bytes more. The smallest id of each class of equal
   windows is kept, all others are marked.
   An anchor with more than `HOT_RUNS` different runs, as at the edge of a passage that very many documents share, has no bucket: its windows are dealt out
   by a hash of their bytes. Of equal windows in one slice only those of the smallest id are, so that a window of all documents costs one record a slice.
4. The marks go back to the documents.

Memory is bounded by the size of a bucket or a slice of text; in step 2 an anchor's different runs (24 bytes each) are still in one task. Steps 1 and 2 and the windows of hot
anchors trust hashes (48 bits of the anchor with 64 of the bytes), the rest of step 3 compares bytes. Runs and marks are sent as packed arrays. A long text is handled in slices that overlap by length - 1 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable
from .blobs import SCHEMA, bucket_count, bucket_of, pack, scatter, unpack, unpack_all
from .words import encoded, mix, slices

#: Bytes in an anchor, windows in a slice of a long text, and the difference cover.
K = 16
SLICE = 250_000
#: Bytes of texts whose runs are found at a time (some 100 bytes of memory for each), and of texts read at a time.
PIECE = 250_000
READ = 4_000_000
CYCLE, COVER = 7, (0, 1, 3)
#: Bytes from any position to the next cover position, at most.
REACH = 3
#: Different runs of an anchor from which on its windows are dealt out one by one.
HOT_RUNS = 1000
_BASE = np.uint64(0x2545F4914F6CDD1D)
_NO_ID = np.iinfo(np.int64).max
_RUN = ("u8", "u8", "i8")
_MARK = ("i8", "u1", "u8", "u8")
_WINDOW = ("u8", "u8", "u8", "i8", "u1")
#: What a record of _MARK says: a run that repeats as a whole, a run whose bytes or whose windows are needed, windows that repeat.
WHOLE, ASKED, HOT, PART = range(4)


def _grown(values: np.ndarray, more: np.ndarray, n_more: int, at: int) -> np.ndarray:
    """Polynomial hashes of runs of `at` bytes, lengthened by the hashes of the `n_more` bytes behind them."""
    n = max(0, min(len(values), len(more) - at))
    return values[:n] * np.uint64(pow(int(_BASE), n_more, 1 << 64)) + more[at : at + n]


class Runs:
    """The runs of windows of some byte strings: text, first and last window start, anchor start, the two hashes, and a hash for each window start."""

    def __init__(self, texts: list[bytes], length: int):
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.data, self.begin = data, np.cumsum(size) - size
        width = length - K + 1
        if len(data) < length:
            none = np.empty(0, np.int64)
            self.text = self.first = self.last = self.anchor = none
            self.key = self.content = self.window = none.astype(np.uint64)
            return
        h1 = mix(data.astype(np.uint64) + np.uint64(1))
        h = {1: h1}
        for n in (1, 2, 4, 8, 16):
            h[2 * n] = _grown(h[n], h[n], n, n)
        whole, done = None, 0
        for n in (32, 16, 8, 4, 2, 1):
            if (length - done) & n:
                whole, done = (h[n], n) if whole is None else (_grown(whole, h[n], n, done), done + n)
        anchors = mix(h[K])
        least = (anchors & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(anchors), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        holds = size >= length
        np.add.at(inside, self.begin[holds], 1)
        np.add.at(inside, (self.begin + size - length + 1)[holds], -1)
        starts = np.flatnonzero(np.cumsum(inside[: len(least)], dtype=np.int8))
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
        del h, h1, inside
        self.first, self.anchor = starts[edge], at[edge]
        self.last = starts[np.concatenate((edge[1:], [len(at)])) - 1] if len(at) else self.first
        self.text = np.searchsorted(self.begin, self.first, side="right") - 1
        # Empty texts begin where the next one does; the last of them is the one with bytes.
        self.key, self.window = anchors[self.anchor], whole
        ends = mix(whole[self.first]) * _BASE + whole[self.last]
        self.content = mix(ends + (self.last - self.first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in lists of bounded size; long texts in overlapping slices."""
    part, size = [], 0
    for i, x in enumerate(texts):
        for at in range(0, max(1, len(x) - length + 1), SLICE):
            piece = x if len(x) < SLICE + length else x[at : at + SLICE + length - 1]
            part.append((i, at, piece))
            size += len(piece)
            if size >= PIECE:
                yield part
                part, size = [], 0
    if part:
        yield part


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(_NO_ID).to_numpy()


def _least_owners(key: np.ndarray, content: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether a run is the first of its kind in that order, whether it repeats one of a smaller owner); an owner's own repetition is neither."""
    order = np.lexsort((owner, content, key))
    key, content, owner = key[order], content[order], owner[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])))
    same = ~new & np.concatenate(([False], owner[1:] == owner[:-1]))
    repeat = (owner > owner[new][np.cumsum(new) - 1]) & ~same
    return order, new, repeat


def _dealt_runs(length: int, n_buckets: int, n_homes: int):
    """Runs by the buckets of their anchors; in buckets from `n_buckets` on, by documents, those that repeat one of the same slice."""

    def dealt_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=READ):
            ids, found = _ids(batch), []
            for part in _pieces(encoded(batch.column("text").to_pylist()), length):
                runs = Runs([x for _, _, x in part], length)
                owner = ids[np.fromiter((i for i, _, _ in part), np.int64, len(part))][runs.text]
                found.append((runs.key, runs.content, owner))
            if not found:
                continue
            key, content, owner = (np.concatenate(c) for c in zip(*found))
            del found
            if len(key):
                order, new, repeat = _least_owners(key >> np.uint64(16), content, owner)
                first, again = order[new], order[repeat]
                yield from scatter(_bucket(key[first], n_buckets), [key[first] >> np.uint64(16), content[first], owner[first]], ascending=True)
                yield from scatter(n_buckets + _home(owner[again], n_homes), _marks(owner[again], content[again]))

    return dealt_runs


def _bucket(key: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bucket of an anchor. Anchors have the least hashes of their windows, so these are mixed again."""
    return bucket_of(mix(key), n_buckets)


def _home(doc: np.ndarray, n_homes: int) -> np.ndarray:
    return bucket_of(mix(doc.view(np.uint64)), n_homes)


def _marks(doc: np.ndarray, content: np.ndarray) -> list[np.ndarray]:
    """Records of whole runs that are repeats."""
    return [doc, np.full(len(doc), WHOLE, np.uint8), content, np.zeros(len(doc), np.uint64)]


def _settled(n_buckets: int, n_homes: int, hot_runs: int):
    """Whole runs that repeat, and runs whose bytes or windows are needed, dealt to the documents' buckets."""

    def settled(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = bucket[0].as_py()
        if at >= n_buckets:  # settled where they were found
            return pa.table({"bucket": pa.array(np.full(table.num_rows, at - n_buckets)), "data": table.column("data")})
        key, content, owner = unpack_all(table.column("data").to_pylist(), _RUN, ascending=True)
        order, new_run, repeat = _least_owners(key, content, owner)
        key, content, owner = key[order], content[order], owner[order]
        new_key = np.concatenate(([True], key[1:] != key[:-1]))
        # Of each anchor's different runs, whether their earliest documents differ.
        first_run = np.flatnonzero(new_key[new_run])
        early = owner[new_run]
        low, high = np.minimum.reduceat(early, first_run), np.maximum.reduceat(early, first_run)
        n_runs = np.diff(np.concatenate((first_run, [len(early)])))
        several, hot = np.repeat(low < high, n_runs), np.repeat(n_runs > hot_runs, n_runs)
        doc = np.concatenate((owner[repeat], early[several]))
        kind = np.concatenate((np.full(int(repeat.sum()), WHOLE, np.uint8), np.where(hot[several], HOT, ASKED).astype(np.uint8)))
        hashes = np.concatenate((content[repeat], content[new_run][several]))
        return _to_homes(doc, kind, hashes, np.zeros(len(doc), np.uint64), n_homes)

    return settled


def _to_homes(doc, kind, content, mask, n_homes: int) -> pa.Table:
    batches = list(scatter(_home(doc, n_homes), [doc, kind, content, mask]))
    return pa.Table.from_batches(batches) if batches else pa.table({"bucket": pa.array([], pa.int64()), "data": pa.array([], pa.binary())})


def _by_document(table: pa.Table) -> pa.Table:
    """One row for each document: its marks, the runs it is asked for, and how many of them by windows."""
    doc, kind, content, mask = unpack_all(table.column("data").to_pylist(), _MARK)
    order = np.argsort(doc, kind="stable")
    doc, kind, content, mask = doc[order], kind[order], content[order], mask[order]
    edge = np.concatenate(([0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)])) if len(doc) else np.zeros(1, np.int64)
    marks, asks, n_hot = [], [], []
    for a, b in zip(edge[:-1], edge[1:]):
        own = (kind[a:b] == WHOLE) | (kind[a:b] == PART)
        marks.append(pack([content[a:b][own], mask[a:b][own]]) if own.any() else None)
        asked, at = np.unique(content[a:b][~own], return_index=True)
        hot = kind[a:b][~own][at] == HOT
        asks.append(pack([asked, hot.astype(np.uint8)]) if len(asked) else None)
        n_hot.append(int(hot.sum()))
    columns = {"marks": pa.array(marks, pa.binary()), "asks": pa.array(asks, pa.binary()), "n_hot": pa.array(n_hot, pa.int64())}
    return pa.table({"mark_id": pa.array(doc[edge[:-1]]), **columns})


_BY_DOCUMENT = "mark_id long, marks binary, asks binary, n_hot long"


def _windows(runs: Runs, at: np.ndarray, owner: np.ndarray, lead: int) -> tuple[np.ndarray, ...]:
    """The windows of the runs `at`: two hashes, the run's content, the owner, and the window's layout column."""
    count = runs.last[at] - runs.first[at] + 1
    run = np.repeat(at, count)
    start = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + runs.first[run]
    key = runs.key[run]
    return mix(runs.window[start]) ^ key, key, runs.content[run], owner[run], (start - runs.anchor[run] + lead).astype(np.uint8)


def _later(first: np.ndarray, second: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether a smaller owner has the same pair of hashes."""
    order = np.lexsort((owner, second, first))
    first, second, own = first[order], second[order], owner[order]
    new = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    later = np.empty(len(own), dtype=bool)
    later[order] = own > own[new][np.cumsum(new) - 1]
    return later


def _asked_runs(length: int, n_buckets: int, n_windows: int, n_homes: int):
    """What documents are asked for: by the buckets of their anchors the bytes of runs, laid out with the anchor at one offset; in the next `n_windows` buckets the windows
    of hot anchors; and beyond, by documents, those windows that repeat one of the same slice."""
    lead = length - K
    width = length + lead

    def laid_out(runs: Runs, at: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        source = np.concatenate((np.zeros(lead, np.uint8), runs.data, np.zeros(width, np.uint8)))
        layout = source[(runs.anchor[at])[:, None] + np.arange(width)]
        column = np.arange(width)
        before = (runs.anchor - runs.first)[at]
        count = (runs.last - runs.first)[at] + 1
        layout[(column < (lead - before)[:, None]) | (column >= (lead - before + count - 1 + length)[:, None])] = 0
        rows = np.ascontiguousarray(layout).view(f"V{width}").ravel()
        return runs.key[at], runs.content[at], owner[at], before.astype(np.uint16), count.astype(np.uint16), rows

    def asked_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=READ):
            ids, asks = _ids(batch), [unpack(x, ("u8", "u1")) for x in batch.column("asks").to_pylist()]
            out, small = [], []
            for part in _pieces(encoded(batch.column("text").to_pylist()), length):
                runs = Runs([x for _, _, x in part], length)
                of = np.fromiter((i for i, _, _ in part), np.int64, len(part))
                edge = np.searchsorted(runs.text, np.arange(len(part) + 1))
                chosen, hot = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for p, i in enumerate(of):
                    asked, wide = asks[i]
                    content, first = np.unique(runs.content[edge[p] : edge[p + 1]], return_index=True)
                    place = np.minimum(np.searchsorted(asked, content), len(asked) - 1)
                    found = asked[place] == content
                    chosen.append(edge[p] + first[found & (wide[place] == 0)])
                    hot.append(edge[p] + first[found & (wide[place] == 1)])
                owner = ids[of][runs.text]
                at, at_hot = np.concatenate(chosen), np.concatenate(hot)
                if len(at):
                    out.append(laid_out(runs, at, owner))
                if len(at_hot):
                    small.append(_windows(runs, at_hot, owner, lead))
            if out:
                key, *rest = (np.concatenate(c) for c in zip(*out))
                yield from scatter(_bucket(key, n_buckets), [key >> np.uint64(16), *rest], ascending=True)
            del out
            if small:
                # All windows of the smallest owner go on: its other runs may have them too.
                found = [np.concatenate(c) for c in zip(*small)]
                later = _later(found[0], found[1], found[3])
                yield from scatter(n_buckets + bucket_of(found[0][~later], n_windows), [c[~later] for c in found])
                _, _, content, owner, column = (c[later] for c in found)
                yield from scatter(n_buckets + n_windows + _home(owner, n_homes), _parts(owner, content, column))

    return asked_runs


def _parts(doc: np.ndarray, content: np.ndarray, column: np.ndarray) -> list[np.ndarray]:
    """Records of single windows that are repeats."""
    return [doc, np.full(len(doc), PART, np.uint8), content, np.uint64(1) << column.astype(np.uint64)]


def _ranks(strings: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of a byte matrix, eight bytes at a time among the rows still tied."""
    n, width = strings.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = strings
    words = padded.view(">u8").astype(np.uint64)
    rank = np.zeros(n, dtype=np.int64)
    tied = np.arange(n)
    for w in range(words.shape[1]):
        order = np.lexsort((words[tied, w], rank[tied]))
        rows = tied[order]
        old, word = rank[rows], words[rows, w]
        new = np.concatenate(([True], (old[1:] != old[:-1]) | (word[1:] != word[:-1])))
        # Ranks are places in the sorted order, so that classes settled earlier keep theirs.
        start = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
        base = np.repeat(start, np.diff(np.concatenate((start, [len(rows)]))))
        place = np.flatnonzero(new)[np.cumsum(new) - 1]
        rank[rows] = old + place - base
        size = np.diff(np.concatenate((np.flatnonzero(new), [len(rows)])))
        tied = rows[np.repeat(size > 1, size)]
        if not len(tied):
            break
    return rank


def repeated_windows(layout: np.ndarray, before: np.ndarray, count: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """A bit for each window of each run that also starts in a run of a smaller owner. Bit o is the window at layout column o."""
    lead, n = length - K, len(layout)
    marks = np.zeros(n, dtype=np.uint64)
    reach = length - REACH
    first, last = lead - before, lead - before + count - 1
    ranked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for o in range(lead + 1):
        rows = np.flatnonzero((first <= o) & (o <= last))
        if len(rows) < 2:
            continue
        ahead = next(i for i in range(REACH + 1) if (o + i) % CYCLE in COVER)
        c = o + ahead
        if c not in ranked:
            # All runs with a window that reaches this cover position are ranked together, once.
            near = [x for x in range(max(0, c - REACH), c + 1) if x + next(i for i in range(REACH + 1) if (x + i) % CYCLE in COVER) == c and x <= lead]
            users = np.flatnonzero(np.logical_or.reduce([(first <= x) & (x <= last) for x in near]))
            rank = np.empty(n, dtype=np.int64)
            rank[users] = _ranks(layout[users, c : c + reach])
            ranked = {c: rank}
        more = np.concatenate((np.arange(o, c), np.arange(c + reach, o + length)))
        extra = np.zeros(len(rows), dtype=np.int64)
        for col in more:
            extra = (extra << 8) | layout[rows, col]
        rank = ranked[c][rows]
        order = np.lexsort((owner[rows], extra, rank))
        rank, extra, own = rank[order], extra[order], owner[rows][order]
        new = np.concatenate(([True], (rank[1:] != rank[:-1]) | (extra[1:] != extra[:-1])))
        least = own[new][np.cumsum(new) - 1]
        marks[rows[order][own > least]] |= np.uint64(1) << np.uint64(o)
    return marks


def _compared(length: int, n_buckets: int, n_windows: int, n_homes: int):
    """The windows that repeat, dealt to the documents' buckets; buckets as `_asked_runs` deals them."""
    lead = length - K
    kinds = ("u8", "u8", "i8", "u2", "u2", f"V{length + lead}")

    def compared(bucket: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at, blobs = bucket[0].as_py(), table.column("data")
        if at >= n_buckets + n_windows:  # settled where they were found
            return pa.table({"bucket": pa.array(np.full(table.num_rows, at - n_buckets - n_windows)), "data": blobs})
        if at >= n_buckets:
            first, second, content, owner, column = unpack_all(blobs.to_pylist(), _WINDOW)
            later = _later(first, second, owner)
            return _to_homes(*_parts(owner[later], content[later], column[later]), n_homes)
        key, content, owner, before, count, layout = unpack_all(blobs.to_pylist(), kinds, ascending=True)
        order = np.argsort(key, kind="stable")
        key, content, owner = key[order], content[order], owner[order]
        before, count = before[order].astype(np.int64), count[order].astype(np.int64)
        layout = layout[order].view(np.uint8).reshape(len(key), length + lead)
        mask = repeated_windows(layout, before, count, owner, length)
        hit = mask != 0
        return _to_homes(owner[hit], np.full(int(hit.sum()), PART, np.uint8), content[hit], mask[hit], n_homes)

    return compared


def _cut(length: int, names: list[str], with_text: bool):
    """Each document with its repeats taken out."""
    lead = length - K
    extra = [pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("kept_sha256", pa.string())]
    extra += [pa.field("span_starts", pa.list_(pa.int64())), pa.field("span_ends", pa.list_(pa.int64()))]
    extra += [pa.field("kept_text", pa.string())] * with_text

    def removed_bytes(text: bytes, whole: np.ndarray, some: np.ndarray, masks: np.ndarray) -> np.ndarray:
        step = np.zeros(len(text) + 1, dtype=np.int32)
        bits = np.arange(lead + 1, dtype=np.uint64)
        for part in _pieces([text], length):
            runs = Runs([x for _, _, x in part], length)
            shift = np.fromiter((at for _, at, _ in part), np.int64, len(part)) - runs.begin
            shift = shift[runs.text] if len(runs.text) else np.empty(0, np.int64)
            full = np.isin(runs.content, whole)
            np.add.at(step, (runs.first + shift)[full], 1)
            np.add.at(step, (runs.last + shift)[full] + length, -1)
            if len(some):
                place = np.minimum(np.searchsorted(some, runs.content), len(some) - 1)
                hit = np.flatnonzero((some[place] == runs.content) & ~full)
                on = (masks[place[hit]][:, None] >> bits) & np.uint64(1) != 0
                row, o = np.nonzero(on)
                start = (runs.anchor + shift)[hit][row] - lead + o
                np.add.at(step, start, 1)
                np.add.at(step, start + length, -1)
        return np.cumsum(step[:-1]) > 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text", READ):
            lengths, removed, spans, digests, starts, ends, kept = [], [], [], [], [], [], []
            for text, first, second in zip(encoded(batch.column("_text").to_pylist()), batch.column("_whole").to_pylist(), batch.column("_part").to_pylist()):
                rest, gone = text, None
                if first or second:
                    whole = unpack(first, ("u8", "u8"))[0] if first else np.empty(0, np.uint64)
                    some, masks = unpack(second, ("u8", "u8")) if second else (np.empty(0, np.uint64),) * 2
                    some, at = np.unique(some, return_inverse=True)
                    both = np.zeros(len(some), np.uint64)
                    np.bitwise_or.at(both, at, masks)
                    gone = removed_bytes(text, whole, some, both)
                    data = np.frombuffer(text, dtype=np.uint8)
                    rest = data[~gone].tobytes()
                if gone is not None and gone.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                    starts.append(edge[0::2].tolist())
                    ends.append(edge[1::2].tolist())
                else:
                    starts.append([])
                    ends.append([])
                lengths.append(len(text))
                removed.append(len(text) - len(rest))
                spans.append(len(starts[-1]))
                digests.append(hashlib.sha256(rest).hexdigest())
                if with_text:
                    if removed[-1]:  # a character goes only if all its bytes go
                        char = np.flatnonzero((data & 0xC0) != 0x80)
                        lost = np.minimum.reduceat(gone, char) if len(char) else gone
                        rest = data[~np.repeat(lost, np.diff(np.concatenate((char, [len(data)]))))].tobytes()
                    kept.append(rest.decode("utf-8", "replace"))
            columns = [pa.array(x) for x in (lengths, removed, spans)] + [pa.array(digests, pa.string())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (starts, ends)] + [pa.array(kept, pa.string())] * with_text
            schema = pa.schema([*[batch.schema.field(x) for x in names], *extra])
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in names], *columns], schema=schema)

    return cut


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, with_text: bool = False, keep: tuple[str, ...] = (), hot_runs: int = HOT_RUNS) -> DataFrame:
    """One row for each row of `docs`: doc_id, the columns `keep`, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends (byte
    offsets of the removed runs) and, with `with_text`, kept_text, in which a character goes only if all its bytes go.

    `length` is 20 to 63 bytes. A missing text is empty; a text shorter than `length` loses nothing and removes nothing. Rows with the same id never remove from each
    other. A missing id counts as larger than any other. Columns of `keep` must not have the names above; other columns are ignored. An empty table gives no rows. An anchor with more than
    `hot_runs` different runs is settled by its windows, with the same result.
    """
    if not K + REACH < length < 64:
        raise ValueError("length must be 20 to 63")
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = int(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n_runs = 2 * total // (length - K + 2) + 1
    n_homes = bucket_count(spark, n_runs // 5, 300_000)

    n_buckets = bucket_count(spark, n_runs, 300_000)
    dealt = texts.mapInArrow(_dealt_runs(length, n_buckets, n_homes), SCHEMA)
    homes = dealt.groupBy("bucket").applyInArrow(_settled(n_buckets, n_homes, hot_runs), SCHEMA)
    found = durable(homes.groupBy("bucket").applyInArrow(_by_document, _BY_DOCUMENT))

    own_id = F.coalesce(F.col("doc_id"), F.lit(_NO_ID))
    asks = found.where("asks is not null").select("mark_id", "asks")
    asked = texts.join(asks, own_id == F.col("mark_id")).select("doc_id", "text", "asks")
    n_hot = int(found.agg(F.sum("n_hot")).first()[0] or 0)
    dealing = length, bucket_count(spark, n_runs // 8, 40_000), bucket_count(spark, n_hot * (length - K + 1), 300_000), n_homes
    compared = asked.mapInArrow(_asked_runs(*dealing), SCHEMA).groupBy("bucket").applyInArrow(_compared(*dealing), SCHEMA)
    parts = durable(compared.groupBy("bucket").applyInArrow(_by_document, _BY_DOCUMENT))

    marks = (
        found.where("marks is not null")
        .select("mark_id", F.col("marks").alias("_whole"))
        .join(parts.select("mark_id", F.col("marks").alias("_part")), "mark_id", "full_outer")
    )
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    joined = named.join(marks, own_id == F.col("mark_id"), "left").drop("mark_id")
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1]]
        + ["n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"]
        + ["kept_text string"] * with_text
    )
    return joined.mapInArrow(_cut(length, named.columns[:-1], with_text), schema)
