"""SimHash near copies by anchor-point covering.

A fingerprint has 64 bits, bit i set if more than half of a text's shingle hashes have it. Two link if at most RADIUS bits differ. The 64 bits are cut
into blocks; of RADIUS differing bits some block has at most t = RADIUS // blocks. The words of a block are covered by the code of a Hamming code's
words with all values of the bits beyond its length: each word is within one bit of exactly one of them, its home anchor. A fingerprint goes to every anchor
within 1 + t bits of each of its blocks. So whatever links with it meets it at its home anchor of some block, and there all that came to an
anchor are compared with those at home, by all 64 bits. Every link is found; what is kept of them is a spanning forest at each anchor.

* `scheme`: three blocks have 2^17 to 2^18 anchors each and some 45 places a fingerprint; beyond `MANY` fingerprints two blocks of 2^27 anchors
  and some 340 places keep the comparisons down. The links are the same.
* Equal fingerprints are one before anything is compared.
* An anchor with more than CROWD fingerprints is split: homes and visitors are dealt to groups by hash, and each pair of groups is a place of its own.
* Where a place is large, components grow from one fingerprint at a time, each compared only with those not reached yet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators import skew
from ..operators.durable import durable
from . import blobs, graph
from .words import mix, slices

WORDS = 4
SEED = 42
RADIUS = 4
#: Fingerprints beyond which two blocks are used instead of three.
MANY = 200_000_000
#: Fingerprints at an anchor that are compared in one place.
CROWD = 100_000
#: Records of a bucket, of 17 bytes each.
BUCKET = 3_000_000
#: Fingerprints whose anchors are made at a time.
SLICE = 20_000
#: Pairs of a place up to which all are compared at once.
AT_ONCE = 1 << 16
#: Bytes of a text that are cut into words at a time.
PART = 2_000_000
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: Fixed widths of the blocks.
_WIDTHS = {3: (21, 21, 22), 2: (32, 32)}


def _word_lists(data: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text in lists, each after the first beginning with the last WORDS - 1 words before; the second value is false for the first list."""
    at, carried, later = 0, [], False
    while at < len(data):
        blank = _BLANK.search(data, at + PART) if at + PART < len(data) else None
        end = blank.start() if blank else len(data)
        words = carried + data[at:end].split()
        yield words, later
        carried, later, at = words[-(WORDS - 1) :], True, end
    if not later:
        yield [], False


def fingerprint(text: bytes) -> int:
    """The SimHash of a text's WORDS-word shingles, repeats included; 0 without words."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    hashed = xxhash.xxh64_intdigest
    # ASCII letters alone change their case in bytes.
    for words, later in _word_lists(text.lower()):
        joined = b" ".join(words)
        if len(words) >= WORDS:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            spans = zip(starts[: len(words) - WORDS + 1].tolist(), ends[WORDS - 1 :].tolist())
            values = np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - WORDS + 1)
        elif words and not later and len(text) <= PART:
            values = np.array([hashed(joined, SEED)], dtype=np.uint64)
        else:
            values = np.empty(0, dtype=np.uint64)
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(values)
    if not n and len(text) > PART:  # a few very long words
        words = text.lower().split()
        return hashed(b" ".join(words), SEED) if words else 0
    return sum(1 << i for i in range(64) if 2 * int(ones[i]) > n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every text; `print` is the fingerprint as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary())
            prints = np.fromiter((fingerprint(x.as_py() or b"") for x in texts), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, print long")


class Code:
    """Anchors of the words of `width` bits: those whose first 2^r - 1 bits are a word of the Hamming code, the other bits being free."""

    def __init__(self, width: int, reach: int):
        """`reach`: how far from a word its anchors lie at most."""
        self.checks = (width + 1).bit_length() - 1
        self.length = (1 << self.checks) - 1
        tables = np.zeros((-(-self.length // 8), 256), dtype=np.uint64)
        for i in range(self.length):
            tables[i // 8] ^= np.where(np.arange(256) >> (i % 8) & 1, np.uint64(i + 1), np.uint64(0))
        self._tables = tables
        errors = [sum(1 << i for i in bits) for n in range(reach + 1) for bits in combinations(range(width), n)]
        errors = np.array(errors, dtype=np.uint64)
        found = self.syndrome(errors)
        # The first error of a syndrome has the fewest bits: it leads to the home anchor.
        self.errors = [errors[found == s] for s in range(1 << self.checks)]

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out, within = np.zeros(len(words), dtype=np.uint64), words & np.uint64((1 << self.length) - 1)
        for i, table in enumerate(self._tables):
            out ^= table[within >> np.uint64(8 * i) & np.uint64(255)]
        return out

    def anchors(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions of words, their anchors as a matrix), home first, for each syndrome."""
        syndromes = self.syndrome(words)
        for s in np.unique(syndromes):
            at = np.flatnonzero(syndromes == s)
            yield at, words[at][:, None] ^ self.errors[int(s)]


@lru_cache(maxsize=2)
def codes(blocks: int) -> list[tuple[int, Code]]:
    """(shift, code) of each block of the fingerprint."""
    shift, out = 0, []
    for width in _WIDTHS[blocks]:
        out.append((shift, Code(width, 1 + RADIUS // blocks)))
        shift += width
    return out


def scheme(n: int) -> int:
    return 3 if n <= MANY else 2


def places(prints: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, position of its print, whether at home) for all anchors of all prints; anchors are hashes of block and code word."""
    keys, at, home = [], [], []
    for number, (shift, code) in enumerate(codes(blocks)):
        width = _WIDTHS[blocks][number]
        words = prints >> np.uint64(shift) & np.uint64((1 << width) - 1)
        for where, anchors in code.anchors(words):
            keys.append(mix(anchors.ravel() + np.uint64((number + 1) << 40)))
            at.append(np.repeat(where, anchors.shape[1]))
            home.append(np.tile(np.arange(anchors.shape[1]) == 0, len(where)))
    return np.concatenate(keys), np.concatenate(at), np.concatenate(home)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for i in range(0, len(values), SLICE):
            yield values[i : i + SLICE]


def _crowded(prints: DataFrame, blocks: int, n: int) -> dict[int, int]:
    """Groups into which the prints of each crowded anchor are dealt.

    A slice reports an anchor that has at least the slice's share of half a crowd, and twice at least: what is not reported stays below half a crowd,
    and once a slice beyond that.
    """
    if n < CROWD // 2:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _parts(batches):
            keys, counts = np.unique(places(values, blocks)[0], return_counts=True)
            many = counts >= max(2, CROWD * len(values) / (2 * n))
            yield pa.record_batch([pa.array(keys[many].view(np.int64)), pa.array(counts[many])], names=["anchor", "n"])

    found = prints.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= CROWD // 2)
    return {r["anchor"] % (1 << 64): -(-2 * r["n"] // CROWD) for r in found.collect()}


def _dealt(keys: np.ndarray, at: np.ndarray, home: np.ndarray, prints: np.ndarray, crowded: dict[int, int]):
    """The places with those of crowded anchors replaced by one for each pair of groups that a print belongs to."""
    if not crowded:
        return keys, at, home
    listed = np.array(sorted(crowded), dtype=np.uint64)
    split = np.isin(keys, listed)
    out = [(keys[~split], at[~split], home[~split])]
    for key in np.unique(keys[split]):
        groups = crowded[int(key)]
        here = keys == key
        own = (mix(prints[at[here]]) % np.uint64(groups)).astype(np.int64)
        for i in range(groups):
            # As a visitor it goes to its own group in each row of the grid; at home it stands for its row in each column.
            visits = np.full(here.sum(), i) * groups + own
            out.append((mix(key + mix(visits.astype(np.uint64))), at[here], np.zeros(len(own), dtype=bool)))
            homes = home[here]
            stands = own[homes] * groups + i
            out.append((mix(key + mix(stands.astype(np.uint64))), at[here][homes], np.ones(len(stands), dtype=bool)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _grown(home: np.ndarray, present: np.ndarray) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """(print, prints reached from it) at a place: breadth first, each compared with what is not reached yet."""
    left = present
    for start in home:
        hit = left == start
        if not hit.any():
            continue
        left, queue = left[~hit], [start]
        while queue and len(left):
            one = queue.pop()
            hit = _near(left, one)
            if hit.any():
                yield one, left[hit]
                queue.extend(left[hit])
                left = left[~hit]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, at most one for each end."""
    ends, where = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = where[: len(a)], where[len(a) :], np.arange(len(ends))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        # Roots of both ends are hung on the smaller one.
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    hung = label != np.arange(len(ends))
    return ends[hung], ends[label[hung]]


def links_at(keys: np.ndarray, prints: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links found at the places `keys`."""
    order = np.lexsort((~home, keys))
    keys, prints, home = keys[order], prints[order], home[order]
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    first, size = edge[:-1], np.diff(edge)
    homes = np.add.reduceat(home.astype(np.int64), first)
    # Split places hold a print twice, at home and as a visitor.
    pairs, found = homes * size, []
    some = np.flatnonzero((pairs <= AT_ONCE) & (size > 1) & (homes > 0))
    cut = np.cumsum(pairs[some]) // (1 << 21)
    for group in np.split(some, np.flatnonzero(np.diff(cut)) + 1) if len(some) else []:
        within = np.arange(pairs[group].sum()) - np.repeat(np.cumsum(pairs[group]) - pairs[group], pairs[group])
        row, width = np.repeat(first[group], pairs[group]), np.repeat(size[group], pairs[group])
        a, b = prints[row + within // width], prints[row + within % width]
        near = _near(a, b) & (a != b)
        found.append((a[near], b[near]))
    for i in np.flatnonzero(pairs > AT_ONCE):
        here = slice(first[i], first[i] + size[i])
        for one, reached in _grown(np.unique(prints[here][home[here]]), np.unique(prints[here])):
            found.append((np.full(len(reached), one), reached))
    if not found:
        return prints[:0], prints[:0]
    return _forest(*(np.concatenate(x) for x in zip(*found)))


def links(prints: DataFrame, n: int) -> DataFrame:
    """Pairs (a, b) of the distinct `print` values whose components are those of all links."""
    spark, blocks = prints.sparkSession, scheme(n)
    crowded = _crowded(prints, blocks, n)
    each = {3: 50, 2: 350}[blocks]
    buckets = blobs.bucket_count(spark, n * each, BUCKET)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in _parts(batches):
            keys, at, home = _dealt(*places(values, blocks), values, crowded)
            yield from blobs.scatter(blobs.bucket_of(keys, buckets), [keys, values[at], home.astype(np.uint8)], ascending=True)

    def compare(table: pa.Table) -> pa.Table:
        keys, values, home = blobs.unpack_all(table.column("data").to_pylist(), ("u8", "u8", "u1"), ascending=True)
        a, b = links_at(keys, values, home.astype(bool))
        return pa.table([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return prints.mapInArrow(deal, blobs.SCHEMA).groupBy("bucket").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of `docs`: its fingerprint in hexadecimal and the smallest doc_id that links lead to.

    Repeated rows stay; a missing text is empty; texts without words have fingerprint zero and link like others. Missing ids are passed over in a
    component with others; if all are missing, so is `component_id`. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    prints = durable(fingerprints(docs))
    each = durable(prints.groupBy("print").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    n, largest = each.agg(F.count(F.lit(1)), F.max("n")).first()
    hot = durable(each.where(F.col("n") > skew.HOT_ROWS).select("print")) if n and largest > skew.HOT_ROWS else skew.NONE_HOT
    found = durable(graph.components(links(each.select("print"), n)).select(F.col("node").alias("print"), "component"))
    linked = found.join(each, "print")
    names = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = linked.join(names, "component").select("print", "component_id")
    alone = each.join(linked, "print", "left_anti").select("print", F.col("least").alias("component_id"))
    shown = F.lpad(F.lower(F.hex("print")), 16, "0")
    named = skew.attach(prints, linked.unionByName(alone), ["print"], hot)
    return named.select("doc_id", shown.alias("fingerprint"), "component_id")
