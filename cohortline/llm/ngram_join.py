"""N-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows, recursion, exact.

The points are the documents' sets of distinct n-word shingles, the distance is 1 - Jaccard similarity, the radius r is one minus the
threshold. Between texts that share nothing every distance is 1, so document pivots alone cannot separate a corpus. The pivots of the
first level are therefore the shingles themselves (as singleton sets), in one global order:

* A document's nearest pivot is its first shingle in that order; the pivots of its own set follow in turn.
* Triangle inequality with P(c), the set of all pivots before c: a partner y within the radius shares at least (1 - r)|x| shingles of x,
  so at most r|x| pivots of x can lie before the first one both have. x is replicated to its first |x| - ceil((1 - r)|x|) + 1 pivots, and
  every linked pair meets in the region of its first common pivot.
* Shingles that many documents have come last in the order. They are found by counts of every task's batches over all rows. The order
  decides which region a pair meets in, never whether it does.
* Small regions give the pairs that sizes, positions, the number of pivots both windows share and 128 counts by hash allow; documents that such pairs connect
  form a region of their own. Counts by hash alone let most pairs of long texts pass (from about 4,000 shingles on), which would connect all of them.
* These and the large regions hold the full sets of their members. A set whose shingles are too often its own has no partner there. The others are joined in turn by document pivots, those first whose
  shingles most members have: exact distances to a few members, Voronoi
  cells by the nearest, and the cell also takes each document whose distance exceeds that to its own pivot by 2r or less. Cells recurse. A
  cell whose members are already connected is done. Where cells do not shrink, pivots are taken one by one instead, each with
  its distances to all others, until the rest is connected. A region too large for one task is cut into blocks, and each pair of blocks is
  joined, so any size is exact.

Equal sets are one point throughout. 63 bits of a cryptographic hash stand for a set, 64 bits for a shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.durable import durable
from .blobs import SCHEMA, bucket_count, bucket_of, scatter, unpack_all
from .frequent import most_frequent
from .graph import components
from .words import encoded, mix, set_key, shingle_sets, slices

#: Members of a region whose pairs are listed; larger regions are joined by document pivots.
SMALL_REGION = 64
#: Shingles of the members of a region that one task holds.
TASK_SHINGLES = 2_000_000
#: A shingle is put last in the order from so many reported occurrences on; no more of them than the second number are sent to all tasks (8 bytes
#: each, the most frequent). Either only shapes regions.
FREQUENT = 4
FREQUENT_MOST = 300_000
_SKETCH = 128
_WINDOW = ("u8", "i8", "u4", "u4")


def _need(total, share: Fraction):
    """The smallest intersection of two sets of `total` members together that has the similarity."""
    return -(-total * share.numerator // (share.numerator + share.denominator))


def _profiles(n_words: int):
    schema = pa.schema(
        [("kind", pa.int8()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("sketch", pa.binary())]
    )

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new: dict[int, np.ndarray] = {}
            for part in slices([batch]):
                n, keys, sketches = [], [], []
                for values in shingle_sets(encoded(part.column("text").to_pylist()), n_words):
                    key = set_key(values)
                    counts = np.bincount((values & np.uint64(_SKETCH - 1)).astype(np.int64), minlength=_SKETCH)
                    n.append(len(values))
                    keys.append(key)
                    sketches.append(np.minimum(counts, 65535).astype("<u2").tobytes())
                    new.setdefault(key, values)
                zero = pa.array(np.zeros(len(n), np.int8))
                columns = [zero, part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())]
                yield pa.record_batch(columns, schema=schema)
            if not new:
                continue
            # What different sets of one batch share is reported; the reports are added up over all tasks.
            every = np.sort(np.concatenate(list(new.values())))
            new.clear()
            start = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.empty(0, bool))
            count = np.diff(np.concatenate((start, [len(every)])))
            value, count = every[start[count > 1]].view(np.int64), count[count > 1]
            rows = len(value)
            nothing = pa.nulls(rows, pa.int64())
            columns = [pa.array(np.ones(rows, np.int8)), nothing, pa.array(value), pa.array(count.astype(np.int64)), nothing, pa.nulls(rows, pa.binary())]
            yield pa.record_batch(columns, schema=schema)

    return profiles, "kind byte, doc_id long, text_hash long, n long, key long, sketch binary"


class _Frequent:
    """Membership in the frequent shingles: a bitmap first, as nearly all values are not among them."""

    def __init__(self, values: np.ndarray):
        self.values = np.sort(values)
        self.near = np.zeros(1 << 20, dtype=bool)
        self.near[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = self.near[(values >> np.uint64(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.minimum(np.searchsorted(self.values, values[at]), len(self.values) - 1)
            out[at] = self.values[place] == values[at]
        return out


def _windows(n_words: int, share: Fraction, n_buckets: int, frequent):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_frequent = _Frequent(np.frombuffer(frequent.value, dtype=np.uint64))
        for batch in slices(batches):
            pivots, keys, sizes, ranks, seen = [], [], [], [], set()
            for values in shingle_sets(encoded(batch.column("text").to_pylist()), n_words):
                n, key = len(values), set_key(values)
                if not n or key in seen:
                    continue
                seen.add(key)
                w = n + 1 + (-n * share.numerator // share.denominator)
                last = is_frequent(values)
                if last.any():
                    values = np.concatenate((values[~last], values[last]))
                pivots.append(values[:w])
                keys.append(np.full(w, key, np.int64))
                sizes.append(np.full(w, n, np.uint32))
                ranks.append(np.arange(w, dtype=np.uint32))
            if pivots:
                pivot = mix(np.concatenate(pivots))
                columns = [pivot, np.concatenate(keys), np.concatenate(sizes), np.concatenate(ranks)]
                yield from scatter(bucket_of(pivot, n_buckets), columns, ascending=True)

    return windows


def _grouped(code: np.ndarray, n: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each code, ascending: the sum of n, the greatest hi and the least lo."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    start = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
    if not len(start):
        return code, n, hi, lo
    return code[start], np.add.reduceat(n[order], start), np.maximum.reduceat(hi[order], start), np.minimum.reduceat(lo[order], start)


def _regions(share: Fraction):
    """The pairs of small regions (kind 0) and the members of large ones (kind 1: region, key) of a bucket.

    Of a pair: its common pivots in the bucket (n), what the first (hi) and the last of them (lo) leave beyond the smallest intersection, both counted
    from that pivot on, and what the ends of the windows leave (rest)."""

    def regions(table: pa.Table) -> pa.Table:
        pivot, key, size, rank = unpack_all(table.column("data").to_pylist(), _WINDOW, ascending=True)
        order = np.lexsort((rank, key, pivot))
        pivot, key, size, rank = pivot[order], key[order], size[order].astype(np.int64), rank[order].astype(np.int64)
        first = np.ones(len(pivot), dtype=bool)
        first[1:] = (pivot[1:] != pivot[:-1]) | (key[1:] != key[:-1])
        pivot, key, size, rank = pivot[first], key[first], size[first], rank[first]
        start = np.flatnonzero(np.concatenate(([True], pivot[1:] != pivot[:-1])))
        members = np.diff(np.concatenate((start, [len(pivot)])))
        keys, at, own = np.unique(key, return_index=True, return_inverse=True)
        found = []
        for m in np.unique(members[(members > 1) & (members <= SMALL_REGION)]):
            i, j = np.triu_indices(m, 1)
            of_size = start[members == m]
            for part in np.array_split(of_size, max(1, len(of_size) * len(i) // 1_000_000)):
                x, y = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
                need = _need(size[x] + size[y], share)
                ok = np.minimum(size[x], size[y]) >= need
                x, y, need = x[ok], y[ok], need[ok]
                more = np.minimum(size[x] - rank[x], size[y] - rank[y]) - need
                found.append(_grouped(own[x] * len(keys) + own[y], np.ones(len(x), np.int64), more, more))
        code, n, hi, lo = _grouped(*(np.concatenate(c) for c in zip(*found))) if found else (np.empty(0, np.int64),) * 4
        x, y = code // max(1, len(keys)), code % max(1, len(keys))
        n_x, n_y = size[at][x], size[at][y]
        rest = -(-np.maximum(n_x, n_y) * share.numerator // share.denominator) - 1 - _need(n_x + n_y, share)
        large = np.repeat(members > SMALL_REGION, members)
        none = np.zeros(int(large.sum()), np.int64)
        columns = {"kind": np.concatenate((np.zeros(len(code), np.int8), np.ones(len(none), np.int8)))}
        columns |= {"a": np.concatenate((keys[x], pivot[large].view(np.int64))), "b": np.concatenate((keys[y], key[large]))}
        columns |= {k: np.concatenate((v, none)).astype(np.int32) for k, v in (("n", n), ("hi", hi), ("lo", lo), ("rest", rest))}
        return pa.table(columns)

    return regions


_REGIONS = "kind byte, a long, b long, n int, hi int, lo int, rest int"


def _meeting(met: DataFrame) -> DataFrame:
    """The pairs (a, b) of small regions that their common pivots allow.

    All pivots that both windows have are counted, unless one has a large region, where the pair is met as well. From the first, from the last, and
    beyond the end of the window that ends first there can be no more common shingles than are left in either set."""
    pairs = met.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"), F.max("rest").alias("rest"))
    return pairs.where("hi >= 0 and n - 1 + lo >= 0 and n + rest >= 0").select("a", "b")


def _possible(share: Fraction):
    """Pairs whose counts by hash still allow the similarity: the counts' difference is at most the sets'."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(n, _SKETCH).astype(np.int32) for c in ("sketch_a", "sketch_b"))
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            ok = np.abs(x - y).sum(axis=1) <= total - 2 * _need(total, share)
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return possible


def _sets(n_words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, blobs = [], []
            found = shingle_sets(encoded(batch.column("text").to_pylist()), n_words)
            for key, values in zip(batch.column("key").to_pylist(), found):
                if set_key(values) == key:
                    keys.append(key)
                    blobs.append(values.tobytes())
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "members"])

    return sets


class Region:
    """Sets of one region, joined exactly by document pivots. `links` is a spanning forest of the links found."""

    #: Regions of so many sets or fewer are joined by taking each set as a pivot in turn.
    LEAF = 24
    PIVOTS = 8

    def __init__(self, sets: list[np.ndarray], share: Fraction):
        self.share, self.links = share, []
        self.size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.mark = np.zeros(int(self.ids.max()) + 1, dtype=bool)
        self.parent = np.arange(len(sets))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def roots(self, of: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent[of]
            self.parent = up

    def link(self, x: int, others: np.ndarray) -> None:
        for y in others.tolist():
            a, b = self.find(x), self.find(y)
            if a != b:
                self.parent[max(a, b)] = min(a, b)
                self.links.append((x, y))

    def common(self, pivot: int, of: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with the pivot."""
        own = self.ids[self.start[pivot] : self.start[pivot + 1]]
        self.mark[own] = True
        at = np.repeat(self.start[of] - np.concatenate(([0], np.cumsum(self.size[of])[:-1])), self.size[of]) + np.arange(self.size[of].sum())
        hits = self.mark[self.ids[at]]
        self.mark[own] = False
        return np.add.reduceat(hits, np.concatenate(([0], np.cumsum(self.size[of])[:-1])), dtype=np.int64)

    def distances(self, pivot: int, of: np.ndarray) -> np.ndarray:
        """Jaccard distances to the pivot; what is within the radius is linked."""
        common, total = self.common(pivot, of), self.size[of] + self.size[pivot]
        self.link(pivot, of[(common >= _need(total, self.share)) & (of != pivot)])
        return 1 - common / (total - common)

    def one_by_one(self, of: np.ndarray) -> None:
        """Every set as a pivot until those not yet taken are connected, sets of small components first."""
        left = of
        while len(left) > 1:
            root = self.roots(left)
            names, count = np.unique(root, return_counts=True)
            if len(names) == 1:
                return
            pivot = left[np.flatnonzero(root == names[np.argmin(count)])[0]]
            left = left[left != pivot]
            self.distances(int(pivot), left)

    def partnered(self) -> tuple[np.ndarray, np.ndarray]:
        """Sets that may have a partner, and their mean number of sets a shingle is in.

        A set shares with no other the shingles that it alone has. If the others are too few for the smallest set that its size allows, it has no partner;
        without it, more shingles may be in one set only."""
        of = np.arange(len(self.size))
        row = np.repeat(of, self.size)
        while True:
            inside = np.zeros(len(self.size), dtype=bool)
            inside[of] = True
            count = np.bincount(self.ids[inside[row]], minlength=len(self.mark))[self.ids]
            common = np.bincount(row[count > 1], minlength=len(self.size))[of]
            sizes = np.sort(self.size[of])
            least = sizes[np.searchsorted(sizes, -(-self.size[of] * self.share.numerator // self.share.denominator))]
            left = of[common >= _need(self.size[of] + least, self.share)]
            if len(left) > 0.9 * len(of) or not len(left):
                return left, np.bincount(row, weights=count, minlength=len(self.size))[left] / self.size[left]
            of = left

    def join(self, of: np.ndarray | None = None) -> None:
        if of is None:
            of, middle = self.partnered()
            if len(of) > self.LEAF:  # what most others are near copies of links them at once
                for pivot in of[np.argsort(-middle, kind="stable")[: self.PIVOTS]]:
                    self.distances(int(pivot), of)
        if len(of) < 2 or len(np.unique(self.roots(of))) == 1:
            return
        if len(of) <= self.LEAF:
            self.one_by_one(of)
            return
        pivots = of[np.linspace(0, len(of) - 1, self.PIVOTS).astype(int)]
        d = np.stack([self.distances(int(p), of) for p in pivots])
        near, radius = d.min(axis=0), 1 - float(self.share)
        home = d.argmin(axis=0)
        for i in range(len(pivots)):
            cell = of[(home == i) | (d[i] <= near + 2 * radius + 1e-9)]
            if not (home == i).any() or len(cell) < 2 or len(np.unique(self.roots(cell))) == 1:
                continue
            if len(cell) <= 0.7 * len(of):
                self.join(cell)
            else:  # the windows overlap: no region would be smaller, so the rest is joined at once
                self.one_by_one(of)
                return


def _region_links(share: Fraction):
    def region_links(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        keys, at = np.unique(keys, return_index=True)
        blobs = table.column("members").combine_chunks()
        region = Region([np.frombuffer(blobs[int(i)].as_buffer(), dtype=np.uint64) for i in at], share)
        region.join()
        links = np.array(region.links, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": keys[links[:, 0]], "b": keys[links[:, 1]]})

    return region_links


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row for each row of `docs`: doc_id, text_hash, n_shingles, class_id (documents with an equal set share it), component_id, group_id.

    ASCII letters are compared in lower case. component_id is the smallest doc_id that links of at least `similarity` reach, the
    document's own without links. A text without words has no shingles and no links; a missing text counts as one. A missing doc_id
    gets the component of the others of its group, NULL if there are none; group_id, a set's key, names the group in any case (NULL without words). Repeated rows are returned as often as they occur. Other columns are ignored.
    """
    spark, share = docs.sparkSession, Fraction(str(similarity))
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash")
    )
    profiles, schema = _profiles(words)
    found = durable(docs.mapInArrow(profiles, schema))
    stats = found.where("kind = 0")
    counted = durable(found.where("kind = 1").groupBy("text_hash").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT))
    often = most_frequent(counted, FREQUENT_MOST).toArrow().column("text_hash").to_numpy()
    frequent = spark.sparkContext.broadcast(often.astype(np.int64).tobytes())
    records = int((stats.agg(F.sum("n")).first()[0] or 0) * (1 - share)) + 1
    n_buckets = bucket_count(spark, records, 400_000)

    dealt = docs.mapInArrow(_windows(words, share, n_buckets, frequent), SCHEMA)
    met = durable(dealt.groupBy("bucket").applyInArrow(_regions(share), _REGIONS))

    classes = durable(
        stats.where("n > 0")
        .groupBy("key")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash")).alias("r"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .select("key", F.col("r.doc_id").alias("doc_id"), F.col("r.text_hash").alias("text_hash"), "n", "sketch")
    )

    def side(s: str, *cols: str) -> DataFrame:
        return classes.select(F.col("key").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in cols])

    pairs = _meeting(met).join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b")
    pairs = durable(pairs.mapInArrow(_possible(share), "a long, b long"))
    # Documents that chains of possible pairs connect form a region as well, so that a set is sent there once and not with every pair.
    chains = components(pairs).select(F.lit(0).alias("kind"), F.col("component").alias("region"), F.col("node").alias("key"))
    members = durable(met.where("kind = 1").select(F.lit(1).alias("kind"), F.col("a").alias("region"), F.col("b").alias("key")).union(chains))

    wanted = members.select("key").distinct().join(classes.select("key", F.col("doc_id").alias("id"), "text_hash"), "key")
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
    sets = durable(texts.select("key", "text").mapInArrow(_sets(words), "key long, members binary"))

    by = ["kind", "region"]
    sizes = members.join(classes.select("key", "n"), "key").groupBy(*by).agg(F.ceil(F.sum("n") / F.lit(TASK_SHINGLES)).alias("blocks"))
    block = F.pmod(F.xxhash64("key"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    units = (
        members.join(sizes, by)
        .select(*by, "key", block.alias("block"), other.alias("other"))
        .select(*by, "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    )
    by_region = units.join(sets, "key").groupBy(*by, "low", "high").applyInArrow(_region_links(share), "a long, b long")
    linked = components(by_region)
    # The component's smallest doc_id; its name so far is a set's key.
    named = linked.join(classes.select(F.col("key").alias("node"), "doc_id"), "node")
    named = named.join(named.groupBy("component").agg(F.min("doc_id").alias("linked_id")), "component").select(F.col("node").alias("key"), "linked_id", F.col("component").alias("group_id"))
    ids = classes.select("key", F.col("doc_id").alias("own_id")).join(named, "key", "left")
    ids = ids.select("key", F.coalesce("linked_id", "own_id").alias("component"), F.coalesce("group_id", "key").alias("group_id"))
    return stats.join(ids, "key", "left").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("key").alias("class_id"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "group_id"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one document of each group: the one with the smallest id, once. Documents without words all stay."""
    found = durable(shingle_classes(docs, id_col, text_col, words, similarity).where("n_shingles > 0"))
    # Of each group the row with the least id, a missing one last, and the least hash of its text; the join is by the component's own name.
    rank = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("text_hash").isNull().alias("no_text"), "text_hash")
    least = found.groupBy("group_id").agg(F.min(rank).alias("r")).select("group_id", F.col("r.doc_id").alias("l_id"), F.col("r.text_hash").alias("l_hash"))
    marked = found.join(least, "group_id")
    other = ~(F.col("doc_id").eqNullSafe(F.col("l_id")) & F.col("text_hash").eqNullSafe(F.col("l_hash")))
    gone = marked.where(other).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    again = marked.where(~other).groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).count().where("count > 1").drop("count")
    own = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_hash"))
    rest = docs.join(gone, own, "left_anti")
    if not again.take(1):
        return rest
    return rest.join(again, own, "left_anti").union(rest.join(again, own, "left_semi").dropDuplicates([id_col, text_col]))
