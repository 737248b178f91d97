"""SimHash near copies against all pairs."""

from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import prose

from cohortline.llm import simhash_anchors as anchors


def plain_print(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids):
    group = list(range(len(prints)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4:
                group[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(prints))]


def around(rng, centre, n, most):
    out = []
    for _ in range(n):
        bits = rng.choice(64, rng.integers(0, most + 1), replace=False)
        out.append(int(centre) ^ sum(1 << int(b) for b in bits))
    return out


def check_prints(spark, values):
    """Components of a table of fingerprints, found by the places."""
    distinct = sorted(set(values))
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in distinct], "print long").repartition(3)
    found = anchors.graph.components(anchors.links(frame, len(distinct))).collect()
    got = {r.node % (1 << 64): r.component for r in found}
    expected = plain_components(distinct, list(range(len(distinct))))
    pairs = {(e, got.get(v, v if v < 1 << 63 else v - (1 << 64))) for v, e in zip(distinct, expected)}
    assert len(pairs) == len(set(expected)) == len({p[1] for p in pairs})


@pytest.mark.parametrize("blocks", [3, 2])
def test_every_pair_meets(blocks):
    """Four bits anywhere: the pair meets at the home anchor of one of them."""
    rng = np.random.default_rng(blocks)
    values = rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 300, dtype=np.uint64)
    for v in values.tolist()[: 300 if blocks == 3 else 60]:
        other = v ^ sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        keys, at, home = anchors.places(np.array([v, other], dtype=np.uint64), blocks)
        for one, two in ((0, 1), (1, 0)):
            assert set(keys[home & (at == one)].tolist()) & set(keys[at == two].tolist())


@pytest.mark.parametrize("width", [21, 22, 32])
def test_code_covers(width):
    code = anchors.Code(width, 2)
    words = np.random.default_rng(width).integers(0, 1 << width, 200).astype(np.uint64)
    for at, places in code.anchors(words):
        assert (code.syndrome(places.ravel()) == 0).all()
        far = np.bitwise_count(places ^ words[at][:, None])
        assert (far[:, 0] <= 1).all() and (far <= 2).all() and all(len(set(p)) == len(p) for p in places.tolist())


def test_components_of_prints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = around(rng, 0, 150, 5) + around(rng, (1 << 64) - 1, 40, 6) + around(rng, 0x5555555555555555, 60, 9)
    values += [int(x) for x in rng.integers(0, 1 << 63, 200)]
    check_prints(spark, values)
    with monkeypatch.context() as m:  # crowded anchors, split into groups, and places too large for all pairs
        m.setattr(anchors, "CROWD", 20)
        m.setattr(anchors, "SLICE", 100)
        m.setattr(anchors, "AT_ONCE", 30)
        assert anchors._crowded(spark.createDataFrame([(v,) for v in range(300)], "print long"), 3, 300)
        check_prints(spark, values)
    with monkeypatch.context() as m:
        m.setattr(anchors, "MANY", 10)
        check_prints(spark, values[:60])


def test_documents(spark, docs, rows, monkeypatch):
    expected = [plain_print(r[1]) for r in rows]
    parts = plain_components(expected, [r[0] for r in rows])
    shown = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(rows, expected, parts))
    assert Counter(map(tuple, anchors.near_copies(docs).collect())) == shown
    monkeypatch.setattr(anchors.skew, "HOT_ROWS", 2)
    assert Counter(map(tuple, anchors.near_copies(docs).collect())) == shown


def test_prints_of_long_texts(monkeypatch):
    texts = ["", " \n", "a", "A b  c", "a b c d", prose(1, 500), "x" * 300, "x" * 300 + " y", prose(2, 3) + " " + "z" * 400 + "\x0b" + prose(3, 9)]
    for size in (2_000_000, 50, 7):
        monkeypatch.setattr(anchors, "PART", size)
        assert [anchors.fingerprint(t.encode()) for t in texts] == [plain_print(t) for t in texts]


def test_no_documents(no_docs, spark):
    assert anchors.near_copies(no_docs).count() == 0
    blank = spark.createDataFrame([(3, None), (2, " "), (None, ""), (7, "a b c d e")], "doc_id long, text string")
    got = anchors.near_copies(blank).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == {(3, 2): 1, (2, 2): 1, (None, 2): 1, (7, 7): 1}
