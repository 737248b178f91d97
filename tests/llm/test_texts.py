"""Operators on documents against plain versions, with missing, empty, long, repeated and copied texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from helpers import counts, links, prose, without_repeats
from tokenizers import Tokenizer

from cohortline.llm import bpe_lexicon, frequent, ngram_join, packing, quality_rules, site_classifier, statistics, suffix_dedup, syncmers
from cohortline.llm.blobs import pack, unpack
from cohortline.llm.words import shingle_sets


def same(a, b):
    assert Counter(map(tuple, a)) == Counter(map(tuple, b))


def test_join_equals_all_pairs(docs, rows):
    got = ngram_join.shingle_classes(docs).select("doc_id", "n_shingles", "component_id").collect()
    same(got, [(r[0], *x) for r, x in zip(rows, links(rows))])


def test_join_of_large_regions(spark, monkeypatch):
    """Chains of near copies in regions beyond the listed size, cut into blocks."""
    monkeypatch.setattr(ngram_join, "SMALL_REGION", 3)
    monkeypatch.setattr(ngram_join, "TASK_SHINGLES", 2_000)
    base = prose(11, 90).split(" ")
    rows = []
    for i in range(150):
        words = list(base)
        for k in range(i % 9):
            words[(i * 7 + k * 13) % 90] = f"new{i}{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, prose(100 + i, 50)) for i in range(20)]
    got = ngram_join.shingle_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), [(r[0], *x) for r, x in zip(rows, links(rows))])


def test_long_texts_with_few_common_shingles_are_no_pairs(spark, monkeypatch):
    """Counts by hash tell nothing about texts of thousands of shingles; the number of pivots they share does."""
    met = []
    monkeypatch.setattr(ngram_join, "components", lambda edges, f=ngram_join.components: (met.append(edges.count()), f(edges))[1])
    common = [prose(500 + i, 5) for i in range(40)]
    texts = [" ".join(prose(600 + i, 6000).split(" ") + common[i % 40 :] + common[: i % 40]) for i in range(8)]
    words = texts[3].split(" ")
    words[10:13] = ["an", "edit"]
    rows = [*enumerate(texts), (8, " ".join(words))]
    got = ngram_join.shingle_classes(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id")
    same(got.collect(), [(r[0], *x) for r, x in zip(rows, links(rows))])
    assert met[0] == 1


def test_region_of_copies_takes_few_pivots(monkeypatch):
    """Copies of one set that are linked to it but not to each other, and others that are too far from all."""
    taken = []
    monkeypatch.setattr(ngram_join.Region, "distances", lambda self, pivot, of, f=ngram_join.Region.distances: (taken.append(pivot), f(self, pivot, of))[1])
    rng = np.random.default_rng(1)
    base = np.arange(400)

    def copy(i, n):
        own = rng.choice(400, n, replace=False)
        return np.sort(np.concatenate((np.delete(base, own), 1_000 * (i + 1) + np.arange(n)))).astype(np.uint64)

    sets = [copy(i, 40 if i % 2 else 60) for i in range(300)] + [base.astype(np.uint64)]
    region = ngram_join.Region(sets, ngram_join.Fraction("0.8"))
    region.join()
    roots = region.roots(np.arange(301))
    assert len(set(roots[1::2][:150].tolist()) | {roots[300]}) == 1 and len(set(roots.tolist())) == 151
    assert len(taken) < 30


def test_region_finds_every_component():
    rng = np.random.default_rng(0)
    sets = []
    for c in range(12):
        base = rng.integers(0, 1 << 60, 80).astype(np.uint64)
        for _ in range(15):
            own = base.copy()
            own[rng.integers(0, 80, rng.integers(0, 14))] = rng.integers(0, 1 << 60, 1).astype(np.uint64)
            sets.append(np.unique(own))
    region = ngram_join.Region(sets, ngram_join.Fraction("0.8"))
    region.join()
    whole = ngram_join.Region(sets, ngram_join.Fraction("0.8"))
    for i in range(len(sets)):
        whole.distances(i, np.arange(len(sets)))
    ends = [x.roots(np.arange(len(sets))) for x in (region, whole)]
    assert (ends[0][:, None] == ends[0]).tolist() == (ends[1][:, None] == ends[1]).tolist()


def test_one_of_near_copies_stays(docs, rows):
    got = [r.text for r in ngram_join.near_duplicates(docs).collect()]
    groups = defaultdict(set)
    for r, (n, component) in zip(rows, links(rows)):
        if n:
            groups[component if component is not None else r[1]].add(r[0])
    assert len([x for x in got if x and x.strip()]) == len(groups)
    assert len([x for x in got if not x or not x.strip()]) == sum(1 for _, n in zip(rows, links(rows)) if not n[0])


def test_one_of_near_copies_without_own_ids_stays(spark):
    base, other, third = prose(21, 100), prose(22, 100), prose(23, 100)
    rows = [(None, base), (None, base + " more"), (7, other), (7, other + " more"), (7, other), (None, third), (9, third + " more"), (None, "")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and Counter(r.doc_id for r in got) == {None: 2, 7: 1, 9: 1}


def test_repeats_equal_brute_force(docs, rows):
    got = suffix_dedup.remove_repeats(docs, with_text=True, keep=("n_chars",)).collect()
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], [(r[0], *x) for r, x in zip(rows, without_repeats(rows))])
    for r in got:
        assert sum(b - a for a, b in zip(r.span_starts, r.span_ends)) == r.n_removed


def test_repeats_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 200)
    rows = [(i, prose(i % 4, 30) + " " + prose(50, 10 + i) + "é" * (i % 3) + " " + prose(i, 200)) for i in range(12)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()], [(r[0], *x) for r, x in zip(rows, without_repeats(rows))])


@pytest.mark.parametrize("hot_runs", [0, 3])
def test_repeats_of_hot_anchors(spark, docs, rows, hot_runs):
    """Anchors settled by windows: in every document a passage among other words, in some twice; later copies with a changed letter; over several partitions."""
    shared = prose(60, 25)
    more = [(100 + i, prose(70 + i, 12) + " " + shared + " " + prose(90 + i, 12) + (" " + shared if i % 3 else "")) for i in range(20)]
    more += [(130 + i, more[i][1][: 40 + i] + "?" + more[i][1][41 + i :]) for i in range(20)] + [(None, shared), (139, shared)]
    for table, known in ((docs, rows), (spark.createDataFrame(more, "doc_id long, text string").repartition(5), more)):
        got = suffix_dedup.remove_repeats(table, hot_runs=hot_runs).collect()
        same([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got], [(r[0], *x) for r, x in zip(known, without_repeats(known))])


def test_counts(rows):
    table = statistics.counts([(r[1] or "").encode() for r in rows])
    assert [tuple(x[:5]) for x in table.tolist()] == [counts(r[1]) for r in rows]


def test_rules_on_awkward_rows(docs, rows, labels):
    got = quality_rules.judge(docs, labels).collect()
    same([(r.doc_id, *r[1:6]) for r in got], [(r[0], *counts(r[1])) for r in rows])
    assert all(not r.kept for r in got if r.base_failed) and quality_rules.keep_good(docs, labels).columns == docs.columns


def test_learned_list():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(statistics.FEATURES)))
    bad = (x[:, 0] > 0.8) & (x[:, 3] <= 0.5) | (x[:, 5] > 0.9)
    rules = quality_rules.learn(x[:2000], bad[:2000])
    found = np.logical_or.reduce([quality_rules._covered(r, x[2000:]) for r in rules])
    assert (found == bad[2000:]).mean() > 0.97 and all(len(r) <= quality_rules.MOST_CONDITIONS for r in rules)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where("doc_id % 3 = 0").collect()
    taught = labels.where("doc_id % 3 <> 0")
    kept = {r.doc_id: r.kept for r in site_classifier.classify(docs, taught).collect()}
    right = [kept[r.doc_id] == (r.quality == 1 and r.toxic == 0) for r in held]
    assert sum(right) / len(right) > 0.85
    clean = [kept[r.doc_id] for r in held if r.quality == 1 and r.toxic == 0]
    assert sum(clean) / len(clean) > 0.95
    by_rule = {r.doc_id: r for r in quality_rules.judge(docs, taught).collect()}
    right = [(by_rule[r.doc_id].rule is None) == (r.quality == 1) for r in held if not by_rule[r.doc_id].base_failed]
    assert sum(right) / len(right) > 0.95


def test_classifier_on_awkward_rows(docs, rows, labels):
    got = site_classifier.classify(docs, labels)
    assert got.count() == len(rows)
    assert site_classifier.keep_good(docs, labels.limit(0)).count() == len(rows)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(packing.tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encoding_equals_the_library(docs, rows, tokenizer):
    expected = []
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        shown = " ".join(map(str, ids))
        expected.append((r[0], len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    for size in (0, 40, 65_536):
        same(bpe_lexicon.encode(docs, lexicon_words=size).collect(), expected)


def test_every_code_point_as_the_library_has_it(tokenizer):
    """Each between letters, up to U+20000 also alone and behind a digit; both encoders."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    lexicon_free = bpe_lexicon.Encoder(bpe_lexicon.Merges(packing.tokenizer_path()), tokenizer, None)
    lexicon_free.lexicon = None
    by_parts = packing.PartIds(None)
    for a in range(0, len(points), 40_000):
        texts = [f"{c} 1{c} b{c}a" if c < "\U00020000" else f"b{c}a" for c in points[a : a + 40_000]]
        expected = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lexicon_free.forget()
        for text, ids, (n, shown, _) in zip(texts, expected, lexicon_free.texts(texts)):
            assert (n, shown) == (len(ids), " ".join(map(str, ids))), ascii(text)
        ids, edge = by_parts(texts)
        assert [ids[x:y].tolist() for x, y in zip(edge[:-1], edge[1:])] == expected


def test_forgotten_parts_are_learned_again(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED", 12)
    encode = packing.PartIds(None)
    texts = [f"{prose(i % 5, 6)}, {prose(i, 3)}. the the" for i in range(30)]
    for text in texts:
        ids, edge = encode([text, None])
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids and edge.tolist() == [0, len(ids), len(ids)]
        assert len(encode.known.keys) < 40


def test_lexicon_is_minimal_and_finds_its_words(tmp_path):
    words = [b"tap", b"taps", b"top", b"tops", b"a", b"\xc3\xa9t\xc3\xa9"]
    data = bpe_lexicon.compile_lexicon(words, {w: [i, i + 1] for i, w in enumerate(words)})
    (tmp_path / "lexicon").write_bytes(data)
    lexicon = bpe_lexicon.Lexicon(str(tmp_path / "lexicon"))
    places = lexicon.find([*words, b"ta", b"tapsx", b"", b"zz"])
    assert [lexicon.sequence(p) for p in places[:6]] == [[i, i + 1] for i in range(6)] and (places[6:] == -1).all()
    # The start, t, ta = to, tap = top, one end for all words, and four inside the accented one.
    assert len(lexicon.accepts) == 9


def test_packing_takes_few_texts_at_a_time(monkeypatch):
    """A worker's memory grows with the bytes whose ids are found at once."""
    taken = []
    monkeypatch.setattr(packing, "part_ids", lambda path, f=packing.part_ids: lambda texts: (taken.append(sum(map(len, texts))), f(path)(texts))[1])
    texts = [prose(300 + i, 20_000) for i in range(8)] * 8
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts})
    got = list(packing._pieces(None, 2, 4096, False)(iter([batch])))
    assert sum(taken) == sum(map(len, texts)) > 7_000_000 and max(taken) < 2_500_000
    assert sorted({r for b in got for r in b.column("doc_id").to_pylist()}) == list(range(len(texts)))


def test_packing(docs, rows, tokenizer):
    got = packing.pack(docs, with_ids=True).collect()
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append((r.start, r.ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    expected = Counter((r[0], tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    for doc_id in {r[0] for r in rows}:
        joined = Counter()
        for (i, ids), n in expected.items():
            if i == doc_id:
                for start in range(0, len(ids), packing.WINDOW):
                    joined[start, ids[start : start + packing.WINDOW], len(ids)] += n
        assert Counter((s, tuple(i), n) for s, i, n in by_doc[doc_id]) == joined


def test_best_fit_takes_the_tightest_window():
    lengths = np.random.default_rng(2).integers(1, 101, 500)
    where, offset = packing.best_fit_decreasing(lengths, 100)
    room, expected = [], np.zeros(len(lengths), int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [w for w in range(len(room)) if room[w] >= lengths[i]]
        if not fits:
            room.append(100)
            fits = [len(room) - 1]
        w = min(fits, key=lambda x: room[x])
        expected[i] = room[w]
        room[w] -= lengths[i]
    assert len(set(where.tolist())) == len(room) and (100 - offset == expected).all()


def test_fingerprints(docs, rows):
    got = syncmers.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for r, text in ((g, t) for g in got for t in [next(x[1] for x in rows if x[0] == g.doc_id and len(x[1] or "") == g.n_chars)]):
        assert by_text.setdefault(text or "", r.fingerprint) == r.fingerprint
    ids = sorted({r[0] for r in rows if r[0] is not None})
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    first_null = [r for r in got if r.doc_id is None]
    assert len(first_null) == 2
    for i, nxt in zip(ids, ids[1:]):
        q = len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - q] + texts[nxt][:q]
        assert {r.edited_sha256 for r in got if r.doc_id == i} == {hashlib.sha256(edited.encode()).hexdigest()}


def _spark_hash(*values):
    """XXH64 of strings and longs in a row, as Spark chains it."""
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_anchors(text):
    """The anchors of a text by the definition: (word, hash)."""
    words = [_spark_hash(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    found = []
    for i in range(len(words) - syncmers.K + 1):
        run = words[i : i + syncmers.K]
        inner = [_spark_hash(a, b) for a, b in zip(run, run[1:])]
        if min(inner) in (inner[0], inner[-1]):
            halves = [_spark_hash(inner[k], inner[k + 2]) for k in (0, 4)]
            found.append((i, _spark_hash(*halves)))
    return found or ([(0, _spark_hash(*words))] if words else [])


def plain_likeness(a, b):
    a, b = (set(sorted({h for _, h in x})[: syncmers.SKETCH]) for x in (a, b))
    both = sorted(a | b)[: syncmers.SKETCH]
    return len(set(both) & a & b) / len(both) if both else 1.0


def test_fingerprints_equal_brute_force(spark):
    base = prose(31, 300)
    texts = [base, base.replace(base.split()[150], "other", 1), "zz " * 5 + base, prose(32, 9), prose(33, 3), "", prose(34, 2000), "é ß\x0bÀ  " + prose(35, 40)]
    texts += [prose(40 + n, n) for n in range(6, 20)]
    rows = [(7 * i, t, "own", 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, other string, need long")).collect()}
    for i, text in enumerate(texts):
        following, quarter, r = texts[(i + 1) % len(texts)], len(text) // 4, got[7 * i]
        edited = text[: len(text) - quarter] + following[:quarter]
        own, other = plain_anchors(text), plain_anchors(edited)
        shown = "".join(f"{(h % (1 << 64)) >> 32:08X}" for h in sorted({h for _, h in own})[: syncmers.SKETCH])
        assert r.fingerprint == shown and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(plain_likeness(own, other)) and r.near_next == pytest.approx(plain_likeness(own, plain_anchors(following)))


def test_anchors_at_the_same_place(spark):
    """Positional matching by brute force: a shared beginning keeps its anchors, a shift loses them."""
    base = prose(31, 300)
    pairs = [(base, base), (base, base + " more"), (base, base.replace(base.split()[150], "other", 1)), (base, "zz " + base), (base, ""), ("", ""), ("", base), (prose(33, 3), prose(33, 3)), (base, prose(36, 300))]
    df = syncmers.with_anchors(syncmers.with_anchors(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string"), "a", "x"), "b", "y")
    got = {r.i: r.s for r in df.select("i", syncmers.same_place(df.x, df.y).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        own, other = plain_anchors(a), plain_anchors(b)
        assert got[i] == pytest.approx(len(set(own) & set(other)) / len(own) if own else float(not other))
    assert got[0] == got[1] == 1 and 0.8 < got[2] < 1 and got[3] < 0.2


def test_syncmers_equal_a_plain_loop(spark):
    texts = [prose(s, n) for s, n in ((1, 5), (2, 8), (3, 9), (4, 200))]
    df = syncmers.with_anchors(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "own")
    for r in df.collect():
        n = len(r.text.split(" "))
        assert len(r.own) == (1 if n < syncmers.K else n - syncmers.K + 1)
    # The same run of words is an anchor, or not, wherever it stands.
    moved = syncmers.with_anchors(spark.createDataFrame([("zz " * 11 + texts[3],)], "text string"), "text", "own").first().own
    assert moved[11:] == df.collect()[3].own


def test_short_texts_without_anchors(spark):
    """From 8 to 12 words a text need not hold a closed syncmer."""
    texts = [prose(100 * n + s, n) for n in range(8, 13) for s in range(12)] + ["", " \n"]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    prints = [got[i].fingerprint for i in range(60)]
    assert len(set(texts[:60])) == 60 and len(set(prints)) == 60 and all(prints)
    assert all(got[i].near_next == 0 for i in range(60)) and (got[60].near_next, got[60].fingerprint, got[61].fingerprint) == (1, "", "")
    # An edit of a text without an anchor is seen.
    alone = syncmers.with_anchors(spark.createDataFrame(list(enumerate(texts[:60])), "doc_id long, text string"), "text", "own")
    alone = alone.where("own[0] = xxhash64(transform(split(text, ' '), w -> xxhash64(w)))").collect()
    hashed = {r.doc_id: r.own for r in alone}
    assert len(hashed) > 5 and all(len(x) == len(texts[i].split(" ")) - syncmers.K + 1 and set(x[1:]) <= {None} for i, x in hashed.items())
    assert all(got[i].near_edited < 1 for i in hashed)


def test_sketches_are_shuffled_once(docs, spark, monkeypatch, capsys):
    """Texts are dealt once for both joins, and sketches only with the heads of the next texts; no copy of them is written."""
    copies, write = [], syncmers.durable
    monkeypatch.setattr(syncmers, "durable", lambda df: copies.append(df.dtypes) or write(df))
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        found = syncmers.fingerprints(docs)
        found.explain("formatted")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert copies and not [c for copy in copies for c in copy if c[1].startswith("array") or c[0] == "text"]
    dealt = [re.sub(r"#\d+L?", "", x).split(", ") for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)]
    assert sum({"k", "text"} <= {*x} for x in dealt) == 1 and not [x for x in dealt if {"own", "other", "edited"} & {*x}]
    assert sum(x[0] == "ask_k" and len(x) > 2 and "next_k" not in x for x in dealt) == 1


def test_empty_tables(no_docs, labels):
    for made in (
        ngram_join.shingle_classes(no_docs), ngram_join.near_duplicates(no_docs), suffix_dedup.remove_repeats(no_docs), quality_rules.judge(no_docs, labels.limit(0)), site_classifier.classify(no_docs, labels),
        bpe_lexicon.encode(no_docs), packing.pack(no_docs), syncmers.fingerprints(no_docs),
    ):
        assert made.count() == 0


def test_packed_arrays():
    columns = [np.sort(np.random.default_rng(3).integers(0, 1 << 63, 100).astype(np.uint64)), np.arange(100, dtype=np.int32)]
    back = unpack(pack(columns, ascending=True), ("u8", "i4"), ascending=True)
    assert all((a == b).all() for a, b in zip(columns, back)) and len(unpack(pack([columns[0][:0]]), ("u8",))[0]) == 0


def test_short_texts_are_one_shingle():
    sets = list(shingle_sets([b"a b", b"A  B", b"a b c d e", b"", b" "]))
    assert [len(x) for x in sets] == [1, 1, 1, 0, 0] and sets[0][0] == sets[1][0] != sets[2][0]


def test_most_frequent_rows(spark):
    counts = spark.createDataFrame([(i, 1 + i % 70 + (i % 13) * 900) for i in range(500)], "w long, n long").repartition(5)
    values = sorted((r.n for r in counts.collect()), reverse=True)
    for size in (0, 1, 40, 200, 499, 500, 10**6):
        got = sorted((r.n for r in frequent.most_frequent(counts, size).collect()), reverse=True)
        assert len(got) <= size and got == values[: len(got)]
        # What is left out begins a class that no longer fits; classes are 32nds of a power of two, or single counts.
        if len(got) < len(values):
            first = values[len(got)]
            low = max(first.bit_length() - frequent.BITS, 0)
            assert len(got) + sum(v >> low == first >> low and v.bit_length() == first.bit_length() for v in values) > size
    assert frequent.most_frequent(counts.limit(0), 5).count() == 0
