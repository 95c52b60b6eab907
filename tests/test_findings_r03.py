"""Tests of what the third review found."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from recallsmith.functions import text
from recallsmith.operators import consolidation, cosine_join, hdc, index


def test_sentences_keep_digits_that_equal_their_place(spark):
    said = "0997 begins the first. 19.37.233.111\vand so on! 2381604611877803 is third?\n  3 spaces go   "
    got = spark.createDataFrame([(said,), (None,)], "t string").select(text.sentences(F.col("t")).alias("s")).collect()
    assert got[0].s == ["0997 begins the first.", "19.37.233.111\vand so on!", "2381604611877803 is third?", "3 spaces go"]
    assert got[1].s is None


def _anywhere(spark, n, d=16, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"v{i:05}", rng.standard_normal(d).tolist(), int(i % 3)) for i in range(n)]
    return spark.createDataFrame(rows, "id string, embedding array<double>, label int")


def test_a_vector_is_shuffled_to_few_bundles(spark, monkeypatch):
    """Vectors without any structure: however many parts there are, a vector goes to at most SHARES bundles or so."""
    monkeypatch.setattr(cosine_join, "PART", 8)
    v = _anywhere(spark, 1200)
    heads, _ = cosine_join.classes(v)
    cells = cosine_join._fit(heads, math.acos(0.4), 256)
    assert sum(sum(own.parts.values()) for own in cells.values()) > 120
    visits = cosine_join._visits(heads, cells)
    assert visits.count() <= 1200 * (cosine_join.SHARES + 8) / 2
    assert visits.where("NOT visitor").count() == 1200


def test_tiles_are_small_and_blocks_use_them(spark, monkeypatch):
    v = _anywhere(spark, 500)
    x = np.array([r.embedding for r in v.orderBy("id").collect()])
    x /= np.sqrt((x * x).sum(1))[:, None]
    sim = np.round(x @ x.T, 6)
    want = {(f"v{i:05}", f"v{j:05}") for i, j in zip(*np.nonzero(np.triu(sim >= 0.3, 1)), strict=True)}
    monkeypatch.setattr(cosine_join, "TILE", 64)
    monkeypatch.setattr(cosine_join, "PART", 100)
    monkeypatch.setattr(cosine_join, "BUNDLE_BYTES", 1 << 10)
    got = [(r.a, r.b) for r in consolidation.similar_pairs(v, 0.3).collect()]
    assert len(got) == len(want) and set(got) == want
    blocked = consolidation.similar_pairs(v, 0.3, "label")
    got = [(r.a, r.b) for r in blocked.collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if int(a[1:]) % 3 == int(b[1:]) % 3}
    assert "mapinarrow" in blocked._jdf.queryExecution().toString().lower()


def test_clusters_shuffle_a_forest(spark):
    """All pairs of 300 nodes in two groups: few edges are left of them, and their number is kept."""
    rows = [(f"n{i:03}", f"n{j:03}") for i in range(300) for j in range(i + 1, 300) if i % 2 == j % 2]
    pairs = spark.createDataFrame(rows, "a string, b string").repartition(4)
    tree = consolidation.forest(pairs)
    assert tree.count() < 4 * 300 + 50 and tree.agg(F.sum("n")).first()[0] == len(rows)
    assert {r.id: r.cluster for r in consolidation.clusters(pairs).collect()} == {f"n{i:03}": f"n{i % 2:03}" for i in range(300)}
    assert consolidation.summary(tree, consolidation.clusters(tree)).first().asDict() == {"clusters": 2, "total_superseded": 300, "pairs_found": len(rows)}


def test_majority_by_adders_equals_counting():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 4, 7, 33, 96):
        vs = [rng.integers(0, 1 << 64, 3, dtype=np.uint64) for _ in range(n)]
        bits = np.unpackbits(np.array([v.view(np.uint8) for v in vs]), axis=1, bitorder="little").sum(0)
        odd = np.arange(192) % 2 == 1
        want = (2 * bits > n) | ((2 * bits == n) & odd)
        assert (np.unpackbits(hdc.majority_of(vs).view(np.uint8), bitorder="little").astype(bool) == want).all()


def test_vectors_are_made_in_small_batches(spark):
    """The session's batches are bounded in bytes, and packed vectors are those of plain ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
    m = spark.createDataFrame([(str(i), f"words number {i} of a text") for i in range(600)], "id string, text string").coalesce(1)
    plain = {r.id: list(r.hv) for r in hdc.index(m, 4).collect()}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    packed = {r.id: np.frombuffer(bytes(r.hv), "<i8").tolist() for r in hdc.index(m, 4, packed=True).collect()}
    assert packed == plain and len(plain) == 600


def _counted_prefixes(rows):
    out = Counter()
    for t in rows:
        words = {w for w in re.findall("[a-z0-9]+", (t or "").lower()) if len(w) >= 3}
        out.update({w[:k] for w in words for k in range(3, min(len(w), 32) + 1)})
    return out


def test_postings_are_grouped_in_tasks_without_a_shuffle(spark, tmp_path, monkeypatch):
    """A word of a block is one row, however many runs a task has; prefixes and counts equal those of all words, with rows that are deleted too."""
    monkeypatch.setattr(index, "RUN", 700)
    monkeypatch.setattr(index, "ROWS", 50)
    rng = np.random.default_rng(2)
    words = [f"{'abc'[i % 3] * (1 + i % 5)}word{i % 40}" for i in range(200)] + ["ab", "q" * 40]
    texts = {f"m{i}": " ".join(rng.choice(words, rng.integers(1, 90))) for i in range(400)} | {"none": None, "empty": "", "short": "a bc"}
    m = spark.createDataFrame(list(texts.items()), "id string, text string").repartition(3)
    idx = index.build(m, f"file://{tmp_path}/i")
    docs = spark.read.schema(index._DOCS).parquet(f"file://{tmp_path}/i/segments/*/docs")
    assert "Exchange" not in index._grouped(docs)._jdf.queryExecution().executedPlan().toString()
    rows = idx._rows("postings", index._POSTINGS)
    assert rows.count() == rows.select("term", "block").distinct().count() < idx.postings().count() / 2
    for gone in ([], [f"m{i}" for i in range(0, 400, 3)] + ["none"]):
        if gone:
            idx.delete(spark.createDataFrame([(x,) for x in gone], "id string"))
        live = {k: t for k, t in texts.items() if k not in gone}
        want = _counted_prefixes(live.values())
        asked = [p for p in want if len(p) <= 32][::7] + ["absent"]
        assert idx.counts(asked) == {p: want[p] for p in asked}
        each = {(r.term, r.id, r.tf) for r in idx.postings().collect()}
        assert each == {(w, k, n) for k, t in live.items() for w, n in Counter((t or "").split()).items() if len(w) >= 3}
        posted, df = idx.of_words(spark.createDataFrame([(words[0],), (words[1],), ("absent",)], "term string"))
        own = {(t, k) for t, k, _ in each if t in words[:2]}
        assert {(r.term, r.id) for r in posted.collect()} == own
        assert {r.term: r.df for r in df.collect()} == Counter(t for t, _ in own)
    assert index.TextIndex(spark, f"file://{tmp_path}/none").of_words(m.select(F.col("id").alias("term")))[1].count() == 0
