"""Stored indexes that grow: equal to full scans and rebuilds, whatever the order of changes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recallsmith.operators import hdc, index, retrieval
from recallsmith.operators.hamming import VectorIndex, margin
from recallsmith.operators.index import TextIndex
from recallsmith.plans import adapters as a

WORDS = "alpha beta gamma delta things thing thinker string stringent rest restless omega x ab".split()


def _texts(n, seed=0):
    rng = random.Random(seed)
    return [(f"m{i}", " ".join(rng.choices(WORDS, range(len(WORDS), 0, -1), k=rng.choice((1, 3, 9, 40, 200))))) for i in range(n)]


def _same(rows, want):
    assert [(r["id"], round(r["score"], 8)) for r in rows] == [(r["id"], round(r["score"], 8)) for r in want]


@pytest.fixture(scope="module")
def store(spark):
    return spark.createDataFrame([*_texts(900), ("none", None), ("empty", ""), ("long", "thing " * 30000 + "omega")], "id string, text string").cache()


@pytest.fixture(scope="module", params=[4, 128])
def built(request, store, tmp_path_factory):
    before, index.BLOCK = index.BLOCK, request.param
    yield index.build(store, f"file://{tmp_path_factory.mktemp('x')}/i")
    index.BLOCK = before


@pytest.mark.parametrize("query", ["thing omega", "th thi thinker", "string alpha thing beta", "absent", "omega absent"])
def test_pruned_search_equals_scan(spark, store, built, query):
    every = retrieval.bm25(store, query).orderBy(F.desc("score"), "id").collect()
    _same(built.best(query, 7).collect(), every[:7])
    _same(built.best(query, 7, store.where("id LIKE '%3'")).collect(), [r for r in every if r["id"].endswith("3")][:7])
    _same(built.bm25(query).orderBy(F.desc("score"), "id").collect(), every)


def test_blocks_are_skipped(spark, tmp_path, monkeypatch):
    """A query of a frequent word reads a few blocks of its postings, and the same rows come out; joins instead of lookups find them too."""
    monkeypatch.setattr(index, "BLOCK", 16)
    rows = [(f"m{i}", "thing " * (1 + (i % 50 == 0) * 9) + " ".join(f"w{i}x{j}" for j in range(20 + i % 7))) for i in range(1500)] + [(f"o{i}", "other words") for i in range(2500)]
    m = spark.createDataFrame(rows, "id string, text string")
    idx = index.build(m, f"file://{tmp_path}/i")
    want = retrieval.bm25(m, "thing").orderBy(F.desc("score"), "id").limit(5).collect()
    found, took = idx.search("thing", 5)
    _same(found.collect(), want)
    assert took["postings"] == 1500 and took["read"] < 500
    monkeypatch.setattr(index, "LOOKUP", 0)
    _same(idx.best("thing", 5).collect(), want)
    monkeypatch.setattr(index, "BROADCAST_ROWS", 0)
    _same(idx.best("thing", 5).collect(), want)


def test_any_order_of_changes_equals_a_rebuild(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    rng, live = random.Random(5), {}
    idx = TextIndex(spark, f"file://{tmp_path}/grown")
    assert idx.best("thing", 5).collect() == [] and idx.merge().numbers() == (0, 0.0)
    for step, act in enumerate(["append", "append", "delete", "replace", "merge", "delete", "append", "small", "delete all of one", "append"]):
        if act in ("append", "replace"):
            new = [(f"m{step}_{i}", t) for i, (_, t) in enumerate(_texts(40, step))]
            if act == "replace":
                new += [(i, "thing again restless") for i in rng.sample(sorted(live), 15)]
            idx.append(spark.createDataFrame([*new, new[0], (None, "thing")], "id string, text string"))
            live.update(new)
        elif act.startswith("delete"):
            gone = rng.sample(sorted(live), 20) if act == "delete" else [i for i in live if i.startswith("m6_")]
            idx.delete(spark.createDataFrame([(i,) for i in [*gone, gone[0], "unknown"]], "id string"))
            for i in gone:
                del live[i]
        else:
            idx.merge(60 if act == "small" else None)
        m = spark.createDataFrame(sorted(live.items()), "id string, text string")
        n, words = len(live), sum(len(t.split()) for t in live.values())
        assert idx.numbers() == (n, words / n)
        if step in (5, 7, 9):
            again = TextIndex(spark, idx.path)  # a reader of its own
            _same(again.best("thing rest", 9).collect(), retrieval.bm25(m, "thing rest").orderBy(F.desc("score"), "id").limit(9).collect())


def test_long_prefixes_and_deletes_are_counted(spark, tmp_path):
    long = "q" * 50
    m = spark.createDataFrame([("a", long + "x y"), ("b", long + "z " + long), ("c", "q" * 33), ("d", "other words")], "id string, text string")
    idx = index.build(m, f"file://{tmp_path}/i")
    assert idx.counts([long, "qqq", "q" * 32, "q" * 33]) == {long: 2, "qqq": 3, "q" * 32: 3, "q" * 33: 3}
    idx.delete(m.where("id = 'b'"))
    assert idx.counts([long, "qqq", "q" * 33, "oth"]) == {long: 1, "qqq": 2, "q" * 33: 2, "oth": 1}


def test_unfinished_changes_are_not_seen(spark, store, tmp_path):
    idx = index.build(store.limit(50), f"file://{tmp_path}/i")
    before = idx.numbers()
    number, at = idx.manifest.fresh()
    index.counted(store).write.parquet(f"{at}/docs")  # a writer that died
    assert TextIndex(spark, idx.path).numbers() == before
    assert TextIndex(spark, idx.path).append(spark.createDataFrame([("new", "thing")], "id string, text string")).numbers()[0] == before[0] + 1


# --- vectors ------------------------------------------------------------------------------------------------------


def _memories(spark, n=300):
    rng = random.Random(2)
    rows = [(f"v{i}", f"uses {'python' if i % 40 == 0 else f'tool{i}'} and {rng.choice(WORDS)} in {rng.choice(WORDS)}", "semantic", i) for i in range(n)]
    return spark.createDataFrame([*rows, ("vn", None, "semantic", -1), ("ve", "", "working", -2)], "id string, text string, tier string, created_at int")


def test_vectors_equal_the_full_scan(spark, tmp_path):
    m = _memories(spark)
    idx = VectorIndex(spark, f"file://{tmp_path}/v").append(m)
    every = hdc.index(m)
    for said, limit in (("python things", 5), ("python", 40), ("omega", 7), ("zzz", 3)):
        want = hdc.query(every, said).orderBy(F.desc("score"), "id").limit(limit).collect()
        assert [tuple(r) for r in idx.query(said, limit).collect()] == [tuple(r) for r in want]
    scope = m.where("id LIKE '%0'")
    want = hdc.query(every.join(scope.select("id"), "id"), "python").orderBy(F.desc("score"), "id").limit(5).collect()
    assert [tuple(r) for r in idx.query("python", 5, scope).collect()] == [tuple(r) for r in want]
    assert {tuple(r[:2]) + (tuple(r[2]),) for r in [(x.id, tuple(x.entities), x.hv) for x in idx.vectors().collect()]} == {(x.id, tuple(x.entities), tuple(x.hv)) for x in every.collect()}


def test_sampled_bits_leave_few_rows(spark, tmp_path):
    """Where some rows stand out, only they are read in full; the plan of a search reads no text."""
    idx = VectorIndex(spark, f"file://{tmp_path}/v").append(_memories(spark))
    found = idx.candidates("python", 5).collect()
    assert len(found) < 30 and {"vn", "ve"} | {f"v{i}" for i in range(0, 300, 40)} >= {r["id"] for r in idx.query("python", 5).collect()}
    assert "text" not in idx.query("python", 5)._jdf.queryExecution().toString()


def test_the_margin_holds():
    rng = np.random.default_rng(0)
    bits = rng.random((500, 65536)) < 0.55
    assert np.abs(bits[:, :4096].mean(1) - bits.mean(1)).max() < margin(1024, 64) < 0.06
    assert margin(64, 64) == 0


def test_vector_changes(spark, tmp_path):
    m = _memories(spark, 60)
    idx = VectorIndex(spark, f"file://{tmp_path}/v", 16)
    assert idx.query("python").collect() == [] and idx.stats().first()["indexed_memories"] == 0 and idx.merge().near() is None
    idx.append(m.where("created_at < 30"))
    idx.delete(m.where("created_at BETWEEN 10 AND 20").select("id").union(m.limit(1).select(F.lit("unknown"))))
    changed = spark.createDataFrame([("v5", "omega now", "working", 99), ("v5", "aged omega", "working", 99), (None, "x", "x", 0)], "id string, text string, tier string, created_at int")
    idx.append(changed)
    idx.backfill(m, 12)
    live = {f"v{i}": m for i in [*range(10), *range(21, 30)]} | {"vn": m, "ve": m} | {f"v{i}": m for i in range(48, 60)}
    for _ in range(2):
        got = {r.id: r for r in idx.vectors().collect()}
        assert set(got) == set(live)
        want = {r.id: r for r in hdc.index(m, 16).collect()}
        assert all(got[i].hv == want[i].hv for i in live if i != "v5") and got["v5"].entities == ["omega", "now"]
        assert idx.stats().first()["indexed_memories"] == len(live)
        idx.merge()


def test_search_reads_stored_vectors(spark, sf):
    m = a.memories(spark, sf)
    stored = retrieval.lane_vsa(m, a.vector_index(spark, sf), "thing ering", 30).collect()
    assert stored == retrieval.lane_vsa(m, hdc.index(m), "thing ering", 30).collect()


def test_shared_folder_without_a_setting(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Bare:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "local[2]", "app-1"
            getConf = staticmethod(Conf)

    assert a.shared_root(Bare) == a.shared_root(Bare) and a.shared_root(Bare).startswith("file:///")
    Bare.sparkContext.master = "spark://x:7077"
    with pytest.raises(RuntimeError):
        a.shared_root(Bare)
