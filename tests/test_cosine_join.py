"""The exact cosine join against all pairs."""

import numpy as np
import pytest

from recallsmith.operators import consolidation, cosine_join


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(c) for c in v] if v is not None else None) for i, v in rows], "id string, embedding array<float>")


def brute(rows, threshold):
    x = {}
    for i, v in rows:
        if v is not None and len(v) and i is not None:
            a = np.array(v, np.float32).astype(float)
            n = np.sqrt((a * a).sum())
            if np.isfinite(n) and n > 0:
                x[i] = a / n
    ids = sorted(x)
    return {(a, b): round(float(x[a] @ x[b]), 5) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(x[a]) == len(x[b]) and round(float(x[a] @ x[b]), 6) >= threshold}


def skewed(rng, n=700, d=16, hubs=6):
    """Most vectors near a few centres, one of which has half of them, some copies, some anywhere."""
    centres = rng.standard_normal((hubs, d))
    out = [(f"v{i}", centres[0 if i % 2 else rng.integers(hubs)] + rng.standard_normal(d) * rng.choice([0.02, 0.15, 0.4])) for i in range(n)]
    return out + [(f"r{i}", rng.standard_normal(d)) for i in range(60)] + [(f"c{i}", centres[1]) for i in range(40)] + [(f"s{i}", 2 * centres[1]) for i in range(3)]


@pytest.mark.parametrize("threshold,part,pivots", [(0.92, 2048, 256), (0.92, 40, 12), (0.99, 7, 30), (0.3, 100, 5), (-0.2, 300, 256)])
def test_equals_all_pairs(spark, monkeypatch, threshold, part, pivots):
    monkeypatch.setattr(cosine_join, "PART", part)
    monkeypatch.setattr(cosine_join, "VISITORS", 150)
    rows = skewed(np.random.default_rng(4))
    heads, copies = cosine_join.classes(frame(spark, rows))
    got = cosine_join.similar_heads(heads, threshold, pivots).collect()
    names = {r["id"] for r in heads.collect()}
    want = {k: s for k, s in brute(rows, threshold).items() if set(k) <= names}
    assert len(got) == len(want) and {(r["a"], r["b"]): round(r["sim"], 5) for r in got} == pytest.approx(want, abs=1.1e-5)
    assert {(r["a"], r["b"]) for r in copies.collect()} == {("c0", f"c{i}") for i in range(1, 40)} | {("s0", f"s{i}") for i in range(1, 3)}


def test_copies_are_expanded_or_told_as_a_star(spark):
    rows = skewed(np.random.default_rng(4), 120)
    want = brute(rows, 0.95)
    got = consolidation.similar_pairs(frame(spark, rows), 0.95).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == set(want)
    star = cosine_join.similar_classes(frame(spark, rows), 0.95).collect()
    assert len(star) < len(want) and {(r["a"], r["b"]) for r in star} <= set(want)
    # the same classes are joined
    joined = lambda pairs: {r["id"]: r["cluster"] for r in consolidation.clusters(pairs).collect()}
    assert joined(spark.createDataFrame(star)) == joined(spark.createDataFrame(got))


def test_clusters_are_pruned_and_nothing_is_crossed(spark, monkeypatch):
    """Vectors near their centres visit few parts: the visits are a small share of vectors x parts; no join without a key is planned."""
    monkeypatch.setattr(cosine_join, "PART", 20)
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 32))
    rows = [(f"v{i:04}", centres[i % 40] + 0.03 * rng.standard_normal(32)) for i in range(1200)]
    heads, _ = cosine_join.classes(frame(spark, rows))
    cells = cosine_join._fit(heads, 0.2, 256)
    parts = sum(n for own in cells.values() for n in own.parts.values())
    visits = cosine_join._visits(heads, cells).where("visitor").count()
    assert parts >= 60 and visits < 0.15 * 1200 * parts / 2
    plan = cosine_join._met(cosine_join._visits(heads, cells), 0.98)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_edge_cases(spark):
    rows = [("a", [1, 0]), ("b", [1, 0, 0]), ("c", [2, 0]), ("d", [0, 0]), ("e", None), ("f", []), ("g", [float("nan"), 1]), ("h", [float("inf"), 1]), (None, [1, 0]), ("i", [1, 0, 0]), ("i", [0, 1, 0]), ("j", [0, 1, 0]), ("a", [1, 0]), ("k", [1e-30, 1e-30, 0])]
    got = {(r["a"], r["b"], r["sim"]) for r in cosine_join.similar_classes(frame(spark, rows), 0.9).collect()}
    assert got == {("a", "c", 1.0), ("b", "i", 1.0), ("i", "j", 1.0)}
    assert cosine_join.similar_classes(frame(spark, []), 0.9).collect() == []
    assert consolidation.similar_pairs(frame(spark, rows[:1]), 0.9).collect() == []
