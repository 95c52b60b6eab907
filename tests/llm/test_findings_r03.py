"""Tests of what the third review found in the pipeline."""

import tracemalloc

import numpy as np

from recallsmith.llm import decontam, near_dup


def test_groups_begin_with_fingerprints(spark, monkeypatch):
    """Copies with a fingerprint in common, or one two bits away, are paired through SimHash; far fingerprints through their first shingles."""
    rng, base = np.random.default_rng(4), [f"word{i}" for i in range(400)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[:200], *(f"new{i}" for i in rng.permutation(30)), *base[230:]])]
    texts += [" ".join(f"own{k}w{i}" for i in range(60)) for k in range(5)]
    told, link = [], near_dup.link_fingerprints

    def seen(spark, fps, *more):
        told.append({r.fp for r in fps.select("fp").collect()})
        return link(spark, fps, *more)

    monkeypatch.setattr(near_dup, "link_fingerprints", seen)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.id: r.group_id for r in near_dup.similarity_groups(spark, rows).collect()} == {0: 0, 1: 0, 2: 0, **{i: i for i in range(3, 8)}}
    signed = [int(np.array([near_dup.simhash(t.encode(), 5, 2)], np.uint64).view(np.int64)[0]) for t in texts]
    assert told == [set(signed)]
    assert ((signed[0] ^ signed[2]) & (1 << 64) - 1).bit_count() > 2  # found by the exact join


def test_a_batch_of_texts_is_looked_through_in_slices():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    items = decontam.Items([(i, " ".join(rng.choice(words, 30))) for i in range(200)])
    texts = [" ".join(rng.choice(words, 500)) for _ in range(1000)] + [None, ""]
    finder = decontam.Finder(items)
    finder.find_all(texts[:5])
    tracemalloc.start()
    got = finder.find_all(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    assert got == [finder.find(t) for t in texts]


def test_remembered_passages_are_bounded_by_their_bytes(monkeypatch):
    monkeypatch.setattr(decontam, "MEMO_BYTES", 1 << 12)
    item = " ".join(f"w{i}" for i in range(20))
    finder = decontam.Finder(decontam.Items([(1, item)]))
    for k in range(50):
        assert [x[0] for x in finder.find(f"{'x ' * k}{item} then {k} more")] == [1]
    assert sum(len(key[1]) for key in finder.memo) <= 2 << 12
