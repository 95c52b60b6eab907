"""What near-copy detection sends to the driver."""

from recallsmith.llm import near_dup


def test_large_sketches_are_not_broadcast(spark, monkeypatch):
    rows = spark.createDataFrame([(i, list(range(64))) for i in range(50)], "c long, odd array<long>")
    hint = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hint(near_dup._hinted(rows, "odd")) and hint(near_dup._hinted(rows.limit(0), "odd"))
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 8 * 64 * 50 + 32 * 50 - 1)
    assert not hint(near_dup._hinted(rows, "odd"))


def test_groups_are_the_same_without_a_broadcast(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:-1] + ["x"]), " ".join(words[::-1]), "", None, " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BROADCAST_BYTES", 0)
    got = {r.id: r.group_id for r in near_dup.similarity_groups(spark, docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 0}
