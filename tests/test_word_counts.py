"""Counts of words by group: one shuffle, and the same counts as without groups."""

from recallsmith.operators import quality


def test_words_of_groups_are_shuffled_once(spark):
    rows = [("a", "Alpha, (alpha) beta the 'Beta' xy"), ("a", "alpha beta!\tBETA"), ("b", "alpha the"), ("b", None), ("c", ""), (None, "gamma.")]
    counts = quality.word_counts(spark.createDataFrame(rows, "g string, text string"), "g")
    assert counts._jdf.queryExecution().sparkPlan().toString().count("Generate") == 1
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, counts.collect()), key=str) == sorted([("a", "alpha", 3), ("a", "beta", 4), ("b", "alpha", 1), (None, "gamma", 1)], key=str)
    whole = quality.word_counts(spark.createDataFrame(rows, "g string, text string")).collect()
    assert sorted(map(tuple, whole)) == [("alpha", 4), ("beta", 4), ("gamma", 1)]
