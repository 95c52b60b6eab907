"""Blocks of near copies, and what finding them asks of the driver."""

import random

from pyspark.sql import functions as F

from recallsmith.llm import common, near_dup


def test_shingles_of_the_same_members_are_one_block(spark):
    members = {1: [7, 8], 2: [7, 8], 3: [7, 8, 9], 4: [7, 8, 9], 5: [9], 6: [8, 9]}
    rows = [(k, c, (100 + c << 32) + 10 * k + c) for k, of in members.items() for c in of]
    got = near_dup.distinct_blocks(spark.createDataFrame(rows, "k long, c long, p long")).collect()
    blocks = {}
    for r in got:
        blocks.setdefault(r.k, []).append((r.c, r.n, r.i, r.m))
    # the least place among the blocks that became one; a block of one member is none
    assert sorted(map(sorted, blocks.values())) == [[(7, 107, 17, 2), (8, 108, 18, 2)], [(7, 107, 37, 3), (8, 108, 38, 3), (9, 109, 39, 3)], [(8, 108, 68, 2), (9, 109, 69, 2)]]


def test_groups_of_a_family_equal_brute_force(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(80)]

    def variant(changes):
        out = list(base)
        for _ in range(changes):
            out[r.randrange(80)] = f"x{r.randrange(10**6)}"
        return " ".join(out)

    texts = [variant(k % 6) for k in range(60)] + [" ".join(r.choices(base, k=40)) for _ in range(20)]
    sets = [set(near_dup._set(t.encode(), 5)[0].tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.id: x.group_id for x in near_dup.similarity_groups(spark, docs).collect()} == dict(enumerate(root))


def test_settings_of_joins_come_back(spark):
    name, other = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(name), spark.conf.get(other, None)
    try:
        with common.no_small_broadcasts(spark):
            assert spark.conf.get(name) == spark.conf.get(other) == "-1"
            raise KeyError
    except KeyError:
        pass
    assert (spark.conf.get(name), spark.conf.get(other, None)) == before


def test_figures_are_taken_while_rows_are_written(spark):
    out = common.materialise(spark, spark.range(5), "figures", n=F.count("*"), most=F.max("id"))
    assert out.figures == {"n": 5, "most": 4} and out.count() == 5
    assert common.materialise(spark, spark.range(0), "figures", n=F.count("*")).figures == {"n": 0}
