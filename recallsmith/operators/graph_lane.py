"""A graph-first lane: memories that are cited by the edges around some entities, nearer ones counting more.

Entities are reached hop by hop. A hop joins the edges with the entities that the last hop reached, leaves out edges to
those reached before, and takes each entity's `fan_out` surest edges, so a hub passes on no more than others; its edges are thinned out in the tasks that
read them, before they are shuffled by entity (row_number() with a limit does so by itself). Each hop is written to shared
storage: the plan of a hop doesn't hold those before it, and a lost executor costs its own tasks.

Cases: an edge without a subject or object leads nowhere, one that cites no memory is walked without a score; edges of a time
that ended are not walked; repeated edges count once, with the greatest confidence, and a null confidence is 0; ties are walked by
entity, predicate and memory; entities without edges, and an empty table on either side, give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallsmith.operators.retrieval import LANE_LIMIT, ranked

_SCHEMA = "n string, m string, predicate string, memory string, confidence double"


def walk(triples: DataFrame, seeds: DataFrame, path: str, depth: int = 3, fan_out: int = 20) -> DataFrame:
    """(hop, n, m, predicate, memory, confidence) of the edges walked from entity n to entity m, from seeds (id) on; hops are written below `path`."""
    spark = triples.sparkSession
    way = lambda a, b: F.struct(F.col(a).alias("n"), F.col(b).alias("m"))
    open_ = triples.where("valid_to IS NULL AND subject IS NOT NULL AND object IS NOT NULL AND subject <> object")
    edges = open_.select(F.explode(F.array(way("subject", "object"), way("object", "subject"))).alias("w"), "predicate", F.col("source_closet").alias("memory"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence")).select("w.*", "predicate", "memory", "confidence")
    first = seeds.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct()
    first.write.mode("overwrite").parquet(f"{path}/seeds")
    start = seen = spark.read.schema("id string").parquet(f"{path}/seeds")
    surest = Window.partitionBy("n").orderBy(F.desc("confidence"), "m", "predicate", F.asc_nulls_first("memory"))
    out = spark.createDataFrame([], f"hop int, {_SCHEMA}")
    for hop in range(1, depth + 1):
        ways = edges.join(start.withColumnRenamed("id", "n"), "n").join(seen.withColumnRenamed("id", "m"), "m", "left_anti")
        once = ways.groupBy("n", "m", "predicate", "memory").agg(F.max("confidence").alias("confidence"))
        few = once.withColumn("r", F.row_number().over(surest)).where(F.col("r") <= fan_out).drop("r")
        few.write.mode("overwrite").parquet(f"{path}/hop-{hop}")
        walked = spark.read.schema(_SCHEMA).parquet(f"{path}/hop-{hop}")
        if walked.isEmpty():
            break
        out = out.unionByName(walked.withColumn("hop", F.lit(hop)))
        start = walked.select(F.col("m").alias("id")).distinct()
        seen = seen.unionByName(start)
    return out


def lane_graph(memories: DataFrame, triples: DataFrame, seeds: DataFrame, path: str, depth: int = 3, decay: float = 0.5, fan_out: int = 20, limit: int = LANE_LIMIT) -> DataFrame:
    """Memories (id) in order of the edges that cite them: the sum of confidence, times `decay` for each hop after the first."""
    walked = walk(triples, seeds, path, depth, fan_out).where("memory IS NOT NULL")
    weight = F.col("confidence") * F.pow(F.lit(decay), F.col("hop") - 1)
    scores = walked.groupBy(F.col("memory").alias("id")).agg(F.round(F.sum(weight), 9).alias("score"))
    return ranked(scores.join(memories.select("id"), "id", "left_semi"), "graph", limit, [F.desc("score"), F.asc("id")])
