"""Ranking quality: expected (query_id, id) against runs (query_id, id, rank)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallsmith.functions import text

#: Cases of an evaluation set that a search is called for, one query each.
MOST_CASES = 1000
#: Up to so many pairs of a query and a document are broadcast.
BROADCAST_ROWS = 200_000


def metrics(expected: DataFrame, runs: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, recall, hit, mrr, ndcg) of each query that expects something."""
    hits = expected.join(runs.where(F.col("rank") <= k), ["query_id", "id"], "left")
    per = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("found"), F.min("rank").alias("first"), F.sum(F.coalesce(1 / F.log2(F.col("rank") + 1), F.lit(0.0))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select("query_id", F.round(F.col("found") / F.col("n"), 6).alias("recall"), (F.col("found") > 0).alias("hit"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("dcg") / ideal, 6).alias("ndcg"))


def summary(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg(F.col("hit").cast("double")), 5).alias("hit_rate"), F.round(F.avg("mrr"), 5).alias("mrr"), F.round(F.avg("ndcg"), 5).alias("ndcg"))


def composite(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (recall5, mrr10, retention, composite) = .45 recall@5 + .40 MRR@10 + .15 share of queries whose first ten have a memory of the
    expected tier; expected (query_id, id, tier), runs (query_id, id, rank, tier)."""
    five, ten = metrics(expected.select("query_id", "id"), runs, 5), metrics(expected.select("query_id", "id"), runs, 10)
    kept = expected.select("query_id", F.col("id").alias("e"), F.col("tier").alias("t")).join(runs.where("rank <= 10"), "query_id", "left").groupBy("query_id").agg(F.max((F.col("e") == F.col("id")) & F.col("t").eqNullSafe(F.col("tier"))).alias("kept"))
    j = five.agg(F.avg("recall").alias("recall5")).crossJoin(ten.agg(F.avg("mrr").alias("mrr10"))).crossJoin(kept.agg(F.avg(F.coalesce(F.col("kept"), F.lit(False)).cast("double")).alias("retention")))  # one row each
    return j.select(*(F.round(c, 5).alias(c) for c in ("recall5", "mrr10", "retention")), F.round(F.expr("0.45D * recall5 + 0.40D * mrr10 + 0.15D * retention"), 5).alias("composite"))


def run(cases: DataFrame, search: Callable[[str], DataFrame], k: int = 10) -> DataFrame:
    """(query_id, id, rank) of a search called for each case (query_id, query); it returns (id, score), best first by score, then id."""
    rows = cases.select("query_id", "query").limit(MOST_CASES + 1).collect()
    if len(rows) > MOST_CASES:
        raise ValueError("too many cases to search one by one: use batch_lane()")
    order = Window.orderBy(F.desc("score"), "id")
    found = [search(r["query"]).orderBy(F.desc("score"), "id").limit(k).select(F.lit(r["query_id"]).alias("query_id"), "id", F.row_number().over(order).alias("rank")) for r in rows]
    return reduce(DataFrame.unionByName, found)


def rare_terms(queries: DataFrame, df: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, term, df) of the words of each query (query_id, query) that fewest documents have; df (term, df)."""
    words = queries.select("query_id", F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term")).join(df, "term")
    return words.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("df", "term"))).where(F.col("r") <= most).drop("r")


def words(queries: DataFrame) -> DataFrame:
    """(term) of all words of queries (query_id, query)."""
    return queries.select(F.explode(F.array_distinct(text.tokens(F.col("query")))).alias("term")).distinct()


def batch_lane(queries: DataFrame, postings: DataFrame, n: int, most: int = 8, k: int = 10, df: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rank) of many queries at once: the rarest words of each meet their postings (term, id), and a document scores the sum of
    log(n / df) of those it has. Rare words have short postings, so no query reads those of common ones. df (term, df) is counted where it is not given."""
    df = postings.groupBy("term").agg(F.count("*").alias("df")) if df is None else df
    met = rare_terms(queries, df, most).join(postings.select("term", "id"), "term")
    scored = met.groupBy("query_id", "id").agg(F.round(F.sum(F.log(F.lit(float(n)) / F.col("df"))), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "id", "rank")


def holders(queries: DataFrame, postings: DataFrame, documents: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(query_id, id) of the documents (id, text) that contain a whole query text: those with its rarest word, then verified. Texts are shuffled only where many have one."""
    df = postings.groupBy("term").agg(F.count("*").alias("df")) if df is None else df
    few = rare_terms(queries, df, 1).join(postings.select("term", "id"), "term").select("query_id", "id")
    few = F.broadcast(few) if few.count() <= BROADCAST_ROWS else few
    return documents.select("id", "text").join(few, "id").join(queries, "query_id").where(F.contains("text", "query")).select("query_id", "id")
