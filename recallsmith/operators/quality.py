"""Health and quality figures of a memory store; each is one pass of partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallsmith.functions import scoring, text


def memory_stats(memories: DataFrame, meta: DataFrame) -> DataFrame:
    """total, active (without a meta row too), deleted, and those of the deleted that were consolidated into another memory."""
    j = memories.select("id").join(meta, "id", "full_outer").join(memories.select("id", F.lit(True).alias("there")), "id", "left")
    gone, there = F.coalesce("is_deleted", F.lit(False)), F.col("there").isNotNull()
    merged = F.col("delete_reason").startswith("consolidated") if "delete_reason" in meta.columns else F.lit(False)
    return j.agg(F.count_if(there).alias("total"), F.count_if(there & ~gone).alias("active"), F.count_if(gone).alias("deleted"), F.count_if(merged).alias("consolidated"))


def age_distribution(memories: DataFrame, as_of: str) -> DataFrame:
    """avg, max, min and the upper median (the value at n div 2 of the sorted ages), of whole days.

    Ages are counted by day first, so the median is taken from running counts, not from a list of all rows.
    """
    from pyspark.sql import Window

    days = memories.select(F.floor(scoring.age_days(F.col("created_at"), as_of)).alias("d")).groupBy("d").agg(F.count("*").alias("n"))
    total = days.agg(F.sum("n").alias("t"), F.sum(F.col("d") * F.col("n")).alias("s"), F.max("d").alias("max_age"), F.min("d").alias("min_age"))
    upto = days.withColumn("c", F.sum("n").over(Window.orderBy("d"))).crossJoin(F.broadcast(total)).where("c > t div 2").agg(F.min("d").alias("median_age"))  # one row per day of age
    return total.crossJoin(upto).select(F.round(F.col("s") / F.col("t"), 1).alias("avg_age"), "max_age", "min_age", "median_age")


def live(memories: DataFrame, meta: DataFrame) -> DataFrame:
    """Memories with a meta row that are not deleted."""
    return memories.join(meta.where("NOT is_deleted").select("id"), "id")


def word_counts(texts: DataFrame, *by: str) -> DataFrame:
    """(*by, word, n): words of three characters or more of rows (text, *by), without marks at the ends and stop words.

    Without `by`, raw words are counted first, so marks are stripped from distinct words only. With it, groups have few words twice, and a second count of them
    would cost a shuffle of nearly as many rows as the first: marks are stripped from all words.
    """
    raw = texts.select(*by, F.explode(F.split(F.lower("text"), r"\s+")).alias("w"))
    raw = raw.withColumn("n", F.lit(1).cast("long")) if by else raw.groupBy("w").agg(F.count("*").alias("n"))
    clean = raw.select(*by, F.trim(text.strip(F.col("w"), text.COVERAGE_MARKS)).alias("word"), "n")
    return clean.where((F.length("word") > 2) & ~F.col("word").isin(text.COVERAGE_STOPWORDS)).groupBy(*by, "word").agg(F.sum("n").alias("n"))


def words(memories: DataFrame, meta: DataFrame) -> DataFrame:
    """(word, n) of the texts of live memories."""
    return word_counts(live(memories, meta))


def word_coverage(memories: DataFrame, meta: DataFrame, top: int = 20) -> DataFrame:
    """(word, n) of the most frequent words."""
    return words(memories, meta).orderBy(F.desc("n"), "word").limit(top)


def coverage(memories: DataFrame, meta: DataFrame) -> DataFrame:
    """total_memories, estimated_topics (distinct words) and coverage_score: 50 topics a memory are 100; an empty store is 0.

    Topics are counted by a column that the counts of words have, so a report that lists words too shuffles them once.
    """
    return coverage_of(live(memories, meta).agg(F.count("*").alias("total_memories")), words(memories, meta).agg(F.count("n").alias("estimated_topics")))


def coverage_of(memories: DataFrame, topics: DataFrame) -> DataFrame:
    """The coverage of a one-row frame total_memories and one estimated_topics."""
    score = F.least(F.col("estimated_topics") / F.greatest("total_memories", F.lit(1)) * 50, F.lit(100.0))
    return memories.crossJoin(topics).select("total_memories", "estimated_topics", F.round(F.when(F.col("total_memories") > 0, score).otherwise(0.0), 1).alias("coverage_score"))  # one row each


def stale(memories: DataFrame, meta: DataFrame, as_of: str, days: int = 30, limit: int = 50) -> DataFrame:
    """Not deleted and not read for `days`, oldest first."""
    j = memories.join(meta, "id").where(~F.col("is_deleted"))
    since = scoring.age_days(F.coalesce("last_accessed_at", "created_at"), as_of)
    old = F.col("last_accessed_at").isNull() | (scoring.age_days(F.col("last_accessed_at"), as_of) > days)
    return j.where(old).orderBy("created_at", "id").limit(limit).select("id", text.truncate(F.col("text"), 100).alias("preview"), F.floor(since).alias("days_since"))


def orphans(memories: DataFrame, meta: DataFrame, mentioned: DataFrame | None = None, limit: int = 50) -> DataFrame:
    """Never read, not deleted, and mentioned by no edge (id)."""
    j = memories.select("id").join(meta, "id").where("hit_count = 0 AND NOT is_deleted")
    if mentioned is not None:
        j = j.join(mentioned, "id", "left_anti")
    return j.select("id").orderBy("id").limit(limit)


def relevance_stats(meta: DataFrame) -> DataFrame:
    return meta.agg(F.count("*").alias("total"), F.count_if(F.expr("hit_count > 0")).alias("with_hits"), F.count_if(F.expr("hit_count >= 5")).alias("hot"), F.count_if(F.expr("hit_count = 0")).alias("cold"), F.round(F.avg("hit_count"), 2).alias("avg_hits"))


def record_hits(meta: DataFrame, hits: DataFrame) -> DataFrame:
    """meta with a batch of hits (id, ts) counted in; an id may occur often, and may be new."""
    h = hits.groupBy("id").agg(F.count("*").alias("more"), F.max("ts").alias("ts"))
    j = meta.join(h, "id", "full_outer")
    return j.select("id", F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), (F.coalesce("hit_count", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("hit_count"), F.greatest("last_accessed_at", "ts").alias("last_accessed_at"))


def decay_distribution(memories: DataFrame, as_of: str, worst: int = 20) -> tuple[DataFrame, DataFrame]:
    """(healthy and degraded counts, the worst rows)."""
    s = memories.select("id", F.round(scoring.tier_decay(F.col("tier"), F.col("created_at"), as_of), 6).alias("decay"))
    return s.agg(F.count_if(F.expr("decay > 0.5")).alias("healthy"), F.count_if(F.expr("decay <= 0.5")).alias("degraded")), s.orderBy("decay", "id").limit(worst)


def forget(memories: DataFrame, as_of: str, threshold: float = 0.3, min_age_days: float = 7) -> DataFrame:
    """Rows to forget: old enough, and decayed below the threshold."""
    d = memories.select("id", scoring.age_days(F.col("created_at"), as_of).alias("age"), F.round(scoring.tier_decay(F.col("tier"), F.col("created_at"), as_of), 6).alias("decay"))
    return d.where((F.col("age") >= min_age_days) & (F.col("decay") < threshold)).select("id", "decay")


def memory_health(memories: DataFrame, meta: DataFrame, log: DataFrame, as_of: str) -> DataFrame:
    """total_memories, the four factors and health_score: .30 freshness + .25 coverage + .20 size + .25 redundancy, each 0 to 100.

    Fresh memories were read within 30 days; 10 to 10,000 memories have the full size; each of up to 25 merges costs two points of
    redundancy. An empty store is 0.
    """
    fresh = F.col("last_accessed_at").isNotNull() & (F.unix_micros(F.col("last_accessed_at").cast("timestamp")) >= F.unix_micros(scoring.instant(as_of)) - 30 * 86_400_000_000)
    a = meta.where("NOT is_deleted").agg(F.count("*").alias("n"), F.count_if(fresh).alias("fresh"))
    return health_of(a, coverage(memories, meta), log)


def health_of(counted: DataFrame, covered: DataFrame, log: DataFrame) -> DataFrame:
    """The health of a one-row frame (n, fresh), a coverage, and a log of merges."""
    j = counted.crossJoin(covered.select("coverage_score")).crossJoin(log.agg(F.count("*").alias("merges")))  # one row each
    n = F.col("n")
    j = j.select(
        n.alias("total_memories"),
        F.when(n == 0, 0.0).otherwise(F.round(F.col("fresh") / n * 100, 9)).alias("freshness"),
        F.when(n == 0, 0.0).otherwise(F.col("coverage_score")).alias("coverage"),
        F.when(n == 0, 0.0).when(n < 10, n / 10 * 100).when(n > 10000, F.greatest(100 - (n - 10000) / 100, F.lit(0.0))).otherwise(100.0).alias("size_health"),
        F.when(n == 0, 100.0).otherwise((100 - F.least(F.col("merges") * 2, F.lit(50))).cast("double")).alias("redundancy"),
    )
    score = F.expr("freshness * 0.30D + coverage * 0.25D + size_health * 0.20D + redundancy * 0.25D")
    score = F.when(F.col("total_memories") > 0, F.bround(F.greatest(F.least(F.round(score, 9), F.lit(100.0)), F.lit(0.0)), 0)).otherwise(0.0)
    return j.select("total_memories", *(F.round(c, 1).alias(c) for c in ("freshness", "coverage", "size_health", "redundancy")), score.cast("int").alias("health_score"))


def extraction_coverage(memories: DataFrame, log: DataFrame) -> DataFrame:
    """Memories, logged extractions, those with entities, triples and errors, and the share logged; log (memory_id, entities_found, triples_found, extraction_error)."""
    n = memories.agg(F.count("*").alias("total_memories"))
    x = log.agg(F.count("*").alias("extracted_memories"), F.count_if(F.expr("entities_found > 0")).alias("with_entities"), F.count_if(F.expr("triples_found > 0")).alias("with_triples"), F.count("extraction_error").alias("with_errors"))
    share = F.when(F.col("total_memories") > 0, F.col("extracted_memories") / F.col("total_memories") * 100).otherwise(0.0)
    return n.crossJoin(x).select("*", F.round(share, 1).alias("coverage_percent"))  # one row each


def consolidation_effectiveness(log: DataFrame) -> DataFrame:
    """Runs, memories fused, and sources a run among runs that had any."""
    mean = F.avg(F.when(F.col("source_count") > 0, F.col("source_count")))
    return log.agg(F.count("*").alias("consolidations"), F.coalesce(F.sum("source_count"), F.lit(0)).cast("long").alias("sources"), F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_sources"))


def system_health(stats: DataFrame, graph_stats: DataFrame, effect: DataFrame, extraction: DataFrame) -> DataFrame:
    """0 to 100: up to 15 points each for active memories, entities, current edges and extraction, 10 for consolidations,
    15 for extraction without errors, and 15 for few deletions. Takes the one-row frames of the figures it sums."""
    parts = [
        "least(active / 10D, 15D)", "least(entities / 5D, 15D)", "least(current / 10D, 15D)", "least(coverage_percent / 10D, 15D)", "least(consolidations * 2D, 10D)",
        "if(with_errors = 0 AND active > 0, 15D, 0D)", "if(deleted < active * 0.3D, 15D, 0D)",
    ]
    j = stats.crossJoin(graph_stats.select("entities", "current")).crossJoin(effect).crossJoin(extraction)  # one row each
    return j.select(F.bround(F.least(F.round(F.expr(" + ".join(parts)), 9), F.lit(100.0)), 0).cast("int").alias("health_score"))


def quality_report(memories: DataFrame, meta: DataFrame, log: DataFrame, as_of: str, days: int = 60) -> DataFrame:
    """One row: health with its factors, coverage with its top terms, and how many memories of the listings are stale and orphaned."""
    health = memory_health(memories, meta, log, as_of).withColumnRenamed("coverage", "coverage_factor")
    top = word_coverage(memories, meta).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "word"))), lambda x: x["word"]), ",").alias("top_terms"))
    listed = stale(memories, meta, as_of, days).agg(F.count("*").alias("stale_count")).crossJoin(orphans(memories, meta).agg(F.count("*").alias("orphan_count")))
    return health.crossJoin(coverage(memories, meta).drop("total_memories")).crossJoin(top).crossJoin(listed)  # one row each


def watermark(memories: DataFrame) -> DataFrame:
    """The newest creation instant: a poll that differs from the last one has new rows to fetch."""
    return memories.agg(F.max("created_at").alias("newest"))


def evaluations(df: DataFrame) -> DataFrame:
    """Quality evaluations (memory_id, score): count, mean, and share of high ones."""
    return df.agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.expr("score >= 0.5")).alias("good"))
