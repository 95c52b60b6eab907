"""What a store notices: a cache of searches, notifications, alerts, anomalies, periodic jobs, retention figures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cycles between the runs of each periodic job.
CADENCE = {"goal_drift": 3, "dream": 5, "health_report": 7, "tasks": 10}


def cache_replay(requests: DataFrame, ttl_seconds: float = 300) -> DataFrame:
    """(key, ts, hit) of requests (key, ts, seq): a hit finds an entry that was cached less than the time to live before; a miss caches anew.

    Requests are dealt by key and streamed in order of time, so nothing but a key's last entry is held.
    """
    ttl = int(ttl_seconds * 1_000_000)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cached = None, 0
        for b in it:
            hits = []
            for key, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                hit = key == now and at - cached < ttl
                if not hit:
                    now, cached = key, at
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(hits, pa.bool_())], ["key", "ts", "hit"])

    part = requests.where("key IS NOT NULL AND ts IS NOT NULL").select("key", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "seq")
    dealt = part.repartition("key").sortWithinPartitions("key", "us", "seq")
    return dealt.mapInArrow(run, part.select("key", "ts").schema.add("hit", "boolean"))


def cache_entries(replayed: DataFrame, most: int = 100) -> DataFrame:
    """(key, cached_at) of the entries that a cache of `most` holds after the requests: those cached last."""
    last = replayed.where("NOT hit").groupBy("key").agg(F.max("ts").alias("cached_at"))
    return last.orderBy(F.desc("cached_at"), "key").limit(most)


def invalidate(entries: DataFrame, key: str | None = None, prefix: str | None = None) -> DataFrame:
    """Entries without one key, without those that begin with a prefix, or without any."""
    if key is not None:
        return entries.where(F.col("key") != key)
    return entries.where(~F.col("key").startswith(prefix)) if prefix is not None else entries.limit(0)


def cache_stats(replayed: DataFrame, as_of: Column, ttl_seconds: float = 300, most: int = 100) -> DataFrame:
    """One row: entries held, those within their time to live and those beyond, hits, misses and hit rate."""
    young = F.unix_micros(as_of) - F.unix_micros(F.col("cached_at").cast("timestamp")) < int(ttl_seconds * 1_000_000)
    held = cache_entries(replayed, most).agg(F.count("*").alias("total_entries"), F.count_if(young).alias("active_entries"))
    used = replayed.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    rate = F.round(F.col("hits") / F.greatest(F.col("hits") + F.col("misses"), F.lit(1)), 3)
    return held.crossJoin(used).select("total_entries", "active_entries", (F.col("total_entries") - F.col("active_entries")).alias("stale_entries"), "hits", "misses", rate.alias("hit_rate"))  # one row each


def pending(notes: DataFrame, topics: list[str], least: float = 0.0, most: int = 50) -> DataFrame:
    """The notifications (id, topic, confidence, ts) that are queued: of wanted topics and sure enough, the newest `most`."""
    ok = notes.where(F.col("topic").isin(topics) & (F.col("confidence") >= least))
    return ok.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def live_notifications(queued: DataFrame, dismissed: DataFrame, as_of: Column, ttl: int = 600) -> DataFrame:
    """Queued notifications that are young and not dismissed, newest first."""
    young = F.unix_micros(as_of) - F.unix_micros(F.col("ts").cast("timestamp")) < ttl * 1_000_000
    return queued.where(young).join(dismissed.select("id"), "id", "left_anti").orderBy(F.desc("ts"), F.desc("id"))


def notification_stats(queued: DataFrame, dismissed: DataFrame) -> DataFrame:
    """One row: notifications queued and dismissed."""
    return queued.agg(F.count("*").alias("pending")).crossJoin(dismissed.agg(F.countDistinct("id").alias("dismissed")))  # one row each


def relevance_alert(results: DataFrame, least: float = 0.8) -> DataFrame:
    """The best of results (id, text, score) as a notification, if its share of the best possible score is over `least`."""
    best = results.where(F.col("score") > least).orderBy(F.desc("score"), "id").limit(1)
    title = F.concat(F.lit("Highly relevant memory found (score: "), F.format_number("score", 2), F.lit(")"))
    return best.select("id", F.lit("relevance_alert").alias("topic"), title.alias("title"), F.substring("text", 1, 200).alias("body"), F.col("score").alias("confidence"))


def anomalies(results: DataFrame, below: float = 0.15) -> DataFrame:
    """Results (id, text, score) that carry little signal, with the beginning of their text."""
    return results.where((F.col("score") < below) & (F.coalesce("text", F.lit("")) != "")).select("id", F.substring("text", 1, 100).alias("preview"), "score")


def due(cycles: DataFrame) -> DataFrame:
    """(cycle, job) of the periodic jobs that run in each cycle."""
    jobs = F.filter(F.array(*(F.when(F.col("cycle") % n == 0, F.lit(job)) for job, n in CADENCE.items())), lambda j: j.isNotNull())
    return cycles.select("cycle", F.explode(jobs).alias("job"))


def retention_stats(gated: DataFrame, last: int = 10) -> DataFrame:
    """One row of gated events (event_id, created_at, error, tier): events, those kept in each tier, surprises, and the last ones."""
    figures = gated.agg(F.count("*").alias("total_processed"), F.count_if(F.col("tier") == "semantic").alias("stored_to_semantic"), F.count_if(F.col("tier") == "working").alias("stored_to_working"), F.count_if(F.expr("error > 0.5")).alias("surprises"))
    newest = gated.orderBy(F.desc("created_at"), F.desc("event_id")).limit(last)
    recent = newest.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("recent_events"))
    return figures.crossJoin(recent)  # one row each


def migration_counts(routed: DataFrame) -> DataFrame:
    """(workspace, n) of routed memories (outcome, target): copied ones by workspace, the others by outcome."""
    return routed.groupBy(F.coalesce("target", "outcome").alias("workspace")).agg(F.count("*").alias("n"))


def working_memory(entries: DataFrame, most: int = 100) -> DataFrame:
    """What an L1 cache of `most` entries keeps of each owner: the greatest last access (in seconds) + 0.3 * importance."""
    rank = F.unix_micros("last_accessed") / 1e6 + 0.3 * F.greatest(F.least("importance", F.lit(1.0)), F.lit(0.0))
    return entries.withColumn("r", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc(rank), "id"))).where(F.col("r") <= most).drop("r")
