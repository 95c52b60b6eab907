"""Daily partials of a store's figures: reports that read no text.

A refresh counts the memories of some days anew and writes, as one segment (manifest.py), for each day of creation: the live memories by the day they were last
read, the words with their counts, the HEAD commonest of them with the next one's count, and a HyperLogLog sketch of the words. Readers take a day's newest count.
Counts of days are added up and sketches are merged, so a report costs what the partials cost, whatever the texts: a day whose memories were added, deleted or read is
refreshed, the others stay. merge() folds all segments into one, without the texts.

The commonest words of all days are exact without a look at all words: a day's head bounds what any other word can have there, so only words whose bound reaches
the kth sum of the heads are read, and the words as a whole only where the heads can't exclude a word that is in none of them.
The number of words is exact from the words, or estimated from the sketches with a relative standard error of 1.04 / sqrt(2 ** SKETCH), 1.6 %.

Cases: live memories are those with a meta row that is not deleted, a row for each such pair; a null id has none. Null and empty texts have no words, and texts of any
length are counted whole. Memories without a creation instant belong to NO_DAY, never read ones have a null day of reading. A day that holds nothing any more counts
as nothing once it is refreshed; an empty store gives zeros. Days are those of the session's time zone. Other columns are not read. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallsmith.operators import quality
from recallsmith.sources.manifest import Manifest

#: Words of a day's head; log2 of a sketch's registers; days that may be broadcast (as many rows of 12 bytes); words that may be a filter of the scan.
HEAD, SKETCH, MOST_DAYS, MOST_LITERALS = 256, 12, 100_000, 1000
#: The day of memories without a creation instant.
NO_DAY = "0001-01-01"

_DAYS = "day date, memories long, topics long, sketch binary"
_READS = "day date, read_day date, n long"
_WORDS = "day date, word string, n long"
_HEADS = "day date, word string, n long, r int"
_TABLES = {"days": _DAYS, "reads": _READS, "words": _WORDS, "heads": _HEADS}


def day_of(created_at: str) -> Column:
    """The day that a memory belongs to."""
    return F.coalesce(F.to_date(created_at), F.to_date(F.lit(NO_DAY)))


class Partials:
    """The partials below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.manifest = spark, Manifest(spark, path)

    def refresh(self, memories: DataFrame, meta: DataFrame, days: DataFrame | None = None) -> int:
        """Count some days (`day`) anew, by default all that the store has or the partials know; memories (id, text, created_at), meta (id, is_deleted, last_accessed_at)."""
        number, path = self.manifest.fresh()
        dated = memories.select("id", "text", day_of("created_at").alias("day"))
        if days is None:
            known = self._newest("days").select("day")
            days = dated.select("day").unionByName(known) if self._numbers() else dated.select("day")
        days.select(day_of("day").alias("day")).distinct().write.mode("overwrite").parquet(f"{path}/asked")
        asked = self.spark.read.schema("day date").parquet(f"{path}/asked")
        n = asked.count()
        mine = dated.join(F.broadcast(asked) if n <= MOST_DAYS else asked, "day")
        live = mine.join(meta.where("NOT is_deleted").select("id", F.to_date("last_accessed_at").alias("read_day")), "id")
        live.groupBy("day", "read_day").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/reads")
        # sorted by word: the statistics of row groups let a reader of few words skip most of them
        quality.word_counts(live, "day").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/words")
        words = self.spark.read.schema(_WORDS).parquet(f"{path}/words")
        self._heads(words).write.mode("overwrite").parquet(f"{path}/heads")
        reads = self.spark.read.schema(_READS).parquet(f"{path}/reads").groupBy("day").agg(F.sum("n").alias("memories"))
        sketches = words.groupBy("day").agg(F.count("*").alias("topics"), F.hll_sketch_agg("word", SKETCH).alias("sketch"))
        zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        asked.join(reads, "day", "left").join(sketches, "day", "left").select("day", zero("memories"), zero("topics"), "sketch").write.mode("overwrite").parquet(f"{path}/days")
        return self.manifest.commit([{"kind": "partial", "number": number, "rows": n}])

    def merge(self) -> int:
        """Fold all segments into one; what later counts replaced goes."""
        old = self._numbers()
        number, path = self.manifest.fresh()
        for name in _TABLES:
            rows = self._newest(name)
            (rows.sortWithinPartitions("word") if name == "words" else rows).write.mode("overwrite").parquet(f"{path}/{name}")
        n = self.spark.read.schema(_DAYS).parquet(f"{path}/days").count()
        return self.manifest.commit([{"kind": "partial", "number": number, "rows": n}], old)

    def coverage(self, exact: bool = True) -> DataFrame:
        """total_memories, estimated_topics and coverage_score, as quality.coverage(); by the sketches if not exact."""
        days = self._newest("days")
        n = days.agg(F.coalesce(F.sum("memories"), F.lit(0)).alias("total_memories"))
        if exact:
            topics = self._newest("words").groupBy("word").agg(F.lit(1).alias("one")).agg(F.count("*").alias("estimated_topics"))
        else:
            topics = days.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("estimated_topics"))
        return quality.coverage_of(n, topics)

    def health(self, log: DataFrame, as_of: str, exact: bool = True) -> DataFrame:
        """The figures of quality.memory_health(); memories are fresh by the day of their last reading, so an instant within a day counts that whole day, 30 days ago, as fresh."""
        since = F.date_sub(F.to_date(F.lit(as_of)), 30)
        counted = self._newest("reads").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("read_day") >= since, F.col("n"))), F.lit(0)).alias("fresh"))
        return quality.health_of(counted, self.coverage(exact), log)

    def top_words(self, k: int = 20) -> DataFrame:
        """(word, n) of the k commonest words, exact; equal ones in their order."""
        heads = self._newest("heads")
        cuts = heads.groupBy("day").agg(F.sum(F.when(F.col("r") > HEAD, F.col("n")).otherwise(0)).alias("cut"))
        inside = heads.where(F.col("r") <= HEAD).join(self._hint(cuts), "day")
        bounds = inside.groupBy("word").agg(F.sum("n").alias("least"), F.sum("cut").alias("own"))
        kth = bounds.orderBy(F.desc("least")).limit(k).agg(F.count("*").alias("found"), F.min("least").alias("least"))
        found, least, cut = kth.crossJoin(cuts.agg(F.coalesce(F.sum("cut"), F.lit(0)).alias("cut"))).first()  # one row each
        words = self._newest("words")
        if not (cut and (found < k or cut >= least)):  # a word in no head has less than the kth, or all words are in heads
            wanted = bounds.where(F.col("least") + cut - F.col("own") >= F.lit(least)).select("word")
            few = [r[0] for r in wanted.limit(MOST_LITERALS + 1).collect()]
            words = words.where(F.col("word").isin(few)) if len(few) <= MOST_LITERALS else words.join(wanted, "word", "left_semi")
        return words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(k)

    @staticmethod
    def _heads(words: DataFrame) -> DataFrame:
        """The HEAD commonest words of each day and the next one; the limit is taken in each task before the rows of a day meet."""
        order = Window.partitionBy("day").orderBy(F.desc("n"), "word")
        return words.withColumn("r", F.row_number().over(order)).where(F.col("r") <= HEAD + 1)

    def _numbers(self) -> list[int]:
        return [r["number"] for r in self.manifest.rows()]

    def _hint(self, days: DataFrame) -> DataFrame:
        """A frame of at most a row for each counted day, broadcast if those are few."""
        return F.broadcast(days) if sum(r["rows"] for r in self.manifest.rows()) <= MOST_DAYS else days

    def _newest(self, name: str) -> DataFrame:
        """The rows of a table that belong to the newest count of their day."""
        numbers = self._numbers()
        if not numbers:
            return self.spark.createDataFrame([], _TABLES[name])
        rows = self.manifest.read(numbers, name, _TABLES[name])
        if len(numbers) == 1:
            return rows.drop("segment")
        last = self.manifest.read(numbers, "days", _DAYS).groupBy("day").agg(F.max("segment").alias("segment"))
        return rows.join(self._hint(last), ["day", "segment"]).drop("segment")
