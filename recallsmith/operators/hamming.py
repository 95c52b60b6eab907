"""A stored index of hypervectors: written once, appended to, searched without reading texts.

The bits of a hypervector are alike independent, so any of its words are a sample of its bits. A segment keeps its rows in two tables: `near` has each row's
entities and the first COARSE words, `full` all words, sorted by id. A search reads `near` alone first. From the sampled bits each row's similarity is known to
within a margin that holds for all but a chance of CHANCE a row (Hoeffding's bound, without replacement); the entities' share of the score is exact. Rows whose greatest
possible score is below the kth least possible one are out; the rest are read in full and ranked by exact scores. So a search equals the full scan but for
that chance, whatever the data: where nothing stands out, all rows are read. (Blocks of equal bits can't find such rows: related vectors agree in 55 to 70 % of
their bits, so blocks long enough to part unrelated rows part related ones too.)

A manifest names the live segments and tombstones; each change writes new folders first, then the next manifest, so readers see a change as a whole or not at
all, and a writer that dies leaves only folders that nothing names. One writer at a time.

Cases: a row that is appended again replaces the earlier one; of equal ids within one append the row with the greatest text stays; deleting unknown ids does nothing; rows without
an id are not indexed; null and empty texts have the vector of an empty text and no entities; ties are in the order of ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.functions import text
from recallsmith.operators import hdc
from recallsmith.sources.manifest import Manifest, small_batches

#: Words of the sample, and the chance that a row's similarity is beyond the margin told from it.
COARSE, CHANCE = 64, 1e-9
#: Up to so many rows are looked up by their ids, and joined by a broadcast.
LOOKUP = 20_000
#: Rows that a task compares at once.
SLICE = 512
#: Small row groups, which a reader of few ids can skip; random bits have no values twice and can't be compressed.
_STORED = {"parquet.block.size": 4 << 20, "parquet.enable.dictionary#hv": "false", "compression": "none"}
_NEAR = "id string, entities array<string>, head binary"


def margin(words: int, coarse: int = COARSE, chance: float = CHANCE) -> float:
    """How far the similarity of all bits may be from that of a sample of them, but for a chance."""
    sampled, every = 64 * coarse, 64 * words
    return math.sqrt((1 - (sampled - 1) / every) * math.log(2 / chance) / (2 * sampled)) if coarse < words else 0.0


def _similar(rows: DataFrame, column: str, query: np.ndarray) -> DataFrame:
    """(id, entities, sim) of rows with packed words, compared with the query's words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(start, SLICE) for b in it for start in range(0, b.num_rows, SLICE)):
            words = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u8").reshape(b.num_rows, -1)
            sim = 1 - np.bitwise_count(words ^ query).sum(1, dtype=np.int64) / (64 * query.size)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], ["id", "entities", "sim"])

    return rows.select("id", "entities", column).mapInArrow(run, "id string, entities array<string>, sim double")


class VectorIndex:
    """Hypervectors below a path in shared storage."""

    def __init__(self, spark: SparkSession, path: str, words: int = hdc.WORDS) -> None:
        self.spark, self.path, self.words, self.coarse = spark, path, words, min(COARSE, words)
        self.manifest = Manifest(spark, path)
        small_batches(spark)

    # --- changes ---

    def append(self, memories: DataFrame) -> VectorIndex:
        """Encode and write new rows (id, text and what hdc.index() reads) as a segment; rows with their ids that are there are replaced."""
        new = memories.where("id IS NOT NULL").withColumn("id", F.col("id").cast("string"))
        if not new.groupBy("id").count().where("count > 1").isEmpty():  # of equal ids the row with the greatest text stays
            rest = [c for c in new.columns if c not in ("id", "text")]
            new = new.groupBy("id").agg(F.max(F.struct("text", *rest)).alias("x")).select("id", "x.*")
        number, at = self.manifest.fresh()
        # texts are put in order, not vectors: an order by ranges looks at its rows twice, and vectors would be made twice for it
        hdc.index(new.repartitionByRange("id").sortWithinPartitions("id"), self.words, packed=True).write.options(**_STORED).parquet(f"{at}/full")
        full = self.spark.read.schema("id string, entities array<string>, hv binary").parquet(f"{at}/full")
        full.select("id", "entities", F.substring("hv", 1, 8 * self.coarse).alias("head")).write.parquet(f"{at}/near")
        old = self._tombstones(full.select("id"))
        self.manifest.commit(add=[{"kind": "segment", "number": number, "rows": full.count()}, *old])
        return self

    def delete(self, ids: DataFrame) -> VectorIndex:
        """Take rows out: a tombstone names the segment and the id of each that is live."""
        if old := self._tombstones(ids):
            self.manifest.commit(add=old)
        return self

    def _tombstones(self, ids: DataFrame) -> list[dict]:
        live = self.near()
        if live is None:
            return []
        dead = live.join(ids.select(F.col("id").cast("string")).distinct(), "id", "left_semi").select("segment", "id")
        number, at = self.manifest.fresh()
        dead.write.parquet(f"{at}/gone")
        n = self.spark.read.schema("segment long, id string").parquet(f"{at}/gone").count()
        return [{"kind": "gone", "number": number, "rows": n}] if n else []

    def backfill(self, memories: DataFrame, most: int = hdc.BACKFILL) -> VectorIndex:
        """Append up to `most` memories that the index lacks, newest first."""
        live = self.near()
        new = memories if live is None else memories.join(live.select("id"), "id", "left_anti")
        return self.append(new.orderBy(F.desc("created_at"), "id").limit(most) if most < 1 << 30 else new)

    def merge(self) -> VectorIndex:
        """Rewrite all live rows as one segment; vectors are copied, not made again."""
        live = self._table("full", "id string, entities array<string>, hv binary")
        if live is None:
            return self
        number, at = self.manifest.fresh()
        live.drop("segment").repartitionByRange("id").sortWithinPartitions("id").write.options(**_STORED).parquet(f"{at}/full")
        full = self.spark.read.schema("id string, entities array<string>, hv binary").parquet(f"{at}/full")
        full.select("id", "entities", F.substring("hv", 1, 8 * self.coarse).alias("head")).write.parquet(f"{at}/near")
        self.manifest.commit(add=[{"kind": "segment", "number": number, "rows": full.count()}], drop=[r["number"] for r in self.manifest.rows()])
        return self

    # --- reading ---

    def _table(self, name: str, schema: str) -> DataFrame | None:
        """The live rows of a table of all segments, with their segment; None without segments."""
        every = self.manifest.rows()
        parts = [r["number"] for r in every if r["kind"] == "segment"]
        if not parts:
            return None
        rows = self.manifest.read(parts, name, schema)
        gone = [r for r in every if r["kind"] == "gone"]
        if not gone:
            return rows
        dead = self.manifest.read([r["number"] for r in gone], "gone", "segment long, id string").select("segment", "id")
        return rows.join(F.broadcast(dead) if sum(r["rows"] for r in gone) <= LOOKUP else dead, ["segment", "id"], "left_anti")

    def near(self) -> DataFrame | None:
        return self._table("near", _NEAR)

    def _score(self, sim, wanted):
        return F.round(hdc.score(sim, F.col("entities"), wanted), 9)

    def candidates(self, said: str, limit: int, scope: DataFrame | None = None) -> DataFrame | None:
        """Ids, and the greatest possible scores, of the rows that may be among the best `limit`, told from sampled bits and entities; None without segments.

        `scope` (id) restricts the search: what it leaves out neither ranks nor bounds.
        """
        live = self.near()
        if live is None:
            return None
        live = live if scope is None else live.join(scope.select("id"), "id", "left_semi")
        wanted, query, slack = text.extract_entities(F.lit(said)), self._query(said), margin(self.words, self.coarse)
        told = _similar(live, "head", query[: self.coarse])
        bounds = told.select("id", self._score(F.col("sim") - slack, wanted).alias("least"), self._score(F.col("sim") + slack, wanted).alias("most"))
        kth = bounds.orderBy(F.desc("least")).limit(limit).agg(F.when(F.count("*") == limit, F.min("least")).alias("kth")).first()["kth"]
        return bounds.select("id", "most") if kth is None else bounds.where(F.col("most") >= kth).select("id", "most")

    def _query(self, said: str) -> np.ndarray:
        return np.array(hdc.query_vector(said, self.words), np.int64).view(np.uint64)

    def query(self, said: str, limit: int = 200, scope: DataFrame | None = None) -> DataFrame:
        """(id, score) of the best `limit` rows, as hdc.query() over all of them would rank them."""
        found = self.candidates(said, limit, scope)
        if found is None:
            return self.spark.createDataFrame([], "id string, score double")
        full = self._table("full", "id string, entities array<string>, hv binary")
        few = [r[0] for r in found.select("id").limit(LOOKUP + 1).collect()]
        # a few are looked up by their ids, which skips most of the sorted files; else the tables are joined
        rows = full.where(F.col("id").isin(few)) if len(few) <= min(LOOKUP, 1000) else full.join(F.broadcast(found.select("id")) if len(few) <= LOOKUP else found.select("id"), "id", "left_semi")
        exact = _similar(rows, "hv", self._query(said)).select("id", self._score(F.col("sim"), text.extract_entities(F.lit(said))).alias("score"))
        return exact.orderBy(F.desc("score"), "id").limit(limit)

    def vectors(self) -> DataFrame:
        """(id, entities, hv array<bigint>) of the live rows, as hdc.index() gives them."""
        full = self._table("full", "id string, entities array<string>, hv binary")
        schema = "id string, entities array<string>, hv array<bigint>"
        if full is None:
            return self.spark.createDataFrame([], schema)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(start, SLICE) for b in it for start in range(0, b.num_rows, SLICE)):
                parts = [np.frombuffer(v, "<i8") for v in b.column(2).to_pylist()]
                ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
                hv = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hv], ["id", "entities", "hv"])

        return full.select("id", "entities", "hv").mapInArrow(run, schema)

    def stats(self) -> DataFrame:
        """One row as hdc.stats() gives it; no vector is read."""
        live = self.near()
        rows = self.spark.createDataFrame([], "id string, entities array<string>") if live is None else live
        return hdc.stats(rows.select("id", "entities", F.lit(True).alias("hv")))
