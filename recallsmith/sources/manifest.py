"""Tables that grow by immutable segments: folders with numbers, and a manifest that names the live ones.

A change writes its folders first and then the next manifest, a small JSON table of its own. Readers take the newest manifest that is complete, so a change is seen as a
whole or not at all; a writer that dies half-way leaves folders that no manifest names. One writer at a time.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "kind string, number long, folder string, segment long, rows long, words long, texts long"


def spread(rows: DataFrame) -> DataFrame:
    """Rows for a step that takes long for each of them: where they come from fewer files than there are cores, they are dealt out to all."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Bound the bytes of the session's later Arrow batches, so that rows of some KB each don't make batches of many MB; a lower setting is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def checkpoint_folder(spark: SparkSession) -> None:
    """Make checkpoint() usable: in the folder that spark.checkpoint.dir names, else, if the master is local, in a new local one."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
    context.setCheckpointDir(root or tempfile.mkdtemp(prefix="recallsmith-"))


class Manifest:
    """The manifests below a path: rows (kind, number, folder, segment, rows, words, texts)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._folders: dict[int, str] = {}

    def _versions(self) -> list[int]:
        """The numbers of the complete manifests, in order."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [f.getPath() for f in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def rows(self, version: int | None = None) -> list[dict]:
        """What a manifest names, the newest by default: a row for each live segment and tombstone, which are few."""
        known = self._versions()
        if not known:
            return []
        at = f"{self.path}/manifest/v{version or known[-1]}"
        out = [r.asDict() for r in self.spark.read.schema(_SCHEMA).json(at).collect()]
        self._folders.update((r["number"], r["folder"]) for r in out)
        return sorted(out, key=lambda r: (r["number"], r["segment"] or 0))

    def fresh(self) -> tuple[int, str]:
        """A number above all that are known, and the path of a folder for it."""
        number = max([0, *self._folders, *(r["number"] for r in self.rows())]) + 1
        self._folders[number] = f"segments/{number}-{uuid.uuid4().hex[:8]}"
        return number, f"{self.path}/{self._folders[number]}"

    def commit(self, add: list[dict], drop: list[int] | tuple[int, ...] = ()) -> int:
        """Write the next manifest: the rows of the last one without some numbers, and new ones."""
        kept = [r for r in self.rows() if r["number"] not in set(drop)]
        new = [{"segment": None, "rows": 0, "words": 0, "texts": 0, **r, "folder": self._folders[r["number"]]} for r in add]
        version = max([0, *self._versions()]) + 1
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        table = self.spark.createDataFrame([tuple(r[c] for c in names) for r in kept + new], _SCHEMA)
        table.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/v{version}")
        return version

    def read(self, numbers: list[int], name: str, schema: str) -> DataFrame:
        """The rows of a table of some folders, with `segment`, the folder's number."""
        reader = self.spark.read.schema(schema)
        parts = [reader.parquet(f"{self.path}/{self._folders[n]}/{name}").withColumn("segment", F.lit(n).cast("long")) if "segment long" not in schema else reader.parquet(f"{self.path}/{self._folders[n]}/{name}") for n in numbers]
        return reduce(DataFrame.unionByName, parts)
