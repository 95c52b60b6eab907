"""Helpers that the text operators share: shared storage, columns, and connected components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_TABLES: list[tuple[SparkSession, str]] = []
#: Rows of a few numbers, and bytes of stored texts, that make a file worth writing.
FILE_ROWS, FILE_BYTES = 1 << 18, 32 << 20
#: Files of a small table.
FEWEST = 4
#: Bytes and rows that go to a Python worker at a time.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000


_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new local one, the same for all of an application, if the master is local too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="recallsmith-"))
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that is not in use; it is deleted when the driver's Python ends."""
    path = f"{shared_root(spark)}/recallsmith-{tag}-{uuid.uuid4().hex[:12]}"
    if not _TABLES:
        atexit.register(_clean)
    _TABLES.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what shared_path() named, through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _TABLES[:] = [x for x in _TABLES if x[1] != path]


def _clean() -> None:
    for spark, path in list(_TABLES):
        try:
            drop_path(spark, path)
        except Exception:  # the session may be closed already
            return


def materialise(spark: SparkSession, df: DataFrame, tag: str, **figures: Column) -> DataFrame:
    """Cut the lineage: write df as Parquet below the shared folder and read it back.

    Any executor can reread it, so a lost executor costs only its own running tasks. Aggregates named by `figures` are taken of the rows
    as they are written, without a job of their own, and are in the result's `figures`.
    """
    path, seen = shared_path(spark, tag), Observation()
    made = df.observe(seen, *(x.alias(k) for k, x in figures.items())) if figures else df
    made.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    out.figures = seen.get if figures else {}
    return out


@contextmanager
def no_small_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins that begin and end in here are shuffled, unless a hint says otherwise: where there are dozens of small ones, each that is broadcast costs the driver
    a thread with its stack, and the rows as a table and as blocks."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {x: spark.conf.get(x, None) for x in names}
    try:
        for x in names:
            spark.conf.set(x, "-1")
        yield
    finally:
        for x, v in before.items():
            spark.conf.unset(x) if v is None else spark.conf.set(x, v)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's later Python stages, by bytes too, so that a batch of long texts stays small.

    A lower setting of the session, in plain numbers, is kept.
    """
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def lighten() -> None:
    """Called where a Python stage begins: let go of the word memos that an earlier stage left in this worker, and give free memory back."""
    if tokens := sys.modules.get("recallsmith.llm.tokens"):
        tokens.LOADED.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def few_files(spark: SparkSession, df: DataFrame, rows: int | None = None, scanned: DataFrame | None = None, row_limit: int = FILE_ROWS) -> DataFrame:
    """df in as few partitions as a bound of its rows, or the stored bytes of the table it was scanned from, calls for; no shuffle.

    Of texts there are never fewer than twice as many as the cluster runs at once, so no core waits, and of rows of a few numbers never fewer
    than FEWEST. What is written next then has files worth opening: a file costs a few calls to the store (on local folders, processes of
    their own) however small it is.
    """
    need = max(FEWEST, -(-rows // row_limit)) if rows is not None else max(2 * spark.sparkContext.defaultParallelism, -(-input_bytes(scanned) // FILE_BYTES))
    return df.coalesce(int(min(need, 1 << 30)))


def drop_table(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that materialise() wrote and that nothing will read again."""
    drop_path(spark, table._shared_path)


def crc32_mod(column: str, n: int):
    """crc32 of the column's text form, modulo n, as a column."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Hashes that decide on a sample are taken modulo this.
SAMPLE_RANGE = 1 << 62


def sample_limit(wanted: int, rows: int) -> int:
    """Rows whose hash modulo SAMPLE_RANGE is below this are a sample of about 1.1 * wanted of so many rows, however many there are."""
    return SAMPLE_RANGE if 10 * rows <= 11 * wanted else 11 * wanted * SAMPLE_RANGE // (10 * rows)


def sampled(rows: DataFrame, group: str, counts: dict, wanted: int, *by: str) -> DataFrame:
    """About 1.1 * wanted rows of each group, chosen by a hash of the columns `by`; groups without a count are left out."""
    if not counts:
        return rows.limit(0)
    limits = F.create_map(*(F.lit(x) for g, n in counts.items() for x in (g, sample_limit(wanted, n))))
    return rows.where(F.pmod(F.xxhash64(*by), F.lit(SAMPLE_RANGE)) < F.element_at(limits, F.col(group)))


def fresh_name(df: DataFrame, tag: str) -> str:
    """A column name that df doesn't have."""
    return f"{tag}_{uuid.uuid4().hex[:8]}"


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size; for file scans, the size of the files it reads."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def batches(rows: Iterable, most: int = 512) -> Iterator[list]:
    """Lists of at most `most` items."""
    out: list = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield out
            out = []
    if out:
        yield out


def connected_components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Label (node, root) of the nodes of edges (a long, b long): root is the least node that can be reached; roots have no row.

    Alternating large-star and small-star steps: each round links nodes to the least neighbour, so paths
    shrink exponentially and no node ever gathers its whole component in one task. A hub's neighbours meet in
    an aggregate of one number per hub (min), whose partial sums run before the shuffle, and in a join that adaptive
    execution may split. Each round is written to shared storage, so lost executors replay one round at most.
    Self loops and repeated edges are allowed; an empty table gives an empty table.
    """
    pairs = materialise(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges", n=F.count("*"))
    n, signature = pairs.figures["n"], None
    for _ in range(most_rounds if n else 1):
        if not n:
            break
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large star: the greater neighbours of u, and u itself, are linked to u's least neighbour
        big = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = big.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        # small star: the smaller neighbours of u are linked to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, pairs = pairs, materialise(spark, few_files(spark, small, rows=2 * n), "edges", n=F.count("*"), hashes=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        drop_table(spark, before)
        if pairs.figures == signature:
            break
        signature = pairs.figures
    else:
        raise RuntimeError("connected components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def local_path(path: str) -> str | None:
    """The plain path of a file: or scheme-less URI, else None."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


class SharedFiles:
    """Whole files below a shared folder, written once by tasks and mapped or read by others.

    A file: folder is used in place; other schemes go through pyarrow's file systems. A write appears under its
    name only when it is complete, so a task that runs twice or dies half-way leaves no partial file.
    """

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, name: str, data: bytes) -> None:
        if base := local_path(self.root):
            os.makedirs(base, exist_ok=True)
            part = f"{base}/.{name}.{uuid.uuid4().hex[:8]}"
            with open(part, "wb") as f:
                f.write(data)
            os.replace(part, f"{base}/{name}")
            return
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        store.create_dir(base, recursive=True)
        part = f"{base}/.{name}.{uuid.uuid4().hex[:8]}"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, f"{base}/{name}")

    def map(self, name: str):
        """The file's bytes as a read-only buffer; memory-mapped where the folder is a mounted one."""
        import numpy as np

        if base := local_path(self.root):
            path = f"{base}/{name}"
            return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        with store.open_input_file(f"{base}/{name}") as f:
            return np.frombuffer(f.read(), np.uint8)
