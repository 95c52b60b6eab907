"""Sources and sinks: source trees, git history, JSON files, memories, keyed tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.functions import text
from recallsmith.sources import git_source

#: Folders that a source scan leaves out.
IGNORED = (".git", ".venv", "__pycache__")
#: Length of the default embedding.
EMBEDDING = 64


def source_tree(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """(path, content) of the files below a root; whole files, without ignored folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return files.where(~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/")).select("path", F.col("content").cast("string").alias("content"))


def git_commits(spark: SparkSession, repository: str, most: int = 100) -> DataFrame:
    """(sha, author, date, message, files, stat) of a repository's newest commits, read by ranges in the tasks (git_source.py); a folder without history gives no row."""
    spark.dataSource.register(git_source.GitHistory)
    return spark.read.format("git_history").option("most", most).load(repository)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, with a given schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expected) of an evaluation set's files {"cases": [{"query": ..., "expected": [ids]}]}; ids in the order of the cases."""
    rows = read_json(spark, path, "cases array<struct<query:string,expected:array<string>>>")
    return rows.select(F.posexplode("cases").alias("query_id", "c")).select("query_id", "c.query", "c.expected")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def hash_embedding(texts: list[str | None], size: int = EMBEDDING) -> list[list[float]]:
    """The default embedding: signed counts of hashed words, to length 1; without words all zeros."""
    import math
    import re

    import xxhash

    out = []
    for t in texts:
        v = [0.0] * size
        for w in re.findall(text.TOKEN, (t or "").lower()):
            h = xxhash.xxh64_intdigest(w.encode())
            v[h % size] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(sum(x * x for x in v))
        out.append([x / n for x in v] if n else v)
    return out


def embed(rows: DataFrame, model: Callable[[list[str | None]], list[list[float]]] = hash_embedding) -> DataFrame:
    """(id, embedding) of rows (id, text) by a model, which takes and gives a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model(b.column(1).to_pylist()), pa.list_(pa.float32()))], ["id", "embedding"])

    part = rows.select("id", "text")
    return part.mapInArrow(run, f"id {part.schema['id'].dataType.simpleString()}, embedding array<float>")


def new_memories(rows: DataFrame, at: Column, workspace: str | None = None) -> DataFrame:
    """(id, user_id, text, created_at, metadata, tier) of new rows (text[, id, user_id, metadata map, tier]): secrets masked, defaults filled in.

    The id is derived from user, text and instant; a tier that the metadata names is stored, else it is semantic; the workspace is added unless it is there.
    """
    has = lambda c, default: F.coalesce(F.col(c), default) if c in rows.columns else default
    none = F.create_map().cast("map<string,string>")
    given = has("metadata", none)
    root = workspace.rstrip("/") if workspace else None
    defaults = F.create_map(F.lit("workspace_root"), F.lit(root), F.lit("workspace_name"), F.lit(root.rsplit("/", 1)[-1])) if root else none
    meta = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(given, k)), given)
    clean, user = text.redact_secrets(F.col("text")), has("user_id", F.lit("default"))
    made = F.concat(F.lit("m_"), F.substring(F.sha2(F.concat_ws("|", user, clean, at.cast("string")), 256), 1, 12))
    tier = F.coalesce(*([F.col("tier")] if "tier" in rows.columns else []), F.element_at(given, F.lit("memory_tier")), F.lit("semantic"))
    return rows.select(has("id", made).alias("id"), user.alias("user_id"), clean.alias("text"), at.alias("created_at"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(meta)))).alias("metadata"), tier.alias("tier"))


def append_memories(rows: DataFrame, path: str, at: Column, workspace: str | None = None, model: Callable[[list[str | None]], list[list[float]]] = hash_embedding) -> None:
    """Append new memories below a path, partitioned by tier, so that tier scans prune folders, and their embeddings beside them."""
    new = new_memories(rows, at, workspace)
    new.write.mode("append").partitionBy("tier").parquet(f"{path}/memories")
    embed(new, model).write.mode("append").parquet(f"{path}/embeddings")


def replace_memories(memories: DataFrame, new: DataFrame) -> DataFrame:
    """Memories with new ones in the place of those with the same id; of new ones with one id the newest (of equally new ones the greatest text)."""
    rest = [c for c in new.columns if c not in ("id", "created_at")]
    last = new.groupBy("id").agg(F.max(F.struct("created_at", *rest)).alias("x")).select("id", "x.*")
    return memories.join(last.select("id"), "id", "left_anti").unionByName(last, allowMissingColumns=True)


def hard_delete(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows without those whose key is among `gone`."""
    return rows.join(gone.select(key), key, "left_anti")


def unembedded(memories: DataFrame, embeddings: DataFrame, most: int = 1000) -> DataFrame:
    """The newest `most` memories without an embedding; a null id is never among them."""
    return memories.where("id IS NOT NULL").join(embeddings.select("id"), "id", "left_anti").orderBy(F.desc("created_at"), "id").limit(most)


def seed_if_empty(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Copy a table to a path only if nothing is there yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return False
    df.write.parquet(path)
    return True
