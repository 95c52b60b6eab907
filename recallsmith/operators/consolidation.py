"""Near-duplicate memories: candidates, similar pairs, clusters, fused rows."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from recallsmith.functions import scoring, text
from recallsmith.operators import cosine_join
from recallsmith.sources.manifest import checkpoint_folder

THRESHOLD = 0.92
#: Random projections: tables and signs in each. Two vectors at cosine .92 meet in some table with a chance of 99.4 %.
TABLES, SIGNS = 24, 12
#: Members of a part of a block; the parts of larger blocks meet two by two.
BLOCK_PART = 256
#: Nodes that a task holds while it leaves out pairs.
FOREST = 1 << 18


def candidates(memories: DataFrame, embeddings: DataFrame, meta: DataFrame, as_of: str, user: str = "default", min_age_hours: float = 1.0, batch: int = 200) -> DataFrame:
    """(id, text, embedding) of a user's oldest `batch` memories that are not deleted and of some age; those without an embedding then drop out."""
    gone = meta.where("is_deleted").select("id")
    old = F.unix_micros(F.col("created_at")) < F.unix_micros(scoring.instant(as_of)) - int(min_age_hours * 3_600_000_000)
    rows = memories.where((F.col("user_id") == user) & old).join(gone, "id", "left_anti").orderBy("created_at", "id").limit(batch)
    return rows.select("id", "text").join(embeddings.select("id", "embedding"), "id", "left").where(F.size("embedding") > 0)


def _dot(v: str, w: str):
    return F.aggregate(F.zip_with(v, w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, block: str | None = None) -> DataFrame:
    """(a, b, sim) with a < b and cosine >= threshold; vectors (id, embedding[, block]).

    With a block column only pairs of one block are compared (approximate where blocks lose pairs); without, all are: see cosine_join. Copies of a
    vector are paired with all that it is similar to, and with each other; where many are equal, similar_classes() tells the same in fewer rows.
    """
    if block is not None:
        unit = cosine_join.unit_vectors(vectors, block).withColumnRenamed(block, "block").select("id", "block", "v")
        return cosine_join.similar_in_blocks(unit, threshold)
    heads, copies = cosine_join.classes(vectors)
    found = cosine_join.similar_heads(heads, threshold)
    if copies.isEmpty():
        return found
    members = copies.select("a", F.col("b").alias("id")).unionByName(copies.select("a", F.col("a").alias("id")).distinct())
    of = lambda side, name: members.select(F.col("a").alias(side), F.col("id").alias(name))
    each = found.join(of("a", "x"), "a", "left").join(of("b", "y"), "b", "left").select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"), "sim")
    ends = F.array(F.lit(1.0))
    within = _within(members.select("id", F.col("a").alias("block"), ends.alias("v"))).select(F.col("id").alias("x"), F.col("b").alias("y"), F.lit(1.0).alias("sim"))
    return each.unionByName(within).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")


def _within(rows: DataFrame) -> DataFrame:
    """(id, v, b, w) of all pairs id < b of one block; rows (id, block, v). A large block is cut into parts, so that no task gets more than two of them."""
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_PART).cast("int").alias("parts")).where(F.col("block").isNotNull())
    dealt = rows.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    x = dealt.select("block", "id", "v", "part", F.explode(every).alias("other"))
    left = x.where("part <= other").select("block", "id", "v", F.col("part").alias("i"), F.col("other").alias("j"))
    right = x.where("part >= other").select("block", F.col("id").alias("b"), F.col("v").alias("w"), F.col("other").alias("i"), F.col("part").alias("j"))
    # a pair meets once: in parts i < j from either side, within one part in the order of ids
    met = left.join(right, ["block", "i", "j"]).where("id <> b AND (i < j OR id < b)")
    swap = F.col("id") > F.col("b")
    return met.select(F.least("id", "b").alias("id"), F.when(swap, F.col("w")).otherwise(F.col("v")).alias("v"), F.greatest("id", "b").alias("b"), F.when(swap, F.col("v")).otherwise(F.col("w")).alias("w"))


def near_pairs(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, signs: int = SIGNS) -> DataFrame:
    """(a, b, sim) as similar_pairs() gives, for any number of vectors, by random projections: pairs are compared that have all
    signs of some table alike. Approximate: a pair at cosine c is missed with a chance of (1 - (1 - acos(c) / pi) ** signs) ** tables.

    Equal vectors meet as one, so copies are no block of their own: each copy is paired with the least id of its vector, and that one with others.
    """
    unit = cosine_join.unit_vectors(vectors).select("id", "v").withColumn("h", F.xxhash64("v"))
    heads = unit.groupBy("h").agg(F.min("id").alias("a"))
    named = unit.join(heads, "h")
    copies = named.where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("sim"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in it:
            x = [np.array(v, np.float64) for v in b.column(1).to_pylist()]
            out = []
            for v in x:
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng(len(v)).standard_normal((len(v), tables * signs))
                bits = (v @ planes[len(v)] > 0).reshape(tables, signs)
                out.append((bits @ (1 << np.arange(signs)) + (np.arange(tables) << signs)).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int64()))], ["id", "v", "blocks"])

    part = named.where("id = a").select("id", "v")
    signed = part.mapInArrow(run, part.select("*").schema.add("blocks", ArrayType(LongType())))
    met = _within(signed.select("id", F.explode("blocks").alias("block"), "v"))
    found = met.withColumn("sim", F.round(_dot("v", "w"), 6)).where(F.col("sim") >= threshold).select(F.col("id").alias("a"), "b", "sim").distinct()
    return found.unionByName(copies)


def forest(pairs: DataFrame) -> DataFrame:
    """(a, b, n): for each partition of pairs a few of them that join the same nodes, and, on one row of each batch of them, how many pairs they stand for.

    What a task holds is bounded: beyond FOREST nodes it tells what it has and begins anew.
    """
    kind = pairs.schema["a"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        for b in it:
            out_a, out_b = [], []
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                r, s = x, y
                while (p := parent.setdefault(r, r)) != r:
                    parent[r] = r = parent[p]
                while (p := parent.setdefault(s, s)) != s:
                    parent[s] = s = parent[p]
                if r != s or x == y:
                    parent[r] = s
                    out_a.append(x)
                    out_b.append(y)
            if b.num_rows and not out_a:  # a row tells the number
                out_a, out_b = [b.column(0)[0].as_py()], [b.column(1)[0].as_py()]
            n = np.zeros(len(out_a), np.int64)
            n[:1] = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(out_a, b.column(0).type), pa.array(out_b, b.column(1).type), pa.array(n)], ["a", "b", "n"])
            if len(parent) > FOREST:
                parent.clear()

    return pairs.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}, n long")


def clusters(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, cluster): the least id that can be reached over pairs; each round is checkpointed, so lineage stays short.

    Pairs that join nothing new in their task are left out before anything is shuffled.
    """
    checkpoint_folder(pairs.sparkSession)
    few = pairs if "n" in pairs.columns else forest(pairs).checkpoint()
    edges = few.select("a", "b").union(few.select("b", "a")).distinct().checkpoint()
    labels = edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("cluster")).checkpoint()
    for _ in range(most_rounds):
        near = edges.join(labels, edges["b"] == labels["id"]).groupBy("a").agg(F.min("cluster").alias("m"))
        # a node also takes its label's label, which halves long paths
        jump = labels.select(F.col("id").alias("cluster"), F.col("cluster").alias("j"))
        new = labels.join(near, labels["id"] == near["a"]).join(jump, "cluster").select("id", F.least("cluster", "m", "j").alias("new"), "cluster").checkpoint()
        if new.where("new <> cluster").isEmpty():
            return labels
        labels = new.select("id", F.col("new").alias("cluster"))
    raise RuntimeError("clusters did not settle")


def fuse(texts: DataFrame, most: int = 2000) -> DataFrame:
    """(cluster, fused, members): sentences of the longest texts first, each once, as far as they fit; texts (cluster, id, text).

    A sentence that doesn't fit is left out and the next is tried; without any sentence the longest text stands.
    """
    listed = F.array_sort(F.collect_list(F.struct((-F.length("text")).alias("k"), "id", "text")))
    groups = texts.groupBy("cluster").agg(listed.alias("x"))
    every = F.array_distinct(F.flatten(F.transform("x", lambda r: text.sentences(r["text"]))))
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def add(acc, s):
        fits = acc["n"] + F.length(s) + 2 <= most
        return F.struct(F.when(fits, acc["n"] + F.length(s) + 2).otherwise(acc["n"]).alias("n"), F.when(fits, F.concat(acc["out"], F.array(s))).otherwise(acc["out"]).alias("out"))

    kept = F.aggregate(every, start, add, lambda acc: acc["out"])
    return groups.select("cluster", F.when(F.size(kept) > 0, F.array_join(kept, ". ")).otherwise(F.col("x")[0]["text"]).alias("fused"), F.transform(F.array_sort(F.transform("x", lambda r: r["id"])), lambda i: i).alias("members"))


def merge_metadata(rows: list[str | None]) -> str:
    """Metadata objects as one: the one with most keys (of equal ones the first) is the base; keys it lacks come from all others in order, objects
    are merged one level deep (later values win), lists get the items they lack, and other values stay. What can't be read is an empty object."""
    found = []
    for r in rows:
        try:
            value = json.loads(r or "{}")
        except ValueError:
            value = {}
        found.append(value if isinstance(value, dict) else {})
    base = max(range(len(found)), key=lambda i: len(found[i]), default=None)
    out = {} if base is None else dict(found[base])
    canonical = lambda v: json.dumps(v, sort_keys=True)
    for other in found[:base] + found[base + 1 :] if found else ():
        for key, value in other.items():
            held = out.setdefault(key, value)
            if isinstance(held, dict) and isinstance(value, dict):
                out[key] = held | value
            elif isinstance(held, list) and isinstance(value, list):
                known = set(map(canonical, held))
                out[key] = held + [v for v in value if canonical(v) not in known]
    return json.dumps(out, sort_keys=True, ensure_ascii=False)


def merged_metadata(groups: DataFrame) -> DataFrame:
    """(cluster, metadata) of rows (cluster, items array<string>), a cluster's metadata objects in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merge_metadata(x) for x in b.column(1).to_pylist()], pa.string())], ["cluster", "metadata"])

    part = groups.select("cluster", "items")
    return part.mapInArrow(run, f"cluster {part.schema['cluster'].dataType.simpleString()}, metadata string")


def consolidate(memories: DataFrame, pairs: DataFrame, as_of: str, embeddings: DataFrame | None = None) -> dict[str, DataFrame]:
    """The new rows, the overlay of soft deletes, and the log, from one set of clusters; memories (id, text[, metadata]).

    A new row has the fused text, the merged metadata with the number of members and the date, and the embedding of its longest text (of equally
    long ones the least id).
    """
    joined = memories.join(clusters(pairs), "id")
    fused = fuse(joined.select("cluster", "id", "text"))
    new_id = F.concat(F.lit("c_"), F.substring(F.sha2(F.array_join("members", ","), 256), 1, 12))
    new = fused.select(new_id.alias("id"), "cluster", F.col("fused").alias("text"), scoring.instant(as_of).alias("created_at"), "members")
    if "metadata" in memories.columns:
        items = joined.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "metadata"))), lambda x: x["metadata"]).alias("items"))
        added = F.concat(F.regexp_replace("metadata", r"\}$", ""), F.when(F.col("metadata") == "{}", "").otherwise(", "), F.lit('"consolidated_from": '), F.size("members").cast("string"), F.lit(f', "consolidation_date": "{as_of}"}}'))
        new = new.join(merged_metadata(items), "cluster").withColumn("metadata", added)
    if embeddings is not None:
        longest = joined.groupBy("cluster").agg(F.min(F.struct((-F.length("text")).alias("k"), "id")).alias("x"))
        best = longest.select("cluster", F.col("x.id").alias("id")).join(embeddings.select("id", "embedding"), "id", "left").select("cluster", "embedding")
        new = new.join(best, "cluster", "left")
    new = new.drop("cluster")
    gone = new.select(F.col("id").alias("replaced_by_id"), F.explode("members").alias("id")).select("id", "replaced_by_id", F.concat(F.lit("consolidated into "), F.substring("replaced_by_id", 1, 8)).alias("delete_reason"))
    log = new.select(F.col("id").alias("consolidated_into_id"), F.col("members").alias("source_ids"), F.size("members").alias("source_count"), text.truncate(F.col("text"), 200, "").alias("fused_text_preview"), "created_at")
    return {"rows": new.drop("members"), "deleted": gone, "log": log}


def summary(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: pairs found, clusters, members superseded; pairs, or what forest() made of them."""
    p = pairs.agg((F.coalesce(F.sum("n"), F.lit(0)) if "n" in pairs.columns else F.count("*")).alias("pairs_found"))
    return labels.agg(F.countDistinct("cluster").alias("clusters"), F.count("*").alias("total_superseded")).crossJoin(p)  # one row each


def overlay_deletes(meta: DataFrame, deletes: DataFrame) -> DataFrame:
    """meta with the rows of deletes (id, replaced_by_id, delete_reason) marked deleted; what meta tells of older deletions stays."""
    j = meta.join(deletes.select("id", F.col("replaced_by_id").alias("_by"), F.coalesce("delete_reason", F.lit("deleted")).alias("_why")), "id", "left")
    kept = lambda c: F.col(c) if c in meta.columns else F.lit(None).cast("string")
    marked = {"is_deleted": F.col("is_deleted") | F.col("_why").isNotNull(), "replaced_by_id": F.coalesce("_by", kept("replaced_by_id")), "delete_reason": F.coalesce("_why", kept("delete_reason"))}
    return j.withColumns(marked).drop("_by", "_why")
