"""The logical tables of the engine over the star-schema test tables."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.operators.hamming import VectorIndex
from recallsmith.operators.index import TextIndex, build

AS_OF = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new local one, the same for all of an application, where it is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all nodes share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.get(app) or _LOCAL.setdefault(app, "file://" + tempfile.mkdtemp(prefix="recallsmith-"))
    return root.rstrip("/")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, user_id, text, created_at, tier, module, type."""
    d = table(spark, sf_dir, "documents")
    user = F.when(F.col("doc_id") % 10 < 8, "default").when(F.col("doc_id") % 10 == 8, "system").otherwise("other")
    tier = F.when(F.col("doc_id") % 3 == 0, "semantic").when(F.col("doc_id") % 3 == 1, "episodic").otherwise("working")
    created = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60)
    return d.select(F.col("doc_id").cast("string").alias("id"), user.alias("user_id"), "text", created.alias("created_at"), tier.alias("tier"), F.col("source").alias("module"), F.col("lang").alias("type"))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, is_deleted, deleted_at, delete_reason, hit_count, last_accessed_at of every memory; hits are events of the user with the memory's number."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    hits = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("hit_count"), F.max("ts").cast("timestamp").alias("last_accessed_at"))
    gone = table(spark, sf_dir, "labels").where("toxic = 1").groupBy("doc_id").agg(F.lit(True).alias("is_deleted"))
    joined = d.join(hits, d["doc_id"] == hits["user_id"], "left").join(gone, "doc_id", "left")
    at = F.when(F.col("is_deleted"), F.timestamp_seconds(F.lit(1_706_000_000) + F.col("doc_id") % 50 * 60))
    why = F.when(F.col("is_deleted"), F.when(F.col("doc_id") % 2 == 0, "consolidated into c_1").otherwise("toxic"))
    return joined.select(F.col("doc_id").cast("string").alias("id"), F.coalesce("is_deleted", F.lit(False)).alias("is_deleted"), at.alias("deleted_at"), why.alias("delete_reason"), F.coalesce("hit_count", F.lit(0)).alias("hit_count"), "last_accessed_at")


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subject, predicate, object, valid_from, valid_to (date texts), confidence, source_closet (a memory's id): order states of customers, and places."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    states = o.select(F.concat(F.lit("customer_"), "o_custkey").alias("subject"), F.lit("has_status").alias("predicate"), F.lower(F.concat(F.lit("status_"), "o_orderstatus")).alias("object"), day("o_orderdate").alias("valid_from"), day(F.lead("o_orderdate").over(w)).alias("valid_to"), (F.col("o_orderkey") % 100).cast("string").alias("source_closet"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    open_ = [F.lit(None).cast("string").alias(x) for x in ("valid_from", "valid_to", "source_closet")]
    place = F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))
    lives = c.select(F.concat(F.lit("customer_"), "c_custkey").alias("subject"), F.lit("located_in").alias("predicate"), place.alias("object"), *open_)
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # 5 regions
    part = n.select(place.alias("subject"), F.lit("part_of").alias("predicate"), F.concat(F.lit("region_"), F.replace(F.lower("r_name"), F.lit(" "), F.lit("_"))).alias("object"), *open_)
    return states.unionByName(lives).unionByName(part).withColumn("confidence", F.lit(1.0))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type of all subjects and objects; a name is its id with blanks and a capital."""
    t = triples(spark, sf_dir)
    names = t.select(F.col("subject").alias("id")).union(t.select(F.col("object").alias("id"))).distinct()
    kind = F.when(F.col("id").startswith("customer_"), "customer").when(F.col("id").startswith("status_"), "status").when(F.col("id").startswith("region_"), "region").otherwise("nation")
    name = F.concat(F.upper(F.substring("id", 1, 1)), F.replace(F.substring("id", 2, 99), F.lit("_"), F.lit(" ")))
    return names.select("id", name.alias("name"), kind.alias("type"))


_INDEXES: dict[tuple[str, str], str] = {}


def text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    """The inverted index of memories below the session's shared folder, built when it is first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = f"{shared_root(spark)}/index-{uuid4().hex[:12]}"
        build(memories(spark, sf_dir), path)
        _INDEXES[key] = path
    return TextIndex(spark, _INDEXES[key])


_VECTORS: dict[tuple[str, str], str] = {}


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The stored hypervectors of memories below the session's shared folder, written when they are first asked for."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _VECTORS:
        path = f"{shared_root(spark)}/vectors-{uuid4().hex[:12]}"
        VectorIndex(spark, path).append(memories(spark, sf_dir))
        _VECTORS[key] = path
    return VectorIndex(spark, _VECTORS[key])


#: The same tables as DuckDB common table expressions.
CTE = {
    "m": """m AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 10 < 8 THEN 'default' WHEN doc_id % 10 = 8 THEN 'system' ELSE 'other' END AS user_id, text,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS BIGINT)) AS created_at, CASE doc_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'episodic' ELSE 'working' END AS tier, source AS module, lang AS type FROM documents)""",
    "meta": """meta AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, coalesce(g.gone, false) AS is_deleted, CASE WHEN g.gone THEN TIMESTAMP '2024-01-23 08:53:20' + to_minutes(CAST(d.doc_id % 50 AS BIGINT)) END AS deleted_at,
  CASE WHEN g.gone THEN CASE WHEN d.doc_id % 2 = 0 THEN 'consolidated into c_1' ELSE 'toxic' END END AS delete_reason, coalesce(h.n, 0) AS hit_count, h.ts AS last_accessed_at FROM documents d
  LEFT JOIN (SELECT user_id, count(*) AS n, max(ts) AS ts FROM events GROUP BY 1) h ON h.user_id = d.doc_id LEFT JOIN (SELECT DISTINCT doc_id, true AS gone FROM labels WHERE toxic = 1) g ON g.doc_id = d.doc_id)""",
    "t": """t AS (SELECT 'customer_' || o_custkey AS subject, 'has_status' AS predicate, lower('status_' || o_orderstatus) AS object, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
  strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS valid_to, 1.0::DOUBLE AS confidence, CAST(o_orderkey % 100 AS VARCHAR) AS source_closet FROM orders
  UNION ALL SELECT 'customer_' || c_custkey, 'located_in', replace(lower(n_name), ' ', '_'), NULL, NULL, 1.0, NULL FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT replace(lower(n_name), ' ', '_'), 'part_of', 'region_' || replace(lower(r_name), ' ', '_'), NULL, NULL, 1.0, NULL FROM nation JOIN region ON n_regionkey = r_regionkey)""",
    "e": """e AS (SELECT id, upper(substr(id, 1, 1)) || replace(substr(id, 2), '_', ' ') AS name, CASE WHEN starts_with(id, 'customer_') THEN 'customer' WHEN starts_with(id, 'status_') THEN 'status' WHEN starts_with(id, 'region_') THEN 'region' ELSE 'nation' END AS type
  FROM (SELECT subject AS id FROM t UNION SELECT object FROM t))""",
    "ne": """ne AS (SELECT s.name AS subject, predicate, o.name AS object, valid_from, valid_to, confidence, valid_to IS NULL AS current, t.subject AS sid, t.object AS oid, source_closet FROM t JOIN e s ON s.id = t.subject JOIN e o ON o.id = t.object)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names)
