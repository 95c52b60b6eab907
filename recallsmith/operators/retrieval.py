"""Retrieval lanes, rank fusion and hybrid search.

A lane is a DataFrame (id, lane, score, rank). Lanes end in a top-k, which Spark runs as one bounded heap per task; so
fusion, dense scoring and decay only see a few hundred candidates. Filters go into every lane. A search takes its lanes once: their rows, at most
LANE_LIMIT or CANDIDATES each, are all that passes through the driver. Keyword scores come from an index in storage (index.py) where one is given.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallsmith.functions import scoring, text
from recallsmith.operators import graph, hdc
from recallsmith.operators.hamming import VectorIndex
from recallsmith.operators.index import TextIndex, postings  # noqa: F401

LANE_LIMIT, CANDIDATES, RRF_K = 200, 400, 60
FILTERS = ("workspace_root", "workspace_name", "room", "module", "type")


def scoped(memories: DataFrame, user: str | None = None, filters: dict[str, str] | None = None, deleted: DataFrame | None = None, with_system: bool = True) -> DataFrame:
    """Rows of a user (and of 'system'), with equal filter columns (unknown keys are ignored), without deleted ids."""
    if user is not None:
        memories = memories.where(F.col("user_id").isin(user, "system") if with_system else F.col("user_id") == user)
    for k, v in (filters or {}).items():
        if k in FILTERS and k in memories.columns:
            memories = memories.where(F.col(k) == v)
    return memories if deleted is None else memories.join(deleted.select("id"), "id", "left_anti")


def ranked(df: DataFrame, lane: str, limit: int, order: list[Column]) -> DataFrame:
    """The first `limit` rows in an order, numbered from 1; the window runs over those rows alone."""
    top = df.orderBy(*order).limit(limit)
    return top.select("id", F.lit(lane).alias("lane"), "score", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def bm25(memories: DataFrame, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of rows with a term of the query; higher is better.

    Terms are prefixes. Frequencies are counted in place, so no postings are shuffled: one scan gives the corpus numbers
    (a single row), another the scores.
    """
    terms = text.query_terms(query)
    if not terms:
        return memories.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    tf = memories.select("id", text.token_count(F.col("text")).alias("dl"), *(text.prefix_count(F.col("text"), t).alias(f"tf{i}") for i, t in enumerate(terms)))
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    any_ = reduce(lambda x, y: x | y, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    parts = []
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        parts.append(idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    return tf.where(any_).crossJoin(F.broadcast(stats)).select("id", F.round(reduce(lambda x, y: x + y, parts), 9).alias("score"))  # one row


def lane_fts(memories: DataFrame, query: str, limit: int = LANE_LIMIT, index: TextIndex | None = None) -> DataFrame:
    """The rows with the best keyword scores. With an index the scores are those of all rows it holds, no text is read, and blocks that can't be among the best are skipped."""
    scores = bm25(memories, query) if index is None else index.best(query, limit, memories)
    return ranked(scores, "fts", limit, [F.desc("score"), F.asc("id")])


def lane_like(memories: DataFrame, query: str, limit: int = LANE_LIMIT) -> DataFrame:
    """Fallback: rows that contain the query as a whole, with a constant score."""
    found = memories.where(F.contains(F.lower("text"), F.lit(query.lower()))).select("id", F.lit(1e6).alias("score"))
    return ranked(found, "like", limit, [F.asc("id")])


def lane_recency(memories: DataFrame, limit: int = LANE_LIMIT) -> DataFrame:
    """The newest rows; the score counts down from the limit."""
    top = memories.orderBy(F.desc("created_at"), F.asc("id")).limit(limit)
    rank = F.row_number().over(Window.orderBy(F.desc("created_at"), F.asc("id")))
    return top.select("id", F.lit("recency").alias("lane"), (F.lit(limit) - rank + 1).cast("double").alias("score"), rank.alias("rank"))


def lane_dense(candidates: DataFrame, embeddings: DataFrame, query_vector: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """Cosine of each candidate's embedding with the one query vector (a one-row frame `q`); 0 without an embedding."""
    rows = candidates.select("id").join(embeddings, "id", "left").crossJoin(F.broadcast(query_vector))
    return ranked(rows.select("id", F.round(F.coalesce(scoring.cosine(F.col("embedding"), F.col("q")), F.lit(0.0)), 9).alias("score")), "dense", limit, [F.desc("score"), F.asc("id")])


def candidate_union(lanes: list[DataFrame], limit: int = CANDIDATES) -> DataFrame:
    """Ids in order of first sight over the lanes, at most `limit`."""
    every = reduce(DataFrame.unionByName, (x.select("id", F.lit(i).alias("p"), "rank") for i, x in enumerate(lanes)))
    first = every.groupBy("id").agg(F.min(F.struct("p", "rank")).alias("at"))
    return first.orderBy("at.p", "at.rank").limit(limit).select("id")


def rrf(lanes: DataFrame, weights: dict[str, float], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: the sum over lanes of weight / (k + rank); lanes without a weight are dropped."""
    w = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))
    used = lanes.where(F.col("lane").isin(*[n for n, v in weights.items() if v]))
    return used.groupBy("id").agg(F.sum(w[F.col("lane")] / (k + F.col("rank"))).alias("score"))


def lane_kg(memories: DataFrame, triples: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Memories that the first edges of the query, taken as an entity's name, cite; a memory is ranked by each citation."""
    cited = graph.source_memories(triples, query, limit).join(memories.select("id"), "id")
    return cited.select("id", F.lit("kg").alias("lane"), F.lit(0.0).alias("score"), "rank")


def lane_vsa(memories: DataFrame, vectors: DataFrame | VectorIndex, query: str, limit: int = LANE_LIMIT) -> DataFrame:
    """Rows in order of the hypervector score of the query; vectors are those of hdc.index(), or stored ones."""
    scores = vectors.query(query, limit, memories) if isinstance(vectors, VectorIndex) else hdc.query(vectors.join(memories.select("id"), "id", "left_semi"), query)
    return ranked(scores, "vsa", limit, [F.desc("score"), F.asc("id")])


def taken(lanes: list[DataFrame]) -> DataFrame:
    """The rows of lanes, run once and held as a local table: each lane is a top-k, so they are some hundred."""
    spark = lanes[0].sparkSession
    rows = [tuple(r) for x in lanes for r in x.select("id", "lane", F.col("score").cast("double"), F.col("rank").cast("int")).collect()]
    return spark.createDataFrame(rows, "id string, lane string, score double, rank int")


def _among(memories: DataFrame, ids: list[str]) -> DataFrame:
    """The memories with some hundred ids, as a filter that reaches the scan."""
    return memories.where(F.col("id").isin(ids)) if ids else memories.limit(0)


def hybrid_lanes(rows: DataFrame, query: str, embeddings: DataFrame | None, query_vector: DataFrame | None, vectors: DataFrame | VectorIndex | None = None, index: TextIndex | None = None) -> DataFrame:
    """The keyword, hypervector and recency lanes, and the dense lane over their candidates; lanes without what they need are off."""
    first = [lane_fts(rows, query, index=index), *([lane_vsa(rows, vectors, query)] if vectors is not None else []), lane_recency(rows)]
    lanes = taken(first)
    if embeddings is None or query_vector is None:
        return lanes
    order = ["fts", "vsa", "recency"]
    union = candidate_union([lanes.where(F.col("lane") == x) for x in order])
    return taken([lanes, lane_dense(union, embeddings, query_vector)])


def search(memories: DataFrame, query: str, as_of: str, embeddings: DataFrame | None = None, query_vector: DataFrame | None = None, limit: int = 20, index: TextIndex | None = None, triples: DataFrame | None = None, **scope) -> DataFrame:
    """v1 hybrid search: keyword, dense, recency and graph lanes, fused, times the tier's decay; with triples each result has its relations."""
    rows = scoped(memories, **scope)
    lanes = hybrid_lanes(rows, query, embeddings, query_vector, index=index)
    if triples is not None:
        lanes = taken([lanes, lane_kg(rows, triples, query)])
    fused = rrf(lanes, {"fts": 1.0, "dense": 1.0, "recency": 0.5, "kg": 0.8})
    ids = [r[0] for r in lanes.select("id").distinct().collect()]
    out = _among(memories, ids).join(fused, "id").withColumn("score", F.round(F.col("score") * scoring.tier_decay(F.col("tier"), F.col("created_at"), as_of), 9))
    best = out.orderBy(F.desc("score"), F.asc("id")).limit(limit)
    if triples is None:
        return best.select("id", "tier", "score")
    return graph.attach_relations(best.select("id", "tier", "score", "text"), triples).select("id", "tier", "score", "relations")


def search_bundle(memories: DataFrame, query: str, as_of: str, embeddings: DataFrame | None = None, query_vector: DataFrame | None = None, vectors: DataFrame | VectorIndex | None = None, limit: int = 10, index: TextIndex | None = None, **scope) -> tuple[DataFrame, DataFrame]:
    """vNext search: (results with strength and trigger in order of strength, traces by lane), of four lanes.

    The governor gets the lanes' own scores: the cosine as similarity, and the hypervector score.
    """
    rows = scoped(memories, with_system=False, **scope)
    lanes = hybrid_lanes(rows, query, embeddings, query_vector, vectors, index)
    fused = rrf(lanes, {"fts": 1.0, "dense": 1.0, "vsa": 1.2, "recency": 0.5}).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.asc("id")).limit(limit)
    own = lambda lane: lanes.where(F.col("lane") == lane).select("id", F.col("score").alias(lane))
    best = fused.join(own("dense"), "id", "left").join(own("vsa"), "id", "left")
    out = _among(memories, [r[0] for r in fused.select("id").collect()]).join(best, "id")
    return annotate(out, as_of).select("id", "score", "strength", "trigger"), lane_trace(lanes)


def annotate(results: DataFrame, as_of: str) -> DataFrame:
    """Results (dense, vsa, created_at) with strength and trigger, strongest first."""
    zero = F.lit(0.0)
    hours = scoring.age_days(F.col("created_at"), as_of) * 24
    strength = F.round(scoring.strength(F.coalesce("dense", zero), F.coalesce("vsa", zero), hours, zero, zero, zero), 6)
    out = results.withColumn("strength", strength)
    return out.withColumn("trigger", scoring.trigger(F.col("strength"), zero, zero, zero)).orderBy(F.desc("strength"), F.asc("id"))


def lane_trace(lanes: DataFrame, top: int = 10) -> DataFrame:
    """(lane, considered, returned, top ids in order) of each lane."""
    firsts = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "id")))), lambda x: x["id"])
    return lanes.groupBy("lane").agg(F.count("*").alias("considered"), F.least(F.count("*"), F.lit(top)).alias("returned"), F.array_join(firsts, ",").alias("top_ids"))


def fetch(memories: DataFrame, ids: DataFrame | list[str], tier: str = "all") -> DataFrame:
    """The rows with given ids, and of a tier (a null tier is semantic); a listed few as a filter, a table of ids by a semi join."""
    rows = memories.where(F.col("id").isin(ids)) if isinstance(ids, list) else memories.join(ids.select("id"), "id", "left_semi")
    return rows if tier == "all" else rows.where(F.coalesce("tier", F.lit("semantic")) == tier)


def lane_tier(memories: DataFrame, query: str, tier: str, limit: int = 100) -> DataFrame:
    """Rows of a tier that contain the query as a whole, newest first."""
    rows = memories.where((F.coalesce("tier", F.lit("semantic")) == tier) & F.contains(F.lower("text"), F.lit(query.lower())))
    return _by_date(rows, tier, limit)


def lane_tokens(memories: DataFrame, query: str, limit: int = 100, most_tokens: int = 24) -> DataFrame:
    """Rows that contain any of the query's first content tokens, newest first; at least 50 are taken."""
    tokens = [t for t in dict.fromkeys(query_tokens(query))][:most_tokens]
    if not tokens:
        return _by_date(memories.limit(0), "token", limit)
    hit = reduce(lambda x, y: x | y, (F.contains(F.lower("text"), F.lit(t)) for t in tokens))
    return _by_date(memories.where(hit), "token", max(limit, 50))


def _by_date(rows: DataFrame, lane: str, limit: int) -> DataFrame:
    order = [F.desc("created_at"), F.asc("id")]
    top = rows.orderBy(*order).limit(limit)
    return top.select("id", F.lit(lane).alias("lane"), F.lit(0.0).alias("score"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def query_tokens(query: str) -> list[str]:
    """The content tokens of a query, in order."""
    import re

    return [t for t in re.findall(text.TOKEN, query.lower()) if len(t) > 1 and t not in text.STOPWORDS]


def overlap_search(memories: DataFrame, query: str, limit: int = 20, vectors: DataFrame | VectorIndex | None = None, working: DataFrame | None = None) -> DataFrame:
    """Multi-tier search: candidates of the hypervector index, the semantic, episodic and working tiers and the token scan, in order of the
    share of the query's content tokens that they have; equal ones in the order they were found."""
    lanes = [*([lane_vsa(memories, vectors, query, limit).withColumn("lane", F.lit("vsa"))] if vectors is not None else []), lane_tier(memories, query, "semantic", limit), lane_tier(memories, query, "episodic", limit)]
    if working is not None:
        lanes.append(_by_date(memories.join(working.select("id"), "id", "left_semi"), "working", limit))
    lanes.append(lane_tokens(memories, query, limit))
    held = taken(lanes)
    places = F.create_map(*(F.lit(x) for i, n in enumerate(("vsa", "semantic", "episodic", "working", "token")) for x in (n, i)))
    seen = held.groupBy("id").agg(F.min(F.struct(places[F.col("lane")].alias("p"), "rank")).alias("at"))
    wanted = sorted(set(query_tokens(query)))
    rows = _among(memories, [r[0] for r in held.select("id").distinct().collect()]).join(seen, "id")
    score = F.size(F.array_intersect(text.content_tokens(F.col("text")), F.array(*map(F.lit, wanted)))) / len(wanted) if wanted else F.lit(0.0)
    return rows.select("id", "tier", F.round(score, 9).alias("score"), "at").orderBy(F.desc("score"), "at.p", "at.rank", "id").drop("at")


def search_relation(memories: DataFrame, subject: str, object_: str) -> DataFrame:
    """Rows an entity of which is, or contains, the subject or the object."""
    found = text.extract_entities(F.col("text"))
    ends = [F.lit(x.lower()) for x in (subject, object_)]
    return memories.where(F.exists(found, lambda e: F.contains(e, ends[0]) | F.contains(e, ends[1])))


def confidence(results: DataFrame) -> DataFrame:
    """The reflector's confidence: average score, diversity of lower-cased beginnings and low variance; results (text, score)."""
    agg = results.agg(F.count("*").alias("n"), F.avg("score").alias("a"), F.var_pop("score").alias("v"), F.countDistinct(F.substring(F.lower("text"), 1, 20)).alias("d"))
    c = scoring.clamp(0.5 * F.col("a") + 0.3 * F.col("d") / F.col("n") + 0.2 * (1 - F.least(F.lit(1.0), F.col("v"))))
    return agg.select("n", F.round(F.when(F.col("n") > 0, c).otherwise(F.lit(0.0)), 6).alias("confidence"))


def reflected_search(results: DataFrame, concepts: DataFrame | None = None, limit: int = 10, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """(report, results): the best `limit` of results (id, text, score), which a search for twice as many gave, with their confidence; below `least`
    they are expanded by related concepts, if there are any."""
    best = results.orderBy(F.desc("score"), "id").limit(limit)
    report = confidence(best).withColumn("strategy", F.when(F.col("confidence") < least, "self_healed").otherwise("standard"))
    out = best.select("id", "text", F.col("score").cast("double").alias("score"), F.lit("found").alias("origin"))
    if concepts is not None:
        weak = report.where("strategy = 'self_healed'").select("strategy")
        more = hdc.expand(best, concepts).crossJoin(F.broadcast(weak)).drop("strategy")  # one row, or none where the results are sure
        out = out.unionByName(more)
    return report, out


#: What a tool's action is about, in words that a memory of such work is likely to have.
INTENT_PHRASES = {
    "project set_state": "where the project stands and its next milestone",
    "project set_goals": "goals and aims of the project",
    "project summary": "state and overview of the project",
    "session begin": "what to know before work begins",
    "session resume": "what was done in the last session",
    "configure enforcement": "rules that goals put on changes",
    "configure autonomy": "tasks that run by themselves",
    "cognitive dream": "patterns and ideas across memories",
    "cognitive align": "whether code follows the goals",
    "cognitive forget": "old memories that may go",
    "kg add_causal": "what causes or depends on what",
    "remember ingest_commit": "changes of code in commits",
    "remember ingest_test_failure": "failing tests and their errors",
}


def intent_phrase(calls: DataFrame, most: int = 400) -> DataFrame:
    """(call_id, phrase) of tool calls (call_id, tool, action, arguments map): what the action is about, and its arguments of over three characters."""
    phrases = F.create_map(*(F.lit(x) for kv in INTENT_PHRASES.items() for x in kv))
    about = F.element_at(phrases, F.concat_ws(" ", "tool", "action"))
    told = F.filter(F.map_entries("arguments"), lambda e: ~e["key"].isin("workspace_root", "action") & (F.length(e["value"]) > 3))
    parts = F.concat(F.filter(F.array(about), lambda x: x.isNotNull()), F.transform(F.array_sort(told), lambda e: e["value"]))
    return calls.select("call_id", F.substring(F.array_join(parts, " "), 1, most).alias("phrase"))


def proactive_context(results: DataFrame, texts: DataFrame, chars: int = 200) -> DataFrame:
    """One row of text: the results (id, score) of a search for a call's phrase, best first, sanitised and cut to `chars` characters each."""
    j = results.join(texts.select("id", "text"), "id").select("score", "id", F.concat(F.lit("• "), F.substring(text.sanitize(F.col("text")), 1, chars)).alias("line"))
    return j.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "id", "line"))), lambda x: x["line"]), "\n").alias("context"), F.count("*").alias("n"))


def deleted(memories: DataFrame, meta: DataFrame, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """A page of deleted memories with the reason, those deleted last first; the limit is clamped."""
    gone = memories.join(meta.where("is_deleted").select("id", "deleted_at", "delete_reason"), "id")
    return gone.orderBy(F.desc("deleted_at"), "id").offset(max(offset, 0)).limit(min(max(limit, 0), most)).select("id", "text", "deleted_at", "delete_reason")
