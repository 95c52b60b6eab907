"""More registered queries: row access, sinks, extraction, graph changes, sessions, caches and notifications."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from recallsmith.functions import scoring, text
from recallsmith.operators import attention, consolidation, graph, graph_lane, hdc, many_rules, retrieval, rules, sessions
from recallsmith.operators.partials import Partials
from recallsmith.plans import sql_surface
from recallsmith.plans.adapters import AS_OF, ctes, entities, memories, meta, shared_root, table, triples
from recallsmith.plans.registry import _DECAY, _ENTITIES, _FTS, _HEALTH, _RECENT, _WORDS, TERMS, _bm25, _consolidations, _events, _extractions, _redacted, _vectors, query
from recallsmith.sources import readers
from recallsmith.streaming import consumer, state
from recallsmith.streaming import events as streams

# --- row access ---------------------------------------------------------------------------------------------------


@query(f"{ctes('m')} SELECT id, tier FROM m WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 0) AND tier = 'episodic'")
def fetch_by_ids(spark, d):
    wanted = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("id"))
    return retrieval.fetch(memories(spark, d), wanted, "episodic").select("id", "tier")


@query(f"{ctes('m')} SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM m WHERE tier = 'episodic' AND contains(lower(text), 'thing')) WHERE rank <= 100")
def tier_scan(spark, d):
    return retrieval.lane_tier(memories(spark, d), "Thing", "episodic").select("id", "rank")


@query(f"{ctes('m')} SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM m WHERE contains(lower(text), 'thing') OR contains(lower(text), 'zu')) WHERE rank <= 50")
def token_scan(spark, d):
    return retrieval.lane_tokens(memories(spark, d), "Is the thing zu", 20).select("id", "rank")


@query(f"{ctes('m', 'meta')} SELECT m.id, text, deleted_at, delete_reason FROM m JOIN meta USING (id) WHERE is_deleted ORDER BY deleted_at DESC, m.id LIMIT 200 OFFSET 3")
def deleted_page(spark, d):
    return retrieval.deleted(memories(spark, d), meta(spark, d), 500, 3).withColumn("deleted_at", F.col("deleted_at").cast("timestamp_ntz"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, len(list_distinct(x)) AS entities FROM (SELECT doc_id, (list_filter(y, lambda v, i: list_position(y, v) = i)[1:32]) AS x FROM (SELECT doc_id, {_ENTITIES} AS y FROM documents))")
def vsa_load(spark, d):
    """Stored entities with the vectors that some of them have; the others are encoded anew, and all have 1024 words then."""
    m = memories(spark, d)
    named = m.select("id", text.extract_entities(F.col("text")).alias("entities"))
    path = f"{shared_root(spark)}/stored-{uuid4().hex[:12]}"
    hdc.index(m.where("CAST(id AS BIGINT) % 2 = 0")).select("id", "hv").write.parquet(path)
    stored = spark.read.schema("id string, hv array<bigint>").parquet(path)
    return hdc.load(named, stored, m).where(F.size("hv") == hdc.WORDS).select("id", F.size("entities").alias("entities"))


@query(f"{ctes('m', 'meta')} SELECT m.id FROM m WHERE user_id = 'default' AND created_at < TIMESTAMP '2024-01-31 23:00:00' AND id NOT IN (SELECT id FROM meta WHERE is_deleted) AND CAST(id AS BIGINT) IN (SELECT vec_id FROM embeddings) AND id IN (SELECT id FROM m WHERE user_id = 'default' AND id NOT IN (SELECT id FROM meta WHERE is_deleted) ORDER BY created_at, id LIMIT 200)")
def consolidation_candidates(spark, d):
    return consolidation.candidates(memories(spark, d), _vectors(spark, d), meta(spark, d), AS_OF).select("id")


@query(f"{ctes('m', 'meta')} SELECT m.id FROM m WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AND id NOT IN (SELECT id FROM meta WHERE is_deleted) ORDER BY created_at DESC, m.id LIMIT 50")
def unprocessed_memories(spark, d):
    return graph.unprocessed(memories(spark, d), _extractions(spark, d), meta(spark, d)).select("id")


@query(f"{ctes('m')} SELECT id FROM m WHERE CAST(id AS BIGINT) NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 3 = 0) ORDER BY created_at DESC, id LIMIT 1000")
def unembedded_memories(spark, d):
    return readers.unembedded(memories(spark, d), _vectors(spark, d).where("CAST(id AS BIGINT) % 3 = 0")).select("id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_ENTITIES} AS y FROM documents) WHERE len(list_filter(y[1:999999], lambda e: contains(e, 'thing') OR contains(e, 'ertion'))) > 0 AND len(list_filter((list_filter(y, lambda v, i: list_position(y, v) = i)[1:32]), lambda e: contains(e, 'thing') OR contains(e, 'ertion'))) > 0")
def relation_search(spark, d):
    return retrieval.search_relation(table(spark, d, "documents").select("doc_id", "text"), "Thing", "ertion").select("doc_id")


# --- sinks --------------------------------------------------------------------------------------------------------


@query(f"""SELECT 'm_' || substr(sha256('default|' || t || '|2024-02-01 00:00:00'), 1, 12) AS id, 'default' AS user_id, t AS text, CASE WHEN turn % 3 = 0 THEN 'episodic' ELSE 'semantic' END AS tier,
  CASE WHEN turn % 3 = 0 THEN '{{"memory_tier":"episodic","workspace_name":"w","workspace_root":"/p/w"}}' ELSE '{{"workspace_name":"own","workspace_root":"/p/w"}}' END AS metadata FROM (SELECT turn, {_redacted('text')} AS t FROM conversations)""")
def insert_memories(spark, d):
    given = F.when(F.col("turn") % 3 == 0, F.create_map(F.lit("memory_tier"), F.lit("episodic"))).otherwise(F.create_map(F.lit("workspace_name"), F.lit("own")))
    rows = table(spark, d, "conversations").select("text", given.alias("metadata"))
    return readers.new_memories(rows, scoring.instant(AS_OF), "/p/w/").select("id", "user_id", "text", "tier", "metadata")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 4 = 0 THEN 'second' WHEN doc_id % 2 = 0 THEN 'first' ELSE text END AS text FROM documents")
def tier_replace(spark, d):
    m = memories(spark, d).select("id", "text", "created_at")
    even = m.where("CAST(id AS BIGINT) % 2 = 0").withColumn("text", F.lit("first"))
    again = m.where("CAST(id AS BIGINT) % 4 = 0").select("id", F.lit("second").alias("text"), F.expr("created_at + INTERVAL 1 DAY").alias("created_at"))
    return readers.replace_memories(m, even.unionByName(again)).select("id", "text")


@query("SELECT 'r' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'block' ELSE 'warn' END AS severity FROM part WHERE p_partkey % 7 <> 0")
def rules_upsert_remove(spark, d):
    p = table(spark, d, "part").select(F.concat(F.lit("r"), "p_partkey").alias("id"), "p_partkey")
    old = p.select("id", F.lit("warn").alias("severity"))
    third = p.where("p_partkey % 3 = 0")
    new = third.select("id", F.lit("info").alias("severity"), F.lit(1).alias("seq")).unionByName(third.select("id", F.lit("block").alias("severity"), F.lit(2).alias("seq")))
    return rules.remove_rules(rules.upsert_rules(old, new), p.where("p_partkey % 7 = 0"))


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def hard_delete(spark, d):
    gone = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return readers.hard_delete(table(spark, d, "embeddings"), gone, "vec_id").select("vec_id")


# --- text ---------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, len(s) AS n, coalesce(array_to_string(s, '|'), '') AS s FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 10) AS s FROM documents)")
def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(s).alias("n"), F.coalesce(F.array_join(s, "|"), F.lit("")).alias("s"))


_START, _END = "<!-- goals:start -->", "<!-- goals:end -->"


@query(f"SELECT page_id, page_id % 2 = 0 AS level1, page_id % 3 = 0 AS level2, false AS level3 FROM pages")
def markdown_flags(spark, d):
    """A block is put into each page (in the place of one that some have), and read back."""
    yes = lambda n: F.when(F.col("page_id") % n == 0, "true").otherwise("false")
    old = F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(f"\n{_START}\n- level3: true\n{_END}\ntail"))).when(F.col("page_id") % 5 == 1, "").otherwise(F.col("html"))
    body = F.concat(F.lit("- level1: "), yes(2), F.lit("\n- Level2 : "), yes(3))
    done = text.upsert_block(old, body, _START, _END, "Rules")
    return table(spark, d, "pages").select("page_id", text.block_flags(done, ["level1", "level2", "level3"], _START, _END).alias("f")).select("page_id", "f.*")


_CALLS = "SELECT conv_id * 100 + turn AS call_id, CASE turn % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'cognitive' ELSE 'other' END AS tool, CASE turn % 3 WHEN 0 THEN 'set_goals' WHEN 1 THEN 'dream' ELSE 'x' END AS action, text FROM conversations"


@query(f"SELECT call_id, substr(CASE tool WHEN 'project' THEN 'goals and aims of the project ' WHEN 'cognitive' THEN 'patterns and ideas across memories ' ELSE '' END || text, 1, 400) AS phrase FROM ({_CALLS}) WHERE length(text) > 3")
def intent_phrases(spark, d):
    k = F.col("turn") % 3
    calls = table(spark, d, "conversations").where(F.length("text") > 3).select((F.col("conv_id") * 100 + F.col("turn")).alias("call_id"), F.when(k == 0, "project").when(k == 1, "cognitive").otherwise("other").alias("tool"), F.when(k == 0, "set_goals").when(k == 1, "dream").otherwise("x").alias("action"), F.create_map(F.lit("query"), F.col("text"), F.lit("workspace_root"), F.lit("/p/long"), F.lit("id"), F.lit("abc")).alias("arguments"))
    return retrieval.intent_phrase(calls)


@query(f"{ctes('m')} SELECT string_agg('• ' || substr(text, 1, 200), chr(10) ORDER BY created_at DESC, id) AS context, count(*) AS n FROM (SELECT * FROM m ORDER BY created_at DESC, id LIMIT 3)")
def proactive_context(spark, d):
    m = memories(spark, d)
    return retrieval.proactive_context(retrieval.lane_recency(m, 3).select("id", "score"), m)


# --- graph --------------------------------------------------------------------------------------------------------

_BRIDGES = "b AS (SELECT 'Room ' || r_regionkey AS a, 'Room ' || ((r_regionkey + 1) % 5) AS z, r_regionkey / 10.0 AS score FROM region)"


@query(f"WITH {_BRIDGES} SELECT 'edge' AS kind, replace(lower(a), ' ', '_') AS x, replace(lower(z), ' ', '_') AS y, CAST(score AS DOUBLE) AS score FROM b UNION ALL SELECT DISTINCT 'room', replace(lower(a), ' ', '_'), a, NULL FROM b")
def kg_bridges(spark, d):
    r = table(spark, d, "region")
    new = r.select(F.concat(F.lit("Room "), "r_regionkey").alias("room_a"), F.concat(F.lit("Room "), (F.col("r_regionkey") + 1) % 5).alias("room_b"), (F.col("r_regionkey") / 10.0).cast("double").alias("score"), F.lit("near").alias("reason"))
    t, e = graph.add_bridges(triples(spark, d), entities(spark, d), new.unionByName(new))
    edges = t.where("predicate = 'semantically_bridges'").select(F.lit("edge").alias("kind"), F.col("subject").alias("x"), F.col("object").alias("y"), F.col("confidence").alias("score"))
    return edges.unionByName(e.where("type = 'room'").select(F.lit("room").alias("kind"), F.col("id").alias("x"), F.col("name").alias("y"), F.lit(None).cast("double").alias("score")))


@query(f"{ctes('t', 'e', 'ne')} SELECT subject AS source, predicate AS relationship, object AS target FROM ne WHERE current AND (sid = 'france' OR oid = 'france') ORDER BY 1, 2, 3 LIMIT 100")
def kg_edges_search(spark, d):
    return graph.edges(triples(spark, d), entities(spark, d), "France")


@query(f"{ctes('t', 'e', 'ne')} SELECT source, relationship, target FROM (SELECT subject AS source, predicate AS relationship, object AS target, current FROM ne ORDER BY valid_from NULLS LAST, subject, predicate, object, valid_to NULLS LAST LIMIT 100) WHERE current")
def kg_edges_all(spark, d):
    return graph.edges(triples(spark, d), entities(spark, d))


@query(f"""{ctes('t', 'e', 'ne')}, f AS (SELECT sid, oid, subject || ' ' || predicate || ' ' || object AS label, row_number() OVER (ORDER BY subject) AS n FROM ne WHERE predicate = 'part_of'),
  c AS (SELECT a.sid AS old_s, a.label AS was, z.sid AS new_s, z.label AS now FROM f a JOIN f z ON z.n = a.n + 1 WHERE a.n % 2 = 1)
  SELECT 'closed' AS kind, old_s AS subject, 'part_of' AS predicate, '2024-02-01' AS told FROM c UNION ALL SELECT 'meta', 'f_' || old_s, 'evolved_into', was || ' → ' || now || '; moved' FROM c""")
def kg_evolve_fact(spark, d):
    from pyspark.sql import Window

    e = entities(spark, d)
    facts = triples(spark, d).where("predicate = 'part_of'").withColumn("id", F.concat(F.lit("f_"), "subject"))
    named = facts.join(graph.names(e, "subject"), "subject").select("id", F.row_number().over(Window.orderBy("subject_name")).alias("n"))  # 25 nations
    changes = named.where("n % 2 = 1").select(F.col("id").alias("old_id"), (F.col("n") + 1).alias("n")).join(named.select(F.col("id").alias("new_id"), "n"), "n").select("old_id", "new_id", F.lit("moved").alias("reason"))
    t, _ = graph.evolve(facts, e, changes, "2024-02-01")
    closed = t.where("valid_to = '2024-02-01'").select(F.lit("closed").alias("kind"), "subject", "predicate", F.col("valid_to").alias("told"))
    return closed.unionByName(t.where("predicate = 'evolved_into'").select(F.lit("meta").alias("kind"), "subject", "predicate", F.col("source_file").alias("told")))


@query("""SELECT CASE WHEN b.p IS NULL THEN a.p ELSE 'workspace' END AS subject, CASE WHEN b.p IS NULL THEN 'depends_on' ELSE 'missing_dep' END AS predicate, CASE WHEN b.p IS NULL THEN 'workspace' ELSE b.p END AS object
  FROM (SELECT DISTINCT p_name AS p FROM part WHERE p_size > 20) a FULL JOIN (SELECT DISTINCT p_name AS p FROM part WHERE p_size < 30) b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL""")
def kg_audit_edges(spark, d):
    p = table(spark, d, "part")
    found = rules.audit(p.where("p_size > 20").select(F.col("p_name").alias("package")), p.where("p_size < 30").select(F.col("p_name").alias("package")))
    return graph.audit_edges(found).select("subject", "predicate", "object")


_FOUND = f"x AS (SELECT id, (list_filter(y, lambda v, i: list_position(y, v) = i)[1:4]) AS x FROM (SELECT id, text, {_ENTITIES} AS y FROM u))"


@query(f"""{ctes('m', 'meta')}, u AS (SELECT * FROM m WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AND id NOT IN (SELECT id FROM meta WHERE is_deleted) ORDER BY created_at DESC, id LIMIT 50), {_FOUND}
  SELECT id AS memory_id, sha256(text) AS memory_text_hash, CAST(len(x) AS BIGINT) AS entities_found, CAST(greatest(len(x) - 1, 0) AS BIGINT) AS triples_found, CAST(NULL AS VARCHAR) AS extraction_error FROM x JOIN m USING (id)""")
def kg_extraction_cycle(spark, d):
    out = graph.extract(memories(spark, d), _extractions(spark, d), meta(spark, d), AS_OF)
    return out["log"].drop("extracted_at")


@query(f"""{ctes('m', 'meta')}, u AS (SELECT * FROM m WHERE id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels) AND id NOT IN (SELECT id FROM meta WHERE is_deleted) ORDER BY created_at DESC, id LIMIT 50), {_FOUND}
  SELECT id AS source_closet, p[1] AS subject, 'near' AS predicate, p[2] AS object FROM (SELECT id, unnest(list_transform(generate_series(1, len(x) - 1), lambda i: [x[i], x[i + 1]])) AS p FROM x)""")
def kg_extracted_edges(spark, d):
    return graph.extract(memories(spark, d), _extractions(spark, d), meta(spark, d), AS_OF)["triples"].select("source_closet", "subject", "predicate", "object")


def _commits(spark, d):
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat(F.lit("f"), F.col("l_partkey").cast("string"), F.lit(".py")))).alias("files"))
    return o.select(F.concat(F.lit("c"), "l_orderkey").alias("sha"), F.lit("change").alias("message"), F.lit("dev").alias("author"), F.lit("2024-01-01").alias("date"), "files", F.lit("").alias("stat"))


_FILES = "c AS (SELECT 'c' || l_orderkey AS sha, list_sort(list_distinct(list('f' || l_partkey || '.py'))) AS files FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_FILES} SELECT unnest(files[1:5]) AS subject, 'introduced_by' AS predicate, 'commit:' || sha AS object FROM c")
def kg_commit_edges(spark, d):
    return graph.commit_edges(_commits(spark, d)).select("subject", "predicate", "object")


@query(f"WITH {_FILES} SELECT 'commit_' || sha AS id, '[git-commit:' || sha || '] change' || chr(10) || 'Author: dev | Date: 2024-01-01' || chr(10) || 'Files changed: ' || array_to_string(files[1:10], ', ') || CASE WHEN len(files) > 10 THEN ' (+' || (len(files) - 10) || ' more)' ELSE '' END || chr(10) || 'Stat: n/a' AS text, 'semantic' AS tier FROM c")
def commit_memories(spark, d):
    return graph.commit_memories(_commits(spark, d))


@query("""SELECT n_name AS subject, predicate, object, valid_from FROM (SELECT lower(replace(n_name, ' ', '_')) AS n_name, n_nationkey, unnest([['child_of', lower(replace(r_name, ' ', '_'))], ['loves', 'tea']]) AS p, p[1] AS predicate, p[2] AS object, CASE WHEN p[1] = 'loves' THEN '2025-01-01' ELSE '2000-01-01' END AS valid_from FROM nation JOIN region ON n_regionkey = r_regionkey)
  UNION ALL SELECT lower(replace(n_name, ' ', '_')), 'is_pet_of', lower(replace(r_name, ' ', '_')), NULL FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0""")
def kg_seed_facts(spark, d):
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    none = F.lit(None).cast("string")
    facts = j.select(F.col("n_name").alias("key"), none.alias("full_name"), none.alias("type"), F.lit("2000-01-01").alias("birthday"), F.col("r_name").alias("parent"), none.alias("partner"), F.when(F.col("n_nationkey") % 4 == 0, "dog").alias("relationship"), none.alias("sibling"), F.col("r_name").alias("owner"), F.array(F.lit("tea")).alias("interests"))
    return graph.seed_facts(facts)[0].select("subject", "predicate", "object", "valid_from")


# --- manifests, imports -------------------------------------------------------------------------------------------


@query("SELECT p_brand AS brand, 'p' || lower(replace(p_brand, '#', '')) AS package FROM part GROUP BY ALL UNION ALL SELECT p_brand, 'dev' FROM part GROUP BY ALL")
def manifest_parse(spark, d):
    name = F.concat(F.lit("p"), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))))
    content = F.concat(F.lit('{"dependencies": {"'), name, F.lit('": "^1.0"}, "devDependencies": {"dev": "2"}}'))
    return table(spark, d, "part").select("p_brand").distinct().select(F.col("p_brand").alias("brand"), F.explode(rules.manifest_packages("package.json", content)).alias("package"))


@query("SELECT CASE WHEN p_size % 2 = 0 THEN 'pyyaml' ELSE 'pkg' || p_size END AS package, string_agg('f' || p_partkey || '.py', ',' ORDER BY 'f' || p_partkey || '.py') AS files FROM part GROUP BY 1")
def import_index(spark, d):
    """Sources with absolute, relative, nested and standard imports, a project's own and one under another name; some can't be parsed."""
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_size") % 2 == 0, "import os, yaml.nodes as y").otherwise(F.concat(F.lit("from pkg"), size, F.lit(".sub import x")))
    content = F.concat(F.lit("from . import local\nfrom .near import z\nimport mine\ndef f():\n    "), line, F.lit("\n    return 'import nothing'\n"))
    files = table(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey", F.lit(".py")).alias("path"), content.alias("content"))
    broken = files.limit(5).select(F.concat(F.lit("broken"), "path").alias("path"), F.lit("import lost\ndef (").alias("content"))
    found = rules.used_packages(rules.imports(files.unionByName(broken)), "mine")
    return rules.import_index(found).select("package", F.array_join("files", ",").alias("files"))


# --- sessions -----------------------------------------------------------------------------------------------------


def _calls(spark, d):
    return _events(spark, d).withColumn("tool_name", F.col("event_type")).withColumn("active_context", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("f"), F.col("event_id") % 4)))


@query("""WITH r AS (SELECT user_id AS session_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), tl AS (SELECT session_id, lower(string_agg(event_type, ' ')) AS tools FROM r WHERE r <= 20 GROUP BY 1)
  SELECT session_id, CAST(contains(tools, 'click') AS INTEGER) + CAST(contains(tools, 'purchase') OR contains(tools, 'signup') AS INTEGER) AS addressed, 2 AS total FROM tl""")
def session_progress(spark, d):
    goals = spark.createDataFrame([("make them click",), ("more purchase or signup",)], "goal string")
    return sessions.progress(goals, _calls(spark, d))


_SNAP = """r AS (SELECT user_id AS session_id, event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'f' || (event_id % 4) END AS context, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events),
  sn AS (SELECT session_id, list(event_type ORDER BY r DESC) FILTER (r <= 25) AS tools, list(event_type ORDER BY r DESC) FILTER (r <= 5) AS last5, list(event_type ORDER BY r DESC) FILTER (r <= 15) AS last15, list(context ORDER BY r DESC) FILTER (r <= 25 AND context IS NOT NULL) AS ctx FROM r GROUP BY 1)"""


@query(f"WITH {_SNAP} SELECT session_id, 'Recent activity: ' || array_to_string(last5, ', ') AS summary, coalesce(array_to_string(list_filter(ctx, lambda v, i: list_position(ctx, v) = i), ','), '') AS active_contexts, len(tools) AS n_tools, 'a goal,b goal' AS goals, CASE WHEN session_id % 3 = 0 THEN 'k: note' ELSE '' END AS l1 FROM sn")
def session_snapshot(spark, d):
    s = _snapshots(spark, d)
    return s.select("session_id", "summary", F.array_join("active_contexts", ",").alias("active_contexts"), F.size("tools").alias("n_tools"), F.array_join("goals", ",").alias("goals"), F.array_join("l1", ",").alias("l1"))


def _snapshots(spark, d):
    calls = _calls(spark, d)
    goals = spark.createDataFrame([("b goal",), ("a goal",)], "goal string")
    notes = calls.select("session_id").distinct().where("session_id % 3 = 0").select("session_id", F.lit("k").alias("id"), F.lit("note").alias("content"))
    return sessions.snapshot(calls, goals, notes)


_LIST = "array_to_string(list_transform({0}, lambda x: '- ' || x), chr(10))"


@query(f"""WITH {_SNAP}, c AS (SELECT *, list_filter(ctx, lambda v, i: list_position(ctx, v) = i) AS files FROM sn)
  SELECT session_id, concat_ws(chr(10), 'SESSION HANDOFF', 'Session: ' || session_id, '', 'WHAT I WAS DOING', 'Recent activity: ' || array_to_string(last5, ', '), '', 'ACTIVE GOALS', '- a goal', '- b goal', '', 'WORKING MEMORY (L1)', CASE WHEN session_id % 3 = 0 THEN '- k: note' ELSE '(empty)' END, '',
  'FILES / ACTIVE CONTEXTS', CASE WHEN len(files) > 0 THEN {_LIST.format('files')} ELSE '(none)' END, '', 'RECENT TOOL CALLS', array_to_string(list_transform(last15, lambda x, i: i || '. ' || x), chr(10))) AS prompt FROM c""")
def session_handoff(spark, d):
    return sessions.handoff(_snapshots(spark, d))


def _sessions(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.concat(F.lit("s"), "c_custkey").alias("id"), F.concat(F.lit("w"), F.col("c_nationkey")).alias("workspace_root"), F.when(F.col("c_custkey") % 4 > 0, F.concat(F.lit("s"), F.col("c_custkey") - 1)).alias("parent_session_id"), F.when(F.col("c_custkey") % 5 == 0, "active").otherwise("closed").alias("status"), F.lit("2024-01-01").alias("started_at"), F.when(F.col("c_custkey") % 5 != 0, F.lit("2024-01-02")).alias("ended_at"))


@query("""SELECT CASE WHEN c_custkey % 5 = 0 AND c_nationkey <> 3 THEN 'active' ELSE 'closed' END AS status, CAST(NULL AS VARCHAR) AS parent, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT 'active', 's1', 1""")
def session_child(spark, d):
    """A session resumed in one workspace: its active ones are closed and a child begins."""
    s = sessions.begin(_sessions(spark, d).withColumn("parent_session_id", F.lit(None).cast("string")), "w3", "2024-02-01", "s1")
    return s.groupBy("status", F.col("parent_session_id").alias("parent")).agg(F.count("*").alias("n"))


@query("SELECT 's' || c_custkey AS id, 's' || (c_custkey - k) AS ancestor, CAST(k AS INTEGER) AS depth FROM customer, generate_series(1, 3) g(k) WHERE k <= c_custkey % 4")
def session_ancestors(spark, d):
    return sessions.ancestors(_sessions(spark, d))


@query("SELECT string_agg(line, chr(10) ORDER BY k, line) AS summary FROM (SELECT 'k' || r_regionkey AS k, '  k' || r_regionkey || CASE r_regionkey % 4 WHEN 0 THEN ': [open] ' || r_name WHEN 1 THEN ': ' || r_name WHEN 2 THEN ': {\"x\":1}' ELSE ': ' || r_name END AS line FROM region)")
def project_state_summary(spark, d):
    k = F.col("r_regionkey") % 4
    value = F.when(k == 0, F.concat(F.lit('[{"status":"open","title":"'), "r_name", F.lit('"}]'))).when(k == 1, F.concat(F.lit('["'), "r_name", F.lit('"]'))).when(k == 2, '{"x":1}').otherwise(F.concat(F.lit('"'), "r_name", F.lit('"')))
    return sessions.project_summary(table(spark, d, "region").select(F.concat(F.lit("k"), "r_regionkey").alias("key"), value.alias("value")))


# --- caches, notifications, periodic jobs -------------------------------------------------------------------------

_TTL = 43_200
_REPLAY = f"""rq AS (SELECT event_type || user_id % 50 AS key, ts, event_id FROM events), mi AS (SELECT key, min(ts) AS ts FROM rq GROUP BY 1 UNION ALL SELECT key, (SELECT min(rq.ts) FROM rq WHERE rq.key = mi.key AND rq.ts >= mi.ts + INTERVAL {_TTL} SECOND) FROM mi WHERE ts IS NOT NULL), ms AS (SELECT * FROM mi WHERE ts IS NOT NULL)"""


def _replayed(spark, d):
    e = table(spark, d, "events").select(F.concat("event_type", (F.col("user_id") % 50).cast("string")).alias("key"), "ts", F.col("event_id").alias("seq"))
    return attention.cache_replay(e, _TTL)


@query(f"WITH RECURSIVE {_REPLAY} SELECT key, count(*) AS misses FROM ms GROUP BY 1")
def cache_misses(spark, d):
    return _replayed(spark, d).where("NOT hit").groupBy("key").agg(F.count("*").alias("misses"))


@query(f"""WITH RECURSIVE {_REPLAY}, en AS (SELECT key, max(ts) AS cached FROM ms GROUP BY 1 ORDER BY cached DESC, key LIMIT 100), f AS (SELECT count(*) AS total_entries, count(*) FILTER (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(cached) < {_TTL}::BIGINT * 1000000) AS active_entries FROM en)
  SELECT total_entries, active_entries, total_entries - active_entries AS stale_entries, (SELECT count(*) FROM events) - (SELECT count(*) FROM ms) AS hits, (SELECT count(*) FROM ms) AS misses, round(1 - (SELECT count(*) FROM ms) / (SELECT count(*) FROM events)::DOUBLE, 3) AS hit_rate FROM f""")
def cache_stats(spark, d):
    return attention.cache_stats(_replayed(spark, d), F.to_timestamp(F.lit("2024-01-31")), _TTL)


def _notes(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("topic"), ((F.col("event_id") % 10) / 10).alias("confidence"), "ts")


_QUEUE = "q AS (SELECT event_id AS id, event_type AS topic, ts FROM events WHERE event_type IN ('click', 'error', 'purchase') AND event_id % 10 >= 7 ORDER BY ts DESC, event_id DESC LIMIT 50)"


@query(f"WITH {_QUEUE}, mx AS (SELECT max(ts) AS ts FROM events) SELECT id, topic FROM q, mx WHERE epoch_us(mx.ts) - epoch_us(q.ts) < 86400::BIGINT * 1000000 AND id % 4 <> 0")
def notifications_live(spark, d):
    queued = attention.pending(_notes(spark, d), ["click", "error", "purchase"], 0.7)
    newest = table(spark, d, "events").agg(F.max("ts")).first()[0]
    gone = table(spark, d, "events").where("event_id % 4 = 0").select(F.col("event_id").alias("id"))
    return attention.live_notifications(queued, gone, F.lit(newest).cast("timestamp"), 86_400).select("id", "topic")


@query(f"WITH {_QUEUE} SELECT (SELECT count(*) FROM q) AS pending, (SELECT count(*) FROM events WHERE event_id % 4 = 0) AS dismissed")
def notification_stats(spark, d):
    queued = attention.pending(_notes(spark, d), ["click", "error", "purchase"], 0.7)
    return attention.notification_stats(queued, table(spark, d, "events").where("event_id % 4 = 0").select(F.col("event_id").alias("id")))


_SCORED = f"{ctes('m')}, x AS (SELECT id, text, round(exp(-CASE tier WHEN 'episodic' THEN 0.02 WHEN 'working' THEN 0.05 ELSE 0.005 END * greatest(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(created_at), 0) / 86400000000.0), 6) AS score FROM m)"


def _scored(spark, d):
    return memories(spark, d).select("id", "text", F.round(scoring.tier_decay(F.col("tier"), F.col("created_at"), AS_OF), 6).alias("score"))


@query(f"{_SCORED} SELECT id, 'relevance_alert' AS topic, 'Highly relevant memory found (score: ' || printf('%.2f', score) || ')' AS title, substr(text, 1, 200) AS body, score AS confidence FROM x WHERE score > 0.8 ORDER BY score DESC, id LIMIT 1")
def relevance_alert(spark, d):
    return attention.relevance_alert(_scored(spark, d))


@query(f"{_SCORED} SELECT id, substr(text, 1, 100) AS preview, score FROM x WHERE score < 0.25 AND text <> ''")
def anomalous_memories(spark, d):
    return attention.anomalies(_scored(spark, d), 0.25)


@query("SELECT c AS cycle, job FROM generate_series(1, 210) g(c), (VALUES ('goal_drift', 3), ('dream', 5), ('health_report', 7), ('tasks', 10)) j(job, n) WHERE c % n = 0")
def periodic_jobs(spark, d):
    return attention.due(spark.range(1, 211).select(F.col("id").alias("cycle")))


@query("""WITH e AS (SELECT event_id, ts, list_distinct(list_filter(regexp_split_to_array(lower(event_type), '\\s+'), lambda w: w <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(event_type || ' ' || props), '\\s+'), lambda w: w <> '')) AS b FROM events),
  er AS (SELECT event_id, ts, round(1 - len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE, 6) AS error FROM e)
  SELECT count(*) AS total_processed, count(*) FILTER (error > 0.5) AS stored_to_semantic, count(*) FILTER (error <= 0.5) AS stored_to_working, count(*) FILTER (error > 0.5) AS surprises, (SELECT string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) FROM (SELECT * FROM er ORDER BY ts DESC, event_id DESC LIMIT 10)) AS recent_events FROM er""")
def retention_stats(spark, d):
    return attention.retention_stats(streams.surprise_gate(streams.logical(table(spark, d, "events"))))


@query("""WITH h AS (SELECT list_filter(['thing', 'ertion', 'attion'], lambda x: contains(lower(text), x)) AS h FROM documents) SELECT CASE len(h) WHEN 0 THEN 'unassigned' WHEN 1 THEN h[1] ELSE 'ambiguous' END AS workspace, count(*) AS n FROM h GROUP BY 1""")
def migration_counts(spark, d):
    return attention.migration_counts(sessions.route(memories(spark, d), ["thing", "ertion", "attion"]))


@query("""SELECT owner, id FROM (SELECT user_id % 5 AS owner, event_id AS id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) / 1e6 + 0.3 * least(event_id % 13 / 10.0, 1.0) DESC, event_id) AS r FROM events) WHERE r <= 100""")
def l1_working_memory(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("owner"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("last_accessed"), (F.col("event_id") % 13 / 10).alias("importance"))
    return attention.working_memory(e).select("owner", "id")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 5 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM g)
  SELECT user_id AS key, max(ts) + INTERVAL 5 HOUR AS settled_at, count(*) > 0 AS some FROM s GROUP BY user_id, no""")
def debounced_changes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("created_at"), F.col("event_type").alias("content"))
    return streams.debounce(e, "5 hours").select("key", F.col("settled_at").cast("timestamp_ntz").alias("settled_at"), F.col("content").isNotNull().alias("some"))


@query(f"{ctes('m')} SELECT count(*) AS runs, CAST(sum(n) AS BIGINT) AS sources, count(DISTINCT k) AS clusters FROM (SELECT text AS k, count(*) AS n FROM m GROUP BY 1 HAVING count(*) > 1)")
def consolidation_log(spark, d):
    """The log of consolidating exact copies: one run for each text that occurs more than once."""
    m = memories(spark, d)
    first = m.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = m.withColumn("h", F.sha2("text", 256)).join(first, "h").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("sim"))
    out = consolidation.consolidate(m.select("id", "text"), pairs, AS_OF)
    return out["log"].agg(F.count("*").alias("runs"), F.sum(F.col("source_count").cast("long")).alias("sources"), F.countDistinct("consolidated_into_id").alias("clusters"))


@query()
def near_pairs_projected(spark, d):
    """Vectors and turned copies of them, by random projections; tests measure the recall against all pairs."""
    v = _vectors(spark, d).select("id", "embedding")
    turned = v.select(F.concat("id", F.lit("c")).alias("id"), F.transform("embedding", lambda x, i: F.when(i % 8 == 0, x * 0.6).otherwise(x).cast("float")).alias("embedding"))
    return consolidation.near_pairs(v.unionByName(turned))


# --- streams with state, joins over time ----------------------------------------------------------------------------


def _logical(spark, d):
    return streams.logical(table(spark, d, "events"))


def _fresh(spark, tag):
    return f"{shared_root(spark)}/{tag}-{uuid4().hex[:12]}"


@query("SELECT user_id AS session_id, count(*) AS n, count(*) FILTER (contains(event_type, 'error')) AS errors, max(ts) AS last_event_at FROM events GROUP BY 1")
def consumed_sessions(spark, d):
    """Session figures that a consumer keeps of a stream of four batches, the older of which are folded."""
    c = consumer.Consumer(spark, _fresh(spark, "consumer"))
    c.start(consumer.in_files(_logical(spark, d), f"{c.path}/in"), f"{c.path}/state").awaitTermination()
    c.compact(1)
    return c.sessions().withColumn("last_event_at", F.col("last_event_at").cast("timestamp_ntz"))


@query("""SELECT owner, id FROM (SELECT CAST(user_id % 5 AS VARCHAR) AS owner, CAST(event_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) / 1e6 + 0.3 * least(event_id % 13 / 10.0, 1.0) DESC, event_id) AS r FROM events) WHERE r <= 100""")
def l1_working_memory_stream(spark, d):
    """Working memory as state: a stream of four batches leaves what the batch query tells."""
    put = _logical(spark, d).select((F.col("session_id") % 5).cast("string").alias("owner"), F.col("event_id").cast("string").alias("id"), F.lit("put").alias("kind"), F.col("event_type").alias("content"), (F.col("event_id") % 13 / 10).alias("importance"), F.col("created_at").alias("at"), "event_id")
    path = _fresh(spark, "memory")
    return state.current(streams.drain(state.working_memory(consumer.in_files(put, f"{path}/in")), path)).select("owner", "id")


@query(f"{ctes('t')} SELECT DISTINCT r.subject, r.day, predicate, object FROM (SELECT DISTINCT 'customer_' || o_custkey AS subject, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders) r JOIN t ON t.subject = r.subject AND (valid_from IS NULL OR valid_from <= day) AND (valid_to IS NULL OR valid_to >= day)")
def kg_as_of_batch(spark, d):
    """The facts about each customer on the days of its orders."""
    days = table(spark, d, "orders").select(F.concat(F.lit("customer_"), "o_custkey").alias("subject"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return graph.as_of_batch(triples(spark, d), days).select("subject", "day", "predicate", "object").distinct()


# --- rules as a table, the graph as a lane ------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,} [a-z]{4,}')) AS pair FROM benchmark),
  r AS (SELECT pair, replace(pair, ' ', '-') AS rule_id, '(?i)\b' || replace(pair, ' ', '\s+') || '\b' AS pattern, CASE WHEN length(pair) > 12 THEN 'block' ELSE 'warn' END AS severity FROM p)
  SELECT 'pages/' || page_id || '.html' AS path, rule_id, severity, 'a pair of words of a test item: ' || pair AS message FROM pages, r WHERE contains(lower(html), split_part(pair, ' ', 1)) AND regexp_matches(html, pattern) AND NOT contains(html, 'rule:allow ' || rule_id)""")
def rule_table_violations(spark, d):
    """A rule for each pair of words of the test items, over all pages."""
    pairs = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,} [a-z]{4,}"), F.lit(0))).alias("pair")).distinct()
    pattern = F.concat(F.lit(r"(?i)\b"), F.replace("pair", F.lit(" "), F.lit(r"\s+")), F.lit(r"\b"))
    some = pairs.select(F.replace("pair", F.lit(" "), F.lit("-")).alias("rule_id"), F.lit("**/*").alias("glob"), pattern.alias("pattern"), F.when(F.length("pair") > 12, "block").otherwise("warn").alias("severity"), F.concat(F.lit("a pair of words of a test item: "), "pair").alias("message"))
    files = table(spark, d, "pages").select(F.concat(F.lit("pages/"), "page_id", F.lit(".html")).alias("path"), F.col("html").alias("content"))
    return many_rules.violations(files, some)


def _hops(depth: int, fan_out: int) -> str:
    out = """, g AS (SELECT n, m, predicate, memory, max(confidence) AS c FROM (SELECT subject AS n, object AS m, predicate, source_closet AS memory, confidence FROM t WHERE valid_to IS NULL
  UNION ALL SELECT object, subject, predicate, source_closet, confidence FROM t WHERE valid_to IS NULL) GROUP BY ALL), s0 AS (SELECT 'customer_7' AS id)"""
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM s{i}" for i in range(k))
        out += f""", w{k} AS (SELECT * FROM (SELECT g.*, row_number() OVER (PARTITION BY n ORDER BY c DESC, m, predicate, memory NULLS FIRST) AS r FROM g JOIN s{k - 1} ON n = id WHERE m NOT IN ({seen})) WHERE r <= {fan_out}), s{k} AS (SELECT DISTINCT m AS id FROM w{k})"""
    return out


@query(f"""{ctes('m', 't')}{_hops(3, 20)}, x AS (SELECT memory AS id, round(sum(c * pow(0.5, k)), 9) AS score FROM (SELECT memory, c, 0 AS k FROM w1 UNION ALL SELECT memory, c, 1 FROM w2 UNION ALL SELECT memory, c, 2 FROM w3) WHERE memory IN (SELECT id FROM m) GROUP BY 1)
  SELECT id, score, rank FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 200""")
def lane_graph_first(spark, d):
    """The lane's own limit of 200 rows, three hops from one customer."""
    seeds = table(spark, d, "customer").where("c_custkey = 7").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"))
    return graph_lane.lane_graph(memories(spark, d), triples(spark, d), seeds, f"{shared_root(spark)}/walk-{uuid4().hex[:12]}").select("id", "score", "rank")


# --- daily partials -----------------------------------------------------------------------------------------------


def _partials(spark, d):
    """Partials of all memories as they were before any was deleted, and then of the days that have deletions."""
    m, x = memories(spark, d), meta(spark, d)
    p = Partials(spark, _fresh(spark, "partials"))
    p.refresh(m, x.withColumn("is_deleted", F.lit(False)))
    p.refresh(m, x, m.join(x.where("is_deleted").select("id"), "id").select(F.to_date("created_at").alias("day")))
    return p


@query(f"{ctes('m', 'meta')}, {_HEALTH} SELECT * FROM h")
def memory_health_partials(spark, d):
    return _partials(spark, d).health(_consolidations(spark, d), AS_OF)


@query(f"{ctes('m', 'meta')}, {_WORDS} SELECT word, n FROM wc ORDER BY n DESC, word LIMIT 20")
def word_coverage_partials(spark, d):
    p = _partials(spark, d)
    p.merge()
    return p.top_words()


# --- the engine in SQL --------------------------------------------------------------------------------------------


@query(f"""{ctes('m')}, {_bm25('m')}, l AS (SELECT * FROM {_FTS} UNION ALL SELECT * FROM {_RECENT.format(s='m')}), f AS (SELECT id, sum(CASE lane WHEN 'recency' THEN 0.5 ELSE 1.0 END / (60 + rank)) AS score FROM l GROUP BY id)
  SELECT m.id, tier, round(f.score * {_DECAY}, 9) AS score FROM m JOIN f ON m.id = f.id ORDER BY 3 DESC, 1 LIMIT 20""")
def sql_hybrid_search(spark, d):
    sql_surface.register(spark, memories(spark, d))
    return spark.sql(f"SELECT * FROM hybrid_search('{TERMS}', TIMESTAMP '{AS_OF}', 20)")


_MODULE_LANES = """l AS (SELECT module AS query_id, id, 'recency' AS lane, row_number() OVER (PARTITION BY module ORDER BY created_at DESC, id) AS rank FROM {m} UNION ALL SELECT module, id, 'long', row_number() OVER (PARTITION BY module ORDER BY length(text) DESC, id) FROM {m})"""


@query(f"""{ctes('m')}, {_MODULE_LANES.format(m='m')}, f AS (SELECT query_id, id, round(sum(CASE lane WHEN 'recency' THEN 0.5 ELSE 1.0 END / (60 + rank)), 9) AS score FROM l WHERE rank <= 200 GROUP BY ALL)
  SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 50""")
def sql_rrf_fuse(spark, d):
    """For each module the best of two lanes of at most 200 rows."""
    sql_surface.register(spark, memories(spark, d))
    return spark.sql(f"WITH {_MODULE_LANES.format(m='recall_memories')} SELECT * FROM rrf_fuse(TABLE(SELECT * FROM l WHERE rank <= 200), weights => 'recency=0.5,long=1.0', top => 50)")


@query(f"{ctes('t')} SELECT subject, predicate, object, valid_from, valid_to, confidence FROM t WHERE (valid_from IS NULL OR valid_from <= '1996-01-01') AND (valid_to IS NULL OR valid_to >= '1996-01-01')")
def sql_kg_as_of(spark, d):
    sql_surface.register(spark, memories(spark, d), triples(spark, d))
    return spark.sql("SELECT * FROM kg_as_of('1996-01-01')")
