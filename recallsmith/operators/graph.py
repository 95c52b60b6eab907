"""The temporal entity-relationship graph: edges (subject, predicate, object, valid_from, valid_to, confidence)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallsmith.functions import scoring, text

#: Predicates of cause.
CAUSAL = ("caused_by", "fixed_by", "introduced_by", "blocked_by", "depends_on")


def valid_at(day: str | Column) -> Column:
    """Closed validity interval, open where a bound is missing; dates compare as text, so partial dates work."""
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))


#: Months of a bucket of time that instants and validity intervals are joined by.
BUCKET_MONTHS = 6


def _bucket(day: Column) -> Column:
    """The bucket of time of a date text, which may lack its day or month; null if it begins with no year."""
    year, month = F.substring(day, 1, 4), F.regexp_extract(day, r"^[0-9]{4}-([0-9]{2})", 1)
    months = year.try_cast("int") * 12 + F.coalesce(month.try_cast("int"), F.lit(1)) - 1
    return F.when(day.rlike("^[0-9]{4}"), F.floor(months / BUCKET_MONTHS).cast("int"))


def as_of_batch(triples: DataFrame, instants: DataFrame) -> DataFrame:
    """(subject, day, predicate, object, valid_from, valid_to): the facts about each subject that are valid on each of its days; instants (subject, day).

    Facts are dealt to the buckets of time that they cover, between the first and the last day that is asked for, and a day lies in one bucket; so the join is by subject and
    bucket, a pair meets once, and a subject with many facts and days is split by time. Bounds are those of valid_at(): closed, open where missing, compared as text.
    Days without a year give no row, as do null subjects; a bound without a year counts as missing when facts are dealt out, and as text when they are compared. Repeated instants are one.
    """
    asked = instants.select("subject", "day").distinct().withColumn("bucket", _bucket(F.col("day"))).where("bucket IS NOT NULL AND subject IS NOT NULL")
    low, high = asked.agg(F.min("bucket"), F.max("bucket")).first()
    if low is None:
        return asked.drop("bucket").join(triples.select("subject", "predicate", "object", "valid_from", "valid_to").limit(0), "subject")
    first, last = (F.greatest(F.lit(low), F.coalesce(_bucket(F.col("valid_from")), F.lit(low))), F.least(F.lit(high), F.coalesce(_bucket(F.col("valid_to")), F.lit(high))))
    facts = triples.select("subject", "predicate", "object", "valid_from", "valid_to", first.alias("first"), last.alias("last")).where("first <= last")
    dealt = facts.withColumn("bucket", F.explode(F.sequence("first", "last"))).drop("first", "last")
    return asked.join(dealt, ["subject", "bucket"]).where(valid_at(F.col("day"))).drop("bucket")


def names(entities: DataFrame, role: str) -> DataFrame:
    """(role, role_name) of entities, to join edges with."""
    return entities.select(F.col("id").alias(role), F.col("name").alias(f"{role}_name"))


def query_entity(triples: DataFrame, entities: DataFrame, name: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
    """Edges of an entity, given by name, with the names of both ends, the direction and whether they are current.

    Each direction joins the entity at the other end; edges to ends that are no entities are left out.
    """
    t, me = triples.where(valid_at(as_of)) if as_of else triples, text.entity_id(F.lit(name))
    parts = []
    if direction in ("out", "both"):
        out = t.where(F.col("subject") == me).join(names(entities, "object"), "object")
        parts.append(out.select(F.lit("outgoing").alias("direction"), F.lit(name).alias("subject"), "predicate", F.col("object_name").alias("object"), "valid_from", "valid_to", "confidence"))
    if direction in ("in", "both"):
        into = t.where(F.col("object") == me).join(names(entities, "subject"), "subject")
        parts.append(into.select(F.lit("incoming").alias("direction"), F.col("subject_name").alias("subject"), "predicate", F.lit(name).alias("object"), "valid_from", "valid_to", "confidence"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("current", F.col("valid_to").isNull())


def named_edges(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges with the names of both ends, which must be entities."""
    j = triples.join(names(entities, "subject"), "subject").join(names(entities, "object"), "object")
    return j.select(F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), "valid_from", "valid_to", "confidence", F.col("valid_to").isNull().alias("current"))


def query_relationship(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    """Edges of a predicate with the names of both ends."""
    t = triples.where(F.col("predicate") == text.entity_id(F.lit(predicate)))
    return named_edges(t.where(valid_at(as_of)) if as_of else t, entities)


def query_batch(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Open outgoing edges of many entities (id), joined, not one query each."""
    return triples.where("valid_to IS NULL").join(names.select(F.col("id").alias("subject")), "subject", "left_semi")


def timeline(triples: DataFrame, entities: DataFrame, name: str | None = None, limit: int = 100) -> DataFrame:
    """The first edges (of an entity) by the day they begin, with the names of both ends."""
    me = text.entity_id(F.lit(name)) if name else None
    t = triples.where((F.col("subject") == me) | (F.col("object") == me)) if name else triples
    return named_edges(t, entities).orderBy(F.asc_nulls_last("valid_from"), "subject", "predicate", "object", F.asc_nulls_last("valid_to")).limit(limit)


def causal(edges: DataFrame) -> DataFrame:
    """Those edges that tell a cause."""
    return edges.where(F.col("predicate").isin(*CAUSAL))


def checked_causal(new: DataFrame) -> DataFrame:
    """New edges; one whose predicate tells no cause fails the plan when it is run."""
    wrong = F.raise_error(F.concat(F.lit("not a causal predicate: "), "predicate"))
    return new.withColumn("predicate", F.when(F.col("predicate").isin(*CAUSAL), F.col("predicate")).otherwise(wrong.cast("string")))


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: entities, triples, current, expired, predicates."""
    t = triples.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current"), F.count_if(F.col("valid_to").isNotNull()).alias("expired"), F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"))
    return t.crossJoin(entities.agg(F.count("*").alias("entities")))  # one row each


def top_by(df: DataFrame, column: str, limit: int = 20) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


def temporal_coverage(triples: DataFrame) -> DataFrame:
    dates = triples.where("valid_from IS NOT NULL").select(F.try_to_timestamp("valid_from").alias("d"))
    return dates.agg(F.count("*").alias("dated"), F.count("d").alias("parsable"))


def add_triples(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Append edges, but none that equals an open one; repeated new edges count once."""
    key = ["subject", "predicate", "object"]
    norm = new.withColumns({"subject": text.entity_id(F.col("subject")), "predicate": F.replace(F.lower("predicate"), F.lit(" "), F.lit("_")), "object": text.entity_id(F.col("object"))})
    first = norm.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.asc_nulls_last("valid_from")))).where("r = 1").drop("r")
    return triples.unionByName(first.join(triples.where("valid_to IS NULL").select(*key), key, "left_anti"), allowMissingColumns=True).select(triples.columns)


def invalidate(triples: DataFrame, subject: str, predicate: str, object_: str, ended: str) -> DataFrame:
    """Close the open edge that matches."""
    hit = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_) & F.col("valid_to").isNull()
    return triples.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to")))


def succession(triples: DataFrame, predicate: str) -> DataFrame:
    """Facts of one predicate, each closed when the next of its subject begins, and the edge to that next fact."""
    w = Window.partitionBy("subject").orderBy("valid_from", "object")
    t = triples.where((F.col("predicate") == predicate) & F.col("valid_from").isNotNull())
    return t.select("subject", "object", "valid_from", F.lead("valid_from").over(w).alias("closed_at"), F.lead("object").over(w).alias("evolved_into"))


def k_hop(triples: DataFrame, name: str, depth: int = 2, fan_out: int = 5) -> DataFrame:
    """(hop, subject, predicate, object) of open edges up to `depth` hops away; later hops take `fan_out` edges of each entity."""
    open_ = triples.where("valid_to IS NULL").select("subject", "predicate", "object")
    hop = open_.where((F.col("subject") == name) | (F.col("object") == name)).distinct()
    out, seen = hop.withColumn("hop", F.lit(1)), hop
    for k in range(2, depth + 1):
        ends = hop.select(F.col("subject").alias("n")).union(hop.select(F.col("object").alias("n"))).where(F.col("n") != name).distinct()
        ways = open_.join(ends, open_["subject"] == ends["n"]).unionByName(open_.join(ends, open_["object"] == ends["n"]))
        few = ways.join(seen, ["subject", "predicate", "object"], "left_anti").withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("subject", "predicate", "object"))).where(F.col("r") <= fan_out)
        hop = few.select("subject", "predicate", "object").distinct()
        out, seen = out.unionByName(hop.withColumn("hop", F.lit(k))), seen.unionByName(hop)
    return out


def impact(triples: DataFrame, name: str, predicate: str = "depends_on") -> DataFrame:
    """What depends on an entity."""
    return triples.where((F.col("predicate") == predicate) & (F.col("object") == name) & F.col("valid_to").isNull()).select("subject").distinct()


def evolve(triples: DataFrame, entities: DataFrame, changes: DataFrame, ended: str) -> tuple[DataFrame, DataFrame]:
    """(edges, entities) after facts evolved; changes (old_id, new_id, reason), triples with an id.

    The old edge is closed, both edges become entities of type fact, and an edge evolved_into joins them; its source tells both facts by name.
    """
    e = names(entities, "subject"), names(entities, "object")
    label = triples.join(e[0], "subject").join(e[1], "object").select("id", F.concat_ws(" ", "subject_name", "predicate", "object_name").alias("label"))
    told = changes.join(label.select(F.col("id").alias("old_id"), F.col("label").alias("was")), "old_id", "left").join(label.select(F.col("id").alias("new_id"), F.col("label").alias("now")), "new_id", "left")
    source = F.concat(F.coalesce("was", "old_id"), F.lit(" → "), F.coalesce("now", "new_id"), F.lit("; "), "reason")
    none = F.lit(None).cast("string")
    meta = told.select(text.entity_id(F.col("old_id")).alias("subject"), F.lit("evolved_into").alias("predicate"), text.entity_id(F.col("new_id")).alias("object"), none.alias("valid_from"), none.alias("valid_to"), F.lit(1.0).alias("confidence"), source.alias("source_file"))
    closed = triples.join(changes.select(F.col("old_id").alias("id"), F.lit(True).alias("closed")).distinct(), "id", "left").withColumn("valid_to", F.when(F.col("closed"), F.lit(ended)).otherwise(F.col("valid_to"))).drop("closed")
    facts = changes.select(F.explode(F.array("old_id", "new_id")).alias("name")).distinct().select(text.entity_id(F.col("name")).alias("id"), "name", F.lit("fact").alias("type"))
    return closed.unionByName(meta, allowMissingColumns=True), add_entities(entities, facts)


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """Entities with new ones (id, name, type) in the place of those with the same id."""
    first = new.dropDuplicates(["id"])
    return entities.join(first.select("id"), "id", "left_anti").unionByName(first, allowMissingColumns=True)


def add_bridges(triples: DataFrame, entities: DataFrame, bridges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, entities) with a semantic bridge between rooms for each of bridges (room_a, room_b, score, reason)."""
    rooms = bridges.select(F.explode(F.array("room_a", "room_b")).alias("name")).distinct().select(text.entity_id(F.col("name")).alias("id"), "name", F.lit("room").alias("type"))
    none = F.lit(None).cast("string")
    new = bridges.select(F.col("room_a").alias("subject"), F.lit("semantically_bridges").alias("predicate"), F.col("room_b").alias("object"), none.alias("valid_from"), none.alias("valid_to"), F.col("score").alias("confidence"))
    return add_triples(triples, new), add_entities(entities, rooms)


def edges(triples: DataFrame, entities: DataFrame, query: str | None = None, limit: int = 100) -> DataFrame:
    """Current edges as (source, relationship, target): the first of the timeline, or those of one entity."""
    found = query_entity(triples, entities, query) if query is not None else timeline(triples, entities, limit=limit)
    return found.where("current").select(F.col("subject").alias("source"), F.col("predicate").alias("relationship"), F.col("object").alias("target")).orderBy("source", "relationship", "target").limit(limit)


def delete_edges(triples: DataFrame, gone: DataFrame, ended: str) -> DataFrame:
    """Edges with the open ones among gone (source, relationship, target) closed; rows that lack an end are left out."""
    key = gone.dropna(subset=["source", "relationship", "target"]).select(text.entity_id(F.col("source")).alias("subject"), text.entity_id(F.col("relationship")).alias("predicate"), text.entity_id(F.col("target")).alias("object"), F.lit(True).alias("gone")).distinct()
    j = triples.join(key, ["subject", "predicate", "object"], "left")
    return j.withColumn("valid_to", F.when(F.col("gone") & F.col("valid_to").isNull(), F.lit(ended)).otherwise(F.col("valid_to"))).select(triples.columns)


def audit_edges(findings: DataFrame, workspace: str = "workspace") -> DataFrame:
    """Edges of a dependency audit (package, finding): orphans depend on the workspace, which misses the ghosts."""
    orphan, none = F.col("finding") == "orphan", F.lit(None).cast("string")
    here = F.lit(workspace)
    return findings.select(F.when(orphan, F.col("package")).otherwise(here).alias("subject"), F.when(orphan, "depends_on").otherwise("missing_dep").alias("predicate"), F.when(orphan, here).otherwise(F.col("package")).alias("object"), none.alias("valid_from"), none.alias("valid_to"), F.lit(1.0).alias("confidence"))


def source_memories(triples: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """(id, rank) of the memories that an entity's first edges cite, for the graph lane of a search; ordered by predicate, ends and source."""
    me = text.entity_id(F.lit(name))
    cited = triples.where((F.col("subject") == me) | (F.col("object") == me)).where("source_closet IS NOT NULL")
    order = ["predicate", "subject", "object", "source_closet"]
    top = cited.orderBy(*order).limit(limit)
    return top.select(F.col("source_closet").alias("id"), F.row_number().over(Window.orderBy(*order)).alias("rank"))


def attach_relations(results: DataFrame, triples: DataFrame, column: str = "text") -> DataFrame:
    """Results with their relations: `predicate object`, sorted, of open edges whose subject is the text itself as an entity; a few hundred results."""
    ids = results.select("id", text.entity_id(F.col(column)).alias("subject"))
    open_ = triples.where("valid_to IS NULL").join(F.broadcast(ids), "subject").groupBy("id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "predicate", "object"))), ";").alias("relations"))
    return results.join(open_, "id", "left")


def centroids(vectors: DataFrame, room: str) -> DataFrame:
    """(room, centroid): the element-wise mean of a room's vectors, summed by element before the shuffle."""
    parts = vectors.select(F.col(room).alias("room"), F.posexplode("embedding").alias("i", "x")).groupBy("room", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("room").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("centroid"))


def assign_room(vectors: DataFrame, rooms: DataFrame, least: float = 0.85, most_rooms: int = 10_000) -> DataFrame:
    """(id, room, sim): the nearest centroid from `least` on, else null; of equally near ones the first by name.

    The rooms are counted, then go to each row as one array, so nothing is shuffled.
    """
    if (n := rooms.count()) > most_rooms:
        raise ValueError(f"{n} rooms: assign level by level")
    every = rooms.agg(F.array_sort(F.collect_list(F.struct("room", "centroid"))).alias("rooms"))
    kind = rooms.schema["room"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("room"), F.lit(-2.0).alias("sim"))

    def nearer(best, r):
        sim = F.round(scoring.cosine(F.col("embedding"), r["centroid"]), 6)
        return F.when(sim > best["sim"], F.struct(r["room"].alias("room"), sim.alias("sim"))).otherwise(best)

    best = vectors.select("id", "embedding").crossJoin(F.broadcast(every)).select("id", F.aggregate("rooms", start, nearer).alias("b"))  # one row of rooms
    return best.select("id", F.when(F.col("b.sim") >= least, F.col("b.room")).alias("room"), F.col("b.sim").alias("sim"))


def project_summary(triples: DataFrame, limit: int = 20, most: int = 10, shown: int = 15) -> DataFrame:
    """(section, line) of the first 3 * limit edges by subject, predicate and object: for each type of `is_a` edges its first entities, and the first other relations."""
    first = triples.orderBy("subject", "predicate", "object", F.asc_nulls_last("valid_from")).limit(3 * limit)
    kinds = first.where("predicate = 'is_a'").groupBy(F.col("object").alias("section")).agg(F.array_join(F.slice(F.array_sort(F.collect_list("subject")), 1, most), ", ").alias("line"))
    told = F.concat(F.col("subject"), F.lit(" --"), F.col("predicate"), F.lit("--> "), F.col("object"))
    rest = first.where("predicate <> 'is_a'").orderBy("subject", "predicate", "object", F.asc_nulls_last("valid_from")).limit(shown).select(F.lit("relations").alias("section"), told.alias("line"))
    return kinds.unionByName(rest)


def seed_facts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, entities) from one row per person or animal: (key, full_name, type, birthday, parent, partner, relationship, sibling, owner, interests array)."""
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))
    rows = facts.withColumn("name", F.coalesce("full_name", cap(F.col("key"))))
    none, some = F.lit(None).cast("string"), lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    edge = lambda ok, predicate, to, since=none: F.when(ok, F.struct(F.lit(predicate).alias("predicate"), to.alias("object"), since.alias("valid_from")))
    kin = lambda r: F.col("relationship") == r
    told = [
        edge(some("parent"), "child_of", cap(F.col("parent")), F.col("birthday")), edge(some("partner"), "married_to", cap(F.col("partner"))),
        edge(kin("daughter"), "is_child_of", F.when(some("parent"), cap(F.col("parent"))).otherwise(F.col("name")), F.col("birthday")),
        edge(kin("husband"), "is_partner_of", cap(F.coalesce("partner", "name"))), edge(kin("brother"), "is_sibling_of", cap(F.coalesce("sibling", "name"))), edge(kin("dog"), "is_pet_of", cap(F.coalesce("owner", "name"))),
    ]
    loves = F.transform(F.coalesce("interests", F.array().cast("array<string>")), lambda i: F.struct(F.lit("loves").alias("predicate"), cap(i).alias("object"), F.lit("2025-01-01").alias("valid_from")))
    edges_ = rows.select("name", F.explode(F.concat(F.filter(F.array(*told), lambda x: x.isNotNull()), loves)).alias("e"))
    new = edges_.select(text.entity_id(F.col("name")).alias("subject"), "e.predicate", text.entity_id(F.col("e.object")).alias("object"), "e.valid_from", none.alias("valid_to"), F.lit(1.0).alias("confidence"))
    kinds = rows.select(text.entity_id(F.col("name")).alias("id"), "name", F.when(kin("dog"), "animal").otherwise(F.coalesce("type", F.lit("person"))).alias("type"))
    ends = edges_.select(text.entity_id(F.col("e.object")).alias("id"), F.col("e.object").alias("name"), F.lit("unknown").alias("type")).dropDuplicates(["id"])
    return new.distinct(), kinds.dropDuplicates(["id"]).unionByName(ends.join(kinds.select("id"), "id", "left_anti"))


_EXTRACTION = "struct<extractions:array<struct<memory_id:string,entities:array<struct<name:string,type:string>>,relations:array<struct<subject:string,predicate:string,object:string,confidence:double>>>>>"


def parse_extractions(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(memory_id, entities, relations) from model answers: JSON, with or without a code fence; unreadable ones give no row."""
    bare = F.regexp_replace(F.trim(F.col(column)), r"(?s)^```[a-z]*\s*|\s*```$", "")
    return answers.select(F.explode(F.from_json(bare, _EXTRACTION)["extractions"]).alias("x")).select("x.*")


def unprocessed(memories: DataFrame, log: DataFrame, meta: DataFrame, limit: int = 50) -> DataFrame:
    """(id, text) of the newest memories that no extraction was logged for and that are not deleted."""
    new = memories.join(log.select(F.col("memory_id").alias("id")), "id", "left_anti").join(meta.where("is_deleted").select("id"), "id", "left_anti")
    return new.orderBy(F.desc("created_at"), "id").limit(limit).select("id", "text", "created_at")


def extraction_batches(rows: DataFrame, size: int = 10, chars: int = 500) -> DataFrame:
    """(batch, ids, prompt) of unprocessed rows, newest first; each text is cut as a prompt's limit demands. A few dozen rows."""
    n = F.row_number().over(Window.orderBy(F.desc("created_at"), "id"))
    line = F.concat(F.lit("["), "id", F.lit("] "), F.substring("text", 1, chars))
    numbered = rows.select(F.floor((n - 1) / size).alias("batch"), n.alias("n"), "id", line.alias("line"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("n", c))), lambda x: x[c])
    return numbered.groupBy("batch").agg(listed("id").alias("ids"), F.array_join(listed("line"), "\n").alias("prompt"))


def rule_answers(batches: DataFrame, memories: DataFrame) -> DataFrame:
    """(batch, answer): answers as a language model would give them, by rule: a text's first entities, each near the next."""
    ids = batches.select("batch", F.explode("ids").alias("id")).join(memories.select("id", "text"), "id")
    found = F.slice(text.extract_entities(F.col("text")), 1, 4)
    near = F.transform(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda e, i: F.struct(F.get(found, i).alias("subject"), F.lit("near").alias("predicate"), e.alias("object"), F.lit(0.5).alias("confidence")))
    each = F.struct(F.col("id").alias("memory_id"), F.transform(found, lambda e: F.struct(e.alias("name"), F.lit("term").alias("type"))).alias("entities"), near.alias("relations"))
    return ids.groupBy("batch").agg(F.to_json(F.struct(F.array_sort(F.collect_list(each)).alias("extractions"))).alias("answer"))


def extract(memories: DataFrame, log: DataFrame, meta: DataFrame, as_of: str, model=None, limit: int = 50) -> dict[str, DataFrame]:
    """One extraction cycle: new edges and entities, and log rows, of the unprocessed memories. `model` takes batches (batch, ids, prompt) and the
    memories and returns (batch, answer); the default goes by rule. A memory that no readable answer covers is logged with an error."""
    rows = unprocessed(memories, log, meta, limit)
    parsed = parse_extractions((model or rule_answers)(extraction_batches(rows), memories)).dropDuplicates(["memory_id"])
    found = parsed.select("memory_id", F.explode("relations").alias("r")).select(F.col("memory_id").alias("source_closet"), "r.*")
    none = F.lit(None).cast("string")
    new = found.select(text.entity_id(F.col("subject")).alias("subject"), text.entity_id(F.col("predicate")).alias("predicate"), text.entity_id(F.col("object")).alias("object"), none.alias("valid_from"), none.alias("valid_to"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "source_closet")
    kinds = parsed.select(F.explode("entities").alias("e")).select(text.entity_id(F.col("e.name")).alias("id"), F.col("e.name").alias("name"), F.coalesce("e.type", F.lit("unknown")).alias("type")).dropDuplicates(["id"])
    return {"triples": new, "entities": kinds, "log": extraction_log(parsed, rows, as_of)}


def extraction_log(parsed: DataFrame, memories: DataFrame, as_of: str) -> DataFrame:
    """One log row per memory with its own counts and a hash of its text; without an extraction an error."""
    j = memories.select("id", "text").join(parsed, F.col("id") == F.col("memory_id"), "left")
    lost = F.col("memory_id").isNull()
    size = lambda c: F.when(lost, 0).otherwise(F.size(F.coalesce(F.col(c), F.array()))).cast("long")
    return j.select(F.col("id").alias("memory_id"), F.sha2("text", 256).alias("memory_text_hash"), scoring.instant(as_of).alias("extracted_at"), size("entities").alias("entities_found"), size("relations").alias("triples_found"), F.when(lost, "no readable answer").alias("extraction_error"))


def commit_memories(commits: DataFrame) -> DataFrame:
    """(id, text, tier) of commits (sha, message, author, date, files array, stat); up to ten files are named."""
    more = F.when(F.size("files") > 10, F.concat(F.lit(" (+"), (F.size("files") - 10).cast("string"), F.lit(" more)"))).otherwise("")
    stat = F.when(F.coalesce("stat", F.lit("")) != "", F.substring("stat", 1, 300)).otherwise("n/a")
    lines = [F.concat(F.lit("[git-commit:"), "sha", F.lit("] "), "message"), F.concat(F.lit("Author: "), "author", F.lit(" | Date: "), "date"), F.concat(F.lit("Files changed: "), F.array_join(F.slice("files", 1, 10), ", "), more), F.concat(F.lit("Stat: "), stat)]
    return commits.select(F.concat(F.lit("commit_"), "sha").alias("id"), F.concat_ws("\n", *lines).alias("text"), F.lit("semantic").alias("tier"))


def commit_edges(commits: DataFrame, most_files: int = 5) -> DataFrame:
    """Causal edges of commits (sha, files): the first files were introduced by it."""
    none = F.lit(None).cast("string")
    return commits.select(F.explode(F.slice("files", 1, most_files)).alias("subject"), F.lit("introduced_by").alias("predicate"), F.concat(F.lit("commit:"), "sha").alias("object"), none.alias("valid_from"), none.alias("valid_to"), F.lit(1.0).alias("confidence"), F.concat(F.lit("commit_"), "sha").alias("source_closet"))


def failure_memories(failures: DataFrame) -> DataFrame:
    """(id, text, tier) of test failures (test_name, error, file_path, at)."""
    lines = [F.concat(F.lit("[test-failure:"), "test_name", F.lit("] "), "at"), F.concat(F.lit("File: "), F.coalesce("file_path", F.lit(""))), F.concat(F.lit("Error: "), F.substring("error", 1, 500))]
    return failures.select(F.concat(F.lit("failure_"), F.substring(F.sha2(F.concat_ws("|", "test_name", "at"), 256), 1, 12)).alias("id"), F.concat_ws("\n", *lines).alias("text"), F.lit("episodic").alias("tier"))


def failure_edges(failures: DataFrame) -> DataFrame:
    """A test was made to fail by a file, where one is named."""
    none = F.lit(None).cast("string")
    return failures.where("coalesce(file_path, '') <> ''").select(F.col("test_name").alias("subject"), F.lit("caused_by").alias("predicate"), F.col("file_path").alias("object"), none.alias("valid_from"), none.alias("valid_to"), F.lit(1.0).alias("confidence"))
