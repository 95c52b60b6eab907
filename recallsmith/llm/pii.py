"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base patterns find e-mail addresses, IP addresses, card numbers and phone numbers. Each found value is a protected entity.
Words that occur in documents with it may give it away: the disclosure of entity e by term t is k / (k + 1) * PMI(t; e) / IC(e), where
PMI = log2(P(e | t) / P(e)), IC = -log2 P(e), and k is the number of different texts that have both. P(e | t) is the number of documents that have
both over the number that have t; a document is co-occurrence as a whole, however long it is. So a term that occurs with e alone comes near 1 as
the evidence grows; copies of one text count on both sides of P(e | t) but are no further evidence. Terms beyond the thresholds are generalised or
removed wherever they occur in documents with that entity.

k / (k + 1) is below the lower threshold g for all k < g / (1 - g), three texts by default, so entities and pairs in fewer texts are left out without
loss. Terms are words of TERM_CHARS letters or more.

Cases: a null text is empty; repeated rows are treated alike; ties keep the order email, ip, card, phone, term; overlapping
spans are kept in `spans` and merged when a text is rewritten; an empty table gives an empty result; other columns pass by
unread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import fresh_name, materialise

KINDS = ("email", "ip", "card", "phone", "term")
#: The base patterns. Possessive quantifiers match the same spans without recursion or retries, and a run is only entered
#: at its start or where the last match ended, so that time is linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without one of these has no valid match of the kind.
_HINTS = {
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){13}",
    "phone": r"\+[0-9][ ().0-9-]{8}",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM_CHARS = 4
GENERALISE, REMOVE = 0.75, 0.9
#: Up to so many short rows, or documents with so many spans of revealing terms in all, a list may be broadcast.
BROADCAST_ROWS, BROADCAST_SPANS = 20_000, 200_000
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def running_sums(values: Column, block: int = 128) -> Column:
    """Inclusive running sums of an integer array, in blocks: n * block steps instead of n * n."""

    def within(s: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / block).cast("int")), lambda b: F.slice(s, b * block + 1, F.lit(block)))
        return _let(chunks, lambda c: _let(F.transform(c, _sum), lambda t: F.flatten(F.transform(F.sequence(F.lit(1), F.size(c)), lambda i: _let(_sum(F.slice(t, 1, i - 1)), lambda base: _let(c[i - 1], lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda j: base + _sum(F.slice(x, 1, j)))))))))

    return _let(values, lambda s: F.when(F.size(s) > 0, within(s)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str, kind: str) -> Column:
    """All matches of a Java pattern as spans, in order; places are code points, ends exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    step = _let(found, lambda f: _let(F.transform(f, lambda m: F.length(m)), lambda n: F.struct(f.alias("f"), n.alias("n"))))
    rank = F.lit(KINDS.index(kind))

    def spans(x: Column) -> Column:
        # a match starts after all parts before it and all earlier matches
        before = F.zip_with(F.slice(between, 1, F.size(x["f"])), F.concat(F.array(F.lit(0)), x["n"]), lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        starts = F.slice(running_sums(before), 1, F.size(x["f"]))
        return F.zip_with(x["f"], starts, lambda m, s: F.struct(s.alias("start"), rank.alias("rank"), (s + F.length(m)).cast("int").alias("end"), F.lit(kind).alias("kind"), m.alias("value")))

    return _let(step, lambda x: F.when(F.size(x["f"]) > 0, spans(x)).otherwise(F.array())).cast(_SPAN)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of a value pass the Luhn check."""

    def weigh(d: Column) -> Column:
        def one(i: Column) -> Column:
            x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
            twice = 2 * x - F.when(x > 4, 9).otherwise(0)
            return F.when(i % 2 == 1, twice).otherwise(x).cast("int")

        return _sum(F.transform(F.sequence(F.lit(0), F.length(d) - 1), one)) % 10 == 0

    return _let(_digits(value), weigh)


def base_spans(text: Column) -> Column:
    """The valid base spans of a text, ordered by start, then kind."""
    none = F.array().cast(_SPAN)
    valid = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["value"].rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": lambda s: F.when(F.length(_digits(s["value"])).between(14, 19), luhn(s["value"])).otherwise(False),
        "phone": lambda s: F.length(_digits(s["value"])).between(10, 15),
    }
    parts = []
    for kind, pattern in PATTERNS.items():
        hint = text.contains("@") if kind == "email" else text.contains("+") & text.rlike(_HINTS[kind]) if kind == "phone" else text.rlike(_HINTS[kind])
        parts.append(F.when(hint, F.filter(matches(text, pattern, kind), valid[kind])).otherwise(none))
    return F.when(text.contains("@") | text.rlike("[0-9]"), _let(F.concat(*parts), lambda s: F.array_sort(s))).otherwise(none)


def find_base(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, row, spans, hit) of every row, written to shared storage.

    key is a hash of the text, row a number of its own; hit is the text, only of rows that have spans.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    out = rows.select("id", F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row"), "spans", F.when(F.size("spans") > 0, F.col("text")).alias("hit"))
    return materialise(spark, out, "pii")


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def terms_of(text: Column, least: int = TERM_CHARS) -> Column:
    """The distinct lower-cased words of a text with `least` letters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) >= least))


def _bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def disclosure(spark: SparkSession, found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, disclosure) of the terms that reveal an entity to the lower threshold or more.

    Candidates are counted first, from one text of each class of copies that has an entity, with partial sums before each shuffle; only if some
    term recurs with an entity are the documents that have it counted, in a second pass over all texts.
    """
    least = math.ceil(GENERALISE / (1 - GENERALISE) - 1e-9)
    hits = found.where(F.size("spans") > 0)
    firsts = hits.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    names = hits.select("row", "key", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).join(firsts, ["key", "row"]).drop("key")
    names = materialise(spark, names, "entities")
    per_entity = names.groupBy("entity").agg(F.count("*").alias("k_e"), F.sum("copies").alias("n_e")).where(F.col("k_e") >= least).drop("k_e")
    per_entity = materialise(spark, per_entity, "recurring")
    held = names.join(_bounded(per_entity), "entity").groupBy("row").agg(F.first("copies").alias("copies"), F.collect_list("entity").alias("entities"))
    texts = hits.select("row", "hit").join(_bounded(materialise(spark, held, "holders")), "row")
    words = texts.select("copies", "entities", F.explode(terms_of(F.col("hit"))).alias("term")).select("copies", "term", F.explode("entities").alias("entity"))
    pairs = words.groupBy("entity", "term").agg(F.count("*").alias("k_te"), F.sum("copies").alias("n_te")).where(F.col("k_te") >= least)
    pairs = materialise(spark, pairs.join(per_entity, "entity"), "pairs")
    n = found.count()
    wanted = pairs.select("term").distinct()
    if not pairs.isEmpty():
        words = docs.select(F.explode(terms_of(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("term"))
        counts = words.groupBy("term").agg(F.count("*").alias("n_t")).join(_bounded(wanted), "term")  # counted before the join, which then has a row per term
    else:
        counts = wanted.withColumn("n_t", F.lit(1).cast("long"))
    content = F.log2(F.lit(float(max(n, 1))) / F.col("n_e"))
    sure = F.col("k_te") / (F.col("k_te") + 1)
    scored = pairs.join(counts, "term").withColumn("disclosure", F.when(content > 0, sure * (1 + F.log2(F.col("n_te") / F.col("n_t")) / content)).otherwise(F.lit(0.0)))
    return materialise(spark, scored.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure"), "risks")


def term_spans(spark: SparkSession, found: DataFrame, risks: DataFrame) -> DataFrame:
    """(id, key, terms) for the rows that hold an entity and a term that reveals it: spans of the term, outside base spans.

    A document's own terms are looked up among those that reveal its entities, so an entity in many documents with many terms costs no product of both.
    """
    hits = found.where(F.size("spans") > 0)
    names = hits.select("row", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity"))
    held = names.join(_bounded(risks.select("entity").distinct()), "entity").groupBy("row").agg(F.collect_list("entity").alias("entities"))
    held = materialise(spark, held, "risky")
    own = hits.select("row", "hit").join(_bounded(held), "row").select("row", "entities", F.explode(terms_of(F.col("hit"))).alias("term"))
    own = own.join(_bounded(risks.select("term").distinct()), "term").select("row", "term", F.explode("entities").alias("entity"))
    listed = own.join(_bounded(risks), ["entity", "term"]).groupBy("row", "term").agg(F.max("disclosure").alias("d")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("risky"))
    rows = hits.join(_bounded(materialise(spark, listed, "listed")), "row")
    words = F.filter(matches(F.col("hit"), r"\p{L}++", "term"), lambda w: F.map_contains_key(F.col("risky"), F.lower(w["value"])) & ~F.exists(F.col("spans"), lambda s: (w["start"] < s["end"]) & (s["start"] < w["end"])))
    marked = F.transform(words, lambda w: F.struct(w["start"].alias("start"), w["rank"].alias("rank"), w["end"].alias("end"), F.when(F.element_at(F.col("risky"), F.lower(w["value"])) >= REMOVE, "removed").otherwise("generalised").alias("kind"), w["value"].alias("value")))
    out = rows.select("row", "id", "key", marked.alias("terms"))
    return materialise(spark, out.where(F.size("terms") > 0), "terms")


def _light(terms: DataFrame) -> DataFrame:
    """Spans of revealing terms, to be broadcast if there are few in all."""
    rows, spans = terms.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    return F.broadcast(terms) if rows <= BROADCAST_ROWS and spans <= BROADCAST_SPANS else terms


def span_list(spans: Column, term_kind: str = "term") -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.when(s["rank"] == len(KINDS) - 1, term_kind).otherwise(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def analyse(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, spans, all_spans) of every row: the base spans, and all spans with those of revealing terms."""
    found = find_base(spark, docs, id_col, text_col)
    risks = disclosure(spark, found, docs, text_col)
    if risks.isEmpty():
        return found.select("id", "key", "spans", F.col("spans").alias("all_spans"))
    terms = term_spans(spark, found, risks).select("row", "terms")
    both = found.select("row", "id", "key", "spans").join(_light(terms), "row", "left")
    return both.select("id", "key", "spans", F.when(F.col("terms").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "terms"))).alias("all_spans"))


def rewrite(text: Column, spans: Column) -> Column:
    """The text with base values and generalised terms as placeholders and removed terms left out; overlaps are one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        put = F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("<"), F.upper(F.when(s["kind"] == "generalised", F.lit("term")).otherwise(s["kind"])), F.lit(">")))
        gap = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step)
    return F.when(F.size(spans) > 0, _let(done, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text))))).otherwise(text)


def sanitise(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of docs with the text rewritten. Rows without a finding keep their text, and null stays null."""
    found = find_base(spark, docs, id_col, text_col)
    risks = disclosure(spark, found, docs, text_col)
    spans = base_spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    if risks.isEmpty():
        return docs.withColumn(text_col, rewrite(F.col(text_col), spans))
    # copies of a row have the same spans
    id_, key, listed = (fresh_name(docs, x) for x in ("id", "key", "terms"))
    terms = term_spans(spark, found, risks).dropDuplicates(["id", "key"]).select(F.col("id").alias(id_), F.col("key").alias(key), F.col("terms").alias(listed))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.join(_light(terms.withColumnRenamed(listed, "terms")).withColumnRenamed("terms", listed), F.col(id_col).eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key)), "left")
    every = _let(spans, lambda s: F.when(F.col(listed).isNull(), s).otherwise(F.array_sort(F.concat(s, F.col(listed)))))
    return rows.withColumn(text_col, rewrite(F.col(text_col), every)).drop(id_, key, listed)


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the personal data of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = analyse(spark, docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(F.col("id").alias("doc_id"), *(count(k) for k in KINDS[:4]), F.sha2(span_list(F.col("spans")), 256).alias("base_sha256"), span_list(F.col("all_spans")).alias("spans"))
