"""The engine in SQL: register() makes views of a store and functions over them.

    register(spark, memories, triples)
    spark.sql("SELECT * FROM hybrid_search('spark memory', TIMESTAMP '2024-02-01', 20)")
    spark.sql("SELECT * FROM rrf_fuse(TABLE(my_lanes), weights => 'fts=1.0,dense=0.5')")

Scalar functions and the lanes are SQL functions, which Catalyst puts in the place of their calls: filters and limits around a call reach the scan, and a lane stays a top-k.
Fusion of given lanes is a Python table function: its analyze() checks the table and the options, names the columns it reads, and has the rows dealt by query and sorted by lane
and rank, so queries are fused in parallel; a task holds the ids of one query, as many as its lanes have rows.

| function | result |
|-|-|
| tier_decay(tier, created_at, as_of) | the factor of a memory's age |
| query_terms(query), entity_id(name) | the prefixes that a query stands for; an entity's id |
| recency_lane(n), fts_lane(query, n) | (id, lane, score, rank) |
| hybrid_search(query, as_of, n) | (id, tier, score): both lanes, fused, times the decay |
| kg_as_of(day), kg_entity(name) | the edges valid on a day; the current edges of an entity, and their direction |
| rrf_fuse(TABLE(lanes), weights, k, top) | (query_id, id, score, rank) of lanes (query_id, id, lane, rank) |

Cases: null texts count as memories without terms, a query without terms finds nothing in fts_lane; ties go by id. In rrf_fuse a null query_id is a query, a null id, lane or rank
has no score, lanes without a weight are dropped, a lane that ranks an id twice counts twice; an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType

from recallsmith.functions.scoring import DECAY
from recallsmith.functions.text import TOKEN
from recallsmith.operators.retrieval import LANE_LIMIT, RRF_K

LANES = ("query_id", "id", "lane", "rank")


@dataclass
class Fusion(AnalyzeResult):
    """What analyze() found, as the tasks get it."""

    weights: dict[str, float] = field(default_factory=dict)
    k: int = RRF_K
    top: int | None = None


def parse_weights(text: str) -> dict[str, float]:
    """The weights of 'lane=weight,...'."""
    pairs = [p.partition("=") for p in text.split(",") if p.strip()]
    try:
        out = {name.strip(): float(value) for name, eq, value in pairs if eq and name.strip()}
    except ValueError:
        out = {}
    if not out or len(out) != len(pairs):
        raise ValueError(f"weights are lane=weight,..., not {text!r}")
    return out


@udtf
class RrfFuse:
    """Reciprocal rank fusion of the lanes of each query."""

    def __init__(self, analyzed: Fusion) -> None:
        self.options, self.query, self.scores = analyzed, None, {}

    @staticmethod
    def analyze(lanes: AnalyzeArgument, **options: AnalyzeArgument) -> Fusion:
        if not lanes.isTable or not set(LANES) <= set(lanes.dataType.names):
            raise ValueError(f"rrf_fuse takes a table with the columns {', '.join(LANES)}")
        unknown = set(options) - {"weights", "k", "top"}
        if unknown or "weights" not in options or any(not a.isConstantExpression for a in options.values()):
            raise ValueError("rrf_fuse takes constants: weights => 'lane=weight,...', and if wanted k => n, top => n")
        value = lambda name, default: options[name].value if name in options else default
        schema = StructType().add("query_id", lanes.dataType["query_id"].dataType).add("id", StringType()).add("score", DoubleType()).add("rank", IntegerType())
        return Fusion(
            schema=schema, partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("lane"), OrderingColumn("rank"), OrderingColumn("id")],
            select=[SelectedColumn(c) for c in LANES], weights=parse_weights(value("weights", "")), k=value("k", RRF_K), top=value("top", None),
        )

    def eval(self, row, **options) -> None:
        self.query = row["query_id"]
        weight = self.options.weights.get(row["lane"])
        if weight and row["id"] is not None and row["rank"] is not None:
            self.scores[row["id"]] = self.scores.get(row["id"], 0.0) + weight / (self.options.k + row["rank"])

    def terminate(self):
        found = sorted(self.scores.items(), key=lambda x: (-round(x[1], 9), x[0]))
        for n, (i, score) in enumerate(found[: self.options.top], 1):
            yield self.query, str(i), round(score, 9), n


def _functions(prefix: str) -> dict[str, str]:
    """Signature and body of each SQL function over the views of a prefix."""
    rates = " ".join(f"WHEN '{name}' THEN {rate}D" for name, rate in DECAY.items() if name != "semantic")
    age = "greatest((unix_micros(tier_decay.as_of) - unix_micros(tier_decay.created_at)) / 86400000000D, 0D)"
    terms = lambda query: f"array_distinct(filter(regexp_extract_all(lower({query}), '{TOKEN}', 0), t -> length(t) >= 3))"  # noqa: E731  (in a function within a function Spark takes no third)
    tf = f"SELECT id, regexp_count(lower(text), '{TOKEN}') AS dl, transform({terms('fts_lane.query')}, t -> regexp_count(lower(text), concat('(?<![a-z0-9])', t))) AS tf FROM {prefix}memories"
    idf = "greatest(ln((n - d + 0.5D) / (d + 0.5D)), 1e-6D)"
    edges = "subject, predicate, object, valid_from, valid_to, confidence"
    typed = "subject STRING, predicate STRING, object STRING, valid_from STRING, valid_to STRING, confidence DOUBLE"
    lane = "TABLE (id STRING, lane STRING, score DOUBLE, rank INT)"
    return {
        "query_terms(query STRING) RETURNS ARRAY<STRING>": terms("query"),
        "entity_id(name STRING) RETURNS STRING": r"replace(replace(lower(name), ' ', '_'), '\'', '')",
        "tier_decay(tier STRING, created_at TIMESTAMP, as_of TIMESTAMP) RETURNS DOUBLE": f"coalesce(exp(-(CASE tier_decay.tier {rates} ELSE {DECAY['semantic']}D END) * {age}), 1D)",
        f"recency_lane(n INT) RETURNS {lane}": f"SELECT id, 'recency', CAST(recency_lane.n - r + 1 AS DOUBLE), r FROM (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS r FROM {prefix}memories) WHERE r <= recency_lane.n",
        f"fts_lane(query STRING, n INT) RETURNS {lane}": f"""SELECT id, 'fts', score, r FROM (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM
          (SELECT id, round(aggregate(zip_with(tf, df, (f, d) -> {idf} * f * 2.2D / (f + 1.2D * (0.25D + 0.75D * dl / avgdl))), 0D, (a, x) -> a + x), 9) AS score FROM ({tf}) AS rows
          CROSS JOIN (SELECT count(*) AS n, avg(regexp_count(lower(text), '{TOKEN}')) AS avgdl FROM {prefix}memories) AS store
          CROSS JOIN (SELECT transform(array_sort(array_agg(struct(i, c))), x -> x.c) AS df FROM (SELECT i, count_if(f > 0) AS c FROM ({tf}) LATERAL VIEW posexplode(tf) AS i, f GROUP BY i)) AS terms
          WHERE exists(tf, f -> f > 0))) WHERE r <= fts_lane.n""",
        "hybrid_search(query STRING, as_of TIMESTAMP, n INT) RETURNS TABLE (id STRING, tier STRING, score DOUBLE)": f"""SELECT id, tier, score FROM (SELECT id, tier, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM
          (SELECT m.id, m.tier, round(f.score * tier_decay(m.tier, m.created_at, hybrid_search.as_of), 9) AS score FROM {prefix}memories AS m JOIN
          (SELECT id, sum(weight / ({RRF_K} + rank)) AS score FROM (SELECT id, rank, 1.0D AS weight FROM fts_lane(hybrid_search.query, {LANE_LIMIT}) UNION ALL SELECT id, rank, 0.5D FROM recency_lane({LANE_LIMIT})) GROUP BY id) AS f ON f.id = m.id))
          WHERE r <= hybrid_search.n""",
        f"kg_as_of(day STRING) RETURNS TABLE ({typed})": f"SELECT {edges} FROM {prefix}triples WHERE (valid_from IS NULL OR valid_from <= kg_as_of.day) AND (valid_to IS NULL OR valid_to >= kg_as_of.day)",
        f"kg_entity(name STRING) RETURNS TABLE (direction STRING, {typed})": f"SELECT CASE WHEN subject = entity_id(kg_entity.name) THEN 'out' ELSE 'in' END, {edges} FROM {prefix}triples WHERE valid_to IS NULL AND (subject = entity_id(kg_entity.name) OR object = entity_id(kg_entity.name))",
    }


def register(spark: SparkSession, memories: DataFrame, triples: DataFrame | None = None, prefix: str = "recall_") -> list[str]:
    """Make the views `<prefix>memories` and `<prefix>triples` and the functions, for this session; without triples there are no kg functions. Returns the functions' names."""
    memories.createOrReplaceTempView(f"{prefix}memories")
    if triples is not None:
        triples.createOrReplaceTempView(f"{prefix}triples")
    made = ["rrf_fuse"]
    for signature, body in _functions(prefix).items():
        name = signature.split("(")[0]
        if name.startswith("kg_") and triples is None:
            continue
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        made.append(name)
    spark.udtf.register("rrf_fuse", RrfFuse)
    return made
