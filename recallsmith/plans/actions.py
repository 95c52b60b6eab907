"""Whole actions over a store of logical tables, by name: each composes operators and returns a DataFrame.

Actions that write return the new state of a table, which the caller stores; nothing here writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallsmith.functions import scoring
from recallsmith.operators import attention, consolidation, graph, hdc, quality, retrieval, rules, sessions
from recallsmith.operators.index import TextIndex
from recallsmith.sources import readers


@dataclass
class Store:
    """The tables of one workspace at an instant; what an action doesn't need may be missing."""

    as_of: str
    memories: DataFrame
    meta: DataFrame | None = None
    embeddings: DataFrame | None = None
    vectors: DataFrame | None = None
    triples: DataFrame | None = None
    entities: DataFrame | None = None
    goals: DataFrame | None = None
    sessions: DataFrame | None = None
    events: DataFrame | None = None
    state: DataFrame | None = None
    consolidations: DataFrame | None = None
    extractions: DataFrame | None = None
    shares: DataFrame | None = None
    index: TextIndex | None = None
    user: str = "default"

    @property
    def deleted(self) -> DataFrame | None:
        return None if self.meta is None else self.meta.where("is_deleted")

    def query_vector(self, query: str) -> DataFrame | None:
        """The query's embedding as a one-row frame, if the store has embeddings; by the default model."""
        return None if self.embeddings is None else self.memories.sparkSession.createDataFrame([(readers.hash_embedding([query])[0],)], "q array<double>")


ACTIONS: dict[str, Callable[..., DataFrame]] = {}


def action(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        ACTIONS[name] = f
        return f

    return add


def run(store: Store, name: str, /, **arguments: object) -> DataFrame:
    """An action by name, as `tool action`."""
    if name not in ACTIONS:
        raise ValueError(f"no action {name}; there are: {', '.join(sorted(ACTIONS))}")
    return ACTIONS[name](store, **arguments)


# --- search -------------------------------------------------------------------------------------------------------


@action("search basic")
def search_basic(s: Store, query: str, limit: int = 10, **filters: str) -> DataFrame:
    return retrieval.search(s.memories, query, s.as_of, s.embeddings, s.query_vector(query), limit, s.index, s.triples, user=s.user, filters=filters, deleted=s.deleted)


@action("search advanced")
def search_advanced(s: Store, query: str, limit: int = 10, **filters: str) -> DataFrame:
    return _bundle(s, query, limit, filters)[0]


@action("search explain")
def search_explain(s: Store, query: str, limit: int = 10, **filters: str) -> DataFrame:
    return _bundle(s, query, limit, filters)[1]


def _bundle(s: Store, query: str, limit: int, filters: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    return retrieval.search_bundle(s.memories, query, s.as_of, s.embeddings, s.query_vector(query), s.vectors, limit, s.index, user=s.user, filters=filters, deleted=s.deleted)


def _found(s: Store, query: str, limit: int = 10) -> DataFrame:
    """(id, text, score) of a basic search; scores are shares of the best one that the lanes can give."""
    hits = search_basic(s, query, limit)
    best = (1.0 + 1.0 + 0.5 + (0.8 if s.triples is not None else 0.0)) / (retrieval.RRF_K + 1)
    return hits.join(s.memories.select("id", "text"), "id").select("id", "text", F.least(F.col("score") / best, F.lit(1.0)).alias("score"))


@action("search reflected")
def search_reflected(s: Store, query: str, limit: int = 10) -> DataFrame:
    """The report of a search for twice as many, cut to the limit."""
    return retrieval.reflected_search(_found(s, query, 2 * limit), None, limit)[0]


@action("search relation")
def search_relation(s: Store, subject: str, object_: str) -> DataFrame:
    return retrieval.search_relation(s.memories, subject, object_).select("id", "text")


# --- memories -----------------------------------------------------------------------------------------------------


@action("remember add")
def remember_add(s: Store, rows: DataFrame, workspace: str | None = None) -> DataFrame:
    return readers.new_memories(rows, scoring.instant(s.as_of), workspace)


@action("remember consolidate")
def remember_consolidate(s: Store, threshold: float = consolidation.THRESHOLD) -> DataFrame:
    """The new rows of one consolidation run over the oldest candidates."""
    few = consolidation.candidates(s.memories, s.embeddings, s.meta, s.as_of, s.user)
    return consolidation.consolidate(s.memories, consolidation.similar_pairs(few, threshold), s.as_of, s.embeddings)["rows"]


@action("remember hit")
def remember_hit(s: Store, hits: DataFrame) -> DataFrame:
    return quality.record_hits(s.meta, hits)


@action("remember share")
def remember_share(s: Store, wanted: DataFrame) -> DataFrame:
    return sessions.share(s.shares, wanted)


@action("remember ingest_commit")
def remember_commits(s: Store, commits: DataFrame) -> DataFrame:
    return graph.commit_memories(commits)


@action("remember ingest_test_failure")
def remember_failures(s: Store, failures: DataFrame) -> DataFrame:
    return graph.failure_memories(failures)


@action("cognitive forget")
def cognitive_forget(s: Store, threshold: float = 0.3, min_age_days: float = 7) -> DataFrame:
    return quality.forget(s.memories, s.as_of, threshold, min_age_days)


@action("cognitive warnings")
def cognitive_warnings(s: Store, context: str) -> DataFrame:
    return rules.warnings(_found(s, context))


@action("cognitive tasks")
def cognitive_tasks(s: Store) -> DataFrame:
    return rules.latent_tasks(s.memories)


# --- project, sessions --------------------------------------------------------------------------------------------


@action("project set_state")
def project_set_state(s: Store, rows: DataFrame) -> DataFrame:
    return sessions.latest(s.state.unionByName(rows, allowMissingColumns=True), "key", "updated_at")


@action("project delete_state")
def project_delete_state(s: Store, gone: DataFrame) -> DataFrame:
    return readers.hard_delete(s.state, gone, "key")


@action("project summary")
def project_summary(s: Store) -> DataFrame:
    return sessions.project_summary(s.state)


@action("project set_goals")
def project_set_goals(s: Store, new: DataFrame, context: str | None = None, replace: bool = True) -> DataFrame:
    return sessions.set_goals(s.goals, new, context, replace, s.as_of)


@action("project list_goals")
def project_list_goals(s: Store, limit: int = 50, offset: int = 0) -> DataFrame:
    return sessions.page(s.goals.where("is_active"), [F.desc("created_at"), F.asc("goal")], limit, offset)


@action("session begin")
def session_begin(s: Store, workspace: str) -> DataFrame:
    return sessions.begin(s.sessions, workspace, s.as_of)


@action("session resume")
def session_resume(s: Store, workspace: str, session_id: str) -> DataFrame:
    return sessions.begin(s.sessions, workspace, s.as_of, session_id)


@action("session handoff")
def session_handoff(s: Store, memory: DataFrame) -> DataFrame:
    return sessions.handoff(sessions.snapshot(s.events, s.goals.where("is_active"), memory))


@action("session progress")
def session_progress(s: Store) -> DataFrame:
    return sessions.progress(s.goals.where("is_active"), s.events)


# --- graph --------------------------------------------------------------------------------------------------------


@action("graph add_relation")
def graph_add_relation(s: Store, new: DataFrame) -> DataFrame:
    return graph.add_triples(s.triples, new)


@action("graph query")
def graph_query(s: Store, name: str, depth: int = 1) -> DataFrame:
    return graph.k_hop(s.triples, name, depth)


@action("graph impact")
def graph_impact(s: Store, name: str) -> DataFrame:
    return graph.impact(s.triples, name)


@action("graph summary")
def graph_summary(s: Store) -> DataFrame:
    return graph.project_summary(s.triples)


@action("kg extract")
def kg_extract(s: Store, limit: int = 50) -> DataFrame:
    return graph.extract(s.memories, s.extractions, s.meta, s.as_of, limit=limit)["triples"]


@action("kg health")
def kg_health(s: Store) -> DataFrame:
    return graph.stats(s.triples, s.entities).crossJoin(graph.temporal_coverage(s.triples))  # one row each


@action("kg query_causal")
def kg_query_causal(s: Store, name: str, direction: str = "both") -> DataFrame:
    return graph.causal(graph.query_entity(s.triples, s.entities, name, direction=direction))


@action("kg add_causal")
def kg_add_causal(s: Store, new: DataFrame) -> DataFrame:
    return graph.add_triples(s.triples, graph.checked_causal(new))


@action("kg cross_workspace_stats")
def kg_shares(s: Store) -> DataFrame:
    return sessions.sync_stats(s.shares)


# --- health -------------------------------------------------------------------------------------------------------


@action("health memory")
def health_memory(s: Store) -> DataFrame:
    return quality.memory_stats(s.memories, s.meta).crossJoin(quality.age_distribution(s.memories, s.as_of))  # one row each


@action("health quality")
def health_quality(s: Store) -> DataFrame:
    return quality.quality_report(s.memories, s.meta, s.consolidations, s.as_of)


@action("health health")
def health_health(s: Store) -> DataFrame:
    return quality.system_health(quality.memory_stats(s.memories, s.meta), graph.stats(s.triples, s.entities), quality.consolidation_effectiveness(s.consolidations), quality.extraction_coverage(s.memories, s.extractions))


@action("health relevance")
def health_relevance(s: Store) -> DataFrame:
    return quality.relevance_stats(s.meta)


@action("health explain")
def health_explain(s: Store) -> DataFrame:
    """How far memories have decayed: healthy and degraded ones, and the worst by name."""
    figures, worst = quality.decay_distribution(s.memories, s.as_of)
    listed = worst.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("decay", "id"))), lambda x: x["id"]), ",").alias("worst"))
    return figures.crossJoin(listed)  # one row each


@action("health vsa")
def health_vsa(s: Store) -> DataFrame:
    return hdc.stats(s.vectors)


@action("notifications alert")
def notifications_alert(s: Store, query: str) -> DataFrame:
    return attention.relevance_alert(_found(s, query))


@action("notifications anomalies")
def notifications_anomalies(s: Store, query: str, limit: int = 20) -> DataFrame:
    return attention.anomalies(_found(s, query, limit))
