"""Sessions, goals, upserts, sharing between workspaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallsmith.sources.manifest import checkpoint_folder


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"), F.max("created_at").alias("last_event_at"))


def recent_events(events: DataFrame, n: int = 25) -> DataFrame:
    """The last n events of each session; the row limit is pushed into each task's window groups."""
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return events.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n)


def checkpoints(events: DataFrame, every: int = 25) -> DataFrame:
    """Events at which a checkpoint is due, and whether a progress report is (every third)."""
    w = Window.partitionBy("session_id").orderBy("created_at", "event_id")
    return events.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") % every == 0).select("session_id", "event_id", "ordinal", (F.col("ordinal") % (3 * every) == 0).alias("progress"))


def gap_sessions(events: DataFrame, key: str, gap_hours: float) -> DataFrame:
    """(key, session_no, started_at, ended_at, n): a session ends where no event follows for the gap."""
    w = Window.partitionBy(key).orderBy("created_at", "event_id")
    new = F.coalesce((F.unix_micros("created_at") - F.unix_micros(F.lag("created_at").over(w)) > int(gap_hours * 3_600_000_000)).cast("int"), F.lit(1))
    return events.withColumn("new", new).withColumn("session_no", F.sum("new").over(w)).groupBy(key, "session_no").agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("n"))


def previous_session(sessions: DataFrame, key: str) -> DataFrame:
    """Each session with the start of the one before."""
    w = Window.partitionBy(key).orderBy("session_no")
    return sessions.withColumn("previous_start", F.lag("started_at").over(w))


def diff(before: Column, after: Column) -> Column:
    """New and removed items of two lists, sorted."""
    return F.struct(F.sort_array(F.array_except(after, before)).alias("added"), F.sort_array(F.array_except(before, after)).alias("removed"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Upsert by key: the last row of each; rows never gather by key in a list."""
    rest = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("x"))
    return best.select(key, f"x.{order}", *(f"x.{c}" for c in rest))


def set_goals(goals: DataFrame, new: DataFrame, context: str | None, replace: bool, at: str) -> DataFrame:
    """History with new goals; `replace` closes the active ones of the same context (null matches null)."""
    same = F.col("context").eqNullSafe(F.lit(context).cast("string"))
    old = goals.withColumn("is_active", F.when(same & F.lit(replace), F.lit(False)).otherwise(F.col("is_active")))
    return old.unionByName(new.select(F.lit(context).cast("string").alias("context"), "goal", F.lit(at).alias("created_at"), F.lit(True).alias("is_active")), allowMissingColumns=True)


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 100) -> DataFrame:
    """A page, newest first; the limit is clamped."""
    return rows.orderBy(*order).offset(max(offset, 0)).limit(min(limit, most))


def share(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shares to add: (source, target, memory_id), each once, and none that the log has."""
    key = ["source_workspace", "target_workspace", "memory_id"]
    return wanted.select(*key).distinct().join(log, key, "left_anti").withColumn("status", F.lit("shared"))


def sync_stats(log: DataFrame) -> DataFrame:
    """Shares by status, with all sources and targets of the log, sorted; one row."""
    names = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return log.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "shared").alias("shared"), F.count_if(F.col("status") == "imported").alias("imported"),
        names("source_workspace").alias("sources"), names("target_workspace").alias("targets"),
    )


def shared_with(log: DataFrame, workspace: str, direction: str = "outgoing") -> DataFrame:
    """Shares from a workspace, or to it, newest first."""
    side = "source_workspace" if direction == "outgoing" else "target_workspace"
    return log.where(F.col(side) == workspace).orderBy(F.desc("shared_at"), "memory_id")


def import_shared(memories: DataFrame, log: DataFrame, arrived: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """(memories with the arrived rows as user 'shared', log with their shares imported); arrived (shared_memory_id, source_workspace, text, metadata map).

    The new id is derived from the shared one, so importing twice gives the same row.
    """
    meta = F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("imported_from"), F.col("source_workspace"), F.lit("original_shared_id"), F.col("shared_memory_id")))
    new = arrived.dropDuplicates(["shared_memory_id"]).select(F.concat(F.lit("i_"), F.substring(F.sha2("shared_memory_id", 256), 1, 12)).alias("id"), F.lit("shared").alias("user_id"), "text", at.alias("created_at"), F.to_json(meta).alias("metadata"))
    known = arrived.select("shared_memory_id", F.lit(True).alias("here")).distinct()
    marked = log.join(known, "shared_memory_id", "left").withColumn("status", F.when(F.col("here") & (F.col("status") == "shared"), "imported").otherwise(F.col("status"))).drop("here")
    return memories.unionByName(new.join(memories.select("id"), "id", "left_anti"), allowMissingColumns=True), marked


def route(memories: DataFrame, names: list[str], present: DataFrame | None = None) -> DataFrame:
    """(id, outcome, target): the workspaces a text names: none is unassigned, one is copied (unless present), more are ambiguous."""
    hits = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.lower(F.col("text")), F.lower(n)))
    r = memories.select("id", hits.alias("h"))
    if present is not None:
        r = r.join(present.select("id"), "id", "left_anti")
    return r.select("id", F.when(F.size("h") == 0, "unassigned").when(F.size("h") == 1, "copied").otherwise("ambiguous").alias("outcome"), F.when(F.size("h") == 1, F.col("h")[0]).alias("target"))


def goal_drift(goals: Column, said: Column) -> Column:
    """Matches of the goals' words (over three letters, the first five of each) in what was said, over ten or the number of words; 1 without words."""
    words = F.flatten(F.transform(goals, lambda g: F.slice(F.filter(F.split(F.lower(g), r"\s+"), lambda w: F.length(w) > 3), 1, 5)))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower(said), w)))
    return F.when(F.size(words) > 0, hits / F.least(F.size(words), F.lit(10))).otherwise(F.lit(1.0))


def progress(goals: DataFrame, events: DataFrame, recent: int = 20) -> DataFrame:
    """(session_id, addressed, total): goals one of whose words (over four letters) is in the tools of a session's last events; goals (goal), a handful."""
    tools = recent_events(events, recent).groupBy("session_id").agg(F.lower(F.array_join(F.collect_list("tool_name"), " ")).alias("tools"))
    few = goals.limit(5).agg(F.collect_list(F.filter(F.split(F.lower("goal"), r"\s+"), lambda w: F.length(w) > 4)).alias("goals"))
    met = F.filter("goals", lambda g: F.exists(g, lambda w: F.contains(F.col("tools"), w)))
    return tools.crossJoin(F.broadcast(few)).select("session_id", F.size(met).alias("addressed"), F.size("goals").alias("total"))  # one row of goals


def begin(sessions: DataFrame, workspace: str, at: str, parent: str | None = None) -> DataFrame:
    """Sessions with an active one for a workspace: the one that is, or a new one. With a parent the active ones are closed and a child begins."""
    here = (F.col("workspace_root") == workspace) & (F.col("status") == "active")
    new = sessions.sparkSession.range(1).select(
        F.concat(F.lit("s_"), F.substring(F.sha2(F.concat_ws("|", F.lit(workspace), F.lit(parent or ""), F.lit(at)), 256), 1, 12)).alias("id"), F.lit(workspace).alias("workspace_root"),
        F.lit(parent).cast("string").alias("parent_session_id"), F.lit("active").alias("status"), F.lit(at).alias("started_at"), F.lit(None).cast("string").alias("ended_at"),
    )
    if parent is None:
        return sessions.unionByName(new.join(sessions.where(here).limit(1), F.lit(True), "left_anti"), allowMissingColumns=True)
    closed = sessions.withColumn("ended_at", F.when(here, F.lit(at)).otherwise(F.col("ended_at"))).withColumn("status", F.when(here, "closed").otherwise(F.col("status")))
    return closed.unionByName(new, allowMissingColumns=True)


def ancestors(sessions: DataFrame, most: int = 200) -> DataFrame:
    """(id, ancestor, depth) of the whole parent chain of each session; chains of over `most` steps, as a circle is, raise an error."""
    from functools import reduce

    step = sessions.where("parent_session_id IS NOT NULL").select("id", F.col("parent_session_id").alias("ancestor"))
    now, out = step.withColumn("depth", F.lit(1)), []
    up = step.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("next"))
    checkpoint_folder(sessions.sparkSession)
    while True:
        out.append(now)
        depth = len(out) + 1
        now = now.join(up, "ancestor").select("id", F.col("next").alias("ancestor"), F.lit(depth).alias("depth"))
        if depth % 8 == 0:  # long chains don't grow the plan
            now = now.checkpoint()
        if now.isEmpty():
            return reduce(DataFrame.unionByName, out)
        if depth > most:
            raise ValueError(f"a session has over {most} ancestors")


def snapshot(events: DataFrame, goals: DataFrame, memory: DataFrame, recent: int = 25) -> DataFrame:
    """(session_id, summary, active_contexts, tools, goals, l1): what a session's checkpoint holds. events (session_id, tool_name, active_context, ...),
    goals (goal) of the workspace, memory (session_id, id, content) of its working memory. Lists run from the oldest event to the newest."""
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("k"), F.col(c).alias("v")))), lambda x: x["v"])
    last = recent_events(events, recent).groupBy("session_id").agg(listed("tool_name").alias("tools"), listed("active_context").alias("contexts"))
    kept = memory.groupBy("session_id").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "id", "content"))).alias("l1"))
    held = goals.limit(50).agg(F.array_sort(F.collect_list("goal")).alias("goals"))
    j = last.join(kept, "session_id", "left").crossJoin(F.broadcast(held))  # one row of goals
    tail = F.slice("tools", F.greatest(F.size("tools") - 4, F.lit(1)), F.lit(5))
    return j.select("session_id", F.concat(F.lit("Recent activity: "), F.array_join(tail, ", ")).alias("summary"), F.array_distinct(F.filter("contexts", lambda c: c.isNotNull() & (c != ""))).alias("active_contexts"), "tools", "goals", F.coalesce("l1", F.array().cast("array<string>")).alias("l1"))


def handoff(snapshots: DataFrame, shown: int = 15) -> DataFrame:
    """(session_id, prompt): a snapshot as text, with the newest `shown` tool calls in order and up to 20 items of working memory."""

    def lines(items: Column, none: str) -> Column:
        return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(none)

    calls = F.slice("tools", F.greatest(F.size("tools") - shown + 1, F.lit(1)), F.lit(shown))
    numbered = F.when(F.size(calls) > 0, F.array_join(F.transform(calls, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")).otherwise("(none)")
    parts = [
        F.lit("SESSION HANDOFF"), F.concat(F.lit("Session: "), F.col("session_id").cast("string")), F.lit(""), F.lit("WHAT I WAS DOING"), F.col("summary"), F.lit(""), F.lit("ACTIVE GOALS"), lines(F.col("goals"), "(none)"), F.lit(""),
        F.lit("WORKING MEMORY (L1)"), lines(F.slice("l1", 1, 20), "(empty)"), F.lit(""), F.lit("FILES / ACTIVE CONTEXTS"), lines(F.col("active_contexts"), "(none)"), F.lit(""), F.lit("RECENT TOOL CALLS"), numbered,
    ]
    return snapshots.select("session_id", F.concat_ws("\n", *parts).alias("prompt"))


def project_summary(state: DataFrame) -> DataFrame:
    """One row of text: each key of a project's state (key, value JSON) with its value; items of lists with status and title."""
    value = F.col("value")
    item = "array<struct<status:string,title:string,name:string>>"
    titled = F.transform(F.from_json(value, item), lambda x: F.struct(x["status"].alias("s"), F.coalesce(x["title"], x["name"]).alias("t")))
    plain = F.transform(F.from_json(value, "array<string>"), lambda x: x)
    rows = F.when(value.startswith("[{"), F.transform(titled, lambda x: F.concat(F.when(F.coalesce(x["s"], F.lit("")) != "", F.concat(F.lit("["), x["s"], F.lit("] "))).otherwise(""), F.coalesce(x["t"], F.lit("")))))
    rows = rows.when(value.startswith("["), plain).when(value.startswith("{"), F.array(F.substring(value, 1, 200))).otherwise(F.array(F.regexp_replace(value, r'^"|"$', "")))
    lines = state.select("key", F.posexplode(rows).alias("i", "x")).select("key", "i", F.concat(F.lit("  "), "key", F.lit(": "), "x").alias("line"))
    return lines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "i", "line"))), lambda x: x["line"]), "\n").alias("summary"))
