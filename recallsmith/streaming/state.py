"""Working memory and notifications as state of a stream, with timers and time to live.

Both take a stream of changes and hold, for each owner, a bounded map in the state store; what they emit is a log of changes, from which current() tells what is held. They need the
state store that stateful() sets. A restart goes on from the checkpoint; a replayed batch finds the state it found before.

Changes of an owner within a batch are applied in the order of time, then id. An owner's changes pass through one task, as its memory is one thing; what a task holds of
it is bounded by the memory's size, whatever arrives.

Cases: changes without an owner or an id are left out; unknown ids may be read, removed or dismissed; a null importance is 0.5; a repeated notification keeps its first form.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOG = "owner string, id string, change string, content string, at timestamp, seq long"
#: Rows that are made Python objects, or a frame, at a time.
PIECE = 1 << 16


def stateful(spark: SparkSession) -> None:
    """The state store that maps and timers need; streams that were started with another one can't change to it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _seconds(at: pd.Timestamp) -> float:
    return at.value / 1e9


def _ordered(batches: Iterator[pd.DataFrame]) -> list[tuple]:
    rows = [r for b in batches for r in b.itertuples(index=False)]
    return sorted(rows, key=lambda r: (r.at, r.id))


def _told(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(id, kind, content, importance, at in nanoseconds) of changes, in the order of time, then id."""
    parts = [b[["id", "kind", "content", "importance", "at"]] for b in batches]
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True).sort_values(["at", "id"], kind="stable", ignore_index=True)
    at = rows["at"].astype("datetime64[ns]").astype("int64")
    for k in range(0, len(rows), PIECE):
        part = rows.iloc[k : k + PIECE]
        yield from zip(*(part[c].tolist() for c in ("id", "kind", "content", "importance")), at.iloc[k : k + PIECE].tolist(), strict=True)


def _standing(i: str, entry: list) -> tuple:
    """What orders entries: the last access with a share of the importance; of equal ones the later id goes first."""
    return entry[2] + 0.3 * entry[1], [-ord(c) for c in i], i


class _Memory(StatefulProcessor):
    """The entries of an owner; beyond `most` the one with the least last access + 0.3 * importance goes."""

    def __init__(self, most: int, ttl_ms: int | None) -> None:
        self.most, self.ttl_ms, self.heap = most, ttl_ms, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "id string", "content string, importance double, accessed double, reads long", self.ttl_ms)
        self.count = handle.getValueState("seq", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = {k[0]: list(v) for k, v in self.held.iterator()}
        seq, before, log, last = (self.count.get()[0] if self.count.exists() else 0), dict.fromkeys(held), {}, None
        for last in _told(rows):
            i, kind, content, importance, at = last
            if kind == "put":
                weight = 0.5 if importance is None or pd.isna(importance) else min(max(importance, 0.0), 1.0)
                held[i] = [content, weight, at / 1e9, held[i][3] if i in held else 0]
                log[i] = ("put", content, at)
                self._push(i, held)
                if len(held) > self.most:
                    out = self._least(held)
                    del held[out]
                    log[out] = ("evicted", None, at)
            elif i in held:
                if kind == "remove":
                    del held[i]
                    log[i] = ("removed", None, at)
                elif kind == "get":
                    held[i][2:] = [at / 1e9, held[i][3] + 1]
                    self._push(i, held)
        self.heap = None
        for gone in before.keys() - held.keys():
            self.held.removeKey((gone,))
        for i, v in held.items():
            self.held.updateValue((i,), tuple(v))
        if last is not None:
            self.count.update((seq + 1,))
        # of an entry that came and went within the batch only its end is told
        ids, columns = sorted(log), [c.split()[0] for c in LOG.split(", ")]
        for part in (ids[k : k + PIECE] for k in range(0, len(ids), PIECE)):
            what, content, at = zip(*(log[i] for i in part), strict=True)
            told = [[key[0]] * len(part), part, list(what), list(content), pd.to_datetime(pd.Series(at, dtype="int64")), [seq + 1] * len(part)]
            yield pd.DataFrame(dict(zip(columns, told, strict=True)))

    def _push(self, i: str, held: dict[str, list]) -> None:
        """Note the standing of an entry that was put or read; what the heap has of it from before is passed over."""
        if self.heap is None or len(self.heap) > 8 * (len(held) + self.most):
            self.heap = [_standing(x, held[x]) for x in held]
            heapq.heapify(self.heap)
        else:
            heapq.heappush(self.heap, _standing(i, held[i]))

    def _least(self, held: dict[str, list]) -> str:
        """The entry that goes first."""
        while True:
            worth, _, i = heapq.heappop(self.heap)
            if i in held and worth == held[i][2] + 0.3 * held[i][1]:
                return i

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from ()

    def close(self) -> None:
        pass


def working_memory(changes: DataFrame, most: int = 100, ttl_ms: int | None = None) -> DataFrame:
    """The log of a working memory of `most` entries for each owner.

    changes: (owner, id, kind put, get or remove, content, importance, at). With a time to live, entries that were not written for so long in
    processing time are forgotten by the store itself.
    """
    stateful(changes.sparkSession)
    rows = changes.where("owner IS NOT NULL AND id IS NOT NULL").select(F.col("owner").cast("string"), F.col("id").cast("string"), "kind", "content", "importance", F.col("at").cast("timestamp"))
    return rows.groupBy("owner").transformWithStateInPandas(_Memory(most, ttl_ms), LOG, "Append", "None")


class _Notifications(StatefulProcessor):
    """The queue of an owner: beyond `most` the oldest goes; what is older than the time to live is taken out by a timer."""

    def __init__(self, most: int, ttl_ms: int) -> None:
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getMapState("queue", "id string", "content string, at double")
        self.count = handle.getValueState("seq", "n long")

    def _log(self, key, told: dict) -> Iterator[pd.DataFrame]:
        if told:
            seq = (self.count.get()[0] if self.count.exists() else 0) + 1
            self.count.update((seq,))
            yield pd.DataFrame([(key[0], i, what, content, pd.Timestamp(at, unit="s"), seq) for i, (what, content, at) in sorted(told.items())], columns=[c.split()[0] for c in LOG.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        queue, told = {k[0]: tuple(v) for k, v in self.queue.iterator()}, {}
        before = set(queue)
        for r in _ordered(rows):
            at = _seconds(r.at)
            if r.kind == "notify" and r.id not in queue and told.get(r.id, ("",))[0] != "dismissed":
                queue[r.id] = (r.content, at)
                told[r.id] = ("queued", r.content, at)
                if len(queue) > self.most:
                    oldest = min(queue, key=lambda i: (queue[i][1], i))
                    del queue[oldest]
                    told[oldest] = ("evicted", None, at)
            elif r.kind == "dismiss" and r.id in queue:
                del queue[r.id]
                told[r.id] = ("dismissed", None, at)
        for i in before - queue.keys():
            self.queue.removeKey((i,))
        for i in queue.keys() - before:
            self.queue.updateValue((i,), queue[i])
            self.handle.registerTimer(int(queue[i][1] * 1000) + self.ttl_ms)
        yield from self._log(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000
        old = {k[0]: ("expired", None, now) for k, v in self.queue.iterator() if v[1] + self.ttl_ms / 1000 <= now}
        for i in old:
            self.queue.removeKey((i,))
        yield from self._log(key, old)

    def close(self) -> None:
        pass


def notifications(changes: DataFrame, ttl_seconds: int = 600, most: int = 50, late: str = "1 hour") -> DataFrame:
    """The log of each owner's queue of notifications; changes: (owner, id, kind notify or dismiss, content, at).

    Time is that of the events: a notification expires when the watermark, which is `late` behind the newest event, has passed its time to live.
    """
    stateful(changes.sparkSession)
    rows = changes.where("owner IS NOT NULL AND id IS NOT NULL").select(F.col("owner").cast("string"), F.col("id").cast("string"), "kind", "content", F.col("at").cast("timestamp"))
    return rows.withWatermark("at", late).groupBy("owner").transformWithStateInPandas(_Notifications(most, ttl_seconds * 1000), LOG, "Append", "EventTime")


def current(log: DataFrame) -> DataFrame:
    """(owner, id, content, at) of what is held after a log: the last change of each id puts or queues it."""
    last = log.withColumn("r", F.row_number().over(Window.partitionBy("owner", "id").orderBy(F.desc("seq")))).where("r = 1")
    return last.where("change IN ('put', 'queued')").select("owner", "id", "content", "at")


def restored(held: DataFrame, owner: str, at) -> DataFrame:
    """Changes that put what one session held into another's memory, as when it is resumed; held: current() of a log."""
    return held.select(F.lit(owner).alias("owner"), "id", F.lit("put").alias("kind"), "content", F.lit(0.5).alias("importance"), at.cast("timestamp").alias("at"))
