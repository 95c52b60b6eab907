"""Streams with large batches."""

import random

import pandas as pd

from recallsmith.streaming import consumer, state


class _Map(dict):
    def iterator(self):
        return iter([((k,), v) for k, v in self.items()])

    def removeKey(self, key):  # noqa: N802
        del self[key[0]]

    def updateValue(self, key, value):  # noqa: N802
        self[key[0]] = value


class _Value:
    now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value


def _plain(held, rows, most):
    """The rule by a look at all entries."""
    log = {}
    for i, kind, content, importance, at in sorted(rows, key=lambda r: (r[4], r[0])):
        if kind == "put":
            held[i] = [content, 0.5 if importance is None else min(max(importance, 0.0), 1.0), at.value / 1e9, held[i][3] if i in held else 0]
            log[i] = ("put", content, at)
            if len(held) > most:
                out = min(held, key=lambda x: (held[x][2] + 0.3 * held[x][1], [-ord(c) for c in x]))
                del held[out]
                log[out] = ("evicted", None, at)
        elif i in held and kind == "remove":
            del held[i]
            log[i] = ("removed", None, at)
        elif i in held:
            held[i][2:] = [at.value / 1e9, held[i][3] + 1]
    return log


def test_a_large_batch_of_an_owner_is_told_in_pieces(monkeypatch):
    """Puts, reads and removals in any order, with many ties, leave and tell what a look at all entries does; a piece is a frame of its own."""
    monkeypatch.setattr(state, "PIECE", 64)
    rng, memory = random.Random(4), state._Memory(12, None)
    memory.held, memory.count = _Map(), _Value()
    held = {}
    for batch in range(4):
        rows = [(f"e{rng.randrange(10 ** rng.randrange(1, 4))}", rng.choice(["put", "put", "put", "get", "remove"]), f"c{k}", rng.choice([None, 0.0, 0.5, 2.0]), pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=300 * (rng.randrange(400) + 300 * batch))) for k in range(900)]
        rows = list({(r[4], r[0]): r for r in rows}.values())  # one change of an id at an instant
        frame = pd.DataFrame(rows, columns=["id", "kind", "content", "importance", "at"])
        got = list(memory.handleInputRows(("a",), iter([frame[:300], frame[300:]]), None))
        want = _plain(held, rows, 12)
        told = pd.concat(got)
        assert {r.id: (r.change, r.content, r.at) for r in told.itertuples()} == want and len(told) == len(want) and set(told["seq"]) == {batch + 1}
        assert len(got) > 1 and max(map(len, got)) == 64
        assert {k: list(v) for k, v in memory.held.items()} == held


def test_a_batch_of_many_bytes_is_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(consumer, "FILE_BYTES", 1 << 10)
    rows = spark.range(4000).select("id").withColumnRenamed("id", "event_id")
    stream, seen = consumer.in_files(rows, f"file://{tmp_path}/in"), {}

    def note(batch, number):
        seen[number] = [r[0] for r in batch.collect()]

    stream.writeStream.foreachBatch(note).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 4 and sorted(x for ids in seen.values() for x in ids) == list(range(4000))
    assert len(list((tmp_path / "in").glob("part-*"))) >= 8
