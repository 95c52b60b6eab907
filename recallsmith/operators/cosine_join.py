"""An exact cosine join of any number of vectors, by pivots and the triangle inequality.

The angle between unit vectors is a metric, and two are similar if it is at most `reach`, the threshold's angle. Each vector belongs to the cell of its nearest pivot,
there to a ring by its angle to the pivot, and, where a ring has many, to one of several parts. A vector y need not visit a cell whose pivot is further from y than the cell's
radius and the reach, nor one whose pivot is further from y than y's own pivot by more than twice the reach (every vector there is nearer to that pivot than to y's own),
nor a ring whose angles differ from y's by more than the reach. Parts are ordered, and a vector visits those before its own, so that a pair meets once.

Neighbouring parts are bundled, to SHARES bundles or, where these would be larger, to as many as BUNDLE_BYTES allows, and a vector is sent once to a bundle in which it must visit any
part: so a vector is shuffled a bounded number of times as long as a bundle may grow, however many parts there are. A task holds one bundle and lets the visitors pass by, tile by
tile; the visitors of a bundle are dealt to several tasks where they are many. Equal vectors
meet as one: copies are told as a star around the least id of their vector, so no group of copies is squared. How much is pruned depends on the data: clustered
vectors visit few cells, vectors without any structure visit all, and then the work is that of all pairs, but never more memory.

Pivots are a bounded sample, chosen by a hash; which ones they are changes the time taken, never the result.

Cases: null, empty and zero vectors, and those with a null or non-finite entry, are like nothing; vectors of different lengths are not compared; rows without an id drop out; of rows with one id and
one vector one is kept, and two vectors under one id are compared with others but not with each other; an empty table gives no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallsmith.sources.manifest import checkpoint_folder

#: Vectors of a part, visitors of a task, and pivots.
PART, VISITORS, PIVOTS = 2048, 1 << 16, 256
#: Bundles of parts, unless one had more bytes of vectors than the second number.
SHARES, BUNDLE_BYTES = 16, 16 << 20
#: Vectors of either side that are compared at once, which bounds what a task holds besides its bundle.
TILE = 1024


def unit_vectors(vectors: DataFrame, *keep: str) -> DataFrame:
    """(id, keep, embedding, v): v has length 1."""
    rows = vectors.where("id IS NOT NULL").select("id", *keep, F.col("embedding").cast("array<double>").alias("embedding"))
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x * x), F.lit(0.0), lambda s, x: s + x))
    # a null or non-finite entry makes the norm null or non-finite, and the row drops out
    return rows.withColumn("n", norm).where("n > 0 AND n < double('infinity')").select("id", *keep, "embedding", F.expr("transform(embedding, x -> x / n)").alias("v"))


class Cells:
    """Pivots of vectors of one length, with each cell's radius and the parts of its rings."""

    def __init__(self, pivots: np.ndarray, reach: float) -> None:
        self.pivots, self.reach = pivots, reach
        self.radius = np.zeros(len(pivots))
        self.parts: dict[tuple[int, int], int] = {}
        self.rows: dict[tuple[int, int], int] = {}

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))

    def ring(self, angle: np.ndarray) -> np.ndarray:
        return np.floor(angle / max(self.reach, 1e-3)).astype(np.int64)

    def bundles(self) -> dict[tuple[int, int, int], int]:
        """(cell, ring, part) -> bundle: parts in their order, as many as fit."""
        most = max(PART, min(-(-sum(self.rows.values()) // SHARES), BUNDLE_BYTES // (8 * max(1, self.pivots.shape[1]))))
        out, bundle, held = {}, 0, 0
        for at in sorted(self.parts):
            each = self.rows[at] / self.parts[at]
            for s in range(self.parts[at]):
                if held and held + each > most:
                    bundle, held = bundle + 1, 0
                out[(*at, s)], held = bundle, held + each
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _by_length(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by the length of their vectors."""
    sizes = b.column(at).value_lengths().to_numpy()
    for d in np.unique(sizes):
        yield int(d), b.take(pa.array(np.flatnonzero(sizes == d)))


def _fit(heads: DataFrame, reach: float, pivots: int) -> dict[int, Cells]:
    """The cells of heads (id, v) by the length of vectors; the driver gets the pivots, a radius for each, and the size of each ring."""
    count = heads.count()
    wanted = min(pivots, max(1, 4 * count // PART))  # cells of a quarter of a part: smaller ones cost more visits than they prune
    chosen = [np.array(r["v"]) for r in heads.orderBy(F.xxhash64("id"), "id").select("v").limit(wanted).collect()]
    cells = {d: Cells(np.array([p for p in chosen if len(p) == d]), reach) for d in {len(p) for p in chosen}}

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for d, x in _by_length(b, 0):
                cell, angle, ring = _placed(cells.get(d), _matrix(x.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), d)), pa.array(cell), pa.array(ring), pa.array(angle)], ["d", "cell", "ring", "angle"])

    sizes = heads.select("v").mapInArrow(assign, "d long, cell long, ring long, angle double").groupBy("d", "cell", "ring").agg(F.max("angle").alias("far"), F.count("*").alias("n"))
    for r in sizes.collect():
        own = cells.setdefault(r["d"], Cells(np.zeros((0, r["d"])), reach))
        if len(own.pivots):
            own.radius[r["cell"]] = max(own.radius[r["cell"]], r["far"])
        own.parts[r["cell"], r["ring"]], own.rows[r["cell"], r["ring"]] = -(-r["n"] // PART), r["n"]
    return cells


def _placed(cells: Cells | None, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, angle to its pivot, ring) of vectors; without a pivot of their length they share one cell and ring."""
    if cells is None or not len(cells.pivots):
        return np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(x), np.int64)
    angles = cells.angles(x)
    cell = angles.argmin(1)
    angle = angles[np.arange(len(x)), cell]
    return cell, angle, cells.ring(angle)


def _visits(heads: DataFrame, cells: dict[int, Cells]) -> DataFrame:
    """(part, visitor, id, v): each vector once as a member of its bundle of parts (visitor false), and once for each bundle before that in which it must visit a part."""
    bundles, starts, total = {d: own.bundles() for d, own in cells.items()}, {}, 0
    for d in sorted(bundles):
        starts[d], total = total, total + max(bundles[d].values(), default=-1) + 1
    slack = 1e-9

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rings: dict[int, dict[int, np.ndarray]] = {}
        for d, known in bundles.items():
            rings[d] = {k: np.array(sorted({(c, r) for (c, r, _), n in known.items() if n == k})) for k in set(known.values())}
        for b in (b.slice(start, TILE) for b in it for start in range(0, b.num_rows, TILE)):
            for d, rows in _by_length(b, 1):
                own, known = cells[d], bundles[d]
                x, salt = _matrix(rows.column(1)), rows.column(2).to_numpy()
                cell, nearest, ring = _placed(own, x)
                mine = np.array([known[c, r, s % own.parts[c, r]] for c, r, s in zip(cell.tolist(), ring.tolist(), salt.tolist(), strict=True)], np.int64)
                at, part = [np.arange(len(x))], [mine]
                if len(own.pivots):
                    reach, angles = own.reach + slack, own.angles(x)
                    near = (angles <= own.radius + reach) & (angles <= nearest[:, None] + 2 * reach)
                    low, high = own.ring(np.maximum(angles - reach, 0)), own.ring(angles + reach)
                for k, within in rings[d].items():
                    c, r = within.T
                    must = (near[:, c] & (low[:, c] <= r) & (r <= high[:, c])).any(1) if len(own.pivots) else np.ones(len(x), bool)
                    who = np.flatnonzero(must & (mine > k))
                    at.append(who)
                    part.append(np.full(len(who), k))
                at, part = np.concatenate(at), np.concatenate(part)
                got = rows.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(part + starts[d]), pa.array(np.arange(len(at)) >= len(x)), got.column(0), got.column(1)], ["part", "visitor", "id", "v"])

    rows = heads.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("salt"))
    return rows.mapInArrow(run, f"part long, visitor boolean, id {heads.schema['id'].dataType.simpleString()}, v array<double>")


def _met(visits: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) of the pairs that are similar, of visits (part, visitor, id, v); the vectors of a part have one length."""
    id_type = visits.schema["id"].dataType.simpleString()
    # the visitors of a part are dealt to tasks by their number; each of these tasks has the part
    tasks = visits.groupBy("part").agg(F.ceil(F.count_if("visitor") / VISITORS).cast("int").alias("tasks"))
    dealt = visits.join(tasks, "part").withColumn("tasks", F.greatest("tasks", F.lit(1)))
    own = F.when(F.col("visitor"), F.array(F.pmod(F.xxhash64("id"), F.col("tasks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("tasks") - 1))
    rows = dealt.select("part", F.explode(own).alias("task"), "visitor", "id", "v").repartition("part", "task").sortWithinPartitions("part", "task", "visitor")
    least = threshold - 1e-6  # what may be rounded to the threshold

    def pairs(left: pa.Array, x: np.ndarray, right: pa.Array, y: np.ndarray, upper: bool = False) -> pa.RecordBatch:
        sim = x @ y.T
        i, j = np.nonzero(np.triu(sim >= least, 1) if upper else sim >= least)
        told = np.round(sim[i, j], 6)
        kept = told >= threshold
        return pa.RecordBatch.from_arrays([left.take(pa.array(i[kept])), right.take(pa.array(j[kept])), pa.array(told[kept])], ["x", "y", "sim"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in it:
            part, task, visitor = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            codes = part.dictionary_encode().indices.to_numpy()
            cuts = np.flatnonzero((np.diff(codes) != 0) | (np.diff(task) != 0) | (np.diff(visitor.astype(int)) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)], strict=True) if len(part) else ():
                if (now := (part[start].as_py(), task[start])) != key:
                    key, held = now, []
                for at in range(start, stop, TILE):
                    rows = b.slice(at, min(TILE, stop - at))
                    own, x = rows.column(3), _matrix(rows.column(4))
                    if visitor[start] or task[start] == 0:  # the members among themselves, in one of the tasks
                        for ids, y in held:
                            yield pairs(own, x, ids, y)
                        if not visitor[start]:
                            yield pairs(own, x, own, x, True)
                    if not visitor[start]:
                        # own memory, so that the batch can go
                        held.append((pa.concat_arrays([own]) if own.offset == 0 else own.take(pa.array(np.arange(len(own)))), np.array(x)))

    met = rows.mapInArrow(run, f"x {id_type}, y {id_type}, sim double")
    return met.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "sim")


def similar_in_blocks(unit: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim) with a < b of the similar pairs of one block, of rows (id, block, v of length 1); rows without a block are like nothing.

    A block is cut into parts of bounded bytes by a hash of ids; a row is a member of its own and visits those before it.
    """
    rows = unit.where("block IS NOT NULL").withColumn("d", F.size("v"))
    sizes = rows.groupBy("block", "d").agg(F.count("*").alias("n"))
    room = F.greatest(F.floor(F.lit(BUNDLE_BYTES / 8) / F.col("d")), F.lit(PART))
    dealt = rows.join(sizes.select("block", "d", F.ceil(F.col("n") / room).alias("parts")), ["block", "d"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    visits = dealt.select("block", "d", "own", "id", "v", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("k"))
    return _met(visits.select(F.concat_ws("|", F.col("block").cast("string"), "d", "k").alias("part"), (F.col("k") < F.col("own")).alias("visitor"), "id", "v"), threshold)


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(heads, copies): the least id (id, v) of each different vector, and (a, b), each other id with the head of its vector."""
    checkpoint_folder(vectors.sparkSession)
    unit = unit_vectors(vectors)
    groups = unit.groupBy("embedding").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.first("v").alias("v")).checkpoint()
    several = groups.where("z > a").select("embedding", "a")
    copies = unit.join(several, "embedding").where("id > a").select("a", F.col("id").alias("b")).distinct()
    return groups.select(F.col("a").alias("id"), "v"), copies


def similar_heads(heads: DataFrame, threshold: float, pivots: int = PIVOTS) -> DataFrame:
    """(a, b, sim) with a < b of all pairs of different vectors (id, v) with a cosine, to six places, of the threshold or more."""
    reach = math.acos(max(-1.0, min(1.0, threshold - 1e-6))) + 1e-6
    return _met(_visits(heads, _fit(heads, reach, pivots)), threshold)


def similar_classes(vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b, sim): all similar pairs of different vectors, by the least id of each, and each copy with the least id of its vector at 1."""
    heads, copies = classes(vectors)
    return similar_heads(heads, threshold).unionByName(copies.withColumn("sim", F.lit(1.0)))
