"""Whitening of embeddings from one aggregation of all products of two dimensions.

Entries become whole numbers, x = floor(1024 * c) + 100000. The first pass counts the vectors and sums each dimension exactly. The second is a single
aggregation of generated SQL expressions, the sums of centred products of all pairs of dimensions i <= j, the upper triangle of the covariance; its size
does not depend on the rows, and partial sums run before the shuffle. LAPACK decomposes it on the driver. The rows are then projected batch by batch on the
few components, so nothing of the data is gathered or broadcast.

Cases: vectors that are null, empty, or hold a null, NaN or infinite entry drop out, and so do those of another length than most have (of equally common
lengths the greatest counts). Components without variance (an eigenvalue below RANK_TOLERANCE of the trace) can't be scaled to 1 and are left out, so equal
vectors, or one vector, give no rows, and an empty table gives an empty result. Repeated rows count each; rows without an id are kept; ties between
eigenvalues keep LAPACK's order. Entries beyond 2**50 count as 2**50, and a deviation that doesn't
fit into a long is null. Other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import bounded_batches, lighten, materialise

SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond this would not fit into a long and count as this.
MOST = 2.0**60
COMPONENTS = 8
#: Columns on each side of a tile of the upper triangle.
SIDE = 8
#: Eigenvalues below this share of the trace are rounding, not variance.
RANK_TOLERANCE = 1e-12


def whole_numbers(vector: Column) -> Column:
    """A vector's entries as whole numbers; null unless all of them are finite."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = lambda c: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), c.cast("double") * SCALE))
    # the condition guards the conversion, which fails on entries that aren't finite
    return F.when(finite, F.transform(vector, lambda c: F.floor(held(c)).cast("bigint") + SHIFT))


def quantised(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<bigint>) of the vectors that have only finite entries, and one at least."""
    return rows.select(F.col(id_col).alias("id"), whole_numbers(F.col(vector_col)).alias("x")).where(F.size("x") > 0)


def usual_length(x: DataFrame) -> int:
    """The length that most vectors have; 0 without vectors."""
    row = x.groupBy(F.size("x").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("m")).first()
    return row["m"]["d"] if row["m"] else 0


def _column(i: int) -> str:
    return f"x[{i}]"


def first_moments(x: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of their dimensions."""
    get = [_column(i) for i in range(d)]
    row = x.agg(F.count("*").alias("n"), *(F.expr(f"try_sum({c})").alias(f"s{i}") for i, c in enumerate(get))).first()
    if row["n"] and None in row:  # a sum beyond 64 bits
        row = x.agg(F.count("*").alias("n"), *(F.expr(f"sum(cast({c} as decimal(20,0)))").alias(f"s{i}") for i, c in enumerate(get))).first()
    return row["n"], [int(row[f"s{i}"] or 0) for i in range(d)]


def pair_expressions(side: int = SIDE) -> list[str]:
    """SQL for the sums of products of each pair of a tile's columns."""
    return [f"sum(u{i} * v{j}) AS p{i}_{j}" for i in range(side) for j in range(side)]


def covariance(x: DataFrame, n: int, means: list[float]) -> np.ndarray:
    """The covariance of the columns of x, divisor n, from one aggregation of the products of all pairs.

    The upper triangle is laid out in square tiles of SIDE columns by SIDE, and each row meets every tile: one expression for each pair of a tile's columns,
    grouped by the tile, keeps the generated code small enough to be compiled, where one expression for every pair of the table is not.
    """
    d, across = len(means), -(-len(means) // SIDE)
    tiles = [(a, b) for a in range(across) for b in range(a, across)]
    centre = F.zip_with("x", F.array(*map(F.lit, means)), lambda v, m: v.cast("double") - m)
    rows = x.select(F.concat(centre, F.array_repeat(F.lit(0.0), across * SIDE - d)).alias("c"))
    # the places of a tile's first row and first column are constants; a table of tiles is no data
    dealt = rows.select("c", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a * SIDE).alias("a"), F.lit(b * SIDE).alias("b")) for k, (a, b) in enumerate(tiles)))).alias("t"))
    sides = dealt.selectExpr("t.k AS k", *(f"c[t.a + {i}] AS u{i}" for i in range(SIDE)), *(f"c[t.b + {j}] AS v{j}" for j in range(SIDE)))
    out = np.zeros((across * SIDE, across * SIDE))
    for row in sides.groupBy("k").agg(*map(F.expr, pair_expressions())).collect():  # one row for each tile
        a, b = tiles[row["k"]]
        out[a * SIDE : (a + 1) * SIDE, b * SIDE : (b + 1) * SIDE] = np.array(row[1:]).reshape(SIDE, SIDE)
    upper = np.triu(out[:d, :d]) / n
    return upper + np.triu(upper, 1).T


def decompose(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows), greatest first, of the up to `most` components that have variance.

    The sign, which is free, makes the greatest entry positive.
    """
    e, vectors = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:most]
    order = order[e[order] > RANK_TOLERANCE * max(float(np.trace(v)), 0.0)]
    e, vectors = e[order], vectors[:, order].T
    signs = np.array([np.sign(r[np.argmax(np.abs(r))]) for r in vectors])
    return e, vectors * signs[:, None] if len(e) else vectors


class Whitening:
    """Means, components and their shares, fitted to all vectors of a table."""

    def __init__(self, n: int, sums: list[int], eigenvalues: np.ndarray, vectors: np.ndarray, trace: float) -> None:
        self.n, self.sums, self.eigenvalues, self.vectors, self.trace = n, sums, eigenvalues, vectors, trace
        self.means = [s / n for s in sums] if n else []

    @classmethod
    def fit(cls, x: DataFrame, components: int = COMPONENTS) -> Whitening:
        d = usual_length(x)
        if not d:
            return cls(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
        x = x.where(F.size("x") == d)
        n, sums = first_moments(x, d)
        v = covariance(x, n, [s / n for s in sums])
        return cls(n, sums, *decompose(v, components), float(np.trace(v)))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """For each row of x, the sum over dimensions of (n * x - S) squared, exact; None beyond 64 bits."""
        rough = ((x.astype(np.float64) - self.means) ** 2).sum(1) * float(self.n) ** 2
        if rough.max(initial=0) < 2.0**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(1).tolist()
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(1)
        return [v if v < 1 << 63 else None for v in exact]

    def apply(self, x: DataFrame) -> DataFrame:
        """(id, deviation, whitened array<double>) of the vectors x (id, x) of the usual length."""
        d, weights, means = len(self.means), self.vectors / np.sqrt(self.eigenvalues)[:, None], np.array(self.means)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lighten()
            for b in it:
                entries = b.column(1).flatten().to_numpy().reshape(-1, d)
                w = (entries - means) @ weights.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(self.deviation(entries), pa.int64()), lists], ["id", "deviation", "whitened"])

        rows = x.where(F.size("x") == d) if len(self.eigenvalues) else x.limit(0)
        return rows.mapInArrow(run, f"id {x.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")

    def identity_error(self, rows: DataFrame) -> float:
        """The largest absolute entry of the covariance of whitened rows, minus the identity."""
        k = len(self.eigenvalues)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = rows.agg(F.lit(0.0), *(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))) for i, j in pairs)).first()[1:]
        return max((abs(v - (i == j)) for v, (i, j) in zip(got, pairs, strict=True)), default=0.0)


def whiten(spark: SparkSession, rows: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Whitening]:
    """(id, deviation, whitened) of the rows that have a usable vector, written to shared storage; and what was fitted to them."""
    bounded_batches(spark)
    x = quantised(rows, id_col, vector_col)
    fitted = Whitening.fit(x, components)
    return materialise(spark, fitted.apply(x), "whitened"), fitted


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight whitened components of every embedding, fitted to all of them."""
    rows, fitted = whiten(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    shares = F.array(*(F.lit(float(e / fitted.trace)) for e in fitted.eigenvalues)).cast("array<double>")
    each = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(fitted.identity_error(rows)).alias("identity_error"))
