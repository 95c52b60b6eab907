"""Toxicity severity by cumulative-link ordinal regression over sparse word features.

P(severity > k) = logistic(w . x - t_k): all ordered thresholds t_1 < t_2 < ... share the weights w of the words (and
beginnings of words) that a text has. An L1 penalty keeps the weights sparse, so words that say nothing weigh nothing, however long the text.

Cases: a null or empty text has no features and gets the base rate; a document without a label, or with a null one, is not learned from;
repeated rows count each; without any labels all severities are 0; other columns pass by unread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import crc32_mod, lighten, sampled

_WORD = re.compile(r"[^\W\d_]+")
#: Training takes about this many labelled documents of each grade, chosen by a hash of their id.
SAMPLE_PER_GRADE = 2500


#: Letters of a word's beginning that count as a feature of their own; they catch inflected and disguised forms.
PREFIX = 4


def features_of(text: str | None) -> set[str]:
    """The distinct lower-cased words of a whole text, and the beginnings of the longer ones, marked by a hyphen."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:PREFIX] + "-" for w in words if len(w) > PREFIX}


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class SeverityModel:
    """Sparse weights by word and ordered thresholds."""

    def __init__(self, weights: dict[str, float], thresholds: list[float]) -> None:
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, texts: list[set[str]], grades: np.ndarray, penalty: float | None = None, least_texts: int = 3, rounds: int = 25) -> SeverityModel:
        """Minimise the mean negative log-likelihood plus penalty * |w|, then refit the words that are left.

        Each round takes a quadratic model of the likelihood at the present weights and sweeps once over the features that
        are in use or whose gradient exceeds the penalty. The default penalty, 0.12 * sqrt(log(features) / texts), is
        above what chance gives to a feature that says nothing. The refit at a twentieth of it undoes the shrinking.
        """
        top = int(grades.max()) if len(grades) else 0
        if top == 0:
            return cls({}, [])
        seen: dict[str, int] = {}
        for t in texts:
            for w in t:
                seen[w] = seen.get(w, 0) + 1
        names = sorted(w for w, n in seen.items() if n >= least_texts)
        index = {w: i for i, w in enumerate(names)}
        rows = np.fromiter((i for i, t in enumerate(texts) for w in t if w in index), np.int64)
        cols = np.fromiter((index[w] for t in texts for w in t if w in index), np.int64)
        order = np.argsort(cols, kind="stable")
        by_feature = np.split(rows[order], np.cumsum(np.bincount(cols, minlength=len(names)))[:-1]) if names else []
        n = len(texts)
        if penalty is None:
            penalty = 0.12 * float(np.sqrt(np.log(len(names) + 2) / n))
        share = np.array([(grades > k).mean() for k in range(top)]).clip(1e-3, 1 - 1e-3)
        theta, w, eta = np.log((1 - share) / share), np.zeros(len(names)), np.zeros(n)
        for phase, cost in enumerate((penalty, penalty / 20)):
            support = np.flatnonzero(w) if phase else None
            for _ in range(rounds):
                bounds = np.concatenate(([-np.inf], theta, [np.inf]))
                up, low = _logistic(bounds[grades + 1] - eta), _logistic(bounds[grades] - eta)
                up[grades == top], low[grades == 0] = 1.0, 0.0
                p = np.maximum(up - low, 1e-9)
                du, dl = up * (1 - up), low * (1 - low)
                g, h = (du - dl) / p, np.maximum(du + dl, 1e-3)  # first and second derivative by eta
                grad = np.bincount(cols, g[rows], minlength=len(names)) / n
                use = support if phase else np.flatnonzero((w != 0) | (np.abs(grad) > cost))
                moved, shift = 0.0, np.zeros(n)
                for j in use:
                    at = by_feature[j]
                    a = float(h[at].sum()) / n
                    b = float((g[at] + h[at] * shift[at]).sum()) / n
                    z = w[j] - b / a
                    new = np.sign(z) * max(abs(z) - cost / a, 0.0)
                    if step := float(np.clip(new - w[j], -1, 1)):
                        w[j] += step
                        shift[at] += step
                        moved = max(moved, abs(step))
                eta += shift
                for k in range(top):  # each threshold by a damped Newton step
                    first = (dl[grades == k + 1] / p[grades == k + 1]).sum() - (du[grades == k] / p[grades == k]).sum()
                    second = dl[grades == k + 1].sum() + du[grades == k].sum() + 1e-3 * n
                    theta[k] -= float(np.clip(first / second, -1, 1))
                theta = np.sort(theta)
                if moved < 1e-3:
                    break
        return cls({x: float(w[i]) for x, i in index.items() if w[i]}, [float(x) for x in theta])

    def above(self, text: str | None) -> list[float]:
        """P(severity > k) for each threshold."""
        got = self.weights.keys() & features_of(text)
        eta = sum(self.weights[w] for w in sorted(got))
        return [float(_logistic(np.float64(eta - t))) for t in self.thresholds]


def grade_column(toxic: str = "toxic", quality: str = "quality"):
    """Ordered grades from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality; null without a label."""
    return F.when(F.col(toxic) == 0, 0).when(F.col(toxic) == 1, F.when(F.col(quality) == 0, 2).otherwise(1))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_grade: int = SAMPLE_PER_GRADE) -> SeverityModel:
    """Learn from a bounded sample of graded rows (id, grade); `per_grade` bounds what the driver gets."""
    graded = labels.where(F.col("grade").isNotNull()).select(F.col(id_col).alias("id"), F.col("grade").cast("int").alias("grade"))
    counts = {r[0]: r[1] for r in graded.groupBy("grade").count().collect()}
    chosen = sampled(graded, "grade", counts, per_grade, "id").orderBy(F.xxhash64("id"), "id", "grade").limit(4 * per_grade * max(1, len(counts)))
    # the sample is bounded by its parameter, so it may be broadcast
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([" ".join(sorted(features_of(t))) for t in b.column(1).to_pylist()], pa.string())], ["id", "grade", "words"])

    got = texts.mapInArrow(run, texts.select("id", "grade").schema.add("words", "string")).orderBy(F.xxhash64("id", "words"), "id", "grade", "words").limit(4 * per_grade * max(1, len(counts))).toPandas().sort_values(["id", "words"])
    return SeverityModel.fit([set(w.split()) for w in got["words"]], got["grade"].to_numpy(np.int64))


def score(docs: DataFrame, model: SeverityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, p_toxic, severity, toxic) of every row; severity is the likeliest grade."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            got = [model.above(t) or [0.0] for t in b.column(1).to_pylist()]
            grade = [int(np.argmax(-np.diff([1.0, *p, 0.0]))) if model.thresholds else 0 for p in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(p) for p in got], pa.float64()), pa.array([p[0] for p in got], pa.float64()), pa.array(grade, pa.int32()), pa.array([p[0] > 0.5 for p in got], pa.bool_())], ["id", "expected_severity", "p_toxic", "severity", "toxic"])

    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = part.select("id").schema.add("expected_severity", "double").add("p_toxic", "double").add("severity", "integer").add("toxic", "boolean")
    return part.mapInArrow(run, schema)


def op9_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document; labels of documents whose crc32 modulo 4 is 2 are held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", grade_column().alias("grade"))
    model = train(docs, labels.where(crc32_mod("doc_id", 4) != 2))
    out = score(docs, model)
    return out.select(F.col("id").alias("doc_id"), (crc32_mod("id", 4) == 2).alias("held_out"), "expected_severity", "p_toxic", "severity", "toxic")
