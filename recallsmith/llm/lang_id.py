"""Language identification by hierarchical discrimination.

A linear support vector machine for each pair of language families tells the family; within it, one-versus-one linear
support vector machines separate the related languages. Features are hashed byte n-grams of the whole lower-cased text.

Cases: a null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn from; a
language that no family lists belongs to the family `other`, or, if there are more than FAMILY_SIZE of these, to one of several such families of
like languages; every value of `lang` is learned, from fewer rows each where there are very many; repeated rows
count each; a null id passes through; very long texts are read whole, in chunks; other columns pass by unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import crc32_mod, lighten, sampled

#: Language codes of each family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
}
UNDETERMINED = "und"
DIMENSIONS = 1 << 12
#: Training takes about this many labelled documents of each language, chosen by a hash of id and text.
SAMPLE_PER_LANGUAGE = 300
#: Training takes about this many labelled documents in all.
SAMPLE_ROWS = 20_000
#: Languages of a family that is formed here, of those that FAMILIES doesn't list: machines are trained for each pair within a family.
FAMILY_SIZE = 16
_CHUNK = 1 << 18


def gram_counts(text: str) -> np.ndarray:
    """Counts of the hashed byte bigrams, trigrams and 4-grams of a text, taken in chunks."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    out = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(data), _CHUNK):
        x = data[at : at + _CHUNK + 3].astype(np.uint32)
        h = x * np.uint32(0x9E3779B1)
        for k in (1, 2, 3):
            if len(x) <= k:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + x[k:] * np.uint32(0xC2B2AE35)
            out += np.bincount((h[:_CHUNK] ^ (h[:_CHUNK] >> np.uint32(13))) & np.uint32(DIMENSIONS - 1), minlength=DIMENSIONS)
    return out


def _unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts, dtype=np.float32)
    return x / max(float(np.linalg.norm(x)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of a linear L2-loss support vector machine by dual coordinate descent; y is +1 or -1."""
    rng, n = np.random.default_rng(seed), len(x)
    w, alpha = np.zeros(x.shape[1], np.float32), np.zeros(n)
    diagonal = np.einsum("ij,ij->i", x, x) + 0.5 / cost
    for _ in range(epochs):
        for i in rng.permutation(n):
            g = y[i] * float(x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            new = max(alpha[i] - g / diagonal[i], 0.0)
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                alpha[i] = new
    return w


class OneVersusOne:
    """A support vector machine for each pair of labels; the label with most votes wins, then the greater margins."""

    def __init__(self, labels: list[str], x: np.ndarray, y: np.ndarray) -> None:
        self.labels = labels
        self.pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
        rows = []
        for i, j in self.pairs:
            at = np.flatnonzero((y == labels[i]) | (y == labels[j]))
            rows.append(fit_svm(x[at], np.where(y[at] == labels[i], 1.0, -1.0)))
        self.weights = np.array(rows, np.float32).reshape(-1, x.shape[1])

    def decide(self, x: np.ndarray) -> tuple[str, float]:
        """(label, confidence from 0 to 1): the logistic of the winner's least margin."""
        if len(self.labels) == 1:
            return self.labels[0], 1.0
        margins = self.weights @ x
        votes, least = np.zeros(len(self.labels)), np.full(len(self.labels), np.inf)
        for (i, j), m in zip(self.pairs, margins, strict=True):
            for k, v in ((i, m), (j, -m)):
                votes[k] += (v > 0) + 1e-3 * np.tanh(v)
                least[k] = min(least[k], v)
        best = int(np.argmax(votes))
        return self.labels[best], float(1 / (1 + np.exp(-4 * least[best])))


def other_families(x: np.ndarray, langs: np.ndarray, unlisted: list[str]) -> dict[str, str]:
    """The family of each language that FAMILIES doesn't list: the first one left and those whose mean features are the nearest to its own."""
    if len(unlisted) <= FAMILY_SIZE:
        return dict.fromkeys(unlisted, "other")
    means, left, out = {v: _unit(np.square(x[langs == v].mean(0))) for v in unlisted}, list(unlisted), {}
    while left:
        mine = sorted(left, key=lambda v: (v != left[0], -float(means[left[0]] @ means[v]), v))[:FAMILY_SIZE]
        out |= dict.fromkeys(mine, f"other {left[0]}")
        left = [v for v in left if v not in mine]
    return out


class LanguageModel:
    """Family first, then the language within it."""

    def __init__(self, x: np.ndarray, langs: np.ndarray, families: dict[str, list[str]] = FAMILIES) -> None:
        of = {lang: family for family, members in families.items() for lang in members}
        of |= other_families(x, langs, sorted(set(langs) - set(of)))
        family = np.array([of[v] for v in langs])
        self.top = OneVersusOne(sorted(set(family)), x, family) if len(langs) else None
        self.within = {f: OneVersusOne(sorted(set(langs[family == f])), x[family == f], langs[family == f]) for f in sorted(set(family))}

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score) of a whole text."""
        if not text or self.top is None or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        x = _unit(gram_counts(text))
        family, sure = self.top.decide(x)
        lang, surer = self.within[family].decide(x)
        return lang, sure * surer


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from a bounded sample of the rows with a language; `per_language` bounds what the driver gets."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), np.array([], object))
    per_language = max(1, min(per_language, SAMPLE_ROWS // len(counts)))
    sample = sampled(known, "lang", counts, per_language, "id", "text").select("lang", "text", F.xxhash64("id", "text").alias("h"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            out = []
            for t in b.column(1).to_pylist():
                c = gram_counts(t)
                at = np.flatnonzero(c)
                out.append(at.astype("<u4").tobytes() + c[at].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)], ["lang", "grams", "h"])

    # repeated rows share a hash and may outgrow the sample; which of them stay makes no difference
    got = sample.mapInArrow(run, "lang string, grams binary, h long").orderBy("h", "lang", "grams").limit(2 * per_language * len(counts)).toPandas().sort_values(["lang", "grams"])
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    for i, data in enumerate(got["grams"]):
        at, c = np.frombuffer(data, "<u4").reshape(2, -1)
        x[i, at] = _unit(c)
    return LanguageModel(x, got["lang"].to_numpy())


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its text alone."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["id", "lang_pred", "score"])

    part = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return part.mapInArrow(run, part.select("id").schema.add("lang_pred", "string").add("score", "double"))


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", least_score: float = 0.05) -> DataFrame:
    """The rows, with all their columns, whose language is determined with a score of `least_score` or more; no shuffle."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            got = [model.predict(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            yield b.filter(pa.array([lang != UNDETERMINED and s >= least_score for lang, s in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 modulo 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.where(crc32_mod("doc_id", 4) != 2))
    out = identify(docs, model)
    return out.select(F.col("id").alias("doc_id"), (crc32_mod("id", 4) == 2).alias("held_out"), "lang_pred", "score")
