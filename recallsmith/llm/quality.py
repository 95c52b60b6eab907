"""Host-level quality rules: rule failures by domain, shrunk by an empirical beta prior, joined back to documents.

Each document is measured and tested against rules. A host's failure rate is the mean of its beta posterior; the prior is
fitted by moments to the rates of all hosts, so small hosts lean to the common rate. Documents of a host whose posterior
rate lies beyond the limit by two posterior standard deviations are rejected with it.

Cases: a null text has no words and fails the base rule; a null host gives no host verdict; repeated rows count each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm.common import lighten, materialise

_BLANK = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Up to this many hosts, with so many bytes of names, the table of hosts may be broadcast; beyond, each host is joined in SALTS parts.
BROADCAST_HOSTS, BROADCAST_BYTES, SALTS = 50_000, 8 << 20, 32


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip(_BLANK)]
    repeated = 0
    if n > WINDOW:
        whole = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = [0, *(ends[: n - WINDOW] + 1).tolist()]
        windows = [whole[a:b] for a, b in zip(starts, ends[WINDOW - 1 :].tolist(), strict=True)]
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            at = np.flatnonzero(np.fromiter((seen[w] > 1 for w in windows), bool, len(windows)))
            covered = np.zeros(n, bool)
            for k in range(WINDOW):
                covered[at + k] = True
            repeated = int(covered.sum())
    blanks = len(data) - len(data.translate(None, _BLANK))
    return n, len(text) - blanks, len(data) - len(data.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the five measures) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lighten()
        for b in it:
            got = np.array([measure(t) for t in b.column(2).to_pylist()], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(got[:, k]) for k in range(5))], ["id", "host", *MEASURES])

    part = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    schema = part.select("id", "host").schema
    for m in MEASURES:
        schema = schema.add(m, "long")
    return part.mapInArrow(run, schema)


def host_rules(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most_rate: float = 0.6) -> DataFrame:
    """(id, the measures, base_failed, rules_failed, host_rate, kept) of every row.

    Rules: base (under 10 words, or over a fifth of the words in repeated five-word windows), symbols (over a tenth of the
    characters), lines (over three in ten words as many repeated lines). A host fails a document that fails any rule.
    """
    rules = [
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        (10 * F.col("n_symbols") > F.col("word_chars")).alias("symbols_failed"),
        (10 * F.col("n_dup_lines") > 3 * F.col("n_words")).alias("lines_failed"),
    ]
    rows = materialise(spark, measures(docs, id_col, text_col, host_col).select("*", *rules), "measures")
    any_failed = F.col("base_failed") | F.col("symbols_failed") | F.col("lines_failed")
    hosts = rows.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(any_failed.cast("long")).alias("failed"))
    hosts = materialise(spark, hosts, "hosts")
    rate = F.col("failed") / F.col("n")
    m = hosts.agg(F.count("*").alias("hosts"), F.avg(rate).alias("mean"), F.var_samp(rate).alias("var"), F.avg(1 / F.col("n")).alias("noise"), F.sum(F.octet_length("host")).alias("bytes")).first()
    mean = min(max(m["mean"] or 0.0, 1e-4), 1 - 1e-4)
    between = max((m["var"] or 0.0) - mean * (1 - mean) * (m["noise"] or 0.0), 1e-6)  # what chance within hosts explains is taken off
    strength = max(mean * (1 - mean) / between - 1, 2.0)
    a, b = mean * strength, (1 - mean) * strength
    posterior = (F.col("failed") + a) / (F.col("n") + a + b)
    spread = F.sqrt(posterior * (1 - posterior) / (F.col("n") + a + b + 1))
    verdicts = hosts.select("host", posterior.alias("host_rate"), (posterior - 2 * spread > most_rate).alias("host_failed"))
    if m["hosts"] <= BROADCAST_HOSTS and (m["bytes"] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(verdicts), "host", "left")
    else:  # a host may have a third of all rows
        salted = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("id", *MEASURES), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    return joined.select("id", *MEASURES, "base_failed", any_failed.alias("rules_failed"), "host_rate", (~F.col("base_failed") & ~F.coalesce("host_failed", F.lit(False))).alias("kept"))


def op5_host_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = host_rules(spark, docs)
    return out.select(F.col("id").alias("doc_id"), *MEASURES, "base_failed", "kept", "rules_failed", "host_rate")
