"""A training corpus from raw documents: language ID, near copies, decontamination, sanitisation, packing.

Each stage takes all that its predecessor kept, as Parquet below the shared folder, and returns the columns of documents; the last returns packed
pieces. ORACLE_SQL is None: the stages learn, hash and tokenise, which SQL can't express; tests hold each of them against brute force.

Cases, at every stage: an empty table gives an empty one; other columns pass by, whatever their names; no text is cut, however long; a null in any
column but text and doc_id is a value like others. What each stage makes of null and empty texts, of null and repeated ids and of ties is stated there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallsmith.llm import decontam, lang_id, near_dup, packing, pii
from recallsmith.llm.common import bounded_batches, few_files, materialise
from recallsmith.llm.tokens import tokenizer_path

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the model learns from a bounded sample of those with a language.

    Null and empty texts and those without a letter have none and go, as do all if no document tells its language. Repeated rows all stay or all go.
    """
    bounded_batches(spark)
    return few_files(spark, lang_id.keep_known(docs, lang_id.train(docs)), scanned=docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first, of each group of near copies: five-word shingles, SimHash fingerprints over pigeonhole blocks, pairs checked at a similarity of 0.8,
    and an exact join of what fingerprints leave.

    Null and empty texts are copies of each other. Repeated rows are copies; two texts under one id are two documents. Of a group the least id stays, of
    several texts under it the one of the least hash. Rows without an id stay.
    """
    return few_files(spark, near_dup.keep_one(spark, docs), scanned=docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that aligns with a benchmark item.

    Null and empty texts stay, and all documents do without a benchmark; null and empty items match nothing. Repeated rows all stay or all go.
    """
    bounded_batches(spark)
    return few_files(spark, decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), scanned=docs)


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that reveal it rewritten; n_chars follows the text.

    Null and empty texts stay as they are. Repeated rows are rewritten alike, and so are rows without an id. Spans that overlap become one placeholder, that of the first.
    """
    out = few_files(spark, pii.sanitise(spark, docs), scanned=docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens.

    Null and empty texts are an end id each. Repeated rows are packed each, and so are rows without an id; ties are broken by id, piece, checksum and row.
    """
    return packing.pack(spark, docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sanitisation", sanitisation),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each on what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(spark, docs, name)
    return docs
