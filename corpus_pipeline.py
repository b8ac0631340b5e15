"""The corpus pipeline: toxicity, near-duplicates, decontamination, secrets, token ids.

Each stage works on what the one before kept. All but the last return the
columns of ``documents``; the last returns token counts and digests.

Every stage takes nulls in any column, empty and very long texts, repeated rows
and further columns, which it passes on; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arraymill.llm import bpe, decontaminate, secrets, simhash, toxicity
from arraymill.llm._store import drop, scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model learns from the labels of documents that are not held out.

    A null or empty text is one empty sentence and stays unless such texts score
    0.5. Repeated rows share their fate. Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels.where(~toxicity.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard 0.8 or more of five words) the document with the smallest id stays, once.

    Texts without words, null ones among them, are one group. Each row is judged
    by its own text: rows that share an id only if their texts are alike, and
    rows with a null id like any other, after all ids. Rows with neither an id
    nor words all stay.
    """
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go, each row by its own text.

    Null and empty texts hold none and stay. Without a benchmark all stay.
    """
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay, null texts as null, repeated rows alike. n_chars follows the text."""
    corpus = secrets.corpus_counts(docs)
    clean = secrets.redacted(docs, corpus, secrets.train(corpus))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token count, and digests of ids and of decoded bytes; a null text counts as empty."""
    return bpe.encoded_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", encode),
]

#: SQL can express neither the model nor the fingerprints.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop(spark, before)
        before = path
    return docs
