"""The corpus operators as queries over the supplied tables, each over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, held_out, score

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    scored = score(docs, fit(docs, labels.where(~held_out())))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import report, scan

    return report(scan(_table(spark, sf_dir, "documents")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded_digests

    return encoded_digests(_table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substrings import without_repeats

    rest = without_repeats(_table(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files
    from ._store import scratch

    path = scratch(spark, "tokens")
    token_files.write(_table(spark, sf_dir, "documents"), path)
    return token_files.checksums(token_files.read(spark, path))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .decontaminate import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secrets import corpus_counts, findings, train

    docs = _table(spark, sf_dir, "documents")
    corpus = corpus_counts(docs)
    found = findings(docs, corpus, train(corpus))
    spans = F.transform("findings", lambda f: F.concat_ws("-", f["first"], f["past"]))
    return found.select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_findings"), F.array_join(spans, ",").alias("spans"), F.array_max("findings.score").alias("top_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_html_text": op5_html_text,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_files": op8_token_files,
    "op9_decontamination": op9_decontamination,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {
    "op3_license_scan": oracles.licenses(),
    "op6_embedding_dedup": oracles.EMBEDDINGS,
    "op7_substring_dedup": oracles.SUBSTRINGS,
    "op9_decontamination": oracles.DECONTAMINATION,
}
