"""The corpus pipeline: what each stage decides takes effect on the documents that the next one gets.

Language identification, near-duplicate removal, benchmark decontamination, masking of
secrets, tokens. A stage takes (spark, docs, sf_dir) and returns a DataFrame; between
stages the documents are Parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm import language, leakage, secrets, simhash, tokens
from treeloom.llm._store import materialise

#: Frequent words that the literal of the last stage holds.
WORDS = 65_536

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, null and empty ones among them, go; all whose language is found stay, copies too."""
    return language.known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays, once; those without an id all stay."""
    return simhash.keep_one(docs)


def drop_leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a ten-word window with the benchmark go; those without words stay, as do all if it is empty."""
    return leakage.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and n_chars follows; every document stays, and null and empty texts stay as they are."""
    return secrets.redact(docs, path="source" if "source" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digest of the decoded bytes of every document; null has no tokens."""
    # fewer words in the literal than the query of its own has: the driver holds more here; the tokens are the same
    made = tokens.tokenize(docs.select("doc_id", "lang", "source", "text"), tokens.vocabulary(), words=WORDS, keep=["doc_id", "lang", "source"])
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaked),
    ("secrets", mask_secrets),
    ("tokens", encode),
]

#: Not SQL: fingerprints, forests and automata; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs, _ = materialise(stage(spark, docs, sf_dir))
    return docs
