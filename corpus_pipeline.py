"""The corpus pipeline: quality rules, near-dedup, secrets, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and reread as the next
one's ``docs``. All but the last return the columns of documents.

Defined results: an empty table gives an empty one of the same columns; columns beyond those of documents stay with
their rows, whatever their names; repeated rows are copies of each other, so one stays; of a group of near copies one
with an id stays and one without, if it has such; a null or blank text has no words, so the first stage rejects it; later stages take such rows too (no
secrets, size 0, no tokens); ties go to the least id, then to the first stored row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import mixing, q_bpe, quality, secrets, simhash
from acreflow.llm.common import dropped, released, table


def _small_batches(spark: SparkSession) -> None:
    """Stages return plans that run later, so the bound on what a task hands to Python at a time stays set in the session:
    4 MB instead of 64, unless the session has its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("64MB", "64m", str(64 << 20), f"{64 << 20}b"):
        spark.conf.set(name, "4m")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the least id. Links: fingerprints within three bits, and
    texts whose five-word shingles have a similarity of 0.8 or more."""
    _small_batches(spark)
    return simhash.one_of_similar(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows (null for a null text)."""
    _small_batches(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _small_batches(spark)
    return mixing.repeated(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row's text, encoded and decoded again."""
    _small_batches(spark)
    return q_bpe.coded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

#: The stages hash by XXH64, learn and tokenize, which SQL doesn't express; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other; a stage's tables go once its result is written, and that once the next one is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with released() as keep:
            docs = keep(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
