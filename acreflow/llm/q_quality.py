"""op5: base rules and the learned decision list over all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acreflow.llm import quality
from acreflow.llm.common import table


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.judged(docs, rules)
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}
