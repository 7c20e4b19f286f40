"""op2: all documents mixed to source weights 5, 2, 1, repeating."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import mixing
from acreflow.llm.common import table


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


QUERIES = {"op2_source_mix": op2_source_mix}
ORACLES: dict[str, str] = {}
