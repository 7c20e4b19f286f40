"""op1: byte-level BPE of every document, encoded and decoded again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from acreflow.llm import bpe
from acreflow.llm.common import table

RANKS = "byte_bpe_50k.tiktoken"


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    return bpe.coded(docs, path or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))


QUERIES = {"op1_byte_bpe": op1_byte_bpe}
ORACLES: dict[str, str] = {}
