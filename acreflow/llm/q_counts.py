"""op6: token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import transducer
from acreflow.llm.common import table

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transducer.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
