"""op8: every document stored as a chunked payload and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from acreflow.llm import media
from acreflow.llm.common import table


def op8_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(table(spark, sf_dir, "documents")))


QUERIES = {"op8_media_chunks": op8_media_chunks}
ORACLES: dict[str, str] = {}
