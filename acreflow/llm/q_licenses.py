"""op9: licenses of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import licenses
from acreflow.llm.common import table


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    held = F.filter("blocks", lambda b: b["license"].isNotNull())
    spell = lambda b: F.concat_ws(":", b["license"], b["start"].cast("string"), b["end"].cast("string"), b["saved"].cast("string"), b["lacking"].cast("string"), b["added"].cast("string"))
    # A block has an entry for each of its licenses.
    count = lambda blocks: F.size(F.array_distinct(F.transform(blocks, lambda b: F.struct(b["start"], b["end"])))).cast("long")
    return found.select(
        "doc_id",
        count(F.col("blocks")).alias("n_blocks"),
        count(held).alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(held, lambda b: b["license"]))), ",").alias("licenses"),
        F.array_join(F.transform(held, spell), ",").alias("matches"),
    )


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict[str, str] = {}
