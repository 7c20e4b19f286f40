"""op7: secrets of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import secrets
from acreflow.llm.common import table


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, secrets.BASE),
        F.sha2(secrets.joined("spans", lambda s: s["base"]), 256).alias("base_sha256"),
        secrets.joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
        F.size(F.filter("spans", lambda s: s["linked"])).cast("long").alias("n_linked"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES: dict[str, str] = {}
