"""op3: personal data of all documents. The counts are those of the base forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.llm import pii
from acreflow.llm.common import table
from acreflow.llm.secrets import joined


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(joined("spans", lambda s: s["base"]), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added"),
    )


QUERIES = {"op3_personal_data": op3_personal_data}
ORACLES: dict[str, str] = {}
