"""op12: periodic runs of all documents, in a tenth of which one is planted."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from acreflow.llm import periodic
from acreflow.llm.common import table


def planted(doc_id: int | None, ids: np.ndarray) -> np.ndarray:
    """Every tenth document by its id's CRC repeats a stretch of its words from some word on; none without an id."""
    h, n = crc32(str(doc_id).encode()), len(ids)
    if doc_id is None or h % 10 or not n:
        return ids
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([ids[:a], ids[a + np.arange(n - a) % p]])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detected(table(spark, sf_dir, "documents"), words=planted)


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}
