"""Helpers shared by the operators: table access, bounded Arrow batches, bounded memos."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acreflow.sources.tables import dropped, released, settled

__all__ = ["BATCH_BYTES", "PLAIN", "SPACED", "Memo", "batches_of", "cleaned_up", "dropped", "raw_strings", "released", "settled", "slices", "strings", "table", "whole_row", "word_lists"]

#: Arrow batches are cut to about this many bytes of text before Python objects are made of them.
BATCH_BYTES = 4 << 20
#: Bytes of a text of which words are made at a time, at least.
PIECE_BYTES = 1 << 20
#: Tables for ``word_lists``: words are what stands between ASCII white space, as it is; or they are letters and digits
#: and all beyond ASCII, with A to Z lowered.
SPACED = bytes(32 if 9 <= b <= 13 else b for b in range(256))
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def batches_of(spark: SparkSession, size: str = "4m") -> AbstractContextManager[None]:
    """For jobs started within: Arrow batches to Python of at most ``size``. The session's own setting returns."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def cleaned_up(spark: SparkSession) -> AbstractContextManager[None]:
    """For jobs started within: what they shuffled is deleted when they end, not when the driver's memory happens to be
    collected. For steps that store what they read again."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as a struct named row, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]).alias("row")


def slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices of ``batch`` that hold about ``limit`` bytes in ``column``; one row at least."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(limit, batch.column(column).nbytes)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def strings(batch: pa.RecordBatch, column: int) -> list[str]:
    """The column's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw_strings(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """The column's texts as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def word_lists(data: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, some at a time: ``table`` maps each byte, separators to a space. A word is never cut."""
    data, at = data.translate(table), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        if words := data[at:end].split():
            yield words
        at = end


class Memo(dict):
    """A dict that is emptied when it would pass ``most`` entries: bounded memory, same answers."""

    def __init__(self, most: int):
        super().__init__()
        self.most = most

    def put(self, key, value):
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value
