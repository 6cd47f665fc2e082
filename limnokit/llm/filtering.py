"""Dropping listed rows without moving the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnokit.llm.bitmaps import bitmap_of, in_bitmap
from limnokit.session import settle


def row_key() -> Column:
    """A hash that tells rows of one ``doc_id`` with different texts apart."""
    return F.xxhash64("doc_id", "text")


def _sift(bitmap, inside: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("__row_key").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield batch.filter(pa.array(in_bitmap(bitmap.value, keys) == inside))

    return run


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` and ``doc_id`` are in ``dropped`` (settled).

    Rows that a bitmap of bounded size excludes from ``dropped`` stay where
    they are; only the others are joined.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(dropped, "row_key"))
    keyed = docs.withColumn("__row_key", row_key())
    clear, maybe = (keyed.mapInArrow(_sift(bitmap, x), keyed.schema) for x in (False, True))
    listed = dropped.select(F.col("row_key").alias("__row_key"), F.col("doc_id").cast("long").alias("__doc_id")).distinct()
    same = (maybe["__row_key"] == listed["__row_key"]) & maybe["doc_id"].cast("long").eqNullSafe(listed["__doc_id"])
    return clear.unionByName(maybe.join(listed, same, "left_anti")).drop("__row_key")


def one_of_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of ``docs`` for each ``row_key, doc_id`` of ``wanted``, combined before the shuffle."""
    keyed = docs.withColumn("__row_key", row_key())
    listed = settle(wanted.select(F.col("row_key").alias("__row_key"), F.col("doc_id").cast("long").alias("__doc_id")).distinct(), "wanted")
    same = (keyed["__row_key"] == listed["__row_key"]) & keyed["doc_id"].cast("long").eqNullSafe(listed["__doc_id"])
    return keyed.join(listed, same, "left_semi").dropDuplicates(["__row_key", "doc_id"]).drop("__row_key")
