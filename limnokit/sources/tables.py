"""Scans and sinks.

CSV files are matched to a table by header name, never by position, so extra
columns fall away and files whose columns are ordered differently line up.
Columnar inputs are read as they are, with pushdown and pruning by Catalyst.
"""

from __future__ import annotations

import csv
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnokit.sources.schemas import HEADER_ALIASES, TABLES, table_schema

MISSING = "NA"


def _typed(raw: Column, kind: str) -> Column:
    """Text to a typed value: ``NA`` is missing, blank stays a blank text."""
    text = F.when(raw == F.lit(MISSING), F.lit(None)).otherwise(raw)
    if kind == "string":
        return F.when(raw.isNull(), F.lit("")).otherwise(text)
    if kind == "date":
        return F.try_to_date(text, "yyyy-M-d")
    if kind in ("int", "bigint"):
        return text.try_cast("double").try_cast(kind)
    return text.try_cast(kind)


# RFC 4180: a quote inside quotes is doubled, and white space belongs to the text
RFC_4180 = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
RECORD = "__record"


@dataclass
class CsvScan:
    """``rows`` of a table, and ``faults``: how many cells of each ``column`` could not be read as its type.

    A record with more or fewer fields than its header is no row; ``faults``
    counts those under the column ``(record)``. A bad cell is NULL in its row.
    """

    rows: DataFrame
    faults: DataFrame


def _layouts(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Header line of the files -> the files that begin with it.

    One scan of the text; of each file, whichever task holds its beginning
    gives the first line that is not blank.
    """
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.filter("file_block_start = 0 AND trim(value) != ''").groupBy("file_path").agg(F.first("value").alias("header"))
    found: dict[str, list[str]] = {}
    for row in first.collect():
        found.setdefault(row["header"], []).append(unquote(row["file_path"]))
    return found


def _header_fields(header: str) -> list[str]:
    try:
        return next(csv.reader([header.removeprefix("\ufeff")], strict=True))
    except csv.Error as problem:
        raise ValueError(f"a header must be one line: {header!r}") from problem


def _scan_layout(spark: SparkSession, header: str, files: list[str], table: str, multi_line: bool) -> DataFrame:
    """The table's columns as typed values, ``__bad`` with the names of unreadable cells, ``__whole`` for well-formed records."""
    fields = _header_fields(header)
    schema = ", ".join(f"c{i} string" for i in range(len(fields)))
    reader = spark.read.schema(f"{schema}, {RECORD} string").options(**RFC_4180, multiLine=multi_line)
    # Without pruning, or a record with too many fields would pass where its last columns are not asked for
    raw = reader.options(columnPruning=False, columnNameOfCorruptRecord=RECORD).csv(files)
    columns, bad = [], []
    for name, (kind, delivered) in TABLES[table].items():
        spellings = [delivered, name, *HEADER_ALIASES.get(delivered, [])]
        at = next((fields.index(s) for s in spellings if s in fields), None)
        if at is None:
            columns.append(F.lit(None).cast(kind).alias(name))
            continue
        cell = F.col(f"c{at}")
        value = _typed(cell, kind)
        columns.append(value.alias(name))
        if kind != "string":
            bad.append(F.when((F.trim(cell) != "") & (cell != F.lit(MISSING)) & value.isNull(), F.lit(name)))
    listed = F.filter(F.array(*bad), lambda name: name.isNotNull()) if bad else F.array().cast("array<string>")
    # Never true by its second part, which is there because Spark refuses to read the record column alone
    whole = F.col(RECORD).isNull() | (F.length("c0") < 0)
    return raw.select(*columns, listed.alias("__bad"), whole.alias("__whole"))


def scan_csv(spark: SparkSession, path: str | list[str], table: str, multi_line: bool = True) -> CsvScan:
    """Scan CSV files, each by its own header, as one of the known tables.

    Files with the same header line are one scan; the scans are united by
    column name, so the order and the number of the columns may differ from
    file to file. A column that a file does not have is NULL there.
    ``multi_line=False`` lets large files be split among tasks; no quoted text
    may hold a line feed then.
    """
    paths = [path] if isinstance(path, str) else list(path)
    layouts = _layouts(spark, paths)
    if not layouts:
        empty = spark.createDataFrame([], table_schema(table))
        return CsvScan(empty, spark.createDataFrame([], "column string, n long"))
    scans = [_scan_layout(spark, header, paths if len(layouts) == 1 else files, table, multi_line) for header, files in sorted(layouts.items())]
    both = union_tables(scans)
    found = both.select(F.explode(F.when(F.col("__whole"), F.col("__bad")).otherwise(F.array(F.lit("(record)")))).alias("column"))
    return CsvScan(both.filter("__whole").drop("__bad", "__whole"), found.groupBy("column").agg(F.count(F.lit(1)).alias("n")))


def read_csv_table(spark: SparkSession, path: str | list[str], table: str, multi_line: bool = True) -> DataFrame:
    """The rows of :func:`scan_csv`."""
    return scan_csv(spark, path, table, multi_line).rows


def read_parquet_table(spark: SparkSession, path: str | list[str], table: str) -> DataFrame:
    """Scan Parquet files as one of the known tables, without schema inference."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.schema(table_schema(table)).parquet(*paths)


def read_table(spark: SparkSession, path: str | list[str], table: str, fmt: str = "parquet") -> DataFrame:
    """Scan a known table from CSV or Parquet."""
    if fmt == "csv":
        return read_csv_table(spark, path, table)
    if fmt == "parquet":
        return read_parquet_table(spark, path, table)
    raise ValueError(f"unknown format {fmt!r}: use 'csv' or 'parquet'")


def drop_column_at(df: DataFrame, position: int) -> DataFrame:
    """Drop the column at a 1-based position, to align files of one family."""
    return df.drop(df.columns[position - 1])


def union_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """All rows of same-schema tables, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "error") -> None:
    """Hand a table to the next stage."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Hand a table to a stage that groups or joins it by ``keys``: one sorted file a bucket of them.

    Rows are dealt once here; every reader that knows the layout groups them
    without an exchange. A key that holds most rows makes a large bucket: for
    such tables use :func:`write_parquet`.
    """
    name = f"bucketed_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")


def read_bucketed(spark: SparkSession, path: str, table: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """A known table written by :func:`write_bucketed`, with its layout known to Catalyst."""
    columns = ", ".join(f"{c} {kind}" for c, (kind, _) in TABLES[table].items())
    by, name = ", ".join(keys), f"bucketed_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header line, ``NA`` for missing values and ``""`` for blank texts.

    Quotes are doubled and line feeds stay inside quotes, so ``read_csv_table``
    gives every text back but ``NA`` itself, which reads as missing.
    """
    df.write.mode(mode).options(**RFC_4180, nullValue=MISSING).csv(path)
