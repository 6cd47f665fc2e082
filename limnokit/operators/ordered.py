"""Order-dependent values that do not need a whole group, or table, in one task.

Rows are cut into slices that follow the order: a column of the caller's, or
the parts of a range partitioning, whatever the keys. Inside a slice a window
does the work; between slices only one summary row each is carried.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnokit.operators.joins import null_safe_join
from limnokit.session import settle

SLICE = "__slice"
SEGMENT = "__segment"
#: Rows that tasks keep at the top of their own order; positions are counted beyond.
TOP_ROWS = 100_000


def with_row_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """1-based position of every row in the order of the whole table.

    Rows are range-partitioned and sorted once; a row's place is its place in
    its partition plus the sizes of the partitions before it. ``order``
    should end in a unique column, so that equal keys do not pile up.
    """
    # The id is (partition << 33) + place in the partition; settling keeps it
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(ranged.withColumn("__id", F.monotonically_increasing_id()), "ordered")
    placed = placed.withColumn(SLICE, F.shiftright("__id", 33))
    sizes = placed.groupBy(SLICE).agg(F.count(F.lit(1)).alias("__size"))
    # One row per partition, so this window is as long as the table has partitions
    ahead = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(SLICE, F.coalesce(F.sum("__size").over(ahead), F.lit(0)).alias("__offset"))
    joined = null_safe_join(placed, settle(offsets, "offsets"), [SLICE])
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + F.col("__offset")
    return joined.withColumn(name, place).drop(SLICE, "__id", "__offset")


def in_segments(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``df`` with a ``SEGMENT`` that does not decrease along the order and cuts a group of any size.

    The rows are range-partitioned by keys and order and a segment is a part of
    that, so a group in which most rows lie is spread over as many parts. The
    order should end in a unique column: rows equal in it stay together.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return settle(ranged.withColumn(SEGMENT, F.spark_partition_id()), "segments")


def _sliced(df: DataFrame, keys: list[str], order: list[str], slice_by: str | None) -> tuple[DataFrame, str]:
    return (df, slice_by) if slice_by is not None else (in_segments(df, keys, order), SEGMENT)


def _beyond(row: dict, columns: list[str], df: DataFrame) -> tuple[Column, Column]:
    """Whether a row comes after ``row`` in ascending order with missing values last, and whether it is equal in it."""
    kinds = {f.name: f.dataType for f in df.schema}
    after, same = [], []
    for c in columns:
        value = F.lit(row[c]).cast(kinds[c])
        if row[c] is not None:
            after.append(reduce(and_, same, F.coalesce(F.col(c) > value, F.lit(True))))
        same.append(F.col(c).eqNullSafe(value))
    return reduce(or_, after, F.lit(False)), reduce(and_, same)


def skip_head(df: DataFrame, order: list[str], count: int, top_rows: int = TOP_ROWS) -> DataFrame:
    """All rows but the first ``count`` in ascending order, missing values last.

    Each task keeps its first ``count`` rows of the order columns, the least of
    all of them give the last row to skip, and a plain filter does the rest:
    the table is neither sorted nor moved. Of rows that are equal in the order
    to that last one, as many are skipped as fill the count. A count above
    ``top_rows`` goes by :func:`with_row_position`.
    """
    if count <= 0:
        return df
    if count > top_rows:
        place = [F.col(c).asc_nulls_last() for c in order]
        return with_row_position(df, place, "__position").filter(F.col("__position") > count).drop("__position")
    first = settle(df.select(*order).orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(count), "head-rows")
    last = first.orderBy(*[F.when(F.col(c).isNull(), 1).otherwise(0).desc() if k else F.col(c).desc() for c in order for k in (1, 0)]).first()
    if last is None:
        return df
    after, same = _beyond(last.asDict(), order, df)
    skipped, tied = first.filter(same).count(), df.filter(same).count()
    if skipped == tied:
        return df.filter(after)
    rest = with_row_position(df.filter(same), [F.xxhash64(*df.columns).asc()], "__position")
    return df.filter(after).unionByName(rest.filter(F.col("__position") > skipped).drop("__position"))


def sort_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Ascending sort with missing values last."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in columns])


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, slice_by: str | None = None, default: float | None = None
) -> DataFrame:
    """The previous row's value within the group, ``default`` on its first row.

    ``slice_by`` is a column that does not decrease along the order (the month
    of the date, say); without it, slices are those of :func:`in_segments`.
    """
    given, (df, slice_by) = slice_by, _sliced(df, keys, order, slice_by)
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last")
    ends = df.groupBy(*keys, slice_by).agg(last)
    across = Window.partitionBy(*keys).orderBy(slice_by)
    carried = ends.select(
        *keys, slice_by, F.lag("__last").over(across).alias("__carried"), F.row_number().over(across).alias("__nth")
    )
    within = Window.partitionBy(*keys, slice_by).orderBy(*order)
    marked = df.withColumn("__prev", F.lag(value).over(within)).withColumn("__row", F.row_number().over(within))
    joined = null_safe_join(marked, settle(carried, "slice-ends"), [*keys, slice_by])
    first = F.when(F.col("__nth") == 1, F.lit(default)).otherwise(F.col("__carried.v"))
    previous = F.when(F.col("__row") == 1, first).otherwise(F.col("__prev"))
    return joined.withColumn(name, previous).drop("__prev", "__row", "__carried", "__nth", *([] if given else [SEGMENT]))


def with_running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: str, name: str, slice_by: str | None = None
) -> DataFrame:
    """Running total within the group; missing from the first missing value on.

    Slices are as in :func:`with_previous`; after it, with the same column,
    the rows are already where they are needed.
    """
    given, (df, slice_by) = slice_by, _sliced(df, keys, order, slice_by)
    totals = df.groupBy(*keys, slice_by).agg(
        F.sum(value).alias("__total"), F.count_if(F.col(value).isNull()).alias("__missing")
    )
    ahead = Window.partitionBy(*keys).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys,
        slice_by,
        F.coalesce(F.sum("__total").over(ahead), F.lit(0.0)).alias("__total_before"),
        F.coalesce(F.sum("__missing").over(ahead), F.lit(0)).alias("__missing_before"),
    )
    within = Window.partitionBy(*keys, slice_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = df.withColumn("__sum", F.sum(value).over(within)).withColumn(
        "__gaps", F.count_if(F.col(value).isNull()).over(within)
    )
    joined = null_safe_join(summed, settle(carried, "slice-totals"), [*keys, slice_by])
    whole = (F.col("__gaps") + F.col("__missing_before")) == 0
    total = F.when(whole, F.col("__sum") + F.col("__total_before"))
    return joined.withColumn(name, total).drop("__sum", "__gaps", "__total_before", "__missing_before", *([] if given else [SEGMENT]))


def with_running_min(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, slice_by: str | None = None) -> DataFrame:
    """The least value of the group so far, missing ones aside. Slices are as in :func:`with_previous`."""
    given, (df, slice_by) = slice_by, _sliced(df, keys, order, slice_by)
    ahead = Window.partitionBy(*keys).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    least = df.groupBy(*keys, slice_by).agg(F.min(value).alias("__least"))
    carried = least.select(*keys, slice_by, F.min("__least").over(ahead).alias("__carried"))
    within = Window.partitionBy(*keys, slice_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = null_safe_join(df.withColumn("__min", F.min(value).over(within)), settle(carried, "slice-minima"), [*keys, slice_by])
    return joined.withColumn(name, F.least("__min", "__carried")).drop("__min", "__carried", *([] if given else [SEGMENT]))


def with_change_and_total(
    df: DataFrame, keys: list[str], order: list[str], value: str, slice_by: str, change: str, total: str, start: float = 0.0
) -> DataFrame:
    """Change since the previous row of the group (``start`` before the first) and its running total.

    Both come from one summary of the slices (last value, missing values) and
    one window within them. The changes of all slices before add up to the
    last value before, less ``start``. The total is missing from the first
    missing value on. Slices are as in :func:`with_previous`.
    """
    ends = df.groupBy(*keys, slice_by).agg(
        F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last"),
        F.count_if(F.col(value).isNull()).alias("__missing"),
    )
    across = Window.partitionBy(*keys).orderBy(slice_by)
    ahead = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *keys,
        slice_by,
        F.when(F.row_number().over(across) == 1, F.lit(start)).otherwise(F.lag("__last").over(across)["v"]).alias("__carried"),
        F.coalesce(F.sum("__missing").over(ahead), F.lit(0)).alias("__missing_before"),
    )
    joined = null_safe_join(df, settle(carried, "slice-ends"), [*keys, slice_by])
    within = Window.partitionBy(*keys, slice_by).orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(within) == 1
    previous = F.when(first, F.col("__carried")).otherwise(F.lag(value).over(within))
    out = joined.withColumn(change, F.col(value) - previous)
    gaps = F.count_if(F.col(value).isNull()).over(upto) + F.col("__missing_before")
    running = F.sum(change).over(upto) + F.col("__carried") - F.lit(start)
    return out.withColumn(total, F.when(gaps == 0, running)).drop("__carried", "__missing_before")
