"""Local quadratic regression per group, evaluated on an even grid of x.

Equal x of a group collapse to (count, mean) first; the curve depends on
nothing else. Each grid point then needs the distance of its q-th nearest
reading and eight weighted sums.

The distance: every x begins a window, which ends at the first x that makes it
hold q readings. The nearest q readings of a point lie in the window whose
middle is next to it, so of all windows only the last one before and the first
one after each grid point are kept: one grouped maximum and minimum. The sums:
blocks of compact rows meet the grid of their group as one row each, and give
one row of sums for each grid point. Rows are never multiplied by grid points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructType

from limnokit import fixed_values as fixed
from limnokit.operators.joins import null_safe_join
from limnokit.operators.ordered import with_running_min, with_running_sum
from limnokit.session import settle

#: Compact rows of a block.
BLOCK_ROWS = 512
#: Blocks whose sums are handed on together.
BLOCKS_OUT = 256
_SUMS = [*(f"s{k}" for k in range(5)), *(f"t{k}" for k in range(3))]


def _windows(compact: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``first, last`` of the shortest window of at least ``q`` readings from each x on, where there is one."""
    ranked = null_safe_join(with_running_sum(compact.select(*keys, "x", "n"), keys, ["x"], "n", "upto"), groups.select(*keys, "q"), keys, "inner")
    none = F.lit(None).cast("double")
    end = F.struct((-F.col("upto")).alias("down"), F.lit(0).alias("kind"), none.alias("first"), F.col("x").alias("x"))
    start = F.struct((F.col("n") - F.col("q") - F.col("upto")).alias("down"), F.lit(1).alias("kind"), F.col("x").alias("first"), none.alias("x"))
    # from the highest rank down, the least x met so far is the first that reaches a rank
    falling = ranked.select(*keys, F.inline(F.array(end, start)))
    return with_running_min(falling, keys, ["down", "kind"], "x", "last").filter("kind = 1 AND last IS NOT NULL").select(*keys, "first", "last")


def _grids(compact: DataFrame, groups: DataFrame, keys: list[str], points: int) -> DataFrame:
    """Each group with its ``grid``: position ``at`` and distance ``h`` of every point."""
    step = (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    place = F.when(step > 0, ((F.col("first") + F.col("last")) / 2 - F.col("x_min")) / step).otherwise(F.lit(0.0))
    nearest = (
        null_safe_join(_windows(compact, groups, keys), groups.select(*keys, "x_min", "x_max"), keys, "inner")
        .groupBy(*keys, F.floor(place).alias("after"), F.ceil(place).alias("before"))
        .agg(F.max(F.struct("first", "last")).alias("low"), F.min(F.struct("last", "first")).alias("high"))
        .groupBy(*keys)
        .agg(F.collect_list(F.array(*[F.struct(F.col(f"{c}.first").alias("first"), F.col(f"{c}.last").alias("last")) for c in ("low", "high")])).alias("windows"))
    )
    at = lambda p: F.col("x_min") + p * (F.col("x_max") - F.col("x_min")) / F.lit(points - 1)
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda p: F.struct(
            at(p).alias("at"),
            F.array_min(F.transform(F.flatten("windows"), lambda w: F.greatest(F.abs(at(p) - w["first"]), F.abs(w["last"] - at(p))))).alias("h"),
        ),
    )
    return null_safe_join(groups, nearest, keys, "inner").select(*keys, grid.alias("grid"))


def _column(rows: pa.StructArray, name: str) -> np.ndarray:
    return rows.field(name).to_numpy(zero_copy_only=False).astype(float)


def _block_sums(keys: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCKS_OUT):
                part = batch.slice(low, BLOCKS_OUT)
                found, owner, number = [], [], []
                for i in range(part.num_rows):
                    block, grid = part.column("block")[i].values, part.column("grid")[i].values
                    x, n, y = (_column(block, c) for c in ("x", "n", "y"))
                    at, h = (_column(grid, c)[:, None] for c in ("at", "h"))
                    dist = np.abs(x - at)
                    inside = (dist < h) | ((h == 0) & (dist == 0))
                    width = np.where(h > 0, h, 1.0)
                    w = np.where(inside, n * (1 - (dist / width) ** 3) ** 3, 0.0)
                    z = (x - at) / width
                    power = [w]
                    for _ in range(4):
                        power.append(power[-1] * z)
                    support = inside.sum(axis=1)
                    near = np.flatnonzero(support)
                    sums = [support, at[:, 0], *(p.sum(axis=1) for p in power), *((p * y).sum(axis=1) for p in power[:3])]
                    found.append(np.stack(sums)[:, near])
                    owner.append(np.full(len(near), i))
                    number.append(near)
                values = np.concatenate(found, axis=1)
                rows = pa.array(np.concatenate(owner))
                yield pa.record_batch(
                    [*(part.column(k).take(rows) for k in keys), pa.array(np.concatenate(number), pa.int32()), values[0].astype(np.int64), *values[1:]],
                    [*keys, "point", "support", "at", *_SUMS],
                )

    return run


def loess_curve(
    df: DataFrame,
    keys: list[str],
    x: str,
    y: str,
    span: float = fixed.LOESS_SPAN,
    points: int = fixed.LOESS_POINTS,
) -> DataFrame:
    """Smoothed y at ``points`` equally spaced x per group (tricube weights).

    The local fit is quadratic; where a neighbourhood holds only two distinct
    x it is a line, and where it holds one, that x's mean.
    """
    compact = settle(
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(*keys, F.col(x).cast("double").alias("x"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("y")),
        "loess-points",
    )
    groups = settle(
        compact.groupBy(*keys).agg(
            F.greatest(F.floor(F.sum("n") * F.lit(span) + F.lit(1e-5)), F.lit(1)).alias("q"),
            F.min("x").alias("x_min"),
            F.max("x").alias("x_max"),
            F.count(F.lit(1)).alias("held"),
        ),
        "loess-groups",
    )
    grids = settle(_grids(compact, groups, keys, points), "loess-grids")
    blocks = (
        null_safe_join(compact, groups.select(*keys, "held"), keys, "inner")
        .groupBy(*keys, F.pmod(F.xxhash64("x"), F.ceil(F.col("held") / BLOCK_ROWS)).alias("part"))
        .agg(F.collect_list(F.struct("x", "n", "y")).alias("block"))
    )
    shape = StructType([compact.schema[k] for k in keys]).add("point", IntegerType()).add("support", LongType())
    for name in ("at", *_SUMS):
        shape = shape.add(name, DoubleType())
    sums = (
        null_safe_join(blocks, grids.select(*keys, "grid"), keys, "inner")
        .select(*keys, "block", "grid")
        .mapInArrow(_block_sums(keys), shape)
        .groupBy(*keys, "point", "at")
        .agg(F.sum("support").alias("support"), *[F.sum(c).alias(c) for c in _SUMS])
    )
    s0, s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(5))
    t0, t1, t2 = (F.col(f"t{k}") for k in range(3))
    # Value at z = 0: the constant term, by Cramer's rule
    c0, c1, c2 = s2 * s4 - s3 * s3, s1 * s4 - s2 * s3, s1 * s3 - s2 * s2
    det3 = s0 * c0 - s1 * c1 + s2 * c2
    quadratic = (t0 * c0 - t1 * c1 + t2 * c2) / det3
    det2 = s0 * s2 - s1 * s1
    linear = (t0 * s2 - t1 * s1) / det2
    fitted = (
        F.when((F.col("support") >= 3) & (det3 > F.lit(1e-12) * s0 * s2 * s4), quadratic)
        .when((F.col("support") >= 2) & (det2 > F.lit(1e-12) * s0 * s2), linear)
        .otherwise(t0 / s0)
    )
    return sums.select(*keys, "point", F.col("at").alias("x"), fitted.alias("y"))
