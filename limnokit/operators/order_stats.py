"""Exact quantiles, box statistics and outlier rows per group.

A mergeable sketch narrows every wanted rank to a bracket of values, and one
grouped count settles it; only counts move and no task holds a group. Where a
sketch fails (NaN), every rank gets an interval of values, and each round
counts rows into bins of the intervals still open.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnokit.operators.joins import null_safe_join
from limnokit.session import settle

BINS = 1024
#: Rank error of a sketch, as a share of one over this.
ACCURACY = 100_000
#: An even round leaves an interval in one binade or with one value; from then
#: on every round takes 10 of its 52 bits. Odd rounds only make it faster.
MOST_ROUNDS = 14


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def _binade(v: Column) -> Column:
    """An integer that rises with the sign and the power of two of a double; infinities and NaN have their own."""
    power = F.floor(F.log2(F.abs(v))) + 1100
    return (
        F.when(F.isnan(v), F.lit(5000))
        .when(v == 0, F.lit(0))
        .when(~_finite(v), F.when(v > 0, F.lit(4000)).otherwise(F.lit(-4000)))
        .otherwise(F.when(v > 0, power).otherwise(-power))
        .cast("int")
    )


def _even_bin(v: Column, lo: Column, hi: Column) -> Column:
    """Bin of ``v`` among ``BINS`` equal ones from lo to hi (finite, lo < hi); both ends in different bins."""
    scale = F.when(_finite(hi - lo), F.lit(1.0)).otherwise(F.lit(0.25))
    place = (v * scale - lo * scale) / (hi * scale - lo * scale) * F.lit(float(BINS))
    return F.greatest(F.lit(0), F.least(F.floor(place), F.lit(BINS - 1))).cast("int")


def select_ranks(df: DataFrame, keys: list[str], value: str, targets: DataFrame, weight: str | None = None) -> DataFrame:
    """The value at each wanted rank of each group, exactly.

    ``targets`` has the keys, a ``target`` label and a 1-based ``rank``
    (counted in units of ``weight``). Order is that of Spark: -inf, finite
    values, inf, NaN. Every round counts rows into bins of each interval still
    open, and each target moves to the bin that holds its rank, tightened to
    the values seen in it; a target is done when its interval is one value.
    Odd rounds use equal bins, even ones powers of two unless the interval
    lies within one, so any interval is done after ``MOST_ROUNDS`` rounds.
    Intervals of a group never overlap, so a row is counted once.
    Returns keys, target, rank and ``value``.
    """
    size = F.col(weight).cast("double") if weight else F.lit(1.0)
    points = df.filter(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("v"), size.alias("w")
    )
    spread = points.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = targets.select(*keys, "target", "rank")
    state = settle(
        null_safe_join(wanted, spread, keys, "inner").withColumn("before", F.lit(0.0)), "rank-state"
    )
    v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
    finished = state.filter(lo == hi)
    for turn in range(MOST_ROUNDS):
        active = state.filter(lo < hi)
        if active.isEmpty():
            return finished.select(*keys, "target", "rank", lo.alias("value"))
        intervals = active.select(*keys, "lo", "hi", "before").distinct()
        inside = null_safe_join(points, intervals, keys, "inner").filter(v.between(lo, hi))
        even = _finite(lo) & _finite(hi)
        if turn % 2:
            even &= _binade(lo) == _binade(hi)
        counted = (
            inside.withColumn("bin", F.when(even, _even_bin(v, lo, hi)).otherwise(_binade(v)))
            .groupBy(*keys, "lo", "before", "bin")
            .agg(F.sum("w").alias("w"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
        )
        # At most BINS rows, or one a power of two, per window
        in_order = Window.partitionBy(*keys, "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = counted.withColumn("upto", F.col("before") + F.sum("w").over(in_order)).select(
            *keys, "lo", "bin_lo", "bin_hi", "upto", (F.col("upto") - F.col("w")).alias("bin_before")
        )
        state = settle(
            null_safe_join(active.drop("hi", "before"), bins, [*keys, "lo"], "inner")
            .filter((F.col("rank") > F.col("bin_before")) & (F.col("rank") <= F.col("upto")))
            .select(
                *keys,
                "target",
                "rank",
                F.col("bin_lo").alias("lo"),
                F.col("bin_hi").alias("hi"),
                F.col("bin_before").alias("before"),
            ),
            "rank-state",
        )
        finished = finished.unionByName(state.filter(lo == hi))
    if not state.filter(lo < hi).isEmpty():
        raise RuntimeError(f"ranks not found in {MOST_ROUNDS} rounds")
    return finished.select(*keys, "target", "rank", lo.alias("value"))


def _position(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(p)


def _rank_ends(p: float) -> dict[str, Column]:
    """Ranks of the order statistics on both sides of a quantile."""
    low = F.floor(_position(p)) + 1
    return {"low": low, "high": F.least(low + 1, F.col("n"))}


def _reaches(p: float) -> list[tuple[float, float]]:
    """Pairs of probabilities around ``p``, each four times as wide as the one before, the last the whole range."""
    wide = [3 / ACCURACY * 4**k for k in range(8)]
    return [(max(0.0, p - w), min(1.0, p + w)) for w in wide] + [(0.0, 1.0)]


def rank_sketch(value: Column, probs: dict[str, float]) -> Column:
    """Approximate quantiles around each prob, from one mergeable sketch with rank errors below n / ``ACCURACY``."""
    return F.percentile_approx(value, F.array(*[F.lit(x) for p in probs.values() for pair in _reaches(p) for x in pair]), ACCURACY)


def _brackets(probs: dict[str, float]) -> dict[str, tuple[Column, Column]]:
    """The narrowest pair of sketched values that holds the wanted ranks in spite of the sketch's error."""
    out, at = {}, 0
    for name, p in probs.items():
        pairs = _reaches(p)
        pick = F.lit(len(pairs) - 1)
        for k in reversed(range(len(pairs) - 1)):
            pick = F.when(F.lit(3 / ACCURACY * 4**k) * F.col("n") >= 4, F.lit(k)).otherwise(pick)
        out[name] = tuple(F.get("sketch", F.lit(at + side) + 2 * pick) for side in (0, 1))
        at += 2 * len(pairs)
    return out


def _between(ends: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Quantiles from the order statistics ``{name}_low`` and ``{name}_high``."""
    part = {p: _position(p) - F.floor(_position(p)) for p in probs.values()}
    return ends.select(
        *keys,
        "n",
        *[
            F.when((F.col(f"{name}_low") == F.col(f"{name}_high")) | (part[p] == 0), F.col(f"{name}_low"))
            .otherwise(F.col(f"{name}_low") * (1 - part[p]) + F.col(f"{name}_high") * part[p])
            .alias(name)
            for name, p in probs.items()
        ],
    )


def _counted_ends(points: DataFrame, sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Order statistics that lie in the brackets of ``sketches`` (keys, ``n``, ``sketch``); NULL where one does not.

    One pass over the points counts the values inside brackets one by one and
    the rest by the number of brackets they are above. In the order (number of
    brackets above, rest first, value) running counts are ranks: a value in a
    bracket is above all the rest with as many brackets below them.
    """
    brackets = _brackets(probs)
    bounds = sketches.select(*keys, "n", *[c.alias(f"{name}_{side}") for name, pair in brackets.items() for side, c in zip(("from", "to"), pair, strict=True)])
    v = F.col("v")
    inside = reduce(or_, [v.between(F.col(f"{name}_from"), F.col(f"{name}_to")) for name in probs])
    above = reduce(add, [(v > F.col(f"{name}_to")).cast("int") for name in probs])
    rows = null_safe_join(points, bounds, keys, "inner") if keys else points.crossJoin(bounds)
    counted = rows.groupBy(*keys, "n", above.alias("above"), F.when(inside, v).alias("at")).agg(F.count(F.lit(1)).alias("w"))
    order = Window.partitionBy(*keys, "n").orderBy("above", F.col("at").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("w").over(order))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank > F.col("upto") - F.col("w")) & (rank <= F.col("upto")), F.col("at")))

    return ranked.groupBy(*keys, "n").agg(*[value_at(rank).alias(f"{name}_{side}") for name, p in probs.items() for side, rank in _rank_ends(p).items()])


def _searched_ends(points: DataFrame, sizes: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """The same order statistics by :func:`select_ranks`."""
    wanted = F.array(
        *[
            F.struct(F.lit(f"{name}_{side}").alias("target"), rank.cast("bigint").alias("rank"))
            for name, p in probs.items()
            for side, rank in _rank_ends(p).items()
        ]
    )
    targets = sizes.select(*keys, F.explode(wanted).alias("t")).select(*keys, "t.target", "t.rank")
    found = select_ranks(points, keys, "v", targets)
    ends = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("target") == f"{name}_{side}", F.col("value"))).alias(f"{name}_{side}") for name in probs for side in ("low", "high")]
    )
    return null_safe_join(sizes, ends, keys, "left")


def quantiles_of_sketches(points: DataFrame, sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Exact quantiles of ``v`` in ``points`` (keys, ``v`` not null), given settled ``sketches`` (keys, ``n``, ``sketch``).

    The sketch only narrows the search: a rank it does not bracket (it knows no
    order of NaN) shows in the counts, and its group is searched by bins.
    """
    ends = settle(_counted_ends(points, sketches, keys, probs), "rank-ends")
    lost = reduce(or_, [F.col(f"{name}_{side}").isNull() for name in probs for side in ("low", "high")])
    if ends.filter(lost).isEmpty():
        return _between(ends, keys, probs)
    sizes = settle(ends.filter(lost).select(*keys, "n"), "group-sizes")
    rest = null_safe_join(points, sizes.select(*keys), keys, "left_semi")
    return _between(ends.filter(~lost).unionByName(_searched_ends(rest, sizes, keys, probs)), keys, probs)


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear between the two order statistics around each position) and ``n`` per group.

    Two passes over the rows: a sketch brackets each rank, then one grouped
    count finds it. Rows in brackets, the only ones counted by value, are less
    than ``n / 10,000`` of a large group. Between equal order statistics the
    quantile is that value, infinite ones included.
    """
    points = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    sketches = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rank_sketch(F.col("v"), probs).alias("sketch"))
    return quantiles_of_sketches(points, settle(sketches, "rank-sketches"), keys, probs)


def approximate_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = 10_000
) -> DataFrame:
    """Quantiles with a rank error of at most n / accuracy, in one pass of mergeable sketches."""
    at = F.array(*[F.lit(p) for p in probs.values()])
    packed = df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile_approx(value, at, accuracy).alias("q"))
    return packed.select(*keys, "n", *[F.col("q")[i].alias(name) for i, name in enumerate(probs)])


def _hinges(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    quartiles = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    hinges = group_quantiles(df, keys, value, quartiles)
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    return hinges.withColumn("fence_low", F.col("q1") - reach).withColumn("fence_high", F.col("q3") + reach)


def box_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Hinges, median, whisker ends and outlier count of every group.

    Whiskers reach the most extreme value within 1.5 inter-quartile ranges of
    the hinges (never inside the box).
    """
    present = df.filter(F.col(value).isNotNull()).select(*keys, value)
    rows = null_safe_join(present, _hinges(present, keys, value), keys)
    within = F.col(value).between(F.col("fence_low"), F.col("fence_high"))
    box = ["n", "q1", "median", "q3"]
    ends = rows.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in box],
        F.min(F.when(within, F.col(value))).alias("lowest"),
        F.max(F.when(within, F.col(value))).alias("highest"),
        F.count_if(~within).alias("n_outliers"),
    )
    return ends.select(
        *keys,
        *box,
        F.least("lowest", "q1").alias("whisker_low"),
        F.greatest("highest", "q3").alias("whisker_high"),
        "n_outliers",
    )


def box_outliers(
    df: DataFrame, keys: list[str], value: str, carry: list[str] | None = None
) -> DataFrame:
    """The rows beyond the whiskers of their group."""
    present = df.filter(F.col(value).isNotNull()).select(*keys, value, *(carry or []))
    fences = _hinges(present, keys, value).select(*keys, "fence_low", "fence_high")
    rows = null_safe_join(present, fences, keys)
    beyond = (F.col(value) < F.col("fence_low")) | (F.col(value) > F.col("fence_high"))
    return rows.filter(beyond).drop("fence_low", "fence_high")
