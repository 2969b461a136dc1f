"""Exact medians and percentiles of groups that no task can hold.

A double's bits, as a whole number that orders as doubles do, are looked at a few at a time, from the top: a pass counts a
group's values by the next bits and keeps the range in which a wanted rank lies. Counts combine before they are shuffled, so
a hot group costs a task at most as many rows as there are ranges. When the ranges left hold few values, those are ranked one
by one; equal values, however many, end in one range and are one number. Groups that are small from the start are left
to Spark's percentile, whose buffer is then bounded. Both ways give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import broadcast_if_small
from ..functions.state import settled

#: Values of a group, or of a range of one, that a single task may rank.
FEW = 1_000_000
#: How far passes shift a number's bits: the sign and exponent first.
SHIFTS = (52, 39, 26, 13, 0)


def order_bits(value: Column) -> Column:
    """The bits of a double that is not NaN as a bigint that orders as doubles do; both zeros are 0. Made of exact steps: a power of two, a division by it, a product."""
    size = F.abs(value)
    two = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(size)).cast("double")
    # the logarithm is rounded, so the exponent may be one off; 2^1024 is infinite, which is above all that is compared to it
    e = F.when(two(guess) > size, guess - 1).when(two(guess + 1) <= size, guess + 1).otherwise(guess)
    normal = (e.cast("bigint") + 1023) * (1 << 52) + ((size / two(e) - 1) * float(1 << 52)).cast("bigint")
    small = (size * two(F.lit(537.0)) * two(F.lit(537.0))).cast("bigint")
    bits = F.when(size == float("inf"), F.lit(2047 << 52)).when(size < 2.2250738585072014e-308, small).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits)


def percentiles(df: DataFrame, key: str, value: Column | str, wanted: tuple[float, ...], few: int = FEW) -> DataFrame:
    """(key, q): for every group of df with values, the wanted percentiles as an array, interpolated as percentile() does.

    Null and NaN values are left out, infinite ones count. df is read for sizes, small groups and large ones; the values of large groups are settled, as up to six passes read them.
    """
    v = F.col(value) if isinstance(value, str) else value
    d = df.select(F.col(key).alias("_key"), F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias("_v")).filter("_v is not null")
    sizes = settled(d.groupBy("_key").agg(F.count(F.lit(1)).alias("n")))
    large, some = sizes.filter(F.col("n") > few), sizes.filter(F.col("n") <= few).select(F.col("_key").alias("_k"))
    same = F.col("_key").eqNullSafe(F.col("_k"))
    out = d.join(broadcast_if_small(some), same, "left_semi").groupBy("_key").agg(F.percentile("_v", F.array(*map(F.lit, wanted))).alias("q"))
    if not large.isEmpty():
        out = out.unionByName(_selected(d, large, wanted, few))
    return out.select(F.col("_key").alias(key), "q")


def _selected(d: DataFrame, large: DataFrame, wanted: tuple[float, ...], few: int) -> DataFrame:
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), f(place(p)).cast("bigint").alias("rank")) for i, p in enumerate(wanted) for side, f in enumerate((F.floor, F.ceil))))
    # what is left to find: the rank among a group's values whose bits begin with head
    state = settled(large.select(F.col("_key").alias("_k"), F.explode(ranks).alias("x")).select("_k", "x.i", "x.side", "x.rank", F.lit(None).cast("bigint").alias("head"), F.lit(0).alias("shift")))
    held = settled(d.join(broadcast_if_small(large.select(F.col("_key").alias("_k"))), F.col("_key").eqNullSafe(F.col("_k")), "left_semi").withColumn("_bits", order_bits(F.col("_v"))))
    last = 0
    for n, shift in enumerate(SHIFTS):
        heads = state.select("_k", "head").distinct()
        counts = _under(held, heads, last, n).groupBy("_key", "head", F.shiftright("_bits", shift).alias("next")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        counts = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("_key", "head").orderBy("next")))
        found = state.drop("shift").join(counts.withColumnRenamed("head", "_h"), F.col("_key").eqNullSafe(F.col("_k")) & F.col("head").eqNullSafe(F.col("_h")) & (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n")))
        state = settled(found.select("_k", "i", "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), F.col("next").alias("head"), F.lit(shift).alias("shift"), "n", "low", "high"))
        last = shift
        most = state.filter("low < high").agg(F.max("n")).first()[0]
        if most is None or most <= few:
            break
        state = state.drop("n", "low", "high")
    one = state.filter("low = high").select("_k", "i", "side", F.col("low").alias("value"))
    rest = state.filter("low < high")
    rows = _under(held, rest.select("_k", "head").distinct(), last, 1).withColumn("at", F.row_number().over(Window.partitionBy("_key", "head").orderBy("_v")) - 1)
    picked = rest.join(rows.withColumnRenamed("head", "_h"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("head") == F.col("_h")) & (F.col("rank") == F.col("at"))).select("_k", "i", "side", F.col("_v").alias("value"))
    ends = one.unionByName(picked).groupBy("_k", "i").agg(F.max(F.when(F.col("side") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("value"))).alias("b"))
    ends = ends.join(large, F.col("_k").eqNullSafe(F.col("_key")))
    at = F.element_at(F.array(*map(F.lit, map(float, wanted))), F.col("i") + 1) * (F.col("n") - 1)
    # as percentile() weighs them
    q = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((F.ceil(at) - at) * F.col("a") + (at - F.floor(at)) * F.col("b"))
    return ends.withColumn("q", q).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("i", "q"))).alias("x")).select("_key", F.col("x.q").alias("q"))


def _under(held: DataFrame, heads: DataFrame, shift: int, first: int) -> DataFrame:
    """The values whose bits begin with a head of their group; all of them, with a null head, in the first pass."""
    if not first:
        return held.withColumn("head", F.lit(None).cast("bigint"))
    known = broadcast_if_small(heads.select(F.col("_k"), F.col("head").alias("_h")))
    return held.join(known, F.col("_key").eqNullSafe(F.col("_k")) & (F.shiftright("_bits", shift) == F.col("_h"))).withColumn("head", F.col("_h")).drop("_k", "_h")


def medians(df: DataFrame, key: str, value: Column | str, few: int = FEW) -> DataFrame:
    """(key, median) of every group with values."""
    return percentiles(df, key, value, (0.5,), few).select(key, F.col("q")[0].alias("median"))
