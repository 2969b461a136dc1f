"""Column expressions that the operators share. Missing is NULL; infinite values are values, but not finite ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")
MAD_TO_SIGMA = 1.4826
MAD_SCORE = 0.6745

#: One hash exchange on target_id serves every operator: all windows and groups use this key alone.
KEY = "target_id"


def by_seq() -> WindowSpec:
    """Array order within a curve."""
    return Window.partitionBy(KEY).orderBy("seq")


def by_target() -> WindowSpec:
    return Window.partitionBy(KEY)


def by_time() -> WindowSpec:
    """Time order; ties are broken by seq, so that results do not depend on how rows arrive."""
    return Window.partitionBy(KEY).orderBy("time", "seq")


def backward(*order: str) -> WindowSpec:
    """The rows of a curve from its end, the reverse of by_seq or by_time: what follows a row is what comes before it here.

    A frame that reaches forward to the end is computed anew for every row; one that reaches back grows by a row.
    """
    return Window.partitionBy(KEY).orderBy(*(F.desc(c) for c in order))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical(c: Column | str) -> Column:
    """A double with NaN as NULL and infinities kept."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def finite(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < INFINITY)


def where(test: Column, c: Column | str) -> Column:
    """c where test holds, else NULL: what aggregates then skip."""
    return F.when(test, col(c))


def over_finite(c: Column | str) -> Column:
    return where(finite(c), c)


def count_where(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def guarded(top: Column, bottom: Column, otherwise: Column | float | None = None) -> Column:
    """top / bottom, or otherwise where bottom is 0."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise).cast("double")
    return F.when(bottom == 0, other).otherwise(top / F.when(bottom != 0, bottom))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as IEEE 754 divides: infinite where bottom alone is 0, NaN where both are."""
    return guarded(top, bottom, top * F.lit(INFINITY))


def uniform(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and parts alone, the same in any engine with MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def normal(seed: int, *parts: Column | str) -> Column:
    """A standard normal number by Box and Muller from two such uniforms."""
    u, v = uniform(seed, F.lit("u"), *parts), uniform(seed, F.lit("v"), *parts)
    return F.sqrt(-2.0 * F.log(u + 1.0 / 8589934592.0)) * F.cos(v * 6.283185307179586)


def between(low: float, high: float, u: Column) -> Column:
    return F.lit(low) + (high - low) * u


def resequence(lc: DataFrame) -> DataFrame:
    """seq counted anew from 0 in the old order; after rows were dropped."""
    return lc.withColumn("seq", (F.row_number().over(by_seq()) - 1).cast("bigint"))


def merged(first: Column, second: Column) -> Column:
    """The entries of two maps; second's value where both have a key, unless it is null."""
    return F.map_zip_with(first, second, lambda k, a, b: F.coalesce(b, a))


#: A side of a join is broadcast only if it is measured to have at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is measured to be within the limits; else unchanged, so that Spark shuffles it. df is counted for that, up to the limit."""
    fixed = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)
    width = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        if not isinstance(f.dataType, fixed):
            width = width + F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string")), F.lit(0))
    n, size = df.select(width.alias("b")).limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df
