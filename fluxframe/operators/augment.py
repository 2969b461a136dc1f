"""Train-only augmentation of flux. A curve draws its parameters once, from the seed and its id; a projection applies them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import by_target, KEY, between, normal, uniform

TAU = 6.283185307179586


@dataclass(frozen=True)
class Step:
    probability: float
    params: dict = field(default_factory=dict)


# Technique, chance and parameters, applied in this order.
DEFAULTS = {
    "gaussian_noise": Step(0.5, {"sigma_range": (0.0005, 0.003)}),
    "time_shift": Step(0.3, {"max_shift_fraction": 0.02}),
    "flux_scaling": Step(0.3, {"scale_range": (0.98, 1.02)}),
    "random_masking": Step(0.2, {"max_mask_fraction": 0.05}),
    "baseline_drift": Step(0.3, {"amplitude_range": (0.0002, 0.002)}),
}


def _n() -> Column:
    return F.count(F.lit(1)).over(by_target())


def gaussian_noise(lc: DataFrame, sigma_range: tuple = (0.0005, 0.003), seed: int = 42, when: Column | None = None) -> DataFrame:
    """Noise whose deviation is drawn per curve."""
    sigma = between(*sigma_range, uniform(seed, F.lit("sigma"), KEY))
    return _apply(lc, F.col("flux") + sigma * normal(seed, F.lit("noise"), KEY, "seq"), when)


#: The name that the noise step had before it drew its deviation.
augment_with_noise = gaussian_noise


def time_shift(lc: DataFrame, max_shift_fraction: float = 0.02, seed: int = 42, when: Column | None = None) -> DataFrame:
    """Flux turned round by some samples either way; rows must be numbered 0, 1, ... in seq.

    A curve becomes one row of its points, whose flux is turned as an array, and its points again, so nothing is joined.
    """
    point = F.struct("seq", *(c for c in lc.columns if c not in (KEY, "seq")), *([when.alias("_when")] if when is not None else []))
    d = lc.groupBy(KEY).agg(F.array_sort(F.collect_list(point)).alias("_p")).withColumn("_n", F.size("_p"))
    most = F.greatest(F.floor(F.col("_n") * max_shift_fraction), F.lit(1))
    shift = F.floor(uniform(seed, F.lit("shift"), KEY) * (2 * most + 1)) - most
    d = d.withColumn("_s", F.pmod(shift, F.col("_n")).cast("int")).withColumn("_f", F.expr("concat(slice(_p.flux, _n - _s + 1, _s), slice(_p.flux, 1, _n - _s))"))
    d = d.select(KEY, F.explode(F.arrays_zip("_p", "_f")).alias("_x")).select(KEY, "_x._p.*", F.col("_x._f").alias("_moved"))
    return _apply(d, F.col("_moved"), F.col("_when") if when is not None else None, lc.columns)


def flux_scaling(lc: DataFrame, scale_range: tuple = (0.98, 1.02), seed: int = 42, when: Column | None = None) -> DataFrame:
    return _apply(lc, F.col("flux") * between(*scale_range, uniform(seed, F.lit("scale"), KEY)), when)


def random_masking(lc: DataFrame, max_mask_fraction: float = 0.05, seed: int = 42, when: Column | None = None) -> DataFrame:
    """A span of the curve set to 0."""
    d = lc.withColumn("_n", _n())
    most = F.greatest(F.floor(F.col("_n") * max_mask_fraction), F.lit(1))
    length = 1 + F.floor(uniform(seed, F.lit("mask"), KEY) * most)
    start = F.floor(uniform(seed, F.lit("start"), KEY) * (F.greatest(F.col("_n") - length, F.lit(1)) + 1))
    start = F.greatest(F.least(start, F.col("_n") - length), F.lit(0))
    inside = (F.col("seq") >= start) & (F.col("seq") < start + length)
    return _apply(d, F.when(inside, 0.0).otherwise(F.col("flux")), when, lc.columns)


def baseline_drift(lc: DataFrame, amplitude_range: tuple = (0.0002, 0.002), seed: int = 42, when: Column | None = None) -> DataFrame:
    """A slow wave of one to three cycles."""
    u = lambda name: uniform(seed, F.lit(name), KEY)
    d = lc.withColumn("_n", _n())
    wave = between(*amplitude_range, u("amplitude")) * F.sin(TAU * between(1.0, 3.0, u("cycles")) * F.col("seq") / F.col("_n") + TAU * u("angle"))
    return _apply(d, F.col("flux") + wave, when, lc.columns)


def _apply(d: DataFrame, new: Column, when: Column | None, columns: list[str] | None = None) -> DataFrame:
    out = d.withColumn("flux", new if when is None else F.when(when, new).otherwise(F.col("flux")))
    return out.select(*columns) if columns else out


TECHNIQUES = {"gaussian_noise": gaussian_noise, "time_shift": time_shift, "flux_scaling": flux_scaling, "random_masking": random_masking, "baseline_drift": baseline_drift}


def augment(lc: DataFrame, steps: dict[str, Step] | None = None, training: bool = True, enabled: bool = True, seed: int = 42) -> DataFrame:
    """Every technique in order, each by its own chance for each curve. lc itself unless training and enabled."""
    if not training or not enabled:
        return lc
    for name, step in (steps or DEFAULTS).items():
        if name not in TECHNIQUES:
            raise ValueError(f"unknown technique {name!r}")
        if step.probability > 0:
            lc = TECHNIQUES[name](lc, seed=seed, when=uniform(seed, F.lit(f"use {name}"), KEY) < step.probability, **step.params)
    return lc

