"""The period search over its whole grid."""

import inspect

import numpy as np
import pytest

from fluxframe import queries
from fluxframe.operators import bls


def test_transit_features_searches_the_whole_grid(spark, monkeypatch):
    real, seen = bls.bounded_search, []

    def spy(*args, **named):
        given = inspect.signature(real).bind(*args, **named)
        given.apply_defaults()
        seen.append(tuple(given.arguments[k] for k in ("low", "high", "n", "durations")))
        return real(*args, **named)

    monkeypatch.setattr(bls, "bounded_search", spy)
    queries.QUERIES["transit_features"](spark, "/root/testdata/sf0.001")
    assert seen == [(*bls.PERIODS, bls.DURATIONS)]


def test_period_between_the_small_grid_is_found(spark):
    t = np.arange(0, 60, 0.1)
    y = np.where(np.mod(t - 0.7, 3.2737) < 0.3, 0.99, 1.0)
    lc = spark.createDataFrame([("a", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, y, strict=True))], "target_id string, seq bigint, time double, flux double")
    best = bls.best_period(bls.bounded_search(lc)).first()
    assert best.period == pytest.approx(3.2737, rel=0.01)


def test_bounded_search_equals_the_full_one_on_every_curve(spark):
    lc = queries.curves(spark, "/root/testdata/sf0.001", False)
    rows = lambda power: sorted(map(tuple, bls.best_period(power).collect()))
    full = rows(bls.fast_periodogram(lc))
    assert full == rows(bls.bounded_search(lc)) == rows(bls.bounded_search(lc, chunks=7)) and len(full) == 15


@pytest.mark.parametrize("case", ["noise", "dips", "long", "copies", "two", "flat", "one", "huge"])
def test_no_bound_drops_the_best(case):
    rng = np.random.default_rng(11)
    n, span = {"long": (500, 700.0), "two": (2, 9.0), "one": (1, 0.0), "dips": (900, 60.0)}.get(case, (300, 40.0))
    t = np.sort(rng.uniform(0, span, n))
    t -= t[0]
    y = rng.normal(0, 1, n)
    if case == "dips":
        y -= np.where(np.mod(t, 7.77) < 0.3, 9, 0)
    if case == "copies":
        t, y = np.repeat(t[::3], 3), np.repeat(y[::3], 3)
    if case == "flat":
        y[:] = 0
    if case == "huge":
        y = np.exp(rng.normal(0, 8, n)) * -1e6
    y -= np.median(y)
    grid = np.linspace(0.5, 100, 4001)
    power, duration, t0, depth = bls.search_arrays(t, y, grid)
    first = np.flatnonzero(np.round(power / (power.max() or 1), bls.DIGITS) == np.round(power.max() / (power.max() or 1), bls.DIGITS))[0]
    at, found = bls.best_of_arrays(t, y, grid)
    i = list(at).index(first)
    assert at[np.flatnonzero(np.round(found[0] / (found[0].max() or 1), bls.DIGITS) == np.round(found[0].max() / (found[0].max() or 1), bls.DIGITS))[0]] == first
    assert [c[i] for c in found] == [power[first], duration[first], t0[first], depth[first]]
    for coarse in bls.COARSE:
        begins = bls._blocks(grid, t.max(), (coarse - 1) * 0.025)
        ends = np.append(begins[1:], len(grid))
        bound = bls.block_bounds(t, y, grid[begins], grid[ends - 1], coarse)
        assert (np.repeat(bound, ends - begins) >= power).all()


def test_bounds_leave_few_periods_to_search(monkeypatch):
    rng = np.random.default_rng(12)
    t = np.sort(rng.uniform(0, 30, 67))
    y = rng.exponential(50, 67)
    t, y, grid = t - t[0], y - np.median(y), np.linspace(*bls.PERIODS)
    power = bls.search_arrays(t, y, grid[:3800])[0]
    near = np.arange(0, 3800, 9)
    assert (bls.period_bounds(t, y, grid[near]) >= power[near]).all()
    real, tried = bls.search_arrays, []
    monkeypatch.setattr(bls, "search_arrays", lambda t, y, periods, *a: tried.extend(periods) or real(t, y, periods, *a))
    at, found = bls.best_of_arrays(t, y, grid)
    assert found[0].max() == power.max() and at[found[0].argmax()] == power.argmax()
    assert len(tried) < 250


def test_transit_features_searches_once(spark):
    lc = queries.curves(spark, "/root/testdata/sf0.001", False)
    plan = bls.transit_features(lc, bls.bounded_search(lc, n=500))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan
