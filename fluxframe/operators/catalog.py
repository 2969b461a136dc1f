"""The catalog of known planets, and the comparison of detections with it."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import broadcast_if_small
from ..schema import CATALOG

log = logging.getLogger(__name__)

# Published parameters of the planets.
PLANETS = (
    ("Kepler-10b", "Kepler-10", 11904151, "Kepler", 0.837495, 152.0, 1.81, "first confirmed rocky exoplanet"),
    ("Kepler-452b", "Kepler-452", 8311864, "Kepler", 384.843, 84.0, 9.67, "long period, shallow dip"),
    ("Kepler-90g", "Kepler-90", 11442793, "Kepler", 210.60697, 335.0, 7.46, "system of eight planets"),
    ("HAT-P-7b", "HAT-P-7", 10666592, "Kepler", 2.204737, 6180.0, 3.63, "hot Jupiter, deep dip"),
    ("Kepler-22b", "Kepler-22", 10593626, "Kepler", 289.8623, 492.0, 7.42, "planet in the habitable zone"),
)
# Relative tolerances, and the probability from which a detection counts.
TOLERANCES = {"period": 0.01, "depth": 0.30, "duration": 0.30}
CONFIDENCE, HIGH_CONFIDENCE = 0.5, 0.7


def catalog(spark: SparkSession) -> DataFrame:
    """The five planets in their order; five rows, so joins may broadcast it."""
    return spark.createDataFrame([(i, *p) for i, p in enumerate(PLANETS)], CATALOG)


def archive_name(name: Column) -> Column:
    """Kepler-10b as an archive spells it: Kepler-10 b."""
    return F.regexp_replace(name, "([^ ])([A-Za-z])$", "$1 $2")


def lookup(names: DataFrame, known: DataFrame, name_col: str = "planet") -> DataFrame:
    """names with the first catalog entry that equals or contains the name, whatever its case; nulls if there is none.

    Entries are looked up by their parts: every part of a target's name is a key, so containment is an equi-join and
    neither side meets the whole other one.
    """
    entry = F.struct("ordinal", "target", "known_period_days", "known_depth_ppm", "known_duration_hours")
    low = F.lower("target")
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.transform(F.sequence(F.lit(1), F.length(low) - i + 1), lambda n: F.substring(low, i, n))))
    keys = known.filter("target is not null").select(entry.alias("e"), F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.when(low != "", parts).otherwise(F.array().cast("array<string>"))))).alias("_part"))
    first = keys.groupBy("_part").agg(F.min("e").alias("e"))
    n = names.select(F.col(name_col).alias("planet"), F.lower(name_col).alias("_part"))
    found = n.join(broadcast_if_small(first), "_part", "left")
    return found.select("planet", archive_name(F.col("planet")).alias("archive_name"), *(F.col(f"e.{c}").alias(c) for c in ("target", "known_period_days", "known_depth_ppm", "known_duration_hours")))


#: What an archive tells of a planet, by the names that its table has for them.
ARCHIVE_FIELDS = {"period_days": "pl_orbper", "depth_ppm": "pl_trandep", "duration_hours": "pl_trandur", "transit_midpoint": "pl_tranmid", "planet_radius_earth": "pl_rade"}


def archive_query(name: str) -> str:
    """The question for one planet's default parameters, for an archive that speaks ADQL."""
    quoted = name.replace("'", "''")
    return f"select pl_name, {', '.join(ARCHIVE_FIELDS.values())} from ps where pl_name = '{quoted}' and default_flag = 1"


def known_parameters(names: DataFrame, known: DataFrame, ask: Callable[[str], list[dict]] | None = None, name_col: str = "planet") -> DataFrame:
    """(planet, archive_name, planet_name, period_days, depth_ppm, duration_hours, transit_midpoint, planet_radius_earth, origin) of every name.

    ask takes an archive_query and returns its rows as mappings; it runs in the tasks, once for each distinct name. Where it
    is not given, fails or finds nothing, the parameters are those of lookup, and origin tells which: archive, catalog or null.
    """
    fields = list(ARCHIVE_FIELDS)
    numbers = ", ".join(f"{f} double" for f in fields)
    local = lookup(names, known, name_col).distinct()
    local = local.select("planet", "archive_name", F.col("target").alias("_t"), *(F.col(f"known_{f}").cast("double").alias(f"_{f}") for f in fields[:3]), *(F.lit(None).cast("double").alias(f"_{f}") for f in fields[3:]))

    def answers(batches):
        for pdf in batches:
            out = []
            for planet, name in zip(pdf["planet"], pdf["archive_name"], strict=True):
                try:
                    row = next(iter(ask(archive_query(name))), None) if name else None
                except Exception as e:
                    log.warning("no answer for %s: %s", name, e)
                    row = None
                if row is not None:
                    out.append([planet, str(row.get("pl_name") or name), *(None if row.get(c) is None else float(row[c]) for c in ARCHIVE_FIELDS.values())])
            yield pd.DataFrame(out, columns=["planet", "planet_name", *fields])

    asked = names.select(F.col(name_col).alias("planet")).distinct().withColumn("archive_name", archive_name(F.col("planet")))
    found = asked.mapInPandas(answers, f"planet string, planet_name string, {numbers}") if ask else names.sparkSession.createDataFrame([], f"planet string, planet_name string, {numbers}")
    j = names.select(F.col(name_col).alias("planet")).join(local, "planet", "left").join(found, "planet", "left")
    here = F.col("planet_name").isNotNull()
    return j.select(
        "planet", "archive_name", F.coalesce("planet_name", "_t").alias("planet_name"), *(F.when(here, F.nanvl(F.col(f), F.lit(None).cast("double"))).otherwise(F.col(f"_{f}")).alias(f) for f in fields),
        F.when(here, "archive").when(F.col("_t").isNotNull(), "catalog").alias("origin"),
    )


def _check(detected: Column, known: Column, tolerance: float) -> Column:
    ok = F.coalesce((detected != 0) & (known != 0), F.lit(False))
    error = F.when(ok, F.abs(detected - known) / known)
    return F.struct(F.when(ok, detected).alias("detected"), F.when(ok, known).alias("known"), error.alias("relative_error"), F.lit(tolerance).alias("tolerance"), F.coalesce(error <= tolerance, F.lit(False)).alias("pass"))


def check_detections(found: DataFrame, known: DataFrame, tolerances: dict[str, float] = TOLERANCES) -> DataFrame:
    """(target, period, depth, duration, overall_pass) of detections(target, period, depth, duration_hours).

    A depth below 1 is a fraction and is compared in parts per million. Zero or missing values fail. The period alone decides.
    """
    d = found.join(broadcast_if_small(known.select("target", "known_period_days", "known_depth_ppm", "known_duration_hours")), "target", "left")
    depth = F.when(F.col("depth") < 1, F.col("depth") * 1e6).otherwise(F.col("depth"))
    out = d.select("target", _check(F.col("period"), F.col("known_period_days"), tolerances["period"]).alias("period"), _check(depth, F.col("known_depth_ppm"), tolerances["depth"]).alias("depth"), _check(F.col("duration_hours"), F.col("known_duration_hours"), tolerances["duration"]).alias("duration"))
    return out.withColumn("overall_pass", F.col("period.pass"))


def benchmark_table(curves: DataFrame, known: DataFrame, detect: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row per catalog target: its detection compared, or overall_pass false with an error where there is no curve.

    detect turns light curves into detections(target_id, period, depth, duration_hours[, confidence]).
    """
    wanted = known.select("target")
    found = detect(curves.join(broadcast_if_small(wanted), F.col("target_id") == F.col("target"), "left_semi")).withColumnRenamed("target_id", "target")
    confidence = F.col("confidence") if "confidence" in found.columns else F.lit(None).cast("double")
    checked = check_detections(found, known).join(found.select("target", confidence.alias("confidence")), "target")
    flat = checked.select(
        "target", *(F.col(f"{p}.{a}").alias(b) for p, u in (("period", ""), ("depth", "_ppm"), ("duration", "")) for a, b in (("detected", f"detected_{p}{u}"), ("known", f"known_{p}{u}"), ("relative_error", f"{p}_error"), ("pass", f"{p}_pass"))),
        "confidence", "overall_pass",
    )
    absent = wanted.join(flat, "target", "left_anti").select("target", F.lit(False).alias("overall_pass"), F.lit("Data not found").alias("error"))
    return flat.unionByName(absent, allowMissingColumns=True)


def comparison_table(checked: DataFrame) -> DataFrame:
    """(target, parameter, unit, detected, known, error_pct, status) of check_detections' rows: a row for each of period, depth and duration."""
    parts = F.array(*(F.struct(F.lit(p).alias("parameter"), F.lit(u).alias("unit"), F.col(f"{p}.detected").alias("detected"), F.col(f"{p}.known").alias("known"), (100 * F.col(f"{p}.relative_error")).alias("error_pct"), F.when(F.col(f"{p}.pass"), "pass").otherwise("fail").alias("status")) for p, u in (("period", "d"), ("depth", "ppm"), ("duration", "h"))))
    return checked.select("target", F.explode(parts).alias("x")).select("target", "x.*")


def benchmark_report(table: DataFrame) -> str:
    """The benchmark as a text table, for tables of catalog size: a line a target, detected values with their errors."""
    rows = table.orderBy("target").collect()
    passed = sum(r["overall_pass"] for r in rows)
    head = ["target", "result", "period d", "depth ppm", "duration h", "confidence"]

    def cells(r) -> list[str]:
        d = r.asDict()
        if d.get("error"):
            return [r["target"], d["error"], "-", "-", "-", "-"]
        value = lambda a, e, form: "-" if d[a] is None else f"{d[a]:{form}}" + ("" if d[e] is None else f" ({100 * d[e]:.2f} % off)")
        sure = "-" if d["confidence"] is None else f"{d['confidence']:.3f}"
        return [r["target"], "pass" if d["overall_pass"] else "fail", value("detected_period", "period_error", ".4f"), value("detected_depth_ppm", "depth_error", ".1f"), value("detected_duration", "duration_error", ".2f"), sure]

    body = [head, *map(cells, rows)]
    width = [max(len(line[i]) for line in body) for i in range(len(head))]
    lines = ["  ".join(c.ljust(w) for c, w in zip(line, width, strict=True)).rstrip() for line in body]
    return "\n".join([*lines, f"{passed} of {len(rows)} targets pass"])


def confidence_tier(probability: Column, threshold: float = CONFIDENCE, high: float = HIGH_CONFIDENCE) -> Column:
    return F.when(probability >= high, "high").when(probability >= threshold, "medium").otherwise("low")
