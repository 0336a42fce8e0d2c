"""Synthetic networks for property tests: seasonal cycle, shared weather, warming, urban ramp, breaks and gaps."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class World:
    """Parameters of a network.

    Fixed values: cycle of 6 degrees, shared AR(1) of 0.55 with shocks of sd 0.7, offsets of sd 1.2, noise of sd 0.35; warming of 0.15 a decade,
    or, where it accelerates, of 0.02 a year up to 1988 and 0.32 a year after it. Traps follow the cohort: urban stations break about 1992, others
    about 2002 (sd 2 years), and urban ones miss 3 % of their months, others 14 %, twice that in the first 40 %.
    """

    stations: int = 200
    first_year: int = 1975
    last_year: int = 2019
    urban_share: float = 0.5
    urban_per_decade: float = 0.0
    accelerating: bool = True
    breaks: bool = False
    step_sd: float = 0.0
    missing: bool = False
    seed: int = 11


#: A signal to recover, and three worlds without one: plain, with breaks, with gaps.
PRESETS = {
    "signal": World(urban_per_decade=0.30),
    "null": World(seed=12),
    "killer_breaks": World(breaks=True, step_sd=0.25, seed=13),
    "killer_missing": World(missing=True, seed=14),
}


def preset(name: str, **changes) -> World:
    return replace(PRESETS[name], **changes)


def _unit(seed: int, *keys) -> F.Column:
    """A uniform number in (0, 1) from a hash, so that reruns agree."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(seed: int, *keys) -> F.Column:
    return F.sqrt(-2 * F.log(_unit(seed, *keys))) * F.cos(2 * math.pi * _unit(seed + 1, *keys))


def make_world(spark: SparkSession, world: World) -> dict[str, DataFrame]:
    """stations (station, urban), breaks (station, months, steps) and series (station, month, value), months from January of first_year on."""
    s, months = world.seed * 100, (world.last_year - world.first_year) * 12
    stations = spark.range(world.stations).select(
        F.col("id").alias("station"), (F.col("id") < world.stations * world.urban_share).alias("urban"), (_normal(s + 1, "id") * 1.2).alias("offset")
    )
    none = F.array().cast("array<double>")
    at = (F.when(F.col("urban"), 1992.0).otherwise(2002.0) + _normal(s + 2, "station") * 2 - world.first_year) * 12
    breaks = stations.select(
        "station", (F.array(at) if world.breaks else none).alias("months"), (F.array(_normal(s + 20, "station") * world.step_sd) if world.breaks else none).alias("steps")
    )
    # one shared recurrence: a list of as many numbers as there are months
    shocks = spark.range(months).select("id", (_normal(s + 40, "id") * 0.7).alias("e")).orderBy("id").collect()
    shared, weather = 0.0, []
    for r in shocks:
        shared = 0.55 * shared + r.e if r.id else 0.0
        weather.append((r.id, shared))
    common = F.broadcast(spark.createDataFrame(weather, "month long, weather double"))
    full = stations.join(breaks, "station").withColumn("month", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(months - 1).cast("long")))).join(common, "month")
    years, before = F.col("month") / 12.0, 1988.0 - world.first_year
    warm = F.least(years, F.lit(before)) * 0.02 + F.greatest(years - before, F.lit(0.0)) * 0.32 if world.accelerating else years * 0.015
    stepped = F.aggregate(F.zip_with("months", "steps", lambda m, x: F.when(F.col("month") >= m, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    v = 6 * F.sin(2 * math.pi * (F.col("month") % 12) / 12) + warm + F.col("weather") + F.col("offset") + _normal(s + 50, "station", "month") * 0.35 + stepped
    v = v + F.when(F.col("urban"), years / 10 * world.urban_per_decade).otherwise(0.0)
    rate = F.when(F.col("urban"), 0.03).otherwise(0.14) * F.when(F.col("month") < 0.4 * months, 2).otherwise(1) if world.missing else F.lit(0.0)
    series = full.select("station", "month", F.when(_unit(s + 60, "station", "month") >= rate, v).alias("value"))
    return {"stations": stations.select("station", "urban"), "breaks": breaks, "series": series}
