"""Scene arithmetic: reflectance, normalised differences, quality bits, season, decade and sensor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scale and offset of surface reflectance, cloud bits 0 to 4, growing season.
SCALE, OFFSET = 0.0000275, -0.2
CLOUD_BITS = 31
SEASON = (5, 9)
#: The platforms that a decade's scenes come from, the first year of a shortwave sensor, bands of a scene.
DECADE_PLATFORMS = {1980: ("landsat-4", "landsat-5"), 1990: ("landsat-5",), 2000: ("landsat-7",), 2010: ("landsat-8",), 2020: ("landsat-8", "landsat-9")}
FIRST_YEAR = 1984
BANDS = ("red", "nir08", "swir16", "qa_pixel")
MOST_CLOUD = 70.0
SENSORS = {"landsat-4": "TM", "landsat-5": "TM", "landsat-7": "ETM+", "landsat-8": "OLI", "landsat-9": "OLI"}


def reflectance(dn: Column) -> Column:
    return dn * SCALE + OFFSET


def normalised_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the denominator is zero."""
    return F.try_divide(a - b, a + b)


def is_clear(qa: Column) -> Column:
    return qa.bitwiseAND(CLOUD_BITS) == 0


def in_season(day: Column) -> Column:
    return F.month(day).between(*SEASON)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def platform_name(platform: Column) -> Column:
    """The platform in lower case, with hyphens."""
    return F.replace(F.lower(platform), F.lit("_"), F.lit("-"))


def sensor(platform: Column) -> Column:
    """The platform's sensor, however it is spelt; an unknown platform is an error."""
    out = F.raise_error(F.concat(F.lit("unknown platform "), F.coalesce(platform, F.lit("null"))))
    for name, kind in SENSORS.items():
        out = F.when(platform_name(platform) == name, kind).otherwise(out)
    return out


def of_decade(platform: Column, day: Column) -> Column:
    """Whether the platform is one of those designated for the day's decade."""
    name, out = platform_name(platform), F.lit(False)
    for start, names in DECADE_PLATFORMS.items():
        out = F.when(decade(F.year(day)) == start, name.isin(*names)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def composite_reason(decade_: Column, n_scenes: Column, covered: Column, valid_fraction: Column, least_scenes: int = 2, least_valid: float = 0.8) -> Column:
    """Why a ring of a decade has no index; null if it has one."""
    return (
        F.when(decade_ < min(DECADE_PLATFORMS), "no-swir-sensor")
        .when(n_scenes < least_scenes, "insufficient-clear-scenes")
        .when(~covered, "no-scene-coverage")
        .when(F.coalesce(valid_fraction, F.lit(0.0)) < least_valid, "insufficient-clear-coverage")
    )
