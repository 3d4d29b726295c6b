"""Column expressions used by several operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x within lo and hi; null stays null, which least and greatest would skip."""
    return F.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, factor: float = 111.32) -> Column:
    """Equirectangular distance; ``factor`` is the kilometres of a degree."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(x, 2)) * factor


def has_position(lat: Column, lon: Column, box: float = 0.0) -> Column:
    """Neither null nor within ``box`` degrees of latitude and longitude zero."""
    return lat.isNotNull() & lon.isNotNull() & ~((F.abs(lat) <= box) & (F.abs(lon) <= box))


def time_bin(time: Column, minutes: int, origin: str = "2000-01-01 00:00:00") -> Column:
    """The start of the bin of ``minutes`` that holds the time, counted from ``origin``."""
    start = F.lit(origin).cast("timestamp_ntz")
    seconds = F.expr("0") + F.timestamp_diff("SECOND", start, time)
    whole = F.floor(seconds / (minutes * 60)) * minutes
    return start + F.make_dt_interval(mins=whole.cast("int"))


def free_space_db(km: Column, mhz: float = 868.0) -> Column:
    """Free-space path loss, 20 log10(4 pi d / wavelength)."""
    return 20 * F.log10(4 * math.pi * km * 1000 / (299_792_458.0 / (mhz * 1e6)))


def knife_edge_db(v: Column) -> Column:
    """Loss of a single knife edge by ITU-R P.526, zero up to v = -0.78."""
    return F.when(v > -0.78, 6.9 + 20 * F.log10(F.sqrt(F.pow(v - 0.1, 2) + 1) + v - 0.1)).otherwise(F.lit(0.0))


def radio_horizon_km(h1_m: Column, h2_m: Column) -> Column:
    """Line-of-sight range over a 4/3 earth."""
    return (F.sqrt(h1_m) + F.sqrt(h2_m)) * math.sqrt(2 * EARTH_KM * 1000 * 4 / 3) / 1000


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the text with two blanks before and one after."""
    padded = F.concat(F.lit("  "), text, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def once(x: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of x, which is evaluated once however often ``of`` names it."""
    return F.transform(F.array(x), of)[0]


def dice(a: Column, b: Column) -> Column:
    measure = lambda p: 2.0 * F.size(F.array_intersect(p["a"], p["b"])) / F.greatest(F.lit(1), F.size(p["a"]) + F.size(p["b"]))
    return once(F.struct(a.alias("a"), b.alias("b")), measure)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))).cast("double")


def edit_ratio(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.lit(1), F.length(a), F.length(b)).cast("double")


def normalise_message(text: Column) -> Column:
    """Lower case, links out, only letters and digits, runs of three or more halved to two, single blanks."""
    t = F.regexp_replace(F.lower(text), r"https?://\S+|www\.\S+", " ")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(.)\1{2,}", "$1$1"), r" +", " "))


def csv_safe(value: Column) -> Column:
    """A leading quote for values that a spreadsheet would take for a formula."""
    return F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)


def little_endian(hex4: Column) -> Column:
    """The number of two hex bytes, low byte first."""
    return F.conv(F.concat(F.substring(hex4, 3, 2), F.substring(hex4, 1, 2)), 16, 10).cast("long")


def region_health(active: Column, total: Column, packets: Column, minutes: Column) -> Column:
    """0 to 100: freshness .4, availability .3, traffic .2, diversity .1."""
    fresh = clamp(100 * (60 - minutes) / 55.0, 0, 100)
    available = F.when(active >= 2, 100.0).when(active == 1, 60.0).otherwise(0.0)
    traffic = clamp(100 * F.log10(packets + 1.0) / 4, 0, 100)
    diverse = clamp(100 * total / 3.0, 0, 100)
    return F.floor(0.4 * fresh + 0.3 * available + 0.2 * traffic + 0.1 * diverse + 0.5)
