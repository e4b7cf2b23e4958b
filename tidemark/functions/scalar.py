"""Scalar rules on columns: missing values, decibels, time, sizes and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0
#: The event window in local time (+01:00), half-open.
EVENT_START = "2024-07-03T00:00:00+01:00"
EVENT_END = "2024-07-05T00:00:00+01:00"


def finite(c: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; null stays null."""
    return ~F.isnan(c) & (F.abs(c) < float("inf"))


def known(c: Column, *missing: float) -> Column:
    """The value, or null where it is not finite or one of the ``missing`` marks."""
    keep = finite(c)
    for m in missing:
        keep = keep & (c != F.lit(m))
    return F.when(keep, c)


def decibel(c: Column) -> Column:
    """10 log10 of a positive value, computed in double and kept as float; null otherwise."""
    return F.when(c > 0, (10 * F.log10(c.cast("double"))).cast("float"))


def change(before: Column, after: Column) -> Column:
    """Float after less float before."""
    return (after - before).cast("float")


def event_period(ts: Column, start: str = EVENT_START, end: str = EVENT_END) -> Column:
    """'before', 'during' or 'after' a half-open window."""
    return F.when(ts < F.to_timestamp(F.lit(start)), "before").when(ts < F.to_timestamp(F.lit(end)), "during").when(ts.isNotNull(), "after")


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000)


def square_metres(pixels: Column) -> Column:
    return pixels * F.lit(100.0)


def hectares(pixels: Column) -> Column:
    return pixels * F.lit(0.01)


def square_kilometres(pixels: Column) -> Column:
    return pixels * F.lit(0.0001)


def slope_degrees(dx: Column, dy: Column) -> Column:
    return F.degrees(F.atan(F.hypot(dx, dy)))


def near(a: Column, b: Column, tolerance: float | Column) -> Column:
    """Within a tolerance, which may depend on the row."""
    return F.abs(a - b) <= (tolerance if isinstance(tolerance, Column) else F.lit(tolerance))


def patch_name(rank: Column) -> Column:
    return F.format_string("C%04d", rank)


def dem_tile(lat: Column, lon: Column) -> Column:
    """Name of the one-degree elevation tile whose lower left corner is (lat, lon)."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.format_string("DEM_%s%02d_00_%s%03d_00", ns, F.abs(lat).cast("int"), ew, F.abs(lon).cast("int"))


def day_layer(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd")
