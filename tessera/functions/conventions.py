"""Conventions of scientific data, as DataFrame expressions: fill values, scaling, times, strings, coordinates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SECONDS = {"microsecond": 1e-6, "millisecond": 1e-3, "second": 1, "sec": 1, "s": 1, "minute": 60, "min": 60, "hour": 3600, "hr": 3600, "h": 3600, "day": 86400, "d": 86400, "week": 604800}


def resolve_fill_value(attrs: dict[str, object]) -> tuple[object | None, dict[str, object]]:
    """The missing-data marker of a variable and its other attributes; two markers must agree."""
    rest = {k: v for k, v in attrs.items() if k not in ("_FillValue", "missing_value")}
    found = [attrs[k] for k in ("_FillValue", "missing_value") if attrs.get(k) is not None]
    if len(found) == 2 and found[0] != found[1] and not all(isinstance(x, float) and math.isnan(x) for x in found):
        raise ValueError(f"_FillValue {found[0]!r} and missing_value {found[1]!r} differ")
    return (found[0] if found else None), rest


def apply_fill_value(value: Column, marker: object, fill: object | None = None) -> Column:
    """``value`` where it differs from ``marker``, else ``fill`` (None: null). A NaN marker matches NaN."""
    return F.when(value == F.lit(marker), F.lit(fill)).otherwise(value)


def mask_and_scale(value: Column, scale: float = 1.0, offset: float = 0.0, marker: object | None = None) -> Column:
    """Physical values: nulls for the marker, then ``value * scale + offset`` in double."""
    masked = value if marker is None else apply_fill_value(value, marker)
    return masked.cast("double") * F.lit(float(scale)) + F.lit(float(offset))


def parse_time_units(units: str) -> tuple[float, str]:
    """Seconds of a unit, and the epoch, of ``<unit> since <date>``."""
    m = re.fullmatch(r"\s*(\w+?)s?\s+since\s+(.+?)\s*(?:Z|UTC)?\s*", units, re.IGNORECASE)
    unit = m and m[1].lower()
    if not m or unit not in _SECONDS:
        raise ValueError(f"unknown time units {units!r}")
    return _SECONDS[unit], m[2].replace("T", " ")


def decode_times(value: Column, units: str) -> Column:
    """Numbers in ``<unit> since <date>`` as timestamps without time zone, to the microsecond."""
    seconds, epoch = parse_time_units(units)
    micros = F.round(value.cast("double") * F.lit(seconds * 1e6)).cast("long")
    shift = F.make_dt_interval(secs=(micros / F.lit(1_000_000)).cast("decimal(18,6)"))
    return F.lit(epoch).cast("timestamp_ntz") + shift


#: Days of a year, and of its months, in calendars whose years are all alike.
_MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
UNIFORM_CALENDARS = {"360_day": (30,) * 12, "noleap": _MONTHS, "365_day": _MONTHS, "all_leap": (31, 29, *_MONTHS[2:]), "366_day": (31, 29, *_MONTHS[2:])}
STANDARD_CALENDARS = ("standard", "gregorian", "proleptic_gregorian")


def decode_calendar_times(value: Column, units: str, calendar: str) -> Column:
    """Numbers in ``<unit> since <date>`` of a calendar of equal years, as struct<year, month, day, hour, minute, second, microsecond>.

    Such calendars have dates that timestamps lack, as 30 February. Units may also be years, and in the 360-day
    calendar months. Null stays null.
    """
    lengths = UNIFORM_CALENDARS.get(calendar.lower())
    if lengths is None:
        raise ValueError(f"unknown calendar {calendar!r}")
    m = re.fullmatch(r"\s*(year|month)s?\s+since\s+(.+)", units, re.IGNORECASE)
    if m and (m[1].lower() == "year" or len(set(lengths)) == 1):
        days, epoch = (sum(lengths) if m[1].lower() == "year" else lengths[0]), parse_time_units(f"days since {m[2]}")[1]
        seconds = 86400.0 * days
    else:
        seconds, epoch = parse_time_units(units)
    at = re.fullmatch(r"(-?\d+)-(\d+)-(\d+)(?:\s+(\d+):(\d+)(?::(\d+(?:\.\d+)?))?)?", epoch.strip())
    if not at:
        raise ValueError(f"unknown date {epoch!r}")
    year, month, day, hour, minute = (int(x or 0) for x in at.groups()[:5])
    before = [sum(lengths[:k]) for k in range(12)]
    start = (year * sum(lengths) + before[month - 1] + day - 1) * 86400 + hour * 3600 + minute * 60
    micros = F.round(value.cast("double") * F.lit(seconds * 1e6)).cast("long") + F.lit(start * 1_000_000 + round(float(at[6] or 0) * 1e6)).cast("long")
    number, rest = F.floor(micros / F.lit(86_400_000_000)), F.pmod(micros, F.lit(86_400_000_000))
    of_year = F.pmod(number, F.lit(sum(lengths)))
    in_month = sum((of_year >= b).cast("int") for b in before)
    first = F.element_at(F.array(*[F.lit(b) for b in before]), in_month)
    part = lambda unit, size: F.pmod(F.floor(rest / F.lit(unit)), F.lit(size)).cast("int")
    fields = {
        "year": F.floor(number / F.lit(sum(lengths))).cast("int"), "month": in_month, "day": (of_year - first + 1).cast("int"),
        "hour": part(3_600_000_000, 24), "minute": part(60_000_000, 60), "second": part(1_000_000, 60), "microsecond": part(1, 1_000_000),
    }
    return F.when(value.isNotNull(), F.struct(*[c.alias(n) for n, c in fields.items()]))


def is_time_unit(unit: str) -> bool:
    """Whether numbers of this unit are spans of time."""
    return unit.lower().removesuffix("s") in _SECONDS or unit.lower() in _SECONDS


def decode_timedelta(value: Column, unit: str) -> Column:
    """Numbers of a time unit as day-time intervals."""
    seconds = _SECONDS.get(unit.lower().removesuffix("s") or unit.lower(), _SECONDS.get(unit.lower()))
    if seconds is None:
        raise ValueError(f"unknown time unit {unit!r}")
    return F.make_dt_interval(secs=F.round(value.cast("double") * F.lit(float(seconds)), 6).cast("decimal(18,6)"))


def fixed_string(value: Column) -> Column:
    """Text of a fixed-length byte field that is padded with NULs."""
    return F.regexp_replace(F.decode(value, "UTF-8"), "\\x00+$", "")


def concat_characters(df: DataFrame, keys: list[str], position: str, char: str, out: str) -> DataFrame:
    """Strings from single characters along the last dimension, without padding NULs."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(char).alias("c"))))
    joined = F.array_join(F.transform(parts, lambda x: x["c"]), "")
    return df.groupBy(*keys).agg(F.regexp_replace(joined, "\\x00+$", "").alias(out))


def decode_coords(cells: DataFrame, coords: DataFrame, on: dict[str, str], values: list[str]) -> DataFrame:
    """Cells with coordinate values attached; ``on`` maps a cell index column to the coordinate table's.

    The planner broadcasts the coordinate table if its size is below the session's threshold.
    """
    side = coords.select(*[F.col(b).alias(f"_{a}") for a, b in on.items()], *values)
    met = [F.col(a) == F.col(f"_{a}") for a in on]
    return cells.join(side, met, "left").drop(*[f"_{a}" for a in on])
