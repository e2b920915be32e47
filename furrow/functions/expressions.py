"""Column expressions shared by the operators: intervals, calendar days, parsing, and data checks."""

from __future__ import annotations

import datetime
from functools import reduce
from operator import and_
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

HOME_ZONE = "Europe/Tallinn"

#: Columns that a complete weather day has, and the names of missing ones, in the order shown.
COMPLETE_COLUMNS = (
    ("temp_avg_c", "temp_avg"),
    ("temp_min_c", "temp_min"),
    ("temp_max_c", "temp_max"),
    ("humidity_avg_pct", "humidity_avg"),
    ("precipitation_mm", "precipitation"),
    ("wind_avg_ms", "wind_avg"),
    ("wind_gust_ms", "wind_gust"),
    ("radiation_mj_m2", "radiation"),
)
#: Plausible ranges, both ends included.
TEMPERATURE_RANGE, WIND_RANGE, RADIATION_RANGE = (-50, 50), (0, 50), (0, 45)


def fallback_interval(position: Column) -> Column:
    """Days assumed for a field that was never harvested before: 5, 5, 4 in turn by plan position; 5 if unplanned."""
    return F.when(F.pmod(position - 1, F.lit(3)) == 2, 4).otherwise(5).cast("int")


def days_between(earlier: Column, later: Column) -> Column:
    return F.datediff(later, earlier).cast("int")


_DIGITS = r"[0-9](_?[0-9])*"
#: Texts that are numbers: digits may be grouped by single underscores; no suffixes.
NUMBER = rf"[+-]?(({_DIGITS})\.?({_DIGITS})?([eE][+-]?{_DIGITS})?|\.{_DIGITS}([eE][+-]?{_DIGITS})?|(?i:inf(inity)?))"


def safe_float(value: Column) -> Column:
    """The number in a text, or null; NaN counts as missing.  White space around it is allowed, ``1.5d`` is no number."""
    text = F.regexp_extract(value, rf"^\s*({NUMBER})\s*$", 1)
    return F.regexp_replace(text, "_", "").try_cast("double")


def utc_time(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """A timestamp without zone from its parts; a missing hour is 0 and an impossible time is null."""
    whole = lambda c: c.try_cast("int")
    return F.try_make_timestamp_ntz(whole(year), whole(month), whole(day), F.coalesce(whole(hour), F.lit(0)), F.lit(0), F.lit(0))


def local_day(time: Column, zone: str = HOME_ZONE) -> Column:
    """The calendar day of a UTC time in a zone, whatever the session's time zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), time))


def within_days(time: Column, start: datetime.date, end: datetime.date, zone: str = HOME_ZONE) -> Column:
    """A plain range of UTC times that holds every time of the local days from start to end, which a scan can use.

    The range is exact where midnights are; a filter on ``local_day`` still belongs beside it.
    """
    midnight = datetime.time(0)
    first = datetime.datetime.combine(start, midnight, ZoneInfo(zone))
    past = datetime.datetime.combine(end + datetime.timedelta(days=1), midnight, ZoneInfo(zone)).replace(fold=1)
    utc = lambda t: F.lit(t.astimezone(datetime.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    return (time >= utc(first)) & (time < utc(past))


def calendar_day(year: Column, month: Column, day: Column) -> Column:
    """The date from its parts, or null."""
    return F.to_date(utc_time(year, month, day, F.lit(None)))


def season_start(day: Column) -> Column:
    """July 1st of the day's year."""
    return F.make_date(F.year(day), F.lit(7), F.lit(1))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def is_complete() -> Column:
    return reduce(and_, [F.col(c).isNotNull() for c, _ in COMPLETE_COLUMNS])


def missing_fields() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(name)) for c, name in COMPLETE_COLUMNS]))


def _checked(value: Column, bounds: tuple[int, int], name: str) -> Column:
    return F.when(value.isNull(), f"{name}_missing").when(~value.between(*bounds), f"{name}_implausible")


def measured_problems(t_min: Column, t_max: Column, wind: Column, radiation: Column) -> Column:
    """Codes of what is wrong with a measured day, in a fixed order."""
    return F.array_compact(
        F.array(
            _checked(t_min, TEMPERATURE_RANGE, "temp_min"),
            _checked(t_max, TEMPERATURE_RANGE, "temp_max"),
            F.when(t_min > t_max, "temp_swapped"),
            _checked(wind, WIND_RANGE, "wind"),
            _checked(radiation, RADIATION_RANGE, "radiation"),
        )
    )


def forecast_problems(t_min: Column, t_max: Column, wind: Column, radiation: Column) -> Column:
    """Codes of what a forecast day lacks; values aren't judged."""
    return F.array_compact(F.array(F.when(t_min.isNull() | t_max.isNull(), "temp_forecast_missing"), F.when(wind.isNull(), "wind_forecast_missing"), F.when(radiation.isNull(), "radiation_forecast_missing")))


def message(problems: Column, fine: str) -> Column:
    return F.when(F.size(problems) == 0, F.lit(fine)).otherwise(F.array_join(problems, "; "))


def local_second(time: Column, zone: str = HOME_ZONE) -> Column:
    """A UTC time without zone as text in a zone, to the second, with the zone's offset then."""
    utc = time.cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    minutes = F.timestamp_diff("MINUTE", utc, local)
    sign = F.when(minutes < 0, "-").otherwise("+")
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), sign, F.lpad((F.abs(minutes) / 60).cast("int").cast("string"), 2, "0"), F.lit(":"), F.lpad((F.abs(minutes) % 60).cast("string"), 2, "0"))
