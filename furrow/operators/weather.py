"""Weather: local days of hourly readings, daily measures, checks, forecasts, status and counts."""

from __future__ import annotations

import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.functions import expressions as E
from furrow.operators import daily_state

FORECAST_DAYS = 9
SHOWN_BEFORE, SHOWN_AFTER, SHOWN_MEASURED = 30, 8, 14
FORECAST_SCHEMA = "daily struct<time: array<string>, temperature_2m_min: array<double>, temperature_2m_max: array<double>, shortwave_radiation_sum: array<double>>, hourly struct<time: array<string>, wind_speed_10m: array<double>>"


def day_spine(spark, start: datetime.date, end: datetime.date) -> DataFrame:  # noqa: ANN001
    """One row (day) for each day from start to end; none if they are the wrong way round."""
    first, last = F.lit(start), F.lit(end)
    days = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(F.expr("cast(array() as array<date>)"))
    return spark.range(1).select(F.explode(days).alias("day"))


def month_starts(start: Column, end: Column) -> Column:
    """The first days of the months from that of start to that of end; none if they are the wrong way round."""
    first, last = F.trunc(start, "month"), F.trunc(end, "month")
    return F.when(first <= last, F.sequence(first, F.greatest(first, last), F.expr("INTERVAL 1 MONTH"))).otherwise(F.expr("cast(array() as array<date>)"))


def months(spark, start: datetime.date, end: datetime.date) -> DataFrame:  # noqa: ANN001
    """(year, month) from the month of start to the month of end."""
    first = day_spine(spark, start.replace(day=1), end).where(F.dayofmonth("day") == 1)
    return first.select(F.year("day").alias("year"), F.month("day").alias("month"))


def of_station(readings: DataFrame, name: str, exact: bool = False) -> DataFrame:
    """Readings of stations whose name holds the text, in either case; or exactly that station's."""
    return readings.where(F.col("station") == name) if exact else readings.where(F.contains(F.lower("station"), F.lower(F.lit(name))))


def near_months(start: datetime.date, end: datetime.date) -> Column:
    """Whether year and month are among those from start to end: plain comparisons, which a scan can push down."""
    year, month = F.col("year"), F.col("month")
    parts = [(year == y) & month.between(start.month if y == start.year else 1, end.month if y == end.year else 12) for y in range(start.year, end.year + 1)]
    return reduce(or_, parts, F.lit(False))


def with_local_day(readings: DataFrame, zone: str = E.HOME_ZONE) -> DataFrame:
    """Readings with ``day`` and a parsed value; those with an impossible time or no number go."""
    time = E.utc_time(*[F.col(c) for c in ("year", "month", "day", "hour")])
    parsed = readings.withColumns({"local_day": E.local_day(time, zone), "number": E.safe_float(F.col("value").cast("string"))})
    return parsed.where("local_day IS NOT NULL AND number IS NOT NULL")


def daily_air(readings: DataFrame, start: datetime.date, end: datetime.date, zone: str = E.HOME_ZONE) -> DataFrame:
    """(day, t_min, t_max, wind_avg) by local day from hourly readings; means are exactly rounded.

    A local day begins on the UTC day before, so the UTC days read are one more.  Readings with a ``time`` are also
    asked for by a range of it.
    """
    day_before = start - datetime.timedelta(days=1)
    utc_day = E.calendar_day(F.col("year"), F.col("month"), F.col("day"))
    near = readings.where(near_months(day_before, end) & F.col("element").isin(*daily_state.AIR) & utc_day.between(F.lit(day_before), F.lit(end)))
    if "time" in readings.columns:
        near = near.where(E.within_days(F.col("time"), start, end, zone))
    if "seq" not in readings.columns:
        near = near.withColumn("seq", F.lit(0))
    air = daily_state.state(near, zone).where(F.col("day").between(F.lit(start), F.lit(end)))
    return daily_state.measures(air).drop("radiation")


def daily_radiation(readings: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """(day, radiation): the last number of each day by ``seq``, without a change of zone."""
    day = E.calendar_day(F.col("year"), F.col("month"), F.col("day"))
    near = readings.where(near_months(start, end) & (F.col("element") == "DRQS"))
    if "time" in readings.columns:
        near = near.where(E.within_days(F.col("time"), start, end, "UTC"))
    parsed = near.select(day.alias("on"), E.safe_float(F.col("value").cast("string")).alias("number"), "seq")
    known = parsed.where(F.col("number").isNotNull() & F.col("on").between(F.lit(start), F.lit(end)))
    return known.groupBy(F.col("on").alias("day")).agg(F.max_by("number", "seq").alias("radiation"))


def measured(readings: DataFrame, radiation: DataFrame, start: datetime.date, end: datetime.date, zone: str = E.HOME_ZONE) -> DataFrame:
    """One checked row for each day from start to end, with or without data."""
    days = day_spine(readings.sparkSession, start, end)
    return judged(days.join(daily_air(readings, start, end, zone), "day", "left").join(daily_radiation(radiation, start, end), "day", "left"))


def judged(days: DataFrame) -> DataFrame:
    """One checked weather row for each (day, t_min, t_max, wind_avg, radiation)."""
    problems = E.measured_problems(F.col("t_min"), F.col("t_max"), F.col("wind_avg"), F.col("radiation"))
    return days.select(
        F.col("day").alias("weather_date"),
        F.lit("measured").alias("data_kind"),
        F.col("t_min").alias("temp_min_c"),
        F.col("t_max").alias("temp_max_c"),
        F.col("wind_avg").alias("wind_avg_ms"),
        F.col("radiation").alias("radiation_mj_m2"),
        (F.size(problems) == 0).alias("checked"),
        E.message(problems, "checked").alias("check_message"),
    )


def counters(rows: DataFrame) -> DataFrame:
    """One row: how many days were saved, and how many of them are checked."""
    return rows.agg(F.count("*").alias("saved"), F.count_if("checked").alias("checked"))


def forecast(payloads: DataFrame) -> DataFrame:
    """One row for each day that a payload (column ``json``) names, joined by place and by day; nothing is judged.

    Parallel arrays pair up to the shorter one for the hours, and by the days' own array for the days.
    """
    parsed = payloads.select(F.monotonically_increasing_id().alias("payload"), F.from_json("json", FORECAST_SCHEMA).alias("p"))
    empty = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as array<{kind}>)"))
    hours = F.arrays_zip(empty("p.hourly.time", "string").alias("time"), empty("p.hourly.wind_speed_10m", "double").alias("wind"))
    wind = parsed.select("payload", F.explode(hours).alias("h")).where("h.time IS NOT NULL AND h.wind IS NOT NULL")
    wind = exact.means(wind.select("payload", F.substring("h.time", 1, 10).alias("key"), "h.wind"), ["payload", "key"], F.col("wind"), "wind")
    days = parsed.select("payload", "p", F.posexplode(empty("p.daily.time", "string")).alias("i", "key"))
    at = lambda name: F.get(F.col(f"p.daily.{name}"), F.col("i"))
    days = days.select("payload", "key", at("temperature_2m_min").alias("t_min"), at("temperature_2m_max").alias("t_max"), at("shortwave_radiation_sum").alias("radiation"))
    joined = days.join(wind, ["payload", "key"], "left")
    problems = E.forecast_problems(F.col("t_min"), F.col("t_max"), F.col("wind"), F.col("radiation"))
    return joined.select(
        F.to_date("key").alias("weather_date"),
        F.lit("forecast").alias("data_kind"),
        F.col("t_min").alias("temp_min_c"),
        F.col("t_max").alias("temp_max_c"),
        F.col("wind").alias("wind_avg_ms"),
        F.col("radiation").alias("radiation_mj_m2"),
        (F.size(problems) == 0).alias("checked"),
        E.message(problems, "forecast available").alias("check_message"),
    )


def status(days: DataFrame, weather: DataFrame) -> DataFrame:
    """(weather_date, is_complete, missing_fields): one row for each asked day, also for days without data."""
    joined = days.select("weather_date").join(weather, "weather_date", "left")
    return joined.select("weather_date", E.is_complete().alias("is_complete"), E.missing_fields().alias("missing_fields"))


def on_day(weather: DataFrame, day: datetime.date) -> DataFrame:
    return weather.where(F.col("weather_date") == F.lit(day)).limit(1)


def between(weather: DataFrame, start: datetime.date, end: datetime.date) -> DataFrame:
    """Rows from start to end, both included, in order."""
    return weather.where(F.col("weather_date").between(F.lit(start), F.lit(end))).orderBy("weather_date")


def shown(weather: DataFrame, today: datetime.date) -> DataFrame:
    return between(weather, today - datetime.timedelta(days=SHOWN_BEFORE), today + datetime.timedelta(days=SHOWN_AFTER))


def counts(weather: DataFrame) -> DataFrame:
    """One row: measured days, checked ones among them, forecast days."""
    kind = F.col("data_kind")
    return weather.agg(F.count_if(kind == "measured").alias("measured"), F.count_if((kind == "measured") & F.coalesce("checked", F.lit(False))).alias("measured_checked"), F.count_if(kind == "forecast").alias("forecast"))


def latest_measured(weather: DataFrame, rows: int = SHOWN_MEASURED) -> DataFrame:
    """The last measured days, newest first, as shown to people."""
    last = weather.where("data_kind = 'measured'").orderBy(F.desc("weather_date")).limit(rows)
    label = F.when(F.coalesce("checked", F.lit(False)), "checked").otherwise("check")
    return last.select("weather_date", "temp_min_c", "temp_max_c", "wind_avg_ms", "radiation_mj_m2", label.alias("status"), "check_message")
