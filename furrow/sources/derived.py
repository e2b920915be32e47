"""The logical tables as relations over the driver's star schema, in DataFrames and as SQL common table expressions.

``WITH`` holds the same derivations for the oracle, so both sides of a comparison start from one definition.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.functions import expressions as E
from furrow.operators import weather as weather_ops

FIELD_COUNT, HARVESTED_FIELDS = 14, 12
PLAN_START, PLAN_END = datetime.date(1995, 1, 1), datetime.date(2001, 11, 1)
WEATHER_START, WEATHER_END = datetime.date(2023, 12, 31), datetime.date(2024, 2, 1)
#: Days from here on count as forecast in the derived weather table.
FORECAST_FROM = datetime.date(2024, 1, 25)
#: The first of the days that events edit; the last ones are after all orders.
EDITS_START = datetime.date(2001, 6, 1)
ELEMENTS = {"click": "TA", "view": "WS10M", "purchase": "DRQS"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(spark: SparkSession, count: int = FIELD_COUNT, prefix: str = "Field ") -> DataFrame:
    ids = spark.range(1, count + 1).select(F.col("id").cast("int").alias("id"))
    return ids.withColumn("name", F.concat(F.lit(prefix), F.col("id").cast("string")))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as fields."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("id"), F.col("s_name").alias("name"))


def order_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each day's orders ask for: the suppliers of their lines, in the order in which they are asked first."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("plan_date"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").cast("int").alias("field_id"))
    asked = orders.join(lines, "o_orderkey").groupBy("plan_date", "field_id").agg(F.min("o_orderkey").alias("first"))
    turn = F.row_number().over(Window.partitionBy("plan_date").orderBy("first", "field_id"))
    return asked.select("plan_date", "field_id", turn.cast("int").alias("position"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(harvest_date, field_id) of every line shipped."""
    return table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("harvest_date"), F.col("l_suppkey").cast("int").alias("field_id"))


def plan_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as edits of the order plan, in the order of their ids; errors name a field that doesn't exist."""
    kind = F.when(F.col("event_type") == "purchase", "remove").when(F.col("event_type") == "signup", "default").otherwise("add")
    field = F.when(F.col("event_type") == "error", -1).otherwise(F.col("event_id") % 29).cast("int")
    day = F.date_add(F.lit(EDITS_START), (F.col("user_id") % 120).cast("int"))
    return table(spark, sf_dir, "events").select(day.alias("plan_date"), F.col("event_id").alias("seq"), kind.alias("kind"), field.alias("field_id"))


def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as writes of one setting, in the order of their ids."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forecast payload (json) for each user, gathered from its events by day and by hour, so bounded by the calendar."""
    events = table(spark, sf_dir, "events")
    value = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    gathered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    every = lambda rows, c: F.transform(rows, lambda r: r[c])
    days = events.groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("time")).agg(F.min(value("click")).alias("low"), F.max(value("click")).alias("high"), F.sum(value("purchase").cast("decimal(12,2)")).cast("double").alias("sun"))
    days = days.groupBy("user_id").agg(gathered("time", "low", "high", "sun").alias("d"))
    hours = events.where("event_type = 'view'").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:00").alias("time")).agg(F.max("value").alias("wind"))
    hours = hours.groupBy("user_id").agg(gathered("time", "wind").alias("h"))
    daily = F.struct(every("d", "time").alias("time"), every("d", "low").alias("temperature_2m_min"), every("d", "high").alias("temperature_2m_max"), every("d", "sun").alias("shortwave_radiation_sum"))
    hourly = F.struct(every("h", "time").alias("time"), every("h", "wind").alias("wind_speed_10m"))
    return days.join(hours, "user_id", "left").select(F.to_json(F.struct(daily.alias("daily"), hourly.alias("hourly"))).alias("json"))


def harvests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem by day and field; the last two fields were never harvested."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select(F.to_date("l_shipdate").alias("harvest_date"), (F.col("l_suppkey") % HARVESTED_FIELDS + 1).cast("int").alias("field_id"), F.col("l_quantity").cast("decimal(12,2)").alias("q"), "l_returnflag", "l_linestatus")
    grade = lambda ok: F.sum(F.when(ok, F.col("q")).otherwise(F.lit(0).cast("decimal(12,2)"))).cast("decimal(12,2)")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    daily = lines.groupBy("harvest_date", "field_id").agg(grade(flag == "A").alias("a"), grade(flag == "N").alias("b"), grade((flag == "R") & (status == "F")).alias("c"), grade((flag == "R") & (status == "O")).alias("xl"))
    before = F.lag("harvest_date").over(Window.partitionBy("field_id").orderBy("harvest_date"))
    return daily.withColumn("interval_days", F.coalesce(F.datediff("harvest_date", before), F.lit(5)).cast("int")).select("harvest_date", "field_id", "interval_days", "a", "b", "c", "xl")


def daily_plan(spark: SparkSession) -> DataFrame:
    months = weather_ops.months(spark, PLAN_START, PLAN_END).select(F.make_date("year", "month", F.lit(1)).alias("plan_date"))
    rows = months.select("plan_date", F.explode(F.sequence(F.lit(1), F.lit(FIELD_COUNT))).alias("field_id")).where((F.col("field_id") + F.month("plan_date")) % 4 == 0)
    turn = F.row_number().over(Window.partitionBy("plan_date").orderBy("field_id"))
    return rows.withColumn("position", turn.cast("int"))


def plan_days(spark: SparkSession) -> DataFrame:
    return daily_plan(spark).select("plan_date").distinct().withColumn("initialized", F.lit(True))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly station readings in long format, with their order of arrival as ``seq`` and their UTC time."""
    events = table(spark, sf_dir, "events")
    element = F.create_map(*[F.lit(x) for pair in ELEMENTS.items() for x in pair])[F.col("event_type")]
    ts = F.col("ts")
    return events.select(
        F.concat(F.lit("Station "), F.col("user_id").cast("string")).alias("station"),
        F.year(ts).alias("year"),
        F.month(ts).alias("month"),
        F.dayofmonth(ts).alias("day"),
        F.hour(ts).alias("hour"),
        (F.col("value") / 4).alias("value"),
        element.alias("element"),
        F.col("event_id").alias("seq"),
        ts.cast("timestamp_ntz").alias("time"),
    ).where("element IS NOT NULL")


def weather(spark: SparkSession, sf_dir: str, start: datetime.date = WEATHER_START, end: datetime.date = WEATHER_END) -> DataFrame:
    """The derived weather table, or its days from start to end, which ask the scan of events for a range of times."""
    start, end = max(start, WEATHER_START), min(end, WEATHER_END)
    events = table(spark, sf_dir, "events").where(E.within_days(F.col("ts"), start, end)).withColumn("weather_date", E.local_day(F.col("ts")))
    value = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    daily = events.groupBy("weather_date").agg(
        F.avg(value("click")).alias("temp_avg_c"),
        F.min(value("click")).alias("temp_min_c"),
        F.max(value("click")).alias("temp_max_c"),
        F.when(F.count(value("signup")) > 0, F.least(F.lit(100.0), F.avg(value("signup")))).alias("humidity_avg_pct"),
        F.sum(value("error").cast("decimal(12,2)")).cast("decimal(12,2)").alias("precipitation_mm"),
        F.avg(value("view")).alias("wind_avg_ms"),
        F.max(value("view")).alias("wind_gust_ms"),
        F.max_by(value("purchase") / 4, F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("radiation_mj_m2"),
    )
    spine = weather_ops.day_spine(spark, start, end).withColumnRenamed("day", "weather_date")
    problems = E.measured_problems(F.col("temp_min_c"), F.col("temp_max_c"), F.col("wind_avg_ms"), F.col("radiation_mj_m2"))
    return spine.join(daily, "weather_date", "left").withColumns(
        {"data_kind": F.when(F.col("weather_date") < F.lit(FORECAST_FROM), "measured").otherwise("forecast"), "checked": F.size(problems) == 0, "check_message": E.message(problems, "checked")}
    )


def _mean(value: str) -> str:
    return f"avg({value})"


def _problem(value: str, low: int, high: int, name: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '{name}_missing' WHEN NOT {value} BETWEEN {low} AND {high} THEN '{name}_implausible' END"


def problems_sql(t_min: str, t_max: str, wind: str, radiation: str) -> str:
    parts = [_problem(t_min, -50, 50, "temp_min"), _problem(t_max, -50, 50, "temp_max"), f"CASE WHEN {t_min} > {t_max} THEN 'temp_swapped' END", _problem(wind, 0, 50, "wind"), _problem(radiation, 0, 45, "radiation")]
    return f"concat_ws('; ', {', '.join(parts)})"


_LOCAL = "CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Tallinn' AS DATE)"
WITH = {
    "suppliers": "suppliers AS (SELECT CAST(s_suppkey AS INTEGER) AS id, s_name AS name FROM supplier)",
    "order_plan": """order_plan AS (SELECT plan_date, field_id, CAST(row_number() OVER (PARTITION BY plan_date ORDER BY asked, field_id) AS INTEGER) AS position
  FROM (SELECT CAST(o_orderdate AS DATE) AS plan_date, CAST(l_suppkey AS INTEGER) AS field_id, min(o_orderkey) AS asked FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2))""",
    "shipments": "shipments AS (SELECT CAST(l_shipdate AS DATE) AS harvest_date, CAST(l_suppkey AS INTEGER) AS field_id FROM lineitem)",
    "fields": "fields AS (SELECT CAST(i AS INTEGER) AS id, 'Field ' || i AS name FROM range(1, 15) t(i))",
    "events_local": "events_local AS (SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Tallinn' AS l FROM events)",
    "harvests": """lines AS (SELECT CAST(l_shipdate AS DATE) AS harvest_date, CAST(l_suppkey % 12 + 1 AS INTEGER) AS field_id, CAST(l_quantity AS DECIMAL(12,2)) AS q, l_returnflag AS f, l_linestatus AS s
  FROM lineitem),
daily_harvest AS (SELECT harvest_date, field_id,
  CAST(sum(CASE WHEN f = 'A' THEN q ELSE 0 END) AS DECIMAL(12,2)) AS a, CAST(sum(CASE WHEN f = 'N' THEN q ELSE 0 END) AS DECIMAL(12,2)) AS b,
  CAST(sum(CASE WHEN f = 'R' AND s = 'F' THEN q ELSE 0 END) AS DECIMAL(12,2)) AS c, CAST(sum(CASE WHEN f = 'R' AND s = 'O' THEN q ELSE 0 END) AS DECIMAL(12,2)) AS xl
  FROM lines GROUP BY harvest_date, field_id),
harvests AS (SELECT harvest_date, field_id, coalesce(CAST(harvest_date - lag(harvest_date) OVER (PARTITION BY field_id ORDER BY harvest_date) AS INTEGER), 5) AS interval_days, a, b, c, xl FROM daily_harvest)""",
    "plan": """daily_plan AS (SELECT plan_date, field_id, CAST(row_number() OVER (PARTITION BY plan_date ORDER BY field_id) AS INTEGER) AS position
  FROM (SELECT CAST(m AS DATE) AS plan_date FROM (SELECT unnest(generate_series(DATE '1995-01-01', DATE '2001-11-01', INTERVAL 1 MONTH)) AS m)),
       (SELECT CAST(i AS INTEGER) AS field_id FROM range(1, 15) t(i)) WHERE (field_id + month(plan_date)) % 4 = 0)""",
    "readings": f"""readings AS (SELECT 'Station ' || user_id AS station, value / 4 AS number, CASE event_type WHEN 'click' THEN 'TA' WHEN 'view' THEN 'WS10M' WHEN 'purchase' THEN 'DRQS' END AS element,
  event_id AS seq, CAST(ts AS DATE) AS utc_day, CAST(date_trunc('hour', ts) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Tallinn' AS DATE) AS local_day
  FROM events WHERE event_type IN ('click', 'view', 'purchase'))""",
    "weather": f"""daily_weather AS (SELECT {_LOCAL} AS weather_date,
  {_mean("CASE WHEN event_type = 'click' THEN value END")} AS temp_avg_c, min(CASE WHEN event_type = 'click' THEN value END) AS temp_min_c, max(CASE WHEN event_type = 'click' THEN value END) AS temp_max_c,
  {_mean("CASE WHEN event_type = 'signup' THEN value END")} AS humidity, CAST(sum(CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(12,2)) END) AS DECIMAL(12,2)) AS precipitation_mm,
  {_mean("CASE WHEN event_type = 'view' THEN value END")} AS wind_avg_ms, max(CASE WHEN event_type = 'view' THEN value END) AS wind_gust_ms,
  arg_max(value / 4, event_id) FILTER (WHERE event_type = 'purchase') AS radiation_mj_m2
  FROM events GROUP BY 1),
w0 AS (SELECT s.weather_date, temp_avg_c, temp_min_c, temp_max_c, CASE WHEN humidity IS NOT NULL THEN least(100.0::DOUBLE, humidity) END AS humidity_avg_pct, precipitation_mm, wind_avg_ms, wind_gust_ms, radiation_mj_m2,
  CASE WHEN s.weather_date < DATE '2024-01-25' THEN 'measured' ELSE 'forecast' END AS data_kind, {problems_sql("temp_min_c", "temp_max_c", "wind_avg_ms", "radiation_mj_m2")} AS problems
  FROM (SELECT CAST(d AS DATE) AS weather_date FROM (SELECT unnest(generate_series(DATE '2023-12-31', DATE '2024-02-01', INTERVAL 1 DAY)) AS d)) s LEFT JOIN daily_weather d USING (weather_date)),
weather AS (SELECT weather_date, temp_avg_c, temp_min_c, temp_max_c, humidity_avg_pct, precipitation_mm, wind_avg_ms, wind_gust_ms, radiation_mj_m2, data_kind,
  problems = '' AS checked, CASE WHEN problems = '' THEN 'checked' ELSE problems END AS check_message FROM w0)""",
}


def with_sql(*names: str) -> str:
    return "WITH " + ",\n".join(WITH[n] for n in names) + "\n"
