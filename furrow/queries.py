"""The registry of harvest, plan and weather queries, each over the derived relations, with the SQL that equals it."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.functions import expressions as E
from furrow.operators import asof
from furrow.operators import constraints as C
from furrow.operators import daily_state
from furrow.operators import harvests as H
from furrow.operators import upsert as U
from furrow.operators import weather as W
from furrow.plans import daily as P
from furrow.plans import edits, sql_functions
from furrow.sources import derived as D
from furrow.sources.derived import with_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = datetime.date(1998, 7, 1)
START, END, TODAY = datetime.date(2024, 1, 1), datetime.date(2024, 1, 31), datetime.date(2024, 1, 20)


#: Added to a mean before it is shown to six places, so that ties, and sums in another order, round alike.
_PAST_TIES = 1e-11


def query(sql: str, decimals: tuple[str, ...] = (), means: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Registers a query; both sides show its decimal columns as doubles, and its means to six places."""

    def register(f: Query) -> Query:
        def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in decimals} | {c: F.round(F.col(c) + _PAST_TIES, 6) for c in means})

        QUERIES[f.__name__] = shown if decimals or means else f
        replaced = [f"CAST({c} AS DOUBLE) AS {c}" for c in decimals] + [f"round({c} + {_PAST_TIES}, 6) AS {c}" for c in means]
        ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(replaced)}) FROM ({sql})" if replaced else sql
        return f

    return register


@query(with_sql("suppliers") + "SELECT id, name FROM suppliers")
def fields_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.upsert(spark.createDataFrame([], "id int, name string"), D.suppliers(spark, sf_dir), ["id"], ["name"]).select("id", "name").orderBy("id")


def _history_sql(limit: int) -> str:
    return with_sql("fields", "harvests") + f"SELECT harvest_date, name AS field_name, interval_days, a, b, c, xl, CAST(a + b + c + xl AS DECIMAL(15,2)) AS total FROM harvests JOIN fields ON id = field_id ORDER BY harvest_date DESC, field_id LIMIT {limit}"


@query(_history_sql(300), ("a", "b", "c", "xl", "total"))
def harvest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history(D.harvests(spark, sf_dir), D.fields(spark))


@query(_history_sql(1), ("a", "b", "c", "xl", "total"))
def harvest_history_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history(D.harvests(spark, sf_dir), D.fields(spark), 0)


@query(_history_sql(2000), ("a", "b", "c", "xl", "total"))
def harvest_history_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.history(D.harvests(spark, sf_dir), D.fields(spark), 5000)


@query(with_sql("harvests") + "SELECT field_id, interval_days, a, b, c, xl FROM harvests WHERE harvest_date = DATE '1998-07-01'", ("a", "b", "c", "xl"))
def harvest_for_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.for_day(D.harvests(spark, sf_dir), DAY)


@query(with_sql("harvests") + "SELECT field_id, count(*) AS saved, CAST(sum(a + b + c + xl) AS DECIMAL(25,2)) AS total FROM harvests WHERE a + b + c + xl > 0 GROUP BY field_id", ("total",))
def harvest_positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.positive(D.harvests(spark, sf_dir)).groupBy("field_id").agg(F.count("*").alias("saved"), F.sum(H.total()).cast("decimal(25,2)").alias("total"))


@query(with_sql("harvests", "fields") + "SELECT harvest_date AS \"Date\", name AS \"Field\", interval_days AS \"Interval\", a AS \"A\", b AS \"B\", c AS \"C\", xl AS \"XL\", CAST(a + b + c + xl AS DECIMAL(15,2)) AS \"Total\" FROM harvests JOIN fields ON id = field_id ORDER BY harvest_date DESC, field_id LIMIT 300", ("A", "B", "C", "XL", "Total"))
def harvest_history_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.labelled(harvest_history(spark, sf_dir), ["Date", "Field", "Interval", "A", "B", "C", "XL", "Total"])


_INTERVALS = """, found AS (SELECT p.plan_date, p.field_id, p.position, (SELECT max(h.harvest_date) FROM harvests h WHERE h.field_id = p.field_id AND h.harvest_date < p.plan_date) AS last FROM {probes} p),
intervals AS (SELECT plan_date, field_id, position, CAST(CASE WHEN last IS NOT NULL THEN plan_date - last WHEN position IS NOT NULL AND (position - 1) % 3 = 2 THEN 4 ELSE 5 END AS INTEGER) AS interval_days FROM found)
"""


@query(with_sql("harvests", "plan") + ", probes AS (SELECT d.plan_date, f.field_id, p.position FROM (SELECT DISTINCT plan_date FROM daily_plan) d, (SELECT CAST(i AS INTEGER) AS field_id FROM range(1, 15) t(i)) f LEFT JOIN daily_plan p ON p.plan_date = d.plan_date AND p.field_id = f.field_id)" + _INTERVALS.format(probes="probes") + "SELECT plan_date, field_id, interval_days FROM intervals")
def field_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = D.daily_plan(spark)
    probes = D.plan_days(spark).select("plan_date", F.explode(F.sequence(F.lit(1), F.lit(D.FIELD_COUNT))).alias("field_id"))
    return H.intervals(probes, D.harvests(spark, sf_dir), plan)


_PLAN_SQL = with_sql("fields", "harvests", "plan") + _INTERVALS.format(probes="daily_plan") + "SELECT plan_date, field_id, name AS field_name, position, interval_days FROM intervals JOIN fields ON id = field_id"


@query(_PLAN_SQL)
def daily_plan_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_intervals(D.daily_plan(spark), D.fields(spark), D.harvests(spark, sf_dir))


@query(_PLAN_SQL)
def daily_plan_intervals_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, harvests = D.daily_plan(spark), D.harvests(spark, sf_dir)
    return P.with_intervals(plan, D.fields(spark), harvests, H.last_before_subquery(plan, harvests))


_STALEST = ", ranked AS (SELECT id AS field_id, row_number() OVER (ORDER BY last NULLS FIRST, id) AS rn FROM (SELECT id, max(harvest_date) AS last FROM fields LEFT JOIN harvests ON field_id = id GROUP BY id))\n"


@query(with_sql("fields", "harvests") + _STALEST + "SELECT DATE '2002-01-01' AS plan_date, field_id, CAST(rn AS INTEGER) AS position FROM ranked WHERE rn <= 3")
def default_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame([(datetime.date(2002, 1, 1),)], "plan_date date")
    return P.default_plan(days, D.plan_days(spark), D.fields(spark), D.harvests(spark, sf_dir))


@query(with_sql("fields", "harvests") + _STALEST + "SELECT plan_date, field_id, CAST(rn AS INTEGER) AS position FROM ranked, (VALUES (DATE '2001-12-01'), (DATE '2002-01-01')) t(plan_date) WHERE rn <= 3")
def default_plan_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame([(datetime.date(2001, 11, 1),), (datetime.date(2001, 12, 1),), (datetime.date(2002, 1, 1),)], "plan_date date")
    return P.default_plan(days, D.plan_days(spark), D.fields(spark), D.harvests(spark, sf_dir))


@query(with_sql("order_plan") + "SELECT plan_date, field_id, position FROM order_plan UNION ALL SELECT plan_date, 7, CAST(max(position) + 1 AS INTEGER) FROM order_plan GROUP BY plan_date HAVING count(*) FILTER (WHERE field_id = 7) = 0")
def plan_add_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = D.order_plan(spark, sf_dir)
    return P.add_fields(plan, plan.select("plan_date", F.lit(7).alias("field_id")))


@query(with_sql("order_plan") + "SELECT plan_date, field_id, CAST(row_number() OVER (PARTITION BY plan_date ORDER BY position, field_id) AS INTEGER) AS position FROM order_plan WHERE position <> 2")
def plan_remove_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = D.order_plan(spark, sf_dir)
    return P.remove_and_mark(plan, plan.select("plan_date").distinct().withColumn("initialized", F.lit(True)), plan.where("position = 2"))[0]


@query(with_sql("order_plan") + "SELECT plan_date, field_id, position FROM order_plan WHERE plan_date <> DATE '1998-07-01' UNION ALL SELECT DATE '1998-07-01', f, p FROM (VALUES (7, 1), (2, 2), (11, 3), (5, 4)) t(f, p)")
def plan_replace_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.replace_day(D.order_plan(spark, sf_dir), DAY, [7, 2, 11, 5])


@query(with_sql("suppliers", "order_plan") + "SELECT DATE '1998-07-01' AS plan_date, id AS field_id, name AS field_name FROM suppliers WHERE NOT EXISTS (SELECT 1 FROM order_plan p WHERE p.plan_date = DATE '1998-07-01' AND p.field_id = id)")
def fields_not_planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.not_planned_on(DAY, D.suppliers(spark, sf_dir), D.order_plan(spark, sf_dir))


@query(with_sql("suppliers", "order_plan") + "SELECT name, id FROM suppliers WHERE id NOT IN (SELECT field_id FROM order_plan WHERE plan_date = DATE '1998-07-01')")
def free_field_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which field each name means, among those not yet planned for a day."""
    free = P.not_planned_on(DAY, D.suppliers(spark, sf_dir), D.order_plan(spark, sf_dir))
    return P.ids_by_name(free.select(F.col("field_id").alias("id"), F.col("field_name").alias("name"))).select("name", "id")


@query(with_sql("order_plan") + "SELECT plan_date, field_id, position FROM order_plan UNION ALL SELECT DATE '2002-03-01', 5, 1")
def plan_add_known_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame([(datetime.date(2002, 3, 1), 5)], "plan_date date, field_id int")
    plan = D.order_plan(spark, sf_dir)
    return P.add_known_fields(plan, plan.select("plan_date").distinct().withColumn("initialized", F.lit(True)), D.suppliers(spark, sf_dir), added)[0]


@query(with_sql("events_local") + "SELECT event_id, strftime(l, '%Y-%m-%dT%H:%M:%S') || '+02:00' AS local_time FROM events_local")
def events_local_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.table(spark, sf_dir, "events").select("event_id", E.local_second(F.col("ts")).alias("local_time"))


@query(with_sql("harvests", "plan") + "SELECT p.plan_date, p.field_id, position, " + ", ".join(f"CAST(coalesce({g}, 0) AS DECIMAL(12,2)) AS {g}" for g in H.GRADES) + ", h.field_id IS NOT NULL AS saved FROM daily_plan p LEFT JOIN harvests h ON h.harvest_date = p.plan_date AND h.field_id = p.field_id", ("a", "b", "c", "xl"))
def plan_with_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_harvest(D.daily_plan(spark), D.harvests(spark, sf_dir))


@query(with_sql("readings") + "SELECT local_day, element, count(*) AS readings, min(number) AS least, max(number) AS most FROM readings GROUP BY local_day, element")
def readings_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = W.with_local_day(D.readings(spark, sf_dir))
    return local.groupBy("local_day", "element").agg(F.count("*").alias("readings"), F.min("number").alias("least"), F.max("number").alias("most"))


_AIR = """, air AS (SELECT local_day AS day, min(CASE WHEN element = 'TA' THEN number END) AS t_min, max(CASE WHEN element = 'TA' THEN number END) AS t_max,
  avg(CASE WHEN element = 'WS10M' THEN number END) AS wind_avg
  FROM readings WHERE element IN ('TA', 'WS10M') AND local_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY local_day),
rad AS (SELECT utc_day AS day, arg_max(number, seq) AS radiation FROM readings WHERE element = 'DRQS' AND utc_day BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY utc_day),
spine AS (SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d))
"""
_MEASURED = (
    with_sql("readings")
    + _AIR
    + f""", m AS (SELECT day AS weather_date, t_min, t_max, wind_avg, radiation, {D.problems_sql("t_min", "t_max", "wind_avg", "radiation")} AS problems FROM spine LEFT JOIN air USING (day) LEFT JOIN rad USING (day)),
measured AS (SELECT weather_date, 'measured' AS data_kind, t_min AS temp_min_c, t_max AS temp_max_c, wind_avg AS wind_avg_ms, radiation AS radiation_mj_m2, problems = '' AS checked, CASE WHEN problems = '' THEN 'checked' ELSE problems END AS check_message FROM m)
"""
)


@query(with_sql("readings") + _AIR + "SELECT day, t_min, t_max, wind_avg FROM spine LEFT JOIN air USING (day)", means=("wind_avg",))
def weather_daily_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.day_spine(spark, START, END).join(W.daily_air(D.readings(spark, sf_dir), START, END), "day", "left")


@query(with_sql("readings") + _AIR + "SELECT day, radiation FROM rad")
def radiation_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.daily_radiation(D.readings(spark, sf_dir), START, END)


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = D.readings(spark, sf_dir)
    return W.measured(readings, readings, START, END)


@query(_MEASURED + "SELECT * FROM measured", means=("wind_avg_ms",))
def weather_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)


@query(_MEASURED + "SELECT count(*) AS saved, count(*) FILTER (WHERE checked) AS checked FROM measured")
def refresh_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.counters(_measured(spark, sf_dir))


@query(with_sql("weather") + "SELECT weather_date, " + " AND ".join(f"{c} IS NOT NULL" for c, _ in E.COMPLETE_COLUMNS) + " AS is_complete, concat_ws(', ', " + ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for c, n in E.COMPLETE_COLUMNS) + ") AS missing FROM (SELECT CAST(d AS DATE) AS weather_date FROM (SELECT unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS d)) s LEFT JOIN weather USING (weather_date)")
def weather_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = W.day_spine(spark, datetime.date(2023, 12, 25), datetime.date(2024, 2, 5)).withColumnRenamed("day", "weather_date")
    return W.status(days, D.weather(spark, sf_dir)).select("weather_date", "is_complete", F.array_join("missing_fields", ", ").alias("missing"))


@query(with_sql("weather") + "SELECT * FROM weather WHERE weather_date BETWEEN DATE '2023-12-21' AND DATE '2024-01-28'", ("precipitation_mm",), ("temp_avg_c", "humidity_avg_pct", "wind_avg_ms"))
def weather_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last = (TODAY + datetime.timedelta(days=n) for n in (-W.SHOWN_BEFORE, W.SHOWN_AFTER))
    return W.shown(D.weather(spark, sf_dir, first, last), TODAY)


@query(with_sql("weather") + "SELECT count(*) FILTER (WHERE data_kind = 'measured') AS measured, count(*) FILTER (WHERE data_kind = 'measured' AND checked) AS measured_checked, count(*) FILTER (WHERE data_kind = 'forecast') AS forecast FROM weather")
def weather_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.counts(D.weather(spark, sf_dir))


@query(with_sql("weather") + "SELECT weather_date, temp_min_c, temp_max_c, wind_avg_ms, radiation_mj_m2, CASE WHEN checked THEN 'checked' ELSE 'check' END AS status, check_message FROM weather WHERE data_kind = 'measured' ORDER BY weather_date DESC LIMIT 14", means=("wind_avg_ms",))
def weather_last14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.latest_measured(D.weather(spark, sf_dir))


@query(with_sql("weather") + "SELECT * FROM weather WHERE weather_date = DATE '2024-01-20'", ("precipitation_mm",), ("temp_avg_c", "humidity_avg_pct", "wind_avg_ms"))
def weather_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.on_day(D.weather(spark, sf_dir, TODAY, TODAY), TODAY)


@query("SELECT l_returnflag, l_linestatus, CAST(year(m) AS INTEGER) AS year, CAST(month(m) AS INTEGER) AS month FROM (SELECT l_returnflag, l_linestatus, unnest(generate_series(date_trunc('month', min(l_shipdate)), date_trunc('month', max(l_shipdate)), INTERVAL 1 MONTH)) AS m FROM lineitem GROUP BY 1, 2)")
def month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The months from the first to the last shipment of each kind of line."""
    ends = D.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"))
    each = ends.select("l_returnflag", "l_linestatus", F.explode(W.month_starts(F.col("first"), F.col("last"))).alias("m"))
    return each.select("l_returnflag", "l_linestatus", F.year("m").alias("year"), F.month("m").alias("month"))


@query(with_sql("readings") + "SELECT station, element, count(*) AS readings FROM readings WHERE lower(station) LIKE '%station 1%' AND element IN ('TA', 'WS10M') GROUP BY station, element")
def pages_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetched pages of two elements as one bag; all stations that match are pooled."""
    found = W.of_station(D.readings(spark, sf_dir), "STATION 1")
    both = found.where("element = 'TA'").unionByName(found.where("element = 'WS10M'"))
    return both.groupBy("station", "element").agg(F.count("*").alias("readings"))


@query(with_sql("harvests") + """, delta AS (SELECT harvest_date, field_id, 7 AS interval_days, CAST(a + 1 AS DECIMAL(12,2)) AS a, b, c, xl FROM harvests WHERE field_id = 3
  UNION ALL SELECT DATE '2002-06-01', CAST(i AS INTEGER), 5, 1.5, 0, 0, 0 FROM range(1, 15) t(i))
SELECT harvest_date, field_id, CASE WHEN d.a IS NOT NULL THEN d.interval_days ELSE h.interval_days END AS interval_days, CAST(coalesce(d.a, h.a) AS DECIMAL(12,2)) AS a, CAST(coalesce(d.b, h.b) AS DECIMAL(12,2)) AS b, CAST(coalesce(d.c, h.c) AS DECIMAL(12,2)) AS c, CAST(coalesce(d.xl, h.xl) AS DECIMAL(12,2)) AS xl FROM harvests h FULL JOIN delta d USING (harvest_date, field_id)""", ("a", "b", "c", "xl"))
def upsert_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = D.harvests(spark, sf_dir)
    again = base.where("field_id = 3").withColumns({"interval_days": F.lit(7), "a": F.col("a") + 1})
    new = D.fields(spark).selectExpr("DATE '2002-06-01' AS harvest_date", "id AS field_id", "5 AS interval_days", "1.5 AS a", "0 AS b", "0 AS c", "0 AS xl")
    return U.upsert(base, again.unionByName(new), ["harvest_date", "field_id"], ["interval_days", *H.GRADES])


@query(with_sql("weather") + """, delta AS (SELECT weather_date, CAST(NULL AS DOUBLE) AS temp_min_c, 12.5::DOUBLE AS wind_avg_ms FROM weather WHERE day(weather_date) % 2 = 0 UNION ALL SELECT DATE '2024-03-01', 1.0, 2.0)
SELECT weather_date, CASE WHEN d.wind_avg_ms IS NOT NULL THEN d.temp_min_c ELSE w.temp_min_c END AS temp_min_c, w.temp_max_c, coalesce(d.wind_avg_ms, w.wind_avg_ms) AS wind_avg_ms, CASE WHEN w.data_kind IS NULL THEN 'measured' ELSE w.data_kind END AS data_kind, coalesce(w.checked, false) AS checked
FROM weather w FULL JOIN delta d USING (weather_date)""", means=("wind_avg_ms",))
def upsert_weather_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload of two columns: its nulls overwrite, other columns stay, new rows get defaults."""
    base = D.weather(spark, sf_dir).select("weather_date", "temp_min_c", "temp_max_c", "wind_avg_ms", "data_kind", "checked")
    some = base.where("day(weather_date) % 2 = 0").selectExpr("weather_date", "CAST(NULL AS DOUBLE) AS temp_min_c", "12.5D AS wind_avg_ms")
    delta = some.unionByName(spark.range(1).selectExpr("DATE '2024-03-01' AS weather_date", "1.0D AS temp_min_c", "2.0D AS wind_avg_ms"))
    return U.upsert(base, delta, ["weather_date"], ["temp_min_c", "wind_avg_ms"], {"data_kind": "measured", "checked": False})


@query("""WITH stored AS (SELECT 'user ' || user_id AS key, arg_max(event_type, event_id) AS value FROM events GROUP BY 1)
SELECT key, coalesce(value, d) AS value FROM (VALUES ('user 7', ''), ('absent', 'none')) t(key, d) LEFT JOIN stored USING (key)""")
def app_setting_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = U.upsert(spark.createDataFrame([], "key string, value string"), D.settings(spark, sf_dir), ["key"], ["value"], order="seq")
    return U.setting(stored, "user 7").unionByName(U.setting(stored, "absent", "none"))


@query("""WITH hours AS (SELECT user_id, date_trunc('hour', ts) AS h, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2),
wind AS (SELECT user_id, CAST(h AS DATE) AS d, avg(v) AS wind FROM hours GROUP BY 1, 2),
days AS (SELECT user_id, CAST(ts AS DATE) AS d, min(value) FILTER (WHERE event_type = 'click') AS low, max(value) FILTER (WHERE event_type = 'click') AS high,
  CAST(sum(CAST(value AS DECIMAL(12,2))) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS sun FROM events GROUP BY 1, 2),
j AS (SELECT *, concat_ws('; ', CASE WHEN low IS NULL OR high IS NULL THEN 'temp_forecast_missing' END, CASE WHEN wind IS NULL THEN 'wind_forecast_missing' END, CASE WHEN sun IS NULL THEN 'radiation_forecast_missing' END) AS problems
  FROM days LEFT JOIN wind USING (user_id, d))
SELECT d AS weather_date, 'forecast' AS data_kind, low AS temp_min_c, high AS temp_max_c, wind AS wind_avg_ms, sun AS radiation_mj_m2, problems = '' AS checked, CASE WHEN problems = '' THEN 'forecast available' ELSE problems END AS check_message FROM j""", means=("wind_avg_ms",))
def forecast_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.forecast(D.payloads(spark, sf_dir))


@query(with_sql("fields", "harvests", "plan", "weather") + """SELECT 'harvest_key' AS rule, count(*) AS violations FROM (SELECT 1 FROM harvests GROUP BY harvest_date, field_id HAVING count(*) > 1)
UNION ALL SELECT 'harvest_field', count(*) FROM harvests WHERE field_id NOT IN (SELECT id FROM fields WHERE id <= 10)
UNION ALL SELECT 'harvest_range', count(*) FROM harvests WHERE NOT (interval_days >= 0 AND a >= 0 AND b >= 0 AND c >= 0 AND xl >= 0)
UNION ALL SELECT 'plan_positions', count(*) FROM (SELECT plan_date FROM daily_plan WHERE position <> 1 GROUP BY plan_date HAVING max(position) <> count(*) OR count(DISTINCT position) <> count(*))
UNION ALL SELECT 'weather_range', count(*) FROM weather WHERE NOT ((humidity_avg_pct IS NULL OR humidity_avg_pct BETWEEN 0 AND 100) AND coalesce(precipitation_mm >= 0, true) AND coalesce(wind_avg_ms >= 0, true) AND coalesce(wind_gust_ms >= 0, true) AND coalesce(radiation_mj_m2 >= 0, true))""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over each table."""
    plan = D.daily_plan(spark)
    harvests = C.checked(D.harvests(spark, sf_dir), {"harvest_range": C.grades_allowed()}, ("harvest_key", ["harvest_date", "field_id"]), {"harvest_field": ("field_id", D.fields(spark, 10), "id")})
    weather = C.checked(D.weather(spark, sf_dir), {"weather_range": C.weather_allowed()})
    return C.report([harvests, C.position_gaps(plan.where("position <> 1"), "plan_positions"), weather])


@query(rf"""WITH words AS (SELECT unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents)
SELECT word, TRY_CAST(replace(word, '_', '') AS DOUBLE) AS number, count(*) AS n FROM words WHERE regexp_full_match(word, '{E.NUMBER}') GROUP BY 1, 2""")
def safe_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents that are numbers."""
    words = D.table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word"))
    # no number begins otherwise, and each different word is read once
    counted = words.where(F.substring("word", 1, 1).isin(*"+-.0123456789iI")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.select("word", E.safe_float(F.col("word")).alias("number"), "n").where("number IS NOT NULL")


@query(with_sql("order_plan", "shipments") + "SELECT p.plan_date, p.field_id, s.harvest_date AS last_harvest, CAST(p.plan_date - s.harvest_date AS INTEGER) AS interval_days FROM order_plan p ASOF LEFT JOIN (SELECT DISTINCT harvest_date, field_id FROM shipments) s ON p.field_id = s.field_id AND p.plan_date > s.harvest_date")
def order_last_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every day and supplier that orders ask for, the supplier's last shipment strictly before."""
    found = H.last_before(D.order_plan(spark, sf_dir), D.shipments(spark, sf_dir))
    return found.withColumn("interval_days", E.days_between(F.col("last_harvest"), F.col("plan_date")))


@query(with_sql("order_plan", "suppliers", "shipments") + """, e AS (SELECT CAST(DATE '2001-06-01' + CAST(user_id % 120 AS INTEGER) AS DATE) AS plan_date, event_id AS seq, event_type,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 0 END AS kind, CASE WHEN event_type = 'error' THEN -1 ELSE event_id % 29 END AS field_id FROM events),
ok AS (SELECT * FROM e WHERE kind > 0 OR field_id IN (SELECT id FROM suppliers)),
top AS (SELECT list(CAST(id AS BIGINT) ORDER BY last NULLS FIRST, id)[:3] AS ids FROM (SELECT id, max(harvest_date) AS last FROM suppliers LEFT JOIN shipments ON field_id = id GROUP BY id)),
old AS (SELECT plan_date, list(CAST(field_id AS BIGINT) ORDER BY position) AS ids FROM order_plan GROUP BY plan_date),
log AS (SELECT plan_date, list([CAST(kind AS BIGINT), CAST(field_id AS BIGINT)] ORDER BY seq) AS edits FROM ok GROUP BY plan_date),
whole AS (SELECT plan_date, coalesce(old.ids, CASE WHEN edits[1][1] = 2 THEN top.ids ELSE [] END) AS ids, coalesce(edits, []) AS edits FROM old FULL JOIN log USING (plan_date), top),
folded AS (SELECT plan_date, list_reduce(list_prepend(ids, edits), lambda a, x: CASE WHEN x[1] = 0 AND NOT list_contains(a, x[2]) THEN list_append(a, x[2]) WHEN x[1] = 1 THEN list_filter(a, lambda y: y <> x[2]) ELSE a END) AS ids FROM whole)
SELECT 'plan' AS what, plan_date, ids[i] AS field_id, CAST(i AS INTEGER) AS position, CAST(NULL AS BIGINT) AS seq, NULL AS reason FROM (SELECT plan_date, ids, unnest(range(1, len(ids) + 1)) AS i FROM folded)
UNION ALL SELECT 'mark', plan_date, NULL, NULL, NULL, NULL FROM whole
UNION ALL SELECT 'refused', plan_date, field_id, NULL, seq, 'unknown field' FROM e WHERE kind = 0 AND field_id NOT IN (SELECT id FROM suppliers)""")
def plan_edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events replayed as edits of the plan that orders make."""
    plan = D.order_plan(spark, sf_dir)
    days = plan.select("plan_date").distinct().withColumn("initialized", F.lit(True))
    return edits.as_one(edits.replayed(plan, days, D.suppliers(spark, sf_dir), D.shipments(spark, sf_dir), D.plan_edits(spark, sf_dir)))


@query(with_sql("readings") + """SELECT coalesce(a.day, r.day) AS day, t_min, t_max, wind_avg, radiation FROM
(SELECT local_day AS day, min(number) FILTER (WHERE element = 'TA') AS t_min, max(number) FILTER (WHERE element = 'TA') AS t_max, avg(number) FILTER (WHERE element = 'WS10M') AS wind_avg FROM readings WHERE element IN ('TA', 'WS10M') GROUP BY 1) a
FULL JOIN (SELECT utc_day AS day, arg_max(number, seq) AS radiation FROM readings WHERE element = 'DRQS' GROUP BY 1) r ON a.day = r.day""", means=("wind_avg",))
def weather_from_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days from the states of three parts of the readings, which arrive apart."""
    readings = D.readings(spark, sf_dir)
    parts = [readings.where(F.col("hour").between(8 * i, 8 * i + 7)) for i in (2, 0, 1)]
    return daily_state.measures(daily_state.merged(*map(daily_state.state, parts)))


@query(with_sql("harvests") + """, delta AS (SELECT DATE '1998-07-01' AS harvest_date, CAST(i AS INTEGER) AS field_id, CAST(9.5 AS DECIMAL(12,2)) AS a FROM range(1, 15) t(i) UNION ALL SELECT DATE '1999-02-28', 3, 1.25)
SELECT strftime(harvest_date, '%Y-%m') AS month, harvest_date, field_id, coalesce(h.interval_days, 5) AS interval_days, coalesce(d.a, h.a) AS a, coalesce(h.b, 0) AS b, coalesce(h.c, 0) AS c, coalesce(h.xl, 0) AS xl
FROM harvests h FULL JOIN delta d USING (harvest_date, field_id) WHERE strftime(harvest_date, '%Y-%m') IN ('1998-07', '1999-02')""", ("a", "b", "c", "xl"))
def upsert_harvest_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a write rewrites: the months that it touches, and no others."""
    first = D.fields(spark).selectExpr("DATE '1998-07-01' AS harvest_date", "id AS field_id", "CAST(9.5 AS DECIMAL(12,2)) AS a")
    delta = first.unionByName(spark.range(1).selectExpr("DATE '1999-02-28' AS harvest_date", "3 AS field_id", "CAST(1.25 AS DECIMAL(12,2)) AS a"))
    return U.touched_months(D.harvests(spark, sf_dir), delta, ["harvest_date", "field_id"], ["a"], "harvest_date", {"interval_days": 5, "b": 0, "c": 0, "xl": 0})


def _with_functions(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql_functions.register(spark, D.fields(spark), D.daily_plan(spark), D.harvests(spark, sf_dir), D.weather(spark, sf_dir))
    return spark.sql(sql)


@query(_history_sql(300), ("a", "b", "c", "xl", "total"))
def sql_harvest_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_functions(spark, sf_dir, "SELECT * FROM harvest_history(300)")


@query(_PLAN_SQL + " WHERE year(plan_date) = 1998")
def sql_daily_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_functions(spark, sf_dir, "SELECT d.plan_date, p.* FROM (SELECT DISTINCT plan_date FROM furrow_plan WHERE year(plan_date) = 1998) d, LATERAL daily_plan_of(d.plan_date) p")


@query(with_sql("fields", "harvests", "plan") + _INTERVALS.format(probes="(SELECT DATE '1998-07-01' AS plan_date, id AS field_id, p.position FROM fields LEFT JOIN daily_plan p ON p.plan_date = DATE '1998-07-01' AND p.field_id = id)") + "SELECT field_id, interval_days FROM intervals")
def sql_field_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_functions(spark, sf_dir, "SELECT id AS field_id, field_interval(DATE'1998-07-01', id) AS interval_days FROM furrow_fields")


@query(ORACLE_SQL["weather_status"])
def sql_weather_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_functions(spark, sf_dir, "SELECT * FROM weather_status(DATE'2023-12-25', DATE'2024-02-05')")


@query(ORACLE_SQL["default_plan"])
def sql_default_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_functions(spark, sf_dir, "SELECT * FROM default_plan_of(DATE'2002-01-01')")


@query(with_sql("harvests") + "SELECT field_id, interval_days, a, b, c, xl FROM harvests WHERE harvest_date = DATE '1998-07-01'", ("a", "b", "c", "xl"))
def sql_harvests_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_functions(spark, sf_dir, "SELECT * FROM harvests_on(DATE'1998-07-01')")
