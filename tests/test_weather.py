"""Edge cases of local days, checks, forecasts, status and the refresh."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from furrow.functions import expressions as E
from furrow.operators import constraints as C
from furrow.operators import refresh as R
from furrow.operators import upsert as U
from furrow.operators import weather as W

D = datetime.date
READINGS = "station string, year int, month int, day int, hour int, value string, element string, seq long"


@pytest.mark.parametrize(
    ("when", "day"),
    [("2024-07-01 20:59:00", D(2024, 7, 1)), ("2024-07-01 21:00:00", D(2024, 7, 2)), ("2024-01-01 21:30:00", D(2024, 1, 1)), ("2024-01-01 22:00:00", D(2024, 1, 2)), ("2024-03-31 20:59:00", D(2024, 3, 31)), ("2024-03-31 21:00:00", D(2024, 4, 1)), ("2024-10-26 21:00:00", D(2024, 10, 27)), ("2024-10-27 21:59:00", D(2024, 10, 27)), ("2024-10-27 22:00:00", D(2024, 10, 28))],
)
def test_local_day_follows_daylight_saving(spark, when, day):
    df = spark.range(1).select(E.local_day(F.to_timestamp_ntz(F.lit(when))).alias("d"))
    assert df.first()["d"] == day


def test_impossible_times_and_values_are_dropped(spark):
    rows = [("s", 2024, 2, 30, 1, "1", "TA", 1), ("s", 2024, 2, 1, 24, "1", "TA", 2), ("s", 2024, 2, 1, None, "3", "TA", 3), ("s", 2024, 2, 1, 5, "x", "TA", 4), ("s", 2024, 2, 1, 6, None, "TA", 5), ("s", 2024, 2, 1, 5, "7", "TA", 6), ("s", 2024, 2, 1, 5, "NaN", "TA", 7)]
    got = W.daily_air(spark.createDataFrame(rows, READINGS), D(2024, 1, 31), D(2024, 2, 3)).collect()
    assert [(r["day"], r["t_min"], r["t_max"], r["wind_avg"]) for r in got] == [(D(2024, 2, 1), 3.0, 7.0, None)]


def test_last_number_of_the_day_wins(spark):
    rows = [("s", 2024, 2, 1, 0, "1", "DRQS", 1), ("s", 2024, 2, 1, 0, "2", "DRQS", 2), ("s", 2024, 2, 1, 0, None, "DRQS", 3), ("s", 2024, 2, 1, 0, "9", "TA", 4)]
    assert [tuple(r) for r in W.daily_radiation(spark.createDataFrame(rows, READINGS), D(2024, 2, 1), D(2024, 2, 1)).collect()] == [(D(2024, 2, 1), 2.0)]


@pytest.mark.parametrize(
    ("values", "found"),
    [((-50.0, 50.0, 0.0, 45.0), []), ((-50.1, 50.1, 50.1, 45.1), ["temp_min_implausible", "temp_max_implausible", "wind_implausible", "radiation_implausible"]), ((10.0, 5.0, None, None), ["temp_swapped", "wind_missing", "radiation_missing"]), ((None, None, -1.0, -1.0), ["temp_min_missing", "temp_max_missing", "wind_implausible", "radiation_implausible"])],
)
def test_problems_of_a_measured_day(spark, values, found):
    df = spark.createDataFrame([values], "a double, b double, c double, d double")
    assert df.select(E.measured_problems(*[F.col(c) for c in "abcd"]).alias("p")).first()["p"] == found


def test_spine_is_empty_when_start_is_after_end(spark):
    assert W.day_spine(spark, D(2024, 1, 2), D(2024, 1, 1)).count() == 0
    assert W.day_spine(spark, D(2024, 1, 1), D(2024, 1, 3)).count() == 3


def test_status_of_missing_and_complete_days(spark):
    names = [c for c, _ in E.COMPLETE_COLUMNS]
    schema = "weather_date date, " + ", ".join(f"{c} double" for c in names)
    weather = spark.createDataFrame([(D(2024, 1, 1), *[0.0] * 8), (D(2024, 1, 2), *[None] * 8)], schema)
    days = spark.createDataFrame([(D(2024, 1, i),) for i in (1, 2, 3)], "weather_date date")
    got = {r["weather_date"].day: (r["is_complete"], r["missing_fields"]) for r in W.status(days, weather).collect()}
    labels = [n for _, n in E.COMPLETE_COLUMNS]
    assert got == {1: (True, []), 2: (False, labels), 3: (False, labels)}


def test_forecast_with_uneven_arrays(spark):
    json = '{"daily":{"time":["2024-07-01","2024-07-02"],"temperature_2m_min":[1],"temperature_2m_max":[2,3],"shortwave_radiation_sum":[4,5]},"hourly":{"time":["2024-07-01T00:00","2024-07-01T01:00","2024-07-02T00:00"],"wind_speed_10m":[2,4]}}'
    got = {r["weather_date"].day: (r["temp_min_c"], r["wind_avg_ms"], r["check_message"]) for r in W.forecast(spark.createDataFrame([(json,), ("{}",), (None,)], "json string")).collect()}
    assert got == {1: (1.0, 3.0, "forecast available"), 2: (None, None, "temp_forecast_missing; wind_forecast_missing")}


def test_refresh_measures_the_season_and_overwrites(spark):
    readings = spark.createDataFrame([("s", 2024, 7, 1, 10, "12", "TA", 1), ("s", 2024, 7, 1, 11, "3", "WS10M", 2), ("c", 2024, 7, 1, 0, "20", "DRQS", 3)], READINGS)
    schema = "weather_date date, source_station string, radiation_station string, temp_min_c double, temp_max_c double, wind_avg_ms double, radiation_mj_m2 double, data_kind string, checked boolean, check_message string, notes string"
    old = spark.createDataFrame([(D(2024, 7, 2), "x", "y", 1.0, 2.0, 3.0, 4.0, "forecast", True, "m", "kept")], schema)
    empty = spark.createDataFrame([("{}",)], "json string")
    got = {r["weather_date"].day: r for r in R.refreshed(old, readings, readings, empty, D(2024, 7, 3)).collect()}
    assert got[1]["checked"] and got[1]["data_kind"] == "measured" and got[1]["notes"] is None
    assert got[2]["temp_min_c"] is None and got[2]["notes"] == "kept" and not got[2]["checked"]
    kept = {r["weather_date"].day: r for r in R.refreshed(old, readings, readings, empty, D(2024, 7, 3), keep_existing_on_null=True).collect()}
    assert kept[2]["temp_min_c"] == 1.0
    assert R.refreshed(old, readings, readings, empty, D(2024, 7, 1)).count() == 1  # before the season has a day


def test_settings_keep_the_error_of_a_failed_refresh(spark):
    none = spark.createDataFrame([], "key string, value string")
    done = R.with_outcome(none, "2024-07-03T10:00:00")
    failed = R.with_outcome(done, "2024-07-04T10:00:00", "no network")
    assert {r["key"]: r["value"] for r in failed.collect()} == {"weather_last_error": "no network", "weather_last_refresh_at": "2024-07-03T10:00:00"}


def test_upsert_writes_only_its_payload(spark):
    base = spark.createDataFrame([(1, 10, 100), (2, 20, 200)], "k int, a int, b int")
    delta = spark.createDataFrame([(1, None), (3, 30)], "k int, a int")
    got = sorted(tuple(r) for r in U.upsert(base, delta, ["k"], ["a"], {"b": 7}).collect())
    assert got == [(1, None, 100), (2, 20, 200), (3, 30, 7)]
    kept = sorted(tuple(r) for r in U.upsert(base, delta, ["k"], ["a"], keep_existing_on_null=True).collect())
    assert kept == [(1, 10, 100), (2, 20, 200), (3, 30, None)]


def test_constraints_count_what_breaks_them(spark):
    table = spark.createDataFrame([(1, 5), (1, 6), (2, -1), (3, None)], "k int, v int")
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    got = C.report([C.duplicate_keys(table, ["k"], "keys"), C.orphans(table, "k", parents, "id", "parents"), C.out_of_range(table, F.col("v") >= 0, "range")])
    assert {r["rule"]: r["violations"] for r in got.collect()} == {"keys": 1, "parents": 1, "range": 1}


def test_columns_are_added_with_their_value(spark):
    got = U.with_columns_added(spark.createDataFrame([(1,)], "k int"), {"k": ("int", 9), "checked": ("boolean", False)})
    assert [tuple(r) for r in got.collect()] == [(1, False)]


def test_means_are_plain_and_judged_afterwards(spark):
    row = lambda day, hour, value: ("s", 2024, 2, day, hour, value, "WS10M", hour)
    rows = [row(1, 1, "1.23456"), row(1, 2, "1.23457"), row(2, 1, "1e300"), row(2, 2, "1e300"), row(3, 1, "Infinity"), row(3, 2, "1")]
    readings = spark.createDataFrame(rows, READINGS)
    got = {r["weather_date"].day: r for r in W.measured(readings, readings, D(2024, 2, 1), D(2024, 2, 3)).collect()}
    assert got[1]["wind_avg_ms"] == pytest.approx(1.234565, abs=1e-12)
    assert got[2]["wind_avg_ms"] == 1e300 and "wind_implausible" in got[2]["check_message"]
    assert got[3]["wind_avg_ms"] == float("inf") and "wind_implausible" in got[3]["check_message"]


def test_repeated_and_null_keys_of_a_write(spark):
    base = spark.createDataFrame([(1, 10)], "k int, a int")
    twice = spark.createDataFrame([(1, 20, 1), (1, 30, 2), (2, 5, 1)], "k int, a int, at int")
    with pytest.raises(Exception, match="written twice"):
        U.upsert(base, twice, ["k"], ["a"]).collect()
    assert sorted(tuple(r) for r in U.upsert(base, twice, ["k"], ["a"], order="at").collect()) == [(1, 30), (2, 5)]
    with pytest.raises(Exception, match="a null in a key"):
        U.upsert(base, spark.createDataFrame([(None, 1)], "k int, a int"), ["k"], ["a"]).collect()


def test_a_write_stamps_its_rows(spark):
    base = spark.createDataFrame([(1, 10, "old", "old"), (2, 20, "old", "old")], "k int, a int, created_at string, updated_at string")
    got = U.upsert(base, spark.createDataFrame([(2, 21), (3, 30)], "k int, a int"), ["k"], ["a"], now=F.lit("now"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 10, "old", "old"), (2, 21, "old", "now"), (3, 30, "now", "now")]


def test_a_station_is_found_by_its_text_alone(spark):
    rows = spark.createDataFrame([("100% Hill",), ("100 Hill",), ("a_b",), ("axb",)], "station string")
    assert [r[0] for r in W.of_station(rows, "100% h").collect()] == ["100% Hill"]
    assert [r[0] for r in W.of_station(rows, "A_B").collect()] == ["a_b"]


def test_months_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("s", 2024, m, 1, 1, "1", "TA", m) for m in range(1, 13)], READINGS).write.parquet(f"{tmp_path}/r")
    stored = spark.read.parquet(f"{tmp_path}/r")
    air = W.daily_air(stored, D(2024, 7, 1), D(2024, 8, 1))
    plan = air._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(month," in plan.split("PushedFilters")[1]
    assert {r["day"] for r in air.collect()} == {D(2024, 7, 1), D(2024, 8, 1)}
    assert stored.where(W.near_months(D(2023, 11, 5), D(2024, 2, 1))).count() == 2


def test_small_conversions(spark):
    row = spark.range(1).select(E.season_start(F.lit(D(2024, 3, 5))).alias("s"), E.blank_to_null(F.lit("  ")).alias("b"), E.blank_to_null(F.lit(" x ")).alias("x"), *[E.local_second(F.to_timestamp_ntz(F.lit(t))).alias(n) for n, t in (("summer", "2024-07-03 07:00:05"), ("winter", "2024-01-03 22:30:00"))]).first()
    assert tuple(row) == (D(2024, 7, 1), None, "x", "2024-07-03T10:00:05+03:00", "2024-01-04T00:30:00+02:00")


class Tables:
    """A store whose tables are rows in the driver."""

    def __init__(self, spark):
        schema = "weather_date date, source_station string, radiation_station string, temp_min_c double, temp_max_c double, wind_avg_ms double, radiation_mj_m2 double, data_kind string, checked boolean, check_message string, created_at timestamp, updated_at timestamp"
        self.held = {"weather": spark.createDataFrame([], schema), "settings": spark.createDataFrame([], "key string, value string")}
        save = lambda name: lambda df: self.held.__setitem__(name, spark.createDataFrame(df.collect(), df.schema))
        self.store = R.Store(lambda: self.held["weather"], save("weather"), lambda: self.held["settings"], save("settings"))

    def setting(self):
        return {r["key"]: r["value"] for r in self.held["settings"].collect()}


def test_a_guarded_refresh_keeps_what_was_written_before_an_error(spark):
    now = datetime.datetime(2024, 7, 3, 10, 0, 5, 999, tzinfo=datetime.timezone(datetime.timedelta(hours=3)))
    readings = spark.createDataFrame([("s", 2024, 7, 1, 10, "12", "TA", 1), ("s", 2024, 7, 1, 11, "3", "WS10M", 2), ("c", 2024, 7, 1, 0, "20", "DRQS", 3)], READINGS)
    payload = '{"daily":{"time":["2024-07-03"],"temperature_2m_min":[1],"temperature_2m_max":[2],"shortwave_radiation_sum":[4]}}'
    tables = Tables(spark)
    broken = spark.range(1).select(F.raise_error(F.lit("no network")).cast("string").alias("json"))
    got = R.safe_refresh_all(tables.store, readings, readings, broken, now)
    assert "no network" in got["error"] and "no network" in tables.setting()["weather_last_error"]
    assert {r["weather_date"].day for r in tables.held["weather"].collect()} == {1, 2}
    good = spark.createDataFrame([(payload,)], "json string")
    assert R.safe_refresh_all(tables.store, readings, readings, good, now) == {"measured": {"saved": 2, "checked": 1}, "forecast": {"saved": 1}}
    assert tables.setting() == {"weather_last_error": "", "weather_last_refresh_at": "2024-07-03T10:00:05+03:00"}
    rows = {r["weather_date"].day: r for r in tables.held["weather"].collect()}
    assert rows[3]["data_kind"] == "forecast" and all(r["created_at"] is not None and r["updated_at"] is not None for r in rows.values())
    spring = R.refresh_all(Tables(spark).store, readings, readings, good, now.replace(month=5))
    assert spring["measured"] == {"saved": 0, "checked": 0}
