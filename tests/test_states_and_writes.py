"""As-of joins, edit logs, exact means, mergeable days, writes by month, pushed filters, one-pass checks, SQL functions."""

from __future__ import annotations

import datetime
import json
import random
import re
import statistics
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from furrow import schemas
from furrow.functions import exact
from furrow.functions import expressions as E
from furrow.operators import asof, constraints, daily_state
from furrow.operators import harvests as H
from furrow.operators import refresh
from furrow.operators import upsert as U
from furrow.plans import daily as P
from furrow.plans import edits, sql_functions
from furrow.sources import http_readings, tables
from furrow.streaming import ingest

D = datetime.date
SF_DIR = "/root/testdata/sf0.001"
PLAN = "plan_date date, field_id int, position int"
READINGS = "station string, year int, month int, day int, hour int, value string, element string, seq long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# as-of joins


def test_last_before_equals_a_plain_search(spark):
    rng = random.Random(2)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    time = lambda: rng.choice([rng.randrange(-700, 700), rng.randrange(-(1 << 23), 1 << 23), 255, 256, 4095, 4096, 65536])
    known = [(key(), time()) for _ in range(500)] + [(1, None)]
    probes = [(key(), time()) for _ in range(300)]
    asked, have = (spark.createDataFrame(rows, "k int, t long") for rows in (probes, known))
    got = {(r["k"], r["t"]): r["last"] for r in asof.last_before(asked, have, ["k"], "t").collect()}
    wanted = {(k, t): max((x for j, x in known if k is not None and j == k and x is not None and x < t), default=None) for k, t in probes}
    assert got == wanted
    again = {(r["k"], r["t"]): r["last"] for r in asof.last_before(asked, have, ["k"], "t", bits=5, levels=5).collect()}
    assert again == wanted
    assert asof.last_before(asked, have.where("false"), ["k"], "t").where("last IS NOT NULL").count() == 0
    assert asof.last_before(asked.where("false"), have, ["k"], "t").count() == 0


def test_no_window_holds_a_whole_field(spark):
    rows = spark.createDataFrame([(D(1990, 1, 1) + datetime.timedelta(days=i), 1) for i in range(400)], "harvest_date date, field_id int")
    found = H.last_before(rows.withColumnRenamed("harvest_date", "plan_date"), rows)
    assert found.where("last_harvest = date_sub(plan_date, 1)").count() == 399
    assert not re.search(r"hashpartitioning\(field_id#\d+, \d+\)", plan_of(found)) and not re.search(r"Window \[[^\]]*\], \[field_id#\d+\]", plan_of(found))


# edit logs


def replay(plan, marked, fields, top, log):
    """The calls one after another."""
    days = {d: [] for d, *_ in plan}
    for d, f, p in plan:
        days[d].append([p, f])
    days, marks, refused = {d: sorted(rows) for d, rows in days.items()}, set(marked), []
    for d, seq, kind, f in sorted(log, key=lambda e: (e[1] is None, e[1], e[2] != "add", e[3] or 0)):
        if d is None or seq is None or kind not in ("add", "remove", "default") or kind == "add" and f not in fields:
            refused.append((d, seq, kind, f))
            continue
        rows = days.setdefault(d, [])
        if kind == "default" and d not in marks:
            rows += [[i, x] for i, x in enumerate(top, 1) if x not in [y for _, y in rows]]
        elif kind == "add" and f not in [x for _, x in rows]:
            rows.append([max([p for p, _ in rows], default=0) + 1, f])
        elif kind == "remove":
            days[d] = [[i, x] for i, (_, x) in enumerate(sorted(r for r in rows if r[1] != f), 1)]
        marks.add(d)
    return sorted((d, f, p) for d, rows in days.items() for p, f in rows), marks, refused


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    day = lambda i: D(2024, 5, 1) + datetime.timedelta(days=i)
    plan = [(day(i), f, p) for i in range(3) for p, f in zip(sorted(rng.sample(range(1, 9), 3)), rng.sample(range(1, 8), 3), strict=True)]
    marked = [day(i) for i in range(3)] + [day(4)]
    log = [(day(rng.randrange(7)), seq, rng.choice(["add", "add", "remove", "default"]), rng.randrange(1, 9)) for seq in range(rng.choice([6, 120]))]
    log += [(None, 500, "add", 1), (day(6), None, "add", 1), (day(6), 501, "drop", 1), (day(6), 502, None, 1), (day(6), 503, "add", None)]
    rng.shuffle(log)
    fields = spark.createDataFrame([(i, f"F{i}") for i in range(1, 8)], "id int, name string")
    harvests = spark.createDataFrame([(D(2024, 4, i), i) for i in (1, 2, 4, 5, 6, 7)], "harvest_date date, field_id int")
    got = edits.replayed(spark.createDataFrame(plan, PLAN), spark.createDataFrame([(d, True) for d in marked], "plan_date date, initialized boolean"), fields, harvests, spark.createDataFrame(log, "plan_date date, seq long, kind string, field_id int"))
    rows, marks, refused = replay(plan, marked, set(range(1, 8)), [3, 1, 2], log)
    assert sorted(tuple(r) for r in got.plan.collect()) == rows
    assert {r["plan_date"] for r in got.plan_days.collect()} == marks and got.plan_days.count() == len(marks)
    assert Counter(tuple(r)[:4] for r in got.refused.collect()) == Counter(refused)


def test_defaults_and_removals_mark_their_days(spark):
    day, other = D(2024, 5, 1), D(2024, 5, 2)
    plan, days = spark.createDataFrame([(day, 4, 1), (day, 5, 2)], PLAN), spark.createDataFrame([(day, True)], "plan_date date, initialized boolean")
    fields = spark.createDataFrame([(i, f"F{i}") for i in range(1, 6)], "id int, name string")
    none = spark.createDataFrame([], "harvest_date date, field_id int")
    new, marked = P.ensure_default(plan, days, spark.createDataFrame([(day,), (other,)], "plan_date date"), fields, none)
    assert sorted(tuple(r) for r in new.collect()) == [(day, 4, 1), (day, 5, 2), (other, 1, 1), (other, 2, 2), (other, 3, 3)]
    assert {r["plan_date"] for r in marked.collect()} == {day, other}
    new, marked = P.remove_and_mark(plan, days, spark.createDataFrame([(day, 4), (other, 9)], "plan_date date, field_id int"))
    assert [tuple(r) for r in new.collect()] == [(day, 5, 1)] and {r["plan_date"] for r in marked.collect()} == {day, other}


# exact means and mergeable days


def mean_of(spark, values, parts):
    rows = spark.createDataFrame([(1, v) for v in values], "k int, v double").repartition(parts)
    return exact.means(rows, ["k"], F.col("v"), "m").first()["m"]


@pytest.mark.parametrize("seed", range(3))
def test_means_are_exactly_rounded_in_any_order(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([1, -1]) * rng.random() * 10.0 ** rng.choice([0, 3, -3, 300, -300, 17]) for _ in range(200)] + [1e300, -1e300, 5e-324, 0.0, -0.0, 1e16, 1.0, 1.7976931348623157e308]
    wanted = statistics.mean(values)
    for parts in (1, 3, 7):
        rng.shuffle(values)
        assert mean_of(spark, values, parts) == wanted
    few = [0.1] * 10 + [rng.random() for _ in range(7)]
    assert mean_of(spark, few, 4) == statistics.mean(few)


def test_means_of_what_is_not_finite(spark):
    inf = float("inf")
    assert mean_of(spark, [inf, 1.0], 1) == inf and mean_of(spark, [-inf, 1.0], 1) == -inf
    assert mean_of(spark, [inf, -inf], 2) != mean_of(spark, [inf, -inf], 2)  # not a number
    assert mean_of(spark, [None, None], 1) is None and mean_of(spark, [float("nan"), 2.0, None], 1) == 2.0
    assert mean_of(spark, [5e-324, 0.0, 5e-324], 1) == statistics.mean([5e-324, 0.0, 5e-324])


def test_states_of_parts_in_any_order_equal_the_whole(spark):
    rng = random.Random(9)
    number = lambda: rng.choice(["", "x", None, "1e300", str(rng.random() * 50), str(rng.random()), "7"])
    rows = [("s", 2024, 7, rng.randrange(1, 5), rng.randrange(24), number(), rng.choice(["TA", "WS10M", "DRQS", "RH"]), i) for i in range(400)]
    whole = daily_state.measures(daily_state.state(spark.createDataFrame(rows, READINGS)))
    wanted = sorted(map(tuple, whole.collect()))
    for cuts in ((100, 250), (399, 399), (3, 300)):
        parts = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :]]
        rng.shuffle(parts)
        states = [daily_state.state(spark.createDataFrame(p, READINGS)) for p in parts]
        pair = daily_state.merged(states[0], states[1])
        assert sorted(map(tuple, daily_state.measures(daily_state.merged(pair, states[2])).collect())) == wanted
    winds = {}
    for r in rows:
        if r[6] == "WS10M" and r[5] not in (None, "", "x"):
            local = (datetime.datetime(2024, 7, r[3], r[4]) + datetime.timedelta(hours=3)).date()
            winds.setdefault(local, []).append(float(r[5]))
    assert {r["day"]: r["wind_avg"] for r in whole.collect() if r["wind_avg"] is not None} == {d: statistics.mean(v) for d, v in winds.items()}


def test_a_late_reading_costs_its_month_alone(spark, tmp_path):
    held = {"weather": spark.createDataFrame([], schemas.WEATHER_DAILY)}
    saved = []

    def save(df):
        held["weather"] = spark.createDataFrame(df.collect(), schemas.WEATHER_DAILY)
        saved.append(held["weather"].count())

    store = f"{tmp_path}/store"
    write = ingest.day_writer(store, lambda: held["weather"], save)
    batch = lambda *rows: spark.createDataFrame([("s", *r) for r in rows], schemas.READINGS)
    write(batch((2024, 7, 1, 5, "3", "WS10M"), (2024, 8, 1, 5, "4", "WS10M")), 0)
    before = {p: p.stat().st_mtime_ns for p in Path(store).rglob("*.parquet")}
    late = batch((2023, 7, 1, 5, "5", "WS10M"), (2024, 8, 1, 6, "6", "WS10M"))
    write(late, 1)
    write(late, 1)  # a repeated batch counts once
    write(batch(), 2)
    got = {r["weather_date"]: float(r["wind_avg_ms"]) for r in held["weather"].collect()}
    assert got == {D(2023, 7, 1): 5, D(2024, 7, 1): 3, D(2024, 8, 1): 5} and len(saved) == 3
    assert {p: p.stat().st_mtime_ns for p in before} == before
    ingest.compact(spark, store, f"{tmp_path}/compact")
    small = spark.read.schema(ingest.STORED).parquet(f"{tmp_path}/compact")
    assert {r["month"] for r in small.collect()} == {"2023-07", "2024-07", "2024-08"} and small.count() == small.select("day", "bin").distinct().count()
    again = ingest.day_writer(f"{tmp_path}/compact", lambda: held["weather"], save)
    again(batch((2024, 8, 1, 7, "8", "WS10M")), 3)
    assert {r["weather_date"]: float(r["wind_avg_ms"]) for r in held["weather"].collect()}[D(2024, 8, 1)] == 6
    stored = spark.read.schema(ingest.STORED).parquet(store).where(F.col("month").isin(["2023-07"]))
    assert "month" in re.search(r"PartitionFilters: \[([^\]]*)\]", plan_of(stored))[1]


# writes


def test_untouched_months_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/t"
    base = spark.createDataFrame([(D(2024, m, d), m * d, "kept") for m in (1, 2, 3) for d in (1, 2)], "day date, v int, note string")
    tables.overwrite(base, path, by_month="day")
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    delta = spark.createDataFrame([(D(2024, 2, 2), 40), (D(2024, 4, 1), 50)], "day date, v int")
    tables.upsert_by_month(path, delta, ["day"], ["v"], "day", defaults={"note": "new"})
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    same = {p for p in before if after.get(p) == before[p]}
    assert {p.parent.name for p in same} == {"month=2024-01", "month=2024-03"} and len(same) == len([p for p in before if "2024-02" not in str(p)])
    rows = sorted(tuple(r) for r in spark.read.parquet(path).select("day", "v", "note").collect())
    assert rows == [(D(2024, 1, 1), 1, "kept"), (D(2024, 1, 2), 2, "kept"), (D(2024, 2, 1), 2, "kept"), (D(2024, 2, 2), 40, "kept"), (D(2024, 3, 1), 3, "kept"), (D(2024, 3, 2), 6, "kept"), (D(2024, 4, 1), 50, "new")]
    tables.upsert_by_month(path, delta.where("false"), ["day"], ["v"], "day")
    with pytest.raises(ValueError, match="a null in a key"):
        tables.upsert_by_month(path, spark.createDataFrame([(None, 1)], "day date, v int"), ["day"], ["v"], "day")
    touched = U.touched_months(base, delta, ["day"], ["v"], "day", {"note": "new"})
    assert sorted(tuple(r) for r in touched.collect()) == [(D(2024, 2, 1), 2, "kept", "2024-02"), (D(2024, 2, 2), 40, "kept", "2024-02"), (D(2024, 4, 1), 50, "new", "2024-04")]


def test_a_row_that_breaks_a_rule_ends_a_write_by_month(spark, tmp_path):
    path = f"{tmp_path}/t"
    tables.overwrite(spark.createDataFrame([(D(2024, m, 1), m) for m in (1, 2)], "day date, v int"), path, by_month="day")
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    delta = spark.createDataFrame([(D(2024, 1, 1), 5), (D(2024, 2, 1), -5)], "day date, v int")
    with pytest.raises(Exception, match="breaks the rule positive"):
        tables.upsert_by_month(path, delta, ["day"], ["v"], "day", rules={"positive": F.col("v") > 0})
    assert {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")} == before
    tables.upsert_by_month(path, delta.withColumn("v", F.lit(None).cast("int")), ["day"], ["v"], "day", rules={"positive": F.col("v") > 0})
    assert {r["v"] for r in spark.read.parquet(path).collect()} == {None}


def test_a_refresh_rewrites_the_months_it_touches(spark, tmp_path):
    path = f"{tmp_path}/weather"
    old = spark.createDataFrame([(D(2024, 5, 1),), (D(2024, 7, 1),)], "weather_date date").withColumn("notes", F.lit("kept"))
    kinds = {c.split()[0]: c.split()[1] for c in re.split(r", (?![0-9])", schemas.WEATHER_DAILY)}
    table = old.select(*[F.col(c) if c in old.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
    tables.overwrite(table, path, by_month="weather_date")
    before = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    held = {"settings": spark.createDataFrame([], "key string, value string")}
    store = refresh.stored_by_month(spark, path, lambda: held["settings"], lambda df: held.__setitem__("settings", spark.createDataFrame(df.collect(), df.schema)))
    readings = spark.createDataFrame([("s", 2024, 7, 1, 10, "12", "TA", 1), ("s", 2024, 7, 1, 11, "3", "WS10M", 2), ("c", 2024, 7, 1, 0, "20", "DRQS", 3)], READINGS)
    payload = spark.createDataFrame([('{"daily":{"time":["2024-07-03","2024-08-01"],"temperature_2m_min":[1,2],"temperature_2m_max":[2,3],"shortwave_radiation_sum":[4,5]}}',)], "json string")
    got = refresh.refresh_all(store, readings, readings, payload, datetime.datetime(2024, 7, 3, 10, tzinfo=datetime.timezone.utc))
    assert got == {"measured": {"saved": 2, "checked": 1}, "forecast": {"saved": 2}}
    rows = {r["weather_date"]: r for r in store.weather().collect()}
    assert set(rows) == {D(2024, 5, 1), D(2024, 7, 1), D(2024, 7, 2), D(2024, 7, 3), D(2024, 8, 1)}
    assert rows[D(2024, 7, 1)]["notes"] == "kept" and float(rows[D(2024, 7, 1)]["temp_min_c"]) == 12 and rows[D(2024, 8, 1)]["data_kind"] == "forecast"
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert {p.parent.name for p in before if after.get(p) == before[p]} == {"month=2024-05"}


def test_a_stream_rewrites_the_months_it_touches(spark, tmp_path):
    table = f"{tmp_path}/weather"
    tables.overwrite(spark.createDataFrame([], schemas.WEATHER_DAILY), table, by_month="weather_date")
    none = spark.createDataFrame([(D(2024, 5, 1),)], "weather_date date")
    kinds = {c.split()[0]: c.split()[1] for c in re.split(r", (?![0-9])", schemas.WEATHER_DAILY)}
    tables.overwrite(none.select(*[F.col(c) if c == "weather_date" else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()]), table, by_month="weather_date")
    write = ingest.month_writer(f"{tmp_path}/store", table)
    for batch, (month, value) in enumerate([(7, "3"), (8, "4"), (7, "5")]):
        write(spark.createDataFrame([("s", 2024, month, 1, 5, value, "WS10M")], schemas.READINGS), batch)
    assert {r["weather_date"]: r["wind_avg_ms"] and float(r["wind_avg_ms"]) for r in spark.read.parquet(table).collect()} == {D(2024, 5, 1): None, D(2024, 7, 1): 4.0, D(2024, 8, 1): 4.0}


def test_a_write_refuses_rows_that_break_its_rules(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "k int, v int")
    rules = {"v_positive": F.col("v") >= 0, "k_small": F.col("k") < 9}
    with pytest.raises(ValueError, match="'v_positive': 1"):
        tables.write_checked(rows, f"{tmp_path}/bad", rules)
    assert spark.read.parquet(f"{tmp_path}/bad").count() == 0
    assert tables.write_checked(rows.where("k <> 2"), f"{tmp_path}/good", rules) == {"v_positive": 0, "k_small": 0}
    assert spark.read.parquet(f"{tmp_path}/good").count() == 2


def test_all_rules_of_a_table_in_one_pass(spark):
    table = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, -1, 9), (3, None, None)], "k int, v int, parent int")
    parents = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    got = constraints.checked(table, {"range": F.col("v") >= 0}, ("keys", ["k"]), {"parents": ("parent", parents, "id")})
    assert {r["rule"]: r["violations"] for r in got.collect()} == {"keys": 1, "range": 1, "parents": 1}
    empty = constraints.checked(table.where("false"), {"range": F.col("v") >= 0}, ("keys", ["k"]))
    assert {r["rule"]: r["violations"] for r in empty.collect()} == {"keys": 0, "range": 0}
    assert {r["rule"]: r["violations"] for r in constraints.checked(table, {"range": F.col("v") >= 6}).collect()} == {"range": 2}
    report = plan_of(__spark_entry__.queries()["constraint_violations"](spark, SF_DIR))
    assert len(re.findall(r"FileScan parquet .*?lineitem", report)) == 1 and len(re.findall(r"FileScan parquet .*?events", report)) == 1


# filters that reach the sources


@pytest.mark.parametrize("name", ["weather_point", "weather_range", "weather_daily_measured", "weather_validated"])
def test_days_become_ranges_of_time_at_the_scan(spark, name):
    scans = re.findall(r"FileScan parquet.*?PushedFilters: \[([^\]]*)\]", plan_of(__spark_entry__.queries()[name](spark, SF_DIR)), re.S)
    assert scans and all("GreaterThanOrEqual(ts," in s and "LessThan(ts," in s for s in scans)


@pytest.mark.parametrize("day", [D(2024, 1, 10), D(2024, 3, 31), D(2024, 10, 27)])
def test_the_range_of_a_day_is_its_local_day(spark, day):
    begin = datetime.datetime.combine(day, datetime.time(0)) - datetime.timedelta(hours=6)
    times = spark.createDataFrame([((begin + datetime.timedelta(minutes=30 * i)).isoformat(),) for i in range(80)], "t string").select(F.col("t").cast("timestamp_ntz").alias("t"))
    got = times.select((E.local_day(F.col("t")) == F.lit(day)).alias("local"), E.within_days(F.col("t"), day, day).alias("within")).collect()
    assert all(r["local"] == r["within"] for r in got) and any(r["local"] for r in got)


def test_filters_leave_out_requests(spark):
    asked = []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            year, month, element = (q[k].removeprefix("eq.") for k in ("aasta", "kuu", "element_kood"))
            body = json.dumps([{"jaam_nimi": s, "aasta": int(year), "kuu": int(month), "paev": 1, "tund": 2, "vaartus": 1.5, "element_kood": element} for s in ("Hill", "Hill East")]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(http_readings.StationReadings)
        read = lambda: spark.read.format("station_readings").option("url", f"http://127.0.0.1:{server.server_port}/").option("station", "Hill").option("elements", "TA,WS10M").option("start", "2023-11-01").option("end", "2024-10-31").load()
        assert read().count() == 2 * 12 * 2 and len(asked) == 24
        asked.clear()
        rows = read().where("element = 'TA' AND year = 2024 AND month >= 3 AND month < 5 AND station = 'Hill'").collect()
        assert {(r["station"], r["element"], r["year"], r["month"]) for r in rows} == {("Hill", "TA", 2024, 3), ("Hill", "TA", 2024, 4)}
        assert sorted((q["kuu"], q["element_kood"], q["jaam_nimi"]) for q in asked) == [("eq.3", "eq.TA", "eq.Hill"), ("eq.4", "eq.TA", "eq.Hill")]
        asked.clear()
        assert read().where("month IN (1, 12) AND hour = 2").count() == 2 * 2 * 2 and len(asked) == 4
        asked.clear()
        assert read().where("year = 2022").count() == 0 and not asked
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
        server.shutdown()


# numbers, and SQL functions


@pytest.mark.parametrize(
    ("text", "number"),
    [("1.5", 1.5), (" 2 ", 2.0), ("\t-3e2\n", -300.0), ("1_000", 1000.0), ("1_0.0_1e1_0", 10.01e10), (".5", 0.5), ("5.", 5.0), ("+0", 0.0), ("inf", float("inf")), ("-Infinity", float("-inf")), ("1e400", float("inf")), ("1.5d", None), ("2f", None), ("", None), ("abc", None), (None, None), ("12,5", None), ("1__0", None), ("_1", None), ("1e", None), (".", None), ("nan", None), ("0x10", None), ("1 2", None)],
)
def test_texts_are_numbers_as_in_python(spark, text, number):
    if text is not None and text.strip().lower() != "nan":
        try:
            assert float(text) == number
        except ValueError:
            assert number is None
    assert spark.createDataFrame([(text,)], "t string").select(E.safe_float(F.col("t"))).first()[0] == number


def test_sql_functions_equal_the_dataframes(spark):
    day = D(2024, 8, 4)
    harvest = "harvest_date date, field_id int, interval_days int, a decimal(12,2), b decimal(12,2), c decimal(12,2), xl decimal(12,2)"
    rows = [(D(2024, 8, 1), 1), (D(2024, 8, 4), 1), (D(2024, 7, 1), 2), (D(2024, 8, 9), 3)]
    harvests = spark.createDataFrame(rows, "harvest_date date, field_id int").selectExpr("*", "5 AS interval_days", "1.0 AS a", "0 AS b", "0 AS c", "0 AS xl")
    harvests = harvests.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in harvest.split(", ")])
    fields = spark.createDataFrame([(i, f"Field {i}") for i in range(1, 6)], "id int, name string")
    plan = spark.createDataFrame([(day, 1, 1), (day, 4, 2), (day, 3, 3), (D(2024, 8, 5), 2, 1)], PLAN)
    weather = spark.createDataFrame([(day, *[1.0] * 8)], "weather_date date, " + ", ".join(f"{c} double" for c, _ in E.COMPLETE_COLUMNS))
    sql_functions.register(spark, fields, plan, harvests, weather)
    ask = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    assert ask("SELECT * FROM daily_plan_of(DATE'2024-08-04')") == [(1, "Field 1", 1, 3), (3, "Field 3", 3, 4), (4, "Field 4", 2, 5)]
    lateral = ask("SELECT d.day, p.* FROM VALUES (DATE'2024-08-04'), (DATE'2024-08-05'), (DATE'2024-08-06') d(day), LATERAL daily_plan_of(d.day) p")
    assert lateral == sorted((r["plan_date"], r["field_id"], r["field_name"], r["position"], r["interval_days"]) for r in P.with_intervals(plan, fields, harvests).collect())
    assert ask("SELECT id, field_interval(DATE'2024-08-04', id) FROM furrow_fields") == [(1, 3), (2, 34), (3, 4), (4, 5), (5, 5)]
    assert ask("SELECT * FROM default_plan_of(DATE'2024-08-06')") == [(D(2024, 8, 6), 2, 3), (D(2024, 8, 6), 4, 1), (D(2024, 8, 6), 5, 2)]
    assert ask("SELECT * FROM default_plan_of(DATE'2024-08-05')") == []
    assert [r[:2] for r in ask("SELECT * FROM harvests_on(DATE'2024-08-04')")] == [(1, 5)]
    for n, size in ((2, 2), (0, 1), (-5, 1), (5000, 4), ("NULL", 4)):
        assert len(ask(f"SELECT * FROM harvest_history({n})")) == size
    assert ask("SELECT * FROM weather_status(DATE'2024-08-03', DATE'2024-08-04')")[1] == (day, True, "")
    assert ask("SELECT * FROM weather_status(DATE'2024-08-04', DATE'2024-08-03')") == []
