"""Stored tables, the JSON service, and streaming ingestion."""

from __future__ import annotations

import datetime
import io
import json

import pytest

from furrow import schemas
from furrow.operators import upsert as U
from furrow.sources import http_readings, tables
from furrow.streaming import ingest


@pytest.mark.parametrize("kind", ["parquet", "json", "csv", "orc"])
def test_tables_round_trip(spark, tmp_path, kind):
    rows = spark.createDataFrame([(1, "Field 1"), (2, "Field 2")], "id int, name string")
    tables.overwrite(rows, f"{tmp_path}/t", kind)
    assert sorted(tuple(r) for r in tables.read(spark, "fields", f"{tmp_path}/t", kind).collect()) == [(1, "Field 1"), (2, "Field 2")]


def test_one_request_for_each_element_and_month(monkeypatch):
    asked = []

    def reply(url, timeout):
        asked.append(url)
        return io.BytesIO(json.dumps([{"jaam_nimi": "Station 1", "aasta": 2024, "kuu": "7", "paev": 1, "tund": "", "vaartus": 1.5, "element_kood": "TA"}]).encode())

    monkeypatch.setattr(http_readings.urllib.request, "urlopen", reply)
    reader = http_readings.StationReader({"url": "http://test", "station": "one", "elements": "TA,WS10M", "start": "2024-11-30", "end": "2025-01-01"})
    parts = reader.partitions()
    assert [(p.element, p.year, p.month) for p in parts] == [(e, y, m) for e in ("TA", "WS10M") for y, m in ((2024, 11), (2024, 12), (2025, 1))]
    assert list(reader.read(parts[0])) == [("Station 1", 2024, 7, 1, None, "1.5", "TA")]
    assert "ilike." in asked[0] and "kuu=eq.11" in asked[0]
    monkeypatch.setattr(http_readings.urllib.request, "urlopen", lambda url, timeout: io.BytesIO(b"{}"))
    with pytest.raises(ValueError):
        list(reader.read(parts[0]))
    reader.options["lenient"] = "true"
    assert list(reader.read(parts[0])) == []


def test_a_forecast_is_one_payload(monkeypatch):
    asked = []

    def reply(url, timeout):
        asked.append(url)
        return io.BytesIO(b'{"daily": {"time": ["2024-08-20"]}}')

    monkeypatch.setattr(http_readings.urllib.request, "urlopen", reply)
    source = http_readings.ForecastPayload({"url": "http://test", "latitude": "58.1", "longitude": "25.5", "start": "2024-08-20"})
    reader = source.reader(None)
    assert [json.loads(r[0]) for r in reader.read(None)] == [{"daily": {"time": ["2024-08-20"]}}]
    assert "start_date=2024-08-20" in asked[0] and "end_date=2024-08-28" in asked[0] and "wind_speed_unit=ms" in asked[0]
    monkeypatch.setattr(http_readings.urllib.request, "urlopen", lambda url, timeout: io.BytesIO(b"[]"))
    with pytest.raises(ValueError):
        list(reader.read(None))


def test_hourly_means_close_behind_the_watermark(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    at = lambda day, hour, value: json.dumps({"station": "s", "year": 2024, "month": 7, "day": day, "hour": hour, "value": value, "element": "TA"})
    (src / "a.json").write_text("\n".join([at(1, 1, "5"), at(1, 1, "7"), at(1, 2, "1"), at(2, 9, "3")]))
    means = ingest.hourly_means(ingest.readings_stream(spark, str(src)))
    means.writeStream.format("memory").queryName("means").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r["window"].start.hour, r["mean"], r["readings"]) for r in spark.table("means").collect()) == [(1, 6.0, 2), (2, 1.0, 1)]


def test_a_stream_of_files_is_upserted_by_day(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    row = {"station": "s", "year": 2024, "month": 7, "day": 1, "hour": 22, "value": "5", "element": "TA"}
    (src / "a.json").write_text(json.dumps(row) + "\n" + json.dumps(row | {"hour": 1}))
    state = {"days": spark.createDataFrame([], "day date, seen int")}

    def write(batch, _):
        days = ingest.touched_days(batch).selectExpr("day", "1 AS seen")
        merged = U.upsert(state["days"], days, ["day"], ["seen"]).collect()
        state["days"] = spark.createDataFrame(merged, "day date, seen int")

    ingest.into(ingest.readings_stream(spark, str(src)), write, f"{tmp_path}/checkpoint").awaitTermination()
    assert sorted(r["day"] for r in state["days"].collect()) == [datetime.date(2024, 7, 1), datetime.date(2024, 7, 2)]


def test_days_are_computed_again_from_all_stored_readings(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    state = {"weather": spark.createDataFrame([], schemas.WEATHER_DAILY)}

    def save(merged):
        state["weather"] = spark.createDataFrame(merged.collect(), schemas.WEATHER_DAILY)

    def arrive(name, *rows):
        (src / name).write_text("\n".join(json.dumps({"station": "s", "year": 2024, "month": 7, "day": 1, "hour": h, "value": v, "element": e}) for e, h, v in rows))
        writer = ingest.day_writer(f"{tmp_path}/store", lambda: state["weather"], save)
        ingest.into(ingest.readings_stream(spark, str(src)), writer, f"{tmp_path}/checkpoint").awaitTermination()
        return {r["weather_date"].day: tuple(None if r[c] is None else float(r[c]) for c in ("temp_min_c", "temp_max_c", "radiation_mj_m2")) for r in state["weather"].collect()}

    assert arrive("a.json", ("TA", 1, "5"), ("TA", 22, "7"), ("DRQS", 1, "3")) == {1: (5, 5, 3), 2: (7, 7, None)}
    assert arrive("b.json", ("TA", 2, "9"), ("DRQS", 2, "4")) == {1: (5, 9, 4), 2: (7, 7, None)}
