"""The whole weather refresh: measured days of the season, then the forecast, then settings, each one set-based write.

``refreshed`` is the table after both; ``refresh_all`` writes step by step, so that what was measured stays if the
forecast fails, and ``safe_refresh_all`` stores the error instead of raising it.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.operators import upsert as U
from furrow.operators import weather as W
from furrow.sources import tables

PAYLOAD = ["data_kind", "temp_min_c", "temp_max_c", "wind_avg_ms", "radiation_mj_m2", "source_station", "radiation_station", "checked", "check_message"]
MEASURED_STATIONS, FORECAST_STATION = ("main", "coast"), "forecast service"


def measured_window(today: datetime.date) -> tuple[datetime.date, datetime.date]:
    """July 1st of the year to yesterday; empty early in the year."""
    return datetime.date(today.year, 7, 1), today - datetime.timedelta(days=1)


def _with_stations(rows: DataFrame, source: str, radiation: str) -> DataFrame:
    return rows.withColumns({"source_station": F.lit(source), "radiation_station": F.lit(radiation)})


def measured_rows(readings: DataFrame, radiation: DataFrame, today: datetime.date) -> DataFrame | None:
    """The season's measured days with their stations; None before the season has a day."""
    start, end = measured_window(today)
    return _with_stations(W.measured(readings, radiation, start, end), *MEASURED_STATIONS) if end >= start else None


def forecast_rows(payloads: DataFrame) -> DataFrame:
    return _with_stations(W.forecast(payloads), FORECAST_STATION, FORECAST_STATION)


def refreshed(weather: DataFrame, readings: DataFrame, radiation: DataFrame, payloads: DataFrame, today: datetime.date, keep_existing_on_null: bool = False) -> DataFrame:
    """The weather table after a refresh on that day; missing readings overwrite, unless existing values are kept."""
    days = measured_rows(readings, radiation, today)
    table = weather if days is None else U.upsert(weather, days, ["weather_date"], PAYLOAD, keep_existing_on_null=keep_existing_on_null)
    return U.upsert(table, forecast_rows(payloads), ["weather_date"], PAYLOAD, keep_existing_on_null=keep_existing_on_null)


def with_outcome(settings: DataFrame, now: str, error: str = "") -> DataFrame:
    """Settings after a refresh: when it ran and its error, or only the error if it failed."""
    rows = [("weather_last_error", error)] + ([] if error else [("weather_last_refresh_at", now)])
    return U.upsert(settings, settings.sparkSession.createDataFrame(rows, "key string, value string"), ["key"], ["value"])


@dataclass(frozen=True)
class Store:
    """How to read the weather and settings tables, and how to put others in their place.

    With ``upsert_weather``, which gets the rows to write and the time, the weather table isn't read or put in place
    as a whole.
    """

    weather: Callable[[], DataFrame]
    save_weather: Callable[[DataFrame], None]
    settings: Callable[[], DataFrame]
    save_settings: Callable[[DataFrame], None]
    upsert_weather: Callable[[DataFrame, datetime.datetime], None] | None = None


def stored_by_month(spark: SparkSession, path: str, settings: Callable[[], DataFrame], save_settings: Callable[[DataFrame], None]) -> Store:
    """A store whose weather is a parquet table split by month, of which a refresh rewrites only the months it touches.

    The table must be there, written by ``furrow.sources.tables.overwrite``.
    """
    read = lambda: spark.read.parquet(path).drop("month")
    save = lambda rows: tables.overwrite(rows, path, by_month="weather_date")

    def upsert(rows: DataFrame, now: datetime.datetime) -> None:
        tables.upsert_by_month(path, rows, ["weather_date"], PAYLOAD, "weather_date", now=F.lit(now))

    return Store(read, save, settings, save_settings, upsert)


def _written(store: Store, rows: DataFrame, now: datetime.datetime) -> dict[str, int]:
    rows = rows.persist()  # a row a day
    try:
        if store.upsert_weather is not None:
            store.upsert_weather(rows, now)
        else:
            store.save_weather(U.upsert(store.weather(), rows, ["weather_date"], PAYLOAD, now=F.lit(now)))
        return W.counters(rows).first().asDict()
    finally:
        rows.unpersist()


def refresh_all(store: Store, readings: DataFrame, radiation: DataFrame, payloads: DataFrame, now: datetime.datetime) -> dict[str, dict[str, int]]:
    """Writes measured days, then the forecast, then the settings; ``now`` is local, with its zone.

    Each is read and written before the next, so an error leaves what was written before it.
    """
    days = measured_rows(readings, radiation, now.date())
    measured = {"saved": 0, "checked": 0} if days is None else _written(store, days, now)
    ahead = _written(store, forecast_rows(payloads), now)
    store.save_settings(with_outcome(store.settings(), now.isoformat(timespec="seconds")))
    return {"measured": measured, "forecast": {"saved": ahead["saved"]}}


def safe_refresh_all(store: Store, readings: DataFrame, radiation: DataFrame, payloads: DataFrame, now: datetime.datetime) -> dict:
    """``refresh_all``, or the error, which the settings keep until a refresh succeeds."""
    try:
        return refresh_all(store, readings, radiation, payloads, now)
    except Exception as error:  # whatever a source or a write raises
        text = str(error) or type(error).__name__
        store.save_settings(with_outcome(store.settings(), "", text))
        return {"error": text}
