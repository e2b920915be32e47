"""Station readings and forecasts from public JSON services, as Python data sources.

Readings have one partition for each element and month:

    spark.dataSource.register(StationReadings)
    spark.read.format("station_readings").option("url", ...).option("station", ...).option("elements", "TA,WS10M")
        .option("start", "2024-07-01").option("end", "2024-08-19").load()

Station, element, year and month are sent with each request, so the service filters; requests run in parallel on
the executors.  With ``spark.sql.python.filterPushdown.enabled``, filters on element, year and month leave out
requests that can't match, and one on the station goes to the service by its exact name.  A reply that isn't a list of readings is an error, or with ``lenient`` no readings, as it is for
daily radiation.

    spark.read.format("forecast_payload").option("url", ...).option("latitude", ...).option("longitude", ...)
        .option("start", "2024-08-20").load()

gives the forecast's reply as one row (json) for ``furrow.operators.weather.forecast``.
"""

from __future__ import annotations

import datetime
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "station string, year int, month int, day int, hour int, value string, element string"
TIMEOUT_S = 45
# The names of the service's fields.
NAMES = {"station": "jaam_nimi", "year": "aasta", "month": "kuu", "day": "paev", "hour": "tund", "value": "vaartus", "element": "element_kood"}


@dataclass
class MonthPartition(InputPartition):
    element: str
    year: int
    month: int


def months(start: datetime.date, end: datetime.date) -> Iterator[tuple[int, int]]:
    for n in range(start.year * 12 + start.month - 1, end.year * 12 + end.month):
        yield n // 12, n % 12 + 1


def may_hold(condition: Filter, value: object) -> bool:
    """Whether a value fulfils a filter; filters of other kinds leave nothing out."""
    tests = {EqualTo: lambda x: value == x, EqualNullSafe: lambda x: value == x, In: lambda x: value in x, GreaterThan: lambda x: value > x, GreaterThanOrEqual: lambda x: value >= x, LessThan: lambda x: value < x, LessThanOrEqual: lambda x: value <= x}
    test = tests.get(type(condition))
    return test is None or bool(test(condition.value))


class StationReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.filters: list[Filter] = []
        self.named: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps filters on what a request asks for; Spark evaluates all of them again on the rows."""
        for f in filters:
            if f.attribute in (("element",), ("year",), ("month",)):
                self.filters.append(f)
            elif f.attribute == ("station",) and isinstance(f, EqualTo):
                self.named = f.value
            yield f

    def partitions(self) -> list[MonthPartition]:
        start, end = (datetime.date.fromisoformat(self.options[k]) for k in ("start", "end"))
        parts = [MonthPartition(e, y, m) for e in self.options["elements"].split(",") for y, m in months(start, end)]
        return [p for p in parts if all(may_hold(f, getattr(p, f.attribute[0])) for f in self.filters)]

    def read(self, partition: MonthPartition | None) -> Iterator[tuple]:
        if partition is None:  # no month fulfils the filters
            return
        station = self.options["station"]
        exact = self.options.get("exact", "false") == "true"
        asked = {
            NAMES["station"]: f"eq.{self.named}" if self.named is not None else f"like.{station}" if exact else f"ilike.*{station}*",
            NAMES["element"]: f"eq.{partition.element}",
            NAMES["year"]: f"eq.{partition.year}",
            NAMES["month"]: f"eq.{partition.month}",
            "select": ",".join(NAMES.values()),
            "order": f"{NAMES['day']}.asc,{NAMES['hour']}.asc",
        }
        with urllib.request.urlopen(f"{self.options['url']}?{urllib.parse.urlencode(asked)}", timeout=TIMEOUT_S) as reply:
            rows = json.load(reply)
        if not isinstance(rows, list):
            if self.options.get("lenient", "false") == "true":
                return
            raise ValueError("the service did not return a list of readings")
        whole = lambda x: None if x in (None, "") else int(x)
        for r in rows:
            value = r.get(NAMES["value"])
            yield (r.get(NAMES["station"]), *(whole(r.get(NAMES[k])) for k in ("year", "month", "day", "hour")), None if value is None else str(value), r.get(NAMES["element"]))


class StationReadings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "station_readings"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StationReader:  # noqa: ANN001
        return StationReader(dict(self.options))


# What is asked of the forecast service, and for how many days.
FORECAST_ASKED = {"timezone": "Europe/Tallinn", "daily": "temperature_2m_min,temperature_2m_max,shortwave_radiation_sum", "hourly": "wind_speed_10m", "wind_speed_unit": "ms"}
FORECAST_DAYS = 9


class ForecastReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def read(self, partition: InputPartition) -> Iterator[tuple[str]]:
        start = datetime.date.fromisoformat(self.options["start"])
        end = start + datetime.timedelta(days=int(self.options.get("days", FORECAST_DAYS)) - 1)
        asked = {"latitude": self.options["latitude"], "longitude": self.options["longitude"], "start_date": start.isoformat(), "end_date": end.isoformat()} | FORECAST_ASKED
        with urllib.request.urlopen(f"{self.options['url']}?{urllib.parse.urlencode(asked)}", timeout=TIMEOUT_S) as reply:
            payload = json.load(reply)
        if not isinstance(payload, dict):
            raise ValueError("the service did not return a forecast")
        yield (json.dumps(payload),)


class ForecastPayload(DataSource):
    @classmethod
    def name(cls) -> str:
        return "forecast_payload"

    def schema(self) -> str:
        return "json string"

    def reader(self, schema) -> ForecastReader:  # noqa: ANN001
        return ForecastReader(dict(self.options))
