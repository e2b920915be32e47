"""Daily measures as states that merge: parts of a day's readings may come in any order and be added up at any time.

A state has rows (day, bin): least and greatest temperature, the sequence and value of the last radiation, how many
wind speeds there are, how many of them are infinite, and the exact sum of those in one bin of ``furrow.functions.exact``.
States merge by one aggregation on (day, bin) with the same columns, so ``merged(a, b)`` of the states of two sets of
readings is the state of both, and daily means have the same bits whatever the parts and their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import exact
from furrow.functions import expressions as E

STATE = f"day date, bin int, t_min double, t_max double, wind_n long, wind_up long, wind_down long, wind_units {exact.UNITS}, last struct<seq: {{seq}}, number: double>"
AIR, RADIATION = ("TA", "WS10M"), "DRQS"


def state(readings: DataFrame, zone: str = E.HOME_ZONE, seq: str = "seq") -> DataFrame:
    """The state of these readings: air by local day, radiation by the day as given; what can't be read doesn't count."""
    parts = [F.col(c) for c in ("year", "month", "day", "hour")]
    radiation = F.col("element") == RADIATION
    day = F.when(radiation, E.calendar_day(*parts[:3])).otherwise(E.local_day(E.utc_time(*parts), zone))
    known = readings.where(F.col("element").isin(*AIR, RADIATION))
    known = known.select(day.alias("day"), "element", E.safe_float(F.col("value").cast("string")).alias("number"), F.col(seq).alias("seq")).where("day IS NOT NULL AND number IS NOT NULL")
    of = lambda element: F.when(F.col("element") == element, F.col("number"))
    known = exact.split(known.withColumn("wind", of("WS10M")), "wind")
    wind = F.col("wind")
    return known.groupBy("day", "bin").agg(
        F.min(of("TA")).alias("t_min"),
        F.max(of("TA")).alias("t_max"),
        F.count(wind).alias("wind_n"),
        exact.infinite_of(wind, 1).alias("wind_up"),
        exact.infinite_of(wind, -1).alias("wind_down"),
        F.sum("units").cast(exact.UNITS).alias("wind_units"),
        F.max(F.when(F.col("element") == RADIATION, F.struct("seq", "number"))).alias("last"),
    )


def merged(*states: DataFrame) -> DataFrame:
    """The state of all readings that these states are of."""
    every = reduce(DataFrame.unionByName, states)
    kept = {"t_min": F.min, "t_max": F.max, "wind_n": F.sum, "wind_up": F.sum, "wind_down": F.sum, "last": F.max}
    return every.groupBy("day", "bin").agg(*[f(c).alias(c) for c, f in kept.items()], F.sum("wind_units").cast(exact.UNITS).alias("wind_units"))


def measures(states: DataFrame) -> DataFrame:
    """(day, t_min, t_max, wind_avg, radiation) of a merged state; a state must be merged before, so that bins are there once."""
    bins, units = exact.collected("bin", "wind_units")
    sums = [F.sum(c).alias(c) for c in ("wind_n", "wind_up", "wind_down")]
    daily = states.groupBy("day").agg(F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"), bins.alias("bins"), units.alias("units"), *sums, F.max("last").alias("last"))
    wind: Column = exact.mean("bins", "units", "wind_n", "wind_up", "wind_down")
    return daily.select("day", "t_min", "t_max", wind.alias("wind_avg"), F.col("last.number").alias("radiation"))
