"""Harvest queries: history, the strictly-before as-of join, intervals, and rows of a day."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.functions import expressions as E
from furrow.operators import asof

GRADES = ("a", "b", "c", "xl")
HISTORY_DEFAULT, HISTORY_MOST = 300, 2000


def total() -> Column:
    return sum((F.col(g) for g in GRADES[1:]), F.col(GRADES[0])).cast("decimal(15,2)")


def clamped(limit: int | None) -> int:
    """A page size from 1 to 2000; none asked for gives the most."""
    return max(1, min(HISTORY_MOST if limit is None else limit, HISTORY_MOST))


def history(harvests: DataFrame, fields: DataFrame, limit: int | None = HISTORY_DEFAULT) -> DataFrame:
    """The latest harvests with field names and totals, newest first, then by field.

    Every harvest has a field, so the page is cut before names are joined to it, and put in order again after.
    """
    page = harvests.orderBy(F.desc("harvest_date"), "field_id").limit(clamped(limit))
    named = page.join(fields.select(F.col("id").alias("field_id"), F.col("name").alias("field_name")), "field_id")
    return named.orderBy(F.desc("harvest_date"), "field_id").select("harvest_date", "field_name", "interval_days", *GRADES, total().alias("total"))


def for_day(harvests: DataFrame, day: datetime.date) -> DataFrame:
    return harvests.where(F.col("harvest_date") == F.lit(day)).select("field_id", "interval_days", *GRADES)


def positive(harvests: DataFrame) -> DataFrame:
    """Harvests with anything in them; only these are saved."""
    return harvests.where(total() > 0)


def last_before(probes: DataFrame, harvests: DataFrame, day: str = "plan_date") -> DataFrame:
    """Each (day, field_id) with ``last_harvest``, the field's latest harvest strictly before that day, or null."""
    asked = probes.select("field_id", F.unix_date(day).alias("at"))
    known = harvests.select("field_id", F.unix_date("harvest_date").alias("at"))
    date = lambda c: F.date_from_unix_date(F.col(c).cast("int"))
    return asof.last_before(asked, known, ["field_id"], "at").select(date("at").alias(day), "field_id", date("last").alias("last_harvest"))


def last_before_subquery(probes: DataFrame, harvests: DataFrame, day: str = "plan_date") -> DataFrame:
    """The same by a correlated scalar subquery, to cross-check ``last_before``."""
    spark = probes.sparkSession
    return spark.sql(
        "SELECT p.{day}, p.field_id, (SELECT max(h.harvest_date) FROM {harvests} h WHERE h.field_id = p.field_id AND h.harvest_date < p.{day}) AS last_harvest FROM {probes} p",
        probes=probes.select(day, "field_id").distinct(),
        harvests=harvests,
        day=F.col(day),
    )


def intervals(probes: DataFrame, harvests: DataFrame, plan: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Days since each field's last harvest before the day, or the fallback by its position in that day's plan."""
    found = last if last is not None else last_before(probes, harvests)
    placed = found.join(plan.select("plan_date", "field_id", "position"), ["plan_date", "field_id"], "left")
    since = E.days_between(F.col("last_harvest"), F.col("plan_date"))
    return placed.select("plan_date", "field_id", F.coalesce(since, E.fallback_interval(F.col("position"))).alias("interval_days"))


def labelled(rows: DataFrame, labels: list[str]) -> DataFrame:
    """The same columns under display labels, by position."""
    return rows.toDF(*labels)
