"""Plan queries and plan edits, for any number of days at once; an edit returns the new state of the plan."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.operators import harvests as H
from furrow.operators.upsert import delete, insert_absent

DEFAULT_ROWS = 3


def with_intervals(plan: DataFrame, fields: DataFrame, harvests: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Each planned field with its name, position and days since its last harvest."""
    named = plan.join(fields.select(F.col("id").alias("field_id"), F.col("name").alias("field_name")), "field_id")
    return named.join(H.intervals(plan, harvests, plan, last), ["plan_date", "field_id"]).select("plan_date", "field_id", "field_name", "position", "interval_days")


def stalest(fields: DataFrame, harvests: DataFrame, rows: int = DEFAULT_ROWS, as_of: datetime.date | None = None) -> DataFrame:
    """(field_id, position) of the fields that were harvested longest ago, never harvested ones first.

    All harvests count, or with ``as_of`` those before that day.
    """
    known = harvests if as_of is None else harvests.where(F.col("harvest_date") < F.lit(as_of))
    last = known.groupBy("field_id").agg(F.max("harvest_date").alias("last_harvest"))
    ranked = fields.select(F.col("id").alias("field_id")).join(last, "field_id", "left")
    top = ranked.orderBy(F.asc_nulls_first("last_harvest"), "field_id").limit(rows)
    return top.select("field_id", F.row_number().over(Window.orderBy(F.asc_nulls_first("last_harvest"), "field_id")).cast("int").alias("position"))


def default_plan(days: DataFrame, plan_days: DataFrame, fields: DataFrame, harvests: DataFrame, rows: int = DEFAULT_ROWS, as_of: datetime.date | None = None) -> DataFrame:
    """New plan rows for those days that were never initialised; an emptied day stays empty."""
    fresh = days.select("plan_date").distinct().join(plan_days, "plan_date", "left_anti")
    top = stalest(fields, harvests, rows, as_of).agg(F.array_sort(F.collect_list(F.struct("position", "field_id"))).alias("top"))  # as many as rows
    return fresh.select("plan_date", F.explode(top.scalar()).alias("t")).select("plan_date", "t.field_id", "t.position")


def ensure_default(plan: DataFrame, plan_days: DataFrame, days: DataFrame, fields: DataFrame, harvests: DataFrame, rows: int = DEFAULT_ROWS) -> tuple[DataFrame, DataFrame]:
    """The plan with its default on those of the days that were never initialised, and the initialised days with all of them, in one step."""
    return plan.select("plan_date", "field_id", "position").unionByName(default_plan(days, plan_days, fields, harvests, rows)), marked(plan_days, days)


def marked(plan_days: DataFrame, days: DataFrame) -> DataFrame:
    """The initialised days with these added."""
    return insert_absent(plan_days, days.select("plan_date").distinct().withColumn("initialized", F.lit(True)), ["plan_date"])


def add_fields(plan: DataFrame, added: DataFrame) -> DataFrame:
    """Appends (plan_date, field_id) after the last position; fields already planned stay where they are."""
    new = added.select("plan_date", "field_id").distinct().join(plan, ["plan_date", "field_id"], "left_anti")
    most = plan.groupBy("plan_date").agg(F.max("position").alias("most"))
    turn = F.row_number().over(Window.partitionBy("plan_date").orderBy("field_id"))
    placed = new.join(most, "plan_date", "left").withColumn("position", (F.coalesce("most", F.lit(0)) + turn).cast("int"))
    return plan.select("plan_date", "field_id", "position").unionByName(placed.select("plan_date", "field_id", "position"))


def add_known_fields(plan: DataFrame, plan_days: DataFrame, fields: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plan with (plan_date, field_id) added, and the initialised days with these days marked, in one step.

    A field that doesn't exist is an error when either result is computed.
    """
    known = fields.select(F.col("id").alias("field_id"), F.lit(True).alias("known"))
    refused = F.raise_error(F.concat(F.lit("unknown field "), F.coalesce(F.col("field_id").cast("string"), F.lit("null")))).cast("int")
    checked = added.join(known, "field_id", "left").select(F.when(F.col("known"), F.col("field_id")).otherwise(refused).alias("field_id"), "plan_date")
    return add_fields(plan, checked), marked(plan_days, checked.where("field_id IS NOT NULL"))


def ids_by_name(fields: DataFrame) -> DataFrame:
    """(name, id): which field a displayed name means; of fields with one name, the greatest id."""
    return fields.groupBy("name").agg(F.max("id").alias("id"))


def renumbered(plan: DataFrame) -> DataFrame:
    """Positions 1 to n on every day."""
    turn = F.row_number().over(Window.partitionBy("plan_date").orderBy("position", "field_id"))
    return plan.select("plan_date", "field_id", turn.cast("int").alias("position"))


def remove_fields(plan: DataFrame, removed: DataFrame) -> DataFrame:
    """Drops (plan_date, field_id) and closes the gaps on the days touched."""
    touched = removed.select("plan_date").distinct()
    left = delete(plan, removed, ["plan_date", "field_id"])
    return left.join(touched, "plan_date", "left_anti").select("plan_date", "field_id", "position").unionByName(renumbered(left.join(touched, "plan_date", "left_semi")))


def remove_and_mark(plan: DataFrame, plan_days: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``remove_fields``, and the initialised days with the days touched, in one step."""
    return remove_fields(plan, removed), marked(plan_days, removed)


def replace_day(plan: DataFrame, day: datetime.date, field_ids: list[int]) -> DataFrame:
    """The plan with one day's fields, in that order, in place of what it had."""
    rows = [(day, f, i) for i, f in enumerate(field_ids, 1)]
    new = plan.sparkSession.createDataFrame(rows, "plan_date date, field_id int, position int")
    return plan.where(F.col("plan_date") != F.lit(day)).select(*new.columns).unionByName(new)


def not_planned_on(day: datetime.date, fields: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_date, field_id, field_name) of the fields that one day's plan doesn't have."""
    planned = plan.where(F.col("plan_date") == F.lit(day)).select(F.col("field_id").alias("id"))
    return fields.join(planned, "id", "left_anti").select(F.lit(day).alias("plan_date"), F.col("id").alias("field_id"), F.col("name").alias("field_name"))


def not_planned(days: DataFrame, fields: DataFrame, plan: DataFrame) -> DataFrame:
    """(plan_date, field_id, field_name) of the fields that a day's plan doesn't have, for each of the days."""
    every = days.select("plan_date", F.explode("field_ids").alias("field_id"))
    left = every.join(plan, ["plan_date", "field_id"], "left_anti")
    return left.join(fields.select(F.col("id").alias("field_id"), F.col("name").alias("field_name")), "field_id").select("plan_date", "field_id", "field_name")


def with_harvest(plan: DataFrame, harvests: DataFrame) -> DataFrame:
    """The plan with what was harvested that day, 0 where nothing was; ``saved`` tells them apart."""
    same_day = harvests.select(F.col("harvest_date").alias("plan_date"), "field_id", *H.GRADES, F.lit(True).alias("saved"))
    joined = plan.join(same_day, ["plan_date", "field_id"], "left")
    grades = [F.coalesce(g, F.lit(0).cast("decimal(12,2)")).alias(g) for g in H.GRADES]
    return joined.select("plan_date", "field_id", "position", *grades, F.coalesce("saved", F.lit(False)).alias("saved"))
