"""A log of plan edits, replayed in order: what the calls for each day leave, which days they mark, what is refused.

Edits are (plan_date, seq, kind, field_id).  ``add`` puts a field after the last position, unless it is planned
already; ``remove`` takes it away, if it is there, and closes the gaps; ``default`` fills a day that no edit has
touched yet with the fields harvested longest ago.  Each accepted edit marks its day.  Refused are adds of fields
that don't exist, other kinds, and edits without a day or place in the order; they change and mark nothing.

The fold over a day's edits has a closed form, so that no day is gone through edit by edit.  A field stays where the
plan had it unless it is removed; else it is in the plan from its first add after its last removal, if there is one.
Fields are in the order of their old positions, then of these adds, and positions run from 1 if anything was removed
that day.  These are sums over (day, field) and (day), which are added up before they are shuffled.

Adds of one day with equal ``seq`` count by field, before removals with that ``seq``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.plans import daily as P

ADD, REMOVE, DEFAULT = "add", "remove", "default"


@dataclass(frozen=True)
class Replay:
    """The plan, the marked days, and the refused edits with a reason."""

    plan: DataFrame
    plan_days: DataFrame
    refused: DataFrame


def replayed(plan: DataFrame, plan_days: DataFrame, fields: DataFrame, harvests: DataFrame, edits: DataFrame) -> Replay:
    """The state after all edits, each day's in the order of ``seq``."""
    known = fields.select(F.col("id").alias("field_id"), F.lit(True).alias("known"))
    reason = (
        F.when(F.col("plan_date").isNull() | F.col("seq").isNull(), "no day or place")
        .when(~F.coalesce(F.col("kind").isin(ADD, REMOVE, DEFAULT), F.lit(False)), "unknown kind")
        .when((F.col("kind") == ADD) & F.col("known").isNull(), "unknown field")
    )
    judged = edits.select("plan_date", "seq", "kind", "field_id").join(known, "field_id", "left").withColumn("reason", reason).drop("known")
    log = judged.where("reason IS NULL").drop("reason")
    removal = F.col("kind") == REMOVE
    days = log.groupBy("plan_date").agg(F.min(F.struct("seq", "kind")).alias("first"), F.max(removal).alias("renumbered"))
    defaulted = P.default_plan(days.where(F.col("first.kind") == DEFAULT), plan_days, fields, harvests)
    old = plan.select("plan_date", "field_id", "position")
    old = old.unionByName(defaulted.join(old, ["plan_date", "field_id"], "left_anti"))

    key = ["plan_date", "field_id"]
    removed = log.where(removal).groupBy(*key).agg(F.max("seq").alias("removed_at"))
    stay = old.join(removed, key, "left_anti").withColumn("added_at", F.lit(None).cast(log.schema["seq"].dataType))
    adds = log.where(F.col("kind") == ADD).groupBy(*key, "seq").agg(F.lit(True).alias("add")).join(removed, key, "left")
    adds = adds.where(F.col("removed_at").isNull() | (F.col("seq") > F.col("removed_at"))).groupBy(*key).agg(F.min("seq").alias("added_at"))
    adds = adds.join(stay, key, "left_anti").withColumn("position", F.lit(None).cast("int"))
    left = stay.unionByName(adds.select(stay.columns)).join(days.select("plan_date", "renumbered"), "plan_date", "left")
    in_order = Window.partitionBy("plan_date").orderBy(F.asc_nulls_first("added_at"), "position", "field_id")
    turn = F.row_number().over(in_order)
    day = Window.partitionBy("plan_date")
    most, before = F.coalesce(F.max("position").over(day), F.lit(0)), F.count("position").over(day)
    place = F.when(F.coalesce("renumbered", F.lit(False)), turn).otherwise(F.coalesce("position", most + turn - before))
    new_plan = left.select(*key, place.cast("int").alias("position"))
    return Replay(new_plan, P.marked(plan_days, days), judged.where("reason IS NOT NULL").select(*edits.select("plan_date", "seq", "kind", "field_id").columns, "reason"))


def as_one(replay: Replay) -> DataFrame:
    """(what, plan_date, field_id, position, seq, reason): the plan's rows, the marked days and the refused edits."""
    none = lambda kind: F.lit(None).cast(kind)
    plan = replay.plan.select(F.lit("plan").alias("what"), "plan_date", F.col("field_id").cast("long").alias("field_id"), "position", none("long").alias("seq"), none("string").alias("reason"))
    days = replay.plan_days.select(F.lit("mark").alias("what"), "plan_date", none("long").alias("field_id"), none("int").alias("position"), none("long").alias("seq"), none("string").alias("reason"))
    refused = replay.refused.select(F.lit("refused").alias("what"), "plan_date", F.col("field_id").cast("long").alias("field_id"), none("int").alias("position"), F.col("seq").cast("long").alias("seq"), "reason")
    return plan.unionByName(days).unionByName(refused)
