"""Keyed writes as DataFrame operators: upsert of some columns, insert if absent, delete, schema additions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Columns that a write fills by itself, where the table has them and it is told the time.
CREATED, UPDATED = "created_at", "updated_at"


def latest(delta: DataFrame, keys: list[str], payload: list[str], order: str | None = None) -> DataFrame:
    """``delta`` with each key once: its last row by ``order``; without one, a repeated key is an error.

    A null in a key is an error too, as stored keys are never null.
    """
    row = F.struct(*payload)
    chosen = F.first(row) if order is None else F.max_by(row, order)
    counted = delta.groupBy(*keys).agg(chosen.alias("row"), F.count("*").alias("n"))
    wrong = reduce(or_, [F.col(k).isNull() for k in keys])
    sound = F.when(wrong, F.raise_error(F.lit("a null in a key: " + ", ".join(keys))))
    if order is None:
        sound = sound.when(F.col("n") > 1, F.raise_error(F.lit("a key is written twice: " + ", ".join(keys))))
    return counted.select(*keys, sound.otherwise(F.col("row")).alias("row")).select(*keys, "row.*")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], payload: list[str], defaults: dict | None = None, keep_existing_on_null: bool = False, order: str | None = None, now: Column | None = None) -> DataFrame:
    """Rows of ``base`` with the payload columns of ``delta`` written over, and new rows with defaults elsewhere.

    A null in the payload overwrites, unless ``keep_existing_on_null``.  Of rows of ``delta`` with one key, the last
    by ``order`` counts; without an order they are an error.  With ``now``, written rows get it as ``updated_at``
    and new ones as ``created_at``, where the table has these columns.
    """
    defaults = defaults or {}
    old = base.withColumn("__old", F.lit(True)).alias("o")
    new = latest(delta, keys, payload, order).withColumn("__new", F.lit(True)).alias("n")
    joined = old.join(new, keys, "full_outer")

    def value(c: str) -> Column:
        kind = base.schema[c].dataType
        if c in keys:
            return F.col(c)
        if c in payload:
            written = F.coalesce(F.col(f"n.{c}").cast(kind), F.col(f"o.{c}")) if keep_existing_on_null else F.col(f"n.{c}").cast(kind)
            return F.when(F.col("__new"), written).otherwise(F.col(f"o.{c}"))
        if now is not None and c == UPDATED:
            return F.when(F.col("__new"), now.cast(kind)).otherwise(F.col(f"o.{c}"))
        absent = now if now is not None and c == CREATED else F.lit(defaults.get(c))
        return F.when(F.col("__old"), F.col(f"o.{c}")).otherwise(absent.cast(kind))

    return joined.select(*[value(c).alias(c) for c in base.columns])


def touched_months(base: DataFrame, delta: DataFrame, keys: list[str], payload: list[str], day: str, defaults: dict | None = None) -> DataFrame:
    """The rows, with their ``month``, of those months of ``base`` that the delta touches, after it is upserted.

    The delta's months are as many as the calendar has at most; they come to ``base`` by broadcast.
    """
    month = F.date_format(day, "yyyy-MM")
    months = F.broadcast(delta.select(month.alias("month")).distinct())
    near = base.withColumn("month", month).join(months, "month", "left_semi").drop("month")
    return upsert(near, delta, keys, payload, defaults).withColumn("month", month)


def insert_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those rows of ``delta`` whose key it doesn't have."""
    return base.unionByName(delta.join(base, keys, "left_anti"), allowMissingColumns=True).select(*base.columns)


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti")


def with_columns_added(base: DataFrame, added: dict[str, tuple[str, object]]) -> DataFrame:
    """``base`` with each named column that it lacks, of that type and with that value."""
    return base.withColumns({c: F.lit(v).cast(kind) for c, (kind, v) in added.items() if c not in base.columns})


def setting(settings: DataFrame, key: str, default: str = "") -> DataFrame:
    """One row: the value of a key, or the default."""
    one = settings.sparkSession.range(1).select(F.lit(key).alias("key"))
    return one.join(settings.select("key", "value"), "key", "left").select("key", F.coalesce("value", F.lit(default)).alias("value"))
