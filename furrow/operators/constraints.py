"""Violations of keys, references and ranges, one row for each rule that is broken."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked(table: DataFrame, rows: dict[str, Column], keys: tuple[str, list[str]] | None = None, references: dict[str, tuple[str, DataFrame, str]] | None = None) -> DataFrame:
    """(rule, violations) of all rules of one table, from one pass over it.

    ``rows`` are conditions that no row may make false, ``keys`` a rule that these columns are unique, ``references``
    rules that a column's value, if there is one, is a key of another table: (column, table, key).
    """
    bad = {rule: F.count_if(~ok) for rule, ok in rows.items()}
    for i, (rule, (column, parents, key)) in enumerate((references or {}).items()):
        known = parents.select(F.col(key).alias(f"__key{i}"), F.lit(True).alias(f"__known{i}")).distinct()
        table = table.join(known, F.col(column) == F.col(f"__key{i}"), "left")
        bad[rule] = F.count_if(F.col(column).isNotNull() & F.col(f"__known{i}").isNull())
    if keys is None:
        total = table.agg(*[n.alias(rule) for rule, n in bad.items()])
    else:
        groups = table.groupBy(*keys[1]).agg(F.count("*").alias("__n"), *[n.alias(rule) for rule, n in bad.items()])
        total = groups.agg(F.count_if(F.col("__n") > 1).alias(keys[0]), *[F.coalesce(F.sum(rule), F.lit(0)).alias(rule) for rule in bad])
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("violations")) for rule in total.columns])
    return total.select(F.explode(each).alias("r")).select("r.*")


def enforced(table: DataFrame, rows: dict[str, Column]) -> DataFrame:
    """The table, with an error when a row is computed that makes a condition false; unknown passes.

    A write of it fails before anything is committed, and needs no pass of its own to check.
    """
    first, *rest = table.columns
    sound = F.col(first)
    for rule, ok in rows.items():
        refused = F.raise_error(F.lit(f"a row breaks the rule {rule}")).cast(table.schema[first].dataType)
        sound = F.when(F.coalesce(ok, F.lit(True)), sound).otherwise(refused)
    return table.select(sound.alias(first), *rest)


def duplicate_keys(table: DataFrame, keys: list[str], rule: str) -> DataFrame:
    return _counted(table.groupBy(*keys).count().where("count > 1"), rule)


def orphans(table: DataFrame, column: str, parents: DataFrame, key: str, rule: str) -> DataFrame:
    return _counted(table.join(parents, F.col(column) == parents[key], "left_anti"), rule)


def out_of_range(table: DataFrame, allowed: Column, rule: str) -> DataFrame:
    """Rows where the condition is false; unknown passes, as a CHECK lets it."""
    return _counted(table.where(~allowed), rule)


def position_gaps(plan: DataFrame, rule: str) -> DataFrame:
    """Days whose positions aren't 1 to n."""
    day = plan.groupBy("plan_date").agg(F.max("position").alias("most"), F.count_distinct("position").alias("different"), F.count("*").alias("n"))
    return _counted(day.where("most <> n OR different <> n"), rule)


def _counted(rows: DataFrame, rule: str) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def grades_allowed() -> Column:
    return (F.col("interval_days") >= 0) & (F.col("a") >= 0) & (F.col("b") >= 0) & (F.col("c") >= 0) & (F.col("xl") >= 0)


def weather_allowed() -> Column:
    percent = lambda c: F.col(c).isNull() | F.col(c).between(0, 100)
    least = lambda c: F.col(c).isNull() | (F.col(c) >= 0)
    return percent("humidity_avg_pct") & least("precipitation_mm") & least("wind_avg_ms") & least("wind_gust_ms") & least("radiation_mj_m2")
