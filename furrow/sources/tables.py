"""Stored tables: parquet, CSV, JSON or ORC under an explicit schema, and an atomic swap of a rewritten table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from furrow import schemas
from furrow.operators import upsert as U
from furrow.operators.constraints import enforced

SCHEMAS = {"fields": schemas.FIELDS, "daily_plan": schemas.DAILY_PLAN, "plan_days": schemas.PLAN_DAYS, "harvests": schemas.HARVESTS, "weather_daily": schemas.WEATHER_DAILY, "app_settings": schemas.APP_SETTINGS}


def read(spark: SparkSession, name: str, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).format(file_format).load(path)


def overwrite(df: DataFrame, path: str, file_format: str = "parquet", by_month: str | None = None) -> None:
    """Writes a table, split by month of a date column if asked, so that date ranges prune folders.

    A table that the frame itself reads must be written to a new path and swapped by the catalog or the store.
    """
    out = df if by_month is None else df.withColumn("month", F.date_format(by_month, "yyyy-MM"))
    writer = out.write.mode("overwrite").format(file_format)
    (writer if by_month is None else writer.partitionBy("month")).save(path)


def month_of(day: str) -> Column:
    return F.date_format(day, "yyyy-MM")


def upsert_by_month(path: str, delta: DataFrame, keys: list[str], payload: list[str], day: str, rules: dict[str, Column] | None = None, **how) -> None:  # noqa: ANN003
    """Upserts into a parquet table that ``overwrite`` split by month of ``day``: only touched months are read and written.

    The months of the delta come to the driver, so that the scan lists no others; the write replaces their folders
    when all tasks are done.  It is atomic for each month, not for all of them.  A row that breaks one of the ``rules``
    ends the write before any month is replaced.  ``how`` goes to ``upsert``.
    """
    months = [r[0] for r in delta.select(month_of(day)).distinct().collect()]
    if None in months:
        raise ValueError(f"a null in a key: {day}")
    if not months:
        return
    base = delta.sparkSession.read.parquet(path).where(F.col("month").isin(months)).drop("month")
    rows = enforced(U.upsert(base, delta, keys, payload, **how), rules or {}).withColumn("month", month_of(day))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_checked(rows: DataFrame, path: str, rules: dict[str, Column]) -> dict[str, int]:
    """Writes a new folder of parquet files and counts, in the same pass, the rows that break each rule.

    A rule is broken where its condition is false; unknown passes, as a CHECK lets it.  Rows that break one refuse the
    whole batch: the folder is left without rows, and the counts are in the error.
    """
    seen = Observation()
    checked = rows.observe(seen, *[F.count_if(~ok).alias(rule) for rule, ok in rules.items()])
    checked.write.mode("errorifexists").parquet(path)
    broken = {rule: n for rule, n in seen.get.items() if n}
    if broken:
        rows.limit(0).write.mode("overwrite").parquet(path)
        raise ValueError(f"refused, as rows break its rules: {broken}")
    return seen.get
