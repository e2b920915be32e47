"""Continuous ingestion: station readings as a stream, kept as a keyed table of checked days.

Each micro-batch is stored as a state of the days that it touches, which merges with the states before it, so a late
reading costs its own month's states and no reading is read twice.  A micro-batch that is repeated after a failure
replaces its own state; a reading that is sent twice in different batches counts twice, as in the batch refresh, and the
last radiation of a day is that of the last batch.  Days are local dates, as fixed-length windows don't follow daylight
saving.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from furrow import schemas
from furrow.functions import expressions as E
from furrow.operators import daily_state
from furrow.operators import upsert as U
from furrow.operators import weather as W
from furrow.sources import tables

#: What a stored state has: its rows, and the month and batch that its folders are named for.
STORED = daily_state.STATE.format(seq="struct<batch: bigint, row: bigint>") + ", month string, batch bigint"


def readings_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON files of readings, under the explicit schema."""
    return spark.readStream.schema(schemas.READINGS).option("maxFilesPerTrigger", files_per_batch).json(path)


def touched_days(batch: DataFrame, zone: str = E.HOME_ZONE) -> DataFrame:
    return W.with_local_day(batch, zone).select(F.col("local_day").alias("day")).distinct()


def month_writer(store: str, table: str, zone: str = E.HOME_ZONE) -> Callable[[DataFrame, int], None]:
    """``day_writer`` into a parquet table split by month, of which only the touched months are read and written."""

    def upsert(rows: DataFrame) -> None:
        payload = [c for c in rows.columns if c != "weather_date"]
        tables.upsert_by_month(table, rows, ["weather_date"], payload, "weather_date", defaults=schemas.DEFAULTS["weather_daily"])

    return _writer(store, upsert, zone)


def day_writer(store: str, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], zone: str = E.HOME_ZONE) -> Callable[[DataFrame, int], None]:
    """A writer for ``into``: stores the state of each micro-batch, merges those of the days it touches, and upserts weather.

    States lie in folders by month and batch.  ``load`` gives the weather table, and ``save`` puts another in its
    place.  The touched months of one batch come to the driver, so that the others' folders aren't read.
    """

    def upsert(rows: DataFrame) -> None:
        payload = [c for c in rows.columns if c != "weather_date"]
        save(U.upsert(load(), rows, ["weather_date"], payload, schemas.DEFAULTS["weather_daily"]))

    return _writer(store, upsert, zone)


def _writer(store: str, upsert: Callable[[DataFrame], None], zone: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        numbered = batch.withColumn("seq", F.struct(F.lit(batch_id).cast("long").alias("batch"), F.monotonically_increasing_id().alias("row")))
        new = daily_state.state(numbered, zone).withColumns({"month": F.date_format("day", "yyyy-MM"), "batch": F.lit(batch_id).cast("long")})
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(store)
        stored = spark.read.schema(STORED).parquet(store)
        touched = stored.where(F.col("batch") == batch_id).select("month", "day").distinct()
        months = [r["month"] for r in touched.select("month").distinct().collect()]
        if not months:
            return
        same_days = stored.where(F.col("month").isin(months)).join(touched, ["month", "day"], "left_semi").drop("month", "batch")
        upsert(W.judged(daily_state.measures(daily_state.merged(same_days))))

    return write


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Writes the merged states of a store to a new one, with one state for each day, while no stream writes to it.

    They are numbered as the last batch, which is whole when the stream has stopped; the stream goes on with the target.
    """
    stored = spark.read.schema(STORED).parquet(store)
    last = stored.agg(F.max("batch")).first()[0]
    if last is not None:
        merged = daily_state.merged(stored.drop("month", "batch")).withColumns({"month": F.date_format("day", "yyyy-MM"), "batch": F.lit(last)})
        merged.repartition("month").write.mode("errorifexists").partitionBy("month", "batch").parquet(target)


def into(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives each micro-batch to ``write``, once for all files that are there now."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_means(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Windowed means of each station and element, closed when the watermark passes."""
    timed = stream.withColumns({"time": E.utc_time(*[F.col(c) for c in ("year", "month", "day", "hour")]).cast("timestamp"), "number": E.safe_float(F.col("value"))}).where("time IS NOT NULL AND number IS NOT NULL")
    return timed.withWatermark("time", late).groupBy(F.window("time", "1 hour"), "station", "element").agg(F.avg("number").alias("mean"), F.count("*").alias("readings"))
