"""Site events as a stream: stored in micro-batches, visits and days as windows, salts of days, and the store of ads.

Writers are idempotent: a micro-batch writes under its own number, so a batch that is run again after a failure writes the
same rows in the same place. Nothing is dropped when events come faster than they are stored: triggers take more at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.web import visitor_hash
from ..operators.visitors import KINDS
from ..sources.publish import upserted

#: The names of events that a browser may send.
CLIENT_EVENTS = ("page_view", "search", "company_view", "executive_view", "executive_search", "view", "click", "purchase", "signup", "error")


def accepted(events: DataFrame, name: str = "name") -> DataFrame:
    """Events of known names; all others are refused."""
    return events.filter(F.col(name).isin(*CLIENT_EVENTS))


def detail_json(detail: Column) -> Column:
    """A map of details as JSON, without blank values; null if none is left."""
    kept = F.map_filter(detail, lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "")
    return F.when(F.size(kept) > 0, F.to_json(kept))


def stored(events: DataFrame, folder: str, checkpoint: str, seconds: int = 2) -> StreamingQuery:
    """Appends a stream of events to folder, partitioned by day, a batch every so many seconds."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.partitionBy("batch", "day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def _counts() -> list[Column]:
    return [*[F.count_if(F.col("name").isin(v)).alias(k) for k, v in KINDS.items()], F.count("*").alias("events")]


def visits(events: DataFrame, idle: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Visits of a stream (or a table): a visitor's events of one day no more than idle apart; a visit is final once the stream
    is late past its end. (A gap of exactly idle does not end a visit.)"""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    return timed.groupBy("day", "visitor", F.session_window("at", idle).alias("w")).agg(
        F.min("at").alias("started"), F.max("at").alias("ended"), *_counts()).drop("w")


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day and kind, a window of a day each."""
    timed = events.withWatermark("at", late) if events.isStreaming else events
    return timed.groupBy(F.window("at", "1 day").alias("w")).agg(*_counts()).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), *KINDS, "events")


def salts(spark: SparkSession, known: DataFrame, days: DataFrame, keep_days: int = 2, fresh: Callable[[], Column] | None = None) -> DataFrame:
    """(day, salt): the salts of days, a new one for each day that has none; those older than keep_days before the newest go.

    fresh: what makes a new salt; a random one unless a test gives another.
    """
    new = fresh() if fresh else F.sha2(F.concat_ws("|", F.uuid(), F.uuid()), 256)
    added = days.select("day").distinct().join(known.select("day"), "day", "left_anti").withColumn("salt", new)
    every = known.select("day", "salt").unionByName(added.select("day", "salt"))
    newest = every.agg(F.max(F.to_date("day")).alias("newest"))
    return every.join(F.broadcast(newest), F.to_date("day") > F.date_sub("newest", keep_days)).drop("newest")


def hashed(events: DataFrame, salts: DataFrame, fingerprint: str) -> DataFrame:
    """events with visitor: the hash of the day's salt and a fingerprint, which itself goes."""
    df = events.join(F.broadcast(salts), "day")
    return df.withColumn("visitor", visitor_hash(F.col("salt"), F.col(fingerprint))).drop("salt", fingerprint)


def seen_ads(ads: DataFrame, root: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Keeps the store of ads under root up to date with a stream of readings (key columns, values, day): each batch writes
    the store of its number from that of the number before, so a batch that runs again writes the same."""
    spark = ads.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        values = [c for c in batch.columns if c not in (*key, "day")]
        latest = F.max_by(F.struct(*values, "day"), F.struct("day", *values)).alias("b")
        new = batch.groupBy(*key).agg(latest).select(*key, *[f"b.{c}" for c in values], "b.day")
        if number:
            old = spark.read.parquet(f"{root}/batch-{number - 1}")
        else:
            old = spark.createDataFrame([], new.drop("day").schema).withColumn("first_seen", F.lit(None).cast("date")).withColumn("last_seen", F.lit(None).cast("date"))
        _upserted_by_day(old, new, key).write.mode("overwrite").parquet(f"{root}/batch-{number}")

    return ads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _upserted_by_day(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """upserted, with each new row's own day."""
    days = new.select(*key, F.col("day").alias("__day"))
    out = upserted(old, new.drop("day"), key, F.lit(None).cast("date")).join(days, key, "left")
    first, last = F.coalesce("first_seen", "__day"), F.coalesce("__day", "last_seen")
    return out.withColumn("first_seen", first).withColumn("last_seen", last).drop("__day")
