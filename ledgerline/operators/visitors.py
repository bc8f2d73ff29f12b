"""Visitor reports over site events: totals, days, ranked values, search points and visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Kinds of events counted by the reports, by the column they are counted in.
KINDS = {"page_views": ["page_view", "view"], "searches": ["search", "executive_search", "click"], "company_views": ["company_view", "purchase"],
         "executive_views": ["executive_view", "signup"]}


def _counts() -> list[Column]:
    return [F.count_distinct("visitor").alias("visitors"), *[F.count_if(F.col("name").isin(v)).alias(k) for k, v in KINDS.items()], F.count("*").alias("events")]


def totals(events: DataFrame, first_day: str, last_day: str) -> DataFrame:
    return events.filter(F.col("day").between(first_day, last_day)).agg(*_counts())


def daily(events: DataFrame, first_day: str, last_day: str) -> DataFrame:
    return events.filter(F.col("day").between(first_day, last_day)).groupBy("day").agg(*_counts())


def top_values(events: DataFrame, key: Column, where: Column | None = None, top: int = 20) -> DataFrame:
    """(value, label, events, visitors): the values with most visitors, then events, then by letters."""
    some = events.withColumn("value", key.cast("string")).filter(F.col("value").isNotNull())
    some = some if where is None else some.filter(where)
    counts = some.groupBy("value").agg(F.max("label").alias("label"), F.count("*").alias("events"), F.count_distinct("visitor").alias("visitors"))
    return counts.orderBy(F.desc("visitors"), F.desc("events"), "value").limit(top)


def search_points(events: DataFrame, top: int = 100) -> DataFrame:
    """Rounded points that searches came from, most visitors first."""
    some = events.filter(F.col("name").isin(KINDS["searches"]) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    some = some.withColumn("latitude", F.bround("latitude", 2)).withColumn("longitude", F.bround("longitude", 2))
    counts = some.groupBy("latitude", "longitude").agg(F.max("label").alias("label"), F.count("*").alias("events"), F.count_distinct("visitor").alias("visitors"))
    return counts.orderBy(F.desc("visitors"), F.desc("events"), "latitude", "longitude").limit(top)


def visits(events: DataFrame, idle_minutes: int = 30) -> DataFrame:
    """One row for each visit: a visitor's events of one day with no gap above idle_minutes.

    Events are first summed by slots of that length: events of one slot are always one visit, so that only slots, of which
    a day has a few dozen, meet in a visitor's window. A visitor with a third of all events costs no more than another.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    slot = F.floor(micros / (idle_minutes * 60_000_000))
    order = F.struct("micros", "event_id")
    slots = events.withColumn("micros", micros).groupBy("day", "visitor", slot.alias("slot")).agg(
        F.min("micros").alias("first"), F.max("micros").alias("last"), F.count("*").alias("events"), F.min_by("device", order).alias("device"),
        F.min_by("country", F.when(F.col("country").isNotNull(), order)).alias("country"),
        *[F.count_if(F.col("name").isin(v)).alias(k) for k, v in KINDS.items()])
    own = Window.partitionBy("day", "visitor").orderBy("slot")
    gap = F.col("first") - F.lag("last").over(own)
    slots = slots.withColumn("visit", F.sum(F.coalesce((gap > idle_minutes * 60_000_000).cast("int"), F.lit(1))).over(own))
    return slots.groupBy("day", "visitor", "visit").agg(
        F.min("first").alias("started"), F.max("last").alias("ended"), F.sum("events").alias("events"), F.min_by("device", "slot").alias("device"),
        F.min_by("country", F.when(F.col("country").isNotNull(), F.col("slot"))).alias("country"), *[F.sum(k).alias(k) for k in KINDS],
    ).drop("visit")


def visit_steps(events: DataFrame, idle_minutes: int = 30, most: int = 200) -> DataFrame:
    """(day, visitor, started, steps): what each visit did in order: its first events as structs (at, name, subject, label).

    No slot gives more than the first few events: these are numbered in parts of a slot first, then among the parts' first
    ones, so that a visitor with a third of all events is no single window. Visits are put together from slots as visits() does.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    slot = F.floor(micros / (idle_minutes * 60_000_000))
    df = events.select("day", "visitor", "event_id", "at", "name", "subject", "label", micros.alias("micros"), slot.alias("slot"), F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("part"))
    for group in (["day", "visitor", "slot", "part"], ["day", "visitor", "slot"]):
        df = df.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy("micros", "event_id"))).filter(F.col("nth") <= most)
    step = F.struct("micros", "event_id", "at", "name", "subject", "label")
    firsts = df.groupBy("day", "visitor", "slot").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    spans = events.groupBy("day", "visitor", slot.alias("slot")).agg(F.min(micros).alias("first"), F.max(micros).alias("last"))
    own = Window.partitionBy("day", "visitor").orderBy("slot")
    gap = F.col("first") - F.lag("last").over(own)
    slots = spans.withColumn("visit", F.sum(F.coalesce((gap > idle_minutes * 60_000_000).cast("int"), F.lit(1))).over(own)).join(firsts, ["day", "visitor", "slot"])
    whole = slots.groupBy("day", "visitor", "visit").agg(F.min("first").alias("started"), F.array_sort(F.collect_list(F.struct("slot", "steps"))).alias("parts"))
    steps = F.slice(F.flatten(F.transform("parts", lambda p: p["steps"])), F.lit(1), F.lit(most))
    bare = F.transform(steps, lambda x: F.struct(x["at"].alias("at"), x["name"].alias("name"), x["subject"].alias("subject"), x["label"].alias("label")))
    return whole.select("day", "visitor", "started", bare.alias("steps"))


def newest_visits(events: DataFrame, top: int = 200) -> DataFrame:
    return visits(events).orderBy(F.desc("started"), "visitor").limit(top)
