"""Places and percentiles within groups of any size, without a window over a whole group."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, group: list[str], order: list[Column], bucket: Column, name: str = "place") -> DataFrame:
    """df with the 1-based place of each row in its group, in order, and the group's size (name and name_of).

    bucket must not fall along the order. Rows are counted by bucket first; a window over these counts tells where each
    bucket begins; rows are numbered within their bucket only. So a sector with a third of all rows is dealt to many tasks.
    """
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    starts = counts.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__bucket").alias("__b"),
                           F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias(f"{name}_of"))
    own = Window.partitionBy(*group, "__bucket").orderBy(*order)
    numbered = df.withColumn("__row", F.row_number().over(own))
    on = F.col("__bucket").eqNullSafe(F.col("__b"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = numbered.join(starts, on)
    return joined.withColumn(name, F.col("__start") + F.col("__row")).drop("__bucket", "__b", "__row", "__start", *[f"__g_{g}" for g in group])


def log_bucket(value: Column, steps: int = 16) -> Column:
    """A number that grows with value, with steps buckets for each doubling, below and above zero."""
    size = F.floor(F.log2(F.abs(value.cast("double")) + 1) * steps)
    return F.when(value < 0, -size).otherwise(size)


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles by linear interpolation between the two nearest places, one column for each of shares.

    Also n (rows with a value), low and high (the extremes).
    """
    some = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    #: Equal values are one row from here on.
    counts = some.groupBy(*group, "__v").agg(F.count("*").alias("__c")).withColumn("__bucket", log_bucket(F.col("__v")))
    cells = counts.groupBy(*group, "__bucket").agg(F.sum("__c").alias("__n"))
    ahead = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__start", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*group)))
    cells = cells.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__bucket").alias("__b"), "__start", "__all")
    inside = Window.partitionBy(*group, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("__upto", F.sum("__c").over(inside))
    #: No bucket is null. By a plain equality Spark would ask one side for that, and count the rows once for each side.
    on = F.col("__bucket").eqNullSafe(F.col("__b"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    placed = counts.join(cells, on)
    last = F.col("__start") + F.col("__upto") - 1
    first = last - F.col("__c") + 1
    out = [F.max("__all").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")]
    for name, share in shares.items():
        at = (F.col("__all") - 1) * F.lit(share)
        below, above = F.floor(at), F.ceil(at)
        a = F.max(F.when((first <= below) & (below <= last), F.col("__v")))
        b = F.max(F.when((first <= above) & (above <= last), F.col("__v")))
        part = F.max(at - below)
        out.append((a + (b - a) * part).alias(name))
    return placed.groupBy(*group).agg(*out)


#: Rows up to which the values of a group are held as lists.
LISTED = 100_000


def listed_percentile(values: Column, share: float) -> Column:
    """The exact percentile, as above, of a sorted array; null if it is empty."""
    at = (F.size(values) - 1) * F.lit(share)
    a, b = F.get(values, F.floor(at).cast("int")), F.get(values, F.ceil(at).cast("int"))
    return a + (b - a) * (at - F.floor(at))


def percentiles_of_few(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """percentiles of large groups, so few that their buckets can be broadcast: df is read twice, first to count its buckets;
    then only values of the buckets that hold a place asked for move, equal ones as one row from each task."""
    some = df.filter(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v")).withColumn("__bucket", log_bucket(F.col("__v")))
    whole = Window.partitionBy(*group)
    ahead = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = some.groupBy(*group, "__bucket").agg(F.count("*").alias("__n"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    cells = cells.withColumns({"__start": F.coalesce(F.sum("__n").over(ahead), F.lit(0)), "__all": F.sum("__n").over(whole), "__low": F.min("__low").over(whole), "__high": F.max("__high").over(whole)})
    at = {name: (F.col("__all") - 1) * F.lit(share) for name, share in shares.items()}
    held = lambda x: (F.col("__start") <= x) & (x < F.col("__start") + F.col("__n"))
    asked = reduce(or_, [held(f(x)) for x in at.values() for f in (F.floor, F.ceil)])
    cells = cells.filter(asked).select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__bucket").alias("__b"), "__start", "__all", "__low", "__high")
    on = reduce(and_, [F.col(g).eqNullSafe(F.col(f"__g_{g}")) for g in group], F.col("__bucket").eqNullSafe(F.col("__b")))
    known = ["__start", "__all", "__low", "__high"]
    counts = some.join(F.broadcast(cells), on).groupBy(*group, "__bucket", "__v", *known).agg(F.count("*").alias("__c"))
    inside = Window.partitionBy(*group, "__bucket").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("__start") + F.sum("__c").over(inside) - 1
    placed = counts.withColumn("__last", last).withColumn("__first", F.col("__last") - F.col("__c") + 1)
    out = [F.max("__all").alias("n"), F.min("__low").alias("low"), F.max("__high").alias("high")]
    for name, x in at.items():
        a, b = (F.max(F.when((F.col("__first") <= f(x)) & (f(x) <= F.col("__last")), F.col("__v"))) for f in (F.floor, F.ceil))
        out.append((a + (b - a) * F.max(x - F.floor(x))).alias(name))
    return placed.groupBy(*group).agg(*out)


#: Rows up to which a group counts as small: one task sorts them.
SMALL = 1_000_000


def percentiles_at(df: DataFrame, group: list[str], value: str, place: str, size: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles as above of rows that already know their place from 0 (equals in any order) and their group's size."""
    v, out = F.col(value), [F.max(size).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")]
    for name, share in shares.items():
        at = (F.col(size) - 1) * F.lit(share)
        below, above = F.floor(at), F.ceil(at)
        a, b = F.max(F.when(F.col(place) == below, v)), F.max(F.when(F.col(place) == above, v))
        out.append((a + (b - a) * F.max(at - below)).alias(name))
    return df.groupBy(*group).agg(*out)


def summed_before(df: DataFrame, group: list[str], order: list[Column], bucket: Column, add: Column, name: str) -> DataFrame:
    """df with the sum of add over the rows of its group that come before it in order; bucket must not fall along the order.

    As in ranked: buckets are summed first, so that a window holds the rows of a bucket, never those of a group.
    """
    df = df.withColumn("__bucket", bucket).withColumn("__add", add)
    sums = df.groupBy(*group, "__bucket").agg(F.sum("__add").alias("__s"))
    sums = sums.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__bucket").alias("__b"), "__s")
    ahead = Window.partitionBy(*[f"__g_{g}" for g in group]).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__start", F.coalesce(F.sum("__s").over(ahead), F.lit(0)))
    own = Window.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("__add").over(own), F.lit(0)))
    on = F.col("__bucket") == F.col("__b")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    joined = df.join(sums, on).withColumn(name, F.col("__start") + F.col("__inside"))
    return joined.drop("__bucket", "__add", "__b", "__s", "__start", "__inside", *[f"__g_{g}" for g in group])
