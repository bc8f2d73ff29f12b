"""Set operations on directories: parts combined, ids without owners, spellings, samples, lookups in several steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def combined(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """The rows of all parts; of rows that share a key (ids whatever their case) the first part's stays."""
    every = reduce(DataFrame.unionByName, [p.withColumn("__turn", F.lit(n)) for n, p in enumerate(parts)])
    columns = parts[0].columns
    kinds = dict(parts[0].dtypes)
    ids = [(F.upper(k) if kinds[k] == "string" else F.col(k)).alias(f"__{k}") for k in key]
    best = every.groupBy(*ids).agg(F.min_by(F.struct(*columns), F.struct("__turn", *columns)).alias("b"))
    return best.select("b.*")


def combined_metadata(parts: DataFrame) -> DataFrame:
    """One row of parts (place, version, as_of, is_sample): versions joined in order, the oldest date, whether any is a sample."""
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "version"))), lambda x: x["version"]), "+").alias("version"),
                     F.min("as_of").alias("as_of"), F.max("is_sample").alias("is_sample"))


def distinct_spellings(df: DataFrame, column: str) -> DataFrame:
    """Each value whatever its case once, in its first spelling by letters."""
    some = df.filter(F.col(column).isNotNull())
    return some.groupBy(F.upper(column).alias("k")).agg(F.min(column).alias(column)).select(column)


def best_of(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in order, by aggregation."""
    rest = [c for c in df.columns if c not in group]
    return df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("b")).select(*group, *[f"b.{c}" for c in rest])


def without(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return df.join(other.select(*key), key, "left_anti")


def unused_ids(ids: DataFrame, users: list[DataFrame], key: str) -> DataFrame:
    """Ids that no table uses: the distinct union of what they use is taken away. Rows without an id use none."""
    used = reduce(DataFrame.union, [u.select(F.col(key)) for u in users]).filter(F.col(key).isNotNull()).distinct()
    return ids.join(used, key, "left_anti")


def even_sample(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """size rows at even distances in order, the same in every run. Places come from ranges that Spark sorts: rows are
    numbered in their range, and ranges begin where those before end."""
    ranged = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy("__part").orderBy(*order)
    numbered = ranged.withColumn("__row", F.row_number().over(own) - 1)
    counts = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    #: One row for each range of the sort.
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    at = F.col("__start") + F.col("__row")
    step = F.greatest(F.floor(F.col("__all") / size), F.lit(1))
    placed = numbered.join(F.broadcast(starts), "__part").withColumn("__at", at).filter((F.col("__at") % step == 0) & (F.col("__at") / step < size))
    return placed.drop("__part", "__row", "__n", "__start", "__all", "__at")


def cascade(asked: DataFrame, tiers: list[tuple[DataFrame, list[str]]], value: str) -> DataFrame:
    """asked with value: from the first of tiers (table, key columns) that has one for the row's key, and which tier it was.

    Each table has a row for a key at most (others are reduced to the smallest value)."""
    df, found, how = asked, [], F.lit(None).cast("int")
    for n, (table, key) in enumerate(tiers):
        one = table.groupBy(*key).agg(F.min(value).alias(f"__v{n}"))
        one = one.select(*[F.col(k).alias(f"__k{n}_{k}") for k in key], f"__v{n}")
        df = df.join(one, reduce(lambda a, b: a & b, [df[k] == one[f"__k{n}_{k}"] for k in key]), "left").drop(*[f"__k{n}_{k}" for k in key])
        found.append(F.col(f"__v{n}"))
    for n in reversed(range(len(tiers))):
        how = F.when(F.col(f"__v{n}").isNotNull(), n).otherwise(how)
    return df.withColumn(value, F.coalesce(*found)).withColumn("tier", how).drop(*[f"__v{n}" for n in range(len(tiers))])


def remapped(rows: DataFrame, merged: DataFrame, key: list[str], id: str) -> DataFrame:
    """rows with ids that were merged away (key, id, kept) replaced by those that were kept."""
    m = merged.select(*[F.col(k).alias(f"__{k}") for k in (*key, id)], "kept")
    on = reduce(lambda a, b: a & b, [rows[k] == m[f"__{k}"] for k in (*key, id)])
    return rows.join(m, on, "left").select(*[F.coalesce("kept", id).alias(c) if c == id else rows[c] for c in rows.columns])


def fuzzy_members(constituents: DataFrame, filers: DataFrame) -> DataFrame:
    """(ticker, filer_id): for each constituent (ticker, key) the filer (filer_id, key, filings) of whose key every word
    begins a word of the constituent's key; ties: the shortest key, then most filings. They meet where the filer's longest
    word, of three letters or more, is a beginning of one of the constituent's words."""
    words = constituents.select("ticker", "key", F.explode(F.array_distinct(F.split("key", " "))).alias("w")).filter(F.length("w") >= 3)
    starts = F.transform(F.sequence(F.lit(3), F.length("w")), lambda n: F.left(F.col("w"), n))
    left = words.select("ticker", "key", F.explode(starts).alias("start")).distinct()
    longest = F.element_at(F.array_sort(F.transform(F.split("key", " "), lambda w: F.struct(F.length(w).alias("l"), w.alias("w")))), -1)["w"]
    right = filers.select("filer_id", F.col("key").alias("f_key"), "filings", longest.alias("start"))
    met = left.join(right, "start")
    every = F.forall(F.split("f_key", " "), lambda w: F.exists(F.split("key", " "), lambda k: k.startswith(w)))
    order = F.struct(F.length("f_key").alias("l"), (-F.col("filings")).alias("n"), F.col("filer_id"))
    return met.filter(every).groupBy("ticker").agg(F.min_by("filer_id", order).alias("filer_id"))


def of_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """The rows of a few ids, whatever the case of text ids: a filter that reaches the scan."""
    if dict(df.dtypes)[key] == "string":
        return df.filter(F.upper(key).isin([i.upper() for i in ids]))
    return df.filter(F.col(key).isin(ids))


def second_pass(asked: DataFrame, table: DataFrame, key: str, relaxed: Column, value: str) -> DataFrame:
    """asked with value by key, and for the rows that this leaves without one by a relaxed form of the key."""
    t = table.groupBy(F.col(key).alias("__key")).agg(F.min(value).alias(value))
    first = asked.join(t, F.col(key) == F.col("__key"), "left").drop("__key")
    rest = first.filter(F.col(value).isNull()).drop(value).withColumn("__relaxed", relaxed)
    again = rest.join(t, F.col("__relaxed") == F.col("__key"), "left").drop("__key", "__relaxed")
    return first.filter(F.col(value).isNotNull()).unionByName(again)


def preferred(first: Column, second: Column, differs: Column) -> Column:
    """A place that is better known over one that is registered: the first where it is there and differs, else the second."""
    return F.when(first.isNotNull() & (second.isNull() | differs), first).otherwise(F.coalesce(second, first))


def newest_wins(rows: DataFrame, key: list[str], order: str, same: list[str]) -> DataFrame:
    """One row for a key (company_id and more): the newest by order; only rows that agree with their company's newest one in
    the columns same, so that a series never mixes two bases."""
    basis = rows.groupBy("company_id").agg(F.max_by(F.struct(*same), F.struct(order, *same)).alias("__basis"))
    df = rows.join(basis, "company_id")
    for c in same:
        df = df.filter(F.col(c).eqNullSafe(F.col(f"__basis.{c}")))
    rest = [c for c in rows.columns if c not in key]
    best = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("b"))
    return best.select(*key, *[f"b.{c}" for c in rest])


def unique_names(asked: DataFrame, people: DataFrame, name: str, id: str) -> DataFrame:
    """asked with the id of a person whose name one person alone has."""
    one = people.select(F.lower(name).alias("__name"), id).distinct().groupBy("__name").agg(F.min(id).alias("__id"), F.count("*").alias("n")).filter("n = 1")
    return asked.join(one.select("__name", "__id"), F.lower(asked[name]) == F.col("__name"), "left").drop("__name").withColumnRenamed("__id", id)


def numbered(df: DataFrame, group: list[str], order: list[Column], top: int | None = None) -> DataFrame:
    """df with place: its number within a (small) group in order; the first top of each. Groups are the rows of one company."""
    out = df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if top is None else out.filter(F.col("place") <= top)


def overlaid(rows: DataFrame, found: DataFrame, key: str, guard: str, take: list[str]) -> DataFrame:
    """rows with what was found for them, as long as the text that it was found for (guard) is still theirs."""
    f = found.select(F.col(key).alias("__key"), F.col(guard).alias("__guard"), *[F.col(c).alias(f"__{c}") for c in take])
    df = rows.join(f, (F.col(key) == F.col("__key")) & F.col(guard).eqNullSafe(F.col("__guard")), "left")
    return df.select(*[F.coalesce(f"__{c}", c).alias(c) if c in take else rows[c] for c in rows.columns])
