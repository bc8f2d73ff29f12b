"""Salaries and ads by job: usual occupation and place of a title, newest link, sources, stores of ads, lists for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.places import us_places
from ..functions.text import job_key
from ..sources.stored import stored
from .ranking import percentiles
from .salaries import SHARES, range_medians


def mode(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value): the most frequent value of each group, of equally frequent ones the first; nulls do not count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*group).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """A left join in which nulls are equal."""
    r = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on])
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(r, match, "left").drop(*[f"__{c}" for c in on])


def job_salaries(filings: DataFrame, codes: DataFrame, least: int = 3) -> DataFrame:
    """(company_id, title, occupation, city, state, code, latitude, longitude, filings, low, p25, p50, p75, high): each title of
    a company, and each of its places (city not empty), with least filings or more there.

    filings: company_id, title, occupation, city, state, code, salary. occupation is the title's most frequent one in the
    company, code the most frequent of a place, and its point that of codes (code, latitude, longitude). Titles without a key
    and places of titles that are too rare go.
    """
    keys = filings.select("title").distinct().withColumn("key", job_key(F.col("title"))).filter("key <> ''")
    rows = filings.join(keys, "title").filter("company_id IS NOT NULL").select("company_id", "key", "occupation", "city", "state", "code", F.col("salary").cast("double").alias("salary"))
    #: Read three times below. (A place with least filings is one of a title that has as many.)
    rows = stored(rows)
    group = ["company_id", "key", "city", "state"]
    whole = F.struct(F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"))
    spots = F.explode(F.when(F.col("city") != "", F.array(whole, F.struct("city", "state"))).otherwise(F.array(whole)))
    both = rows.filter("salary IS NOT NULL").select("company_id", "key", spots.alias("spot"), "salary").select("company_id", "key", "spot.*", "salary")
    stats = percentiles(both, group, "salary", SHARES).filter(F.col("n") >= least)
    placed = _joined(stats, mode(rows.filter("city <> ''"), group, "code"), group)
    points = codes.select(F.col("code").alias("__c"), "latitude", "longitude")
    df = placed.join(mode(rows, ["company_id", "key"], "occupation"), ["company_id", "key"], "left").join(points, F.col("code") == F.col("__c"), "left")
    return df.select("company_id", F.col("key").alias("title"), "occupation", "city", "state", "code", "latitude", "longitude", F.col("n").alias("filings"), "low",
                     *[F.bround(c, 0).alias(c) for c in SHARES], "high")


def ad_summaries(ads: DataFrame) -> DataFrame:
    """(company_id, title, city, state, url, ads, low, p25, p50, p75, high): each title of a company and each US city that its
    ads name (an ad may name several).

    ads: company_id, title, location, pay_min, pay_max, url, seen. p25, p50 and p75 are the medians of lower ends, middles and
    upper ends, the middle kept between the others. url, for a whole company only, is that of the ad seen last (of equals the
    last address).
    """
    #: Titles and locations repeat: they are read once for each pair.
    read = ads.select("title", F.coalesce("location", F.lit("")).alias("location")).distinct().withColumn("key", job_key(F.col("title"))).filter("key <> ''")
    read = stored(read.withColumn("places", F.concat(F.array(F.lit(None).cast("struct<city:string,state:string>")), us_places(F.col("location")))))
    keyed = ads.withColumn("location", F.coalesce("location", F.lit(""))).join(read, ["title", "location"])
    #: Read three times below.
    keyed = stored(keyed.select("company_id", "key", "places", "pay_min", "pay_max", "url", "seen"))
    medians = range_medians(keyed.drop("url", "seen"), ["company_id", "key"], F.col("places")).filter("ads IS NOT NULL").select("*", "place.*").drop("place")
    newest = keyed.groupBy("company_id", "key").agg(F.max_by("url", F.struct("seen", "url")).alias("url"))
    df = medians.join(newest, ["company_id", "key"])
    return df.select("company_id", F.col("key").alias("title"), "city", "state", F.when(F.col("city").isNull(), F.col("url")).alias("url"), "ads", "low", "p25", "p50", "p75", "high")


def salary_sources(kinds: DataFrame, extras: DataFrame, legacy: str = "visa") -> DataFrame:
    """(kind, from, to, source): the days that each kind of salaries covers, and where they come from.

    extras (key, value) hold them under job_salaries.<kind>.<name>; those of the kind legacy may stand without the kind. Kinds
    without both days have no row.
    """
    parts = F.split("key", r"\.")
    named = extras.filter(F.col("key").startswith("job_salaries.")).select(
        F.when(F.size(parts) == 3, F.get(parts, F.lit(1))).otherwise(F.lit(legacy)).alias("kind"), F.element_at(parts, -1).alias("name"), (F.size(parts) == 3).alias("own"), "value")
    best = named.groupBy("kind", "name").agg(F.max_by("value", F.struct("own", "value")).alias("value"))
    wide = best.groupBy("kind").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in ("from", "to", "source")])
    df = kinds.select("kind").distinct().join(wide, "kind")
    days = df.select("kind", F.col("from").try_cast("date").alias("from"), F.col("to").try_cast("date").alias("to"), F.coalesce("source", F.lit("")).alias("source"))
    return days.filter("`from` IS NOT NULL AND `to` IS NOT NULL")


def share_codes(entities: DataFrame, prefixes: list[str], top: int = 20) -> DataFrame:
    """(lei, place, isin): the codes of each entity that may be its shares: of the markets prefixes, those of the oldest style
    (four zeros behind the country) first, else as they are given; no more than top. Repeated codes count where they come first.
    """
    some = entities.filter(F.substring("isin", 1, 2).isin(prefixes)).groupBy("lei", "isin").agg(F.min("n").alias("n"))
    old = F.when((F.length("isin") > 6) & (F.substring("isin", 3, 4) == "0000"), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy("lei").orderBy(old, "n"))
    return some.withColumn("place", place).filter(F.col("place") <= top).select("lei", "place", "isin")


def with_pay(store: DataFrame, since: Column) -> DataFrame:
    """Ads of a store that state their pay and were seen since a day."""
    return store.filter(F.col("pay_min").isNotNull() & F.col("pay_max").isNotNull() & (F.col("last_seen") >= since))


def store_counts(store: DataFrame) -> DataFrame:
    """(system, ads, with_pay, boards) of a store of ads."""
    return store.groupBy("system").agg(F.count("*").alias("ads"), F.count("pay_min").alias("with_pay"), F.count_distinct("board").alias("boards"))


def largest(rows: DataFrame, top: int) -> DataFrame:
    """(company_id, rows, titles): the companies with most rows of a report, each with its number of titles; the limit is the
    report's length: 40 of filings, 60 of ads."""
    counts = rows.groupBy("company_id").agg(F.count("*").alias("rows"), F.count_distinct("title").alias("titles"))
    return counts.orderBy(F.desc("rows"), "company_id").limit(top)


def sample_number(text: Column) -> Column:
    """A 32-bit number (FNV-1a over UTF-8) that a text always has: what decides whether it is in a sample."""
    digits = F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)")
    byte = lambda h: F.conv(h, 16, 10).cast("long")
    return F.aggregate(F.filter(digits, lambda h: h != ""), F.lit(2166136261).cast("long"), lambda a, h: (a.bitwiseXOR(byte(h)) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))
