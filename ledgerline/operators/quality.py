"""Checks of a directory before it is published: rules that must hold, reported checks, tallies, orphans, first rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import USD_PER, usd_rate
from ..sources.stored import stored


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Distinct keys of child that parent lacks."""
    return child.join(parent, key, "left_anti").select(key).distinct()


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in order: an aggregation, so that a key with many rows is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*keys).agg(first).select(*keys, *[f"first.{c}" for c in rest])


def _stacked(counts: DataFrame, checks: list[tuple[str, str, str]]) -> DataFrame:
    """One row of counts (columns c0, c1, ...) as a row for each of checks (area, name, severity)."""
    rows = F.array(*[F.struct(F.lit(a).alias("area"), F.lit(n).alias("name"), F.lit(s).alias("severity"), F.col(f"c{i}").cast("long").alias("n")) for i, (a, n, s) in enumerate(checks)])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def _counted(df: DataFrame, checks: list[tuple[str, str, str, Column]]) -> DataFrame:
    """All checks of a table in one pass over it."""
    return _stacked(df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(f"c{i}") for i, (*_, test) in enumerate(checks)]), [c[:3] for c in checks])


def checks(companies: DataFrame, locations: DataFrame, periods: DataFrame, pay: DataFrame, people: DataFrame, this_year: int, least_usd: float = 10_000_000) -> DataFrame:
    """(area, name, severity, n) of each check; n is 0 where all is well. Jumps and profits count from a revenue of
    least_usd dollars on. Each table is read once for all that can be told from its rows or its companies."""
    #: Sums of orders and items are worked out once, not by each check.
    periods, pay = stored(periods), stored(pay.select("company_id", "person_id", "name", "year", "total"))
    usd = F.col("revenue").cast("double") * usd_rate(F.col("currency"))
    located = locations.groupBy("company_id").agg(F.count("*").alias("places"), F.count_if(F.col("type") == "Headquarters").alias("seats"))
    annual_year = F.when(F.col("period_type") == "Annual", F.col("fiscal_year"))
    figures = periods.groupBy("company_id").agg(F.count("*").alias("rows"), F.max(annual_year).alias("newest"))
    c = companies.join(located, "company_id", "left").join(figures, "company_id", "left")
    annual = periods.filter("period_type = 'Annual'").join(companies.select("company_id", "currency"), "company_id").withColumn("usd", usd)
    own = Window.partitionBy("company_id").orderBy("fiscal_year")
    annual = annual.withColumn("before", F.lag("revenue").over(own)).withColumn("year_before", F.lag("fiscal_year").over(own))
    both = F.least("revenue", "before").cast("double") * usd_rate(F.col("currency")) >= least_usd
    jump = both & (F.col("fiscal_year") == F.col("year_before") + 1) & ((F.col("revenue") > 10 * F.col("before")) | (F.col("before") > 10 * F.col("revenue")))
    quarters = periods.filter("period_type = 'Quarterly'").groupBy("company_id", "fiscal_year").agg(F.sum("revenue").alias("sum"), F.count("*").alias("c")).filter("c = 4")
    annual = annual.join(quarters, ["company_id", "fiscal_year"], "left")
    off = F.abs(F.col("sum") - F.col("revenue")) > F.lit("0.02").cast("decimal(4,2)") * F.abs("revenue")
    large = F.col("usd") >= least_usd
    paid = pay.join(companies.select("company_id", "currency"), "company_id", "left").withColumn("usd", F.col("total").cast("double") * usd_rate(F.coalesce("currency", F.lit("USD"))))
    paid = paid.join(people.select("person_id").distinct().withColumn("known", F.lit(True)), "person_id", "left")
    twice = lambda df, keys, *check: _counted(repeated(df, keys), [(*check, F.lit(True))])
    return reduce(DataFrame.unionByName, [
        _counted(c, [
            ("Companies", "Currency without a rate", "Error", ~F.upper("currency").isin(list(USD_PER))),
            ("Companies", "No location at all", "Error", F.col("places").isNull()),
            ("Companies", "Only a local office", "Warning", F.col("seats") == 0),
            ("Financials", "No figures at all", "Error", F.col("rows").isNull()),
            ("Financials", "Out of date", "Warning", F.col("newest") < this_year - 2),
            ("Financials", "Quarters only", "Warning", F.col("rows").isNotNull() & F.col("newest").isNull()),
        ]),
        twice(companies, ["name"], "Companies", "Same name under two ids", "Warning"),
        _counted(locations, [
            ("Locations", "Missing city", "Warning", F.coalesce(F.trim("city"), F.lit("")) == ""),
            ("Locations", "Outside the world", "Error", ~(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180))),
        ]),
        _counted(periods, [
            ("Financials", "Negative revenue", "Warning", F.col("revenue") < 0),
            ("Financials", "Period in the future", "Error", F.col("fiscal_year") > this_year),
            ("Financials", "Quarter out of range", "Error", (F.col("period_type") == "Quarterly") & ~F.coalesce(F.col("fiscal_quarter"), F.lit(0)).between(1, 4)),
        ]),
        twice(periods, ["company_id", "period_type", "fiscal_year", "fiscal_quarter"], "Financials", "Duplicate period", "Error"),
        _counted(annual, [
            ("Financials", "Implausibly large revenue", "Warning", F.col("usd") > 8e11),
            ("Financials", "Profit far bigger than revenue", "Warning", large & (F.col("net_income") > 3 * F.col("revenue"))),
            ("Financials", "Revenue jumps tenfold", "Warning", jump),
            ("Financials", "Quarters don't add up", "Warning", large & off),
        ]),
        _counted(paid, [
            ("Pay", "Negative amount", "Error", F.col("total") < 0),
            ("Pay", "Year in the future", "Error", F.col("year") > this_year),
            ("Pay", "Person record missing", "Error", F.col("known").isNull()),
            ("Pay", "Impossibly large total", "Error", F.col("usd") > 3e9),
            ("Pay", "Very large total", "Warning", F.col("usd") > 1.5e8),
            ("Pay", "Tiny total", "Warning", (F.col("total") > 0) & (F.col("total") < 10_000)),
            ("Pay", "Name is no person's", "Warning", F.col("name").rlike(r"(?i)\d|\b(total|other|officers?|inc|corp)\b")),
        ]),
        twice(pay, ["company_id", "person_id", "year"], "Pay", "Same person, company and year twice", "Error"),
    ])


def examples(df: DataFrame, test: Column, shown: Column, most: int = 12) -> DataFrame:
    """The first rows that fail a check, as a report shows them. The limit is the report's length."""
    return df.filter(test).select(shown.alias("example")).distinct().orderBy("example").limit(most)


def tallies(companies: DataFrame, periods: DataFrame, pay: DataFrame) -> DataFrame:
    """(kind, value, n): companies by sector, currency, state and market, those with pay by state, by years of history and by
    newest year, periods by kind and year, rows of each table."""
    some = lambda df, kind, value: df.groupBy(value.cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    own = periods.groupBy("company_id").agg(F.count_if(F.col("period_type") == "Annual").alias("years"), F.max(F.when(F.col("period_type") == "Annual", F.col("fiscal_year"))).alias("newest"))
    y = F.col("years")
    span = F.when(y == 0, "0").when(y <= 2, "1-2").when(y <= 5, "3-5").when(y <= 9, "6-9").otherwise("10+")
    paid = companies.join(pay.select("company_id").distinct(), "company_id", "left_semi")
    rows = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit("rows").alias("kind"), F.lit(name).alias("value"), "n")
    return reduce(DataFrame.unionByName, [
        some(companies, "sector", F.col("sector")), some(companies, "currency", F.col("currency")), some(companies, "state", F.col("state")),
        some(companies, "market", F.regexp_extract("ticker", r"\.(\w+)$", 1)), some(paid, "paid", F.col("state")), some(own, "history", span), some(own, "newest", F.col("newest")),
        some(periods, "period", F.col("period_type")), some(periods, "year", F.col("fiscal_year")), rows(companies, "companies"), rows(periods, "periods"), rows(pay, "pay")])
