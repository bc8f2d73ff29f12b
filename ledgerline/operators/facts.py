"""Periods out of tagged facts: one value for each frame of time from several concepts, and quarters that complete a year.

facts: company_id, concept, currency, start, end (dates), value, frame ("CY2023" a year, "CY2023Q2" a quarter, or null), form,
filed (date), place (the order of facts). All steps group or join by company and frame or period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored

YEAR, QUARTER = r"^CY\d{4}$", r"^CY\d{4}Q[1-4]$"
#: How the forms of proxy statements begin.
PROXIES = ("DEF 14", "DEFA14", "PRE 14", "DEFM14")
BANK = "InterestAndDividendIncomeOperating + NoninterestIncome"


def reported(facts: DataFrame) -> DataFrame:
    """facts without those of proxy statements; the frame of one goes to the newest report of the same period, if any."""
    proxy = F.lit(False)
    for start in PROXIES:
        proxy = proxy | F.coalesce(F.col("form"), F.lit("")).startswith(start)
    key = ["company_id", "concept", "currency", "start", "end"]
    own = facts.filter(~proxy)
    newest = own.groupBy(*key).agg(F.max_by(F.struct("value", "form", "filed", "place"), F.struct("filed", (-F.col("place")).alias("p"))).alias("r"))
    framed = facts.filter(proxy & F.col("frame").isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in key], "frame", F.col("place").alias("_place"))
    on = F.lit(True)
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    moved = framed.join(newest, on).select(*key, "r.value", "frame", "r.form", "r.filed", F.col("_place").alias("place"))
    return own.select(*key, "value", "frame", "form", "filed", "place").unionByName(moved)


def reporting_currency(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """(company_id, currency): dollars if any of the concepts has them, else the most frequent currency of these."""
    counts = facts.filter(F.col("concept").isin(concepts) & F.col("currency").rlike("^[A-Z]{3}$")).groupBy("company_id", "currency").agg(
        F.count("*").alias("n"), F.min("place").alias("first"))
    order = F.struct((F.col("currency") == "USD").alias("usd"), "n", (-F.col("first")).alias("f"))
    return counts.groupBy("company_id").agg(F.max_by("currency", order).alias("currency"))


def _rank(concepts: list[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in concepts]), F.col("concept"))


def largest_by_frame(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """(company_id, frame, concept, start, end, value): the largest value of any of the concepts; of equals the first concept."""
    order = F.struct("value", (-_rank(concepts)).alias("c"), (-F.col("place")).alias("p"))
    some = facts.filter(F.col("concept").isin(concepts) & F.col("frame").isNotNull())
    best = some.groupBy("company_id", "frame").agg(F.max_by(F.struct("concept", "start", "end", "value"), order).alias("b"))
    return best.select("company_id", "frame", "b.*")


def first_by_frame(facts: DataFrame, concepts: list[str]) -> DataFrame:
    """(company_id, frame, concept, value): the value of the first concept that has one."""
    some = facts.filter(F.col("concept").isin(concepts) & F.col("frame").isNotNull())
    best = some.groupBy("company_id", "frame").agg(F.min_by(F.struct("concept", "value"), F.struct(_rank(concepts).alias("c"), F.col("place"))).alias("b"))
    return best.select("company_id", "frame", "b.*")


def summed_by_frame(facts: DataFrame, a: str, b: str, name: str, without: str) -> DataFrame:
    """Facts of a concept name that adds up a and b where a company has both, in frames that have no fact of without."""
    one = first_by_frame(facts, [b]).select("company_id", "frame", F.col("value").alias("more"))
    some = facts.filter((F.col("concept") == a) & F.col("frame").isNotNull())
    first = some.groupBy("company_id", "frame").agg(F.min_by(F.struct("currency", "start", "end", "value", "form", "filed", "place"), "place").alias("a"))
    own = facts.filter((F.col("concept") == without) & F.col("frame").isNotNull()).select("company_id", "frame").distinct()
    both = first.join(one, ["company_id", "frame"]).join(own, ["company_id", "frame"], "left_anti")
    value = (F.col("a.value") + F.col("more")).cast(facts.schema["value"].dataType)
    return both.select("company_id", F.lit(name).alias("concept"), "a.currency", "a.start", "a.end", value.alias("value"), "frame", "a.form", "a.filed", "a.place")


def fiscal_year(end: Column) -> Column:
    """A year that ends in January or February counts as the one before."""
    return F.year(end) - F.when(F.month(end) <= 2, 1).otherwise(0)


def quarters_within(start: Column, end: Column) -> Column:
    """The calendar quarters (year * 10 + quarter) that end within a period, twenty days either way."""
    months = F.sequence(F.trunc(start, "quarter"), F.date_add(end, 20), F.expr("interval 3 months"))
    ends = F.transform(months, lambda m: F.date_add(F.add_months(m, 3), -1))
    inside = F.filter(ends, lambda e: (e > F.date_add(start, 20)) & (e <= F.date_add(end, 20)))
    return F.transform(inside, lambda e: F.year(e) * 10 + F.quarter(e))


def merged(facts: DataFrame, revenue: list[str], net: list[str]) -> DataFrame:
    """(company_id, period_type, fiscal_year, fiscal_quarter, revenue, net_income, derived) in each company's currency.

    A frame's revenue is the largest of its concepts (a bank's also the sum of its two kinds of income), its net income that
    of the first concept. If three of a year's quarters are there, the fourth is the year less these, unless its revenue
    would be negative. A year that its four quarters miss by more than two percent was restated: they go.
    """
    clean = reported(facts)
    clean = clean.join(reporting_currency(facts, revenue).withColumnRenamed("currency", "main"), "company_id").filter("currency = main").drop("main")
    #: Read by each of the branches below, so worked out once.
    clean = stored(clean)
    bank = summed_by_frame(clean, *BANK.split(" + "), BANK, "RevenuesNetOfInterestExpense")
    top = largest_by_frame(clean.unionByName(bank), [*revenue, BANK])
    profit = first_by_frame(clean, net).select("company_id", "frame", F.col("value").alias("net_income"))
    both = top.join(profit, ["company_id", "frame"]).select("company_id", "frame", "start", "end", F.col("value").alias("revenue"), "net_income")
    both = stored(both)
    years = both.filter(F.col("frame").rlike(YEAR))
    code = (F.substring("frame", 3, 4).cast("int") * 10 + F.substring("frame", 8, 1).cast("int")).alias("code")
    quarters = both.filter(F.col("frame").rlike(QUARTER)).select("company_id", code, "revenue", "net_income")

    spans = years.filter("start is not null").withColumn("codes", quarters_within(F.col("start"), F.col("end"))).filter(F.size("codes") == 4)
    wide = spans.select("company_id", "frame", F.col("revenue").alias("y_revenue"), F.col("net_income").alias("y_net"), F.explode("codes").alias("code"))
    met = wide.join(quarters, ["company_id", "code"], "left")
    sums = met.groupBy("company_id", "frame", "y_revenue", "y_net").agg(
        F.count("revenue").alias("there"), F.sum("revenue").alias("q_revenue"), F.sum("net_income").alias("q_net"),
        F.max(F.when(F.col("revenue").isNull(), F.col("code"))).alias("missing"))
    kind = facts.schema["value"].dataType
    lone = sums.filter("there = 3 and y_revenue >= q_revenue")
    found = lone.select("company_id", F.col("missing").alias("code"), (F.col("y_revenue") - F.col("q_revenue")).cast(kind).alias("revenue"),
                        (F.col("y_net") - F.col("q_net")).cast(kind).alias("net_income"), F.lit(True).alias("derived"))
    found = found.groupBy("company_id", "code").agg(F.min("revenue").alias("revenue"), F.min_by("net_income", "revenue").alias("net_income"), F.max("derived").alias("derived"))
    #: A derived quarter fits its own year by construction, so only years with four quarters of their own can be off.
    off = sums.filter((F.col("there") == 4) & (F.abs(F.col("q_revenue") - F.col("y_revenue")) > F.abs("y_revenue") * 2 / 100))
    off = off.join(spans.select("company_id", "frame", F.explode("codes").alias("code")), ["company_id", "frame"]).select("company_id", "code").distinct()
    kept = quarters.withColumn("derived", F.lit(False)).unionByName(found).join(off, ["company_id", "code"], "left_anti")
    quarterly = kept.select("company_id", F.lit("Quarterly").alias("period_type"), F.floor(F.col("code") / 10).cast("int").alias("fiscal_year"),
                            (F.col("code") % 10).alias("fiscal_quarter"), "revenue", "net_income", "derived")
    last = F.max_by(F.struct("revenue", "net_income"), "frame").alias("v")
    annual = years.withColumn("fiscal_year", fiscal_year(F.col("end"))).groupBy("company_id", "fiscal_year").agg(last)
    annual = annual.select("company_id", F.lit("Annual").alias("period_type"), "fiscal_year", F.lit(None).cast("int").alias("fiscal_quarter"), "v.*", F.lit(False).alias("derived"))
    return annual.unionByName(quarterly)


def annual_by_duration(facts: DataFrame) -> DataFrame:
    """(company_id, concept, fiscal_year, value): facts over 340 to 380 days that end within ten days of their report's end
    (report_end), the newest filing's value for a year; years that end in the first week of January count as the one before."""
    days = F.datediff("end", "start")
    some = facts.filter(days.between(340, 380) & (F.abs(F.datediff("end", "report_end")) <= 10))
    year = F.year("end") - F.when((F.month("end") == 1) & (F.dayofmonth("end") <= 7), 1).otherwise(0)
    return some.groupBy("company_id", "concept", year.alias("fiscal_year")).agg(F.max_by("value", F.struct("filed", (-F.col("place")).alias("p"))).alias("value"))
