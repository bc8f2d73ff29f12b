"""Indicators of companies from their periods: trailing sums, growth, margins, trends, streaks, records and ranks.

Windows here run over the periods of one company, of which there are a few dozen; whole-table work is left to groupings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import growth, margin, trend, usd_rate, yearly_growth
from .ranking import log_bucket, percentiles, ranked

KEY = ["company_id", "period_type"]


def sort_key():
    return F.col("fiscal_year") * 10 + F.coalesce("fiscal_quarter", F.lit(0))


def indicators(periods: DataFrame, cagr_years: int = 5, history_years: int = 10) -> DataFrame:
    """One row for each company with periods: trailing revenue and net income, growth, yearly growth, margin, trend.

    The last four quarters count where there are four, else the latest year; growth compares with the four quarters (or the
    year) before them. Rows count, not calendar distance. One pass: number the rows from the newest, then aggregate.
    """
    newest = Window.partitionBy(*KEY).orderBy(sort_key().desc())
    df = periods.withColumn("n", F.row_number().over(newest))
    q, a = F.col("period_type") == "Quarterly", F.col("period_type") == "Annual"
    latest = F.max(F.when(a, F.col("fiscal_year"))).over(Window.partitionBy("company_id"))
    df = df.withColumn("latest", latest)
    of = lambda c, test: F.sum(F.when(test, F.col(c)))
    n = F.col("n")
    df = df.groupBy("company_id").agg(
        F.count_if(q).alias("quarters"), F.count_if(a).alias("years"),
        of("revenue", q & (n <= 4)).alias("q_revenue"), of("net_income", q & (n <= 4)).alias("q_net"), of("revenue", q & n.between(5, 8)).alias("q_prior"),
        of("revenue", a & (n == 1)).alias("a_revenue"), of("net_income", a & (n == 1)).alias("a_net"), of("revenue", a & (n == 2)).alias("a_prior"),
        of("revenue", a & (F.col("fiscal_year") == F.col("latest") - cagr_years)).alias("start"),
        F.count_if(a & (n <= history_years)).alias("history_years"),
    )
    whole = F.col("quarters") >= 4
    df = df.select(
        "company_id", "a_revenue", "start", "history_years",
        F.when(whole, F.col("q_revenue")).otherwise(F.col("a_revenue")).alias("ttm_revenue"),
        F.when(whole, F.col("q_net")).otherwise(F.col("a_net")).alias("ttm_net"),
        F.when(whole, F.when(F.col("quarters") >= 8, F.col("q_prior"))).otherwise(F.col("a_prior")).alias("prior"),
    )
    exact = F.when(F.col("prior") > 0, F.col("ttm_revenue").cast("double") / F.col("prior").cast("double") - 1)
    return df.select(
        "company_id", F.col("ttm_revenue").cast("double").alias("ttm_revenue"), F.col("ttm_net").cast("double").alias("ttm_net"),
        growth(F.col("ttm_revenue"), F.col("prior")).alias("growth"), yearly_growth(F.col("a_revenue"), F.col("start"), cagr_years).alias("cagr"),
        margin(F.col("ttm_net"), F.col("ttm_revenue")).alias("margin"), trend(exact, F.col("ttm_net")).alias("trend"), "history_years",
    )


def with_growth(periods: DataFrame) -> DataFrame:
    """Each period with its growth over the same quarter (or the year) a year before, by key and not by row."""
    before = periods.select(F.col("company_id").alias("c"), F.col("period_type").alias("p"), (F.col("fiscal_year") + 1).alias("y"),
                            F.col("fiscal_quarter").alias("q"), F.col("revenue").alias("before"))
    on = F.expr("company_id = c AND period_type = p AND fiscal_year = y AND fiscal_quarter <=> q")
    return periods.join(before, on, "left").withColumn("growth", growth(F.col("revenue"), F.col("before"))).drop("c", "p", "y", "q", "before")


def history(periods: DataFrame, years: int) -> DataFrame:
    """The periods of each company's last years, with their labels."""
    df = with_growth(periods).withColumn("newest", F.max("fiscal_year").over(Window.partitionBy("company_id")))
    label = F.when(F.col("fiscal_quarter").isNull(), F.concat(F.lit("FY "), "fiscal_year")).otherwise(F.concat(F.lit("Q"), "fiscal_quarter", F.lit(" "), "fiscal_year"))
    return df.filter(F.col("fiscal_year") > F.col("newest") - years).select(
        "company_id", "period_type", label.alias("label"), sort_key().alias("sort_key"), F.col("revenue").cast("double").alias("revenue"),
        F.col("net_income").cast("double").alias("net_income"), "growth")


def streaks(periods: DataFrame, least: int = 3) -> DataFrame:
    """(company_id, direction, length, unit): the run of growth, or decline, that the latest period ends.

    Missing and zero growth end a run. A company whose latest quarter has grown or shrunk is judged by quarters alone.
    """
    newest = Window.partitionBy(*KEY).orderBy(sort_key().desc())
    df = with_growth(periods).withColumn("sign", F.signum("growth")).withColumn("n", F.row_number().over(newest))
    df = df.withColumn("first", F.first("sign").over(newest))
    broken = F.min(F.when(F.coalesce(F.col("sign") != F.col("first"), F.lit(True)), F.col("n")))
    runs = df.groupBy(*KEY).agg(F.max(F.when(F.col("n") == 1, F.col("sign"))).alias("sign"), (F.coalesce(broken, F.count("*") + 1) - 1).alias("length"))
    runs = runs.filter("sign is not null and sign <> 0")
    runs = runs.withColumn("turn", F.row_number().over(Window.partitionBy("company_id").orderBy(F.desc("period_type"))))
    return runs.filter((F.col("turn") == 1) & (F.col("length") >= least)).select(
        "company_id", F.when(F.col("sign") > 0, "Up").otherwise("Down").alias("direction"), "length", F.col("period_type").alias("unit"))


def records(periods: DataFrame, years: int = 10, least: int = 3) -> DataFrame:
    """The best of each company's last years (the first of equals), whether it is the latest, and how many made a profit."""
    own = Window.partitionBy("company_id").orderBy(F.desc("fiscal_year"))
    df = periods.filter("period_type = 'Annual'").withColumn("n", F.row_number().over(own)).filter(F.col("n") <= years)
    best = F.max(F.struct("revenue", (-F.col("fiscal_year")).alias("earlier"))).alias("best")
    df = df.groupBy("company_id").agg(best, F.max("fiscal_year").alias("latest"), F.count_if(F.col("net_income") > 0).alias("profitable_years"),
                                      F.count("*").alias("years")).filter(F.col("years") >= least)
    year = -F.col("best.earlier")
    return df.select("company_id", year.alias("best_year"), F.col("best.revenue").cast("double").alias("best_revenue"),
                     (year == F.col("latest")).alias("is_latest"), "profitable_years", "years")


def in_dollars(companies: DataFrame, figures: DataFrame) -> DataFrame:
    """companies with their indicators and revenue_usd; those without periods are left out."""
    return companies.join(figures, "company_id").withColumn("revenue_usd", F.col("ttm_revenue") * usd_rate(F.col("currency")))


def ranks(stats: DataFrame, within: list[str], least: int = 3) -> DataFrame:
    """(company_id, within..., place, place_of): by revenue in dollars; groups of fewer than least have no ranks."""
    some = stats.filter("revenue_usd > 0").select("company_id", *within, "revenue_usd")
    df = ranked(some, within, [F.desc("revenue_usd"), F.col("company_id")], -log_bucket(F.col("revenue_usd")))
    return df.filter(F.col("place_of") >= least).select("company_id", *within, "place", "place_of")


def margin_against_sector(stats: DataFrame, least: int = 5) -> DataFrame:
    """Each company's margin and the median of its sector's."""
    some = stats.filter("ttm_revenue > 0 and margin is not null")
    medians = percentiles(some, ["sector"], "margin", {"median": 0.5}).filter(F.col("n") >= least)
    medians = medians.select("sector", F.bround("median", 4).alias("sector_margin"), F.col("n").alias("sector_companies"))
    return some.select("company_id", "sector", "margin").join(medians, "sector")


def per_head(stats: DataFrame) -> DataFrame:
    """Revenue for each employee and for each second of a year."""
    heads = F.when((F.col("employees") > 0) & (F.col("ttm_revenue") > 0), F.bround(F.col("ttm_revenue") / F.col("employees"), 0))
    return stats.select("company_id", heads.alias("per_employee"),
                        F.bround(F.greatest(F.lit(0.0), "ttm_revenue") / 31_557_600, 2).alias("per_second"))
