"""Salaries by job title and place, from wage filings and from job ads."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import yearly_pay
from ..functions.text import employer_key, job_key
from ..sources.stored import stored
from .ranking import LISTED, SMALL, listed_percentile, percentiles, percentiles_at, percentiles_of_few

SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def by_title_and_place(filings: DataFrame, least: int = 3, titles: DataFrame | None = None, holding: str = "", small: int = SMALL) -> DataFrame:
    """(company_id, title, city, state, filings, low, p25, p50, p75, high): one row for a title at a company and one for
    each of its places (null for the whole company), wherever there are at least least filings. Whole amounts.

    titles (title): a table that holds all titles, if there is one smaller than filings. holding: a text whose words all stand in
    the titles asked for. Rows of a title at a company move once, and its places are sorted beside it; those of more than small rows
    are counted by bucket instead.
    """
    #: Titles repeat: their key is worked out once for each spelling.
    keys = (filings if titles is None else titles).select("title").distinct().withColumn("key", job_key(F.col("title"))).filter("key <> ''")
    keys = title_search(keys, holding, "key")
    rows = filings.join(keys, "title").select("company_id", "key", F.struct("city", "state").alias("place"), F.col("salary").cast("double").alias("salary"))
    #: Read twice or more below.
    rows, title = stored(rows.filter("salary is not null")), ["company_id", "key"]
    large = stored(rows.groupBy(*title).agg(F.count("*").alias("n")).filter(F.col("n") > small).drop("n"))
    group = [*title, "place"]
    both = lambda whole, place: F.explode(F.array(whole, place))
    whole_place = F.lit(None).cast("struct<city:string,state:string>")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in title])
    hidden = F.broadcast(large.select(*[F.col(c).alias(f"__{c}") for c in title]))

    at = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy("salary")) - 1
    of = lambda by: F.count("*").over(Window.partitionBy(*by))
    df = rows.join(hidden, same, "left_anti").repartition(*title)
    df = df.withColumn("i", at(title)).withColumn("n", of(title)).filter(F.col("n") >= least).withColumn("pi", at(group)).withColumn("pn", of(group))
    spot = lambda place, i, n: F.struct(place.alias("place"), F.col(i).alias("i"), F.col(n).alias("n"))
    df = df.select(*title, "salary", both(spot(whole_place, "i", "n"), spot(F.col("place"), "pi", "pn")).alias("e")).select(*title, "salary", "e.*")
    stats = percentiles_at(df.filter(F.col("n") >= least), group, "salary", "i", "n", SHARES)
    if not large.isEmpty():
        many = rows.join(hidden, same, "left_semi").withColumn("place", both(whole_place, F.col("place")))
        stats = stats.unionByName(percentiles(many, group, "salary", SHARES).filter(F.col("n") >= least))
    return stats.select("company_id", F.col("key").alias("title"), "place.city", "place.state", F.col("n").alias("filings"), "low",
                        *[F.bround(c, 0).alias(c) for c in SHARES], "high")


def spellings(filings: DataFrame) -> DataFrame:
    """(key, title): the most frequent spelling of each job key, the first by letters of equals."""
    counts = filings.groupBy("title").agg(F.count("*").alias("n")).withColumn("key", job_key(F.col("title"))).filter("key <> ''")
    return counts.groupBy("key").agg(F.min_by("title", F.struct(-F.col("n"), "title")).alias("title"), F.sum("n").alias("filings"))


def range_medians(rows: DataFrame, group: list[str], places: Column, small: int = LISTED) -> DataFrame:
    """(group, place, ads, low, p25, p50, p75, high) for each of the places (an array of each row's) of stored rows (group,
    pay_min, pay_max, what places reads): the medians of lower ends, middles and upper ends, whole amounts, the middle kept
    between the others; ads and low count the lower ends, high the upper ends. Null where there are none.

    Rows of a group move once, as they are: they are repeated for their places, and their values listed, only where they have met.
    Of groups of more than small rows only the values about the medians move.
    """
    ends = {"p25": F.col("pay_min"), "p50": (F.col("pay_min") + F.col("pay_max")) / 2, "p75": F.col("pay_max")}
    large = stored(rows.groupBy(*group).agg(F.count("*").alias("n")).filter(F.col("n") > small).drop("n"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group])
    hidden = F.broadcast(large.select(*[F.col(c).alias(f"__{c}") for c in group]))
    spread = lambda df: df.select(*group, F.explode(places).alias("place"), *[v.cast("double").alias(n) for n, v in ends.items()])

    lists = spread(rows.join(hidden, same, "left_anti").repartition(*group)).groupBy(*group, "place").agg(*[F.sort_array(F.collect_list(n)).alias(n) for n in ends])
    first, last = F.get("p25", F.lit(0)), F.get("p75", F.size("p75") - 1)
    df = lists.select(*group, "place", F.nullif(F.size("p25").cast("long"), F.lit(0).cast("long")).alias("ads"), first.alias("low"), *[listed_percentile(F.col(n), 0.5).alias(n) for n in ends], last.alias("high"))
    if not large.isEmpty():
        end = F.explode(F.array(*[F.struct(F.lit(n).alias("end"), F.col(n).alias("v")) for n in ends]))
        many = spread(rows.join(hidden, same, "left_semi")).select(*group, "place", end.alias("e")).select(*group, "place", "e.*")
        of = lambda n, c: F.max(F.when(F.col("end") == n, F.col(c))).alias(n if c == "median" else c)
        stats = percentiles_of_few(many, [*group, "place", "end"], "v", {"median": 0.5}).groupBy(*group, "place")
        df = df.unionByName(stats.agg(of("p25", "n").alias("ads"), of("p25", "low"), *[of(n, "median") for n in ends], of("p75", "high")))
    df = df.select(*group, "place", "ads", "low", *[F.bround(n, 0).alias(n) for n in ends], "high")
    return df.withColumn("p50", F.least(F.greatest("p50", "p25"), "p75"))


def ads(postings: DataFrame, titles: DataFrame | None = None, small: int = LISTED) -> DataFrame:
    """(company_id, title, city, ads, low, p25, p50, p75, high): medians of the lower ends, middles and upper ends of
    advertised ranges; the middle lies between the others. titles (title): a table that holds all titles, if there is one smaller
    than postings."""
    #: Titles repeat: their key is worked out once for each spelling, and Spark sees how large their table is.
    keys = stored((postings if titles is None else titles).select("title").distinct().withColumn("key", job_key(F.col("title"))).filter("key <> ''"))
    rows = stored(postings.join(keys, "title").filter("pay_min IS NOT NULL OR pay_max IS NOT NULL").select("company_id", "key", "city", "pay_min", "pay_max"))
    df = range_medians(rows, ["company_id", "key"], F.array(F.lit(None).cast("string"), F.col("city")), small).filter("ads IS NOT NULL AND high IS NOT NULL AND p50 IS NOT NULL")
    return df.select("company_id", F.col("key").alias("title"), F.col("place").alias("city"), "ads", "low", "p25", "p50", "p75", "high")


#: Words behind a company's name that say what part of it an employer is.
UNIT_WORDS = (
    "services", "service", "technologies", "technology", "associates", "stores", "usa", "us", "america", "north", "operations", "bank", "digital",
    "labs", "solutions", "international", "global", "com", "web", "development", "center", "enterprises", "software", "health", "healthcare",
    "financial", "securities", "research", "and", "of", "inc", "llc", "corp", "na", "n", "a", "americas", "manufacturing", "logistics",
    "fulfillment", "retail", "commercial", "capital", "management", "networks", "systems", "markets",
)


def matched_employers(employers: DataFrame, companies: DataFrame, aliases: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """employers (employer, maybe ein) with key, company_id and how: ein (its number in numbers: ein, company_id), alias, name (if
    one company has it), or subsidiary: the longest company name that the employer's name begins with.

    A name of one word counts as a beginning only if it has five letters and all words behind it are those of a unit.
    """
    e = employers.withColumn("key", employer_key(F.col("employer")))
    names = companies.withColumn("key", employer_key(F.col("name"))).filter(F.length("key") >= 3)
    unique = names.groupBy("key").agg(F.min("company_id").alias("by_name"), F.count_distinct("company_id").alias("n")).filter("n = 1").drop("n")
    named = aliases.groupBy(employer_key(F.col("alias")).alias("key")).agg(F.min("company_id").alias("by_alias"))
    #: Each beginning of an employer's name, by whole words, meets the names by equality: a common first word pairs nothing.
    words = F.split("key", " ")
    begun = F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda n: F.array_join(F.slice(words, F.lit(1), n), " ")))
    starts = e.select("key").distinct().filter(F.contains("key", F.lit(" "))).select("key", begun.alias("whole"))
    starts = starts.join(unique.select(F.col("key").alias("whole"), F.col("by_name").alias("by_start")), "whole")
    rest = F.split(F.substr("key", F.length("whole") + 2), " ")
    unit = F.forall(rest, lambda w: w.isin(*UNIT_WORDS)) & (F.length("whole") >= 5)
    starts = starts.filter(F.contains("whole", F.lit(" ")) | unit)
    starts = starts.groupBy("key").agg(F.max_by("by_start", F.length("whole")).alias("by_start"))
    df = e.join(named, "key", "left").join(unique, "key", "left").join(starts, "key", "left")
    by_number = F.lit(None).cast("long")
    if numbers is not None:
        digits = numbers.groupBy(F.regexp_replace("ein", r"\D", "").alias("__ein")).agg(F.min("company_id").alias("by_ein"))
        df = df.join(digits, F.regexp_replace("ein", r"\D", "") == F.col("__ein"), "left")
        by_number = F.when(F.length("__ein") == 9, F.col("by_ein"))
    tiers = {"ein": by_number, "alias": F.col("by_alias"), "name": F.col("by_name"), "subsidiary": F.col("by_start")}
    how = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in tiers.items()])
    return df.select("employer", "key", F.coalesce(*tiers.values()).alias("company_id"), how.alias("how"))


def eligible_filings(filings: DataFrame, least: float = 15_000, most: float = 3_000_000) -> DataFrame:
    """filings (case_number, status, full_time, employer, title, rate, unit) with salary and reason: null for those that count, else
    why not: repeated, not certified, part time, implausible pay, no title. Of rows of one case the first by all columns counts."""
    df = filings.withColumn("salary", yearly_pay(F.col("rate"), F.col("unit")))
    own = Window.partitionBy("case_number").orderBy(*[F.col(c) for c in filings.columns if c != "case_number"])
    df = df.withColumn("__n", F.row_number().over(own))
    reason = (
        F.when((F.coalesce("case_number", F.lit("")) == "") | (F.col("__n") > 1), "repeated").when(F.lower("status") != "certified", "not certified")
        .when(~F.coalesce(F.col("full_time").startswith("Y"), F.lit(False)), "part time").when(~F.coalesce(F.col("salary").between(least, most), F.lit(False)), "implausible pay")
        .when(F.coalesce(job_key(F.col("title")), F.lit("")) == "", "no title")
    )
    return df.withColumn("reason", reason).drop("__n")


def counters(matched: DataFrame, column: str) -> DataFrame:
    """(value, rows): how many rows were matched how, or left out why."""
    return matched.groupBy(F.coalesce(column, F.lit("none")).alias("value")).agg(F.count("*").alias("rows"))


def unmatched(matched: DataFrame, top: int = 150) -> DataFrame:
    """The employers without a company that have most rows. The limit is the report's length."""
    counts = matched.filter("company_id is null").groupBy("employer").agg(F.count("*").alias("rows"))
    return counts.orderBy(F.desc("rows"), "employer").limit(top)


def titles_with_places(salaries: DataFrame, places: int = 4) -> DataFrame:
    """(company_id, title, filings, places): the rows of whole companies, most filings first, each with its largest places as JSON."""
    own = Window.partitionBy("company_id", "title").orderBy(F.desc("filings"), "city")
    inner = salaries.filter("city is not null").withColumn("n", F.row_number().over(own)).filter(F.col("n") <= places)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "city", "filings"))), lambda p: F.struct(p["city"], p["filings"]))
    inner = inner.groupBy("company_id", "title").agg(F.to_json(listed).alias("places"))
    return salaries.filter("city is null").select("company_id", "title", "filings").join(inner, ["company_id", "title"], "left")


def title_search(salaries: DataFrame, text: str, title: str = "title") -> DataFrame:
    """Rows whose title holds every word of a text."""
    df = salaries
    for w in text.lower().split():
        df = df.filter(F.lower(title).contains(w))
    return df
