"""The star-schema tables read as a company directory: companies, places, periods, pay, filings and events.

Companies are customers, their periods are sums of orders, pay rows are line items by supplier and customer, filings are
line items by part and supplier. Attributes that the tables lack (coordinates, currencies, headcounts) follow from keys by
arithmetic, so that SQL can state the same. Every function returns a lazy DataFrame over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CURRENCIES = ("USD", "GBP", "EUR", "CAD", "SEK")
TITLES = ("Chief Executive Officer", "Chief Financial Officer", "Former Chief Operating Officer", "General Counsel", "Executive Director")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place_key, city, state, currency): at most a few dozen rows, as nations are."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("place_key"), F.col("n_name").alias("city"), F.col("r_name").alias("state"),
        _one_of(CURRENCIES, F.col("n_regionkey") % 5).alias("currency"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(places(spark, sf_dir), F.col("c_nationkey") == F.col("place_key"))
    key = F.col("c_custkey")
    return c.select(
        key.alias("company_id"), F.concat(F.lit("T"), key, F.when(key % 11 == 0, ".L").when(key % 13 == 0, ".KA").otherwise("")).alias("ticker"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"), "city", "state", "currency",
        F.when(key % 7 != 0, (key % 900 + 1) * 10).alias("employees"),
        (25 + (key * 37 % 2400).cast("double") / 100).alias("latitude"), (-120 + (key * 53 % 5000).cast("double") / 100).alias("longitude"),
    )


def locations(companies: DataFrame) -> DataFrame:
    """A headquarters for each company, and an office half a degree north of every third one's."""
    hq = F.struct(F.lit(0).alias("n"), F.lit("Headquarters").alias("type"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    office = F.struct(F.lit(1).alias("n"), F.lit("Office").alias("type"), (F.col("latitude") + 0.5).alias("lat"), (F.col("longitude") + 0.25).alias("lng"))
    both = F.when(F.col("company_id") % 3 == 0, F.array(hq, office)).otherwise(F.array(hq))
    df = companies.select("company_id", "city", "state", F.explode(both).alias("l"))
    return df.select((F.col("company_id") * 2 + F.col("l.n")).alias("location_id"), "company_id", F.col("l.type").alias("type"), "city", "state",
                     F.col("l.lat").alias("latitude"), F.col("l.lng").alias("longitude"))


def periods(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Quarterly and annual rows: revenue is the sum of orders, net income that of prices after a cost of four fifths.

    Line items are summed by order before they meet their orders, so the join moves one row for an order. only (company_id):
    the companies asked for; orders and items of others go before anything is summed.
    """
    price, off = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_discount").cast("decimal(4,2)")
    items = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("company_id"), F.year("o_orderdate").cast("long").alias("fiscal_year"),
        F.quarter("o_orderdate").cast("long").alias("fiscal_quarter"), F.col("o_totalprice").cast("decimal(18,2)").alias("revenue"))
    if only is not None:
        orders = orders.join(only.select("company_id").distinct(), "company_id", "left_semi")
        items = items.join(orders.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    net = items.groupBy("l_orderkey").agg(F.sum(price * (F.lit("0.20").cast("decimal(4,2)") - off)).alias("net"))
    joined = orders.join(net, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    quarters = joined.groupBy("company_id", "fiscal_year", "fiscal_quarter").agg(
        F.sum("revenue").alias("revenue"), F.coalesce(F.sum("net"), F.lit(0)).alias("net_income"))
    rows = quarters.withColumn("period", F.explode(F.array(F.lit("Quarterly"), F.lit("Annual"))))
    quarter = F.when(F.col("period") == "Quarterly", F.col("fiscal_quarter"))
    return rows.groupBy("company_id", F.col("period").alias("period_type"), "fiscal_year", quarter.alias("fiscal_quarter")).agg(
        F.sum("revenue").cast("decimal(28,2)").alias("revenue"), F.sum("net_income").cast("decimal(28,4)").alias("net_income"))


def pay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(person_id, name, title, company_id, year, total): one row for a person, a company and a year."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("company_id"), F.year("o_orderdate").cast("long").alias("year"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("part"))
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("l_suppkey").alias("person_id"), "company_id", "year").agg(F.sum("part").cast("decimal(28,2)").alias("total"))
    person = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"), _one_of(TITLES, F.col("s_suppkey") % 5).alias("title"))
    return rows.join(person, F.col("person_id") == F.col("s_suppkey")).select("person_id", "name", "title", "company_id", "year", "total")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company_id, title, city, state, salary) for each line item: its supplier, part name, supplier's place and price."""
    items = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.bround("l_extendedprice", 0).alias("salary"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"))
    seat = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(places(spark, sf_dir), F.col("s_nationkey") == F.col("place_key"))
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).join(seat, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("company_id"), "title", "city", "state", "salary")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, at, day, visitor, name, subject, label, place, device, browser, os, referrer, path) of each site event."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(
        "event_id", F.col("ts").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("user_id").alias("visitor"),
        F.col("event_type").alias("name"), k.alias("subject"), F.concat(F.lit("item "), k).alias("label"),
        (25 + (F.col("user_id") % 20).cast("double") / 4).alias("latitude"), (-100 + (F.col("user_id") % 15).cast("double") / 4).alias("longitude"),
        _one_of(("US", "UK", "FR"), F.col("user_id") % 3).alias("country"), _one_of(("Desktop", "Phone"), F.col("user_id") % 2).alias("device"),
        _one_of(("North", "South", "East", "West"), F.col("user_id") % 4).alias("region"), F.concat(F.lit("town "), F.col("user_id") % 30).alias("city"),
        _one_of(("Chrome", "Safari", "Firefox"), F.col("user_id") % 3).alias("browser"), _one_of(("Windows", "iOS", "Android", "Linux"), F.col("user_id") % 4).alias("os"),
        F.when(k % 3 == 0, F.concat(F.lit("site"), k % 12, F.lit(".example"))).alias("referrer"), F.concat(F.lit("/page/"), k % 40).alias("path"),
    )
