"""Lines of a document in order: cells by gaps, labels carried on, runs glued together, subjects tracked, totals confirmed.

Windows hold the lines of one document, which is read as one text anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cells_by_gap(words: DataFrame, id: str = "id") -> DataFrame:
    """(id, line, cell, text): words (id, left, right, bottom, height, text) of a page as lines by their height on it, and as
    cells where the gap to the word before is wider than 1.2 times the letters."""
    df = words.withColumn("line", F.bround(F.col("bottom") / 2.5, 0).cast("long"))
    own = Window.partitionBy(id, "line").orderBy("left", "right")
    gap = F.col("left") - F.lag("right").over(own)
    df = df.withColumn("cell", F.sum(F.coalesce((gap > F.col("height") * 1.2).cast("int"), F.lit(0))).over(own))
    parts = F.array_sort(F.collect_list(F.struct("left", "text")))
    return df.groupBy(id, "line", "cell").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def carried_labels(lines: DataFrame, id: str = "id") -> DataFrame:
    """lines (id, n, label or null, numeric) with shown: the last label since the last numeric line, for those without one."""
    own = Window.partitionBy(id).orderBy("n")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    df = lines.withColumn("__run", F.coalesce(F.sum(F.col("numeric").cast("int")).over(before), F.lit(0)))
    held = F.last("label", ignorenulls=True).over(Window.partitionBy(id, "__run").orderBy("n"))
    return df.withColumn("shown", F.coalesce("label", held)).drop("__run")


def glued(lines: DataFrame, id: str = "id") -> DataFrame:
    """(id, n, text): numeric lines joined to the text line before them."""
    own = Window.partitionBy(id).orderBy("n")
    df = lines.withColumn("__g", F.sum((~F.col("numeric")).cast("int")).over(own))
    parts = F.array_sort(F.collect_list(F.struct("n", "text")))
    return df.groupBy(id, "__g").agg(F.min("n").alias("n"), F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")).drop("__g")


def subjects(sentences: DataFrame, id: str = "id") -> DataFrame:
    """sentences (id, n, person or null, ends) with subject: the person named last, none after a sentence that ends."""
    own = Window.partitionBy(id).orderBy("n")
    df = sentences.withColumn("__run", F.coalesce(F.sum(F.col("ends").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.withColumn("subject", F.last("person", ignorenulls=True).over(Window.partitionBy(id, "__run").orderBy("n"))).drop("__run")


def confirmed_totals(items: Column) -> Column:
    """An array of structs (amount, total) in order, with ok: whether a total is the sum of the items since the last one that
    was, within a thousandth; null for items."""
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<struct<amount:double,total:boolean,ok:boolean>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        fits = F.abs(state["sum"] - x["amount"]) <= F.abs(x["amount"]) * 0.001
        ok = F.when(x["total"], fits)
        left = F.when(~x["total"], state["sum"] + x["amount"]).when(fits, F.lit(0.0)).otherwise(state["sum"])
        row = F.struct(x["amount"].alias("amount"), x["total"].alias("total"), ok.alias("ok"))
        return F.struct(left.alias("sum"), F.concat(state["out"], F.array(row)).alias("out"))

    return F.aggregate(items, start, step, lambda s: s["out"])


def filled_years(reports: DataFrame) -> DataFrame:
    """(company_id, year, revenue, net_income): each year from the newest report (company_id, report_year, basis, revenue,
    net_income, prior_revenue, prior_net) that states it as its own, else as the year before; only revenues above zero, and
    only on the basis of the company's newest report."""
    newest = reports.groupBy("company_id").agg(F.max_by("basis", "report_year").alias("main"))
    some = reports.join(newest, "company_id").filter(F.col("basis").eqNullSafe(F.col("main")))
    years = F.explode(F.array(
        F.struct(F.col("report_year").alias("year"), F.lit(0).alias("prior"), "revenue", "net_income"),
        F.struct((F.col("report_year") - 1).alias("year"), F.lit(1).alias("prior"), F.col("prior_revenue").alias("revenue"), F.col("prior_net").alias("net_income"))))
    rows = some.select("company_id", "report_year", years.alias("y")).select("company_id", "report_year", "y.*").filter("revenue > 0")
    order = F.struct((-F.col("report_year")).alias("r"), "prior")
    return rows.groupBy("company_id", "year").agg(F.min_by(F.struct("revenue", "net_income"), order).alias("b")).select("company_id", "year", "b.*")
