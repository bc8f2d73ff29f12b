"""Annual reports as lines of text: the statement among the pages, its columns' years and unit, directors' pay by alignment.

lines: id, page, n (a line's number in the document) and text. Everything happens by the document's id: pages are scored and
one is kept, lines are numbered and carried along within it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .markup import column_years, statement_unit

#: Anchors of an income statement and what each is worth; what makes a page another one.
ANCHORS = (
    (4, r"(?i)\b(?:statement of (?:profit (?:or|and) loss|comprehensive income)|income statement|profit and loss account)\b"), (2, r"(?i)^\s*(?:total )?(?:revenue|turnover|sales)\b"),
    (2, r"(?i)\bprofit (?:before|after) (?:income )?tax|profit for the (?:financial )?year"), (1, r"(?i)\bcost of (?:sales|goods)|gross profit|finance costs?|earnings per share"),
    (-5, r"(?i)\bnotes to the|contents\b|statement of (?:financial position|cash flows|changes in equity)|balance sheet"),
)
REVENUE = r"(?i)^(?:total |net )?(?:revenue|turnover|sales)s?(?: from .*|, net| - net)?$"
PROFIT = r"(?i)^(?:net )?(?:profit|\(?loss\)?|profit\s?/\s?\(loss\)).{0,12} (?:after (?:income )?tax(?:ation)?|for the (?:financial )?(?:year|period))\b"
LEAST_SCORE = 6


#: Longer lines are prose.
LONGEST_ROW = 300
_FIGURE = r"(?:\(?-?\d[\d,]*(?:\.\d+)?\)?|[-–—])"


def row_of(line: Column, count: Column) -> Column:
    """struct(label, amounts) of a line that ends with so many figures, or with one more, of which the first is the number of
    a note; else null. Brackets are negative, a dash is null."""
    row = F.when(F.length(line) <= LONGEST_ROW, line)
    ends = F.regexp_extract(row, rf"((?:\s+{_FIGURE})+)\s*$", 1)
    found = F.filter(F.split(ends, r"\s+"), lambda x: x != "")
    noted = (F.size(found) == count + 1) & F.get(found, F.lit(0)).rlike(r"^\d{1,2}(?:\.\d)?$")
    kept = F.when(F.size(found) == count, found).when(noted, F.slice(found, F.lit(2), count))
    number = lambda x: F.regexp_replace(x, r"[(),]", "").try_cast("double") * F.when(x.startswith("("), -1).otherwise(1)
    label = F.trim(F.left(row, F.length(row) - F.length(F.regexp_extract(row, rf"(?:\s+{_FIGURE})+\s*$", 0))))
    return F.when((label != "") & kept.isNotNull(), F.struct(label.alias("label"), F.transform(kept, number).alias("amounts")))


def statement_page(lines: DataFrame) -> DataFrame:
    """(id, page): the page that is most an income statement: each anchor counts once, the first of equal pages wins; none
    under LEAST_SCORE."""
    points = [F.max(F.when(F.col("text").rlike(p), points).otherwise(0)) if points > 0 else F.min(F.when(F.col("text").rlike(p), points).otherwise(0)) for points, p in ANCHORS]
    scores = lines.groupBy("id", "page").agg(reduce(Column.__add__, points).alias("score")).filter(F.col("score") >= LEAST_SCORE)
    return scores.groupBy("id").agg(F.min_by("page", F.struct(-F.col("score"), "page")).alias("page"))


def statement_rows(lines: DataFrame) -> DataFrame:
    """(id, n, label, year, amount): the figures of each document's income statement in single units of its currency.

    The years are those of the first line of the page that has two neighbours; the unit is the last one stated before the
    first row of figures, on the page or on the pages before it. A line with as many figures as there are years is a row, the
    first figure belongs to the first year that the header names. Documents without such a page or header give no rows.
    """
    numbered = lines.select("id", "page", "n", F.coalesce("text", F.lit("")).alias("text"))
    page = statement_page(numbered).withColumnRenamed("page", "at")
    near = numbered.join(page, "id").filter(F.col("page") <= F.col("at"))
    head = near.filter("page = at").withColumn("y", column_years(F.col("text"))).filter("y IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("n", "y"), "n").alias("h"))
    head = head.select("id", F.col("h.n").alias("head"), F.col("h.y.year").alias("newest"), F.col("h.y.newest_first").alias("newest_first"))
    own = near.join(head, "id")
    rows = own.filter("page = at AND n > head").withColumn("r", row_of(F.col("text"), F.lit(2))).filter("r IS NOT NULL")
    first = rows.groupBy("id").agg(F.min("n").alias("first"))
    unit = own.join(first, "id").filter("n < first").withColumn("u", statement_unit(F.col("text"))).filter("u IS NOT NULL").groupBy("id").agg(F.max_by("u.scale", "n").alias("scale"))
    both = rows.join(unit, "id", "left").select("id", "n", F.col("r.label").alias("label"), "newest", "newest_first", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.posexplode("r.amounts").alias("i", "a"))
    year = F.when(F.col("newest_first"), F.col("newest") - F.col("i")).otherwise(F.col("newest") - 1 + F.col("i"))
    return both.filter("a IS NOT NULL").select("id", "n", "label", year.alias("year"), (F.col("a") * F.col("scale")).alias("amount"))


def reported_years(lines: DataFrame, reports: DataFrame) -> DataFrame:
    """(company_id, report_year, basis, revenue, net_income, prior_revenue, prior_net) of reports (id, company_id, basis), as
    filled_years takes them: each report has its own unit. Of several lines that are a revenue or a profit the first counts."""
    rows = statement_rows(lines)
    kind = F.when(F.col("label").rlike(REVENUE), "revenue").when(F.col("label").rlike(PROFIT), "net_income")
    some = rows.withColumn("kind", kind).filter("kind IS NOT NULL").groupBy("id", "kind", "year").agg(F.min_by("amount", "n").alias("amount"))
    newest = some.groupBy("id").agg(F.max("year").alias("report_year"))
    pick = lambda kind, back: F.max(F.when((F.col("kind") == kind) & (F.col("year") == F.col("report_year") - back), F.col("amount")))
    sums = some.join(newest, "id").groupBy("id", "report_year").agg(
        pick("revenue", 0).alias("revenue"), pick("net_income", 0).alias("net_income"), pick("revenue", 1).alias("prior_revenue"), pick("net_income", 1).alias("prior_net"))
    return sums.join(reports.select("id", "company_id", "basis"), "id").drop("id")


#: Kinds of directors' pay by the words over their column, in no order.
PAY_KINDS = {"salary": r"salary|fees?", "benefits": r"benefits?", "bonus": r"bonus", "share_awards": r"ltip|share awards?", "pension": r"pension", "total": r"total"}
_NAME = r"^(?:(?:Mr|Mrs|Ms|Dr|Sir|Dame)\.? )?\p{Lu}[\p{L}.'’-]*(?: \p{Lu}[\p{L}.'’-]*){1,4}$"


def directors_pay(lines: DataFrame) -> DataFrame:
    """(id, n, name, year, salary, benefits, bonus, share_awards, pension, total, adds_up): directors' pay in tables without
    markup, in single units.

    The header is a line with the words for three kinds or more, a total among them; the years are those of the nearest line
    with two, in the header or behind it; the unit is the last one stated. The lines below, up to the next header, are a
    name and figures. With two figures for each kind the years alternate within each kind; with one, the first year is
    meant. A dash is nothing. A row adds up if its total is its other figures within two units. Lines that are no name, or have
    another number of figures, go.
    """
    df = lines.select("id", "n", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    places = [F.struct(F.regexp_instr("text", F.lit(rf"(?i)\b(?:{p})\b")).alias("at"), F.lit(k).alias("kind")) for k, p in PAY_KINDS.items()]
    kinds = F.transform(F.array_sort(F.filter(F.array(*places), lambda x: x["at"] > 0)), lambda x: x["kind"])
    df = df.withColumn("kinds", kinds).withColumn("is_head", (F.size("kinds") >= 3) & F.array_contains("kinds", "total") & ~F.col("text").rlike(r"\d{3},\d{3}"))
    own = Window.partitionBy("id").orderBy("n")
    df = df.withColumn("unit", F.last(statement_unit(F.col("text"))["scale"], ignorenulls=True).over(own))
    df = df.withColumn("table", F.sum(F.col("is_head").cast("int")).over(own)).filter("table > 0")
    inside = Window.partitionBy("id", "table").orderBy("n")
    held = lambda c: F.last(c, ignorenulls=True).over(inside)
    df = df.withColumn("heads", held(F.when(F.col("is_head"), F.col("kinds")))).withColumn("years", held(column_years(F.col("text"))))
    n = F.size("heads")
    two, one = row_of(F.col("text"), 2 * n), row_of(F.col("text"), n)
    rows = df.filter("NOT is_head AND years IS NOT NULL").withColumn("per", F.when(two.isNotNull(), 2).otherwise(1)).withColumn("r", F.coalesce(two, one))
    rows = rows.filter(F.col("r.label").rlike(_NAME))
    year = lambda i: F.when(F.col("years.newest_first"), F.col("years.year") - i).otherwise(F.col("years.year") - 1 + i)
    each = rows.select("id", "n", F.col("r.label").alias("name"), "heads", "per", "unit", F.col("r.amounts").alias("amounts"), "years",
                       F.explode(F.sequence(F.lit(0), F.col("per") - 1)).alias("i"))
    at = lambda kind: F.array_position("heads", F.lit(kind)).cast("int") - 1
    scale = F.coalesce("unit", F.lit(1.0))
    figure = lambda kind: F.coalesce(F.get("amounts", at(kind) * F.col("per") + F.col("i")), F.lit(0.0)) * F.when(at(kind) >= 0, scale)
    paid = each.select("id", "n", "name", year(F.col("i")).alias("year"), scale.alias("scale"), *[F.coalesce(figure(k), F.lit(0.0)).alias(k) for k in PAY_KINDS])
    rest = reduce(Column.__add__, [F.col(k) for k in PAY_KINDS if k != "total"])
    return paid.filter("total > 0").withColumn("adds_up", F.abs(rest - F.col("total")) <= 2 * F.col("scale")).drop("scale")
