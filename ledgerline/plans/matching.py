"""Registered queries over names, addresses and annual reports, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, pages, statements, visitors
from ..sources import directory as d
from .catalogue import query
from .filings import FIRST, LAST
from .text import _pick, _sql_array, _text

SUFFIXES = ["com", "net", "org", "io", "co.uk", "com.au", "example.org"]


@query("q_registrable_domains", f"""
    SELECT page_id, host, CASE WHEN n > k THEN array_to_string(l[n - k:n], '.') END AS domain
    FROM (SELECT page_id, host, l, len(l) AS n, CASE WHEN ends_with(host, '.example.org') OR host = 'example.org' THEN 2
              WHEN list_contains({_sql_array(SUFFIXES)}, array_to_string(l[-2:], '.')) THEN 2 WHEN list_contains({_sql_array(SUFFIXES)}, l[-1]) THEN 1 END AS k
          FROM (SELECT page_id, host, string_split(host, '.') AS l FROM (SELECT page_id, lower(nullif(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '')) AS host FROM pages)))""")  # fmt: skip
def q_registrable_domains(s, sf):
    suffixes = s.createDataFrame([(x,) for x in SUFFIXES], "suffix string")
    return matching.registrable_domains(d.table(s, sf, "pages").select("page_id", "url"), suffixes).select("page_id", "host", "domain")


_HEADS = "SELECT source, regexp_extract_all(text, '[\\p{L}]+')[1:2] AS w FROM documents"


@query("q_canonical_names", """
    SELECT source, name, CASE WHEN is_full THEN name WHEN fits = 1 THEN one ELSE name END AS canonical
    FROM (SELECT n.source, n.name, n.is_full, count(DISTINCT f.name) AS fits, min(f.name) AS one FROM named n
          LEFT JOIN named f ON f.is_full AND n.source = f.source AND n.last = f.last AND (n.initial IS NULL OR n.initial = f.initial) GROUP BY ALL)""",
       extra=f""",
    heads AS ({_HEADS}),
    named AS (SELECT DISTINCT source, name, upper(last) AS last, initial, is_full FROM (
        SELECT source, w[1] || ' ' || w[2] AS name, w[2] AS last, upper(left(w[1], 1)) AS initial, length(w[1]) > 1 AS is_full FROM heads WHERE len(w) = 2
        UNION ALL SELECT source, left(w[1], 1) || '. ' || w[2], w[2], upper(left(w[1], 1)), false FROM heads WHERE len(w) = 2
        UNION ALL SELECT source, 'Ms ' || w[2], w[2], NULL, false FROM heads WHERE len(w) = 2))""")  # fmt: skip
def q_canonical_names(s, sf):
    w = F.slice(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0)), 1, 2)
    heads = d.table(s, sf, "documents").select("source", w.alias("w")).filter("size(w) = 2")
    a, b = F.get("w", F.lit(0)), F.get("w", F.lit(1))
    names = heads.select("source", F.explode(F.array(F.concat_ws(" ", a, b), F.concat(F.left(a, F.lit(1)), F.lit(". "), b), F.concat(F.lit("Ms "), b))).alias("name"))
    return matching.canonical_names(names, "source")


@query("q_insider_matches", f"""
    WITH k AS (SELECT c_custkey AS k FROM customer)
    SELECT k AS company_id, 1::BIGINT AS person_id, 10 * k + CASE WHEN k % 4 = 1 THEN 1 ELSE 0 END AS insider_id, 1 AS tier FROM k WHERE k % 4 IN (0, 1)
    UNION ALL SELECT k, 2, 10 * k + 2, 2 FROM k WHERE k % 4 <> 3
    UNION ALL SELECT k, 3, 10 * k, 2 FROM k WHERE k % 4 = 3""".replace("WITH k AS (SELECT c_custkey AS k FROM customer)\n", ""), extra=""",
    k AS (SELECT c_custkey AS k FROM customer)""")  # fmt: skip
def q_insider_matches(s, sf):
    k = F.col("c_custkey")
    c = d.table(s, sf, "customer")
    last = _pick(LAST, k)
    who = F.array(*[F.struct(F.lit(i).cast("long").alias("person_id"), _text(n, last).alias("name")) for i, n in ((1, "Robert T. "), (2, "Ann 'Annie' "), (3, "Xenia "))])
    people = c.select(k.alias("company_id"), F.explode(who).alias("p")).select("company_id", "p.*")
    first = F.when(k % 4 == 0, " Bob J").when(k % 4 == 3, " Xaver").otherwise(" Robert A")
    second = F.when(k % 4 == 0, " Zoe").when(k % 4 == 3, " Yves").otherwise(" Rob B")
    known = F.array(
        F.struct((10 * k).alias("insider_id"), _text(last, first).alias("name"), (k % 4 == 2).alias("is_officer")),
        F.struct((10 * k + 1).alias("insider_id"), _text(last, second).alias("name"), F.lit(True).alias("is_officer")),
        F.struct((10 * k + 2).alias("insider_id"), _text(F.when(k % 4 == 3, "Nobody").otherwise(last), " Annabel").alias("name"), F.lit(False).alias("is_officer")))
    insiders = c.select(k.alias("company_id"), F.explode(known).alias("i")).select("company_id", "i.*")
    return matching.insider_matches(people, insiders)


def _lines(s, sf, more):
    """The lines of each document as page 0, and more pages with lines worked out from its columns."""
    docs = d.table(s, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("n_chars").alias("c"))
    own = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda t: F.struct(F.lit(0).alias("page"), t.alias("text")))
    added = F.array(*[F.struct(F.lit(p).alias("page"), (t if not isinstance(t, str) else F.lit(t)).alias("text")) for p, t in more(F.col("id"), F.col("c"))])
    return docs.select("id", F.posexplode(F.concat(own, added)).alias("n", "l")).select("id", "n", "l.*")


@query("q_office_addresses", """
    SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Level ' || (n_chars % 40 + 1) || ', ' || (doc_id % 900) || ' Long Road' ELSE (doc_id % 900) || ' Long Road' END AS street,
           CASE WHEN n_nationkey % 2 = 0 THEN 'New ' ELSE '' END || n_name AS town, CAST(2000 + n_nationkey AS VARCHAR) AS code
    FROM documents JOIN nation ON n_nationkey = doc_id % 25 WHERE doc_id % 5 <> 4""")  # fmt: skip
def q_office_addresses(s, sf):
    nation = d.table(s, sf, "nation")
    name = lambda k: F.concat(F.when(k % 2 == 0, "New ").otherwise(""), F.lit("NATION_"), k.cast("string"))
    towns = nation.select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "New ").otherwise(""), "n_name").alias("town"), (2000 + F.col("n_nationkey")).cast("string").alias("code"))
    towns = towns.unionByName(nation.select(F.col("n_name").alias("town"), (2000 + F.col("n_nationkey")).cast("string").alias("code")))

    def more(i, c):
        place = _text(F.upper(name(i % 25)), F.when(i % 2 == 0, " NSW ").otherwise(", "), 2000 + i % 25)
        street = _text(i % 900, " Long Road")
        level = F.when(i % 3 == 0, _text("Level ", c % 40 + 1, ", ")).otherwise("")
        return [
            (1, "Auditor"), (1, "Ernst Partners, 1 Short Street, NATION_1 2001"),
            (1, F.when(i % 5 == 4, "Where we are").when(i % 5 == 0, "Registered office: care of accountants").otherwise(_text("Registered office   Share registry"))),
            (1, F.when(i % 5 == 0, "Telephone 12").otherwise(_text("Shareholder enquiries, ", level, street, "    Registry Ltd, 5 Other Road"))),
            (1, F.when(i % 5 == 0, _text("Principal place of business: ", level, street, ", ", place)).otherwise(place)),
            (1, "Website: www.example.com 2003"),
        ]

    return matching.office_addresses(_lines(s, sf, more), towns)


def _report_lines(s, sf):
    """Documents with a contents page, a statement in a unit of its own, and pages that look like one."""
    def more(i, c):
        y = 2015 + i % 8
        two = lambda a, b: F.when(i % 2 == 0, _text(a, "  ", b)).otherwise(_text(b, "  ", a))
        figure = lambda x: F.format_number(x, 0)
        net = F.when(i % 4 == 0, F.concat(F.lit("("), figure(c % 700 + 1), F.lit(")"))).otherwise(figure(c % 700 + 1))
        return [
            (1, "Contents"), (1, "Income statement 45"), (1, "Balance sheet 46"), (1, "Notes to the accounts 47"), (2, F.when(i % 3 == 0, "Amounts in $'000").when(i % 3 == 1, "In millions of dollars").otherwise("In dollars")),
            (3, "Statement of profit or loss"), (3, _text("Note  ", two(y, y - 1))), (3, _text("Revenue from customers 4  ", two(figure(1000 + c), figure(900 + c)))),
            (3, _text("Cost of sales  ", two("(70)", "(60)"))), (3, _text("Profit before income tax  ", two(figure(c), "55"))), (3, _text("Profit for the year  ", two(net, "50"))), (3, "Earnings per share"),
            (4, "Balance sheet"), (4, _text("Revenue received early 9  ", two("5", "6"))), (5, "Notes to the accounts"), (5, _text(y, " ", y - 1)), (5, _text("Revenue  ", two("1", "2")))]

    return _lines(s, sf, more)


@query("q_reported_years", """
    SELECT doc_id % 40 AS company_id, CAST(2015 + doc_id % 8 AS INTEGER) AS report_year, doc_id AS basis, CAST((1000 + n_chars) * u AS DOUBLE) AS revenue,
           CAST((CASE WHEN doc_id % 4 = 0 THEN -1 ELSE 1 END) * (n_chars % 700 + 1) * u AS DOUBLE) AS net_income, CAST((900 + n_chars) * u AS DOUBLE) AS prior_revenue, CAST(50 * u AS DOUBLE) AS prior_net
    FROM (SELECT doc_id, n_chars, CASE doc_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS u FROM documents)""")  # fmt: skip
def q_reported_years(s, sf):
    reports = d.table(s, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("company_id"), F.col("doc_id").alias("basis"))
    return statements.reported_years(_report_lines(s, sf), reports)


@query("q_years_of_reports", """
    SELECT company_id, year, max_by(revenue, report_year) AS revenue, max_by(net, report_year) AS net_income FROM (
        SELECT company_id, report_year, report_year AS year, CAST((1000 + n_chars) * u AS DOUBLE) AS revenue, CAST(CASE WHEN doc_id % 4 = 0 THEN -1 ELSE 1 END * (n_chars % 700 + 1) * u AS DOUBLE) AS net FROM r
        UNION ALL SELECT company_id, report_year, report_year - 1, CAST((900 + n_chars) * u AS DOUBLE), CAST(50 * u AS DOUBLE) FROM r) GROUP BY 1, 2""", extra=""",
    r AS (SELECT doc_id, n_chars, doc_id // 8 AS company_id, CAST(2015 + doc_id % 8 AS INTEGER) AS report_year, CASE doc_id % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1000000 ELSE 1 END AS u FROM documents)""")  # fmt: skip
def q_years_of_reports(s, sf):
    reports = d.table(s, sf, "documents").select(F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 8).alias("company_id"), F.lit("ifrs").alias("basis"))
    return pages.filled_years(statements.reported_years(_report_lines(s, sf), reports))


@query("q_directors_pay", f"""
    SELECT doc_id AS id, ({_sql_array(FIRST)})[doc_id % 7 + 1] || ' ' || ({_sql_array(LAST)})[doc_id % 2 * 7 + 1] AS name, CAST(2020 + doc_id % 4 - i AS INTEGER) AS year,
           CAST((400 + n_chars % 90 + i) * 1000 AS DOUBLE) AS salary, CAST((CASE WHEN i = 1 THEN 0 ELSE 30 END) * 1000 AS DOUBLE) AS bonus, CAST((20 + doc_id % 9) * 1000 AS DOUBLE) AS pension,
           CAST((420 + n_chars % 90 + i + CASE WHEN i = 1 THEN 0 ELSE 30 END + doc_id % 9) * 1000 AS DOUBLE) AS total, true AS adds_up
    FROM (SELECT doc_id, n_chars, unnest(range(2)) AS i FROM documents)""")  # fmt: skip
def q_directors_pay(s, sf):
    def more(i, c):
        v = {y: {"Salary": 400 + c % 90 + y, "Bonus": F.lit(0) if y else F.lit(30), "Pension": 20 + i % 9, "Total": 420 + c % 90 + y + (0 if y else 30) + i % 9} for y in (0, 1)}
        shown = lambda x: F.when(x == 0, "–").otherwise(F.format_number(x, 0))
        name = _text(_pick(FIRST, i), " ", _pick(LAST, i % 2 * 7))
        orders = [["Salary", "Bonus", "Pension", "Total"], ["Pension", "Salary", "Bonus", "Total"]]
        line = lambda order: _text(name, "  ", *[x for k in order for x in (shown(v[0][k]), "  ", shown(v[1][k]), "  ")])
        return [(1, "Single figure of pay (£'000)"), (1, F.when(i % 3 == 0, " ".join(orders[0])).otherwise("   ".join(orders[1]))), (1, _text(*[x for _ in range(4) for x in (2020 + i % 4, " ", 2019 + i % 4, " ")])),
                (1, F.when(i % 3 == 0, line(orders[0])).otherwise(line(orders[1]))), (1, "Executive directors"), (1, "All directors  1  2  3")]

    return statements.directors_pay(_lines(s, sf, more)).select("id", "name", "year", "salary", "bonus", "pension", "total", "adds_up")


@query("q_visit_steps", """
    SELECT day, visitor, epoch_us(min("at"))::BIGINT AS started, count(*) FILTER (nth <= 200) AS n_steps, string_agg(name || ':' || subject, ' ' ORDER BY "at", event_id) FILTER (nth <= 200) AS steps
    FROM (SELECT *, row_number() OVER (PARTITION BY day, visitor, visit ORDER BY "at", event_id) AS nth FROM (
          SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY day, visitor ORDER BY "at", event_id) AS visit FROM (
          SELECT *, epoch_us("at") - lag(epoch_us("at")) OVER (PARTITION BY day, visitor ORDER BY "at", event_id) AS gap FROM site)))
    GROUP BY day, visitor, visit""")  # fmt: skip
def q_visit_steps(s, sf):
    steps = visitors.visit_steps(d.events(s, sf))
    told = F.array_join(F.transform("steps", lambda x: F.concat(x["name"], F.lit(":"), x["subject"].cast("string"))), " ")
    return steps.select("day", "visitor", "started", F.size("steps").cast("long").alias("n_steps"), told.alias("steps"))
