"""Registered queries over filings, beside their SQL.

The test tables hold web pages, no filings. So each page is made a filing: its own text stays around what is put in, with
names, days and amounts worked out from the page's columns; SQL works out what must be read from it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filings, people
from ..sources import directory as d
from .catalogue import query
from .text import _pick, _sql_array, _text

FIRST = ["Ann", "Robert", "María", "Jean-Luc", "Olga", "William", "Zoë"]
LAST = ["Smith", "O'Neill", "van Dyke", "Nakamura", "Larsson", "McArthur", "Ibáñez", "Brown", "Okafor", "Petrov", "Weiss"]
OFFICES = ["Chief Financial Officer", "President and Chief Executive Officer", "General Counsel", "Executive Vice President, Sales", "Chief People Officer"]


def _pages(s, sf):
    """Pages with k (the id) and w, a number that grows with the page's text."""
    return d.table(s, sf, "pages").select(F.col("page_id").alias("k"), F.col("html"), (F.length("html") % 9000).cast("long").alias("w"))


_NAME_SQL = f"({_sql_array(FIRST)})[k % 7 + 1] || ' ' || chr(CAST(65 + k % 5 AS INTEGER)) || '. ' || ({_sql_array(LAST)})[k // 7 % 11 + 1]"
_PAGES_SQL = "SELECT page_id AS k, CAST(length(html) % 9000 AS BIGINT) AS w FROM pages"


def _name(k):
    return _text(_pick(FIRST, k), " ", F.chr((k % 5 + 65).cast("int")), ". ", _pick(LAST, F.floor(k / 7)))


def _money(x):
    return F.concat(F.lit("$"), F.format_number(x, 0))


@query("q_new_hires", f"""
    SELECT k AS page_id, name, CASE WHEN office LIKE '%, Sales' THEN 'Executive Vice President' ELSE office END AS title,
           CASE WHEN v IN (0, 3) THEN DATE '2025-01-01' + CAST(k % 300 AS INTEGER) END AS starts_on,
           CASE v WHEN 0 THEN 'salary+sign-on+stock+bonus' WHEN 1 THEN 'salary+options' WHEN 3 THEN 'salary+relocation' WHEN 4 THEN 'salary+stock+performance stock' END AS kinds,
           CAST(CASE v WHEN 0 THEN salary + 20000 + w + 1250000 + round(salary * (50 + k % 100) / 100.0) WHEN 1 THEN salary + 800000 + w
                       WHEN 3 THEN salary + 60000 WHEN 4 THEN salary + 600000 + 2 * w + 400000 END AS DOUBLE) AS total
    FROM f WHERE v IN (0, 1, 3, 4)""", extra=f""",
    p AS ({_PAGES_SQL}), f AS (SELECT *, {_NAME_SQL} AS name, ({_sql_array(OFFICES)})[k % 5 + 1] AS office, 300000 + 100 * w AS salary, k % 6 AS v FROM p)""")  # fmt: skip
def q_new_hires(s, sf):
    k, w = F.col("k"), F.col("w")
    name, office, last = _name(k), _pick(OFFICES, k), F.element_at(F.split(_pick(LAST, F.floor(k / 7)), " "), -1)
    salary, day = _money(300000 + 100 * w), F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (k % 300).cast("int")), "MMMM d, yyyy")
    said = [
        _text("On May 2, 2025, the Board appointed ", name, ", age 51, as ", office, ", effective ", day, ". Mr. ", last, " will receive an annual base salary of ", salary,
              " and a sign-on bonus of ", _money(20000 + w), ", which he must pay back if he leaves. He will also be granted restricted stock units with a value of $1.25 million. "
              "His target annual bonus is ", 50 + k % 100, "% of his base salary. The bonus may not exceed a maximum of $9,000,000."),
        _text("Jane Q. Leaver resigned on May 1, 2025. Ms. Leaver will receive a severance payment of $2,400,000 in cash. ", name, " was named to the position of ", office,
              ". Ms. ", last, "'s annual salary will be ", salary, ", with stock options valued at ", _money(800000 + w), ". She may be reimbursed legal fees of up to $15,000."),
        _text("The Board appointed ", name, " as interim ", office, ". Mr. ", last, " will be paid a salary of ", salary, "."),
        _text(name, " will join the Company as ", office, ", beginning ", day, ". Mr. ", last, " will be paid an annual base salary of ", salary, " (and a fee of $30,000 per month until then); "
              "(ii) a relocation allowance of $60,000. Each director receives a cash retainer of $95,000. In 2027, he will receive an annual equity award of $3,000,000."),
        _text("Upon the appointment of ", name, " to be our new ", office, ", Mr. ", last, " is entitled to a base salary of ", salary, ". He will receive a grant of equity of ",
              _money(1000000 + 2 * w), ", consisting of restricted stock units of ", _money(600000 + 2 * w), " and performance-based restricted stock of $400,000."),
        _text("Item 5.02 names nobody. A base salary of ", salary, " was approved."),
    ]
    text = F.get(F.array(*said), (k % 6).cast("int"))
    html = F.concat(F.col("html"), F.lit("<p>Item&nbsp;5.02 Departure of Directors.</p><div>"), text,
                    F.lit("</div><p><b>Item 9.01</b> Exhibits. A salary of $999,999 stands here.</p><p>SIGNATURES</p>"))
    filed = _pages(s, sf).select(k.alias("page_id"), html.alias("html"), F.lit("2025-05-03").cast("date").alias("filed"))
    hires = filings.new_hires(filed, "page_id")
    return hires.select("page_id", "name", "title", "starts_on", F.array_join(F.transform("parts", lambda p: p["kind"]), "+").alias("kinds"), "total")


_ORDERS = (["salary", "bonus", "stock", "options", "other", "total"], ["stock", "options", "salary", "bonus", "other", "total"], ["bonus", "salary", "other", "options", "stock", "total"])
_HEADS = {"salary": "Salary<br>($)", "bonus": "Bonus ($)(1)", "stock": "Stock Awards ($)", "options": "Option Awards", "other": "All Other Compensation ($)", "total": "Total ($)"}


@query("q_pay_tables", f"""
    SELECT k AS page_id, name, CASE WHEN title = 'Former Treasurer' OR k % 2 = 0 THEN title ELSE title || ' and Director' END AS title, CAST(2024 - i AS INTEGER) AS year,
           CAST(b + 500 AS DOUBLE) AS salary, CAST(CASE WHEN i = 1 THEN 0 ELSE 2000 + w END AS DOUBLE) AS bonus, CAST(7000 + k AS DOUBLE) AS stock, CAST(w AS DOUBLE) AS options,
           CAST(b + 500 + CASE WHEN i = 1 THEN 0 ELSE 2000 + w END + 7000 + k + w + 1234 AS DOUBLE) AS total, true AS adds_up
    FROM (SELECT *, 100000 + w * 10 + i * 1000 + CASE WHEN name = 'Olga B. Second' THEN 50000 ELSE 0 END AS b FROM y)""", extra=f""",
    p AS ({_PAGES_SQL}), f AS (SELECT *, {_NAME_SQL} AS name, ({_sql_array(OFFICES)})[k % 5 + 1] AS title FROM p),
    y AS (SELECT k, w, name, title, unnest(range(3)) AS i FROM f UNION ALL SELECT k, w, 'Olga B. Second', 'Former Treasurer', unnest(range(2)) FROM f)""")  # fmt: skip
def q_pay_tables(s, sf):
    k, w = F.col("k"), F.col("w")

    def row(i, order, named, second=False):
        base = 100000 + w * 10 + i * 1000 + (50000 if second else 0) + 500
        bonus = F.lit(0) if i == 1 else 2000 + w
        v = {"salary": base, "bonus": bonus, "stock": 7000 + k, "options": w, "other": F.lit(1234), "total": base + bonus + 7000 + k + w + 1234}
        cells = []
        for c in order:
            number = F.when(v[c] == 0, "—").otherwise(F.format_number(v[c], 0))
            cells += ["<td>$</td><td>", number, "</td><td>(2)</td>" if c == "other" else "</td><td></td>"]
        return _text("<tr>", named, f"<td>{2024 - i}</td>", *cells, "</tr>")

    tables = []
    for order in _ORDERS:
        head = "".join(f'<th colspan="3">{_HEADS[c]}</th>' for c in order)
        more = F.when(k % 2 == 0, "").otherwise("and Director")
        first = _text("<td>", F.regexp_replace(_name(k), " ", "  "), "<br>", _pick(OFFICES, k), "</td>")
        tables.append(_text(
            '<table><tr><td>Summary of pay</td></tr><tr><td>Name and</td></tr><tr><th>Principal Position</th><th>Year</th>', head, "</tr>",
            row(0, order, first), row(1, order, _text("<td>", more, "</td>")), row(2, order, "<td></td>"),
            row(0, order, "<td>Olga B. Second (3), Former Treasurer</td>", True), row(1, order, "<td></td>", True), "</table>"))
    table = F.get(F.array(*tables), (k % 3).cast("int"))
    other = "<table><tr><th>Name</th><th>Year</th><th>Fees</th></tr><tr><td>Ann Lee</td><td>2024</td><td>90,000</td></tr></table>"
    pages = _pages(s, sf).select(k.alias("page_id"), F.concat(F.lit(other), F.col("html"), table).alias("html"))
    rows = filings.pay_tables(pages, "page_id")
    return rows.select("page_id", "name", "title", "year", "salary", "bonus", "stock", "options", "total", "adds_up")


def _tagged_pages(s, sf):
    """Pages with three years of inline tags: a plain context, one of a person, one with two persons' names."""
    k, w = F.col("k"), F.col("w")
    parts = [F.col("html"), F.lit("<ix:header><ix:resources>")]
    end = [F.when(k % 3 == 0, f"{2023 - i}-01-31").otherwise(f"{2023 - i}-12-31") for i in range(3)]
    member = '<xbrli:segment><xbrldi:explicitMember dimension="ecd:IndividualAxis">co:P{}Member</xbrldi:explicitMember></xbrli:segment>'
    for i in range(3):
        for suffix, inner in (("", member.format(1) if i == 1 else ""), ("n", member.format(1)), ("m", member.format(2))):
            parts.append(_text(f'<xbrli:context id="c{i}{suffix}"><xbrli:entity><xbrli:identifier scheme="x">000{i}</xbrli:identifier>{inner}</xbrli:entity><xbrli:period>'
                               f"<xbrli:startDate>{2022 - i}-02-01</xbrli:startDate>\n<xbrli:endDate>", end[i], "</xbrli:endDate></xbrli:period></xbrli:context>"))  # fmt: skip
    parts.append(F.lit("</ix:resources></ix:header><table>"))
    for i in range(3):
        sign, scale = F.when(k % 4 == 0, ' sign="-"').otherwise("") if i == 1 else F.lit(""), F.when(k % 2 == 0, "3").otherwise("0")
        tag = _text(f'<ix:nonFraction contextRef="c{i}" name="ecd:PeoTotalCompAmt" unitRef="usd" format="ixt:num-dot-decimal" scale="', scale, '"', sign, ">", F.format_number(100 + w + i, 0), "</ix:nonFraction>")
        names = {0: [("c0n", F.concat(F.lit("Mr. <b>"), _name(k), F.lit("</b>")))], 1: [("c1n", F.lit("Second")), ("c1m", F.lit("Other"))], 2: [("c2n", F.lit("One")), ("c2m", F.lit("Two"))]}[i]
        called = [x for context, n in names for x in (F.lit(f'<ix:nonNumeric name="ecd:PeoName" contextRef="{context}">'), n, F.lit("</ix:nonNumeric>"))]
        parts += [F.lit("<tr><td>"), *called, tag, F.lit("</td><td>"), tag, F.lit("</td></tr>")]
    return _pages(s, sf).select(k.alias("page_id"), F.concat(*parts).alias("html"))


@query("q_performance_pay", f"""
    SELECT k AS page_id, CAST(2023 - i - CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS fiscal_year, CAST(CASE WHEN k % 3 = 0 THEN DATE '2023-01-31' ELSE DATE '2023-12-31' END - to_years(CAST(i AS INTEGER)) AS DATE) AS ends_on,
           CAST((CASE WHEN i = 1 AND k % 4 = 0 THEN -1 ELSE 1 END) * (100 + w + i) * (CASE WHEN k % 2 = 0 THEN 1000 ELSE 1 END) AS DOUBLE) AS total,
           CASE WHEN i = 2 THEN NULL WHEN i = 1 THEN 'Second' ELSE name END AS name
    FROM (SELECT *, unnest(range(3)) AS i FROM f)""", extra=f""",
    p AS ({_PAGES_SQL}), f AS (SELECT *, {_NAME_SQL} AS name FROM p)""")  # fmt: skip
def q_performance_pay(s, sf):
    return filings.performance_pay(_tagged_pages(s, sf), "page_id")


@query("q_filing_tags_check", f"""
    SELECT k AS tag_id, CASE k % 5 WHEN 2 THEN 'corrected' WHEN 3 THEN 'dropped' WHEN 4 THEN 'unmatched' ELSE 'verified' END AS outcome, CASE WHEN k % 5 IN (2, 3) THEN k END AS person_id,
           CASE WHEN k % 5 IN (2, 3) THEN CAST(2023 - CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS year, CASE WHEN k % 5 = 2 THEN CAST((100 + w) * CASE WHEN k % 2 = 0 THEN 1000 ELSE 1 END AS DOUBLE) END AS total
    FROM p""", extra=f""",
    p AS ({_PAGES_SQL})""")  # fmt: skip
def q_filing_tags_check(s, sf):
    tags = filings.performance_pay(_tagged_pages(s, sf), "page_id").filter("name <> 'Second'")
    tags = tags.select(F.col("page_id").alias("tag_id"), F.col("page_id").alias("company_id"), "name", "fiscal_year", F.year("ends_on").alias("period_end_year"), F.col("total").alias("tagged"))
    k, w = F.col("k"), F.col("w")
    stated = (100 + w) * F.when(k % 2 == 0, 1000).otherwise(1)
    share = F.when(k % 5 == 1, 0.001).when(k % 5 == 2, 0.8).when(k % 5 == 3, 1.2).when(k % 5 == 4, 3.0).otherwise(1.0)
    rows = _pages(s, sf).select(k.alias("company_id"), k.alias("person_id"), _name(k).alias("name"), (2023 - F.when(k % 3 == 0, 1).otherwise(0)).alias("year"), (stated * share).alias("total"), F.lit(0.0).alias("other"))
    return people.tagged_pay(rows, tags)
