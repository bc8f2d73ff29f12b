import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import filings

HIRES = "id long, html string, filed date"


def hired(spark, *texts, filed=date(2025, 5, 3)):
    rows = [(i, f"<p>Item 5.02. Changes</p><p>{t}</p><p>Item 8.01 Other</p>", filed) for i, t in enumerate(texts)]
    out = {}
    for r in filings.new_hires(spark.createDataFrame(rows, HIRES)).collect():
        out.setdefault(r["id"], {})[r["name"]] = (r["title"], r["starts_on"], [(p["kind"], p["amount"], p["note"]) for p in r["parts"]], r["total"])
    return [out.get(i, {}) for i in range(len(texts))]


def test_two_hires_keep_their_own_terms_and_pronouns_go_on(spark):
    (got,) = hired(spark, "The Company appointed Ana B. Ruiz as Chief Financial Officer, effective June 1, 2025, and the Board named Tom Ode, Jr. to be its new General Counsel. "
                   "Ms. Ruiz will receive a base salary of $410,000. She will also receive a signing bonus of $75,000. Mr. Ode's annual salary is $380,000. "
                   "He will be granted options to purchase shares valued at $1.5 million. Ms. Ruiz and Mr. Ode will each receive a bonus of $20,000.")  # fmt: skip
    assert got["Ana B. Ruiz"][2] == [("salary", 410_000, ""), ("sign-on", 75_000, "")] and got["Ana B. Ruiz"][0] == "Chief Financial Officer"
    assert got["Tom Ode, Jr."][2] == [("salary", 380_000, ""), ("options", 1_500_000, "")] and got["Tom Ode, Jr."][3] == 1_880_000


@pytest.mark.parametrize("said, kinds", [
    ("an annual bonus of up to $300,000", []), ("severance of $900,000 upon termination", []), ("a fee of $40,000 per month", []), ("a monthly stipend of $12,000", []),
    ("options with an exercise price of $25,000", []), ("a sign-on bonus of $9,999", []), ("a one-time cash payment of $50,000", ["sign-on"]), ("a $60,000 housing allowance", ["relocation"]),
    ("PSUs with a target value of $700,000", ["performance stock"]), ("an annual target bonus of $250,000", []), ("a bonus of $250,000 in cash", ["bonus"]),
    ("(i) a bonus of $40,000; (ii) RSUs of $90,000", ["bonus", "stock"]), ("stock options of $300 million", []), ("a stock award of $30,000,000", [])])
def test_only_what_is_a_package_counts(spark, said, kinds):
    (got,) = hired(spark, f"Ana Ruiz was appointed as President. Ms. Ruiz will receive a base salary of $500,000. She will receive {said}.")
    assert [p[0] for p in got["Ana Ruiz"][2]] == ["salary", *kinds]


def test_shares_of_salary_misread_salaries_and_other_items(spark):
    got = hired(spark,
        "Ana Ruiz was elected to the position of Treasurer. Her base salary is $200,000, with a target bonus of 45% of her base salary.",
        "Ana Ruiz was elected as Treasurer. Her base salary is $200,000. A bonus of 50% to 75% of base salary is the target.",
        "Ana Ruiz was elected as Treasurer. Her base salary is $20,000.",
        "The Board met. Ana Ruiz, age 50, is our treasurer with a salary of $200,000.",
        "Ana Ruiz was appointed as acting President with a salary of $200,000.",
        "Each director receives $90,000.")
    assert got[0]["Ana Ruiz"][2] == [("salary", 200_000, ""), ("bonus", 90_000, "45% of salary")]
    assert [p[0] for p in got[1]["Ana Ruiz"][2]] == ["salary"]
    assert got[2:] == [{}, {}, {}, {}]


def test_filings_without_text_or_item_give_no_rows(spark):
    rows = [(1, None, None), (2, "", None), (3, "<p>Item 5.03 Ana Ruiz was appointed as President with a salary of $300,000</p>", None), (4, "Item 5.02" + " x" * 300_000, None)]
    df = spark.createDataFrame(rows, HIRES).withColumn("name", F.lit("clash")).withColumn("s", F.lit(1))
    assert filings.new_hires(df).count() == 0 and filings.new_hires(df.filter("false")).count() == 0


def test_sentences_of_many_amounts_are_read_once_and_days_that_are_none_are_no_start(spark):
    many = ", ".join(f"a bonus of ${(i + 20) * 1000:,}.25 for year {i}" for i in range(60))
    began = time.time()
    (got,) = hired(spark, f"Ana Ruiz was appointed as President, effective June 31, 2025. Ms. Ruiz will receive a base salary of $500,000. Ms. Ruiz's terms are {many}.")
    assert got["Ana Ruiz"][1] is None and [p[0] for p in got["Ana Ruiz"][2]] == ["salary"] + ["bonus"] * 60 and time.time() - began < 40


def test_a_sentence_is_about_whom_it_names_without_rows_of_words(spark):
    said = ["Ms. Ruiz’s salary and that of Ode.", "He is paid.", "Ruiz's bonus", "Mr. Stone left.", "She stays.", "each director is paid", "She goes on."]
    lines = spark.createDataFrame([(i, n, s) for i in (1, 2) for n, s in enumerate(said)], "id long, n int, s string")
    df = filings.in_focus(lines, spark.createDataFrame([(1, "Ruiz"), (1, "Ode")], "id long, surname string"))
    got = {(r["id"], r["n"]): r["surname"] for r in df.collect()}
    assert [got[1, n] for n in range(7)] == [None, None, "Ruiz", None, None, None, None] and {got[2, n] for n in range(7)} == {None}
    #: One Generate for the names with an honour, none for words.
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


KINDS = {"salary": "Salary ($)", "bonus": "Bonus", "stock": "Stock<br/>Awards", "options": "Option Awards(2)", "incentive": "Non-Equity Incentive Plan Compensation",
         "pension": "Change in Pension Value", "other": "All Other"}


def table(r):
    """A random table of pay and its rows."""
    kinds = ["salary", *r.sample([k for k in KINDS if k != "salary"], r.randint(1, 6))]
    r.shuffle(kinds)
    cells = r.choice([1, 3])
    out, want = [], []
    top = f"<tr><td></td><td></td>{''.join(f'<td colspan={cells}>Annual</td>' for _ in kinds)}<td colspan={cells}></td></tr>" if r.random() < 0.5 else ""
    head = f"<tr><th>Name and Principal Position</th><th>Year</th>{''.join(f'<th colspan={cells}>{KINDS[k]}</th>' for k in kinds)}<th colspan={cells}>Total ($)</th></tr>"
    for name, title in r.sample([("Ana B. Ruiz", "Chief Executive Officer"), ("Tom Ode, Jr.", "Senior Vice President"), ("Li Wei", "Former Treasurer")], r.randint(1, 3)):
        tall = r.random() < 0.5
        years = list(range(2024, 2024 - r.randint(1, 3), -1))
        for i, y in enumerate(years):
            pay = {k: r.choice([0, r.randint(1, 999), r.randint(100_000, 9_000_000)]) for k in kinds} | {"salary": r.randint(200_000, 900_000)}
            total = sum(pay.values())
            named = (f"<td rowspan={len(years)}>{name}{r.choice(['<br>', ', '])}{title}</td>" if tall else f"<td>{name} (1)<br>{title}</td>") if i == 0 else ("" if tall else "<td></td>")
            figure = lambda v: (f"<td>$</td><td>{v:,}</td><td>(3)</td>" if cells == 3 else f"<td>{v:,}</td>") if v else ("<td></td><td>—</td><td></td>" if cells == 3 else "<td>-</td>")
            out.append(f"<tr>{named}<td>{y}</td>{''.join(figure(pay[k]) for k in kinds)}{figure(total)}</tr>")
            want.append((name, title, y, *[float(pay.get(k, 0)) for k in filings.AMOUNTS[:-1]], float(total), True))
    return f"<table>{top}{head}{''.join(out)}</table>", want


def test_tables_of_pay_with_shuffled_columns(spark):
    r = random.Random(3)
    made = [table(r) for _ in range(60)]
    got = {}
    for x in filings.pay_tables(spark.createDataFrame([(i, f"<p>text</p>{t}<table><tr><td>Salary</td></tr></table>") for i, (t, _) in enumerate(made)], "id long, html string")).collect():
        got.setdefault(x["id"], []).append((x["name"], x["title"], x["year"], *[x[a] for a in filings.AMOUNTS], x["adds_up"]))
    for i, (t, want) in enumerate(made):
        assert sorted(got[i]) == sorted(want), t


def test_totals_without_their_parts_names_on_their_own_lines_and_fiscal_years(spark):
    head = "<tr><td>Name</td><td>Fiscal Year</td><td>Salary</td><td>Bonus</td><td>Total</td></tr>"
    html = (f"<table>{head}<tr><td>Ana B. Ruiz</td></tr><tr><td>President and</td><td>FY2024</td><td>100,000</td><td>5</td><td>150,000</td></tr>"
            "<tr><td>Director</td><td>2023 (4)</td><td>90,000</td><td></td><td>90,000</td></tr><tr><td>Total</td><td></td><td></td><td></td><td>1</td></tr></table>")  # fmt: skip
    rows = filings.pay_tables(spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<table>Salary</table>")], "id long, html string").withColumn("row", F.lit("x"))).collect()
    got = sorted((r["year"], r["name"], r["title"], r["total"], r["adds_up"]) for r in rows)
    assert [g[:2] for g in got] == [(2023, "Ana B. Ruiz"), (2024, "Ana B. Ruiz")] and [g[3:] for g in got] == [(90_000, True), (150_000, False)]
    assert all(g[2].startswith("President and Director") for g in got)


def test_tags_read_signs_scales_zeros_and_first_contexts(spark):
    context = '<xbrli:context id="{}"><xbrli:period><xbrli:endDate>{}</xbrli:endDate></xbrli:period></xbrli:context>'
    tag = '<ix:nonFraction name="ecd:PeoTotalCompAmt" contextRef="{}"{}>{}</ix:nonFraction>'
    html = context.format("a", "2024-12-31") + context.format("a", "1999-12-31") + context.format("b", "2024-02-01") + context.format("c", "not a day")
    html += tag.format("a", ' scale="6" sign="-"', "<b>1.5</b>") + tag.format("b", ' format="ixt:fixed-zero"', "none") + tag.format("c", "", "5") + tag.format("none", "", "6") + tag.format("b", "", "n/a")
    rows = filings.performance_pay(spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")).collect()
    assert sorted((r["fiscal_year"], r["total"], r["name"]) for r in rows) == [(2023, 0.0, None), (2024, -1_500_000.0, None)]
