import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import names
from ledgerline.operators import repair

PERIODS = "company_id long, period_type string, fiscal_year long, fiscal_quarter long, revenue decimal(28,4), net_income decimal(28,4)"
M = 1_000_000


def repaired(spark, annual, quarters=()):
    """annual: (year, revenue, net); quarters: (year, quarter, revenue, net) -> the same, repaired."""
    rows = [(1, "Annual", y, None, Decimal(str(r)), Decimal(str(n))) for y, r, n in annual]
    rows += [(1, "Quarterly", y, q, Decimal(str(r)), Decimal(str(n))) for y, q, r, n in quarters]
    out = repair.repair_financials(spark.createDataFrame(rows, PERIODS)).collect()
    years = {r["fiscal_year"]: (float(r["revenue"]), float(r["net_income"])) for r in out if r["period_type"] == "Annual"}
    parts = {(r["fiscal_year"], r["fiscal_quarter"]): (float(r["revenue"]), float(r["net_income"])) for r in out if r["period_type"] == "Quarterly"}
    return years, parts


def test_a_year_takes_the_unit_of_its_quarters_and_the_last_quarter_follows(spark):
    quarters = [(2024, q, 12 * M, 2 * M) for q in (1, 2, 3)] + [(2024, 4, 54_000 * M - 36 * M, 8 * M - 6 * M)]
    years, parts = repaired(spark, [(2024, 54_000 * M, 8 * M)], quarters)
    assert years[2024] == (54 * M, 8 * M) and parts[2024, 4] == (18 * M, 2 * M)


def test_a_year_takes_the_unit_of_both_years_around_it(spark):
    years, _ = repaired(spark, [(2022, 617 * M, 60 * M), (2023, 615_823, 59_000), (2024, 587 * M, 55 * M)])
    assert years[2023] == (615_823_000, 59_000_000)


def test_years_at_an_end_follow_the_year_they_lead_to(spark):
    years, _ = repaired(spark, [(2019, 155_000, 9_000), (2020, 160_000, 9_500), (2021, 194 * M, 11 * M), (2022, 200 * M, 12 * M)])
    assert years[2019] == (155 * M, 9 * M) and years[2020] == (160 * M, 9.5 * M)
    years, _ = repaired(spark, [(2022, 2105.0, 149.0), (2023, 2_200 * M, 150 * M), (2024, 2_300 * M, 160 * M)])
    assert years[2022] == (2105 * M, 149 * M)


def test_figures_without_evidence_stay_as_filed(spark):
    given = [(2020, 100 * M, 5 * M), (2021, 900 * M, -400 * M), (2022, 90 * M, 1 * M)]
    years, _ = repaired(spark, given)
    assert years == {y: (r, n) for y, r, n in given}
    alone, _ = repaired(spark, [(2024, 3_000, 1_000)])
    assert alone == {2024: (3_000, 1_000)}


def test_a_profit_above_its_revenue_is_in_thousands_beside_an_ordinary_year(spark):
    years, _ = repaired(spark, [(2020, 1_435 * M, 31 * M), (2021, 1_775 * M, -30_143 * M)])
    assert years[2021][1] == -30.143 * M or years[2021][1] == -30_143 * M / 1000


def test_a_loss_filed_as_a_profit_turns_where_only_that_leaves_a_possible_quarter(spark):
    quarters = [(2021, q, 105 * M, -n * M) for q, n in ((1, 56), (2, 71), (3, 57))]
    years, _ = repaired(spark, [(2021, 468 * M, 236_000 * M)], quarters)
    assert years[2021][1] == -236 * M


def test_a_last_quarter_out_of_line_is_worked_out_or_goes(spark):
    three = [(2022, q, 8_000 * M, 900 * M) for q in (1, 2, 3)]
    _, parts = repaired(spark, [(2022, 32_000 * M, 3_600 * M)], [*three, (2022, 4, 11 * M, 1 * M)])
    assert parts[2022, 4] == (8_000 * M, 900 * M)
    _, parts = repaired(spark, [(2022, 24_100 * M, 3_600 * M)], [*three, (2022, 4, 11 * M, 1 * M)])
    assert (2022, 4) not in parts and (2022, 3) in parts


@pytest.mark.parametrize("given, want", [
    ("Nora K. Vale (2)", "Nora K. Vale"), ("Ivo P. Sand3", "Ivo P. Sand"), ("Tess Morrow (Retired", "Tess Morrow"), ("Paul F. Ostrander SVP", "Paul F. Ostrander"),
    ("Hugo R. Lindqvis t", "Hugo R. Lindqvist"), ("Mia Fenn -Treasurer", "Mia Fenn"), ("LEO T. MCGRAW IV", "Leo T. McGraw IV"), ("ROSE D'ARCY-HOLT", "Rose D'Arcy-Holt"),
    ("Seaside Trust Company Odile B. McVey", "Odile B. McVey"), ("Kurt Abel CFO and", "Kurt Abel"), ("Lena van Ost", "Lena van Ost"), ("Jo Ray Chair", "Jo Ray"), ("(1)", "(1)")])
def test_names_lose_what_ran_into_them(given, want):
    assert names.clean_name(given) == want


@pytest.mark.parametrize("a, b, same", [
    ("Robert Quill", "Bob Quill", True), ("T. Edward Marsh", "Ted Marsh", True), ("L. Oscar Finch", "Oscar Finch", True), ("Petra Stone", "Petra Stone-Hale", True),
    ("M. Adeyemi", "Marcus Adeyemi", True), ("Kristoff Lund", "Kristopf Lund", True), ("Nora Whitfield", "Nora Whitfeld", True), ("Nora Vale", "Ivo Vale", False),
    ("Paul Ray", "Paul Roy", False), ("Ann Li", "Anna Li", False), ("", "Nora Vale", False), ("Vale", "Nora Vale", False)])
def test_two_spellings_of_one_person(a, b, same):
    assert names.same_person(a, b) is same and names.same_person(b, a) is same


def test_distances():
    assert names.distance("", "abc") == 3 and names.distance("kitten", "sitting") == 3 and names.distance("abc", "abc") == 0
    assert names.distance("abcdef", "uvwxyz", 2) > 2


def test_labels_are_no_persons_and_cut_names_are_joined():
    assert not any(names.is_person(n) for n in ("Named Officers", "Secretary and", "Finance & Law", "Former Chair", "Bonus", "Al", ""))
    assert names.is_person("Rose D'Arcy") and names.is_person("Su Ng")
    assert names.rejoined("Petra Stone-", "Hale Treasurer") == ("Petra Stone-Hale", "Treasurer")
    assert names.rejoined("Mia Fenn -Treasurer", "and Secretary") == ("Mia Fenn", "Treasurer and Secretary")
    assert names.rejoined("Mia Fenn", "Treasurer") == ("Mia Fenn", "Treasurer") and names.rejoined("", "") == ("", "")
    assert names.without_own_name("Stone III Treasurer", "Petra Stone III") == "Treasurer" and names.without_own_name("Hale Treasurer", "Petra Stone-Hale") == "Treasurer"


@pytest.mark.parametrize("given, want", [
    ("Treasurer These amounts include a grant", "Treasurer"), ("age 47 Chief Risk Officer", "Chief Risk Officer"), ("- , Chief Risk Officer", "Chief Risk Officer"),
    ("Nora K. Vale Executive Chair", "Executive Chair"), ("former Head of Mines", "Former Head of Mines"), ("Represents the value of awards", names.NO_TITLE),
    ("President and Treasurer Ivo Sand , 61 Chair", "President and Treasurer"), ("Secretary 90,500 1,200,000", "Secretary"), ("Co-Head)", "Co-Head"), ("", names.NO_TITLE),
    ("President Former Officers", "President"), ("Vice President Hugo R. Lindqvist", "Vice President"), ("Chief " + "Growth " * 30, "Chief " + "Growth " * 12 + "Growth…")])
def test_titles_lose_what_ran_into_them(given, want):
    assert names.clean_title(given) == want


PAY = "company_id long, person_id string, name string, title string, year int, salary decimal(18,2), bonus decimal(18,2), stock decimal(18,2), other decimal(18,2), total decimal(18,2), filing string, row int"


def paid(spark, rows, insiders=()):
    """rows: (id, name, title, year, total[, filing])."""
    full = [(1, i, n, t, y, Decimal(p), Decimal(0), Decimal(0), Decimal(0), Decimal(p), (f or ["f"])[0], k) for k, (i, n, t, y, p, *f) in enumerate(rows)]
    out = repair.repair_pay(spark.createDataFrame(full, PAY), spark.createDataFrame(list(insiders) or [("none", "")], "person_id string, number string")).collect()
    return {(r["person_id"], r["name"], r["title"], r["year"]) for r in out}


def test_one_person_under_two_ids_keeps_the_insiders(spark):
    got = paid(spark, [("a", "Robert Quill", "CEO", 2022, 53), ("b", "Bob Quill", "Chief Executive", 2022, 53), ("b", "Bob Quill", "CEO", 2021, 40)], [("a", "9")])
    assert got == {("a", "Robert Quill", "Chief Executive", 2022), ("a", "Robert Quill", "CEO", 2021)}


def test_two_insiders_stay_two_unless_a_third_id_joins_them(spark):
    rows = [("a", "Ann Smith", "CEO", 2022, 10), ("b", "Ann Smith", "CFO", 2022, 10)]
    assert len({g[0] for g in paid(spark, rows, [("a", "1"), ("b", "2")])}) == 2
    assert len({g[0] for g in paid(spark, [*rows, ("c", "Ann Smith", "CTO", 2022, 10)], [("a", "1"), ("b", "2")])}) == 1


def test_pay_given_to_the_wrong_person_goes_and_founders_stay(spark):
    rows = [("a", "Kurt Abel", "Chief Executive Officer Paul F. Ostrander Special Advisor", 2023, 90), ("b", "Paul F. Ostrander", "Special Advisor", 2023, 90)]
    assert {g[0] for g in paid(spark, rows)} == {"b"}
    assert len(paid(spark, [("a", "Ann Lee", "Co-founder", 2023, 90), ("b", "Odile Brun", "Co-founder", 2023, 90)])) == 2


def test_companies_that_go_on_in_the_next_batch_are_repaired_whole(spark):
    k = F.col("id")
    years = spark.range(40).select(k.alias("company_id"), F.explode(F.sequence(F.lit(1996).cast("long"), F.lit(2001).cast("long"))).alias("fiscal_year"))
    periods = years.select("company_id", F.lit("Annual").alias("period_type"), "fiscal_year", F.lit(None).cast("int").alias("fiscal_quarter"),
                           (F.col("fiscal_year") * 10_000 * F.when((F.col("company_id") % 2 == 0) & (F.col("fiscal_year") == 1998), 1000).otherwise(1)).alias("revenue"), F.lit(1000).alias("net_income"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = repair.repair_financials(periods).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 240 and all(r["revenue"] == r["fiscal_year"] * 10_000 for r in got)


def test_names_and_titles_of_many_companies_are_cleaned_fast():
    def rows(k):
        common = {"year": 2000, "salary": 1, "bonus": 0, "stock": 0, "other": 0, "total": k + 5, "filing": "f"}
        return [{"company_id": k, "person_id": p, "name": n, "title": t, **common} for p, n, t in (
            ("a", f"T. Edward Marsh{k} (1)", f"chief Executive Officer {k} Represents the aggregate grant date fair value"),
            ("b", f"JOHN P. MCDONALD{k} III", f"age 59 President and Chief Operating Officer {k} 108,150 2,000"), ("c", f"Other NEOs {k} required", "Chief"))]

    began = time.time()
    assert sum(len(repair._repaired_pay(rows(k), {})) for k in range(1500)) == 3000 and time.time() - began < 2.5
