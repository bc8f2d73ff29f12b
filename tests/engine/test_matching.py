import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import matching, statements, visitors


def insiders(spark, people, known):
    p = spark.createDataFrame([(1, i, n) for i, n in people], "company_id int, person_id string, name string").withColumn("words", F.lit(1))
    k = spark.createDataFrame([(1, i, n, o) for i, n, o in known], "company_id int, insider_id string, name string, is_officer boolean")
    return {r["person_id"]: (r["insider_id"], r["tier"]) for r in matching.insider_matches(p, k).collect()}


def test_insiders_are_found_by_name_short_form_office_and_initial(spark):
    assert insiders(spark, [("a", "Bob (Bobby) Vale, Jr."), ("b", "Mia O'Fenn-Hart")], [("1", "VALE ROBERT J", True), ("2", "OFENNHART MIA", False)]) == {"a": ("1", 1), "b": ("2", 1)}
    assert insiders(spark, [("a", "Robert Vale")], [("1", "Vale Robert", True), ("2", "Vale Bob", False)]) == {"a": ("1", 1)}
    assert insiders(spark, [("a", "Robert Vale")], [("1", "Vale Robert", True), ("2", "Vale Bob", True)]) == {}
    assert insiders(spark, [("a", "Rudi Vale")], [("1", "Vale Roland", False), ("2", "Vale Ann", True)]) == {"a": ("1", 2)}
    assert insiders(spark, [("a", "Rudi Vale")], [("1", "Vale Roland", False), ("2", "Vale Rex", True)]) == {}


def test_each_insider_is_one_persons(spark):
    known = [("1", "Vale Robert", None)]
    assert insiders(spark, [("a", "Robert Vale"), ("b", "Rudi Vale")], known) == {"a": ("1", 1)}
    assert insiders(spark, [("a", "Robert Vale"), ("b", "Bob Vale")], known) == {}
    assert insiders(spark, [("a", None), ("b", ""), ("c", "Vale")], known) == {} and insiders(spark, [], known) == {}


def canonical(names):
    def split(n):
        w = [x for x in n.split() if x.strip(".,").lower() not in matching._HONOURS]
        last = (w[-1] if w else n).strip(".,").upper()
        first = w[0].replace(".", "") if len(w) > 1 else ""
        return last, first[:1].upper() or None, len(first) > 1
    out = {}
    for n in names:
        last, initial, full = split(n)
        fits = {m for m in names if split(m)[2] and split(m)[0] == last and (initial is None or split(m)[1] == initial)}
        out[n] = next(iter(fits)) if not full and len(fits) == 1 else n
    return out


def test_canonical_names_match_brute_force(spark):
    r = random.Random(1)
    names = {f"{r.choice(['', 'Ms ', 'Sir '])}{r.choice(['', 'A. ', 'B ', 'Anna ', 'Alan ', 'Bea ', 'Ann B. '])}{r.choice(['Vale', 'VALE', 'Sand', 'Fenn,', 'Roe'])}".strip() for _ in range(60)} | {"Mr", "x"}
    rows = [(g, n) for g in (1, None) for n in names for _ in range(2)] + [(1, None)]
    got = {(r["company_id"], r["name"]): r["canonical"] for r in matching.canonical_names(spark.createDataFrame(rows, "company_id int, name string")).collect()}
    assert got == {(g, n): c for g in (1, None) for n, c in canonical(names).items()}


def test_domains_end_with_the_longest_suffix(spark):
    urls = [(1, "https://a.b.co.uk/x"), (2, "http://co.uk"), (3, "http://10.0.0.1/"), (4, None), (5, "no address"), (6, "http://X.Example.COM.:80/?q"), (7, "http://a.uk"), (8, "http://y.zz")]
    df = spark.createDataFrame(urls, "id int, url string").withColumn("host", F.lit("clash")).drop("host")
    suffixes = spark.createDataFrame([("uk",), ("co.uk",), ("com",), ("com",)], "suffix string")
    got = {r["id"]: r["domain"] for r in matching.registrable_domains(df, suffixes).collect()}
    assert got == {1: "b.co.uk", 2: None, 3: None, 4: None, 5: None, 6: "example.com", 7: "a.uk", 8: None}


LINES = "id int, page int, n int, text string"


def lines(spark, *texts, page=1):
    return spark.createDataFrame([(1, page, i, t) for i, t in enumerate(texts)], LINES)


@pytest.mark.parametrize("texts, want", [
    (["Registered office: 5 High Street, Port Vale 2001"], ("5 High Street", "Port Vale", "2001")), (["Registered office", "Share registry", "5 High Street, Vale 2000"], None),
    (["Registered office", "Level 3", "5 High Street", "VALE NSW 2000"], ("Level 3, 5 High Street", "Vale", "2000")), (["Registered office", "a", "b", "c", "d", "e", "Vale 2000"], None),
    (["Registered office", "1 First Street, Vale 2000", "Head office", "2 Second Street, Vale 2000"], ("2 Second Street", "Vale", "2000")), ([None, "", "Head office"], None),
    (["Head office", "2 Second Street, Nowhere 2000"], None), (["Auditor: 1 Street, Vale 2000"], None), (["Head office  Auditor", "2 Side Lane, Vale 2000   9 Other Way, Port Vale 2001"], ("2 Side Lane", "Vale", "2000"))])
def test_offices(spark, texts, want):
    towns = spark.createDataFrame([("Vale", "2000"), ("Port Vale", "2001"), ("Vale", "2001"), ("Vale", "2000")], "town string, code string")
    rows = matching.office_addresses(lines(spark, *texts), towns).collect()
    assert [(r["street"], r["town"], r["code"]) for r in rows] == ([want] if want else [])


def test_statements_are_found_among_pages_with_their_own_unit(spark):
    texts = [(0, "Notes to the accounts"), (0, "Revenue 5 6"), (0, "2020 2019"), (1, "In thousands of dollars"), (2, "Income statement"), (2, "Note 2022 2023"), (2, "Revenue 3 1,000 2,000"),
             (2, "Cost of sales (700) (900)"), (2, "Profit before tax 300 1,100"), (2, "Net loss after tax (12) 7"), (2, "Earnings per share – 1.5"), (2, "a" * 400 + " 1 2"), (2, None)]
    df = spark.createDataFrame([(1, p, i, t) for i, (p, t) in enumerate(texts)], LINES)
    rows = {(r["label"], r["year"]): r["amount"] for r in statements.statement_rows(df).collect()}
    assert rows["Revenue", 2022] == 1e6 and rows["Revenue", 2023] == 2e6 and rows["Cost of sales", 2022] == -7e5
    assert ("Earnings per share", 2022) not in rows and rows["Earnings per share", 2023] == 1500
    reports = spark.createDataFrame([(1, 9, "ifrs")], "id int, company_id int, basis string")
    r = statements.reported_years(df, reports).first()
    assert (r["company_id"], r["report_year"], r["revenue"], r["prior_revenue"], r["net_income"], r["prior_net"]) == (9, 2023, 2e6, 1e6, 7e3, -12e3)
    assert statements.statement_rows(df.filter("page <> 2")).count() == 0 and statements.statement_rows(df.filter("false")).count() == 0


def test_directors_pay_by_alignment(spark):
    df = lines(spark, "£'000", "Fees  Benefits  LTIP  Total", "2023 2022 2023 2022 2023 2022 2023 2022", "Ms Ana Vale 100 90 5 – 45 1 150 91", "Total 100 90 5 1 1 1 1 1", "Tom Ode 1 2 3",
               "Salary  Bonus  Pension  Total", "Year to 31 March 2024 (2023)", "Tom B. Ode 300 20 30 355", "Li Wei 300 20 30 350", None)
    got = {(r["name"], r["year"]): (r["salary"], r["benefits"], r["share_awards"], r["bonus"], r["pension"], r["total"], r["adds_up"]) for r in statements.directors_pay(df).collect()}
    assert got == {("Ms Ana Vale", 2023): (1e5, 5e3, 45e3, 0, 0, 15e4, True), ("Ms Ana Vale", 2022): (9e4, 0, 1e3, 0, 0, 91e3, True),
                   ("Tom B. Ode", 2024): (3e5, 0, 0, 2e4, 3e4, 355e3, False), ("Li Wei", 2024): (3e5, 0, 0, 2e4, 3e4, 35e4, True)}
    assert statements.directors_pay(df.filter("false")).count() == 0


def test_steps_of_visits_match_brute_force(spark):
    r = random.Random(5)
    start = datetime(2024, 1, 1)
    events, t = [], {v: start for v in ("a", "b", "hot")}
    for i in range(900):
        v = r.choice(["a", "b", "hot", "hot", "hot", "hot"])
        t[v] += timedelta(minutes=r.choice([0, 0, 1, 5, 29, 30, 31, 60]) if v != "hot" else 0, seconds=r.randint(0, 1))
        events.append((i, t[v], t[v].strftime("%Y-%m-%d"), v, r.choice(["view", "click"]), i % 7, None))
    df = spark.createDataFrame(events, "event_id long, at timestamp, day string, visitor string, name string, subject long, label string")
    want = Counter()
    for key in {(e[2], e[3]) for e in events}:
        own = sorted((e for e in events if (e[2], e[3]) == key), key=lambda e: (e[1], e[0]))
        run, last = [], None
        for e in own + [None]:
            if e is None or last and e[1] - last > timedelta(minutes=30):
                want[(*key, tuple((x[4], x[5]) for x in run[:12]))] += 1
                run = []
            if e:
                run.append(e)
                last = e[1]
    got = Counter((x["day"], x["visitor"], tuple((s["name"], s["subject"]) for s in x["steps"])) for x in visitors.visit_steps(df, most=12).collect())
    assert got == want


def test_appointments_go_to_known_people_insiders_and_lone_names(spark):
    appointments = spark.createDataFrame([(1, 1, "Mia Vale"), (2, 1, "Ivo Sand"), (3, 1, "Rose Fenn"), (4, 1, "Tom Ode"), (5, 1, None), (6, 2, "Mia Vale")], "appointment_id long, company_id long, name string")
    known = spark.createDataFrame([(1, "MIA VALE", "k"), (1, "Mia Vale", "k"), (1, "Tom Ode", "a"), (1, "Tom Ode", "b")], "company_id long, name string, person_id string")
    inside = spark.createDataFrame([(1, "SAND IVO", "i", True)], "company_id long, name string, insider_id string, is_officer boolean")
    people = spark.createDataFrame([("rose fenn", "p"), ("Mia Vale", "q"), ("Tom Ode", "a"), ("Tom Ode", "b")], "name string, person_id string")
    got = {r["appointment_id"]: (r["person_id"], r["how"]) for r in matching.appointed_people(appointments, known, inside, people).collect()}
    assert got == {1: ("k", "known"), 2: ("i", "insider"), 3: ("p", "name"), 4: (None, None), 5: (None, None), 6: ("q", "name")}


def test_pay_of_a_year_names_the_largest_payer(spark):
    rows = spark.createDataFrame([("a", 2020, 1, 5.0), ("a", 2020, 2, 7.0), ("a", 2021, 3, 1.0), ("b", 2020, 1, 2.0), ("b", 2020, 3, 2.0)], "person_id string, year int, company_id int, total double")
    one = lambda i, t: spark.createDataFrame([(i, t)], "company_id int, ticker string")
    got = {(r["person_id"], r["year"]): (r["total"], r["ticker"]) for r in matching.pay_by_year(rows, one(1, "ONE"), one(2, "TWO")).collect()}
    assert got == {("a", 2020): (12.0, "TWO"), ("a", 2021): (1.0, "3"), ("b", 2020): (4.0, "ONE")}
