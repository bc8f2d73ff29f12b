from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline.functions import numbers, text, web
from ledgerline.operators import markup, metrics, people, quality, ranking, salaries, search, visitors

PERIODS = "company_id long, period_type string, fiscal_year long, fiscal_quarter long, revenue decimal(18,2), net_income decimal(18,4)"


def periods(spark, quarters=(), years=()):
    rows = [(c, "Quarterly", y, q, Decimal(r), Decimal(n)) for c, y, q, r, n in quarters] + [(c, "Annual", y, None, Decimal(r), Decimal(n)) for c, y, r, n in years]
    return spark.createDataFrame(rows, PERIODS)


def test_trailing_sums_growth_and_trend(spark):
    q = [(1, 2024, i, 100, 10) for i in range(1, 5)] + [(1, 2025, i, 110, 11) for i in range(1, 5)]
    q += [(2, 2025, i, 50, -5) for i in range(1, 5)]
    r = {x["company_id"]: x for x in metrics.indicators(periods(spark, q, [(3, 2024, 100, 1), (3, 2025, 90, 1)])).collect()}
    assert (r[1]["ttm_revenue"], r[1]["ttm_net"], r[1]["growth"], r[1]["trend"]) == (440, 44, 0.1, "Up")
    assert (r[2]["growth"], r[2]["trend"]) == (None, "Down")
    assert (r[3]["ttm_revenue"], r[3]["growth"], r[3]["trend"]) == (90, -0.1, "Down")


def test_growth_follows_keys_not_rows(spark):
    df = metrics.with_growth(periods(spark, [(1, 2023, 1, 100, 0), (1, 2024, 2, 50, 0), (1, 2024, 1, 150, 0)], [(1, 2023, 0, 0), (1, 2024, 5, 0)]))
    got = {(r["fiscal_year"], r["fiscal_quarter"]): r["growth"] for r in df.collect()}
    assert got == {(2023, 1): None, (2024, 2): None, (2024, 1): 0.5, (2023, None): None, (2024, None): None}


def test_streaks_break_at_missing_and_zero_growth(spark):
    up = [(1, 2020, 1, 10, 0), (1, 2021, 1, 11, 0), (1, 2022, 1, 12, 0), (1, 2023, 1, 13, 0)]
    flat = [(2, 2020, 1, 10, 0), (2, 2021, 1, 11, 0), (2, 2022, 1, 11, 0), (2, 2023, 1, 12, 0)]
    years = [(2, y, y, 0) for y in range(2018, 2024)] + [(3, y, 4000 - y, 0) for y in range(2018, 2023)]
    got = {r["company_id"]: tuple(r)[1:] for r in metrics.streaks(periods(spark, up + flat, years)).collect()}
    assert got == {1: ("Up", 3, "Quarterly"), 3: ("Down", 4, "Annual")}


def test_places_and_percentiles_match_plain_python(spark):
    rows = [(i % 3, float(v)) for i, v in enumerate([5, 1, 1, 9, 2, 7, 7, 7, 3, -4, 100, 0, 8, 2])]
    df = spark.createDataFrame(rows, "g int, v double")
    got = ranking.ranked(df, ["g"], [F.desc("v")], -ranking.log_bucket(F.col("v"))).collect()
    for g in range(3):
        own = sorted((r["place"], r["v"]) for r in got if r["g"] == g)
        assert [v for _, v in own] == sorted((v for h, v in rows if h == g), reverse=True) and [p for p, _ in own] == list(range(1, len(own) + 1))
    for r in ranking.percentiles(df, ["g"], "v", {"q": 0.25, "m": 0.5}).collect():
        s = sorted(v for h, v in rows if h == r["g"])
        at = [(len(s) - 1) * p for p in (0.25, 0.5)]
        assert [r["q"], r["m"]] == [s[int(a)] + (s[min(int(a) + 1, len(s) - 1)] - s[int(a)]) * (a - int(a)) for a in at]


def test_nearest_location_and_reach(spark):
    rows = [(1, 1, "Headquarters", "a", "UT", 40.40, -111.85), (2, 2, "Headquarters", "b", "UT", 40.75, -111.85), (3, 2, "Office", "b", "UT", 40.41, -111.87)]
    places = spark.createDataFrame(rows, "location_id long, company_id long, type string, city string, state string, latitude double, longitude double")
    got = {r["company_id"]: (r["location_id"], r["has_hq"]) for r in search.near(places, 40.3916, -111.8508, 5).collect()}
    assert got == {1: (1, True), 2: (3, False)}


def test_pages_have_no_gaps_and_missing_growth_comes_last(spark):
    rows = [(f"T{i:02d}", "USD", float(i % 4), None if i % 5 == 0 else i / 10) for i in range(23)]
    df = spark.createDataFrame(rows, "ticker string, currency string, ttm_revenue double, growth double")
    for reverse in (False, True):
        pages = [[r["ticker"] for r in search.page(df, search.order("Growth", reverse), n, 5).orderBy("place").collect()] for n in range(1, 6)]
        flat = sum(pages, [])
        assert sorted(flat) == [r[0] for r in rows] and flat[-5:] == ["T00", "T05", "T10", "T15", "T20"]


def test_careers_are_islands(spark):
    rows = [(1, "n", "a", 7, 2001, 10), (1, "n", "b", 7, 2002, 10), (1, "n", "c", 8, 2003, 5), (1, "n", "d", 7, 2004, 1), (1, "n", "e", 7, 2006, 1)]
    pay = spark.createDataFrame(rows, "person_id long, name string, title string, company_id long, year long, total long")
    got = sorted((r["from_year"], r["to_year"], r["title"], r["total"]) for r in people.careers(pay).collect())
    assert got == [(2001, 2002, "b", 20), (2003, 2003, "c", 5), (2004, 2004, "d", 1), (2006, 2006, "e", 1)]


def test_appointments_update_or_add(spark):
    listed = spark.createDataFrame([(1, "A", "CFO", 7, 5.0)], "person_id long, name string, title string, company_id long, latest_pay double")
    new = spark.createDataFrame([(1, "A", "CEO", 9, "2025-01-01", 1.0), (None, "B", "COO", 7, "2025-02-01", 2.0)],
                                "person_id long, name string, title string, company_id long, announced_on string, package double")
    got = sorted((r["name"], r["title"], r["company_id"], r["latest_pay"]) for r in people.with_appointments(listed, new).collect())
    assert got == [("A", "CEO", 9, 5.0), ("B", "COO", 7, 2.0)]


def test_visits_split_by_gap_and_day(spark):
    at = ["2024-01-01 10:00:00", "2024-01-01 10:30:00", "2024-01-01 11:00:01", "2024-01-01 23:59:00", "2024-01-02 00:01:00"]
    rows = [(i, t, t[:10], 1, "view", "D", None if i else "US") for i, t in enumerate(at)]
    e = spark.createDataFrame(rows, "event_id long, at string, day string, visitor long, name string, device string, country string").withColumn("at", F.to_timestamp("at"))
    assert sorted(r["events"] for r in visitors.visits(e).collect()) == [1, 1, 1, 2]


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.search_name(F.lit("Société Générale S.A."))) == "societe generale s a"
    assert one(text.job_key(F.lit("Sr. SW Engr III (JR123) - 20831"))) == "senior software engineer iii"
    assert one(text.employer_key(F.lit("The Goldman Group, Inc."))) == "goldman" and one(text.employer_key(F.lit("AT&T Inc"))) == "att"
    assert one(text.holds_role(F.lit("Former Chief Financial Officer"), "Cfo")) is False and one(text.holds_role(F.lit("Clerk"), "Other")) is True
    assert one(text.plain_text(F.lit("&lt;p&gt;A &amp;amp; B&lt;/p&gt;"))) == "A & B"
    assert [one(text.amount(F.lit(x))) for x in ("$1,200", "(35)", "—", "n/a")] == [1200.0, -35.0, 0.0, None]
    assert one(numbers.yearly_pay(F.lit("$45.50"), F.lit("Hour"))) == 94640.0
    for t, want in (("$45 - $60 per hour", (93600.0, 124800.0)), ("$120,000 to $160,000", (120000.0, 160000.0)), ("$2 - $3 billion", None), ("10 - 20 people", None)):
        r = one(markup.pay_range(F.lit(t)))
        assert tuple(r) == (want or (None, None))
    ua = one(web.user_agent(F.lit("Mozilla/5.0 (Windows NT 10.0) Chrome/120 Safari/537 Edg/120")))
    assert tuple(ua) == ("Desktop", "Edge", "Windows", False) and one(web.user_agent(F.lit("")))["is_bot"]
    assert one(web.referrer_host(F.lit("https://www.Google.com/x"), "site.org")) == "google.com" and one(web.referrer_host(F.lit("https://site.org/a"), "site.org")) is None


def test_grid_pushes_cells_aside():
    table = "<table><tr><th rowspan=2>a</th><td colspan='2'>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td></td></tr></table>"
    assert markup.grids(table)[0] == [(0, 0, 0, "a"), (0, 1, 2, "b"), (1, 1, 1, "c"), (1, 2, 2, "d")]


def test_checks_flag_each_defect(spark):
    c = spark.createDataFrame([(1, "A", "USD"), (2, "A", "USD")], "company_id long, name string, currency string")
    places = spark.createDataFrame([(1, 1, "Office", " ", 95.0, 0.0)], "location_id long, company_id long, type string, city string, latitude double, longitude double")
    p = periods(spark, [], [(1, 2020, 200_000_000, 900_000_000), (1, 2021, 12_000_000, 0), (1, 2021, 12_000_000, 0), (1, 2030, -1, 0)])
    pay = spark.createDataFrame([(7, "Ann Lee", 1, 2020, Decimal(500)), (7, "Ann Lee", 1, 2020, Decimal(600)), (8, "Total 3", 2, 2031, Decimal(-1)), (7, "Ann Lee", 2, 2020, Decimal(4 * 10**9))],
                                "person_id long, name string, company_id long, year long, total decimal(18,2)")
    known = spark.createDataFrame([(7,)], "person_id long")
    got = {r["name"]: r["n"] for r in quality.checks(c, places, p, pay, known, 2025).collect()}
    assert {k: v for k, v in got.items() if v} == {
        "No location at all": 1, "Only a local office": 1, "Same name under two ids": 1, "Missing city": 1, "Outside the world": 1, "No figures at all": 1,
        "Negative revenue": 1, "Period in the future": 1, "Duplicate period": 1, "Profit far bigger than revenue": 1, "Revenue jumps tenfold": 1,
        "Negative amount": 1, "Year in the future": 1, "Person record missing": 1, "Impossibly large total": 1, "Very large total": 1, "Tiny total": 2, "Name is no person's": 1,
        "Same person, company and year twice": 1}


def test_employers_match_by_tiers(spark):
    c = spark.createDataFrame([(1, "Amazon.com Inc"), (2, "Target Corp"), (3, "Twin Name"), (4, "Twin Name"), (5, "Walmart Inc.")], "company_id long, name string")
    e = spark.createDataFrame([("Amazon.com Services LLC",), ("Target Corporation",), ("Twin Name Inc",), ("Search Co",), ("Walmart Associates",), ("Walmart Tree Farm",)], "employer string")
    a = spark.createDataFrame([("Search", 9)], "alias string, company_id long")
    got = {r["employer"]: (r["company_id"], r["how"]) for r in salaries.matched_employers(e, c, a).collect()}
    assert got == {"Amazon.com Services LLC": (1, "subsidiary"), "Target Corporation": (2, "name"), "Twin Name Inc": (None, None), "Search Co": (9, "alias"),
                   "Walmart Associates": (5, "subsidiary"), "Walmart Tree Farm": (None, None)}
