"""What grows with the tables: work, memory, and results that only larger tables show."""

import math
import random
import re
import time
from statistics import median

from pyspark.sql import functions as F

from ledgerline.functions import places as functions_places
from ledgerline.functions import text
from ledgerline.operators import markup, matching, people, quality, salaries, search, statements


def test_a_table_of_many_rows_is_laid_out_in_linear_time():
    page = "<table>" + "<tr><td>a</td><td></td><td>b</td></tr>" * 20_000 + "</table>"
    began = time.time()
    (cells,) = markup.grids(page)
    assert len(cells) == 60_000 and cells[-1] == (19_999, 2, 2, "b") and time.time() - began < 20


def test_a_row_of_many_cells_is_laid_out_in_linear_time():
    began = time.time()
    (cells,) = markup.grids("<table><tr><td rowspan=2>a" + "<td>b" * 20_000 + "</tr><tr><td>c<td>d</tr></table>")
    assert cells[20_000][1] == 20_000 and cells[-2:] == [(1, 1, 1, "c"), (1, 2, 2, "d")] and time.time() - began < 20


def test_cells_leave_in_parts(spark):
    pages = spark.createDataFrame([(7, "<table>" + "<tr><td>x</td></tr>" * (markup.CELLS + 5) + "</table>"), (8, None), (9, "<table><tr><td>y</table>")], "id long, h string")
    counts = markup.table_cells(pages.coalesce(1), "id", "h").groupBy("id").agg(F.count("*").alias("n"), F.max("row").alias("last")).collect()
    assert {(r["id"], r["n"], r["last"]) for r in counts} == {(7, markup.CELLS + 5, markup.CELLS + 4), (9, 1, 0)}


def test_a_common_first_word_pairs_no_names(spark):
    k = F.col("id")
    companies = spark.range(30_000).select(k.alias("company_id"), F.concat(F.lit("Customer "), k).alias("name"))
    employers = spark.range(30_000).select(F.concat(F.lit("Customer "), k, F.lit(" Services")).alias("employer"))
    began = time.time()
    none = spark.createDataFrame([], "alias string, company_id long")
    assert salaries.matched_employers(employers, companies, none).filter("how = 'subsidiary'").count() == 30_000 and time.time() - began < 60


def test_the_longest_beginning_of_whole_words_counts(spark):
    companies = spark.createDataFrame([(1, "Alpha"), (2, "Alpha Beta"), (3, "Alpha Bet"), (4, "Gamma")], "company_id long, name string")
    employers = spark.createDataFrame([("Alpha Beta Works",), ("Alpha Services",), ("Alpha Works",), ("Gammas Bank",), ("Gamma",), (None,)], "employer string")
    none = spark.createDataFrame([], "alias string, company_id long")
    got = {r["employer"]: (r["company_id"], r["how"]) for r in salaries.matched_employers(employers, companies, none).collect()}
    assert got == {"Alpha Beta Works": (2, "subsidiary"), "Alpha Services": (1, "subsidiary"), "Alpha Works": (None, None), "Gammas Bank": (None, None), "Gamma": (4, "name"), None: (None, None)}


def test_insiders_of_all_companies_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, 1, "Ann Lee", True)], "company_id long, person_id long, name string, is_officer boolean")
    insiders = rows.select("company_id", F.lit(5).cast("long").alias("insider_id"), F.lit("Lee Ann").alias("name"), "is_officer")
    df = matching.insider_matches(rows.drop("is_officer"), insiders)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert re.search(r"SortMergeJoin \[company_id#\d+L?, last#\d+\]", plan)
    assert [tuple(r) for r in df.collect()] == [(1, 1, 5, 1)]


def test_capitals_of_one_letter_stay_one(spark):
    rows = spark.createDataFrame([("a", n) for n in ("Erbezu ß", "Anna SS", "E. ß", "A. SS", "Ms ss", "Ms ß")], "g string, name string")
    got = {r["name"]: r["canonical"] for r in matching.canonical_names(rows, "g").collect()}
    assert got == {"Erbezu ß": "Erbezu ß", "Anna SS": "Anna SS", "E. ß": "Erbezu ß", "A. SS": "Anna SS", "Ms ss": "Anna SS", "Ms ß": "Erbezu ß"}


def test_an_entity_ends_with_a_semicolon(spark):
    rows = [("a &amp b",), ("a &amp;amp b",), ("&lt;p>x&copy;&copy &#39;&#39 &nosuch; &ampx;",), ("AT&ampT &amp;lt;i&amp;gt;",)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(text.plain_text("h")).collect()]
    assert got == ["a &amp b", "a &amp b", "x©&copy '&#39 &nosuch; &ampx;", "AT&ampT"]


def test_single_units_replace_a_scale_stated_before(spark):
    texts = [(0, "Sales of 3 million last year"), (1, None), (2, "In dollars"), (3, "Income statement"), (3, "Note  2016  2015"), (3, "Revenue 4  1,000  900"), (3, "Profit before income tax  9  8"),
             (3, "Profit for the year  7  6")]
    lines = spark.createDataFrame([(1, p, n, t) for n, (p, t) in enumerate(texts)], "id long, page int, n int, text string")
    (row,) = statements.reported_years(lines, spark.createDataFrame([(1, 5, "a")], "id long, company_id long, basis string")).collect()
    assert (row["revenue"], row["net_income"], row["prior_revenue"], row["prior_net"]) == (1000.0, 7.0, 900.0, 6.0)


def test_nearest_places_are_those_of_all_pairs(spark):
    r = random.Random(3)
    points = [(i, 40 + r.choice((0.01, 0.2, 3)) * r.random(), -100 + r.choice((0.01, 0.2, 3)) * r.random()) for i in range(150)]
    points += [(200 + i, points[i][1], points[i][2]) for i in range(20)] + [(300, None, -100.0)]
    places = [(f"p{i}", 40 + r.choice((0.02, 1, 3)) * r.random(), -100 + r.choice((0.02, 1, 3)) * r.random()) for i in range(60)]
    places += [(f"a{i}", *places[i][1:]) for i in range(9)]
    p, q = spark.createDataFrame(points, "id long, latitude double, longitude double"), spark.createDataFrame(places, "place string, to_latitude double, to_longitude double")
    want = {}
    for i, y, x in points:
        flat = lambda t: (round((t[1] - y) ** 2 + ((t[2] - x) * math.cos(math.radians(y))) ** 2, 12), t[0])  # noqa: B023, E731
        want[i] = min(places, key=flat) if y is not None else None
    got = {row["id"]: (row["place"], row["miles"]) for row in search.nearest_place(p, q, "id", 30.0).collect()}
    assert set(got) == set(want) and all(got[i][0] in (want[i] and want[i][0], None) for i in want)
    #: A degree of latitude is 69 miles, and one of longitude less.
    near = {i for i, y, x in points if want[i] and math.dist((y, x), want[i][1:]) < 30 / 70}
    assert len(near) > 100 and all(got[i][0] == want[i][0] and got[i][1] <= 30 for i in near)


def test_points_of_one_spot_make_no_pairs(spark):
    spots = spark.range(40_000).select("id", (40 + F.col("id") % 2).cast("double").alias("latitude"), F.lit(-100.0).alias("longitude"))
    places = spots.select(F.concat(F.lit("p"), "id").alias("place"), F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"))
    began = time.time()
    assert {(r["place"], r["miles"], r["count"]) for r in search.nearest_place(spots, places, "id", 15.0).groupBy("place", "miles").count().collect()} == {("p0", 0.0, 20_000), ("p1", 0.0, 20_000)}
    assert time.time() - began < 60


def test_nearest_codes_are_those_of_all_pairs(spark):
    r = random.Random(5)
    number = lambda: f"{r.randrange(2000 if r.random() < 0.7 else 100_000):05d}"
    asked = [(i, r.choice((1, 2, None)), r.choice((number(), number()[1:], None))) for i in range(300)]
    known = [(r.choice((1, 2, None)), r.choice((number(), number()[1:])), f"n{r.randrange(50)}") for i in range(80)]
    rows = search.located_codes(spark.createDataFrame(asked, "id long, country long, code string"), spark.createDataFrame(known, "country long, known string, place string")).collect()

    def best(country, code):
        fits = [(0 if k == code else 1 if k[:3] == code[:3] and len(k) == len(code) else 2 if k[:2] == code[:2] and len(k) == len(code) else 9, abs(int(k) - int(code)), k, p) for c, k, p in known
                if code and country and c == country]
        found = min(fits, default=(9,))
        return (found[0], *found[2:]) if found[0] < 9 else (None, None, None)

    assert {row["id"]: (row["tier"], row["known"], row["place"]) for row in rows} == {i: best(c, k) for i, c, k in asked}


def test_ranges_of_ads_are_read_in_one_pass(spark):
    rows = [(1, "Sr Dev", "Provo", 10.0, 30.0), (1, "Senior Developer", "Provo", 20.0, 40.0), (1, "Sr Dev", None, 90.0, 100.0), (2, "Clerk", "Ogden", None, 50.0), (2, "(x)", "Ogden", 1.0, 2.0)]
    df = salaries.ads(spark.createDataFrame(rows, "company_id long, title string, city string, pay_min double, pay_max double"))
    got = {(r["company_id"], r["city"]): tuple(r)[3:] for r in df.collect()}
    #: A null city is the whole company; its ad counts there twice, as before.
    assert got == {(1, None): (4, 10.0, 55.0, 62.0, 70.0, 100.0), (1, "Provo"): (2, 10.0, 15.0, 25.0, 35.0, 40.0)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") + df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 4


def test_ads_move_once_and_large_groups_only_about_their_medians(spark):
    r = random.Random(8)
    pay = lambda: r.choice((None, float(r.randrange(1, 40) * 500), r.random() * 90_000))
    rows = [(r.choice((1, 1, 1, 2, None)), r.choice(("Sr Dev", "Senior Developer", "Clerk")), r.choice(("Provo", "Ogden", None)), pay(), pay()) for _ in range(600)]
    df = spark.createDataFrame(rows, "company_id long, title string, city string, pay_min double, pay_max double")
    listed, counted = (salaries.ads(df, small=n) for n in (10_000, 60))
    assert listed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    groups: dict = {}
    for company, title, city, low, high in rows:
        for place in (None, city):
            groups.setdefault((company, "clerk" if title == "Clerk" else "senior developer", place), []).append((low, high))
    want, whole = {}, lambda values: float(round(median(values)))
    for key, pairs in groups.items():
        lows, highs, mids = [a for a, _ in pairs if a is not None], [b for _, b in pairs if b is not None], [(a + b) / 2 for a, b in pairs if None not in (a, b)]
        p25, p75 = whole(lows), whole(highs)
        want[key] = (len(lows), min(lows), p25, min(max(whole(mids), p25), p75), p75, max(highs))
    assert {tuple(x)[:3]: tuple(x)[3:] for x in listed.collect()} == {tuple(x)[:3]: tuple(x)[3:] for x in counted.collect()} == want


def test_peers_of_copies_are_the_closest_by_id_and_lists_are_sorted(spark):
    rng = random.Random(3)
    base = [(rng.choice(["a", "b"]), rng.choice(["USD", "GBP"]), rng.choice([1999, 2000, 2001]), rng.choice([100.0, 250.0, 10_000.0]) * rng.randrange(1, 4), float(rng.randrange(1, 40))) for _ in range(25)]
    rows = [(25 * c + n, f"T{25 * c + n}", s, "sec", cur, y, r, p) for c in range(12) for n, (s, cur, y, r, p) in enumerate(base)]
    df = spark.createDataFrame(rows, "company_id long, ticker string, sector string, market string, currency string, year long, revenue_usd double, top_pay double")
    rate, want = {"USD": 1.0, "GBP": 1.27}, {}
    for i, t, s, _, cur, y, r, p in rows:
        peers = sorted((round(abs(math.log(o[6] / r)), 9), o[0], o) for o in rows if o[2] == s and o[5] >= y - 1 and o[0] != i)[:8]
        near = [(o[7] if o[4] == cur else float(round(o[7] * rate[o[4]] / rate[cur])), o[1]) for *_, o in peers] + [(p, t)]
        want[i] = [x[1] for x in sorted(near, key=lambda x: (-x[0], x[1]))]
    got = {}
    for x in sorted(people.peers_listed(df).collect(), key=lambda x: x["place"]):
        got.setdefault(x["company_id"], []).append(x["ticker"])
    assert got == want


def test_a_company_is_in_one_panel_and_makes_few_rows(spark):
    k = F.col("id")
    df = spark.range(2_000).select(k.alias("company_id"), F.concat(F.lit("T"), k).alias("ticker"), F.lit("a").alias("sector"), F.lit("sec").alias("market"), F.lit("USD").alias("currency"),
                                    (F.lit(2001) - k % 7).alias("year"), (k * 7919 % 20_011 + 5000).cast("double").alias("revenue_usd"), (k * 104_729 % 9973).cast("double").alias("top_pay"))
    panels, meets = people._panels(df)
    assert panels.count() == 2_000 and meets.count() == 34
    edges = {"low": (F.col("revenue_usd") / 3, 0), "high": (F.col("revenue_usd") * 3, 2)}
    asked = people._asked(panels, meets, edges)
    small = {r[0]: r[1] for r in people._paid_less(panels, asked, base=2, leaf=64, most_queries=50).collect()}
    whole = {r[0]: r[1] for r in people._paid_less(panels, asked).collect()}
    assert small == whole and len(whole) == 2_000
    own = df.filter("company_id = 7").first()
    lower = df.filter((F.col("year") >= own["year"] - 1) & F.col("revenue_usd").between(own["revenue_usd"] / 3, own["revenue_usd"] * 3) & (F.col("top_pay") < own["top_pay"])).count()
    assert whole[7] == lower


def test_salaries_move_once_and_large_groups_are_counted_by_bucket(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.choice(["Engineer", "engineer", "Clerk", "Night Clerk", None]), rng.choice(["a", "b", None]), "s", rng.choice([None, 1.0, 2.0, 5.5, 900.0, float(rng.randrange(2000))])) for _ in range(400)]
    df = spark.createDataFrame(rows, "company_id long, title string, city string, state string, salary double")
    groups = {}
    for c, t, city, state, v in rows:
        if t and v is not None:
            groups.setdefault((c, t.lower(), None, None, "all"), []).append(v)
            groups.setdefault((c, t.lower(), city, state, "place"), []).append(v)

    def at(values, share):
        x = (len(values) - 1) * share
        low, high = values[math.floor(x)], values[math.ceil(x)]
        return float(round(low + (high - low) * (x - math.floor(x))))

    want = list((*k[:4], len(v), min(v), *[at(sorted(v), p) for p in (0.25, 0.5, 0.75)], max(v)) for k, v in groups.items() if len(v) >= 3)
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    for small in (1_000_000, 60, 0):
        assert order(salaries.by_title_and_place(df, small=small).collect()) == order(want)
    found = salaries.by_title_and_place(df, titles=df.select("title"), holding="CLERK night")
    assert order(found.collect()) == order(r for r in want if r[1] == "night clerk")
    plan = salaries.by_title_and_place(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_pay_is_summed_once_for_all_steps_that_read_it(spark):
    pay = spark.createDataFrame([(1, 1, 2000, 5.0), (1, 1, 1999, 4.0)], "person_id long, company_id long, year long, total double").select(
        "*", F.lit("n").alias("name"), F.concat(F.lit("Chief Executive Officer of pay_"), F.rand(1).cast("string")).alias("title"))
    companies = spark.createDataFrame([(1, "T1", "a", "USD", "x")], "company_id long, ticker string, sector string, currency string, name string")
    periods = spark.createDataFrame([(1, "Annual", y, None, 10.0 * y, 1.0) for y in (1999, 2000)], "company_id long, period_type string, fiscal_year long, fiscal_quarter long, revenue double, net_income double")
    places = companies.select("company_id", F.lit("Headquarters").alias("type"), F.lit("c").alias("city"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"))
    against = people.pay_against_results(pay, companies, periods, 2001)
    near = people.people_near(pay, companies.select("company_id"), 3, 2001)
    checked = quality.checks(companies, places, periods, pay, pay.select("person_id"), 2001)
    for df in (against, near, checked):
        assert "rand(1)" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["person_id"], r["pay_change"]) for r in against.collect()] == [(1, 0.25)]


def test_the_steps_of_a_place_are_worked_out_once(spark):
    ads = spark.createDataFrame([("Provo, UT; NYC, New York, USA or Remote, TX",)], "ad string").select(functions_places.us_places(F.col("ad")).alias("p"))
    assert [tuple(p) for p in ads.first()["p"]] == [("Provo", "UT"), ("New York", "NY")]
    assert ads._jdf.queryExecution().analyzed().toString().count("split(trim(") == 1
