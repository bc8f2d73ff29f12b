"""Registered queries over lists and lookups: sets, publishing, executives, visitors, and lines of filings; beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import companies, numbers, text, web
from ..operators import facts, markup, metrics, pages, people, search, sets, visitors
from ..sources import directory as d
from ..sources import publish
from ..streaming import events as stream
from .catalogue import query
from .queries import _VISITS
from .sql import MILES
from .text import _pick, _sql_array, _text

POINT = (40.3916, -111.8508, 250.0)


# --- sets and lookups -------------------------------------------------------------------------------------------------


@query("q_combined", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS part FROM customer")
def q_combined(s, sf):
    c = d.table(s, sf, "customer").select("c_custkey", "c_name")
    a = c.filter("c_custkey % 2 = 0").withColumn("part", F.lit("a"))
    return sets.combined([a, c.withColumn("c_name", F.lower("c_name")).filter("c_custkey % 4 = 0").withColumn("part", F.lit("late")), c.withColumn("part", F.lit("b"))], ["c_custkey"])


@query("q_metadata", """SELECT string_agg(r_name, '+' ORDER BY r_regionkey) AS version, DATE '2020-01-01' + min(r_regionkey) AS as_of, bool_or(r_regionkey = 3) AS is_sample FROM region""")
def q_metadata(s, sf):
    k = F.col("r_regionkey")
    parts = d.table(s, sf, "region").select(k.alias("place"), F.col("r_name").alias("version"), F.date_add(F.lit("2020-01-01").cast("date"), k).alias("as_of"), (k == 3).alias("is_sample"))
    return sets.combined_metadata(parts)


@query("q_distinct_sectors", "SELECT DISTINCT c_mktsegment AS sector FROM customer")
def q_distinct_sectors(s, sf):
    k = F.col("c_custkey")
    return sets.distinct_spellings(d.table(s, sf, "customer").select(F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("sector")), "sector")


@query("q_best_of", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def q_best_of(s, sf):
    return sets.best_of(d.table(s, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [-F.col("o_totalprice"), F.col("o_orderkey")])


@query("q_set_except", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0")
def q_set_except(s, sf):
    t = d.table(s, sf, "supplier").select("s_suppkey")
    return sets.without(t, t.filter("s_suppkey % 7 = 0"), ["s_suppkey"])


@query("q_unused_ids", "SELECT p_partkey FROM part WHERE p_partkey % 6 NOT IN (0, 2, 3, 4)")
def q_unused_ids(s, sf):
    t = d.table(s, sf, "part").select("p_partkey")
    return sets.unused_ids(t, [t.filter("p_partkey % 2 = 0"), t.filter("p_partkey % 3 = 0"), t.select(F.lit(None).cast("long").alias("p_partkey"))], "p_partkey")


@query("q_even_sample", """SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () // 50 AS step FROM orders) WHERE n % step = 0 AND n // step < 50""")
def q_even_sample(s, sf):
    return sets.even_sample(d.table(s, sf, "orders").select("o_orderkey"), ["o_orderkey"], 50)


@query("q_cascade", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'by id' WHEN c_nationkey % 3 = 0 THEN 'by nation' WHEN c_mktsegment = 'BUILDING' THEN 'by sector' END AS site,
    CASE WHEN c_custkey % 2 = 0 THEN 0 WHEN c_nationkey % 3 = 0 THEN 1 WHEN c_mktsegment = 'BUILDING' THEN 2 END AS tier FROM customer""")  # fmt: skip
def q_cascade(s, sf):
    c = d.table(s, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    by = lambda df, *key, name: df.select(*key).distinct().withColumn("site", F.lit(name))
    tiers = [(by(c.filter("c_custkey % 2 = 0"), "c_custkey", name="by id"), ["c_custkey"]), (by(c.filter("c_nationkey % 3 = 0"), "c_nationkey", name="by nation"), ["c_nationkey"]),
             (by(c.filter("c_mktsegment = 'BUILDING'"), "c_mktsegment", name="by sector"), ["c_mktsegment"])]
    return sets.cascade(c, tiers, "site").select("c_custkey", "site", "tier")


@query("q_remapped", "SELECT company_id, CASE WHEN person_id % 3 = 0 THEN person_id + 1 ELSE person_id END AS person_id, count(*) AS n FROM pay GROUP BY 1, 2")
def q_remapped(s, sf):
    p = d.pay(s, sf).select("company_id", "person_id", "year")
    merged = p.filter("person_id % 3 = 0").select("company_id", "person_id", (F.col("person_id") + 1).alias("kept")).distinct()
    return sets.remapped(p, merged, ["company_id"], "person_id").groupBy("company_id", "person_id").agg(F.count("*").alias("n"))


@query("q_fuzzy_members", "SELECT 'T' || s_suppkey AS ticker, s_suppkey AS filer_id FROM supplier")
def q_fuzzy_members(s, sf):
    k = F.col("s_suppkey")
    t = d.table(s, sf, "supplier")
    return sets.fuzzy_members(t.select(_text("T", k).alias("ticker"), _text("x", k, "q acme industries").alias("key")), t.select(k.alias("filer_id"), _text("x", k, "q acme indus").alias("key"), k.alias("filings")))


@query("q_upserted", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE 'new' END AS title, CASE WHEN s_suppkey % 2 = 0 OR s_suppkey % 3 = 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS pay_min,
    CASE WHEN s_suppkey % 3 = 2 THEN DATE '2024-05-02' ELSE DATE '2024-05-01' END AS first_seen, CASE WHEN s_suppkey % 3 = 0 THEN DATE '2024-05-01' ELSE DATE '2024-05-02' END AS last_seen
    FROM supplier""")  # fmt: skip
def q_upserted(s, sf):
    k = F.col("s_suppkey")
    t = d.table(s, sf, "supplier")
    day = lambda n: F.lit(f"2024-05-0{n}").cast("date")
    old = t.filter("s_suppkey % 3 <> 2").select(k, F.lit("old").alias("title"), F.when((k % 3 == 0) & (k % 2 == 0), 2.0).otherwise(1.0).alias("pay_min"), day(1).alias("first_seen"), day(1).alias("last_seen"))
    new = t.filter("s_suppkey % 3 <> 0").select(k, F.lit("new").alias("title"), F.when((k % 2 == 0) | (k % 3 == 1), 2.0).when(k % 3 == 2, 1.0).alias("pay_min"))
    return publish.upserted(old, new, ["s_suppkey"], day(2))


@query("q_updated", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE 'found' END AS website, CASE WHEN s_suppkey % 5 = 0 THEN 'old' ELSE 'new' END AS careers FROM supplier")
def q_updated(s, sf):
    k = F.col("s_suppkey")
    t = d.table(s, sf, "supplier")
    rows = t.select(k, F.when(k % 2 == 0, "own").alias("website"), F.lit("old").alias("careers"))
    return publish.updated(rows, t.select(k, F.lit("found").alias("website"), F.when(k % 5 != 0, "new").alias("careers")), "s_suppkey", keep=["website"], take=["careers"])


@query("q_insert_missing", "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'here' ELSE 'added' END AS name FROM supplier")
def q_insert_missing(s, sf):
    t = d.table(s, sf, "supplier").select("s_suppkey")
    return publish.insert_missing(t.filter("s_suppkey % 2 = 0").withColumn("name", F.lit("here")), t.withColumn("name", F.lit("added")), ["s_suppkey"])


@query("q_without_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def q_without_orphans(s, sf):
    parent = d.table(s, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return publish.without_orphans(d.table(s, sf, "orders").select("o_orderkey", "o_custkey"), parent, "o_custkey").select("o_orderkey")


@query("q_known_rows", "SELECT 'customer' AS name, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def q_known_rows(s, sf):
    return publish.known_rows({t: d.table(s, sf, t) for t in ("customer", "orders")})


# --- executives -------------------------------------------------------------------------------------------------------

_NEAR = """near AS (SELECT * FROM (SELECT person_id, any_value(name) AS name, arg_max(title, (year, -total, company_id)) FILTER (here) AS title,
    arg_max(company_id, (year, -total, company_id)) FILTER (here) AS company_id, arg_max(here, (year, -total, company_id)) AS is_current, max(year) AS latest_year,
    sum(total) FILTER (year = last)::DOUBLE AS latest_pay, CASE WHEN sum(total) FILTER (year = last - 1) > 0 AND last - 1 > newest - 3
         THEN round_even(sum(total) FILTER (year = last)::DOUBLE / sum(total) FILTER (year = last - 1)::DOUBLE - 1, 4) END AS growth,
    sum(total) FILTER (year > newest - 3)::DOUBLE AS window_pay, count(DISTINCT year) FILTER (year > newest - 3) AS years_paid
    FROM (SELECT *, company_id IN (SELECT company_id FROM nearest) AS here, max(year) OVER (PARTITION BY person_id) AS last, least(max(year) OVER (), 2001) AS newest
          FROM pay WHERE person_id IN (SELECT person_id FROM pay WHERE company_id IN (SELECT company_id FROM nearest))) GROUP BY person_id, last, newest) WHERE years_paid > 0)"""


def _near(s, sf):
    hits = search.near(d.locations(d.companies(s, sf)), *POINT)
    return people.people_near(d.pay(s, sf), hits, 3, 2001)


@query("q_people_summary", """SELECT count(*) AS people, count(DISTINCT company_id) AS companies, round_even(sum(latest_pay) FILTER (is_current), 2) AS current_pay, max(latest_year) AS latest_year,
    round_even(median(latest_pay) FILTER (is_current), 2) AS median_pay FROM near""", extra=",\n" + _NEAR)  # fmt: skip
def q_people_summary(s, sf):
    return people.people_summary(_near(s, sf))


for _sort, _key in {"Pay": "latest_pay DESC NULLS LAST", "Growth": "growth DESC NULLS LAST", "Total": "window_pay DESC NULLS LAST", "Name": "name", "Company": "ticker"}.items():

    def _page(s, sf, sort=_sort):
        who = _near(s, sf).join(d.companies(s, sf).select("company_id", "ticker"), "company_id", "left")
        return people.executive_page(who, sort, " chief ", 1, 25).select("person_id", F.col("place").cast("long").alias("place"))

    query(f"q_executives_{_sort.lower()}", f"""SELECT person_id, place FROM (SELECT person_id, row_number() OVER (ORDER BY {_key}, person_id) AS place FROM (
        SELECT near.*, ticker FROM near LEFT JOIN companies USING (company_id)) WHERE contains(lower(title), 'chief') OR contains(lower(name), 'chief')) WHERE place <= 25""", extra=",\n" + _NEAR)(_page)  # fmt: skip


def _appointments(s, sf):
    """One for every supplier: of a known person for even keys, of a new one for odd."""
    k = F.col("s_suppkey")
    day = F.date_add(F.lit("2001-01-01").cast("date"), (k % 700).cast("int"))
    part = lambda kind, label, amount: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), amount.cast("double").alias("amount"))
    package = F.array(part("Salary", "Base salary", k * 1000), part("Bonus", "Sign-on bonus", k * 10), part("Stock", "Stock awards", k * 100), part("Stock", "Stock awards", k * 200))
    return d.table(s, sf, "supplier").select(k.alias("appointment_id"), F.when(k % 2 == 0, k).alias("person_id"), F.col("s_name").alias("name"), F.lit("Chief Financial Officer").alias("title"),
                                             (k % 100).alias("company_id"), day.alias("announced_on"), F.when(k % 3 == 0, F.date_add(day, 90)).alias("starts_on"), package.alias("package"))


@query("q_recent", """SELECT s_suppkey AS appointment_id FROM supplier WHERE DATE '2001-01-01' + (s_suppkey % 700)::INT + CASE WHEN s_suppkey % 3 = 0 THEN 90 ELSE 0 END >= DATE '2001-03-15'""")
def q_recent(s, sf):
    return people.recent(_appointments(s, sf), "2002-03-15").select("appointment_id")


@query("q_packages", """SELECT s_suppkey AS appointment_id, (s_suppkey * 1310)::DOUBLE AS total, (s_suppkey * 1000)::DOUBLE AS salary, (s_suppkey * 10)::DOUBLE AS bonus, (s_suppkey * 300)::DOUBLE AS stock FROM supplier""")
def q_packages(s, sf):
    return people.package_totals(_appointments(s, sf)).drop("lines")


@query("q_has_profile", "SELECT s_suppkey AS appointment_id, s_suppkey % 2 = 0 AND s_suppkey IN (SELECT person_id FROM pay) AS has_profile FROM supplier")
def q_has_profile(s, sf):
    return people.with_profiles(_appointments(s, sf), d.pay(s, sf)).select("appointment_id", "has_profile")


@query("q_appointments", """SELECT person_id, name, title, company_id, latest_pay, is_new FROM (
    SELECT coalesce(n.person_id, a.s_suppkey) AS person_id, coalesce(n.name, a.s_name) AS name, CASE WHEN a.s_suppkey IS NULL THEN n.title ELSE 'Chief Financial Officer' END AS title,
           CASE WHEN a.s_suppkey IS NULL THEN n.company_id ELSE a.s_suppkey % 100 END AS company_id, coalesce(n.latest_pay, a.s_suppkey * 1310)::DOUBLE AS latest_pay, a.s_suppkey IS NOT NULL AS is_new
    FROM near n FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0 AND DATE '2001-01-01' + (s_suppkey % 700)::INT + CASE WHEN s_suppkey % 3 = 0 THEN 90 ELSE 0 END >= DATE '2001-03-15') a ON n.person_id = a.s_suppkey
    UNION ALL SELECT NULL, s_name, 'Chief Financial Officer', s_suppkey % 100, s_suppkey * 1310, true FROM supplier
    WHERE s_suppkey % 2 = 1 AND DATE '2001-01-01' + (s_suppkey % 700)::INT + CASE WHEN s_suppkey % 3 = 0 THEN 90 ELSE 0 END >= DATE '2001-03-15')""", extra=",\n" + _NEAR)  # fmt: skip
def q_appointments(s, sf):
    a = people.recent(_appointments(s, sf), "2002-03-15")
    a = a.drop("package").join(people.package_totals(a).select("appointment_id", F.col("total").alias("package")), "appointment_id")
    return people.with_appointments(_near(s, sf).select("person_id", "name", "title", "company_id", "latest_pay"), a)


@query("q_hours_for_median", """SELECT company_id, person_id, CASE WHEN total > median THEN round_even(median / total * 8766, 2) END AS hours FROM (
    SELECT company_id, person_id, usd AS total, CASE WHEN ticker LIKE '%.L' THEN 40000.0 WHEN ticker LIKE '%.KA' THEN 900000.0 ELSE 60000.0 END::DOUBLE AS median FROM chiefs)""")  # fmt: skip
def q_hours_for_median(s, sf):
    c = people.chiefs(d.pay(s, sf), d.companies(s, sf), 2001).withColumn("country", people.pay_market(F.col("ticker"))).withColumn("amount", F.col("usd"))
    medians = s.createDataFrame([("uk", 40000.0), ("pk", 900000.0), ("sec", 60000.0)], "country string, median double")
    return people.hours_for_median(c, medians).select("company_id", "person_id", "hours")


# --- visitors ---------------------------------------------------------------------------------------------------------


@query("q_newest_visits", _VISITS + " ORDER BY started DESC, visitor LIMIT 200")
def q_newest_visits(s, sf):
    return visitors.newest_visits(d.events(s, sf))


@query("q_areas", """SELECT area, events, visitors FROM (SELECT CASE WHEN latitude < 27.2 THEN 'South town' ELSE 'Near ' || printf('%.2f, %.2f', latitude, longitude) END AS area, sum(events)::BIGINT AS events, sum(visitors)::BIGINT AS visitors
    FROM (SELECT latitude, longitude, count(*) AS events, count(DISTINCT visitor) AS visitors FROM site WHERE name = 'click' GROUP BY 1, 2 ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 100) GROUP BY 1) ORDER BY visitors DESC, events DESC, area LIMIT 25""")  # fmt: skip
def q_areas(s, sf):
    quarter = lambda first, n: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: first + i / 4))
    towns = s.range(1).select(quarter(25.0, 8).alias("to_latitude")).select("to_latitude", quarter(-100.0, 15).alias("to_longitude"), F.lit("South town").alias("place"))
    return search.areas(visitors.search_points(d.events(s, sf)), towns)


@query("q_user_agents", f"""SELECT c_custkey, ({_sql_array(['Phone', 'Desktop', 'Tablet', 'Unknown', 'Desktop'])})[c_custkey % 5 + 1] AS device,
    ({_sql_array(['Safari', 'Edge', 'Chrome', 'Unknown', 'Other'])})[c_custkey % 5 + 1] AS browser, ({_sql_array(['iOS', 'Windows', 'Android', 'Unknown', 'Other'])})[c_custkey % 5 + 1] AS os,
    c_custkey % 5 IN (3, 4) AS is_bot FROM customer""")  # fmt: skip
def q_user_agents(s, sf):
    agents = ["Mozilla/5.0 (iPhone; CPU iPhone OS 17_0) Version/17.0 Mobile Safari/604.1", "Mozilla/5.0 (Windows NT 10.0) Chrome/120.0 Safari/537.36 Edg/120.0",
              "Mozilla/5.0 (Linux; Android 13; SM-X200) Chrome/119.0 Safari/537.36", "", "curl/8.0"]
    a = d.table(s, sf, "customer").select("c_custkey", web.user_agent(_pick(agents, F.col("c_custkey"))).alias("a"))
    return a.select("c_custkey", "a.device", "a.browser", "a.os", "a.is_bot")


@query("q_client_events", "SELECT event_id FROM site WHERE name <> 'error'")
def q_client_events(s, sf):
    e = d.events(s, sf).withColumn("name", F.when(F.col("name") == "error", "unheard_of").otherwise(F.col("name")))
    return stream.accepted(e).select("event_id")


@query("q_event_details", """SELECT event_id, CASE WHEN subject % 2 = 0 THEN '{"item":"' || subject || '"}' END AS detail FROM site""")
def q_event_details(s, sf):
    detail = F.create_map(F.lit("item"), F.when(F.col("subject") % 2 == 0, F.col("subject").cast("string")).otherwise("  "), F.lit("note"), F.lit(None).cast("string"))
    return d.events(s, sf).select("event_id", stream.detail_json(detail).alias("detail"))


@query("q_salts", """SELECT DISTINCT day, CASE WHEN day = (SELECT max(day) FROM site) THEN sha256('fresh') ELSE 'known' END AS salt FROM site WHERE day >= strftime((SELECT max(day) FROM site)::DATE - 1, '%Y-%m-%d')""")
def q_salts(s, sf):
    days = d.events(s, sf).select("day").distinct()
    newest = days.agg(F.max("day").alias("n"))
    known = days.join(F.broadcast(newest), F.col("day") < F.col("n")).select("day", F.lit("known").alias("salt"))
    return stream.salts(s, known, days, fresh=lambda: F.sha2(F.lit("fresh").cast("binary"), 256))


# --- scalars ----------------------------------------------------------------------------------------------------------


@query("q_yearly_pay", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 45.5 * 2080 WHEN 1 THEN 100000 WHEN 2 THEN 1000 * 52 WHEN 3 THEN 2000 * 26 ELSE 5000 * 12 END::DOUBLE AS pay FROM part""")
def q_yearly_pay(s, sf):
    k = F.col("p_partkey")
    rate, unit = _pick(["$45.50", "100,000.00", "1000", "$2,000", "5000"], k), _pick(["Hour", "Year", " week ", "Bi-Weekly", "month"], k)
    return d.table(s, sf, "part").select("p_partkey", numbers.yearly_pay(rate, unit).alias("pay"))


@query("q_amounts", "SELECT p_partkey, ([1234.0, -500.0, 0.0, NULL, 12.5])[p_partkey % 5 + 1]::DOUBLE AS amount FROM part")
def q_amounts(s, sf):
    return d.table(s, sf, "part").select("p_partkey", text.amount(_pick(["$1,234 (a)", "(500)", "—", "n/a", "£12.50"], F.col("p_partkey"))).alias("amount"))


@query("q_calendar_quarters", """SELECT n_nationkey, y AS fiscal_year, y || '1,' || y || '2,' || y || '3,' || y || '4' AS codes FROM (SELECT n_nationkey, 2000 + n_nationkey AS y FROM nation)""")
def q_calendar_quarters(s, sf):
    """Years that end in December, and those of shops that end in January and count as the year before."""
    k = F.col("n_nationkey")
    start = F.when(k % 2 == 0, F.make_date(k + 2000, F.lit(1), F.lit(1))).otherwise(F.make_date(k + 2000, F.lit(2), F.lit(1)))
    end = F.when(k % 2 == 0, F.make_date(k + 2000, F.lit(12), F.lit(31))).otherwise(F.make_date(k + 2001, F.lit(1), F.lit(31)))
    codes = F.array_join(F.transform(facts.quarters_within(start, end), lambda c: c.cast("string")), ",")
    return d.table(s, sf, "nation").select("n_nationkey", facts.fiscal_year(end).alias("fiscal_year"), codes.alias("codes"))


@query("q_sentences", """SELECT c_custkey, 3 AS n, 'Mr. Smith of Acme Inc. met J. Doe.' AS first FROM customer""")
def q_sentences(s, sf):
    t = markup.sentences(_text("Mr. Smith of Acme Inc. met J. Doe. They paid $5.50 to No. ", F.col("c_custkey"), "! Then all went."))
    return d.table(s, sf, "customer").select("c_custkey", F.size(t).alias("n"), F.get(t, F.lit(0)).alias("first"))


@query("q_money", "SELECT p_partkey, p_size * 1e6::DOUBLE AS a, 2500.0::DOUBLE AS b, 3e9::DOUBLE AS c, p_size * 1000.0::DOUBLE AS d FROM part")
def q_money(s, sf):
    m = markup.money(_text("from $", F.col("p_size"), " million and $2,500 to $3bn, or $", F.col("p_size"), "k each, not 7 million"))
    return d.table(s, sf, "part").select("p_partkey", *[F.get(m, F.lit(i)).alias(n) for i, n in enumerate("abcd")])


@query("q_bonus_percent", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 75.0 END::DOUBLE AS percent FROM part")
def q_bonus_percent(s, sf):
    t = _pick(["a target annual bonus of 75% of salary", "a target bonus of 50% to 75%", "a target bonus of up to 60%", "a target bonus of 900%"], F.col("p_partkey"))
    return d.table(s, sf, "part").select("p_partkey", markup.bonus_percent(t).alias("percent"))


@query("q_without_totals", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 3 END AS n, (p_size * 3)::DOUBLE AS sum_left FROM part")
def q_without_totals(s, sf):
    x = F.col("p_size").cast("double")
    a = F.when(F.col("p_partkey") % 2 == 0, F.array(x * 3, x, x * 2)).otherwise(F.array(x / 2, x / 2, x * 2))
    left = markup.without_totals(a)
    return d.table(s, sf, "part").select("p_partkey", F.size(left).alias("n"), F.aggregate(left, F.lit(0.0), lambda p, q: p + q).alias("sum_left"))


@query("q_nearest_kind", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Bonus' ELSE 'Salary' END AS kind FROM part")
def q_nearest_kind(s, sf):
    clause = F.when(F.col("p_partkey") % 2 == 0, "salary will be set, and a bonus of $5").otherwise("a bonus is due later; base salary $5")
    kind = markup.nearest_kind(clause, F.regexp_instr(clause, F.lit(r"\$")), [("Salary", "salary"), ("Bonus", "bonus")])
    return d.table(s, sf, "part").select("p_partkey", kind.alias("kind"))


@query("q_statement_units", "SELECT p_partkey, ([1e6, 1e3, 1.0, NULL])[p_partkey % 4 + 1]::DOUBLE AS scale, (['AUD', 'USD', 'PKR', NULL])[p_partkey % 4 + 1] AS currency, ([2024, NULL])[p_partkey % 2 + 1] AS year FROM part")
def q_statement_units(s, sf):
    k = F.col("p_partkey")
    u = markup.statement_unit(_pick(["Amounts in A$ millions", "US$'000", "Rupees", "Notes"], k))
    return d.table(s, sf, "part").select("p_partkey", u["scale"].alias("scale"), u["currency"].alias("currency"), markup.column_years(_pick(["2024 2023", "page 2024"], k))["year"].alias("year"))


@query("q_labelled_rows", "SELECT p_partkey, 'Revenue from sales' AS label, p_size * 1000.0::DOUBLE AS a, -500.0::DOUBLE AS b FROM part")
def q_labelled_rows(s, sf):
    r = markup.labelled_row(_text("Revenue from sales 12 ", F.col("p_size"), ",000 (500)"))
    return d.table(s, sf, "part").select("p_partkey", r["label"].alias("label"), F.get(r["amounts"], F.lit(0)).alias("a"), F.get(r["amounts"], F.lit(1)).alias("b"))


@query("q_pay_ratio", "SELECT p_partkey, 50000.0::DOUBLE + p_size AS median, (50000.0::DOUBLE + p_size) * 200 AS ceo, 200.0::DOUBLE AS ratio FROM part")
def q_pay_ratio(s, sf):
    low = F.col("p_size") + 50000
    t = _text("Pay ratio. For 2024 our median employee earned $", low, " and the chief executive $", low * 200, "; the ratio is 200 to 1.")
    return d.table(s, sf, "part").select("p_partkey", markup.pay_ratio(t).alias("r")).select("p_partkey", "r.*")


# --- lines of filings -------------------------------------------------------------------------------------------------


@query("q_cells_by_gap", """SELECT n_regionkey AS id, 40::BIGINT AS line, (i >= 3)::BIGINT AS cell, string_agg(n_name, ' ' ORDER BY i) AS text FROM (
    SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation) GROUP BY ALL""")  # fmt: skip
def q_cells_by_gap(s, sf):
    """Five words of a line, with a wide gap before the fourth."""
    i = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    left = (i * 10 + F.when(i >= 3, 30).otherwise(0)).cast("double")
    words = d.table(s, sf, "nation").select(F.col("n_regionkey").alias("id"), left.alias("left"), (left + 8).alias("right"), F.lit(100.0).alias("bottom"), F.lit(10.0).alias("height"), F.col("n_name").alias("text"))
    return pages.cells_by_gap(words).select("id", "line", F.col("cell").cast("long").alias("cell"), "text")


def _lines(s, sf):
    """The orders of a customer as lines: a label stands in every third, every other is numeric."""
    k = F.col("o_orderkey")
    return d.table(s, sf, "orders").select(F.col("o_custkey").alias("id"), k.alias("n"), F.when(k % 3 == 0, _text("label ", k)).alias("label"), (k % 2 == 0).alias("numeric"), k.cast("string").alias("text"))


_LINES = """, lines AS (SELECT o_custkey AS id, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'label ' || o_orderkey END AS label, o_orderkey % 2 = 0 AS numeric, o_orderkey::VARCHAR AS text FROM orders)"""


@query("q_carried_labels", """SELECT id, n, coalesce(label, last_value(label IGNORE NULLS) OVER (PARTITION BY id, run ORDER BY n)) AS shown FROM (
    SELECT *, coalesce(sum(numeric::INT) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM lines)""", extra=_LINES)  # fmt: skip
def q_carried_labels(s, sf):
    return pages.carried_labels(_lines(s, sf)).select("id", "n", "shown")


@query("q_glued", """SELECT id, min(n) AS n, string_agg(text, ' ' ORDER BY n) AS text FROM (SELECT *, sum((NOT numeric)::INT) OVER (PARTITION BY id ORDER BY n) AS g FROM lines) GROUP BY id, g""", extra=_LINES)
def q_glued(s, sf):
    return pages.glued(_lines(s, sf))


@query("q_subjects", """SELECT id, n, last_value(label IGNORE NULLS) OVER (PARTITION BY id, run ORDER BY n) AS subject FROM (
    SELECT *, coalesce(sum((n % 7 = 0)::INT) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM lines)""", extra=_LINES)  # fmt: skip
def q_subjects(s, sf):
    lines = _lines(s, sf).withColumnRenamed("label", "person").withColumn("ends", F.col("n") % 7 == 0)
    return pages.subjects(lines).select("id", "n", "subject")


@query("q_confirmed_totals", "SELECT p_partkey, true AS first, p_size % 2 = 0 AS second FROM part")
def q_confirmed_totals(s, sf):
    x = F.col("p_size").cast("double") * 1000
    item = lambda v, t: F.struct(v.cast("double").alias("amount"), F.lit(t).alias("total"))
    off = F.when(F.col("p_size") % 2 == 0, x).otherwise(x * 2)
    ok = pages.confirmed_totals(F.array(item(x, False), item(x * 2, False), item(x * 3, True), item(x, False), item(off, True)))
    return d.table(s, sf, "part").select("p_partkey", F.get(ok, F.lit(2))["ok"].alias("first"), F.get(ok, F.lit(4))["ok"].alias("second"))


@query("q_filled_years", """SELECT company_id, year, revenue::DOUBLE AS revenue FROM (SELECT c_custkey AS company_id, y AS year, CASE WHEN y = 2000 THEN c_custkey + y ELSE c_custkey + 5 END AS revenue
    FROM customer, range(1998, 2001) a(y)) WHERE company_id > 0""")  # fmt: skip
def q_filled_years(s, sf):
    k = F.col("c_custkey")
    rows = d.table(s, sf, "customer").filter("c_custkey > 0").select(k.alias("company_id"), F.explode(F.array(F.lit(1999), F.lit(2000))).alias("report_year"))
    y = F.col("report_year")
    reports = rows.select("company_id", "report_year", F.lit("ifrs").alias("basis"), (F.col("company_id") + y).alias("revenue"), F.lit(1).alias("net_income"), (F.col("company_id") + 5).alias("prior_revenue"), F.lit(2).alias("prior_net"))
    other = reports.limit(0).unionByName(reports.withColumn("report_year", y - 10).withColumn("basis", F.lit("local")))
    out = pages.filled_years(reports.unionByName(other))
    return out.select("company_id", "year", F.col("revenue").cast("double").alias("revenue"))


@query("q_modal_columns", "SELECT r_regionkey AS id, 0::BIGINT AS n_table, 3::BIGINT AS columns FROM region")
def q_modal_columns(s, sf):
    html = _text("<table><tr><td>", F.col("r_name"), "</td></tr><tr><td>a</td><td>b</td><td>c</td></tr><tr><td colspan=2>d</td><td>e</td></tr></table>")
    return markup.modal_columns(markup.table_cells(d.table(s, sf, "region").withColumn("h", html), "r_regionkey", "h"))


# --- lookups and orders of single companies ---------------------------------------------------------------------------


@query("q_facets", "SELECT * FROM (SELECT company_id, ticker FROM companies) WHERE upper(ticker) IN ('T1', 'T11.L', 'T26.KA')")
def q_facets(s, sf):
    return sets.of_ids(d.companies(s, sf).select("company_id", "ticker"), "ticker", ["t1", "T11.l", "t26.ka"])


@query("q_location_order", "SELECT location_id, row_number() OVER (PARTITION BY company_id ORDER BY type <> 'Headquarters', city, location_id) AS place FROM locations")
def q_location_order(s, sf):
    order = [F.col("type") != "Headquarters", F.col("city"), F.col("location_id")]
    return sets.numbered(d.locations(d.companies(s, sf)), ["company_id"], order).select("location_id", F.col("place").cast("long").alias("place"))


@query("q_title_order", """SELECT company_id, title, place FROM (SELECT company_id, title, row_number() OVER (PARTITION BY company_id ORDER BY n DESC, lower(title), title) AS place FROM (
    SELECT company_id, title, count(*) AS n FROM filings GROUP BY 1, 2)) WHERE place <= 25""")  # fmt: skip
def q_title_order(s, sf):
    counts = d.filings(s, sf).groupBy("company_id", "title").agg(F.count("*").alias("n"))
    return sets.numbered(counts, ["company_id"], [F.desc("n"), F.lower("title"), F.col("title")], 25).select("company_id", "title", F.col("place").cast("long").alias("place"))


@query("q_second_pass", "SELECT c_custkey, c_nationkey::BIGINT AS lat FROM customer")
def q_second_pass(s, sf):
    k = F.col("c_nationkey")
    asked = d.table(s, sf, "customer").select("c_custkey", F.concat(k, F.lit(" Main St"), F.when(F.col("c_custkey") % 2 == 0, " Suite 5").otherwise("")).alias("street"))
    table = d.table(s, sf, "nation").select(F.concat("n_nationkey", F.lit(" Main St")).alias("street"), F.col("n_nationkey").cast("long").alias("lat"))
    return sets.second_pass(asked, table, "street", F.regexp_replace("street", r"(?i)\s+(suite|ste|floor|unit)\b.*$", ""), "lat").select("c_custkey", "lat")


@query("q_preferred_office", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Head' WHEN 1 THEN 'Registered' ELSE 'Both' END AS town FROM customer")
def q_preferred_office(s, sf):
    k = F.col("c_custkey")
    head, registered = F.when(k % 3 == 0, "Head").when(k % 3 == 2, "Both"), F.when(k % 3 == 1, "Registered").when(k % 3 == 2, "both")
    return d.table(s, sf, "customer").select("c_custkey", F.initcap(sets.preferred(head, registered, F.lower(head) != F.lower(registered))).alias("town"))


@query("q_newest_wins", "SELECT l_suppkey AS company_id, year(l_shipdate) AS year, max(l_orderkey) AS value FROM lineitem GROUP BY 1, 2")
def q_newest_wins(s, sf):
    """Each year of a supplier twice: in a filing of its newest concept, and in an older one of another."""
    rows = d.table(s, sf, "lineitem").groupBy(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("year")).agg(F.max("l_orderkey").alias("value"))
    kinds = F.explode(F.array(F.struct(F.lit(1).alias("filed"), F.lit("old").alias("concept"), F.lit(0).alias("off")), F.struct(F.lit(2).alias("filed"), F.lit("new").alias("concept"), F.lit(0).alias("off")),
                              F.struct(F.lit(1).alias("filed"), F.lit("new").alias("concept"), F.lit(7).alias("off"))))
    rows = rows.withColumn("k", kinds).select("company_id", "year", (F.col("value") - F.col("k.off")).alias("value"), "k.filed", "k.concept")
    return sets.newest_wins(rows, ["company_id", "year"], "filed", ["concept"]).select("company_id", "year", "value")


@query("q_unique_names", "SELECT s_suppkey AS row, CASE WHEN s_suppkey >= 4 THEN s_suppkey END AS person_id FROM supplier")
def q_unique_names(s, sf):
    k = F.col("s_suppkey")
    t = d.table(s, sf, "supplier")
    name = F.when(k < 4, _text("Twin ", k % 2)).otherwise(F.col("s_name"))
    people_ = t.select(name.alias("name"), k.alias("person_id"))
    return sets.unique_names(t.select(k.alias("row"), F.upper(name).alias("name")), people_, "name", "person_id").select("row", "person_id")


@query("q_not_shown_elsewhere", "SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def q_not_shown_elsewhere(s, sf):
    c = d.table(s, sf, "customer").select("c_custkey", companies.company_key(F.concat("c_name", F.lit(" Ltd."))).alias("key"))
    other = d.table(s, sf, "customer").filter("c_custkey % 3 = 0").select(companies.company_key(F.concat(F.upper("c_name"), F.lit(", Inc"))).alias("key"))
    return sets.without(c, other, ["key"]).select("c_custkey")


@query("q_best_filers", "SELECT c_mktsegment AS name, arg_max(c_custkey, (c_nationkey, -c_custkey)) AS filer FROM customer GROUP BY 1")
def q_best_filers(s, sf):
    f = d.table(s, sf, "customer").select(F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("filer"), F.col("c_nationkey").alias("filings"))
    return sets.best_of(f, ["name"], [-F.col("filings"), F.col("filer")]).select("name", "filer")


@query("q_plausible_pay", """SELECT s_suppkey FROM supplier WHERE CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 10000 BETWEEN 150000 AND 25000000 AND s_suppkey % 2 = 0 WHEN 1 THEN s_suppkey * 10000 >= 1000000 ELSE s_suppkey > 0 END""")
def q_plausible_pay(s, sf):
    k = F.col("s_suppkey")
    rows = d.table(s, sf, "supplier").select(k, F.when(k % 3 == 0, "uk").when(k % 3 == 1, "pk").otherwise("sec").alias("market"), (k * 10_000).cast("double").alias("total"),
                                             F.when(k % 4 == 0, k * 1000.0).otherwise(k * 1.0).alias("salary"), (k % 4 == 2).alias("verified"))
    return people.plausible_pay(rows).select("s_suppkey")


@query("q_report_years", "SELECT s_suppkey AS company_id, y AS year FROM supplier, range(1999, 2003) a(y)")
def q_report_years(s, sf):
    rows = d.table(s, sf, "supplier").select(F.col("s_suppkey").alias("company_id"), F.explode(F.sequence(F.lit(1990), F.lit(2010))).alias("year"))
    newest = rows.select("company_id", "year", F.lit(2001).alias("report_year"), F.lit("GBP").alias("currency"))
    return people.report_years(newest.unionByName(rows.select("company_id", "year", F.lit(1995).alias("report_year"), F.lit("USD").alias("currency")))).select("company_id", "year")


@query("q_listed", "SELECT company_id FROM stats JOIN (SELECT company_id, max(fiscal_year) AS newest FROM periods GROUP BY 1) USING (company_id) WHERE newest >= 1999 AND (company_id % 2 = 0 OR revenue_usd >= 300000)")
def q_listed(s, sf):
    newest = d.periods(s, sf).groupBy("company_id").agg(F.max("fiscal_year").alias("newest_year"))
    df = metrics.in_dollars(d.companies(s, sf), metrics.indicators(d.periods(s, sf))).join(newest, "company_id")
    return people.listed(df.withColumn("exchange", F.when(F.col("company_id") % 2 == 0, "NYSE").otherwise(" ")), 2001, 300_000).select("company_id")


@query("q_area_top_paid", "SELECT person_id, latest_pay FROM near WHERE is_current ORDER BY latest_pay DESC, person_id LIMIT 100", extra=",\n" + _NEAR)
def q_area_top_paid(s, sf):
    return people.area_top_paid(_near(s, sf)).select("person_id", "latest_pay")


@query("q_nearest_codes", f"""SELECT s_suppkey, code FROM (SELECT s.s_suppkey, c.code, row_number() OVER (PARTITION BY s.s_suppkey ORDER BY round(power(c.latitude - s.latitude, 2) + power((c.longitude - s.longitude) * cos(radians(s.latitude)), 2), 12), c.code) AS n,
    {MILES.format(a='s', b='c')} AS m FROM (SELECT s_suppkey, 25 + (s_suppkey * 41 % 2400)::DOUBLE / 100 AS latitude, -120 + (s_suppkey * 59 % 5000)::DOUBLE / 100 AS longitude FROM supplier) s,
    (SELECT 'C' || company_id AS code, latitude, longitude FROM companies) c) WHERE n = 1 AND m <= 15""")  # fmt: skip
def q_nearest_codes(s, sf):
    k = F.col("s_suppkey")
    points = d.table(s, sf, "supplier").select(k, (25 + (k * 41 % 2400).cast("double") / 100).alias("latitude"), (-120 + (k * 59 % 5000).cast("double") / 100).alias("longitude"))
    codes = d.companies(s, sf).select(_text("C", F.col("company_id")).alias("place"), F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"))
    return search.nearest_place(points, codes, "s_suppkey", 15).filter("place is not null").select("s_suppkey", F.col("place").alias("code"))


@query("q_table_rows", "SELECT c_nationkey AS id, c_name AS name, c_custkey::VARCHAR AS ticker FROM customer")
def q_table_rows(s, sf):
    """Members in the second table of a page, beside one without the headers."""
    row = _text("<tr><td>", F.col("c_custkey"), "</td><td>x</td><td><a href='#'>", F.col("c_name"), "</a></td></tr>")
    rows = d.table(s, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.array_join(F.collect_list(row), "").alias("rows"))
    html = _text("<table><tr><td>a</td></tr></table><table><tr><th>Ticker</th><th>Sector</th><th>Company</th></tr>", F.col("rows"), "</table>")
    cells = markup.table_cells(rows.withColumn("h", html), "id", "h")
    return markup.table_rows(cells, {"name": "company", "ticker": "ticker"}).select("id", "name", "ticker")


@query("q_overlaid", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS latitude FROM supplier")
def q_overlaid(s, sf):
    k = F.col("s_suppkey")
    rows = d.table(s, sf, "supplier").select(k, F.lit("1 Main St").alias("street"), F.lit(1.0).alias("latitude"))
    found = rows.select(k, F.when(k % 3 == 0, "1 Main St").otherwise("old street").alias("street"), F.lit(2.0).alias("latitude"))
    return sets.overlaid(rows, found, "s_suppkey", "street", ["latitude"]).select("s_suppkey", "latitude")


@query("q_filing_urls", "SELECT o_orderkey, 'https://filings.xbrl.org/' || o_custkey AS url FROM orders")
def q_filing_urls(s, sf):
    o = d.table(s, sf, "orders")
    dictionary = o.select("o_custkey").distinct().select("o_custkey", companies.expanded(_text("~xbrl/", F.col("o_custkey"))).alias("url"))
    return o.select("o_orderkey", "o_custkey").join(dictionary, "o_custkey", "left").select("o_orderkey", "url")


@query("q_unit_factors", "SELECT s_suppkey, (CASE WHEN s_suppkey % 2 = 0 THEN 1000 ELSE 1 END)::INTEGER AS factor FROM supplier")
def q_unit_factors(s, sf):
    k = F.col("s_suppkey")
    net = F.when(k % 2 == 0, 5.0).otherwise(5000.0)
    return d.table(s, sf, "supplier").select(k, numbers.unit_factor(net * 10, net, F.lit(2.5), F.lit(2000.0), F.lit(1e6)).alias("factor"))


@query("q_last_days", "SELECT event_id FROM site WHERE day >= '2024-01-24'")
def q_last_days(s, sf):
    first, last = numbers.last_days(7, F.lit("2024-01-30").cast("date"))
    return d.events(s, sf).filter(F.to_date("day").between(first, last)).select("event_id")
