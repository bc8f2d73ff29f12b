"""The registered queries: each operator over whole tables, beside the same result in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import companies, text, web
from ..operators import markup, metrics, people, quality, salaries, search, visitors
from ..sources import directory as d
from ..sources.stored import stored
from .catalogue import ORACLE_SQL, QUERIES
from .catalogue import query as _query
from .sql import MILES, USD

AS_OF = 2001
POINT = (40.3916, -111.8508, 250.0)
DAYS = ("2024-01-03", "2024-01-20")


def _stats(s, sf):
    return metrics.in_dollars(d.companies(s, sf), metrics.indicators(d.periods(s, sf)))


def _found(s, sf):
    c = d.companies(s, sf)
    hits = search.near(d.locations(c), *POINT)
    return search.results(hits, c, metrics.indicators(d.periods(s, sf, hits)))


@_query("q_indicators", "SELECT * FROM indicators")
def q_indicators(s, sf):
    return metrics.indicators(d.periods(s, sf))


@_query("q_yoy_growth", "SELECT company_id, period_type, fiscal_year, fiscal_quarter, revenue::DOUBLE AS revenue, growth FROM grown")
def q_yoy_growth(s, sf):
    return metrics.with_growth(d.periods(s, sf)).select("company_id", "period_type", "fiscal_year", "fiscal_quarter", F.col("revenue").cast("double").alias("revenue"), "growth")


@_query("q_history", """SELECT company_id, period_type, CASE WHEN fiscal_quarter IS NULL THEN 'FY ' || fiscal_year ELSE 'Q' || fiscal_quarter || ' ' || fiscal_year END AS label,
    fiscal_year * 10 + coalesce(fiscal_quarter, 0) AS sort_key, revenue::DOUBLE AS revenue, net_income::DOUBLE AS net_income, growth
    FROM (SELECT *, max(fiscal_year) OVER (PARTITION BY company_id) AS newest FROM grown) WHERE fiscal_year > newest - 3""")  # fmt: skip
def q_history(s, sf):
    return metrics.history(d.periods(s, sf), 3)


@_query("q_growth_streak", """SELECT company_id, CASE WHEN s > 0 THEN 'Up' ELSE 'Down' END AS direction, length, period_type AS unit FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY period_type DESC) AS turn FROM (
        SELECT company_id, period_type, max(first) AS s, coalesce(min(n) FILTER (s IS NULL OR s <> first), count(*) + 1) - 1 AS length
        FROM (SELECT *, sign(growth) AS s, row_number() OVER w AS n, first_value(sign(growth)) OVER w AS first FROM grown
              WINDOW w AS (PARTITION BY company_id, period_type ORDER BY fiscal_year * 10 + coalesce(fiscal_quarter, 0) DESC))
        GROUP BY 1, 2) WHERE s <> 0) WHERE turn = 1 AND length >= 3""")  # fmt: skip
def q_growth_streak(s, sf):
    return metrics.streaks(d.periods(s, sf))


@_query("q_records", """SELECT company_id, max(fiscal_year) FILTER (b = 1) AS best_year, max(revenue) FILTER (b = 1)::DOUBLE AS best_revenue,
    max(fiscal_year) FILTER (b = 1) = max(fiscal_year) AS is_latest, count(*) FILTER (net_income > 0) AS profitable_years, count(*) AS years
    FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY revenue DESC, fiscal_year) AS b FROM numbered
          WHERE period_type = 'Annual' AND n <= 10) GROUP BY company_id HAVING count(*) >= 3""")  # fmt: skip
def q_records(s, sf):
    return metrics.records(d.periods(s, sf))


def _rank_sql(within: str) -> str:
    return f"""SELECT * FROM (SELECT company_id, {within}, row_number() OVER (PARTITION BY {within} ORDER BY revenue_usd DESC, company_id) AS place,
        count(*) OVER (PARTITION BY {within}) AS place_of FROM stats WHERE revenue_usd > 0) WHERE place_of >= 3"""


@_query("q_rank_sector", _rank_sql("sector"))
def q_rank_sector(s, sf):
    return metrics.ranks(_stats(s, sf), ["sector"])


@_query("q_rank_city", _rank_sql("city, state"))
def q_rank_city(s, sf):
    return metrics.ranks(_stats(s, sf), ["city", "state"])


@_query("q_margin_vs_sector", """SELECT company_id, s.sector, margin, sector_margin, sector_companies FROM stats s JOIN (
    SELECT sector, round_even(median(margin), 4) AS sector_margin, count(*) AS sector_companies FROM stats WHERE ttm_revenue > 0 AND margin IS NOT NULL
    GROUP BY 1 HAVING count(*) >= 5) m ON s.sector = m.sector WHERE ttm_revenue > 0 AND margin IS NOT NULL""")  # fmt: skip
def q_margin_vs_sector(s, sf):
    return metrics.margin_against_sector(_stats(s, sf))


@_query("q_per_head", """SELECT company_id, CASE WHEN employees > 0 AND ttm_revenue > 0 THEN round_even(ttm_revenue / employees, 0) END AS per_employee,
    round_even(greatest(0, ttm_revenue) / 31557600, 2) AS per_second FROM stats""")  # fmt: skip
def q_per_head(s, sf):
    return metrics.per_head(_stats(s, sf))


@_query("q_companies_near", "SELECT * FROM found")
def q_companies_near(s, sf):
    return _found(s, sf)


@_query("q_near_summary", f"""SELECT count(*) AS companies, sum(CASE WHEN currency = main THEN ttm_revenue ELSE round_even(ttm_revenue * {USD} / main_rate, 0) END) AS revenue,
    count(*) FILTER (trend = 'Up') AS growing, count(*) FILTER (has_hq) AS based_here, max(main) AS currency, bool_or(currency <> main) AS mixed
    FROM found, (SELECT currency AS main, {USD} AS main_rate FROM (SELECT currency, count(*) AS n FROM found GROUP BY 1) ORDER BY n DESC, currency LIMIT 1)""")  # fmt: skip
def q_near_summary(s, sf):
    out = search.summary(_found(s, sf))
    return out.withColumn("revenue", F.bround("revenue", 2))


ORACLE_SQL["q_near_summary"] = ORACLE_SQL["q_near_summary"].replace("sum(CASE WHEN currency = main", "round_even(sum(CASE WHEN currency = main").replace("/ main_rate, 0) END) AS revenue", "/ main_rate, 0) END), 2) AS revenue")

for _sort, _key in (("Revenue", f"ttm_revenue * {USD}"), ("Profit", f"ttm_net * {USD}"), ("Growth", "growth"), ("Distance", "miles")):
    for _reverse in (False, True):
        _up = (_sort == "Distance") != _reverse

        def _page(s, sf, sort=_sort, reverse=_reverse):
            return search.page(_found(s, sf), search.order(sort, reverse), 2, 20).select("ticker", F.col("place").cast("long").alias("place"))

        _query(f"q_page_{_sort.lower()}{'_reversed' if _reverse else ''}", f"""SELECT ticker, place FROM (
            SELECT ticker, row_number() OVER (ORDER BY {_key} {'ASC' if _up else 'DESC'} NULLS LAST, ticker) AS place FROM found) WHERE place BETWEEN 21 AND 40""")(_page)  # fmt: skip


@_query("q_region", """SELECT company_id, location_id, latitude, longitude, has_hq FROM (SELECT *, row_number() OVER (PARTITION BY company_id
    ORDER BY type <> 'Headquarters', type, location_id) AS n, bool_or(type = 'Headquarters') OVER (PARTITION BY company_id) AS has_hq
    FROM locations WHERE state = 'EUROPE') WHERE n = 1""")  # fmt: skip
def q_region(s, sf):
    return search.in_region(d.locations(d.companies(s, sf)), "EUROPE")


@_query("q_region_centre", """SELECT coalesce(round_even(avg(latitude), 3), 0) AS latitude, coalesce(round_even(avg(longitude), 3), 0) AS longitude,
    count(*) AS companies FROM locations WHERE state = 'ASIA' AND type = 'Headquarters'""")  # fmt: skip
def q_region_centre(s, sf):
    return search.centre(search.in_region(d.locations(d.companies(s, sf)), "ASIA"))


def _towns(s, sf):
    key = F.col("s_suppkey")
    return d.table(s, sf, "supplier").select(F.col("s_name").alias("place"), (25 + (key * 41 % 2400).cast("double") / 100).alias("to_latitude"),
                                             (-120 + (key * 59 % 5000).cast("double") / 100).alias("to_longitude"))


_TOWNS = "SELECT s_name AS place, 25 + (s_suppkey * 41 % 2400)::DOUBLE / 100 AS latitude, -120 + (s_suppkey * 59 % 5000)::DOUBLE / 100 AS longitude FROM supplier"


@_query("q_nearest_place", f"""SELECT company_id, place, round_even(m, 2) AS miles FROM companies LEFT JOIN (SELECT * FROM (
    SELECT company_id, place, m, row_number() OVER (PARTITION BY company_id ORDER BY round(flat, 12), place) AS n FROM (
        SELECT c.company_id, t.place, {MILES.format(a='c', b='t')} AS m, power(t.latitude - c.latitude, 2) + power((t.longitude - c.longitude) * cos(radians(c.latitude)), 2) AS flat
        FROM companies c, ({_TOWNS}) t)) WHERE n = 1 AND m <= 60) USING (company_id)""")  # fmt: skip
def q_nearest_place(s, sf):
    points = d.companies(s, sf).select("company_id", "latitude", "longitude")
    return search.nearest_place(points, _towns(s, sf), "company_id", 60.0).select("company_id", "place", "miles")


_PAIRS = f"SELECT c.company_id, t.company_id AS other_id, c.sector = t.sector AS same, t.revenue_usd, {MILES.format(a='c', b='t')} AS m FROM stats c JOIN stats t ON c.company_id <> t.company_id AND t.ttm_revenue > 0"


@_query("q_similar", f"""SELECT company_id, other_id, round_even(m, 1) AS miles, kind AS same_sector, place FROM (
    SELECT *, count(*) FILTER (kind AND place <= 5) OVER (PARTITION BY company_id) >= 2 AS enough FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id, kind ORDER BY round_even(m, 0), revenue_usd DESC, other_id) AS place FROM (
            SELECT *, true AS kind FROM ({_PAIRS}) WHERE same AND m <= 100 UNION ALL SELECT *, false FROM ({_PAIRS}) WHERE m <= 25)))
    WHERE place <= 5 AND kind = enough""")  # fmt: skip
def q_similar(s, sf):
    return search.similar(_stats(s, sf))


@_query("q_metro", f"""SELECT company_id, CASE WHEN {MILES.format(a='c', b='a')} <= 120 THEN 'Mountain' WHEN {MILES.format(a='c', b='b')} <= 200 THEN 'Plains'
    WHEN c.state = 'ASIA' THEN 'Far East' ELSE 'Elsewhere' END AS metro FROM companies c, (SELECT 40.0::DOUBLE AS latitude, -111.0::DOUBLE AS longitude) a,
    (SELECT 38.0::DOUBLE AS latitude, -98.0::DOUBLE AS longitude) b""")  # fmt: skip
def q_metro(s, sf):
    circles = [("Mountain", 40.0, -111.0, 120.0), ("Plains", 38.0, -98.0, 200.0)]
    return search.metro(d.companies(s, sf), circles, {"ASIA": "Far East"}, "Elsewhere").select("company_id", "metro")


@_query("q_postcode_fallback", """SELECT id, country, code, tier, known, place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, gap, known, place) AS n FROM (
    SELECT a.id, a.country, a.code, k.known, k.place, abs(a.code::BIGINT - k.known::BIGINT) AS gap,
           CAST(CASE WHEN a.code = k.known THEN 0 WHEN a.code[1:3] = k.known[1:3] THEN 1 WHEN a.code[1:2] = k.known[1:2] THEN 2 END AS INTEGER) AS tier
    FROM (SELECT c_custkey AS id, c_nationkey % 3 AS country, lpad((c_custkey * 7919 % 100000)::VARCHAR, 5, '0') AS code FROM customer) a
    LEFT JOIN (SELECT DISTINCT s_nationkey % 3 AS country, lpad((s_suppkey * 104729 % 100000)::VARCHAR, 5, '0') AS known, s_name AS place FROM supplier) k
    ON a.country = k.country AND a.code[1:2] = k.known[1:2])) WHERE n = 1""")  # fmt: skip
def q_postcode_fallback(s, sf):
    code = lambda key, by: F.lpad((F.col(key) * by % 100000).cast("string"), 5, "0")
    asked = d.table(s, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 3).alias("country"), code("c_custkey", 7919).alias("code"))
    known = d.table(s, sf, "supplier").select((F.col("s_nationkey") % 3).alias("country"), code("s_suppkey", 104729).alias("known"), F.col("s_name").alias("place"))
    return search.located_codes(asked, known.distinct())


@_query("q_company_people", """SELECT company_id, person_id, max(title) AS title,
    '[' || string_agg('{"year":' || year || ',"total":' || trunc(total)::BIGINT || '}', ',' ORDER BY year) || ']' AS years FROM pay GROUP BY 1, 2""")  # fmt: skip
def q_company_people(s, sf):
    return people.company_people(d.pay(s, sf))


_LOCAL = "SELECT * FROM pay WHERE person_id IN (SELECT person_id FROM pay WHERE company_id IN (SELECT company_id FROM nearest))"


@_query("q_people_near", f"""SELECT * FROM (SELECT person_id, any_value(name) AS name, arg_max(title, (year, -total, company_id)) FILTER (here) AS title,
        arg_max(company_id, (year, -total, company_id)) FILTER (here) AS company_id, arg_max(here, (year, -total, company_id)) AS is_current,
        max(year) AS latest_year, sum(total) FILTER (year = last)::DOUBLE AS latest_pay,
        CASE WHEN sum(total) FILTER (year = last - 1) > 0 AND last - 1 > newest - 3
             THEN round_even(sum(total) FILTER (year = last)::DOUBLE / sum(total) FILTER (year = last - 1)::DOUBLE - 1, 4) END AS growth,
        sum(total) FILTER (year > newest - 3)::DOUBLE AS window_pay, count(DISTINCT year) FILTER (year > newest - 3) AS years_paid,
        count(DISTINCT company_id) FILTER (year > newest - 3) AS companies
    FROM (SELECT *, company_id IN (SELECT company_id FROM nearest) AS here, max(year) OVER (PARTITION BY person_id) AS last,
                 least(max(year) OVER (), 2001) AS newest FROM ({_LOCAL})) GROUP BY person_id, last, newest) WHERE years_paid > 0""")  # fmt: skip
def q_people_near(s, sf):
    near = search.near(d.locations(d.companies(s, sf)), *POINT)
    return people.people_near(d.pay(s, sf), near, 3, AS_OF)


@_query("q_careers", """SELECT person_id, company_id, min(year) AS from_year, max(year) AS to_year, arg_max(title, n) AS title, sum(total)::DOUBLE AS total FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY person_id ORDER BY n) AS role FROM (
        SELECT *, row_number() OVER w AS n, CASE WHEN lag(company_id) OVER w = company_id AND year <= lag(year) OVER w + 1 THEN 0 ELSE 1 END AS fresh
        FROM pay WINDOW w AS (PARTITION BY person_id ORDER BY year, total DESC, company_id))) GROUP BY person_id, company_id, role""")  # fmt: skip
def q_careers(s, sf):
    return people.careers(d.pay(s, sf))


@_query("q_career_totals", "SELECT person_id, min(year) AS first_year, max(year) AS last_year, count(DISTINCT year) AS years, sum(total)::DOUBLE AS total FROM pay GROUP BY 1")
def q_career_totals(s, sf):
    return people.career_totals(d.pay(s, sf))


@_query("q_top_paid", "SELECT person_id, name, title, ticker, year, total::DOUBLE AS total, currency, role FROM chiefs ORDER BY usd DESC, company_id, person_id LIMIT 100")
def q_top_paid(s, sf):
    return people.top_paid(d.pay(s, sf), d.companies(s, sf), AS_OF)


@_query("q_company_pay", "SELECT company_id, year, role, top_pay, other_median, ticker, sector, market, currency, revenue_usd FROM companies_pay")
def q_company_pay(s, sf):
    return people.pay_of_companies(d.pay(s, sf), _stats(s, sf), AS_OF)


@_query("q_peer_pay", """SELECT company_id, top_pay, peers, lower, round_even(lower * 100.0::DOUBLE / peers, 0)::BIGINT AS percentile FROM (
    SELECT company_id, top_pay, count(*) AS peers, count(*) FILTER (amount < top_pay) AS lower FROM peers
    WHERE CASE WHEN banded >= 20 THEN inside ELSE near <= 20 END GROUP BY 1, 2) WHERE peers >= 5""")  # fmt: skip
def q_peer_pay(s, sf):
    return people.peer_pay(people.pay_of_companies(d.pay(s, sf), _stats(s, sf), AS_OF))


@_query("q_peers_listed", """SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY raw DESC, ticker) AS place, ticker, round_even(raw, 0) AS amount, is_self
    FROM (SELECT company_id, peer AS ticker, amount AS raw, false AS is_self FROM peers WHERE near <= 8
          UNION ALL SELECT company_id, ticker, top_pay, true FROM companies_pay WHERE company_id IN (SELECT company_id FROM peers))""")  # fmt: skip
def q_peers_listed(s, sf):
    return people.peers_listed(people.pay_of_companies(d.pay(s, sf), _stats(s, sf), AS_OF))


@_query("q_pay_vs_results", """SELECT company_id, person_id, year, round_even(total::DOUBLE / prior - 1, 4) AS pay_change, round_even(revenue / last_revenue - 1, 4) AS revenue_change
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY usd DESC, person_id) AS n FROM chiefs) WHERE n = 1 AND role = 'CEO')
    JOIN (SELECT company_id, person_id, year + 1 AS year, sum(total)::DOUBLE AS prior FROM pay GROUP BY ALL) USING (company_id, person_id, year)
    JOIN (SELECT company_id, fiscal_year AS year, revenue::DOUBLE AS revenue FROM periods WHERE period_type = 'Annual') USING (company_id, year)
    JOIN (SELECT company_id, fiscal_year + 1 AS year, revenue::DOUBLE AS last_revenue FROM periods WHERE period_type = 'Annual') USING (company_id, year)
    WHERE prior > 0 AND last_revenue > 0""")  # fmt: skip
def q_pay_vs_results(s, sf):
    return people.pay_against_results(d.pay(s, sf), d.companies(s, sf), d.periods(s, sf), AS_OF)


@_query("q_roles", """SELECT person_id, title = 'Chief Executive Officer' AS ceo, title = 'Chief Financial Officer' AS cfo, false AS coo,
    title = 'General Counsel' AS legal, title = 'Executive Director' AS other FROM (SELECT DISTINCT person_id, title FROM pay)""")  # fmt: skip
def q_roles(s, sf):
    t = F.col("title")
    roles = {"ceo": "Ceo", "cfo": "Cfo", "coo": "Coo", "legal": "Legal", "other": "Other"}
    return d.pay(s, sf).select("person_id", "title").distinct().select("person_id", *[text.holds_role(t, r).alias(n) for n, r in roles.items()])


@_query("q_name_search", """SELECT company_id, name, CASE WHEN n = 'cust 00000001' THEN 95 WHEN starts_with(n, 'cust 00000001') THEN 80 ELSE 60 END AS score FROM (
    SELECT *, trim(regexp_replace(strip_accents(lower(name)), '[^a-z0-9]+', ' ', 'g')) AS n FROM stats)
    WHERE n LIKE 'cust%' AND n LIKE '% 00000001%' ORDER BY 3 DESC, revenue_usd DESC, name LIMIT 20""")  # fmt: skip
def q_name_search(s, sf):
    df = _stats(s, sf).withColumn("score", text.name_score(text.search_name(F.col("name")), "cust 00000001", F.col("ticker"))).filter("score > 0")
    return df.orderBy(F.desc("score"), F.desc("revenue_usd"), "name").limit(20).select("company_id", "name", "score")


@_query("q_accent_search", "SELECT doc_id, source FROM documents WHERE contains(strip_accents(lower(text)), 'reeau')")
def q_accent_search(s, sf):
    found = F.contains(F.collate("text", "UNICODE_CI_AI"), F.collate(F.lit("réEau"), "UNICODE_CI_AI"))
    return d.table(s, sf, "documents").filter(found).select("doc_id", "source")


@_query("q_job_keys", """SELECT DISTINCT 'Sr. ' || p_name || ' Engr (' || p_brand || ') - JR' || p_size AS title, 'senior ' || p_name || ' engineer' AS key FROM part""")
def q_job_keys(s, sf):
    t = F.concat(F.lit("Sr. "), "p_name", F.lit(" Engr ("), "p_brand", F.lit(") - JR"), "p_size")
    return d.table(s, sf, "part").select(t.alias("title")).distinct().select("title", text.job_key(F.col("title")).alias("key"))


@_query("q_employers", """SELECT c_custkey AS company_id, (['ein', 'name', 'subsidiary', 'alias'])[c_custkey % 4 + 1] AS how FROM customer""")
def q_employers(s, sf):
    k = F.col("c_custkey")
    c = d.table(s, sf, "customer")
    end = F.when(k % 4 == 1, " Holdings, Inc.").when(k % 4 == 2, " Services LLC").otherwise(" elsewhere")
    start = F.when(k % 4 == 3, F.concat(F.lit("Trading as "), k)).when(k % 4 == 0, F.concat(F.lit("Other "), k)).otherwise(F.concat(F.lit("The "), "c_name"))
    ein = F.when(k % 4 == 0, F.format_string("%02d-%07d", F.lit(1), k))
    employers = c.select(F.concat(start, end).alias("employer"), ein.alias("ein"))
    aliases = c.filter("c_custkey % 4 = 3").select(F.concat(F.lit("trading as "), k, F.lit(" elsewhere")).alias("alias"), k.alias("company_id"))
    numbers_ = c.select(F.format_string("%09d", k + 10_000_000).alias("ein"), k.alias("company_id"))
    return salaries.matched_employers(employers, d.companies(s, sf).select("company_id", "name"), aliases, numbers_).select("company_id", "how")


@_query("q_filing_reasons", """SELECT CASE WHEN l_linenumber = 2 THEN 'not certified' WHEN l_linenumber = 3 THEN 'part time' WHEN l_linenumber = 4 THEN 'implausible pay' WHEN l_linenumber = 5 THEN 'no title' ELSE 'none' END AS value,
    count(*) AS rows FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1
    UNION ALL SELECT 'repeated', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem""")  # fmt: skip
def q_filing_reasons(s, sf):
    n = F.col("l_linenumber")
    f = d.table(s, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", n).alias("case_number"), F.when(n == 2, "Withdrawn").otherwise("CERTIFIED").alias("status"), F.when(n == 3, "N").otherwise("Y").alias("full_time"), F.lit("e").alias("employer"),
        F.when(n == 5, "(#12)").otherwise("Engineer").alias("title"), F.when(n == 4, "5").otherwise("$90,000").alias("rate"), F.lit("Year").alias("unit"))
    return salaries.counters(salaries.eligible_filings(f), "reason")


@_query("q_unmatched", "SELECT 'Nobody ' || c_nationkey AS employer, count(*) AS rows FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def q_unmatched(s, sf):
    e = d.table(s, sf, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Nobody "), "c_nationkey")).otherwise(F.col("c_name")).alias("employer"))
    none = s.createDataFrame([], "alias string, company_id long")
    return salaries.unmatched(salaries.matched_employers(e, d.companies(s, sf).select("company_id", "name"), none), 10)


_SALARY = """count(*) AS filings, min(salary) AS low, round_even(quantile_cont(salary, 0.25), 0) AS p25, round_even(quantile_cont(salary, 0.5), 0) AS p50,
    round_even(quantile_cont(salary, 0.75), 0) AS p75, max(salary) AS high FROM filings"""


def _titles(s, sf):
    return d.table(s, sf, "part").select(F.col("p_name").alias("title"))


@_query("q_salaries", f"""SELECT company_id, title, NULL AS city, NULL AS state, {_SALARY} GROUP BY company_id, title HAVING count(*) >= 3
    UNION ALL SELECT company_id, title, city, state, {_SALARY} GROUP BY company_id, title, city, state HAVING count(*) >= 3""")  # fmt: skip
def q_salaries(s, sf):
    return salaries.by_title_and_place(d.filings(s, sf), titles=_titles(s, sf))


@_query("q_titles_with_places", """SELECT company_id, title, filings, places FROM (SELECT company_id, title, count(*) AS filings FROM filings GROUP BY 1, 2 HAVING count(*) >= 3) LEFT JOIN (
    SELECT company_id, title, '[' || string_agg('{"city":"' || city || '","filings":' || c || '}', ',' ORDER BY c DESC, city) || ']' AS places FROM (
        SELECT company_id, title, city, count(*) AS c FROM filings GROUP BY 1, 2, 3 HAVING count(*) >= 3) GROUP BY 1, 2) USING (company_id, title) WHERE contains(title, 'blue') AND contains(title, 'bolt')""")  # fmt: skip
def q_titles_with_places(s, sf):
    found = salaries.by_title_and_place(d.filings(s, sf), titles=_titles(s, sf), holding="Bolt blue")
    return salaries.titles_with_places(stored(found.select("company_id", "title", "city", "filings")))


@_query("q_sectors", """SELECT p_partkey, (['Semiconductors', 'Healthcare', 'Finance', 'Other', 'Industrials'])[p_partkey % 5 + 1] AS by_code, (['Finance', 'Media & telecom', 'Other'])[p_partkey % 3 + 1] AS by_name FROM part""")
def q_sectors(s, sf):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values)).cast("int"))
    return d.table(s, sf, "part").select("p_partkey", companies.sector_of_code(pick([3674, 5122, 6100, None, 3000])).alias("by_code"), companies.sector_of_name(pick(["Retail Banks", "Telecom", None])).alias("by_name"))


@_query("q_addresses", """SELECT c_custkey, '~sec/' || c_custkey AS short, 'https://www.sec.gov/Archives/edgar/data/' || c_custkey AS long, 'mary-jones' || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '-smith' END AS person,
    true AS same, c_custkey % 2 = 0 AS mentioned, CASE WHEN c_custkey % 2 = 0 THEN 'NYSE:BRK.B' END AS symbol, (['greenhouse', 'lever', 'workday', NULL])[c_custkey % 4 + 1] AS system, (['acme', 'acme', 'acme/Ext', NULL])[c_custkey % 4 + 1] AS board FROM customer""")  # fmt: skip
def q_addresses(s, sf):
    k = F.col("c_custkey")
    pick = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % len(values)).cast("int"))
    full = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), k)
    board = companies.job_board(pick("https://boards.greenhouse.io/embed/job_board?for=Acme", "https://jobs.lever.co/acme/12", "https://acme.wd5.myworkdayjobs.com/en-US/Ext/job/1", "https://acme.com/jobs"))
    return d.table(s, sf, "customer").select(
        "c_custkey", companies.shortened(full).alias("short"), companies.expanded(companies.shortened(full)).alias("long"),
        companies.person_key(F.when(k % 2 == 0, "Mary T. Jones, Jr.").otherwise("Mary Jones-Smith III")).alias("person"),
        companies.same_name(F.lit("Analog Devices, Inc."), F.lit("AnalogDevices")).alias("same"), companies.mentions(pick("Work at Analog  Devices!", "an analog job"), F.lit("Analog Devices Inc")).alias("mentioned"),
        companies.price_symbol(F.lit("BRK-B"), pick("NYSE", "LSE"), {"NYSE": "NYSE"}).alias("symbol"), board["system"].alias("system"), board["board"].alias("board"))


@_query("q_filtered_search", "SELECT company_id FROM found WHERE has_hq AND upper(sector) = 'BUILDING'")
def q_filtered_search(s, sf):
    c = d.companies(s, sf)
    hits = search.near(d.locations(c), *POINT)
    return search.results(hits, c, metrics.indicators(d.periods(s, sf, hits)), " building ", True).select("company_id")


@_query("q_spellings", "SELECT title AS key, title, count(*) AS filings FROM filings GROUP BY 1, 2")
def q_spellings(s, sf):
    return salaries.spellings(d.filings(s, sf))


_ADS = """count(*) AS ads, min(salary) AS low, round_even(median(salary), 0) AS p25, round_even(median((salary + salary * 1.5::DOUBLE) / 2), 0) AS p50,
    round_even(median(salary * 1.5::DOUBLE), 0) AS p75, max(salary * 1.5::DOUBLE) AS high FROM filings"""


@_query("q_ads", f"SELECT company_id, title, NULL AS city, {_ADS} GROUP BY 1, 2 UNION ALL SELECT company_id, title, city, {_ADS} GROUP BY 1, 2, 3")
def q_ads(s, sf):
    ads = d.filings(s, sf).select("company_id", "title", "city", F.col("salary").alias("pay_min"), (F.col("salary") * 1.5).alias("pay_max"))
    return salaries.ads(ads, d.table(s, sf, "part").select(F.col("p_name").alias("title")))


@_query("q_pay_text", """SELECT p_partkey, ((p_size + 20) * 2080)::DOUBLE AS pay_min, ((p_size + 30) * 2080)::DOUBLE AS pay_max FROM part""")
def q_pay_text(s, sf):
    low, high = F.col("p_size") + 20, F.col("p_size") + 30
    ad = F.concat(F.lit("A bonus of $500. Pay: $"), low, F.lit(".00 - $"), high, F.lit(".00 per hour, "), "p_name")
    df = d.table(s, sf, "part").select("p_partkey", markup.pay_range(ad).alias("r"))
    return df.select("p_partkey", "r.pay_min", "r.pay_max")


@_query("q_table_cells", """SELECT r_regionkey::BIGINT AS id, 0::BIGINT AS n_table, n::BIGINT AS row, c::BIGINT AS first_column, c::BIGINT AS last_column,
    CASE WHEN n = 0 AND c = 0 THEN r_name WHEN n = 0 THEN 'key & no.' WHEN c = 1 THEN r_regionkey::VARCHAR END AS text
    FROM region, (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 1)) v(n, c))""")  # fmt: skip
def q_table_cells(s, sf):
    r = d.table(s, sf, "region")
    table = F.concat(F.lit("<table><tr><th rowspan=2>"), "r_name", F.lit("</th><td>key &amp;&nbsp;<b>no.</b></td></tr><tr><td>"), "r_regionkey", F.lit("</td></tr></table>"))
    return markup.table_cells(r.select(F.col("r_regionkey").cast("long").alias("key"), table.alias("html")), "key", "html")


@_query("q_links", r"""SELECT page_id AS id, place::BIGINT AS place, href, trim(regexp_replace(t, '<[^>]+>', ' ', 'g')) AS text,
    (5 * contains(b, 'report')::INT + 3 * contains(b, 'annual')::INT + contains(b, 'the')::INT)::BIGINT AS score FROM (
    SELECT *, lower(trim(regexp_replace(t, '<[^>]+>', ' ', 'g')) || ' ' || href) AS b FROM (
        SELECT page_id, generate_subscripts(h, 1) - 1 AS place, unnest(h) AS href, unnest(x) AS t FROM (
            SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h,
                   regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 2) AS x FROM pages)))""")
def q_links(s, sf):
    df = markup.links(d.table(s, sf, "pages"), "page_id", "html")
    return df.withColumn("score", markup.link_score(F.col("href"), F.col("text"), {"report": 5, "annual": 3, "the": 1}))


def _decoded(x: str) -> str:
    for entity, mark in (("&nbsp;", "chr(160)"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"), ("&#39;", "chr(39)"), ("&amp;", "chr(1)")):
        x = f"replace({x}, '{entity}', {mark})"
    return f"replace({x}, chr(1), '&')"


_ESCAPED = "CASE WHEN contains({x}, '&lt;') OR contains({x}, '&amp;') THEN {y} ELSE {x} END"


@_query("q_plain_text", f"""SELECT page_id, trim(regexp_replace({_decoded("regexp_replace(t, '<[^>]+>', ' ', 'g')")}, '[\\s\\x{{A0}}]+', ' ', 'g')) AS text
    FROM (SELECT page_id, {_ESCAPED.format(x='t', y=_decoded('t'))} AS t FROM (SELECT page_id, {_ESCAPED.format(x='html', y=_decoded('html'))} AS t FROM pages))""")  # fmt: skip
def q_plain_text(s, sf):
    return d.table(s, sf, "pages").select("page_id", text.plain_text(F.col("html")).alias("text"))


_KINDS = """count(DISTINCT visitor) AS visitors, count(*) FILTER (name = 'view') AS page_views, count(*) FILTER (name = 'click') AS searches,
    count(*) FILTER (name = 'purchase') AS company_views, count(*) FILTER (name = 'signup') AS executive_views, count(*) AS events"""


@_query("q_report_totals", f"SELECT {_KINDS} FROM site WHERE day BETWEEN '{DAYS[0]}' AND '{DAYS[1]}'")
def q_report_totals(s, sf):
    return visitors.totals(d.events(s, sf), *DAYS)


@_query("q_report_daily", f"SELECT day, {_KINDS} FROM site WHERE day BETWEEN '{DAYS[0]}' AND '{DAYS[1]}' GROUP BY day")
def q_report_daily(s, sf):
    return visitors.daily(d.events(s, sf), *DAYS)


for _name, _value, _where in (("subjects", "subject", "name = 'purchase'"), ("countries", "country", None), ("devices", "device", None), ("names", "name", None),
                              ("places", "coalesce(country, '') || '|' || coalesce(device, '')", None), ("regions", "region", None), ("cities", "city", None), ("browsers", "browser", None),
                              ("systems", "os", None), ("referrers", "referrer", "referrer is not null"), ("paths", "path", "name = 'view'")):

    def _top(s, sf, value=_value, where=_where):
        return visitors.top_values(d.events(s, sf), F.expr(value), where and F.expr(where))

    _query(f"q_top_{_name}", f"""SELECT ({_value})::VARCHAR AS value, max(label) AS label, count(*) AS events, count(DISTINCT visitor) AS visitors FROM site
        WHERE {_where or 'true'} GROUP BY 1 ORDER BY 4 DESC, 3 DESC, 1 LIMIT 20""")(_top)  # fmt: skip


@_query("q_search_points", """SELECT latitude, longitude, max(label) AS label, count(*) AS events, count(DISTINCT visitor) AS visitors FROM site
    WHERE name = 'click' GROUP BY 1, 2 ORDER BY 5 DESC, 4 DESC, 1, 2 LIMIT 100""")  # fmt: skip
def q_search_points(s, sf):
    return visitors.search_points(d.events(s, sf))


_VISITS = """SELECT day, visitor, epoch_us(min("at")) AS started, epoch_us(max("at")) AS ended, count(*) AS events, max(device) AS device, max(country) AS country,
    count(*) FILTER (name = 'view') AS page_views, count(*) FILTER (name = 'click') AS searches, count(*) FILTER (name = 'purchase') AS company_views,
    count(*) FILTER (name = 'signup') AS executive_views FROM (SELECT *, sum(fresh) OVER (PARTITION BY day, visitor ORDER BY "at", event_id) AS visit FROM (
        SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY day, visitor ORDER BY "at", event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM site))
    GROUP BY day, visitor, visit"""


@_query("q_visits", _VISITS)
def q_visits(s, sf):
    return visitors.visits(d.events(s, sf))


@_query("q_visitor_hash", "SELECT DISTINCT day, visitor, sha256('s' || day || '|' || visitor)[1:32] AS hash FROM site")
def q_visitor_hash(s, sf):
    e = d.events(s, sf).select("day", "visitor").distinct()
    return e.select("day", "visitor", web.visitor_hash(F.concat(F.lit("s"), "day"), F.col("visitor").cast("string")).alias("hash"))


@_query("q_referrers", """SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', ''), '') AS host FROM pages""")
def q_referrers(s, sf):
    return d.table(s, sf, "pages").select("page_id", web.referrer_host(F.col("url"), "site.invalid").alias("host"))


_CHECKED = f"""paid AS (SELECT p.*, p.total::DOUBLE * {USD} AS usd FROM pay p LEFT JOIN companies USING (company_id)),
    years AS (SELECT p.*, revenue::DOUBLE * {USD} AS usd, {USD} AS rate, lag(revenue) OVER w AS before, lag(fiscal_year) OVER w AS year_before FROM periods p JOIN companies USING (company_id)
              WHERE period_type = 'Annual' WINDOW w AS (PARTITION BY company_id ORDER BY fiscal_year)),
    whole AS (SELECT company_id, fiscal_year, sum(revenue) AS qsum FROM periods WHERE period_type = 'Quarterly' GROUP BY 1, 2 HAVING count(*) = 4),
    own AS (SELECT company_id, count(*) AS n, max(fiscal_year) FILTER (period_type = 'Annual') AS newest, count(*) FILTER (period_type = 'Annual') AS years FROM periods GROUP BY 1)"""


@_query("q_checks", """SELECT * FROM (VALUES
    ('Companies', 'Currency without a rate', 'Error', 0), ('Companies', 'No location at all', 'Error', 0), ('Companies', 'Only a local office', 'Warning', 0),
    ('Financials', 'No figures at all', 'Error', (SELECT count(*) FROM companies WHERE company_id NOT IN (SELECT company_id FROM own))),
    ('Financials', 'Out of date', 'Warning', (SELECT count(*) FROM own WHERE newest < 1999)), ('Financials', 'Quarters only', 'Warning', 0),
    ('Companies', 'Same name under two ids', 'Warning', (SELECT count(*) FROM (SELECT name FROM companies GROUP BY 1 HAVING count(*) > 1))),
    ('Locations', 'Missing city', 'Warning', 0), ('Locations', 'Outside the world', 'Error', 0),
    ('Financials', 'Negative revenue', 'Warning', (SELECT count(*) FROM periods WHERE revenue < 0)), ('Financials', 'Period in the future', 'Error', (SELECT count(*) FROM periods WHERE fiscal_year > 2001)),
    ('Financials', 'Quarter out of range', 'Error', 0), ('Financials', 'Duplicate period', 'Error', 0),
    ('Financials', 'Implausibly large revenue', 'Warning', (SELECT count(*) FROM years WHERE usd > 8e11)),
    ('Financials', 'Profit far bigger than revenue', 'Warning', (SELECT count(*) FROM years WHERE usd >= 1e5 AND net_income > 3 * revenue)),
    ('Financials', 'Revenue jumps tenfold', 'Warning', (SELECT count(*) FROM years WHERE least(revenue, before)::DOUBLE * rate >= 1e5 AND fiscal_year = year_before + 1 AND (revenue > 10 * before OR before > 10 * revenue))),
    ('Financials', 'Quarters don''t add up', 'Warning', (SELECT count(*) FROM years JOIN whole USING (company_id, fiscal_year) WHERE usd >= 1e5 AND abs(qsum - revenue) > 0.02 * abs(revenue))),
    ('Pay', 'Negative amount', 'Error', (SELECT count(*) FROM paid WHERE total < 0)), ('Pay', 'Year in the future', 'Error', (SELECT count(*) FROM paid WHERE year > 2001)),
    ('Pay', 'Person record missing', 'Error', (SELECT count(*) FROM paid WHERE person_id % 10 = 0)), ('Pay', 'Impossibly large total', 'Error', (SELECT count(*) FROM paid WHERE usd > 3e9)),
    ('Pay', 'Very large total', 'Warning', (SELECT count(*) FROM paid WHERE usd > 1.5e8)), ('Pay', 'Tiny total', 'Warning', (SELECT count(*) FROM paid WHERE total > 0 AND total < 10000)),
    ('Pay', 'Name is no person''s', 'Warning', (SELECT count(*) FROM paid)), ('Pay', 'Same person, company and year twice', 'Error', 0)
    ) v(area, name, severity, n)""", extra=",\n" + _CHECKED)  # fmt: skip
def q_checks(s, sf):
    """Checks with the limit of revenue lowered to what the tables hold; every tenth person has no record."""
    c = d.companies(s, sf)
    people_ = d.table(s, sf, "supplier").filter("s_suppkey % 10 <> 0").select(F.col("s_suppkey").alias("person_id"))
    return quality.checks(c, d.locations(c), d.periods(s, sf), d.pay(s, sf), people_, AS_OF, 1e5)


@_query("q_tallies", """SELECT 'sector' AS kind, sector AS value, count(*) AS n FROM companies GROUP BY 2 UNION ALL SELECT 'currency', currency, count(*) FROM companies GROUP BY 2
    UNION ALL SELECT 'state', state, count(*) FROM companies GROUP BY 2 UNION ALL SELECT 'market', regexp_extract(ticker, '\\.(\\w+)$', 1), count(*) FROM companies GROUP BY 2
    UNION ALL SELECT 'paid', state, count(*) FROM companies WHERE company_id IN (SELECT company_id FROM pay) GROUP BY 2
    UNION ALL SELECT 'history', CASE WHEN years = 0 THEN '0' WHEN years <= 2 THEN '1-2' WHEN years <= 5 THEN '3-5' WHEN years <= 9 THEN '6-9' ELSE '10+' END, count(*) FROM own GROUP BY 2
    UNION ALL SELECT 'newest', newest::VARCHAR, count(*) FROM own GROUP BY 2
    UNION ALL SELECT 'period', period_type, count(*) FROM periods GROUP BY 2 UNION ALL SELECT 'year', fiscal_year::VARCHAR, count(*) FROM periods GROUP BY 2
    UNION ALL SELECT 'rows', 'companies', count(*) FROM companies UNION ALL SELECT 'rows', 'periods', count(*) FROM periods UNION ALL SELECT 'rows', 'pay', count(*) FROM pay""", extra=",\n" + _CHECKED)  # fmt: skip
def q_tallies(s, sf):
    return quality.tallies(d.companies(s, sf), d.periods(s, sf), d.pay(s, sf))


@_query("q_orphans", "SELECT DISTINCT c_custkey AS company_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def q_orphans(s, sf):
    return quality.orphans(d.companies(s, sf), d.table(s, sf, "orders").select(F.col("o_custkey").alias("company_id")), "company_id")


@_query("q_repeated", "SELECT l_orderkey, l_linenumber::INTEGER AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_repeated(s, sf):
    return quality.repeated(d.table(s, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@_query("q_first_rows", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1""")
def q_first_rows(s, sf):
    return quality.first_rows(d.table(s, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.col("o_orderkey")])
