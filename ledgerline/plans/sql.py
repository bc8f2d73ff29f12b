"""DuckDB SQL of the directory's tables and of shared steps, as common table expressions."""

from __future__ import annotations

USD = "(CASE currency WHEN 'GBP' THEN 1.27 WHEN 'EUR' THEN 1.08 WHEN 'CAD' THEN 0.73 WHEN 'SEK' THEN 0.095 ELSE 1.0 END)::DOUBLE"
MILES = "2 * 3958.8 * asin(least(1.0, sqrt(power(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * power(sin(radians({b}.longitude - {a}.longitude) / 2), 2))))"

CTE = {
    "places": """SELECT n_nationkey AS place_key, n_name AS city, r_name AS state,
        (['USD', 'GBP', 'EUR', 'CAD', 'SEK'])[n_regionkey % 5 + 1] AS currency FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "companies": """SELECT c_custkey AS company_id,
        'T' || c_custkey || CASE WHEN c_custkey % 11 = 0 THEN '.L' WHEN c_custkey % 13 = 0 THEN '.KA' ELSE '' END AS ticker, c_name AS name, c_mktsegment AS sector, city, state, currency,
        CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 900 + 1) * 10 END AS employees,
        25 + (c_custkey * 37 % 2400)::DOUBLE / 100 AS latitude, -120 + (c_custkey * 53 % 5000)::DOUBLE / 100 AS longitude
        FROM customer JOIN places ON c_nationkey = place_key""",
    "locations": """SELECT company_id * 2 AS location_id, company_id, 'Headquarters' AS type, city, state, latitude, longitude FROM companies
        UNION ALL SELECT company_id * 2 + 1, company_id, 'Office', city, state, latitude + 0.5, longitude + 0.25 FROM companies WHERE company_id % 3 = 0""",
    "quarters": """SELECT o_custkey AS company_id, year(o_orderdate) AS fiscal_year, quarter(o_orderdate) AS fiscal_quarter,
        sum(o_totalprice::DECIMAL(18,2)) AS revenue, coalesce(sum(net), 0) AS net_income
        FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(18,2) * (0.20 - l_discount::DECIMAL(4,2))) AS net
                               FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""",
    "periods": """SELECT company_id, 'Quarterly' AS period_type, fiscal_year, fiscal_quarter, revenue, net_income FROM quarters
        UNION ALL SELECT company_id, 'Annual', fiscal_year, NULL, sum(revenue), sum(net_income) FROM quarters GROUP BY company_id, fiscal_year""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY company_id, period_type ORDER BY fiscal_year * 10 + coalesce(fiscal_quarter, 0) DESC) AS n,
        max(CASE WHEN period_type = 'Annual' THEN fiscal_year END) OVER (PARTITION BY company_id) AS latest FROM periods""",
    "sums": """SELECT company_id, count(*) FILTER (period_type = 'Quarterly') AS quarters,
        sum(revenue) FILTER (period_type = 'Quarterly' AND n <= 4) AS q_revenue, sum(net_income) FILTER (period_type = 'Quarterly' AND n <= 4) AS q_net,
        sum(revenue) FILTER (period_type = 'Quarterly' AND n BETWEEN 5 AND 8) AS q_prior,
        sum(revenue) FILTER (period_type = 'Annual' AND n = 1) AS a_revenue, sum(net_income) FILTER (period_type = 'Annual' AND n = 1) AS a_net,
        sum(revenue) FILTER (period_type = 'Annual' AND n = 2) AS a_prior,
        sum(revenue) FILTER (period_type = 'Annual' AND fiscal_year = latest - 5) AS start,
        count(*) FILTER (period_type = 'Annual' AND n <= 10) AS history_years FROM numbered GROUP BY company_id""",
    "trailed": """SELECT company_id, a_revenue::DOUBLE AS a_revenue, start::DOUBLE AS start, history_years,
        (CASE WHEN quarters >= 4 THEN q_revenue ELSE a_revenue END)::DOUBLE AS ttm_revenue,
        (CASE WHEN quarters >= 4 THEN q_net ELSE a_net END)::DOUBLE AS ttm_net,
        (CASE WHEN quarters >= 8 THEN q_prior WHEN quarters < 4 THEN a_prior END)::DOUBLE AS prior FROM sums""",
    "indicators": """SELECT company_id, ttm_revenue, ttm_net, CASE WHEN prior > 0 THEN round_even(ttm_revenue / prior - 1, 4) + 0.0::DOUBLE END AS growth,
        CASE WHEN a_revenue > 0 AND start > 0 THEN round_even(power(a_revenue / start, 0.2) - 1, 4) + 0.0::DOUBLE END AS cagr,
        CASE WHEN ttm_revenue <> 0 THEN round_even(ttm_net / ttm_revenue, 4) + 0.0::DOUBLE END AS margin,
        CASE WHEN ttm_net < 0 THEN 'Down' WHEN prior IS NULL OR prior <= 0 THEN 'Flat' WHEN (ttm_revenue / prior - 1) * 100 > 4 THEN 'Up'
             WHEN (ttm_revenue / prior - 1) * 100 < -1 THEN 'Down' ELSE 'Flat' END AS trend, history_years FROM trailed""",
    "stats": f"SELECT c.*, i.* EXCLUDE (company_id), i.ttm_revenue * {USD} AS revenue_usd FROM companies c JOIN indicators i USING (company_id)",
    "grown": """SELECT p.*, CASE WHEN b.revenue > 0 THEN round_even(p.revenue::DOUBLE / b.revenue::DOUBLE - 1, 4) + 0.0::DOUBLE END AS growth FROM periods p
        LEFT JOIN periods b ON p.company_id = b.company_id AND p.period_type = b.period_type AND p.fiscal_year = b.fiscal_year + 1
        AND p.fiscal_quarter IS NOT DISTINCT FROM b.fiscal_quarter""",
    "pay": """SELECT l_suppkey AS person_id, s_name AS name, (['Chief Executive Officer', 'Chief Financial Officer', 'Former Chief Operating Officer',
        'General Counsel', 'Executive Director'])[s_suppkey % 5 + 1] AS title, o_custkey AS company_id, year(o_orderdate) AS year,
        sum(l_extendedprice::DECIMAL(18,2)) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey
        GROUP BY ALL""",
    "filings": """SELECT l_suppkey AS company_id, p_name AS title, city, state, round_even(l_extendedprice, 0) AS salary
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = place_key""",
    "site": """SELECT event_id, ts AS "at", strftime(ts, '%Y-%m-%d') AS day, user_id AS visitor, event_type AS name,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS subject, 'item ' || json_extract_string(props, '$.k') AS label,
        25 + (user_id % 20)::DOUBLE / 4 AS latitude, -100 + (user_id % 15)::DOUBLE / 4 AS longitude,
        (['US', 'UK', 'FR'])[user_id % 3 + 1] AS country, (['Desktop', 'Phone'])[user_id % 2 + 1] AS device,
        (['North', 'South', 'East', 'West'])[user_id % 4 + 1] AS region, 'town ' || user_id % 30 AS city, (['Chrome', 'Safari', 'Firefox'])[user_id % 3 + 1] AS browser,
        (['Windows', 'iOS', 'Android', 'Linux'])[user_id % 4 + 1] AS os,
        CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 = 0 THEN 'site' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 || '.example' END AS referrer,
        '/page/' || CAST(json_extract_string(props, '$.k') AS BIGINT) % 40 AS path FROM events""",
    "nearest": """SELECT company_id, location_id, city, state, round_even(exact, 2) AS miles, has_hq FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY exact, location_id) AS n,
               bool_or(type = 'Headquarters') OVER (PARTITION BY company_id) AS has_hq
        FROM (SELECT l.*, """ + MILES.format(a="o", b="l") + """ AS exact
              FROM locations l, (SELECT 40.3916::DOUBLE AS latitude, -111.8508::DOUBLE AS longitude) o) WHERE exact <= 250) WHERE n = 1""",
    "found": """SELECT n.*, c.ticker, c.name, c.sector, c.currency, coalesce(i.ttm_revenue, 0) AS ttm_revenue, coalesce(i.ttm_net, 0) AS ttm_net,
        i.growth, i.cagr, i.margin, coalesce(i.trend, 'Flat') AS trend, i.history_years
        FROM nearest n JOIN companies c USING (company_id) LEFT JOIN indicators i USING (company_id)""",
    "chiefs": f"""SELECT p.*, c.ticker, c.sector, c.currency, p.total::DOUBLE * {USD} AS usd,
        CASE WHEN title = 'Executive Director' THEN 'executive director' ELSE 'CEO' END AS role FROM pay p
        JOIN (SELECT company_id, max(year) AS year FROM pay WHERE year <= 2001 GROUP BY 1) USING (company_id, year) JOIN companies c USING (company_id)
        WHERE title IN ('Chief Executive Officer', 'Executive Director') AND total > 0
          AND year >= (SELECT max(year) FROM pay WHERE year <= 2001) - 1""",
    "companies_pay": """SELECT company_id, year, role, top_pay, CASE WHEN others >= 2 THEN other_median END AS other_median, s.ticker, s.sector,
        CASE WHEN ends_with(s.ticker, '.L') THEN 'uk' WHEN ends_with(s.ticker, '.KA') THEN 'pk' ELSE 'sec' END AS market, s.currency, s.revenue_usd
        FROM (SELECT company_id, year, any_value(best_role) AS role, any_value(best_pay)::DOUBLE AS top_pay,
                     count(*) FILTER (person_id <> best) AS others, median(total::DOUBLE) FILTER (person_id <> best) AS other_median
              FROM (SELECT *, first_value(person_id) OVER w AS best, first_value(total) OVER w AS best_pay,
                           first_value(CASE WHEN title = 'Chief Executive Officer' THEN 'CEO' ELSE 'top-paid executive director' END) OVER w AS best_role,
                           bool_or(title IN ('Chief Executive Officer', 'Executive Director')) OVER (PARTITION BY company_id) AS has_chief
                    FROM (SELECT *, max(year) OVER (PARTITION BY company_id) AS newest FROM pay WHERE total > 0 AND year <= 2001) WHERE year = newest
                    WINDOW w AS (PARTITION BY company_id ORDER BY title IN ('Chief Executive Officer', 'Executive Director') DESC, total DESC, person_id))
              WHERE has_chief GROUP BY company_id, year) JOIN (SELECT * FROM stats WHERE revenue_usd > 0) s USING (company_id)""",
    "peer_pairs": f"""SELECT a.company_id, a.top_pay, b.company_id AS peer_id, b.ticker AS peer, round(abs(ln(b.revenue_usd / a.revenue_usd)), 9) AS gap,
        b.revenue_usd BETWEEN a.revenue_usd / 3.0::DOUBLE AND a.revenue_usd * 3.0::DOUBLE AS inside,
        CASE WHEN a.currency = b.currency THEN b.top_pay ELSE round_even(b.top_pay * b.rate / a.rate, 0) END AS amount
        FROM (SELECT *, {USD} AS rate FROM companies_pay) a JOIN (SELECT *, {USD} AS rate FROM companies_pay) b
        ON a.sector = b.sector AND a.market = b.market AND a.company_id <> b.company_id AND b.year >= a.year - 1""",
    "peers": """SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY gap, peer_id) AS near,
        count(*) FILTER (inside) OVER (PARTITION BY company_id) AS banded FROM peer_pairs""",
}


def with_tables(body: str, extra: str = "") -> str:
    """body after the common table expressions; DuckDB leaves out those that it does not use."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in CTE.items()) + extra + "\n" + body
