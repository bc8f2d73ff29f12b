"""Registered queries over text: places, names and titles, saved documents, tagged facts, repairs; beside their SQL.

The test tables hold no such text, so it is built from their rows, and each result is known from these: what is put in must
come out.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import places, text
from ..operators import facts, people, repair
from ..sources import directory as d
from ..sources import documents
from .catalogue import query


def _customers(s, sf):
    return d.table(s, sf, "customer")


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("q_country_rule", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'US' WHEN c_custkey % 4 = 1 THEN 'CA' WHEN c_custkey % 4 = 2 THEN 'NL' ELSE 'UK' END AS country
    FROM customer""")  # fmt: skip
def q_country_rule(s, sf):
    k = F.col("c_custkey")
    state = F.when(k % 4 == 0, "ut").when(k % 4 == 1, "NL").when(k % 4 == 2, "nl").otherwise("UK")
    longitude = F.when(k % 4 == 0, -111.0).when(k % 4 == 1, -53.0).when(k % 4 == 2, 5.0).otherwise(-0.1)
    return _customers(s, sf).select("c_custkey", places.country_of(state, longitude).alias("country"))


_ASKED = ["Texas", "tx", "united-kingdom", "Québec", "Washington", "Washington, USA", "Ontario, Canada", "WA USA", "Holland", "new york", "New York State", "nowhere", "NL", "us-ca"]
_MEANT = ["US-TX", "US-TX", "UK", "CA-QC", None, "US-WA", "CA-ON", "US-WA", "NL", None, "US-NY", None, "NL", "US-CA"]


def _sql_array(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _pick(values, key):
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


@query("q_region_names", f"""SELECT c_custkey, ({_sql_array(_MEANT)})[c_custkey % {len(_MEANT)} + 1] AS region FROM customer""")
def q_region_names(s, sf):
    asked = _customers(s, sf).select("c_custkey", _pick(_ASKED, F.col("c_custkey")).alias("asked"))
    return places.find_regions(asked, "asked").select("c_custkey", "region")


_CODES = ["FR-75008", "NL 1012 AB", "AU-2000", "SE-113 56", "84043", "84043-1234", "M5J 2J2", "SW1A 1AA", "EC2A", "nothing", "PL-00-950", "M5J"]
_KEYS = ["FR:75008", "NL:1012", "AU:2000", "SE:11356", "84043", "84043", "CA:M5J", "SW1A", "EC2A", None, "PL:00950", "M5J"]


@query("q_postcodes", f"SELECT c_custkey, ({_sql_array(_KEYS)})[c_custkey % {len(_KEYS)} + 1] AS key FROM customer")
def q_postcodes(s, sf):
    return _customers(s, sf).select("c_custkey", places.postcode(_pick(_CODES, F.col("c_custkey")))["key"].alias("key"))


@query("q_located", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Lehi' WHEN 1 THEN 'Toronto' ELSE 'London' END AS city FROM customer""")
def q_located(s, sf):
    table = s.createDataFrame([("84043", "Lehi", "UT", 40.4, -111.9), ("CA:M5J", "Toronto", "ON", 43.6, -79.4), ("EC2", "London", "UK", 51.5, -0.1)],
                              "zip_key string, city string, state string, latitude double, longitude double")
    asked = _customers(s, sf).select("c_custkey", _pick(["84043-0001", "m5j", "EC2A 4BX"], F.col("c_custkey")).alias("q"))
    return places.located(asked, "q", table).select("c_custkey", "city")


@query("q_us_places", """SELECT c_custkey, n, city, state FROM (SELECT c_custkey, unnest([1, 2]) AS n, unnest(['Santa Clara', 'New York']) AS city, unnest(['CA', 'NY']) AS state
    FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 1, 'Town' || c_custkey, 'UT' FROM customer WHERE c_custkey % 2 = 1)""")  # fmt: skip
def q_us_places(s, sf):
    ad = F.when(F.col("c_custkey") % 2 == 0, "US, CA, Santa Clara; NYC, New York, USA or Remote, TX").otherwise(_text("town", F.col("c_custkey"), ", Utah (hybrid)"))
    df = _customers(s, sf).select("c_custkey", F.posexplode(places.us_places(ad)).alias("n", "p"))
    return df.select("c_custkey", (F.col("n") + 1).alias("n"), "p.city", "p.state")


@query("q_us_jobs", "SELECT c_custkey, c_custkey % 4 < 3 AS is_us FROM customer")
def q_us_jobs(s, sf):
    return _customers(s, sf).select("c_custkey", places.is_us(_pick(["Provo, UT", "Remote - United States", "US-Remote", "London"], F.col("c_custkey"))).alias("is_us"))


@query("q_city_bubbles", """SELECT upper(n_name) AS city_key, count(*) AS companies, min(c_custkey) AS first_id FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def q_city_bubbles(s, sf):
    c = d.companies(s, sf).select("company_id", F.concat("city", F.when(F.col("company_id") % 2 == 0, " 08").otherwise("")).alias("city"))
    key = F.upper(F.replace(places.city_key(F.replace("city", F.lit("_"), F.lit("x"))), F.lit("x"), F.lit("_")))
    return c.groupBy(key.alias("city_key")).agg(F.count("*").alias("companies"), F.min("company_id").alias("first_id"))


@query("q_code_centres", """SELECT code, 'Ort' AS place, round(avg(c_acctbal), 6) AS latitude, round(avg(c_custkey), 6) AS longitude FROM (
    SELECT *, lpad((c_custkey % 97 + 1000)::VARCHAR, 5, '0') AS code FROM customer) GROUP BY 1""")  # fmt: skip
def q_code_centres(s, sf):
    k = F.col("c_custkey")
    rows = _customers(s, sf).select(F.lit("FR").alias("country"), (k % 97 + 1000).cast("string").alias("code"), F.when(k % 2 == 0, "Ort 08").otherwise("Ort").alias("place"),
                                    F.col("c_acctbal").alias("latitude"), k.cast("double").alias("longitude"))
    return places.code_centres(rows).select("code", "place", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query("q_biggest_cities", """SELECT name, state, codes FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY codes DESC, state) AS n FROM (
    SELECT 'CITY' || c_custkey % 10 AS name, c_mktsegment AS state, count(*) AS codes FROM customer GROUP BY 1, 2)) WHERE n = 1""")  # fmt: skip
def q_biggest_cities(s, sf):
    rows = _customers(s, sf).select(_text("city", F.col("c_custkey") % 10).alias("city"), F.col("c_mktsegment").alias("state"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"))
    return places.biggest_cities(rows).select("name", "state", "codes")


def _orders_json(s, sf):
    o = d.table(s, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("r"))
    column = lambda c: F.transform("r", lambda x: x[c].cast("string"))
    recent = F.struct(column("o_orderstatus").alias("form"), column("o_orderpriority").alias("filingDate"), column("o_orderkey").alias("accessionNumber"), column("o_orderkey").alias("primaryDocument"))
    return o.select("o_custkey", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("json"))


@query("q_submissions", """SELECT o_custkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place, o_orderstatus AS form, o_orderpriority AS filed,
    o_orderkey::VARCHAR AS accession, o_orderkey::VARCHAR AS document FROM orders""")  # fmt: skip
def q_submissions(s, sf):
    return documents.submissions(_orders_json(s, sf), "o_custkey", "json")


@query("q_tickers", "SELECT c_nationkey::BIGINT AS cik, min(c_custkey)::VARCHAR AS ticker, arg_min(c_name, c_custkey) AS name, 'X' AS exchange FROM customer GROUP BY 1")
def q_tickers(s, sf):
    c = _customers(s, sf)
    row = F.array(F.col("c_nationkey").cast("string"), "c_name", F.col("c_custkey").cast("string"), F.lit("X"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", row.alias("r")))), lambda x: x["r"])
    return documents.tickers(c.groupBy("c_nationkey").agg(rows.alias("data")).select(F.to_json(F.struct("data")).alias("json")), "json")


@query("q_postings", """SELECT 'greenhouse' AS system, 'b' || p_size AS board, p_partkey::VARCHAR AS id, p_name AS title, p_brand AS location, 'http://x/' || p_partkey AS url,
    NULL::VARCHAR AS description FROM part WHERE p_partkey % 5 <> 0""")  # fmt: skip
def q_postings(s, sf):
    job = F.struct(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("name")).alias("location"),
                   _text("http://x/", F.col("p_partkey")).alias("absolute_url"))
    docs = d.table(s, sf, "part").groupBy("p_size").agg(F.collect_list(job).alias("jobs")).select(_text("b", F.col("p_size")).alias("board"), F.to_json(F.struct("jobs")).alias("json"))
    known = d.table(s, sf, "part").filter("p_partkey % 5 = 0").select(F.lit("greenhouse").alias("system"), _text("b", F.col("p_size")).alias("board"), F.col("p_partkey").cast("string").alias("id"))
    return documents.unseen(documents.postings(docs, "greenhouse", "board", "json"), known).select("system", "board", "id", "title", "location", "url", "description")


@query("q_paged_filings", """SELECT c_nationkey::VARCHAR AS entity, 'N' || c_nationkey AS name, c_mktsegment AS period_end, arg_min('u' || c_custkey, (c_custkey % 7, 'u' || c_custkey)) AS url,
    min(c_custkey % 7) AS errors FROM customer GROUP BY c_nationkey, c_mktsegment""")  # fmt: skip
def q_paged_filings(s, sf):
    k = F.col("c_custkey")
    filing = F.struct(k.cast("string").alias("id"), F.struct(F.col("c_mktsegment").alias("period_end"), _text("u", k).alias("report_url"), (k % 7).alias("error_count")).alias("attributes"),
                      F.struct(F.struct(F.struct(F.col("c_nationkey").cast("string").alias("id")).alias("data")).alias("entity")).alias("relationships"))
    entity = F.struct(F.col("c_nationkey").cast("string").alias("id"), F.struct(_text("N", F.col("c_nationkey")).alias("name"), F.col("c_nationkey").cast("string").alias("identifier")).alias("attributes"))
    pages = _customers(s, sf).groupBy((k % 50).alias("page")).agg(F.collect_list(filing).alias("data"), F.collect_set(entity).alias("included"))
    return documents.paged_filings(pages.select(F.to_json(F.struct("data", "included")).alias("json")), "json")


@query("q_bindings", "SELECT n_regionkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS place, n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation")
def q_bindings(s, sf):
    value = lambda c: F.struct(c.cast("string").alias("value"))
    b = F.struct("n_nationkey", value(F.col("n_nationkey")).alias("key"), F.when(F.col("n_nationkey") % 2 == 0, value(F.col("n_name"))).alias("name"))
    docs = d.table(s, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(b)).alias("bindings"))
    return documents.bindings(docs.select("n_regionkey", F.to_json(F.struct(F.struct("bindings").alias("results"))).alias("json")), "n_regionkey", "json", ["key", "name"])


@query("q_insiders", "SELECT s_nationkey AS company_id, s_suppkey::VARCHAR AS number, s_name AS name, 'director' AS role FROM supplier WHERE s_suppkey > 0")
def q_insiders(s, sf):
    row = _text("<tr><td><a href='x'>", F.col("s_name"), "</a></td><td><a href='?CIK=000", F.col("s_suppkey"), "'>n</a></td><td>2024-01-01</td><td>director</td></tr>")
    docs = d.table(s, sf, "supplier").filter("s_suppkey > 0").groupBy("s_nationkey").agg(F.array_join(F.collect_list(row), "").alias("html"))
    return documents.insiders(docs, "s_nationkey", "html")


@query("q_profiles", "SELECT r_regionkey AS company_id, r_name AS ceo, 'K' || r_regionkey AS auditor FROM region")
def q_profiles(s, sf):
    html = _text("<div>CEO</div><div><b>", F.col("r_name"), "</b></div><td>Auditor:</td> <td>K", F.col("r_regionkey"), "</td>")
    return documents.profile(d.table(s, sf, "region").withColumn("html", html), "r_regionkey", "html", {"ceo": "CEO", "auditor": "Auditor"})


@query("q_symbols", "SELECT 'S' || s_suppkey AS symbol, s_name AS name, 'NYSE' AS exchange FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def q_symbols(s, sf):
    k = F.col("s_suppkey")
    line = F.concat_ws("|", _text("S", k), "s_name", F.when(k % 5 == 0, "?").otherwise("N"), F.when(k % 3 == 0, "Y").otherwise("N"))
    return documents.symbols(d.table(s, sf, "supplier").select(k.alias("place"), line.alias("value")))


@query("q_websites", "SELECT c_custkey AS company_id, 'acme' || c_custkey || '.com' AS domain, 2::BIGINT AS mentions FROM customer")
def q_websites(s, sf):
    k = F.col("c_custkey")
    body = _text("See www.sec.gov, www.acme", k, ".com and www.ir.acme", k, ".com/a or www.sec.gov and www.sec.gov.")
    return documents.websites(_customers(s, sf).select("c_custkey", body.alias("t"), _text("Acme", k, " Inc").alias("n")), "c_custkey", "t", "n")


# --- tagged facts -----------------------------------------------------------------------------------------------------

_FACT_SQL = """,
    q AS (SELECT l_suppkey AS company_id, year(l_shipdate) AS y, quarter(l_shipdate) AS qt, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(28,4) AS rev,
          sum(l_quantity::DECIMAL(18,2))::DECIMAL(28,4) AS net FROM lineitem GROUP BY ALL),
    y AS (SELECT company_id, y, sum(rev) AS rev, sum(net) AS net, count(*) AS n FROM q GROUP BY ALL),
    qs AS (SELECT q.company_id, q.y, q.qt, q.rev, q.net FROM q WHERE NOT (q.company_id % 3 = 0 AND q.qt = 4)),
    ys AS (SELECT company_id, y, n, CASE WHEN company_id % 5 = 0 AND y = 1997 THEN rev * 1.5 ELSE rev END AS rev, net FROM y)"""


def tagged(s, sf):
    """Quarters and years of suppliers as tagged facts: some fourth quarters are missing, one year was restated, some years
    have a smaller line of revenue beside the total, and some net incomes come from a proxy statement in another unit."""
    item = d.table(s, sf, "lineitem")
    q = item.groupBy(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("y"), F.quarter("l_shipdate").alias("qt")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(28,4)").alias("rev"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("decimal(28,4)").alias("net"))
    y = q.groupBy("company_id", "y").agg(F.sum("rev").cast("decimal(28,4)").alias("rev"), F.sum("net").cast("decimal(28,4)").alias("net")).withColumn("qt", F.lit(None).cast("int"))
    restated = (F.col("company_id") % 5 == 0) & (F.col("y") == 1997)
    y = y.withColumn("rev", F.when(restated, F.col("rev") * F.lit("1.5").cast("decimal(2,1)")).otherwise(F.col("rev")).cast("decimal(28,4)"))
    rows = q.filter("not (company_id % 3 = 0 and qt = 4)").select("company_id", "y", "qt", "rev", "net").unionByName(y.select("company_id", "y", "qt", "rev", "net"))
    frame = F.concat(F.lit("CY"), F.col("y"), F.when(F.col("qt").isNotNull(), F.concat(F.lit("Q"), "qt")).otherwise(""))
    start = F.make_date("y", F.coalesce(F.col("qt") * 3 - 2, F.lit(1)), F.lit(1))
    end = F.date_add(F.add_months(start, F.when(F.col("qt").isNotNull(), 3).otherwise(12)), -1)
    proxy = (F.col("company_id") % 7 == 0) & F.col("qt").isNull()
    fact = lambda concept, value, frame, form: F.struct(F.lit(concept).alias("concept"), value.cast("decimal(28,4)").alias("value"), frame.alias("frame"), F.lit(form).alias("form"))
    none = F.lit(None).cast("string")
    some = F.array(fact("Revenues", F.col("rev"), frame, "10-K"), fact("SalesRevenueNet", F.col("rev") / 2, frame, "10-K"))
    net = F.when(proxy, F.array(fact("NetIncomeLoss", F.col("net"), none, "10-K"), fact("NetIncomeLoss", F.col("net") / 1000, frame, "DEF 14A"))).otherwise(
        F.array(fact("NetIncomeLoss", F.col("net"), frame, "10-K"), fact("ProfitLoss", F.col("net") * 2, frame, "10-K")))
    df = rows.select("company_id", start.alias("start"), end.alias("end"), F.posexplode(F.concat(some, net)).alias("place", "f"))
    return df.select("company_id", "f.concept", F.lit("USD").alias("currency"), "start", "end", "f.value", "f.frame", "f.form", F.date_add("end", 40).alias("filed"), F.col("place").cast("long").alias("place"))


@query("q_xbrl_merge", """SELECT company_id, 'Annual' AS period_type, y::INTEGER AS fiscal_year, NULL::INTEGER AS fiscal_quarter, rev::DOUBLE AS revenue, net::DOUBLE AS net_income, false AS derived FROM ys
    UNION ALL SELECT company_id, 'Quarterly', y::INTEGER, qt::INTEGER, rev::DOUBLE, net::DOUBLE, derived FROM (
        SELECT *, false AS derived FROM qs UNION ALL
        SELECT ys.company_id, ys.y, m.qt, ys.rev - s.rev, ys.net - s.net, true FROM ys JOIN (SELECT company_id, y, sum(rev) AS rev, sum(net) AS net, count(*) AS n, 10 - sum(qt) AS qt FROM qs GROUP BY 1, 2) m USING (company_id, y)
        JOIN (SELECT company_id, y, sum(rev) AS rev, sum(net) AS net FROM qs GROUP BY 1, 2) s USING (company_id, y) WHERE m.n = 3 AND ys.rev >= s.rev)
    WHERE (company_id, y) NOT IN (SELECT company_id, y FROM ys JOIN (SELECT company_id, y, sum(rev) AS qrev, count(*) AS c FROM qs GROUP BY 1, 2) USING (company_id, y) WHERE c = 4 AND abs(qrev - rev) > 0.02 * abs(rev))""", extra=_FACT_SQL)  # fmt: skip
def q_xbrl_merge(s, sf):
    out = facts.merged(tagged(s, sf), ["Revenues", "SalesRevenueNet", "RevenuesNetOfInterestExpense"], ["NetIncomeLoss", "ProfitLoss"])
    return out.select("company_id", "period_type", "fiscal_year", "fiscal_quarter", F.col("revenue").cast("double").alias("revenue"), F.col("net_income").cast("double").alias("net_income"), "derived")


@query("q_company_facts", """SELECT company_id, 'Revenues' AS concept, count(*) AS n, sum(rev)::DOUBLE AS value FROM (SELECT company_id, rev FROM qs UNION ALL SELECT company_id, rev FROM ys) GROUP BY 1""", extra=_FACT_SQL)
def q_company_facts(s, sf):
    t = tagged(s, sf).filter("concept = 'Revenues'")
    fact = F.struct("start", "end", F.col("value").alias("val"), "frame", "form", "filed")
    units = F.create_map(F.lit("USD"), F.collect_list(fact))
    docs = t.groupBy("company_id").agg(F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(units.alias("units")))).alias("facts"))
    rows = documents.company_facts(docs.select("company_id", F.to_json(F.struct("facts")).alias("json")), "company_id", "json")
    return rows.groupBy("company_id", "concept").agg(F.count("*").alias("n"), F.sum("value").cast("double").alias("value"))


@query("q_report_facts", "SELECT company_id, 'Revenue' AS concept, y::INTEGER AS fiscal_year, rev::DOUBLE AS value FROM ys", extra=_FACT_SQL)
def q_report_facts(s, sf):
    t = tagged(s, sf).filter("concept = 'Revenues' and length(frame) = 6")
    period = F.concat(F.col("start").cast("string"), F.lit("T00:00:00/"), F.date_add("end", 1).cast("string"), F.lit("T00:00:00"))
    sizes = F.create_map(F.lit("concept"), F.lit("ifrs-full:Revenue"), F.lit("entity"), F.lit("e"), F.lit("period"), period, F.lit("unit"), F.lit("iso4217:USD"))
    part = F.map_concat(sizes, F.create_map(F.lit("segment"), F.lit("x")))
    fact = F.array(F.struct(F.concat(F.lit("f"), "frame").alias("k"), F.struct(F.col("value").cast("string").alias("value"), sizes.alias("dimensions")).alias("v")),
                   F.struct(F.concat(F.lit("g"), "frame").alias("k"), F.struct(F.lit("1").alias("value"), part.alias("dimensions")).alias("v")))
    docs = t.select("company_id", F.explode(fact).alias("f")).groupBy("company_id").agg(F.map_from_entries(F.collect_list("f")).alias("facts"))
    rows = documents.report_facts(docs.select("company_id", F.to_json(F.struct("facts")).alias("json")), "company_id", "json")
    rows = rows.withColumn("report_end", F.make_date(F.year("end"), F.lit(12), F.lit(31))).withColumn("filed", F.col("end"))
    return facts.annual_by_duration(rows).select("company_id", "concept", "fiscal_year", F.col("value").cast("double").alias("value"))


# --- repairs ----------------------------------------------------------------------------------------------------------

_PLAIN = """SELECT company_id, period_type, fiscal_year, fiscal_quarter, revenue::DOUBLE AS revenue, net_income::DOUBLE AS net_income FROM (
    SELECT c_custkey AS company_id, 'Quarterly' AS period_type, y AS fiscal_year, q AS fiscal_quarter, (c_custkey % 50 + 20) * 1000000 * (y - 1990) + q * 1000 AS revenue,
           (c_custkey % 50 + 20) * 100000 * (y - 1990) + q * 100 AS net_income FROM customer, range(1996, 2002) a(y), range(1, 5) b(q)
    UNION ALL SELECT c_custkey, 'Annual', y, NULL, (c_custkey % 50 + 20) * 1000000 * (y - 1990) * 4 + 10000, (c_custkey % 50 + 20) * 100000 * (y - 1990) * 4 + 1000 FROM customer, range(1996, 2002) a(y))"""


@query("q_repair_financials", _PLAIN)
def q_repair_financials(s, sf):
    """Six years of made-up figures with planted slips of the unit: whole years, one measure, and a year at the end."""
    k = F.col("c_custkey")
    years = _customers(s, sf).select(k, F.explode(F.sequence(F.lit(1996), F.lit(2001))).alias("y"))
    size = (k % 50 + 20) * (F.col("y") - 1990)
    q = years.withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(4))))
    q = q.select("c_custkey", "y", "q", (size * 1_000_000 + F.col("q") * 1000).alias("r"), (size * 100_000 + F.col("q") * 100).alias("n"))
    a = years.select("c_custkey", "y", F.lit(None).cast("int").alias("q"), (size * 4_000_000 + 10_000).alias("r"), (size * 400_000 + 1000).alias("n"))
    up = lambda test, c: F.when(test, F.col(c).cast("decimal(28,4)") * 1000).otherwise(F.col(c)).cast("decimal(28,4)")
    down = lambda test, c: F.when(test, F.col(c) / 1000).otherwise(F.col(c)).cast("decimal(28,4)")
    a = a.select("c_custkey", "y", "q", up((k % 3 == 0) & (F.col("y") == 1998), "r").alias("r"), down((k % 4 == 0) & (F.col("y") == 1999), "n").alias("n"))
    rows = q.select("c_custkey", "y", "q", F.col("r").cast("decimal(28,4)").alias("r"), F.col("n").cast("decimal(28,4)").alias("n")).unionByName(a)
    periods = rows.select(F.col("c_custkey").alias("company_id"), F.when(F.col("q").isNull(), "Annual").otherwise("Quarterly").alias("period_type"), F.col("y").cast("long").alias("fiscal_year"),
                          F.col("q").cast("long").alias("fiscal_quarter"), F.col("r").alias("revenue"), F.col("n").alias("net_income"))
    out = repair.repair_financials(periods)
    return out.select("company_id", "period_type", "fiscal_year", "fiscal_quarter", F.col("revenue").cast("double").alias("revenue"), F.col("net_income").cast("double").alias("net_income"))


@query("q_repair_pay", """SELECT c_custkey AS company_id, CASE n WHEN 0 THEN 'a' ELSE 'c' END AS person_id,
    CASE n WHEN 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'T. Edward Marsh' ELSE 'Edward Marsh' END ELSE 'John P. McDonald III' END AS name,
    CASE n WHEN 0 THEN 'Chief Executive Officer' ELSE 'President and Chief Operating Officer' END AS title, y AS year, (c_custkey + 1000 * n + y)::DOUBLE AS total
    FROM customer, range(0, 2) a(n), range(2000, 2003) b(y)""")  # fmt: skip
def q_repair_pay(s, sf):
    """Two people of each company: one under two ids with a short name in one year, both with debris in names and titles, and
    a row that is no person."""
    k = F.col("c_custkey")
    y = _customers(s, sf).select(k, F.explode(F.sequence(F.lit(2000), F.lit(2002))).alias("y"))
    long_name = F.when(k % 3 == 0, "T. Edward Marsh (1)").otherwise("Edward Marsh2")
    row = lambda id, name, title, total: F.struct(F.lit(id).alias("person_id"), name.alias("name"), F.lit(title).alias("title"), total.cast("decimal(28,4)").alias("total"))
    rows = F.array(
        row("a", long_name, "chief Executive Officer Represents the aggregate grant date fair value", k + F.col("y")),
        row("b", F.when(F.col("y") == 2001, "Ted Marsh").otherwise("Other NEOs required"), "Chief Executive Officer", k + F.col("y")),
        row("c", F.lit("JOHN P. MCDONALD III"), "age 59 President and Chief Operating Officer 108,150 2,000", k + F.col("y") + 1000))
    df = y.select(k.alias("company_id"), F.col("y").alias("year"), F.posexplode(rows).alias("row", "r"))
    zero = lambda c: F.lit(0).cast("decimal(28,4)").alias(c)
    pay = df.select("company_id", "r.person_id", "r.name", "r.title", "year", F.col("r.total").alias("salary"), zero("bonus"), zero("stock"), zero("other"), "r.total", F.lit("f").alias("filing"), "row")
    insiders = s.createDataFrame([("a", "77")], "person_id string, number string")
    return repair.repair_pay(pay, insiders).select("company_id", "person_id", "name", "title", "year", F.col("total").cast("double").alias("total"))


@query("q_pvp_check", """SELECT s_suppkey AS tag_id, CASE s_suppkey % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'verified' WHEN 2 THEN 'corrected' WHEN 3 THEN 'dropped' ELSE 'unmatched' END AS outcome,
    CASE WHEN s_suppkey % 5 IN (2, 3) THEN s_suppkey END AS person_id, CASE WHEN s_suppkey % 5 IN (2, 3) THEN 2000 END AS year, CASE WHEN s_suppkey % 5 = 2 THEN 1200000 + s_suppkey END::DOUBLE AS total FROM supplier""")  # fmt: skip
def q_pvp_check(s, sf):
    k = F.col("s_suppkey")
    p = d.table(s, sf, "supplier")
    rows = p.select(k.alias("company_id"), k.alias("person_id"), F.col("s_name").alias("name"), F.lit(2000).alias("year"), (k + 1_000_000).cast("double").alias("total"), F.lit(1000.0).alias("other"))
    tagged_ = F.when(k % 5 == 0, k + 1_000_000).when(k % 5 == 1, (k + 1_000_000) * 1000).when(k % 5 == 2, k + 1_200_000).when(k % 5 == 3, k + 900_000).otherwise(k + 9_000_000)
    tags = p.select(k.alias("tag_id"), k.alias("company_id"), F.upper("s_name").alias("name"), F.lit(1999).alias("fiscal_year"), F.lit(2000).alias("period_end_year"), tagged_.cast("double").alias("tagged"))
    return people.tagged_pay(rows, tags)


@query("q_job_titles", "SELECT DISTINCT p_size AS size, 'SR SW ENGR, AI/ML of ' || p_size AS spelling, 'Senior Software Engineer, AI/ML of ' || p_size AS shown FROM part")
def q_job_titles(s, sf):
    t = d.table(s, sf, "part").select(F.col("p_size").alias("size"), _text("SR SW ENGR, AI/ML of ", F.col("p_size")).alias("spelling")).distinct()
    return t.select("size", "spelling", text.job_title(F.col("spelling")).alias("shown"))
