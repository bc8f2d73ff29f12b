"""Registered queries over salaries, ads and their stores, and over the whole text of documents and pages; beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import companies, web
from ..operators import jobs, markup, matching, quality, salaries
from ..sources import directory as d
from ..sources import documents
from .catalogue import query
from .text import _text

_CODED = "(SELECT *, p_type AS occupation, l_linenumber % 3 AS code FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = place_key)"
_STATS = """count(*) AS filings, min(salary) AS low, round_even(quantile_cont(salary, 0.25), 0) AS p25, round_even(median(salary), 0) AS p50,
    round_even(quantile_cont(salary, 0.75), 0) AS p75, max(salary) AS high"""


@query("q_job_salaries", f"""
    SELECT company_id, title, occupation, NULL AS city, NULL AS state, NULL AS code, NULL AS latitude, {_STATS} FROM jf JOIN jo USING (company_id, title) GROUP BY 1, 2, 3 HAVING count(*) >= 3
    UNION ALL SELECT s.company_id, s.title, occupation, s.city, s.state, m.code, CASE WHEN m.code <> '2' THEN 40.0 + m.code::DOUBLE END, s.* EXCLUDE (company_id, title, city, state) FROM (
        SELECT company_id, title, city, state, {_STATS} FROM jf GROUP BY ALL HAVING count(*) >= 3) s JOIN jo USING (company_id, title)
    JOIN (SELECT company_id, title, city, state, code FROM (SELECT company_id, title, city, state, code, row_number() OVER (PARTITION BY company_id, title, city, state ORDER BY count(*) DESC, code) AS r
          FROM jf GROUP BY company_id, title, city, state, code) WHERE r = 1) m USING (company_id, title, city, state)""",
       extra=f""",
    jf AS (SELECT l_suppkey % 7 AS company_id, lower(p_type) AS title, p_brand AS job, city, state, CAST(l_linenumber % 3 AS VARCHAR) AS code, round_even(l_extendedprice, 0) AS salary FROM {_CODED}),
    jo AS (SELECT company_id, title, occupation FROM (SELECT company_id, title, job AS occupation, row_number() OVER (PARTITION BY company_id, title ORDER BY count(*) DESC, job) AS r
           FROM jf GROUP BY company_id, title, job) WHERE r = 1)""")  # fmt: skip
def q_job_salaries(s, sf):
    t = lambda n: d.table(s, sf, n)
    rows = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        d.places(s, sf), F.col("s_nationkey") == F.col("place_key"))
    filings = rows.select((F.col("l_suppkey") % 7).alias("company_id"), F.col("p_type").alias("title"), F.col("p_brand").alias("occupation"), "city", "state",
                          (F.col("l_linenumber") % 3).cast("string").alias("code"), F.bround("l_extendedprice", 0).alias("salary"))
    codes = s.createDataFrame([("0", 40.0, 1.0), ("1", 41.0, 2.0)], "code string, latitude double, longitude double")
    return jobs.job_salaries(filings, codes).drop("longitude")


_AD = """count(*) AS ads, min(pay) AS low, round_even(median(pay), 0) AS p25, round_even(median(pay) * 1.25, 0) AS p50, round_even(median(pay) * 1.5, 0) AS p75, max(pay) * 1.5 AS high"""


@query("q_ad_summaries", f"""
    SELECT company_id, title, NULL AS city, NULL AS state, max_by(url, seen) AS url, {_AD} FROM ad GROUP BY 1, 2
    UNION ALL SELECT company_id, title, city, state, NULL, {_AD} FROM (
        SELECT *, 'Austin' AS city, 'TX' AS state FROM ad WHERE o_orderkey % 3 < 2 UNION ALL SELECT *, 'Salt Lake City', 'UT' FROM ad WHERE o_orderkey % 3 = 1) GROUP BY 1, 2, 3, 4""",
       extra=""",
    ad AS (SELECT o_orderkey, o_custkey % 20 AS company_id, lower(o_orderpriority[3:]) AS title, CAST(4 * floor(o_totalprice) AS DOUBLE) AS pay, 'https://jobs/' || o_orderkey AS url, o_orderkey AS seen FROM orders)""")  # fmt: skip
def q_ad_summaries(s, sf):
    k = F.col("o_orderkey")
    pay = (4 * F.floor("o_totalprice")).cast("double")
    place = F.when(k % 3 == 0, "Austin, TX, United States").when(k % 3 == 1, "Remote - Austin, Texas; SALT LAKE CITY, UT").otherwise("Berlin")
    ads = d.table(s, sf, "orders").select((F.col("o_custkey") % 20).alias("company_id"), F.substr("o_orderpriority", F.lit(3)).alias("title"), place.alias("location"), pay.alias("pay_min"),
                                          (pay * 1.5).alias("pay_max"), _text("https://jobs/", k).alias("url"), k.alias("seen"))
    return jobs.ad_summaries(ads)


@query("q_salary_sources", """SELECT c_custkey || 'k' AS kind, DATE '2024-01-01' + CAST(c_custkey % 90 AS INTEGER) AS "from", DATE '2024-12-31' AS "to", CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE '' END AS source
    FROM customer WHERE c_custkey % 5 <> 4 UNION ALL SELECT 'visa', DATE '2020-01-01', DATE '2020-06-30', ''""")  # fmt: skip
def q_salary_sources(s, sf):
    k = F.col("c_custkey")
    c = d.table(s, sf, "customer")
    pairs = F.array(
        F.struct(_text("job_salaries.", k, "k.from").alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 90).cast("int")).cast("string").alias("value")),
        F.struct(_text("job_salaries.", k, "k.to").alias("key"), F.when(k % 5 == 4, "never").otherwise("2024-12-31").alias("value")),
        F.struct(F.when(k % 3 == 0, _text("job_salaries.", k, "k.source")).otherwise("other").alias("key"), F.col("c_name").alias("value")),
        F.struct(F.when(k == 1, "job_salaries.from").when(k == 2, "job_salaries.to").otherwise("x").alias("key"), F.when(k == 1, "2020-01-01").otherwise("2020-06-30").alias("value")))
    extras = c.select(F.explode(pairs).alias("p")).select("p.*")
    kinds = c.select(_text(k, "k").alias("kind")).unionByName(s.createDataFrame([("visa",)], "kind string"))
    return jobs.salary_sources(kinds, extras)


@query("q_share_codes", """
    SELECT lei, CAST(place AS INTEGER) AS place, isin FROM (SELECT lei, isin, row_number() OVER (PARTITION BY lei ORDER BY CASE WHEN isin[3:6] = '0000' THEN 0 ELSE 1 END, n) AS place
        FROM (SELECT o_custkey AS lei, isin, min(o_orderkey) AS n FROM (SELECT *, (['GB', 'FR', 'US'])[o_orderkey % 3 + 1] || CASE WHEN o_orderkey % 4 = 0 THEN '0000' ELSE '1234' END || o_orderkey // 2 AS isin FROM orders)
              WHERE isin[1:2] IN ('GB', 'FR') GROUP BY 1, 2)) WHERE place <= 20""")  # fmt: skip
def q_share_codes(s, sf):
    k = F.col("o_orderkey")
    country = F.when(k % 3 == 0, "GB").when(k % 3 == 1, "FR").otherwise("US")
    isin = _text(country, F.when(k % 4 == 0, "0000").otherwise("1234"), F.floor(k / 2))
    return jobs.share_codes(d.table(s, sf, "orders").select(F.col("o_custkey").alias("lei"), isin.alias("isin"), k.alias("n")), ["GB", "FR"])


def _store(s, sf):
    o = d.table(s, sf, "orders")
    k = F.col("o_orderkey")
    return o.select(F.when(k % 2 == 0, "lever").otherwise("ashby").alias("system"), (F.col("o_custkey") % 50).alias("board"), k.alias("id"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("pay_min"),
                    F.when(k % 8 != 1, F.col("o_totalprice")).alias("pay_max"), F.to_date("o_orderdate").alias("last_seen"))


@query("q_ads_with_pay", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 8 <> 1 AND o_orderdate >= TIMESTAMP '1998-01-01'")
def q_ads_with_pay(s, sf):
    return jobs.with_pay(_store(s, sf), F.lit("1998-01-01").cast("date")).select("id")


@query("q_store_counts", """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'lever' ELSE 'ashby' END AS system, count(*) AS ads, count(*) FILTER (o_orderkey % 4 <> 0) AS with_pay, count(DISTINCT o_custkey % 50) AS boards
    FROM orders GROUP BY 1""")  # fmt: skip
def q_store_counts(s, sf):
    return jobs.store_counts(_store(s, sf))


@query("q_largest_filers", "SELECT l_suppkey AS company_id, count(*) AS rows, count(DISTINCT p_name) AS titles FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1 ORDER BY rows DESC, company_id LIMIT 40")
def q_largest_filers(s, sf):
    return jobs.largest(d.filings(s, sf).select("company_id", "title"), 40)


@query("q_largest_advertisers", "SELECT o_custkey AS company_id, count(*) AS rows, count(DISTINCT o_orderpriority) AS titles FROM orders GROUP BY 1 ORDER BY rows DESC, company_id LIMIT 60")
def q_largest_advertisers(s, sf):
    return jobs.largest(d.table(s, sf, "orders").select(F.col("o_custkey").alias("company_id"), F.col("o_orderpriority").alias("title")), 60)


@query("q_sample_numbers", """
    SELECT doc_id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(left(lang || ':' || source, 40), ''), lambda c: unicode(c)::BIGINT)),
                               lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS number FROM documents""")  # fmt: skip
def q_sample_numbers(s, sf):
    return d.table(s, sf, "documents").select("doc_id", jobs.sample_number(F.left(F.concat_ws(":", "lang", "source"), F.lit(40))).alias("number"))


_SYSTEMS = ["greenhouse", "lever", "ashby", "smartrecruiters", "workday"]


@query("q_all_boards", """
    SELECT (['greenhouse', 'lever', 'ashby', 'smartrecruiters', 'workday'])[page_id % 5 + 1] AS system, 'b' || page_id AS board, CASE WHEN page_id % 5 = 4 THEN '/job/' || page_id ELSE page_id::VARCHAR END AS id,
           'Engineer ' || length(html) AS title, 'Provo, UT' AS location, CASE WHEN page_id % 5 = 4 THEN '/job/' || page_id ELSE url END AS url, CASE WHEN page_id % 5 < 3 THEN html END AS description FROM pages""")  # fmt: skip
def q_all_boards(s, sf):
    p = d.table(s, sf, "pages")
    id, title, place = F.col("page_id").cast("string"), _text("Engineer ", F.length("html")), F.lit("Provo, UT")
    docs = {
        "greenhouse": F.struct(F.array(F.struct(id.alias("id"), title.alias("title"), F.struct(place.alias("name")).alias("location"), F.col("url").alias("absolute_url"), F.col("html").alias("content"))).alias("jobs")),
        "lever": F.struct(F.array(F.struct(id.alias("id"), title.alias("text"), F.struct(place.alias("location")).alias("categories"), F.col("url").alias("hostedUrl"), F.col("html").alias("descriptionPlain"))).alias("jobs")),
        "ashby": F.struct(F.array(F.struct(id.alias("id"), title.alias("title"), place.alias("location"), F.col("url").alias("jobUrl"), F.col("html").alias("descriptionPlain"))).alias("jobs")),
        "smartrecruiters": F.struct(F.array(F.struct(id.alias("id"), title.alias("name"), F.struct(F.lit("Provo").alias("city"), F.lit("UT").alias("region")).alias("location"), F.col("url").alias("ref"))).alias("content")),
        "workday": F.struct(F.array(F.struct(_text("/job/", id).alias("externalPath"), title.alias("title"), place.alias("locationsText"))).alias("jobPostings")),
    }
    found = [documents.postings(p.filter(F.col("page_id") % 5 == n).select(_text("b", id).alias("board"), F.to_json(docs[system]).alias("json")), system, "board", "json") for n, system in enumerate(_SYSTEMS)]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return every


# --- whole texts of documents and pages ------------------------------------------------------------------------------------


@query("q_document_sentences", """
    SELECT doc_id, CAST(len(p) AS INTEGER) AS n, CAST(list_max(list_transform(p, lambda x: length(trim(x)))) AS INTEGER) AS longest, trim(p[-1]) AS last
    FROM (SELECT doc_id, string_split(regexp_replace(replace(t, chr(1), '.'), '([.!?])[ \\t\\n\\f\\r\\x0B]+(\\p{Lu})', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS p FROM (
          SELECT doc_id, text AS t FROM documents WHERE NOT regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(Mr|Mrs|Ms|Dr|Inc|Corp|Co|Ltd|Jr|Sr|St|No|\\p{Lu})\\.')))""")  # fmt: skip
def q_document_sentences(s, sf):
    short = r"(^|[^\p{L}\p{N}_])(Mr|Mrs|Ms|Dr|Inc|Corp|Co|Ltd|Jr|Sr|St|No|\p{Lu})\."
    docs = d.table(s, sf, "documents").filter(~F.col("text").rlike(short)).select("doc_id", markup.sentences(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").alias("n"), F.array_max(F.transform("p", lambda x: F.length(x))).alias("longest"), F.element_at("p", -1).alias("last"))


@query("q_document_money", """
    SELECT doc_id, CAST(2 + doc_id % 2 AS INTEGER) AS n, CAST(n_chars * 1e6 + (doc_id + 1) * 1000 + CASE WHEN doc_id % 2 = 1 THEN n_chars + 0.5 ELSE 0 END AS DOUBLE) AS total FROM documents""")  # fmt: skip
def q_document_money(s, sf):
    k, c = F.col("doc_id"), F.col("n_chars")
    said = _text(" It cost $", F.format_number(c, 0), " million in all, or $ ", k + 1, "k each", F.when(k % 2 == 1, _text(", and $", F.format_number(c + 0.5, 2), " more")).otherwise(""), ". ")
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.regexp_replace(F.left("text", half), r"\$", "_"), said, F.regexp_replace(F.substr("text", half + 1), r"\$", "_"))
    m = markup.money(text)
    return d.table(s, sf, "documents").select("doc_id", m.alias("m")).select("doc_id", F.size("m").alias("n"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("q_document_pay_ratios", """SELECT doc_id, CAST(40000 + n_chars AS DOUBLE) AS median, CAST((40000 + n_chars) * (60 + doc_id % 300) AS DOUBLE) AS ceo, CAST(60 + doc_id % 300 AS DOUBLE) AS ratio FROM documents""")
def q_document_pay_ratios(s, sf):
    k, c = F.col("doc_id"), F.col("n_chars")
    median, times = 40000 + c, 60 + k % 300
    said = _text(" The pay of our median employee was $", F.format_number(median, 0), " and that of our chief executive $", F.format_number(median * times, 0), F.when(k % 3 == 0, ", a ratio of 1 to ").otherwise(". The ratio is "),
                 F.format_number(times, 0), F.when(k % 3 == 0, ".").when(k % 3 == 1, ":1.").otherwise(" to one."), " ")
    half = F.floor(F.length("text") / 2).cast("int")
    text = F.concat(F.left("text", half), said, F.translate(F.substr("text", half + 1), "0123456789$", ""))
    return d.table(s, sf, "documents").select("doc_id", markup.pay_ratio(F.concat(F.translate(F.left(text, half), "0123456789$", ""), F.substr(text, half + 1))).alias("r")).select("doc_id", "r.*")


@query("q_page_table_cells", """
    SELECT page_id AS id, 0::BIGINT AS n_table, r::BIGINT AS row, CASE WHEN r = 0 THEN 0 ELSE c END::BIGINT AS first_column, CASE WHEN r = 0 THEN 2 ELSE c END::BIGINT AS last_column,
           CASE WHEN r = 0 THEN 'All of ' || page_id ELSE (length(html) + r * 10 + c)::VARCHAR END AS text
    FROM pages, range(3) a(r), range(3) b(c) WHERE r > 0 OR c = 0""")  # fmt: skip
def q_page_table_cells(s, sf):
    k, n = F.col("page_id"), F.length("html")
    cell = lambda r, c: _text("<td>", n + r * 10 + c, "</td>")
    table = _text("<table><tr><th colspan='3'>All <b>of</b>&nbsp;", k, "</th></tr>", *[x for r in (1, 2) for x in ("<tr>", cell(r, 0), cell(r, 1), cell(r, 2), "</tr>")], "</table>")
    return markup.table_cells(d.table(s, sf, "pages").select("page_id", F.concat("html", table).alias("html")), "page_id", "html")


@query("q_page_referrers", """SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', ''), '') AS host FROM pages""")
def q_page_referrers(s, sf):
    return d.table(s, sf, "pages").select("page_id", web.referrer_host(F.col("url"), "own.example").alias("host"))


# --- companies and people -------------------------------------------------------------------------------------------------


@query("q_pay_by_year", """
    SELECT person_id, year, sum(total)::DOUBLE AS total, any_value(CASE WHEN r = 1 THEN CASE WHEN company_id % 3 = 0 THEN 'T' || company_id WHEN company_id % 3 = 1 THEN 'O' || company_id ELSE company_id::VARCHAR END END) AS ticker
    FROM (SELECT person_id, year, company_id, total, row_number() OVER (PARTITION BY person_id, year ORDER BY total DESC, company_id) AS r FROM pay) GROUP BY 1, 2""")  # fmt: skip
def q_pay_by_year(s, sf):
    c = d.table(s, sf, "customer").select(F.col("c_custkey").alias("company_id"))
    near = c.filter("company_id % 3 = 0").withColumn("ticker", _text("T", F.col("company_id")))
    paid = matching.pay_by_year(d.pay(s, sf), near, c.filter("company_id % 3 = 1").withColumn("ticker", _text("O", F.col("company_id"))))
    return paid.withColumn("total", F.col("total").cast("double"))


@query("q_company_names", """
    SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(upper(replace(n, '&', ' AND ')), '[^A-Z0-9]+'), lambda w: w NOT IN ('GROUP', 'PLC', 'THE', 'LTD')), '') AS register,
           array_to_string(list_filter(regexp_split_to_array(lower(n), '[^a-z0-9]+'), lambda w: w NOT IN ('group', 'plc', 'the', 'and', 'ltd')), '') AS listing
    FROM (SELECT doc_id, 'The ' || regexp_replace(left(text, 20), '[^A-Za-z]+', ' ', 'g') || ' & Sons' || CASE WHEN doc_id % 2 = 0 THEN ' Group PLC' ELSE ', Ltd.' END AS n FROM documents)
    WHERE NOT regexp_matches(lower(n), '\\b(limited|holdings?|company|co|inc|corporation|corp|sa|nv|ag|se|public|nl)\\b')""")  # fmt: skip
def q_company_names(s, sf):
    name = F.concat(F.lit("The "), F.regexp_replace(F.left("text", F.lit(20)), "[^A-Za-z]+", " "), F.lit(" & Sons"), F.when(F.col("doc_id") % 2 == 0, " Group PLC").otherwise(", Ltd."))
    df = d.table(s, sf, "documents").select("doc_id", name.alias("n")).filter(~F.lower("n").rlike(r"\b(limited|holdings?|company|co|inc|corporation|corp|sa|nv|ag|se|public|nl)\b"))
    return df.select("doc_id", companies.register_name(F.col("n")).alias("register"), companies.listing_name(F.col("n")).alias("listing"))


@query("q_appointed_people", """
    SELECT c_custkey AS appointment_id, CASE c_custkey % 4 WHEN 0 THEN 'k' || c_custkey WHEN 1 THEN 'i' || c_custkey WHEN 2 THEN 'p' || c_custkey END AS person_id,
           (['known', 'insider', 'name', NULL])[c_custkey % 4 + 1] AS how FROM customer""")  # fmt: skip
def q_appointed_people(s, sf):
    k = F.col("c_custkey")
    c = d.table(s, sf, "customer")
    word = F.translate(k.cast("string"), "0123456789", "abcdefghij")
    name = F.concat(F.lit("Mia "), F.initcap(F.concat(F.lit("vale"), word)))
    appointments = c.select(k.alias("appointment_id"), k.alias("company_id"), name.alias("name"))
    known = c.filter(k % 4 == 0).select(k.alias("company_id"), F.upper(name).alias("name"), _text("k", k).alias("person_id"))
    insiders = c.filter(k % 4 == 1).select(k.alias("company_id"), F.concat(F.lit("VALE"), F.upper(word), F.lit(" MIA J")).alias("name"), _text("i", k).alias("insider_id"), F.lit(True).alias("is_officer"))
    twice = F.explode(F.when(k % 4 == 3, F.array(_text("x", k), _text("y", k))).otherwise(F.array(_text("p", k))))
    return matching.appointed_people(appointments, known, insiders, c.select(name.alias("name"), twice.alias("person_id")))


@query("q_orphan_orders", "SELECT DISTINCT o_custkey AS company_id FROM orders WHERE o_custkey % 3 <> 0")
def q_orphan_orders(s, sf):
    known = d.table(s, sf, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("company_id"))
    return quality.orphans(d.table(s, sf, "orders").select(F.col("o_custkey").alias("company_id")), known, "company_id")


@query("q_usual_spellings", """
    SELECT lower(t) AS key, min_by(t, (-n, t)) AS title, CAST(sum(n) AS BIGINT) AS filings FROM (
        SELECT CASE l_linenumber % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(left(p_name, 1)) || substr(p_name, 2) ELSE p_name END AS t, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) GROUP BY 1""")  # fmt: skip
def q_usual_spellings(s, sf):
    n = F.col("p_name")
    t = F.when(F.col("l_linenumber") % 3 == 0, F.upper(n)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.upper(F.left(n, F.lit(1))), F.substr(n, F.lit(2)))).otherwise(n)
    rows = d.table(s, sf, "lineitem").join(d.table(s, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return salaries.spellings(rows.select(t.alias("title")))
