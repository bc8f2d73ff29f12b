import datetime as dt
import math
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import places, text
from ledgerline.operators import markup, people, quality, search, visitors
from ledgerline.sources import files, publish
from ledgerline.streaming import events as stream


def test_a_failed_publish_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "companies")
    rows = lambda *ids: spark.createDataFrame([(i, f"N{i}") for i in ids], "company_id string, name string")
    checks = {"no name": F.col("name").isNull()}
    publish.replace_partition(root, rows("1", "2"), "market", "sec", checks, ["company_id"])
    publish.replace_partition(root, rows("9"), "market", "uk", checks, ["company_id"])
    before = publish.current(spark, root)
    with pytest.raises(ValueError, match="no name: 1 rows"):
        publish.replace_partition(root, rows("3").withColumn("name", F.lit(None).cast("string")), "market", "sec", checks, ["company_id"])
    with pytest.raises(ValueError, match="repeated company_id"):
        publish.replace_partition(root, rows("9"), "market", "sec", checks, ["company_id"])
    assert publish.current(spark, root) == before
    publish.replace_partition(root, rows("5"), "market", "sec", checks, ["company_id"])
    assert {(r["company_id"], r["market"]) for r in spark.read.parquet(publish.current(spark, root)).collect()} == {("5", "sec"), ("9", "uk")}


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "z.csv").write_text('Latitude,CITY,zip,state,longitude,extra\n40.4,"Lehi, ""old""",8404,UT,-111.8,x\nbad,Nowhere,1,UT,0,y\n43.6,Toronto,m5j,ON,-79.4,\n')
    (tmp_path / "eu.csv").write_text("zip,city,state,latitude,longitude,country\n1012 AB,Amsterdam,NL,52.4,4.9,NL\n8002,Barcelona,ES,41.4,2.2,ES\n")
    got = {r["zip_key"]: r["city"] for r in files.zip_table(spark, [str(tmp_path / "z.csv"), str(tmp_path / "eu.csv")]).collect()}
    assert got == {"08404": 'Lehi, "old"', "CA:M5J": "Toronto", "NL:1012": "Amsterdam", "ES:08002": "Barcelona"}
    with pytest.raises(ValueError, match="lacks columns: employer, ticker"):
        files.employer_aliases(spark, str(tmp_path / "z.csv"))


def test_workbooks_are_read_by_header_and_cells_typed(spark, tmp_path):
    path = tmp_path / "book.xlsx"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Wage</t></si><si><t>Case</t></si><si><t>$1,200.50</t></si></sst>')
        rows = ('<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>When</t></is></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>7</v></c><c r="D2"><v>45292</v></c></row>'
                '<row><c r="C3"><v>x</v></c></row>')  # fmt: skip
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    df = files.union_workbooks(spark, [str(path), str(tmp_path / "none.xlsx")], "data", ["case", "wage", "when"])
    got = files.typed(df, {"case": "int", "wage": "decimal", "when": "date"}).orderBy("case").collect()
    assert [(r["case"], r["wage"] and float(r["wage"]), r["when"], r["problems"]) for r in got] == [(None, None, None, ["case"]), (7, 1200.5, dt.date(2024, 1, 1), [])]


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id TEXT, n INTEGER, more TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, 'x')", [(f"i{i}", i) for i in range(25)])
    files.register(spark)
    df = spark.read.format("sqlite_table").schema("id string, n long, row_ord long").option("path", path).option("table", "t").option("rows", "10").load()
    assert df.rdd.getNumPartitions() == 3 and df.agg(F.sum("n"), F.max("row_ord"), F.count("*")).first() == (300, 25, 25)


def test_a_stream_of_events_makes_the_visits_and_days_of_the_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 23, 0)
    r = random.Random(5)
    rows = [(i, start + dt.timedelta(minutes=r.randint(0, 600)), r.randint(1, 4), r.choice(["view", "click"])) for i in range(200)] + [(999, start, 7, "view"), (1000, start + dt.timedelta(minutes=30), 7, "view")]
    e = spark.createDataFrame(rows, "event_id long, at timestamp, visitor long, name string").withColumn("day", F.date_format("at", "yyyy-MM-dd"))
    e = e.withColumn("device", F.lit("d")).withColumn("country", F.lit("c"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    late = spark.createDataFrame([(5000, start + dt.timedelta(days=9), 1, "view")], "event_id long, at timestamp, visitor long, name string").withColumn("day", F.lit("2024-01-10"))
    late.withColumn("device", F.lit("d")).withColumn("country", F.lit("c")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, made, key in (("visits", stream.visits(source), ["day", "visitor", "events"]), ("days", stream.daily(source), ["day", "events"])):
        q = made.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
        batch = visitors.visits(e) if name == "visits" else visitors.daily(e, "2024-01-01", "2024-01-02")
        want = sorted(tuple(x[k] for k in key) for x in batch.collect())
        got = sorted(tuple(x[k] for k in key) for x in spark.table(name).collect() if x["day"] < "2024-01-10")
        assert got == want


def test_events_and_ads_are_stored_batch_by_batch(spark, tmp_path):
    ads = lambda day, *rows: spark.createDataFrame([(i, t, p, dt.date(2024, 5, day)) for i, t, p in rows], "id string, title string, pay_min double, day date").coalesce(1).write.mode("append").parquet(str(tmp_path / "ads"))
    schema = "id string, title string, pay_min double, day date"
    for day, rows in ((1, [("a", "old", 5.0), ("b", "b", None)]), (3, [("a", "new", None), ("c", "c", 1.0)])):
        ads(day, *rows)
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "ads"))
        stream.seen_ads(source, str(tmp_path / "store"), str(tmp_path / "check"), ["id"]).awaitTermination(120)
    got = {r["id"]: (r["title"], r["pay_min"], r["first_seen"].day, r["last_seen"].day) for r in spark.read.parquet(str(tmp_path / "store" / "batch-1")).collect()}
    assert got == {"a": ("new", 5.0, 1, 3), "b": ("b", None, 1, 1), "c": ("c", 1.0, 3, 3)}
    spark.createDataFrame([(1, "2024-05-01"), (2, "2024-05-02")], "event_id long, day string").write.parquet(str(tmp_path / "e"))
    q = stream.stored(spark.readStream.schema("event_id long, day string").parquet(str(tmp_path / "e")), str(tmp_path / "kept"), str(tmp_path / "c2"), 1)
    q.processAllAvailable()
    q.stop()
    assert {(r["event_id"], str(r["day"])) for r in spark.read.parquet(str(tmp_path / "kept")).collect()} == {(1, "2024-05-01"), (2, "2024-05-02")}


def test_cells_of_tables_with_spans():
    page = ("<p>x<table><tr><th rowspan='2'>a<td colspan=2>b &amp; c</td></tr><tr><td>d<td>e</tr><tr><td></td></tr><tr><td>f<table><tr><td>inner</td></tr></table></td></tr></table>"
            "<TABLE><TR><TD rowspan=99>z</TD></TR></TABLE>")  # fmt: skip
    first, second = markup.grids(page)
    assert first == [(0, 0, 0, "a"), (0, 1, 2, "b & c"), (1, 1, 1, "d"), (1, 2, 2, "e"), (2, 0, 0, "f inner")]
    assert second == [(0, 0, 0, "z")]


@pytest.mark.parametrize("given, want", [
    ("Pay: $120,000 - $160,000", (120_000, 160_000)), ("$45.00/hr – $60.00/hr", (93_600, 124_800)), ("136,000 USD - 218,500 USD", (136_000, 218_500)), ("$211.4K – $290.6K", (211_400, 290_600)),
    ("between $95K and $120K", (95_000, 120_000)), ("Hourly pay: $45 - $60", (93_600, 124_800)), ("$5,000 to $6,000 per month", (60_000, 72_000)), ("$2 - $3 billion", None), ("5 - 10 years", None),
    ("bonus of $500 to $900, then $100,000 to $150,000 a year", (100_000, 150_000)), ("$20,000 - $200,000", None), ("", None), (None, None)])
def test_pay_ranges_of_ads(given, want):
    got = markup.first_range(given)
    assert (got and (got["pay_min"], got["pay_max"])) == want


def test_peers_are_those_in_the_band_or_else_the_closest(spark):
    r = random.Random(3)
    rows = [(i, f"T{i}", r.choice(["A", "A", "B"]), r.choice(["sec", "sec", "uk"]), r.choice(["USD", "EUR", "SEK"]), r.choice([1999, 2000, 2001]), math.exp(r.uniform(0, 9)), float(r.randint(1, 60) * 1000)) for i in range(260)]
    c = spark.createDataFrame(rows, "company_id long, ticker string, sector string, market string, currency string, year long, revenue_usd double, top_pay double")
    got = {x["company_id"]: (x["peers"], x["lower"], x["percentile"]) for x in people.peer_pay(c).collect()}
    rate = {"USD": 1.0, "EUR": 1.08, "SEK": 0.095}
    want = {}
    for i, _, s, m, cur, y, rev, top in rows:
        recent = [(abs(math.log(o[6] / rev)), o[0], o) for o in rows if o[0] != i and o[2] == s and o[3] == m and o[5] >= y - 1]
        peers = [o for _, _, o in recent if rev / 3 <= o[6] <= rev * 3]
        peers = peers if len(peers) >= 20 else [o for *_, o in sorted(recent)[:20]]
        if len(peers) >= 5:
            lower = sum((o[7] if o[4] == cur else round(o[7] * rate[o[4]] / rate[cur])) < top for o in peers)
            want[i] = (len(peers), lower, round(100 * lower / len(peers)))
    assert got == want


def test_names_are_found_by_ticker_and_accents(spark):
    df = spark.createDataFrame([("BMW", "BMW AG", "x"), ("NES", "Nestlé S.A.", "x"), ("NESX", "Other", "x"), ("Q", "Société Générale", "x")], "ticker string, name string, sector string")
    score = lambda q: {r["ticker"]: r["s"] for r in df.select("ticker", text.name_score(text.search_name(F.col("name")), q, F.col("ticker")).alias("s")).filter("s > 0").collect()}
    assert score("nes") == {"NES": 100, "NESX": 50} and score("nestle") == {"NES": 80} and score("generale") == {"Q": 60} and score("tle s") == {"NES": 30}
    assert {r["ticker"] for r in search.matching(df, "NESTLÉ").collect()} == {"NES"} and search.matching(df, " ").count() == 4


def test_regions_by_what_people_type(spark):
    asked = ["Texas", "CA", "Québec", "Washington", "Washington, USA", "the netherlands", "Ontario Canada", "Dallas US", None, ""]
    df = spark.createDataFrame(list(enumerate(asked)), "n int, q string")
    got = [r["region"] for r in places.find_regions(df, "q").orderBy("n").collect()]
    assert got == ["US-TX", "US-CA", "CA-QC", None, "US-WA", "NL", "CA-ON", None, None, None]
    spots = spark.createDataFrame([("NL", -53.0), ("NL", 5.0), ("tx", -97.0), ("UK", 0.0)], "state string, longitude double")
    assert places.in_region(spots, "CA").count() == 1 and places.in_region(spots, "US-TX").count() == 1 and places.in_region(spots, "NL").count() == 1


def test_pay_ratios_need_amounts_that_have_them(spark):
    good = "CEO pay ratio. The median of the annual total compensation was $68,254 and our CEO's was $63.2 million, so approximately 926 to 1 for 2025."
    rows = [(1, good), (2, good.replace("926", "500")), (3, "no such thing"), (4, None), (5, "median employee $50,000; CEO 8,965,642; ratio 1:179.3")]
    got = {r["n"]: r["r"]["ratio"] for r in spark.createDataFrame(rows, "n int, t string").select("n", markup.pay_ratio(F.col("t")).alias("r")).collect()}
    assert {k: v and round(v, 1) for k, v in got.items()} == {1: 926.0, 2: None, 3: None, 4: None, 5: 179.3}


def test_reports_and_exports_are_written(spark, tmp_path):
    df = spark.createDataFrame([(2, 'b, "x"'), (1, "a|b"), (3, None)], "id int, name string")
    publish.write_csv(df, str(tmp_path / "out"), ["id"])
    back = spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').collect()
    assert [(r["id"], r["name"]) for r in sorted(back, key=lambda r: r["id"])] == [("1", "a|b"), ("2", 'b, "x"'), ("3", None)]
    assert publish.markdown(df.orderBy("id"), 2).split("\n") == ["| id | name |", "| --- | --- |", "| 1 | a\\|b |", '| 2 | b, "x" |']
    assert [r["example"] for r in quality.examples(df, F.col("id") > 1, F.concat(F.lit("row "), "id"), 1).collect()] == ["row 2"]
    old = spark.createDataFrame([("h1b", "x"), ("postings", "y")], "source string, title string")
    publish.replace_partition(str(tmp_path / "s"), old.filter("source = 'h1b'").drop("source"), "source", "h1b")
    publish.replace_partition(str(tmp_path / "s"), spark.createDataFrame([("z",)], "title string"), "source", "postings")
    assert {(r["title"], r["source"]) for r in spark.read.parquet(publish.current(spark, str(tmp_path / "s"))).collect()} == {("x", "h1b"), ("z", "postings")}
