import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import jobs
from ledgerline.sources import stored

FILINGS = "company_id int, title string, occupation string, city string, state string, code string, salary double"


def test_salaries_have_the_usual_occupation_and_the_point_of_the_usual_code(spark):
    rows = [(1, "Sr Engineer", o, c, "UT", z, float(p)) for o, c, z, p in (
        ("a", "Provo", "1", 10), ("b", "Provo", "2", 20), ("b", "Provo", "2", 40), (None, "Lehi", "3", 50), (None, "", "4", 60))]
    rows += [(1, "rare", "a", "Provo", "UT", "1", 5.0), (1, "(all in brackets)", "a", "Provo", "UT", "1", 5.0), (2, "Sr Engineer", None, None, None, None, None)]
    codes = spark.createDataFrame([("2", 40.0, -111.0), ("9", 0.0, 0.0)], "code string, latitude double, longitude double")
    out = {r["city"]: r for r in jobs.job_salaries(spark.createDataFrame(rows, FILINGS), codes).collect()}
    assert set(out) == {None, "Provo"}
    assert (out[None]["filings"], out[None]["occupation"], out[None]["latitude"], out[None]["p50"]) == (5, "b", None, 40.0)
    assert (out["Provo"]["filings"], out["Provo"]["code"], out["Provo"]["longitude"], out["Provo"]["low"], out["Provo"]["high"]) == (3, "2", -111.0, 10.0, 40.0)


def test_filings_are_read_once_and_those_without_a_company_go(spark, tmp_path):
    rows = [(c, "Engineer", "a", "Provo", None, "1", float(p)) for c in (1, None) for p in (10, 20, 30, 40)] + [(1, "Engineer", "b", None, "UT", "2", None)] * 5
    spark.createDataFrame(rows, FILINGS).write.parquet(f"{tmp_path}/given")
    df = jobs.job_salaries(spark.read.parquet(f"{tmp_path}/given"), spark.createDataFrame([("1", 1.0, 2.0)], "code string, latitude double, longitude double"))
    assert not any("/given/" in f for f in df.inputFiles())
    assert {(r["company_id"], r["city"], r["state"], r["occupation"], r["code"], r["filings"], r["p50"]) for r in df.collect()} == {(1, None, None, "b", None, 4, 25.0), (1, "Provo", None, "b", "1", 4, 25.0)}


def test_ads_count_in_each_of_their_cities_and_link_the_newest(spark):
    rows = [(1, "Engineer", "Austin, TX; Provo, UT", 100.0, 200.0, "u1", date(2024, 1, 1)), (1, "engineer", "Austin, Texas", 120.0, 140.0, "u2", date(2024, 5, 1)),
            (1, "Engineer", None, 300.0, 310.0, "u0", date(2023, 1, 1)), (1, None, "Austin, TX", 1.0, 2.0, "u9", date(2025, 1, 1))]
    ads = spark.createDataFrame(rows, "company_id int, title string, location string, pay_min double, pay_max double, url string, seen date")
    out = {r["city"]: (r["ads"], r["url"], r["low"], r["p25"], r["p50"], r["p75"], r["high"]) for r in jobs.ad_summaries(ads).collect()}
    assert out == {None: (3, "u2", 100.0, 120.0, 150.0, 200.0, 310.0), "Austin": (2, None, 100.0, 110.0, 140.0, 170.0, 200.0), "Provo": (1, None, 100.0, 100.0, 150.0, 200.0, 200.0)}
    assert jobs.ad_summaries(ads.filter("false")).count() == 0


def test_sources_fall_back_to_keys_without_a_kind(spark):
    extras = spark.createDataFrame([("job_salaries.from", "2020-01-01"), ("job_salaries.visa.from", "2021-01-01"), ("job_salaries.to", "2021-12-31"), ("job_salaries.ads.from", "2022-01-01"), ("x", "y")], "key string, value string")
    kinds = spark.createDataFrame([("visa",), ("ads",), ("visa",)], "kind string")
    assert [tuple(r) for r in jobs.salary_sources(kinds, extras).collect()] == [("visa", date(2021, 1, 1), date(2021, 12, 31), "")]


def test_old_codes_of_shares_come_first(spark):
    rows = [("l", i, c) for i, c in enumerate(["FR0000131104", "GB1234567890", "US0000000000", "GB0000000001", "GB1234567890", "FR9"])]
    out = jobs.share_codes(spark.createDataFrame(rows, "lei string, n int, isin string"), ["GB", "FR"], 3).orderBy("place").collect()
    assert [r["isin"] for r in out] == ["FR0000131104", "GB0000000001", "GB1234567890"]


def test_sample_numbers_are_fnv(spark):
    r = random.Random(1)
    texts = ["", "a", "foobar", "é日🙂", *["".join(r.choices("abc xyz", k=r.randint(1, 30))) for _ in range(50)]]

    def fnv(t):
        h = 2166136261
        for b in t.encode():
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        return h

    got = {x["t"]: x["n"] for x in spark.createDataFrame([(t,) for t in texts], "t string").select("t", jobs.sample_number(F.col("t")).alias("n")).collect()}
    assert got == {t: fnv(t) for t in texts} and got["foobar"] == 0xBF9CF968


def test_percentiles_of_one_title_with_most_rows(spark):
    r = np.random.default_rng(1)
    pay = [float(x) for x in r.integers(1, 50, 400)]
    rows = [(1, "Cook", "o", "Provo", "UT", "1", p) for p in pay]
    codes = spark.createDataFrame([], "code string, latitude double, longitude double")
    out = [x for x in jobs.job_salaries(spark.createDataFrame(rows, FILINGS), codes).collect() if x["city"] is None][0]
    assert [out["p25"], out["p50"], out["p75"]] == pytest.approx([np.percentile(pay, q).round() for q in (25, 50, 75)], abs=0.51)


def test_stored_tables_stay_until_they_are_cleared(spark):
    df = stored.stored(spark.range(5).withColumn("x", F.rand()))
    first = sorted(map(tuple, df.collect()))
    assert sorted(map(tuple, df.collect())) == first
    stored.cleared(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
