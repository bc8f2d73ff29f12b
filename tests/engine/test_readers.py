import hashlib
import random

import pytest

from ledgerline.operators import sets
from ledgerline.sources import files
from ledgerline.streaming import events


def put(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_curated_offices_keep_known_types(spark, tmp_path):
    path = put(tmp_path / "o.csv", 'Zip,TYPE,ticker,label,street,city,extra\n84043,Office,ABC,"A, B","1 ""Long"" Rd",Lehi,x\n84043,shed,ABC,C,2 Rd,Lehi,x\n1,HEADQUARTERS,DEF,D,3 Rd,Provo,x\n')
    rows = files.curated_offices(spark, path).orderBy("ticker").collect()
    assert [(r["ticker"], r["label"], r["street"], r["note"]) for r in rows] == [("ABC", "A, B", '1 "Long" Rd', None), ("DEF", "D", "3 Rd", None)]
    with pytest.raises(ValueError, match="street"):
        files.curated_offices(spark, put(tmp_path / "bad.csv", "ticker,type,label,city,zip\n"))


def test_constituents_without_an_identifier_have_none(spark, tmp_path):
    path = put(tmp_path / "c.csv", "ticker,name,sector,lei\nAAA,Acme,Mines, \nBBB,Béta,III,XYZ\n")
    assert [(r["ticker"], r["lei"]) for r in files.constituents(spark, path).orderBy("ticker").collect()] == [("AAA", None), ("BBB", "XYZ")]


def test_gazetteers_name_columns_by_place(spark, tmp_path):
    path = put(tmp_path / "g.tsv", "GB\tAB1\tAberdeen \t57.1\nGB\tAB2\n")
    rows = files.gazetteer(spark, path, {"code": 1, "town": 2, "latitude": 3}).orderBy("code").collect()
    assert [tuple(r) for r in rows] == [("AB1", "Aberdeen", "57.1"), ("AB2", None, None)]


def test_visitors_are_hashed_by_day(spark):
    e = spark.createDataFrame([("2024-01-01", "ip1", 1), ("2024-01-01", "ip1", 2), ("2024-01-02", "ip1", 3), ("2024-01-03", "ip1", 4)], "day string, who string, n int")
    s = spark.createDataFrame([("2024-01-01", "a"), ("2024-01-02", "b")], "day string, salt string")
    out = {r["n"]: r["visitor"] for r in events.hashed(e, s, "who").collect()}
    assert set(out) == {1, 2, 3} and out[1] == out[2] != out[3] and all(len(v) == 32 for v in out.values())
    assert "who" not in events.hashed(e, s, "who").columns and hashlib.md5(b"").hexdigest() not in out.values()


def test_fuzzy_members_match_brute_force(spark):
    r = random.Random(3)
    stems = ["sain", "sainsbury", "fash", "fashion", "jd", "sport", "sports", "al", "alpha", "j"]
    c = {f"T{i}": " ".join(r.choices(stems, k=r.randint(1, 4))) for i in range(40)}
    f = [(i, " ".join(r.choices(stems, k=r.randint(1, 3))), r.randint(1, 5)) for i in range(60)]
    want = {}
    for t, key in c.items():
        fits = [(len(k), -n, i) for i, k, n in f if max(map(len, k.split())) >= 3 and all(any(w.startswith(x) for w in key.split()) for x in k.split())]
        if fits:
            want[t] = min(fits)[2]
    got = sets.fuzzy_members(spark.createDataFrame(list(c.items()), "ticker string, key string"), spark.createDataFrame(f, "filer_id int, key string, filings int"))
    assert {r["ticker"]: r["filer_id"] for r in got.collect()} == want and len(want) > 20
