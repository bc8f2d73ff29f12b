"""Long runs and long addresses: each operator reads them whole, in time that does not grow with their square."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import bpe, fim, quality, spelling, tokens, urls, warc

MANY = 2_000_000
DOCS = [(1, "x" + " " * MANY + "y"), (2, "\n" * MANY), (3, "w" * MANY), (4, "word " * 12 + "..." + " " * 1_000_000 + "x"), (5, "word " * 12 + "..." + " \t" * 500_000),
        (6, "...\n" * 300_000), (7, "word " * 12 + "... read" + " " * 1_000_000 + "more")]
REPORTS = {
    "tokens": tokens.token_report, "quality": quality.quality_report, "bpe": bpe.bpe_report, "fim": fim.fim_report, "spelling": lambda d: spelling.spelling_report(d, spelling.Spelling(min_count=1)),
    "quality_clean": quality.quality_clean,
}


@pytest.mark.parametrize("name", REPORTS)
def test_runs_of_millions_of_characters(spark, name):
    began = time.time()
    REPORTS[name](spark.createDataFrame(DOCS, "doc_id long, text string")).write.format("noop").mode("overwrite").save()
    assert time.time() - began < 90


def test_tokens_of_long_runs_are_those_of_the_library(spark, monkeypatch):
    form = tokens.TokenFormat()
    texts = [" " * 3000 + "x", "a\n\n" + "\t" * 2000, "é  " * 900 + "\n" * 1500]
    plain = [tokens.encoded(t, form).tolist() for t in texts]
    monkeypatch.setattr(tokens, "LONG_RUN", 1000)
    assert [tokens.encoded(t, form).tolist() for t in texts] == plain
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_report(spark.createDataFrame([(1, " " * MANY + "x"), (2, None)], "doc_id long, text string")).collect()}
    assert counts == {1: len(bpe.encoder().encode(" " * MANY + "x")), 2: 0}


def test_ends_of_teasers_are_those_of_the_pattern(spark):
    words = quality.QualityRules().leads_on
    pattern = re.compile(rf"(\.\.\.|…)[\x20\x09-\x0D]*(\[?({'|'.join(words)})\]?)?[\x20\x09-\x0D»>]*$")
    r = random.Random(2)
    bits = ["...", "…", " ", "\t", "more", "read more", "leer más", "[", "]", "»", ">", "x", "bread", "lire la suite", ".", ""]
    lines = ["".join(r.choices(bits, k=r.randint(0, 7))) for _ in range(4000)]
    df = spark.createDataFrame([(x,) for x in lines], "x string").select("x", quality._teases(F.col("x"), words).alias("t"))
    for x, t in df.collect():
        assert t == bool(pattern.search(x)), repr(x)


def test_an_address_of_a_million_characters(spark):
    began = time.time()
    pages = [(i, f"http://a{i}.org/x{i}") for i in range(20)] + [(i, f"http://b{i}.com/de/{i}") for i in range(20, 40)] + [(50, "http://c.net/" + "ab/" * 333_333), (51, "q" * 1_000_000)]
    out = {r["page_id"]: r for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert len(out) == 42 and out[50]["score"] is not None and time.time() - began < 90


def test_grams_end_at_each_character_and_hot_grams_are_dealt_out(spark, monkeypatch):
    df = spark.createDataFrame([("ab",), ("",), ("é/",)], "u string").select("u", urls._grams(urls._spelled(F.col("u"))).alias("g"))
    got = {r["u"]: r["g"] for r in df.collect()}
    assert got["ab"] == ["\x02\x02\x02a", "\x02\x02ab", "\x02ab\x03"] and got[""] == ["\x02\x02\x02\x03"] and len(got["é/"]) == 3
    pages = [(i, f"http://{'abc'[i % 3]}{i}.{['org', 'com', 'net'][i % 3]}/{['x', 'de', 'y'][i % 3]}/{i}") for i in range(90)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    whole = {r["page_id"]: (r["verdict"], r["score"] and round(r["score"], 9)) for r in urls.url_verdicts(df).collect()}
    monkeypatch.setattr(urls, "HOT_GRAMS", 7)
    assert {r["page_id"]: (r["verdict"], r["score"] and round(r["score"], 9)) for r in urls.url_verdicts(df).collect()} == whole


def test_a_page_of_many_megabytes_goes_into_an_archive_and_back(spark):
    df = spark.createDataFrame([(1, "http://a", "x" * 8_000_000), (2, "http://b", "x" * 8_000_000), (3, "http://c", None)], "page_id long, url string, html string")
    out = {r["page_id"]: r["record_type"] for r in warc.warc_report(df).collect()}
    assert out == {1: "revisit", 2: "response", 3: "response"}
