import sys
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute
from test_brute_models import leaks

import corpus_pipeline
from ledgerline.llm import decontaminate, quality
from ledgerline.llm.shared import written

SF = "/root/testdata/sf0.001"


def test_stages_match_brute_force_each_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), "test")
        if name != "source mix":
            assert out.columns == docs.columns
        before, after = ({r["doc_id"]: r for r in d.collect()} for d in (docs, out))
        seen[name] = len(after)
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality.quality_report(docs).filter("kept").collect()}
            assert set(after) == kept
        if name == "line dedup":
            want = brute.line_report([(d, r["text"]) for d, r in before.items()])
            for d, r in after.items():
                assert sum(len(brute.words(x)) >= 1 for x in r["text"].split("\n")) == want[d][3]
        if name == "near dedup":
            assert set(after) == {d for d, w in brute.near_report([(d, r["text"]) for d, r in before.items()], 5).items() if w[2]}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            held = leaks([(d, r["text"]) for d, r in before.items()], items, decontaminate.Leaks())
            assert set(after) == {d for d in before if not held[d]}
        if name == "source mix":
            want = brute.mix([(d, r["text"], r["source"]) for d, r in before.items()])
            assert {d: (r["size"], r["source_size"], r["taken"]) for d, r in after.items()} == {d: (a, b, t) for d, (a, b, _, t) in want.items() if t}
        docs = out
    assert seen["quality rules"] > 100 and corpus_pipeline.run(spark, SF).agg(F.count("*")).first()[0] == seen["source mix"]


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (None, "one two three four five six seven eight nine ten eleven twelve.", None, "a", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("taken", F.lit("clash"))
    for some in (docs, docs.filter("false")):
        now = some
        for _, stage in corpus_pipeline.STAGES:
            now = written(stage(spark, now, SF), "test")
        now.collect()
