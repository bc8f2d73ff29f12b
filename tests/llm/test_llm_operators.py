import random
import struct
import sys
import time
import zipfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from ledgerline.llm import decontaminate, lines, lm, minhash, mixing, quality, tokens, toxicity, urls, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string"
VOCABULARY = [f"w{i}" for i in range(60)]


def made(n=60, seed=1):
    """Texts with equal lines, near lines, copies and near copies."""
    r = random.Random(seed)
    sentence = lambda: " ".join(r.choices(VOCABULARY, k=r.randint(3, 30)))
    pool = [sentence() for _ in range(30)]
    out = []
    for i in range(n):
        ls = [r.choice(pool) if r.random() < 0.5 else sentence() for _ in range(r.randint(1, 6))]
        if out and r.random() < 0.3:
            w = r.choice(out)[1].split(" ")
            k = r.randrange(len(w))
            ls = [" ".join(w[:k] + ([] if r.random() < 0.5 else ["x"]) + w[k + 1:])] if r.random() < 0.7 else [" ".join(w)]
        out.append((i, "\n".join(ls), r.choice(["a", "b", "c", None]), "en"))
    return out


ODD = [(1, None, None, None), (2, "", "a", "en"), (3, "  \n\t", "a", None), (None, "one two three four five six seven eight nine ten eleven", "b", "en"),
       (4, "same words here and there again now ok fine yes", "a", "en"), (4, "same words here and there again now ok fine yes", "a", "en"),
       (5, "long " * 60_000, "c", "en"), (6, "ÄÖ é 日本 🙂\nline", "a", "de")]
OPERATORS = {
    "tokens": lambda d: tokens.token_report(d), "mixing": lambda d: mixing.mix_report(mixing.sizes(d)), "lines": lambda d: lines.line_report(d),
    "near": lambda d: minhash.near_report(d), "quality": lambda d: quality.quality_report(d), "lm": lambda d: lm.lm_report(d),
    "leaks": lambda d: decontaminate.leak_report(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    "toxicity": lambda d: toxicity.toxicity_report(d, d.select("doc_id", F.lit(1).alias("toxic"))),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_empty_tables_and_clashing_columns(spark, name):
    df = spark.createDataFrame(ODD, DOCS)
    for extra in ("id", "n", "score", "line", "key", "text_hash", "size", "words"):
        df = df.withColumn(extra, F.lit(None).cast("string"))
    rows = OPERATORS[name](df).collect()
    assert len(rows) == len(ODD)
    assert OPERATORS[name](df.filter("false")).count() == 0


@pytest.mark.parametrize("clean", [quality.quality_clean, lines.line_clean, minhash.near_clean, mixing.mix_documents])
def test_cleaning_keeps_columns_and_survives_odd_rows(spark, clean):
    df = spark.createDataFrame(ODD, DOCS)
    out = clean(df)
    assert out.columns[: len(df.columns)] == df.columns
    out.collect()
    assert clean(df.filter("false")).count() == 0


def test_mixing_matches_brute_force(spark):
    rows = made() + [(100, None, "a", "en"), (101, "", None, "en")]
    docs = spark.createDataFrame(rows, DOCS)
    want = brute.mix([(d, t, s) for d, t, s, _ in rows])
    for mix in (mixing.Mix(block_words=7, cell_rows=5), mixing.Mix()):
        got = {r["key"]: r for r in mixing.mix_report(mixing.sizes(docs), mix).collect()}
        for d, (size, total, target, _) in want.items():
            assert (got[d]["size"], got[d]["source_size"]) == (size, total)
            assert abs(got[d]["target"] - target) < 1e-6 and got[d]["taken"] <= 2 * size
        for s in {r[2] for r in rows}:
            own = [r for r in got.values() if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lines_match_brute_force(spark, seed):
    rows = made(seed=seed)
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.line_report(spark.createDataFrame(rows, DOCS)).collect()}
    want = brute.line_report([(d, t) for d, t, *_ in rows])
    assert got == want
    cleaned = lines.line_clean(spark.createDataFrame(rows, DOCS)).collect()
    long = {r["doc_id"]: sum(len(brute.words(x)) >= 1 for x in r["text"].split("\n")) for r in cleaned}
    assert all(long.get(d, 0) == w[3] for d, w in want.items())


@pytest.mark.parametrize("k", [4, 5])
def test_near_groups_match_brute_force(spark, k):
    rows = made(120, seed=7) + [(500 + i, "a b c d e f g h i j k l m n o p q r s t " + ("z " * (i % 2)), "a", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in minhash.near_report(docs, minhash.Near(shingle=k)).collect()}
    want = brute.near_report([(d, t) for d, t, *_ in rows], k)
    assert got == want
    kept = {r["doc_id"] for r in minhash.near_clean(docs, minhash.Near(shingle=k)).collect()}
    assert kept == {d for d, w in want.items() if w[2]}


def test_sketches_agree_as_often_as_sets_do():
    r = np.random.default_rng(0)
    base = r.integers(0, 2**63, 400).astype(np.uint64)
    for shared in (100, 200, 300):
        a, b = base[:300], base[300 - shared: 600 - shared]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        agree = (minhash.sketch(a, 2000) == minhash.sketch(b, 2000)).mean()
        assert abs(agree - true) < 0.05
    assert (minhash.sketch(base[:1], 240) != np.iinfo(np.uint64).max).all()


def test_quality_counts_match_brute_force(spark):
    texts = [t for _, t, *_ in made(40, seed=5)] + ["a b c d e a b c d e f", "# x * y", "x\nx\n\nx", None, ""]
    got = quality.quality_report(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        w = brute.words(t)
        windows = [tuple(w[i: i + 5]) for i in range(len(w) - 4)]
        inside = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(5)}
        some = [x for x in (t or "").split("\n") if brute.words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(inside))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "") and r["n_dup_lines"] == len(some) - len(set(some))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        assert not (r["kept"] and r["base_failed"])


def test_quality_removes_lines_first(spark):
    prose = "The river rose over night and the people of the town moved to the hills before dawn."
    menu = "Home | News | Sport | About | Contact"
    rows = [(1, f"{menu}\n{prose}", "a", "en"), (2, "\n".join([menu] * 9 + ["We met there once and left."]), "a", "en"), (3, prose, "a", "en")]
    out = {r["doc_id"]: r["text"] for r in quality.quality_clean(spark.createDataFrame(rows, DOCS)).collect()}
    assert out == {1: prose, 3: prose}


def test_wand_finds_what_full_scoring_finds():
    r = random.Random(3)
    rules = decontaminate.Leaks(block=3, segment=16)
    items = [(i, " ".join(r.choices([f"t{j}" for j in range(80)], k=40)) + ". " + " ".join(r.choices([f"t{j}" for j in range(80)], k=12))) for i in range(60)]
    index = decontaminate.Index.of(items, rules)
    for _ in range(300):
        text = r.choice(items)[1].split()[: r.randint(5, 52)] + r.choices([f"t{j}" for j in range(80)], k=r.randint(0, 20))
        words = decontaminate.word_hashes([" ".join(text)], marks=False)[0]
        terms = sorted({int(p) for p in np.searchsorted(index.terms, words) if p < len(index.terms)} & {
            i for i, t in enumerate(index.terms.tolist()) if t in set(words.tolist())})
        scores = np.zeros(len(index.items))
        for t in terms:
            for d, x in zip(*index.postings[t][:2]):
                scores[d] += x
        assert index.search(terms) == np.flatnonzero(scores >= rules.threshold - 1e-9).tolist()


def test_planted_items_are_found(spark):
    filler = " ".join(f"f{i}" for i in range(900))
    item = "which planet is the third from the sun and has one large moon. the answer is of course the planet earth itself"
    docs = [(1, filler, "a", "en"), (2, f"{filler} {item.upper()} {filler}", "a", "en"), (3, item, "a", "en"), (4, "the planet and the sun", "a", "en")]
    bench = spark.createDataFrame([(7, item), (8, None), (None, "x")], "item_id long, text string")
    d = spark.createDataFrame(docs, DOCS)
    got = {r["doc_id"]: r["item_ids"] for r in decontaminate.leak_report(d, bench).collect()}
    assert got == {1: [], 2: [7], 3: [7], 4: []}
    assert {r["doc_id"] for r in decontaminate.leak_clean(d, bench).collect()} == {1, 4}


def test_token_counts_over_tiny_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    form = tokens.TokenFormat(block_bytes=1000, file_bytes=50_000)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_report(docs, form).collect()}
    assert got == {r["doc_id"]: len(tokens.encoded(r["text"], form)) for r in docs.select("doc_id", "text").collect()}


def test_token_file_without_last_end(spark, tmp_path):
    np.asarray([5, 6, 50256, 50256, 7], "<u2").tofile(tmp_path / "a.tokens")
    (tmp_path / "b.tokens").write_bytes(b"")
    got = tokens.scan_token_files(tokens.token_files(spark, [str(tmp_path / "a.tokens"), str(tmp_path / "b.tokens")]), tokens.TokenFormat(block_bytes=4)).collect()
    assert sorted((r["ordinal"], r["n_tokens"], r["ended"]) for r in got) == [(0, 2, True), (1, 0, True), (2, 1, False)]


def test_archives_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/", big), (2, "http://b/ x", big), (3, None, big), (4, "u", "small"), (5, "v", "small"), (6, "w", None), (None, "n", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit("clash"))
    got = {r["page_id"]: r for r in warc.warc_report(pages).collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), None: ("response", None)}
    assert all(r["checked"] for r in got.values()) and got[3]["payload_bytes"] == 1200
    assert warc.warc_report(pages.filter("false")).count() == 0


def test_zip64_members_are_located(tmp_path):
    path = tmp_path / "a.wacz"
    with zipfile.ZipFile(path, "w") as z:
        for name, data in (("x", b"abc" * 50), ("y", b"hello")):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as m:
                m.write(data)
    raw = path.read_bytes()
    for m, want in zip(warc.zip_members(str(path)), (b"abc" * 50, b"hello")):
        assert raw[m.offset: m.offset + m.size] == want and m.stored
    end = raw.rindex(b"PK\x05\x06")
    count, size, at = struct.unpack_from("<10xHII", raw, end)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    path.write_bytes(raw[:end] + wide + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    assert [m.name for m in warc.zip_members(str(path))] == ["x", "y"]


def test_urls_follow_rules_and_models(spark):
    some = ["http://EXAMPLE.org/es/a?b", "http://sub.example.org/en/12#x", "http://x.org/", "http://org", "https://a.com/fr/1", "https://a.com/de/1",
            "notaurl", "", None, "http://b.net/p?q", "http://b.net", "ftp://c.net/x y/é"]
    some += [f"http://good{i}.com/fr/article" for i in range(40)] + [f"http://casino{i}.com/de/win-big" for i in range(40)]
    some += ["http://good.net/xx/article", "http://casino.net/yy/win-big"]
    pages = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.url_verdicts(pages).collect()}
    rules = [(r.allow, r.host, r.path) for r in urls.RULES]
    for i, u in enumerate(some):
        assert (got[i]["host"], got[i]["path"]) == brute.url_parts(u)
        name, verdict = brute.url_rule(u, rules)
        assert got[i]["rule"] == name and (name is None or got[i]["verdict"] == verdict) and got[i]["verdict"] in ("allow", "block")
    assert got[len(some) - 2]["verdict"] == "allow" and got[len(some) - 1]["verdict"] == "block"
    assert urls.url_verdicts(pages.filter("false")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    assert auc > 0.95 and got.score.between(0, 1).all()


def test_windows_score_each_token_once():
    rules = lm.Lm()
    lengths = np.asarray([1, 63, 64, 65, 116, 117, 500])
    start, length, scored = lm.windows(lengths, rules)
    seen = np.zeros(lengths.sum(), int)
    for s, n, f in zip(start, length, scored):
        seen[s + f: s + n] += 1
    assert (seen == 1).all()


def batch_of(net, r, windows=3):
    n = net.lm.window
    ids = r.integers(0, net.lm.end + 1, windows * n).astype(np.int32)
    cells = lm.Cells(ids, np.asarray([n] * windows), net.lm)
    return ids, cells


def test_gradient_is_that_of_the_loss():
    net, r = lm.Network(lm.Lm(width=6, window=8, step=6, bits=9)), np.random.default_rng(1)
    net.w = {k: v.astype(np.float64) + 0.1 * r.standard_normal(v.shape) for k, v in net.w.items()}
    net.t = [x.astype(np.float64) for x in net.t]
    ids, cells = batch_of(net, r)
    some = cells.before.reshape(-1, 8), *cells.at(np.arange(len(ids)))
    g, dp, _ = net.gradient(*some)
    for name in [*net.w, 0, 1, 2]:
        for _ in range(3):
            if name in net.w:
                of, at = net.w[name], tuple(r.integers(0, n) for n in net.w[name].shape)
                want = g[name][at]
            else:
                of, token = net.t[name], r.integers(0, len(ids))
                row, k = cells.rows[name][token], r.integers(0, net.t[name].shape[1])
                at, want = (row, k), dp[cells.rows[name] == row, lm.SPANS[name][0] + k].sum() / len(ids)
            old, losses = of[at], []
            for e in (1e-2, -1e-2):
                of[at] = old + e
                losses.append(net.gradient(*some)[2])
            of[at] = old
            assert abs((losses[0] - losses[1]) / 2e-2 - want) < 1e-3


def test_scores_are_the_probabilities_that_learning_sees_and_add_up_to_one():
    net, r = lm.Network(lm.Lm(bits=9)), np.random.default_rng(2)
    for x in net.t:
        x += r.standard_normal(x.shape).astype(np.float32)
    ids, cells = batch_of(net, r, 5)
    scores = net.score(ids, np.asarray([16] * 5))
    assert abs(scores.sum() * np.log(10) / len(ids) + net.gradient(cells.before.reshape(-1, 16), *cells.at(np.arange(len(ids))))[2]) < 1e-4
    every = [np.append(ids[:3], i).astype(np.int32) for i in range(net.lm.end + 1)]
    given = net.score(ids[:3], np.asarray([3]))[0]
    assert abs((10 ** (net.score(np.concatenate(every), np.asarray([4] * len(every))) - given)).sum() - 1) < 1e-3
    for x in net.t:
        x *= 1e6  # no exponent overflows, no sum is zero
    assert np.isfinite(net.score(ids, np.asarray([16] * 5))).all()


def test_a_text_scores_alike_alone_and_among_others():
    net, texts = lm.Network(lm.Lm()), ["one two three " * 40, "", "four", "the end of it all"]
    net.learn(*lm.cut_texts(texts * 20, net.lm), 1.0)
    together = net.score(*lm.cut_texts(texts, net.lm))
    assert np.allclose(together, [net.score(*lm.cut_texts([t], net.lm))[0] for t in texts], atol=1e-3)


def test_lm_base_matches_brute_force_and_model_learns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in lm.lm_report(docs).collect()}
    rows = docs.select("doc_id", "text", toxicity.fold(F.col("doc_id"), 10).alias("fold")).collect()
    lower = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in brute.words(t)] + [""]
    counts: dict = {}
    for r in rows:
        if r["fold"] != 0:
            for w in lower(r["text"]):
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w, g = lower(r["text"]), got[r["doc_id"]]
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert abs(g["base_score"] - sum(np.log10((counts.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6 * max(1, len(w))
        assert np.isfinite(g["score"]) and g["score"] < 0


def test_short_lines_lose_exact_copies(spark):
    rows = made(seed=4) + [(200 + i, "All rights reserved.\nNext\n\nAll  rights reserved.\nonly here " + str(i), "a", "en") for i in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in lines.line_report(docs).collect()}
    assert got == brute.line_report([(d, t) for d, t, *_ in rows], min_words=1)
    cleaned = {r["doc_id"]: r["text"] for r in lines.line_clean(docs).collect()}
    assert [cleaned[200 + i] for i in range(3)] == ["All rights reserved.\nNext\n\nonly here 0", "\nonly here 1", "\nonly here 2"]
    assert all(sum(bool(brute.words(x)) for x in cleaned.get(d, "").split("\n")) == w[3] for d, w in got.items())


def test_every_training_document_teaches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").filter(~(toxicity.fold(F.col("doc_id"), 10) == 0))
    some = docs.orderBy("id").limit(20).cache()
    form = lm.Lm(first=2, shard_bytes=5_000)
    whole = lm.train(some, form).packed()
    assert whole != lm.Network(form).packed()
    for row in some.collect()[::5]:
        assert lm.train(some.filter(F.col("id") != row["id"]), form).packed() != whole


def test_lm_beats_an_untrained_network_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lm.lm_report(docs).filter("held_out").join(docs, "doc_id").toPandas()
    untrained = lm.Network(lm.Lm()).score(*lm.cut_texts(got["text"].tolist(), lm.Lm()))
    assert (got["score"].to_numpy() > untrained).mean() > 0.95 and got["score"].sum() > 0.8 * untrained.sum()


def test_lm_beats_the_word_base_on_held_out_documents_and_repeats(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = lm.lm_report(docs, lm.Lm()).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]
    small = spark.read.parquet(f"{SF}/documents.parquet")
    one, two = ({r["doc_id"]: r["score"] for r in lm.lm_report(small, lm.Lm(shard_bytes=100_000)).collect()} for _ in range(2))
    assert one == two


def test_classes_hold_each_frequent_word_once_and_their_shares_add_up_to_one():
    r = np.random.default_rng(3)
    spellings = sorted({bytes(r.integers(97, 123, r.integers(1, 9)).astype(np.uint8)) for _ in range(3000)})
    hashes, counts = r.permutation(len(spellings)).astype(np.uint64) * np.uint64(7919), r.integers(2, 500, len(spellings))
    form = lm.Lm()
    got = lm.Classes.of(hashes, counts, spellings, 3.0, form)
    assert got.kind[-1] == form.spelled and got.kind[:-1].max() < form.spelled and got.share[-1] == 0
    assert np.allclose(np.bincount(got.kind[:-1], 10 ** got.share[:-1])[np.unique(got.kind[:-1])], 1)
    assert (np.bincount(got.kind[:-1]) == 1).sum() >= form.own
    at = got.places(np.sort(hashes))
    assert (got.hashes[at] == np.sort(hashes)).all() and got.places(np.asarray([5], np.uint64))[0] == len(hashes)
    assert np.allclose(got.base[at], np.log10(counts[np.argsort(hashes)] + 0.1) - 3.0)
    none = lm.Classes.of(hashes[:0], counts[:0], [], 0.0, form)
    assert none.kind.tolist() == [form.spelled] and none.places(hashes[:2]).tolist() == [0, 0]


def test_a_place_of_a_text_costs_one_step_and_a_word_is_spelled_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    docs = docs.withColumn("held_out", toxicity.fold(F.col("id"), 10) == 0)
    form, words = lm.Lm(frequent=2000), lm.word_counts(docs)
    model, read, seldom = lm.learnt(docs, words, 4.0, form)
    assert seldom.count() == seldom.select("word").distinct().count() and words.count() == seldom.count() + len(model.classes.hashes)
    assert len(model.classes.hashes) <= 2000
    spelling = {r["spelling"]: r["word"] for r in seldom.collect()}
    rows = {r["id"]: r for r in read.collect()}
    frequent, seen = {r["spelling"]: r["word"] for r in words.join(seldom, "word", "left_anti").collect()}, 0
    for r in docs.collect():
        got, every = rows[r["id"]], [w.translate({c: c + 32 for c in range(65, 91)}).encode() for w in brute.words(r["text"])]
        seen += len(every)
        kinds = lm.streams([bytes(got["kinds"])])[0].tolist()
        at = [model.classes.places(np.asarray([frequent[w]]).astype(np.int64).view(np.uint64))[0] if w in frequent else -1 for w in every]
        assert kinds == [*model.classes.kind[at].tolist(), form.end]
        assert abs(got["share"] - model.classes.share[at].sum()) < 1e-6
        rest = [spelling[w] for w in every if w not in frequent]
        assert dict(zip(got["rare"], got["times"], strict=True)) == {w: rest.count(w) for w in rest} and got["found"] == len(every) - len(rest)
    cut = lm.cut_texts([r["text"] for r in docs.collect()], form)[0]
    assert sum(len(r["kinds"]) // 2 for r in rows.values()) == seen + len(rows) < len(cut) / 2


def test_lm_scores_are_classes_shares_and_spellings(spark):
    docs = spark.createDataFrame([(i, f"Common words {'and' if i % 3 else 'or'} rare{i} rare{i // 2}\tone", "a", "en") for i in range(60)] + [(98, "", "a", "en"), (99, None, "a", "en")], DOCS)
    got = {r["doc_id"]: r for r in lm.lm_report(docs).collect()}
    plain = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (toxicity.fold(F.col("doc_id"), 10) == 0).alias("held_out"))
    model, read, seldom = lm.learnt(plain, lm.word_counts(plain), 0.0, lm.Lm())
    assert any(r["held_out"] for r in got.values()) and seldom.filter("c = 0").count() > 0
    spelled = {r["word"]: model.speller.score(*lm.cut_texts([bytes(r["spelling"])], lm.Lm()))[0] for r in seldom.collect()}
    for r in read.collect():
        want = model.network.score(*lm.streams([bytes(r["kinds"])]))[0] + r["share"] + sum(spelled[w] * n for w, n in zip(r["rare"], r["times"], strict=True))
        assert abs(got[r["id"]]["score"] - want) < 1e-3
    assert got[98]["score"] == got[99]["score"] and got[98]["n_tokens"] == 1


def test_a_spelled_word_teaches_as_often_as_it_occurs(spark):
    c = np.asarray([1, 5, 0, 2, 300])
    parts = list(lm.occurrences(c, 7))
    assert np.bincount(np.concatenate(parts), minlength=5).tolist() == c.tolist() and max(map(len, parts)) < 14
    counts = [(i, f"spelt{i}".encode(), 40 if i == 3 else 1 + i % 3) for i in range(60)] + [(99, b"heldout", 0)]
    words = spark.createDataFrame(counts, "word long, spelling binary, c long")
    met, averaged = {}, lm.averaged

    def seen(dealt, shards, network, teach, name):
        met.update((bytes(r["spelling"]), (r["c"], r["shards"])) for r in dealt.groupBy("spelling").agg(F.sum("c").alias("c"), F.count_distinct("shard").alias("shards")).collect())
        own = lm.Network(network.lm)
        met["ids"] = teach(own, dealt.toArrow()), int(own.met[0].sum())
        return averaged(dealt, shards, network, teach, name)

    lm.averaged = seen
    try:
        lm.train_speller(words, lm.Lm(word_bytes=100, bits=9, first_words=5))
    finally:
        lm.averaged = averaged
    ids = met.pop("ids")
    assert {k: v[0] for k, v in met.items()} == {w: n for _, w, n in counts if n} and met[b"spelt3"][1] > 1
    lengths = lm.cut_texts([w for _, w, n in counts if n], lm.Lm())[1]
    assert ids[0] == (lengths * [n for *_, n in counts if n]).sum() <= ids[1]


def test_weights_count_as_repeats_do():
    net, r = lm.Network(lm.Lm(bits=9)), np.random.default_rng(4)
    ids, cells = batch_of(net, r, 4)
    some = cells.before.reshape(-1, 16), *cells.at(np.arange(len(ids)))
    weights = np.repeat([1.0, 2.0, 0.0, 1.0], 16).astype(np.float32)
    at = np.concatenate([np.arange(32), np.arange(16, 32), np.arange(48, 64)])
    again = cells.before[at].reshape(-1, 16), *cells.at(at)
    one, two = net.gradient(*some, weights)[0], net.gradient(*again)[0]
    assert all(np.allclose(one[k], two[k], atol=1e-6) for k in one)


def test_url_models_read_the_whole_url(spark):
    known = [f"http://a{i}.com/fr/x?topic=news{i}" for i in range(30)] + [f"http://a{i}.com/de/x?topic=casino{i}" for i in range(30)]
    asked = ["http://q.net/x?topic=news1", "http://q.net/x?topic=casino1", "http://q.net/x#news7", "http://q.net/x9", "http://q.net/x11", "topic=news1", "topic=casino1", None]
    pages = spark.createDataFrame(list(enumerate(known + asked)), "page_id long, url string")
    got = [r["verdict"] for r in urls.url_verdicts(pages).orderBy("page_id").collect()][len(known):]
    score = [r["score"] for r in urls.url_verdicts(pages).orderBy("page_id").collect()][len(known):]
    assert got[:2] == ["allow", "block"] and score[5] > score[6]
    assert len(set(score)) == len(asked)


def test_short_items_parts_of_long_items_and_questions_are_found():
    word = lambda a, n: [f"{a}{i}" for i in range(n)]
    long, short_q = word("l", 300), word("q", 12)
    items = [(1, "Who wrote Hamlet?"), (2, " ".join(long)), (3, " ".join(short_q) + "? " + " ".join(word("r", 40)) + "."), (4, "yes")]
    index = decontaminate.Index.of(items, decontaminate.Leaks())
    pad = word("p", 150)
    find = lambda w: index.all_hits(*decontaminate.word_hashes([" ".join(pad), " ".join([*pad, *w, *pad]), " ".join(w)], marks=False))
    assert find(["who", "WROTE", "hamlet"]) == [[], [1], [1]]
    assert find(["who", "wrote", "x", "hamlet"]) == [[], [], []]
    for at in (0, 60, 120, 180, 240):
        assert find(long[at: at + 60]) == [[], [2], [2]]
    assert find(long[:200]) == [[], [2], [2]] and find(long[:20]) == [[], [], []]
    assert find(short_q) == [[], [3], [3]] and find(short_q[:7]) == [[], [], []]
    assert index.all_hits(*decontaminate.word_hashes(["x who wrote", "hamlet x yes"], marks=False)) == [[], [4]]


BIG = 1 << 60
WIDE = [(BIG + 1, "one two three four five six seven eight nine ten eleven twelve\nsecond line of it", "a", "en"), (None, "x y z and nothing else of any use", "b", "en"),
        (BIG + 3, "what on earth is this text about now then you see", "a", None), (BIG + 3, "what on earth is this text about now then you see", "a", None),
        (BIG + 5, None, None, None), (BIG + 2, "x y z and nothing else of any use", "b", "en")]


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_beside_nulls_stay_exact(spark, name):
    got = OPERATORS[name](spark.createDataFrame(WIDE, DOCS)).collect()
    key = "key" if name == "mixing" else "doc_id"
    assert sorted(r[key] or 0 for r in got) == sorted(w[0] or 0 for w in WIDE)
    if name == "near":
        assert {r["doc_id"]: r["component_id"] for r in got}[BIG + 2] == BIG + 2
        assert {r["doc_id"]: r["component_id"] for r in got}[None] == BIG + 2
    if name == "leaks":
        assert {r["doc_id"]: r["item_ids"] for r in got}[BIG + 3] == [BIG + 3]


@pytest.mark.parametrize("name", ["quality", "lines", "near", "leaks", "mixing"])
def test_stages_keep_wide_numbers_beside_nulls(spark, name):
    stages = {"quality": lambda d: quality.quality_clean(d, quality.QualityRules(min_words=0, min_kept=0)), "lines": lines.line_clean, "near": minhash.near_clean,
              "leaks": lambda d: decontaminate.leak_clean(d, spark.createDataFrame([(1, WIDE[2][1])], "item_id long, text string")), "mixing": mixing.mix_documents}
    docs = spark.createDataFrame(WIDE, DOCS).withColumn("n_chars", F.when(F.col("lang") == "en", F.col("doc_id") + 7)).withColumn(
        "exact", F.when(F.col("source") == "a", F.lit("12345678901234567890.5").cast("decimal(30,3)")))
    before = {(r["doc_id"], r["n_chars"], r["exact"]) for r in docs.collect()}
    after = stages[name](docs).collect()
    assert after and all((r["doc_id"], r["n_chars"], r["exact"]) in before for r in after)
    assert any((r["doc_id"] or 0) > BIG for r in after) and (name in ("lines", "near") or any(r["doc_id"] is None for r in after))


def test_wide_page_ids_beside_nulls(spark):
    big = "é" * 600
    pages = spark.createDataFrame([(BIG + 1, "u", big), (None, "v", "x"), (BIG + 3, None, big)], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.warc_report(pages).collect()}
    assert got == {BIG + 1: BIG + 3, None: None, BIG + 3: None}
    assert {r["page_id"] for r in urls.url_verdicts(pages.withColumn("score", F.lit("clash"))).collect()} == {BIG + 1, None, BIG + 3}


def test_near_copies_of_very_long_lines(spark):
    words = [f"w{i}" for i in range(200_000)]
    docs = [(1, " ".join(words)), (2, " ".join([*words[:99_000], "new", *words[99_000:]])), (3, " ".join([*words[:150_000], "other", *words[150_001:]])), (4, " ".join(words[1:]))]
    began = time.time()
    got = {r["doc_id"]: r["n_near"] for r in lines.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1} and time.time() - began < 120


def test_every_prefix_of_the_mix_is_near_its_shares(spark):
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.randint(1, 40)), r.choice(["a", "b", "b", "b", "c", "c", None]), "en") for i in range(800)]
    docs = spark.createDataFrame(rows, DOCS)
    form = mixing.Mix(block_words=32, cell_rows=50)
    parts = sorted((x["slot"], x["start"], x["source"] or "~", x["words"]) for x in mixing.mix_sequence(docs, form).collect())
    total = {s: sum(p[3] for p in parts if p[2] == s) for s in {p[2] for p in parts}}
    whole, seen, so_far = sum(total.values()), dict.fromkeys(total, 0), 0
    for _, _, s, n in parts:
        seen[s] += n
        so_far += n
        assert all(abs(seen[x] - so_far * total[x] / whole) < 12 * form.block_words for x in total)
    taken = {x["key"]: x["taken"] for x in mixing.mix_report(mixing.sizes(docs), form).collect()}
    assert sum(taken.values()) == whole
    again = sorted((x["slot"], x["start"], x["source"] or "~", x["words"]) for x in mixing.mix_sequence(docs.repartition(3), form).collect())
    assert again == parts
