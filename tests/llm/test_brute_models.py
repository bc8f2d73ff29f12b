"""Whole operators against plain Python versions: the models' verdict on URLs, leaks of test items, features, trees."""

import math
import random
import re
from collections import Counter, defaultdict
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import xxhash

from ledgerline.llm import decontaminate, toxicity, urls


def url_models(pages):
    """pages: (page_id, url, rule verdict or None) -> {page_id: (verdict, score)} of those without a rule."""
    spell = lambda u: re.sub(r"[^\x20-\x7e]", "\x7f", u or "")
    grams = lambda t: [("\x02" * 3 + t + "\x03")[i : i + 4] for i in range(len(t) + 1)]
    known = defaultdict(lambda: [0, 0])
    for _, u, v in pages:
        if v:
            known[spell(u)][v == "block"] += 1
    half = {t: xxhash.xxh64(t.encode(), seed=42).intdigest() % 2 for t in known}

    def model(texts):
        count = [defaultdict(lambda: [0, 0]) for _ in range(4)]
        for t in texts:
            for g in grams(t):
                for k in range(4):
                    for side in (0, 1):
                        count[k][g[3 - k :]][side] += known[t][side]
        sums, kinds = ([defaultdict(lambda: [0, 0]) for _ in range(4)] for _ in range(2))
        for k in range(4):
            for tail, c in count[k].items():
                for side in (0, 1):
                    sums[k][tail[:-1]][side] += c[side]
                    kinds[k][tail[:-1]][side] += c[side] > 0

        def score(text):
            total = 0.0
            for g in grams(text):
                p = [1 / 97, 1 / 97]
                for k in range(4):
                    tail = g[3 - k :]
                    for side in (0, 1):
                        n, t = sums[k][tail[:-1]][side], kinds[k][tail[:-1]][side]
                        p[side] = (count[k][tail][side] + t * p[side]) / (n + t) if n else p[side]
                total += math.log10(p[0] / p[1])
            return total / (len(text) + 1)

        return score

    halves = [model([t for t in known if half[t] != side]) for side in (0, 1)]
    bins = defaultdict(lambda: [0, 0])
    for t, c in known.items():
        at = int(Decimal(halves[half[t]](t) * 64).quantize(Decimal(1), ROUND_HALF_UP))
        for side in (0, 1):
            bins[at][side] += c[side]
    sums = [max(1, sum(b[side] for b in bins.values())) for side in (0, 1)]
    wrong = lambda x: max(sum(b[0] for a, b in bins.items() if a < x) / sums[0], 1 - sum(b[1] for a, b in bins.items() if a < x) / sums[1])
    best = min(bins, key=lambda x: (wrong(x), abs(x), x)) if bins else None
    threshold = (best - 0.5) / 64 if bins else 0.0
    whole = model(list(known))
    return {i: ("allow" if whole(spell(u)) >= threshold else "block", whole(spell(u))) for i, u, v in pages if not v}


def test_url_verdicts_match_plain_models(spark):
    r = random.Random(4)
    word = lambda a: "".join(r.choices(a, k=r.randint(3, 8)))
    some = [f"https://{word('abcde')}.com/fr/{word('abcde')}" for _ in range(40)] + [f"https://{word('vwxyz')}.com/de/{word('vwxyz')}?{word('xyz')}" for _ in range(30)]
    some += [f"http://{word('abvw')}.net/{word('abcxyz')}" for _ in range(30)] + ["", None, "no address é", some[0], some[0]]
    df = spark.createDataFrame(list(enumerate(some)), "page_id long, url string")
    got = {x["page_id"]: x for x in urls.url_verdicts(df).collect()}
    want = url_models([(i, u, got[i]["verdict"] if got[i]["rule"] else None) for i, u in enumerate(some)])
    assert want and {i: got[i]["verdict"] for i in want} == {i: v for i, (v, _) in want.items()}
    assert all(abs(got[i]["score"] - s) < 1e-9 for i, (_, s) in want.items())


WORD = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]


def share(words, near):
    k = min(3, len(words))
    shingles = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    return len(shingles(words) & shingles(near)) / len(shingles(words)) if k else 1.0


def leaks(docs, items, rules):
    """docs: (id, text), items: (id, text) -> {id: [item ids]}: every passage against every segment."""
    segments, parts = [], {}
    for i, t in items:
        w = plain_words(t)
        if len(w) >= rules.min_words:
            asked = len(plain_words(decontaminate.question_and_answer(t)[0]))
            parts[i] = w, asked
            edges = np.linspace(0, len(w), math.ceil(len(w) / rules.segment) + 1).astype(int).tolist()
            segments += [(i, a, z, Counter(w[a:z])) for a, z in zip(edges, edges[1:])]
    df = Counter(t for *_, c in segments for t in c)
    mean = sum(sum(c.values()) for *_, c in segments) / max(1, len(segments))

    def impact(c):
        norm = rules.k1 * (1 - rules.b + rules.b * sum(c.values()) / mean)
        one = {t: math.log(1 + (len(segments) - df[t] + 0.5) / (df[t] + 0.5)) * n * (rules.k1 + 1) / (n + norm) for t, n in c.items()}
        return {t: x / sum(one.values()) for t, x in one.items()}

    weights, out = [impact(c) for *_, c in segments], {}
    for d, text in docs:
        w, found = plain_words(text), set()
        for i, t in items:
            own = plain_words(t)
            if 0 < len(own) < rules.min_words and any(w[k : k + len(own)] == own for k in range(len(w))):
                found.add(i)
        found |= {i for i, (own, asked) in parts.items() if asked >= rules.min_words and share(own[:asked], w) >= rules.alone and len(w) >= 3}
        for first in range(0, max(1, len(w) - rules.passage + rules.step), rules.step):
            passage = set(w[first : first + rules.passage])
            for (i, a, z, _), weight in zip(segments, weights):
                if sum(x for t, x in weight.items() if t in passage) >= rules.threshold - 1e-9:
                    own, asked = parts[i]
                    near = w[max(0, first - len(own)) : min(len(w), first + rules.passage) + len(own)]
                    cut = min(max(a, asked), z)
                    held = lambda p, q, e: share(own[p:q], near) >= rules.question and share(own[q:e], near) >= rules.answer
                    if held(0, asked, len(own)) or len(own) > rules.segment and held(a, cut, z):
                        found.add(i)
        out[d] = sorted(found)
    return out


def test_leaks_match_every_passage_against_every_item(spark, monkeypatch):
    r = random.Random(8)
    v = [f"t{i}" for i in range(150)]
    items = [(100 + i, " ".join(r.choices(v, k=r.choice([4, 20, 45, 150]))) + ". " + " ".join(r.choices(v, k=r.choice([3, 12])))) for i in range(30)]
    docs = [(0, None), (1, ""), (2, "t1 t2")]
    for d in range(3, 60):
        w = r.choices(v, k=r.randint(5, 300))
        for _ in range(r.randint(0, 2)):
            own = r.choice(items)[1].split()
            a = r.randrange(len(own))
            piece = [x if r.random() > 0.05 else "zz" for x in (own if r.random() < 0.6 else own[a : a + r.randint(3, 60)])]
            at = r.randrange(len(w) + 1)
            w[at:at] = piece
        docs.append((d, " ".join(w)))
    rules = decontaminate.Leaks(passage=64, step=32, segment=32, block=4)
    want = leaks(docs, items, rules)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 1500):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", size)
        got = {x["doc_id"]: x["item_ids"] for x in decontaminate.leak_report(d, b, rules).collect()}
        assert got == want and sum(map(bool, want.values())) > 15
        assert {x["doc_id"] for x in decontaminate.leak_clean(d, b, rules).collect()} == {i for i, x in want.items() if not x}


def test_features_match_counts():
    texts = ["You IDIOT!! are you stupid? 1d10t", "", None, "Nice day, no one is hurt. Aaaah sooo", "tu es STUPIDE !"]
    lexicon = (np.sort(toxicity.word_hashes(["nice"])[0]), np.asarray([2.0]))
    got = toxicity.features(texts, lexicon)
    column = {n: i for i, n in enumerate(toxicity.FEATURES)}
    for row, t in zip(got, texts):
        t = t or ""
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)]
        n = max(1, len(words))
        assert math.isclose(row[column["log_words"]], math.log1p(len(words)))
        assert math.isclose(row[column["seed_density"]], sum(w in toxicity.SEED for w in words) / n, abs_tol=1e-12)
        assert math.isclose(row[column["second_person"]], sum(w in toxicity.SECOND_PERSON for w in words) / n, abs_tol=1e-12)
        assert math.isclose(row[column["learnt_weight"]], 2.0 * words.count("nice") / n, abs_tol=1e-12)
        assert math.isclose(row[column["exclaims"]], t.count("!") / n) and math.isclose(row[column["asks"]], t.count("?") / n)
        assert math.isclose(row[column["capitals"]], sum("A" <= c <= "Z" for c in t) / max(1, sum(c.isalpha() for c in t)), abs_tol=1e-12)


def test_a_stump_is_the_best_split_and_calibration_the_nearest_rising_function():
    r = np.random.default_rng(5)
    x, y = r.random((60, 3)).round(1), (r.random(60) < 0.4).astype(float)
    how = toxicity.Training(trees=1, depth=1, rate=1.0, bins=64, least_leaf=5)
    margin = toxicity.Trees(x, y, how).margin(x)
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    g, h, best = y - p, np.full(60, p * (1 - p)), (0.0, None)
    for f in range(3):
        for cut in np.unique(x[:, f]):
            left = x[:, f] <= cut
            if 5 <= left.sum() <= 55:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)
                best = max(best, (gain, tuple(left)), key=lambda b: b[0])
    left = np.asarray(best[1])
    want = np.where(left, g[left].sum() / (h[left].sum() + 1), g[~left].sum() / (h[~left].sum() + 1)) + np.log(p / (1 - p))
    assert np.allclose(margin, want)
    s, t = np.sort(r.random(40)), (r.random(40) < 0.5).astype(float)
    knots, values = toxicity.isotonic(s, t)
    fitted = [max(min(t[j : k + 1].mean() for k in range(i, 40)) for j in range(i + 1)) for i in range(40)]
    at = np.searchsorted(np.cumsum([sum(abs(f - v) < 1e-12 for f in fitted) for v in values]), np.arange(40), side="right")
    assert np.all(np.diff(values) > 0) and np.allclose(np.asarray(values)[at], fitted)
