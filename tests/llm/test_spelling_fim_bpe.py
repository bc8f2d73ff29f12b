import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ledgerline.llm import bpe, fim, spelling

ODD = [(1, None), (2, ""), (3, "  \n\t"), (None, "Straße straße STRASSE"), (4, "same"), (4, "same"), (5, "long " * 60_000), (6, "ÄÖ é 日本 🙂\nline"),
       (7, "a <P> b"), (8, "<<S<S>>"), (9, "🙂<" * 50)]
SCHEMA = "doc_id long, text string"
REPORTS = {"spelling": spelling.spelling_report, "fim": fim.fim_report, "bpe": bpe.bpe_report}


@pytest.mark.parametrize("name", REPORTS)
def test_odd_rows_extra_columns_and_empty_tables(spark, name):
    df = spark.createDataFrame(ODD, SCHEMA)
    for extra in ("id", "n", "key", "word", "ids", "output", "form", "decoded"):
        df = df.withColumn(extra, F.lit(None).cast("string"))
    rows = REPORTS[name](df).collect()
    assert name == "spelling" or sorted(str(r["doc_id"]) for r in rows) == sorted(str(d) for d, _ in ODD)
    assert REPORTS[name](df.filter("false")).count() == 0


def test_wide_and_text_ids_stay_exact(spark):
    rows = [(2**62 + 1, "a b"), (None, "c"), (-1, "d")]
    for report in (fim.fim_report, bpe.bpe_report):
        assert {r["doc_id"] for r in report(spark.createDataFrame(rows, SCHEMA)).collect()} == {2**62 + 1, None, -1}
        named = spark.createDataFrame([("x", "a b")], "key string, body string")
        assert report(named, id="key", text="body").first()["key"] == "x"


# --- spelling variants


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def spelled(docs, s):
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if s.damage and h % s.damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= s.min_chars and c >= s.min_count}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v and n[v] >= s.times * n[w] else None for w, v in form.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def edited(r, w):
    i = r.randrange(len(w) + 1)
    return r.choice([w[:i] + r.choice("abéÀz") + w[i:], w[:i] + w[i + 1:], w[:i] + r.choice("xyß÷") + w[i + 1:]])


@pytest.mark.parametrize("damage", [0, 3, 199])
def test_spellings_match_brute_force(spark, damage):
    r = random.Random(damage)
    words = ["".join(r.choices("abcéÿÀno", k=r.randint(3, 9))) for _ in range(60)]
    for _ in range(3):
        words += [edited(r, r.choice(words)) for _ in range(80)]
    weights = [r.choice([1, 1, 5, 30, 200]) for _ in words]
    docs = [(i if i else None, r.choice([" ", "9", "\n", "_日"]).join(w.capitalize() if r.random() < 0.2 else w for w in r.choices(words, weights, k=120))) for i in range(90)]
    s = spelling.Spelling(damage=damage, min_count=3, times=3)
    want = spelled(docs, s)
    got = {x["word"]: (x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in spelling.spelling_report(spark.createDataFrame(docs, SCHEMA), s).collect()}
    assert got == want and any(v[0] for v in want.values()) and any(v[0] and v[0] != v[1] for v in want.values())


def test_masks_of_near_words_share_a_band(spark):
    r = random.Random(4)
    pairs = []
    for _ in range(400):
        w = "".join(r.choices("abcdefghijklmnopqrstuvwxyzéàÿ", k=r.randint(1, 12)))
        pairs.append((w, edited(r, w)))
    df = spark.createDataFrame(pairs, "a string, b string")
    for a, b in df.select(spelling.parity_mask(F.col("a")), spelling.parity_mask(F.col("b"))).collect():
        assert (a ^ b).bit_count() <= 2 and any((a ^ b) >> 21 * j & (1 << 21) - 1 == 0 for j in range(3))


def test_long_words_are_compared_as_short_ones(spark, monkeypatch):
    r = random.Random(11)
    words = {"".join(r.choices("abé", k=r.randint(1, 5))) for _ in range(150)}
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    want = sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert sorted((x["word"], x["other"]) for x in spelling.near_words(df).collect()) == want
    monkeypatch.setattr(spelling, "LONG_WORD", 0)
    assert sorted((x["word"], x["other"]) for x in spelling.near_words(df).collect()) == want


def test_a_chain_of_forms_ends_at_its_root_and_a_crowded_key_loses_no_pair(spark):
    chain = [("w" + "a" * i + "end", 3**i) for i in range(3, 20)]
    forms = spark.createDataFrame([(a, b) for (a, _), (b, _) in zip(chain, chain[1:])], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {chain[-1][0]}
    crowd = [("prefix" + a + b, 7) for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    pairs = spelling.near_words(spark.createDataFrame(crowd, "word string, n long")).collect()
    assert len(pairs) == len({(p["word"], p["other"]) for p in pairs}) == sum(one_edit(a, b) for a, _ in crowd for b, _ in crowd)


# --- fill-in-middle


def filled(d, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    t, n = text or "", len(units)
    x = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
    h = [int(x[i: i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(c in t for c in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_brute_force(spark):
    r = random.Random(5)
    bits = ["word", "P", "S", "M", "<", ">", "<P>", " ", "\n", "é", "日", "🙂", "x1y", "<S", "M>", "\x00"]
    docs = [(i, "".join(r.choices(bits, [9, 3, 3, 3, 5, 5, 0.1, 9, 1, 3, 1, 1, 3, 2, 2, 1], k=r.randrange(40)))) for i in range(600)] + ODD
    df = spark.createDataFrame(docs, SCHEMA)
    got = fim.fill_in_middle(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(str, ((x[0], *x[1:6]) for x in got))) == sorted(map(str, ((d, *filled(d, t)) for d, t in docs)))
    assert sorted(str((x["doc_id"], x["back"])) for x in got) == sorted(str((d, t or "")) for d, t in docs)
    assert {x["form"] for x in got} == {"plain", "psm", "spm"}


def test_own_sentinels_and_every_place_of_a_text(spark):
    f = fim.Fim("⟨p⟩", "⟨s⟩", "⟨m⟩", changed_percent=100, spm_percent=50)
    text = "ab⟨p c⟩, déf  gh" * 3
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"))
    out = fim.fill_in_middle(df, f).select("form", "output", fim.restored(F.col("output"), F.col("form"), f).alias("back")).collect()
    assert {x["back"] for x in out} == {text} and {x["form"] for x in out} == {"psm", "spm"}
    starts, first, marked = fim.Events(f).find(text)
    units = fim.Units(starts, first, len(text))
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert not marked and [units.place(k) for k in range(units.n + 1)] == [len("".join(parts[:k])) for k in range(len(parts) + 1)]
    with pytest.raises(ValueError):
        fim.Fim("<<P", "<S", "<M")


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_text(r):
    k = r.random()
    if k < 0.3:
        return "".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x80, 0x800), r.randrange(0x800, 0xD800), r.randrange(0xE000, 0x110000)])) for _ in range(r.randrange(40)))
    if k < 0.6:
        return "".join(r.choice(["'s", "'ll", "'RE", "''", " ", "  ", "\n", "　", "\x85", "\x1c", "a", "A", "B9", "½", "é", "日", "🙂", "Ⅷ"]) for _ in range(r.randrange(60)))
    return "".join(r.choice(" ab\n\t" if k < 0.8 else "aAxzq0-_=") for _ in range(r.randrange(160)))


def test_transducer_equals_the_library_also_when_states_are_forgotten(library):
    r = random.Random(6)
    texts = [odd_text(r) for _ in range(4000)] + [" the cat's ''s" * 50, "\n" * 3000 + "x", "ab" * 3000]
    for coder in (bpe.encoder(), bpe.Encoder(bpe.Bpe(max_states=50, max_pieces=20, piece_chars=8))):
        for t in texts:
            assert coder.encode(t).tolist() == library.encode_ordinary(t), repr(t)
        assert "".join(p for b in bpe.pieces(texts[0]) for p in b) == texts[0]


def test_pairs_of_tokens_are_judged_as_the_plain_rule_does(library):
    v, r = bpe.vocabulary(bpe.Bpe().vocabulary), random.Random(7)
    for _ in range(4000):
        a, b = r.randrange(50_256), r.randrange(50_256)
        ids = library._encode_single_piece(v.tokens[a] + v.tokens[b])
        assert v.apart(a, b) == (ids == [a, b])


def test_tokens_leave_before_the_piece_ends():
    t = bpe.Transducer(bpe.vocabulary(bpe.Bpe().vocabulary), 1000)
    read = []
    stream = t.stream(read.append(b) or b for b in b"x" * 5000)
    next(stream)
    assert len(read) < 300


def test_blocks_of_long_texts_are_cut_where_no_piece_goes_on(library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    r = random.Random(8)
    for t in ["it's a  very 'long\n\n text's 12 34 ", *[odd_text(r) for _ in range(500)]]:
        assert bpe.Encoder(bpe.Bpe()).encode(t).tolist() == library.encode_ordinary(t)


def test_utf8_machine_equals_the_standard_decoder():
    r = random.Random(9)
    for _ in range(5000):
        b = bytes(r.choice([r.randrange(256), 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x99, 0x82, 0xED, 0xA0, 65]) for _ in range(r.randrange(12)))
        m, k = bpe.Utf8(), r.randrange(len(b) + 1)
        want = b.decode("utf-8", "replace")
        assert m.feed(b[:k]) + m.feed(b[k:]) + m.close() == want and (m.replaced == 0) == ("�" not in want)


def test_documents_go_to_ids_and_back(spark, library):
    docs = ODD + [(10, " " * 2_000_000 + "x"), (11, "x" * 2_000_000), (12, "\n" * 2_000_000)]
    df = spark.createDataFrame(docs, SCHEMA)
    rows = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert sorted(str((r["doc_id"], r["decoded"])) for r in rows) == sorted(str((d, t or "")) for d, t in docs)
    want = {d: library.encode_ordinary(t or "") for d, t in ODD}
    for r in rows:
        if r["doc_id"] in want:
            assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]] and r["n_tokens"] == len(want[r["doc_id"]])
    digests = {r["doc_id"]: r for r in bpe.bpe_report(df).collect()}
    for d, ids in want.items():
        assert digests[d]["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()


def test_unknown_and_cut_ids_are_replaced(spark):
    rows = [(1, np.asarray([50_256, 64], "<u4").tobytes() + b"\x01"), (2, None), (3, np.asarray([bpe.vocabulary(bpe.Bpe().vocabulary).ranks[b"\xe2"]], "<u4").tobytes())]
    got = {r["doc_id"]: (r["decoded"], r["n_replaced"]) for r in bpe.decode_documents(spark.createDataFrame(rows, "doc_id long, ids binary")).collect()}
    assert got[2] == ("", 0) and got[3] == ("�", 1) and got[1][0].endswith("a") and got[1][1] == 1
