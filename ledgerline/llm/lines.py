"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

A line goes if an earlier line has the same words, or, from near_words words on, differs from it by one word inserted,
deleted or replaced. Earlier: smaller id, then (for rows of one id) smaller hash of the text, then higher up.

1. Lines are grouped by a 96-bit hash of their words; the first of each group stays a candidate.
2. Two lines one edit apart share their first or their last half. Half keys that two different lines have tell which
   lines can have a neighbour at all; only these go on.
3. Each of them emits its own key and those of its words without the i-th, for all i. Lines that share the key without
   the i-th word differ in the i-th word only, all of them from each other, so the earliest stands for the group; a line
   whose own key is another's key without a word is that line less a word. So groups are only aggregated, never paired.
4. The earliest partner of each line is looked up and the edit distance verified on the words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, dropped, words, written


@dataclass(frozen=True)
class LineRules:
    """Lines of fewer than min_words words always stay; only lines of near_words words or more have near copies, shorter ones
    lose exact copies alone."""

    min_words: int = 1
    near_words: int = 8


#: Every line that has a word loses its exact copies: the rules of the query and of the pipeline's stage.
EVERY_LINE = LineRules()

DOC = ["id", "text_hash"]
ORD = ["null_id", "id", "text_hash", "pos"]


def _lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """The lines that may go: id, text_hash, pos, line (words with one space between them), n (words)."""
    df = docs.select("id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    odd = F.col("raw").startswith(" ") | F.col("raw").endswith(" ")
    for mark in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd = odd | F.col("raw").contains(mark)
    tidy = F.when(odd, F.trim(F.regexp_replace("raw", SPACE, " "))).otherwise(F.col("raw"))
    df = df.select("id", "text_hash", "pos", tidy.alias("line")).filter(F.col("line") != "")
    spaces = F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit("")))
    return df.withColumn("n", spaces + 1).filter(F.col("n") >= rules.min_words)


def _half_keys(rules: LineRules) -> Column:
    """Keys one of which two lines share that are one edit apart: halves for the line's length and for one word less."""

    def halves(m: str) -> list[Column]:
        first = F.expr(f"substring_index(line, ' ', cast(({m}) div 2 as int))")
        last = F.expr(f"substring_index(line, ' ', -cast(({m}) - ({m}) div 2 as int))")
        return [F.xxhash64(F.expr(m), F.lit(side), part) for side, part in ((1, first), (2, last))]

    none = F.array().cast("array<long>")
    return F.when(F.col("n") >= rules.near_words, F.array(*halves("n"), *halves("n - 1"))).otherwise(none)


def _running(values: Column, n: Column) -> Column:
    """The exclusive or of the first, the first two, ... of an array of n numbers, in as many rounds as n has binary digits:
    each round takes in what lies twice as far back."""
    rounds = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(n)).cast("int") - 1, F.lit(0)))

    def further(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x.bitwiseXOR(F.coalesce(F.get(sums, i - back), F.lit(0).cast("long"))))

    return F.aggregate(rounds, values, further)


def _placed(hashes: Column, back: int) -> Column:
    """Hashes of words together with their places, counted from minus back."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, i - back))


def _variants(line: DataFrame) -> DataFrame:
    """(line, v, m, i): the key of a line's n words with i = -1, and the keys without each word i, with the number of words
    each stands for; line has line and hashes.

    A key is the exclusive or of the hashes of words and places. What comes behind a word that is left out moves up by one
    place, so each key is one of two running sums up to there and the other from there on: work grows as n log n.
    """
    n = F.size("hashes")
    df = line.select("line", n.alias("n"), _running(_placed(F.col("hashes"), 0), n).alias("kept"), _running(_placed(F.col("hashes"), 1), n).alias("moved"))
    end = F.get("moved", F.col("n") - 1)
    without = F.transform("moved", lambda x, i: F.coalesce(F.get("kept", i - 1), F.lit(0).cast("long")).bitwiseXOR(end).bitwiseXOR(x))
    every = F.concat(F.array(F.get("kept", F.col("n") - 1)), without)
    df = df.select("line", "n", F.posexplode(every).alias("at", "v"))
    return df.select("line", "v", F.when(F.col("at") == 0, F.col("n")).otherwise(F.col("n") - 1).alias("m"), (F.col("at") - 1).alias("i"))


def _one_edit(a: Column, b: Column) -> Column:
    """Whether two arrays of word hashes differ by exactly one word inserted, deleted or replaced."""
    short, long = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    at = F.sequence(F.lit(0), short - 1)
    ahead = F.size(F.filter(at, lambda i: F.get(a, i) == F.get(b, i)))
    #: Words equal from the front and from the back, each up to the first that differs.
    front = F.coalesce(F.array_position(F.transform(at, lambda i: F.get(a, i) == F.get(b, i)), F.lit(False)), F.lit(0))
    back = F.coalesce(F.array_position(
        F.transform(at, lambda i: F.get(a, F.size(a) - 1 - i) == F.get(b, F.size(b) - 1 - i)), F.lit(False)), F.lit(0))
    front, back = F.when(front == 0, short).otherwise(front - 1), F.when(back == 0, short).otherwise(back - 1)
    return F.when(F.size(a) == F.size(b), ahead == short - 1).otherwise((long - short == 1) & (front + back >= short))


def _hashed_lines(docs: DataFrame, rules: LineRules) -> DataFrame:
    """The table of lines that everything else reads: hashes and half keys, no text."""
    lines = _lines(docs, rules).withColumn("halves", _half_keys(rules))
    return written(lines.select(F.col("id").isNull().alias("null_id"), *DOC, "pos", F.xxhash64("line").alias("h"),
                                F.hash("line").alias("g"), "halves"), "lines")


def removed_lines(docs: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, near) for docs with id, text_hash and text and their table of lines.

    first: line (a number in the order of lines), id, text_hash, pos of each group of equal lines' first line. near: the
    numbers of those that go since an earlier line is one edit away.
    """
    first = lines.groupBy("h", "g").agg(F.min(F.struct(*ORD)).alias("o"), F.first("halves").alias("halves"))
    first = first.select("o.*", "halves").orderBy(*ORD)
    first = written(first.withColumn("line", F.monotonically_increasing_id()), "lines-first")

    half = first.select("line", F.explode("halves").alias("half"))
    shared = half.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    able = half.join(shared, "half", "left_semi").select("line").distinct()
    places = first.join(able, "line").groupBy(*DOC).agg(F.collect_list(F.struct("pos", "line")).alias("places"))

    #: The same join at every size: the lines wanted grow with the documents.
    texts = docs.select(*DOC, "text").hint("merge")
    on = [texts["id"].eqNullSafe(places["id"]), texts["text_hash"] == places["text_hash"]]
    split = texts.join(places, on).select("places", F.split("text", "\n").alias("all"))
    at = F.transform("places", lambda p: F.struct(p["line"].alias("line"), F.get("all", p["pos"]).alias("text")))
    some = split.select(F.explode(at).alias("x")).select("x.line", words(F.col("x.text")).alias("words"))
    some = written(some.select("line", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")), "lines-some")

    emitted = written(_variants(some).select("line", F.xxhash64("v", "m").alias("key"), "i"), "lines-variants")
    replaced = emitted.filter("i >= 0").groupBy("key", "i").agg(F.min("line").alias("to"), F.count("*").alias("c"))
    replaced = emitted.join(replaced.filter("c > 1").drop("c"), ["key", "i"]).select("line", "to")
    whole, part = F.min(F.when(F.col("i") < 0, F.col("line"))), F.min(F.when(F.col("i") >= 0, F.col("line")))
    inserted = emitted.groupBy("key").agg(whole.alias("whole"), part.alias("part")).filter("whole is not null and part is not null")
    inserted = emitted.join(inserted, "key").select("line", F.when(F.col("i") < 0, F.col("part")).otherwise(F.col("whole")).alias("to"))
    pairs = replaced.unionByName(inserted).filter("to < line").groupBy("line").agg(F.min("to").alias("to"))

    own = some.select("line", F.col("hashes").alias("a"))
    other = some.select(F.col("line").alias("to"), F.col("hashes").alias("b"))
    near = pairs.join(own, "line").join(other, "to").filter(_one_edit(F.col("a"), F.col("b"))).select("line")
    near = written(near.distinct(), "lines-near")
    dropped(some)
    dropped(emitted)
    return first.drop("halves"), near


def _prepared(docs: DataFrame, id: str, text: str) -> DataFrame:
    t = F.coalesce(docs[text], F.lit(""))
    return docs.select(docs[id].alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))


def _kept(first: DataFrame, near: DataFrame) -> DataFrame:
    """By document: kept (positions of first lines that stay) and n_near (those that go)."""
    marked = first.join(near.select("line", F.lit(True).alias("goes")), "line", "left")
    return marked.groupBy(*DOC).agg(F.collect_list(F.when(F.col("goes").isNull(), F.col("pos"))).alias("kept"),
                                    F.count("goes").alias("n_near"))


def line_report(docs: DataFrame, rules: LineRules = EVERY_LINE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_lines (of min_words words or more), n_exact and n_near (removed), n_kept.

    Null and empty texts have no lines. Null ids come after all others. Rows that repeat id and text count as one row and
    have the same result; rows of one id with different texts are different documents. Extra columns are dropped.
    """
    prepared = _prepared(docs, id, text)
    lines = _hashed_lines(prepared, rules)
    first, near = removed_lines(prepared, lines)
    kept = _kept(first, near).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"),
                                     F.size("kept").cast("long").alias("n_kept"), "n_near")
    counted = lines.groupBy(*DOC).agg(F.count("*").alias("n"))
    rows = prepared.groupBy(*DOC).agg(F.count("*").alias("rows"))
    both = [rows["id"].eqNullSafe(counted["id"]), rows["text_hash"] == counted["text_hash"]]
    df = rows.join(counted, both, "left").select(rows["id"], rows["text_hash"], "rows", F.coalesce("n", F.lit(0)).alias("n"))
    df = df.join(kept, [df["id"].eqNullSafe(kept["__id"]), df["text_hash"] == kept["__hash"]], "left")
    n = F.floor(F.col("n") / F.col("rows"))
    n_kept, n_near = F.coalesce("n_kept", F.lit(0)), F.coalesce("n_near", F.lit(0))
    df = df.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return df.select(F.col("id").alias(id), n.alias("n_lines"), (n - n_kept - n_near).alias("n_exact"),
                     n_near.alias("n_near"), n_kept.alias("n_kept"))


def line_clean(docs: DataFrame, rules: LineRules = EVERY_LINE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, text without the removed lines; documents left without a word go."""
    prepared = _prepared(docs, id, text)
    first, near = removed_lines(prepared, _hashed_lines(prepared, rules))
    kept = _kept(first, near).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("kept").alias("__kept"))
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    df = hashed.join(kept, [hashed[id].eqNullSafe(kept["__id"]), hashed["__text_hash"] == kept["__hash"]], "left")
    all_lines = F.split(F.coalesce(hashed[text], F.lit("")), "\n")
    stays = F.filter(
        F.transform(all_lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda p: (F.regexp_count(p["x"], F.lit(r"[^\x20\x09-\x0D]+")) < rules.min_words)
        | F.array_contains(F.coalesce("__kept", F.array().cast("array<int>")), p["i"]),
    )
    new = F.array_join(F.transform(stays, lambda p: p["x"]), "\n")
    df = df.withColumn("__new", new).filter(F.col("__new").rlike(r"[^\x20\x09-\x0D]"))
    return df.select(*[F.col("__new").alias(c) if c == text else hashed[c] for c in docs.columns])
