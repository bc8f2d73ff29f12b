"""Spelling variants: words one edit apart, each led back to the spelling that it most likely stands for.

Every word has a mask with the parity of each letter's count. One edit flips at most two bits of it, so of three bands of
the mask at least one is equal in two words that are one edit apart. It also leaves the first or the second half of the
shorter word as it is. Words meet where their lengths, a band and a half agree: equality joins on hashed keys, no pairs of
all words. Each pair that meets is verified by its edit distance, and counted at the first key on which it meets only.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import dropped, only, written

#: Letters of words: A-Z, a-z and the Latin-1 block from its first letter on.
RUN = "[A-Za-zÀ-ÿ]+"
BANDS, BAND_BITS = 3, 21
#: A chain of forms grows by the factor `times` a step, so counts below 2**63 allow at most 27 steps; rounds double.
ROUNDS = 5


@dataclass(frozen=True)
class Spelling:
    """Words of at least min_chars code points and min_count occurrences; a form has at least times a word's count.

    Where damage divides the crc32 of `<id>:<run>`, the run loses a letter first (0: none does)."""

    min_chars: int = 6
    min_count: int = 5
    times: int = 5
    damage: int = 199


def word_counts(docs: DataFrame, spelling: Spelling = Spelling(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the distinct words of all texts and how often they occur. Counts are combined before they are shuffled."""
    low = F.translate(F.coalesce(docs[text], F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(docs[id].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= spelling.min_chars)
    word = F.col("run")
    if spelling.damage:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(h % spelling.damage == 0, cut).otherwise(word)
    counts = runs.select(word.alias("word")).filter(F.length("word") >= spelling.min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter(F.col("n") >= spelling.min_count)


def _bit(letter: Column) -> Column:
    """The mask's bit of a letter; frequent letters are spread over the bands, accented ones share bits."""
    code = F.ascii(letter)
    plain = code - ord("a")
    accented = code - 0xC0
    return F.when(code < 128, BAND_BITS * (plain % BANDS) + (plain / BANDS).cast("int")).otherwise(
        BAND_BITS * (accented % BANDS) + 9 + (accented / BANDS).cast("int") % 12)


def parity_mask(word: Column) -> Column:
    """long: bit b is set if the letters of b occur an odd number of times."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(c))))


def _band(mask: Column, j: int) -> Column:
    return F.shiftright(mask, BAND_BITS * j).bitwiseAND((1 << BAND_BITS) - 1)


def _halves(word: Column, shorter: Column) -> tuple[Column, Column]:
    """What stays equal in two words, the shorter of so many letters, unless the one edit lies in it."""
    half = (shorter / 2).cast("int")
    return F.substring(word, F.lit(1), half), F.right(word, shorter - half)


def _keyed(words: DataFrame) -> DataFrame:
    """(word, n, mask, longer, slot, key): each word once for its own length and once as the longer of a pair."""
    length = F.length("word")
    keys = []
    for longer, shorter in ((False, length), (True, length - 1)):
        for side, half in enumerate(_halves(F.col("word"), shorter)):
            for j in range(BANDS):
                key = F.xxhash64(shorter, F.lit(2 * j + side), _band(F.col("mask"), j), half)
                keys.append(F.struct(F.lit(longer).alias("longer"), F.lit(2 * j + side).alias("slot"), key.alias("key")))
    return words.select("word", "n", "mask", F.explode(F.array(*keys)).alias("k")).select("word", "n", "mask", "k.*")


#: Spark's distance of long words takes time with the square of their length.
LONG_WORD = 64


def one_edit(a: Column, b: Column) -> Column:
    """Whether b, as long as a or longer by one, is exactly one inserted or replaced letter away from a."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x.isNull() | (x != y))
    first = F.array_position(differ, F.lit(True)).cast("int")
    without = F.concat(F.left(b, first - 1), F.substr(b, first + 1))
    long = F.when(F.length(a) == F.length(b), F.size(F.filter(differ, lambda d: d)) == 1).otherwise(without == a)
    return F.when(F.length(a) > LONG_WORD, long).otherwise(F.levenshtein(a, b, 1) == 1)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all pairs of words (word, n), both ways, that are exactly one edit apart."""
    keyed = _keyed(words.withColumn("mask", parity_mask(F.col("word"))))
    a = keyed.filter(~F.col("longer")).select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("mask").alias("a_mask"), "slot", "key")
    b = keyed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("mask").alias("b_mask"), "longer", "key", F.col("slot").alias("b_slot"))
    met = a.join(b, "key").filter((F.col("slot") == F.col("b_slot")) & (F.col("longer") | (F.col("a") < F.col("b"))))
    met = met.filter(F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2)
    first = F.lit(BANDS)
    for j in reversed(range(BANDS)):
        first = F.when(_band(F.col("a_mask"), j) == _band(F.col("b_mask"), j), j).otherwise(first)
    shorter = F.length("a")
    side = F.when(_halves(F.col("a"), shorter)[0] == _halves(F.col("b"), shorter)[0], 0).otherwise(1)
    pairs = met.filter(F.when(F.col("slot") == 2 * first + side, one_edit(F.col("a"), F.col("b"))).otherwise(False)).select("a", "a_n", "b", "b_n")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return pairs.select(both.alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): where the chain of forms that begins at word ends. Each round halves chains."""
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    for _ in range(ROUNDS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = written(now.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        dropped(now)
        now = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            break
    return now


def spelling_report(docs: DataFrame, spelling: Spelling = Spelling(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    form is the near word of largest n (ties: the smallest in code-point order) if it occurs spelling.times as often; root
    is where following forms ends. Null and empty texts have no words, a null id counts as empty, repeated rows count
    each, extra columns are ignored; an empty table gives no rows.
    """
    words = written(word_counts(only(docs, id, text), spelling, id, text), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    joined = words.join(near, "word", "left")
    enough = F.col("form_n") >= spelling.times * F.col("n")
    found = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"),
                                  F.when(enough, F.col("form_n")).alias("form_n")), "spellings")
    dropped(words)
    led = roots(found.filter("form IS NOT NULL"))
    return found.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
