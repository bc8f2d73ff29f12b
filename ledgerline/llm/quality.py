"""Quality rules: line-first cleaning with DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines are removed; a document that
loses too much of its text, or fails the base rules, is rejected. All work happens within a row: no shuffle, and
memory is bounded by one document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, only, words

WINDOW = 5


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; the defaults are those of production.

    A line fails if its symbols exceed max_symbols of its words, if at least min_bars bars (or bullets, arrows) make up
    max_bars of its words, if max_shouted of its words (of five or more) have no small letter but two capitals, or if it
    is a line of at most boilerplate_words words that has a boilerplate phrase, or that ends as a teaser does: with an
    ellipsis, with or without a word that leads on. A document is rejected that keeps less than min_kept of its word
    characters.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols: float = 0.3
    min_bars: int = 3
    max_bars: float = 0.2
    max_shouted: float = 0.6
    boilerplate_words: int = 30
    min_kept: float = 0.5
    boilerplate: tuple[str, ...] = (
        "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "we use cookies",
        "enable javascript", "click here to", "sign up for our newsletter", "share this page", "lorem ipsum",
        "skip to content", "powered by wordpress", "back to top",
        "tous droits réservés", "mentions légales", "politique de confidentialité", "nous utilisons des cookies", "cliquez ici pour",
        "alle rechte vorbehalten", "nutzungsbedingungen gelten", "datenschutzerklärung lesen", "wir verwenden cookies", "klicken sie hier",
        "todos los derechos reservados", "aviso legal", "política de privacidad", "utilizamos cookies", "haga clic aquí",
    )
    leads_on: tuple[str, ...] = ("more", "read more", "lire la suite", "weiterlesen", "leer más")


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))


def repeat_words(w: Column) -> Column:
    """Words inside five-word windows that occur twice or more in the array of words."""

    def covered(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, i: (p["h"] == F.get(pairs, i - 1)["h"]) | (p["h"] == F.get(pairs, i + 1)["h"]))
        starts = F.sort_array(F.transform(twice, lambda p: p["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(s, i + 1) - p, F.lit(WINDOW)))),
            F.lit(0).cast("long"), lambda a, x: a + x))

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, covered))

    def of_words(x: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(x) - WINDOW), lambda i: F.xxhash64(*[F.get(x, i + k) for k in range(WINDOW)]))
        return F.when(F.size(x) <= WINDOW, F.lit(0).cast("long")).otherwise(let(h, of_hashes))

    return let(w, of_words)


_BLANK = "\x20\t\n\x0b\f\r"


def _teases(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a line ends with an ellipsis, a word that leads on (in square brackets or not) behind it or not. Ends are
    trimmed and looked at in a few characters, so the time does not grow with a line's white space."""
    ended = F.rtrim(low, F.lit(_BLANK + "»>"))
    few = max(map(len, words)) + 2
    rest = F.concat(F.left(ended, F.greatest(F.length(ended) - few, F.lit(0))), F.regexp_replace(F.right(ended, F.lit(few)), rf"\[?(?:{'|'.join(words)})\]?$", ""))
    left = F.rtrim(rest, F.lit(_BLANK))
    return left.endswith("...") | left.endswith("…")


def _line_fails(line: Column, rules: QualityRules) -> Column:
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))
    bars = F.regexp_count(line, F.lit(r"[|»•·]"))
    #: Few lines have two capitals in a word; only their words are looked at one by one.
    loud = F.size(F.filter(words(line), lambda w: w.rlike(r"\p{Lu}.*\p{Lu}") & ~w.rlike(r"\p{Ll}")))
    shouted = F.when(line.rlike(r"\p{Lu}[^\x20\x09-\x0D\p{Ll}]*\p{Lu}"), loud).otherwise(0)
    low = F.lower(line)
    phrase = F.lit(False)
    for p in rules.boilerplate:
        phrase = phrase | low.contains(p)
    return let(n, lambda n: (
        (_symbols(line) > n * rules.max_symbols)
        | let(bars, lambda b: (b >= rules.min_bars) & (b >= n * rules.max_bars))
        | ((n >= 5) & (shouted > n * rules.max_shouted))
        | ((n <= rules.boilerplate_words) & (phrase | _teases(low, rules.leads_on)))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _with_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")).cast("long")


def _measured(docs: DataFrame, rules: QualityRules, text: str) -> DataFrame:
    """docs with the counts, the cleaned text and the verdicts in columns that begin with two underscores.

    Each step reads columns of the one before, so that no array is computed again for every element of another.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__w", words(t)).withColumn("__l", F.filter(_lines(t), _with_word))
    df = df.withColumn("__good", F.filter("__l", lambda x: ~_line_fails(x, rules)))
    df = df.select(
        *[df[c] for c in docs.columns],
        F.size("__w").cast("long").alias("__n_words"),
        _word_chars(t).alias("__word_chars"),
        _symbols(t).cast("long").alias("__n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("__n_dup_lines"),
        repeat_words(F.col("__w")).alias("__n_repeat_words"),
        F.array_join("__good", "\n").alias("__clean"),
        (F.size("__l") - F.size("__good")).cast("long").alias("__n_bad_lines"),
    )
    base = (F.col("__n_words") < rules.min_words) | (100 * F.col("__n_repeat_words") > rules.max_repeat_percent * F.col("__n_words"))
    left = F.when(F.col("__n_bad_lines") == 0, F.col("__word_chars")).otherwise(_word_chars(F.col("__clean")))
    df = df.withColumn("__base", base)
    return df.withColumn("__kept", ~F.col("__base") & (left >= F.col("__word_chars") * rules.min_kept))


def quality_report(docs: DataFrame, rules: QualityRules = QualityRules(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its counts, base_failed and kept.

    Null or empty text: all counts 0, base_failed, not kept. Repeated rows each get their row. Null ids stay null. Extra
    columns are dropped. An empty table gives no rows.
    """
    df = _measured(only(docs, id, text), rules, text)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return df.select(
        F.col(id), *[F.col(f"__{c}").alias(c) for c in counts],
        F.col("__base").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__n_bad_lines").alias("n_bad_lines"),
    )


def quality_clean(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """The documents kept, all their columns, text without the failing lines (unchanged where no line fails)."""
    df = _measured(docs, rules, text).filter("__kept")
    cleaned = F.when(F.col("__n_bad_lines") == 0, F.col(text)).otherwise(F.col("__clean"))
    return df.select(*[cleaned.alias(c) if c == text else df[c] for c in docs.columns])
