"""URL filters: host and path rules first, a ratio of two character Markov models for the rest; DataFrame functions only.

The model for accepted and the one for rejected URLs are variable-order Markov models over characters: the probability of
a character after its context of up to ORDER characters mixes, by Witten-Bell weights, the counts after the whole context
with the model of the next shorter one, down to a uniform one. Both are read off one table of counts of character grams.
A URL's score is the mean over its characters of the log-likelihood difference; its threshold is calibrated on the URLs
that rules decide: the boundary between two halves of the training URLs, where as many accepted as rejected ones (in
shares) fall on the wrong side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import let, only, written

ORDER = 3
#: Characters of a URL as the models see them: the whole text as it is, all beyond printable ASCII as one.
OTHER = "\x7f"
START, END = "\x02", "\x03"
#: A spelling that more pages have than this is dealt over one task for each so many; a gram likewise by its places in URLs.
HOT_PAGES = 100_000
HOT_GRAMS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Fits host and its subdomains where the path begins with path."""

    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of production; of those that fit, the longest decides.
RULES = (
    Rule(True, "org", "/"),
    Rule(False, "example.org", "/es/"),
    Rule(False, "example.org", "/en/1"),
    Rule(True, "com", "/fr/"),
    Rule(False, "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lowered; empty without ://, for null too."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://, for null too."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule that fits, or null."""
    return F.coalesce(*[
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name))
        for r in sorted(rules, key=lambda r: -len(r.name))
    ])


def _spelled(url: Column) -> Column:
    """What the models read: the whole URL, an empty text for null."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[^\x20-\x7e]", OTHER)


def _grams(text: Column) -> Column:
    """array of the grams that end at each character: the ORDER characters before it and itself."""
    characters = F.split(F.concat(F.lit(START * ORDER), text, F.lit(END)), "")
    return let(characters, lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - ORDER - 1), lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)])))


def _markov(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fold, gram, llr) for each wanted gram: log10 of its last character's probability, accepted over rejected.

    counts: fold, gram, n_good, n_bad, of whole grams; each fold is a model of its own. Tables here have a row for each
    gram, not for each URL. Each order is written before the next, so that no plan holds them all.
    """
    alphabet = 97.0
    df = wanted.withColumn("p_good", F.lit(1 / alphabet)).withColumn("p_bad", F.lit(1 / alphabet))
    for k in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - k, k + 1)
        level = counts.groupBy("fold", tail.alias("tail")).agg(F.sum("n_good").alias("c_good"), F.sum("n_bad").alias("c_bad"))
        context = level.groupBy("fold", F.expr(f"left(tail, {k})").alias("context")).agg(
            *[F.sum(f"c_{x}").alias(f"n_{x}") for x in ("good", "bad")],
            *[F.count_if(F.col(f"c_{x}") > 0).alias(f"t_{x}") for x in ("good", "bad")],
        )
        df = df.withColumn("tail", tail).withColumn("context", F.expr(f"left(tail, {k})"))
        #: Up to two characters make no more rows than the alphabet squared for each fold; many grams share each.
        level, context = F.broadcast(level) if k < 2 else level, F.broadcast(context) if k < 3 else context
        df = df.join(level, ["fold", "tail"], "left").join(context, ["fold", "context"], "left")
        for x in ("good", "bad"):
            c, n, t = (F.coalesce(F.col(f"{y}_{x}"), F.lit(0)) for y in "cnt")
            df = df.withColumn(f"p_{x}", F.when(n == 0, F.col(f"p_{x}")).otherwise((c + t * F.col(f"p_{x}")) / (n + t)))
        df = written(df.select("fold", "gram", "p_good", "p_bad"), "url-model")
    return df.select("fold", "gram", F.log10(F.col("p_good") / F.col("p_bad")).alias("llr"))


def _scored(grams: DataFrame, wanted: DataFrame, model: DataFrame) -> DataFrame:
    """(key, score): the mean llr of the grams (fold, key, gram) of each URL. A gram with many places (wanted: fold, gram,
    places) is dealt over as many tasks as these ask for."""
    salts = F.ceil(F.col("places") / HOT_GRAMS).cast("int")
    salted = model.join(wanted.select("fold", "gram", salts.alias("of")), ["fold", "gram"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("of") - 1))).drop("of")
    hot = wanted.filter(F.col("places") > HOT_GRAMS).select("fold", "gram", salts.alias("of"))
    #: Rows of some 30 bytes, no more than all places over HOT_GRAMS.
    grams = grams.join(F.broadcast(hot) if hot.count() <= HOT_GRAMS else hot, ["fold", "gram"], "left")
    grams = grams.withColumn("salt", F.pmod(F.xxhash64("key"), F.coalesce("of", F.lit(1))).cast("int"))
    return grams.join(salted, ["fold", "gram", "salt"]).groupBy("key").agg(F.avg("llr").alias("score"))


def _threshold(scored: DataFrame) -> float:
    """Where the share of accepted URLs below comes nearest to that of rejected ones above, over a histogram."""
    step = 1 / 64
    bins = scored.groupBy(F.round(F.col("score") / step).alias("bin")).agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad"))
    lower = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    wrong = F.greatest(
        F.coalesce(F.sum("good").over(lower), F.lit(0)) / F.greatest(F.sum("good").over(every), F.lit(1)),
        1 - F.coalesce(F.sum("bad").over(lower), F.lit(0)) / F.greatest(F.sum("bad").over(every), F.lit(1)),
    )
    best = bins.select("bin", wrong.alias("wrong")).orderBy("wrong", F.abs("bin"), "bin").first()
    return (best["bin"] - 0.5) * step if best else 0.0


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule (or null), verdict (allow or block), score (null where a rule decides).

    Null URLs and those without :// have empty host and path, no rule, and the models' verdict on their text. Equal
    URLs share their verdict. Without URLs that rules allow, or none that they block, the models see both as alike where
    they know nothing. Extra columns are dropped; an empty table gives no rows.
    """
    df = only(pages, id, url)
    df = df.select(F.col(id).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                   _spelled(F.col(url)).alias("spelled"))
    df = written(df.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    allowed = F.col("rule").isin([r.name for r in rules if r.allow])
    known = df.filter(F.col("rule").isNotNull()).groupBy("spelled").agg(
        F.count_if(allowed).alias("n_good"), F.count_if(~allowed).alias("n_bad"))
    known = known.withColumn("half", F.pmod(F.xxhash64("spelled"), F.lit(2)))
    known = written(known, "url-known")
    grams = known.select("half", "n_good", "n_bad", F.explode(_grams(F.col("spelled"))).alias("gram"))
    counts = written(grams.groupBy("half", "gram").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad")), "url-grams")

    #: Folds 0 and 1: each half of the known URLs, by the model of the other half, which has not seen them; they set the
    #: threshold. Fold 2: the URLs that no rule decides, by the model of both.
    asked = df.filter(F.col("rule").isNull()).select(F.lit(2).alias("fold"), "spelled").distinct()
    asked = asked.select("fold", "spelled", F.lit(0).cast("long").alias("n_good"), F.lit(0).cast("long").alias("n_bad"))
    spelled = known.select(F.col("half").cast("int").alias("fold"), "spelled", "n_good", "n_bad").unionByName(asked)
    spelled = written(spelled.withColumn("key", F.monotonically_increasing_id()), "url-spelled")
    every = written(spelled.select("fold", "key", F.explode(_grams(F.col("spelled"))).alias("gram")), "url-asked")
    taught = counts.select(F.explode(F.array((1 - F.col("half")).cast("int"), F.lit(2))).alias("fold"), "gram", "n_good", "n_bad")
    taught = written(taught.groupBy("fold", "gram").agg(F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad")), "url-taught")
    wanted = written(every.groupBy("fold", "gram").agg(F.count("*").alias("places")), "url-wanted")
    scored = _scored(every, wanted, _markov(taught, wanted.select("fold", "gram")))
    scored = written(spelled.join(scored, "key"), "url-scores")
    threshold = _threshold(scored.filter("fold < 2"))
    scores = scored.filter("fold = 2").select(F.col("spelled").alias("__spelled"), "score")
    #: Pages that no rule decides look for their score; a spelling that many pages share is dealt over as many tasks as its
    #: pages ask for.
    asking = df.filter(F.col("rule").isNull())
    often = asking.groupBy("spelled").agg(F.count("*").alias("pages")).select(
        F.col("spelled").alias("__spelled"), F.ceil(F.col("pages") / HOT_PAGES).cast("int").alias("__salts"))
    scores = written(scores.join(often, "__spelled"), "url-verdicts")
    hot = scores.filter("__salts > 1").select(F.col("__spelled").alias("__hot"), F.col("__salts").alias("__of"))
    #: No more hot spellings than pages over HOT_PAGES.
    open_ = asking.join(F.broadcast(hot) if hot.count() <= HOT_PAGES else hot, F.col("spelled") == F.col("__hot"), "left")
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("id", "host"), F.coalesce("__of", F.lit(1))).cast("int"))
    salted = scores.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
    scored = open_.join(salted, (open_["spelled"] == salted["__spelled"]) & (open_["salt"] == salted["__salt"]))
    closed = df.filter(F.col("rule").isNotNull())
    columns = [F.col("id").alias(id), "host", "path", "rule"]
    return scored.select(*columns, F.when(F.col("score") >= threshold, "allow").otherwise("block").alias("verdict"), "score").unionByName(
        closed.select(*columns, F.when(allowed, "allow").otherwise("block").alias("verdict"), F.lit(None).cast("double").alias("score")))
