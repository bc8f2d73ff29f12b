"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Features are densities of a seed lexicon and of one learnt from labels (words and word beginnings that are far more
frequent in documents labelled toxic), how close their hits are to second-person words, rates of capitals and punctuation,
and rates of obfuscation. They are computed with numpy over batches of texts. Training takes a bounded sample of labelled
rows, the same whatever the order of rows: a third of it teaches the lexicon, the rest the trees and the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, extended, lists
from .shared import only, written
from .wordhash import Words, word_hashes

#: Seed words for insults and contempt, by language.
SEED = (
    "idiot idiots stupid moron morons loser losers trash scum clown worthless pathetic disgusting dumb imbecile fool "
    "filth garbage vermin freak coward liar ugly hate shut kill die "
    "dumm dummkopf trottel abschaum versager widerlich erbärmlich wertlos ekelhaft arschloch "
    "imbécile crétin ordure minable dégoûtant stupide raclure pathétique menteur "
    "estúpido imbécil basura escoria patético asqueroso inútil payaso mentiroso tonto"
).split()
SECOND_PERSON = "you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()
#: What stands for which letter in obfuscated words.
LEET = dict(zip(b"013457@$!", b"oieastasi", strict=True))
PREFIXES = (4, 5, 6, 7, None)
FEATURES = (
    "log_words", "seed_density", "seed_log", "learnt_density", "learnt_log", "learnt_weight", "second_person", "near_second_person",
    "capitals", "shouted", "exclaims", "asks", "marks", "mixed_words", "unmasked", "stretched",
)


@dataclass(frozen=True)
class Training:
    """sample: most labelled rows to learn from; least_df, least_odds, least_z: an entry's
    least documents labelled toxic, log-odds, and standard deviations above the documents that chance would give it. near: words between a hit and a second-person word."""

    sample: int = 20_000
    least_df: int = 4
    least_odds: float = 1.5
    least_z: float = 4.0
    near: int = 5
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    least_leaf: int = 5


def _find(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Places of hashes in a sorted table, -1 where they are not in it."""
    if not len(table):
        return np.full(len(hashes), -1)
    at = np.searchsorted(table, hashes)
    at[at == len(table)] = 0
    return np.where(table[at] == hashes, at, -1)


def _sorted_hashes(words: list[str]) -> np.ndarray:
    return np.sort(word_hashes([" ".join(words)])[0])


def _per_text(values: np.ndarray, stops: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return np.diff(sums[stops], prepend=0.0)


_UPPER, _LETTER, _MARK, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = _DIGIT[48:58] = True
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_LEET = np.arange(256, dtype=np.uint8)
_LEET[list(LEET)] = list(LEET.values())


def features(texts: list[str | bytes | None], lexicon: tuple[np.ndarray, np.ndarray], near: int = 5) -> np.ndarray:
    """A row of FEATURES for each text; lexicon: sorted hashes of words and beginnings, and their weights."""
    seed, second = _sorted_hashes(SEED), _sorted_hashes(SECOND_PERSON)
    w = Words(texts, marks=False)
    whole = w.hashes()
    is_seed, is_second = _find(whole, seed) >= 0, _find(whole, second) >= 0
    weight = np.zeros(len(whole))
    for k in PREFIXES:
        at = _find(w.hashes(k), lexicon[0])
        hit = at >= 0
        if k is not None:
            hit &= w.ends - w.starts >= k
        weight[hit] = np.maximum(weight[hit], lexicon[1][at[hit]])
    hit = is_seed | (weight > 0)
    seconds = np.concatenate([[0], np.cumsum(is_second)])
    index, stop = np.arange(len(whole)), np.repeat(w.stops, np.diff(w.stops, prepend=0))
    start = np.repeat(np.concatenate([[0], w.stops[:-1]]), np.diff(w.stops, prepend=0))
    close = seconds[np.minimum(index + near + 1, stop)] > seconds[np.maximum(index - near, start)]

    def by_byte(flags: np.ndarray) -> np.ndarray:
        return _per_text(flags, w.text_ends)

    capital = np.concatenate([[0], np.cumsum(_UPPER[w.data])])
    small = np.concatenate([[0], np.cumsum(_LETTER[w.data] & ~_UPPER[w.data])])
    shouted = (capital[w.ends] - capital[w.starts] > 1) & (small[w.ends] == small[w.starts])
    raw = Words(texts)
    counts = [np.concatenate([[0], np.cumsum(t[raw.data])]) for t in (_LETTER, _DIGIT | _MARK)]
    inner = np.maximum(raw.ends - 1, raw.starts)
    mixed_words = (counts[0][raw.ends] - counts[0][raw.starts] > 1) & (counts[1][inner] > counts[1][np.minimum(raw.starts + 1, inner)])
    unmasked = Words(texts, marks=False, table=_LEET)
    leet_hits = _per_text(_find(unmasked.hashes(), seed) >= 0, unmasked.stops)
    same = np.zeros(len(w.data), bool)
    same[2:] = (w.data[2:] == w.data[1:-1]) & (w.data[2:] == w.data[:-2]) & _LETTER[w.data[2:]]

    n = np.maximum(np.diff(w.stops, prepend=0), 1)
    letters = np.maximum(by_byte(_LETTER[w.data]), 1)
    size = np.maximum(np.diff(w.text_ends, prepend=0), 1)
    seeds, learnt = _per_text(is_seed, w.stops), _per_text(weight > 0, w.stops)
    columns = [
        np.log1p(np.diff(w.stops, prepend=0)), seeds / n, np.log1p(seeds), learnt / n, np.log1p(learnt), _per_text(weight, w.stops) / n,
        _per_text(is_second, w.stops) / n, _per_text(hit & close, w.stops) / n, by_byte(_UPPER[w.data]) / letters,
        _per_text(shouted, w.stops) / n, by_byte(w.data == 33) / n, by_byte(w.data == 63) / n, by_byte(_MARK[w.data]) / size,
        _per_text(mixed_words, raw.stops) / n, np.maximum(leet_hits - seeds, 0) / n, by_byte(same) / n,
    ]
    return np.column_stack(columns)


class Trees:
    """Gradient-boosted regression trees for the logistic loss, over histograms of each feature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, how: Training):
        quantiles = np.linspace(0, 1, how.bins + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(c, quantiles)) for c in x.T]
        codes = self._codes(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base, self.rate, self.trees = float(np.log(p / (1 - p))), how.rate, []
        margin = np.full(len(y), self.base)
        for _ in range(how.trees):
            p = 1 / (1 + np.exp(-margin))
            tree: dict = {}
            self._grow(tree, 1, codes, y - p, p * (1 - p), np.arange(len(y)), how)
            self.trees.append(tree)
            margin += how.rate * self._value(tree, codes)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T, strict=True)])

    def _grow(self, tree: dict, node: int, codes, g, h, rows, how: Training) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if node < 2**how.depth and len(rows) >= 2 * how.least_leaf:
            for f in range(codes.shape[1]):
                n = len(self.cuts[f]) + 1
                c = codes[rows, f]
                left_g, left_h = (np.cumsum(np.bincount(c, v[rows], n))[:-1] for v in (g, h))
                left_n = np.cumsum(np.bincount(c, minlength=n))[:-1]
                gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                gain[(left_n < how.least_leaf) | (len(rows) - left_n < how.least_leaf)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            tree[node] = float(total_g / (total_h + 1))
            return
        tree[node] = best[1:]
        left = codes[rows, best[1]] <= best[2]
        self._grow(tree, 2 * node, codes, g, h, rows[left], how)
        self._grow(tree, 2 * node + 1, codes, g, h, rows[~left], how)

    def _value(self, tree: dict, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes))
        open_ = [(1, np.arange(len(codes)))]
        while open_:
            node, rows = open_.pop()
            if isinstance(tree[node], float):
                out[rows] = tree[node]
                continue
            f, cut = tree[node]
            left = codes[rows, f] <= cut
            open_ += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return self.base + self.rate * sum(self._value(t, codes) for t in self.trees)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function of x nearest to y, by pooling neighbours that go down."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of x
    for v, t in zip(x[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(v)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, s = blocks.pop()
            m0, w0, s0 = blocks.pop()
            blocks.append([(m0 * w0 + m * w) / (w0 + w), w0 + w, s0 + s])
    return np.asarray([s / w for _, w, s in blocks]), np.asarray([m for m, _, _ in blocks])


@dataclass
class Model:
    lexicon: tuple[np.ndarray, np.ndarray]
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    rate: float
    near: int

    def score(self, texts: list[str | bytes | None]) -> np.ndarray:
        """The calibrated probability; where calibration ties, the trees' own probability decides, by a hundredth at most."""
        if self.trees is None:
            return np.full(len(texts), self.rate)
        margin = self.trees.margin(features(texts, self.lexicon, self.near))
        own = 1 / (1 + np.exp(-margin))
        return np.clip(0.99 * np.interp(margin, *self.knots) + 0.01 * own, 0.0, 1.0)


def fold(id: Column, n: int) -> Column:
    """crc32 of the id as text (null: empty) modulo n."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % n


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of words and beginnings of each document, with its label."""
    for part, texts in chunks(batches):
        w = Words(texts, marks=False)
        rows = np.repeat(np.arange(len(texts)), np.diff(w.stops, prepend=0))
        out = [np.empty((0, 2), np.uint64)]
        for k in PREFIXES:
            long = np.ones(len(rows), bool) if k is None else w.ends - w.starts >= k
            out.append(np.column_stack([rows[long].astype(np.uint64), w.hashes(k)[long]]))
        seen = np.unique(np.concatenate(out), axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen[:, 1].astype(np.int64)), part.column("toxic").take(pa.array(seen[:, 0].astype(np.int64)))], names=["hash", "toxic"])


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), id: str = "doc_id", text: str = "text") -> Model:
    """Learns from labelled documents whose fold of 5 is not 0.

    labels: id, toxic. Null ids or labels are left out; an id labelled twice counts as toxic if one label says so. The sample
    are the rows with the smallest hashes of ids. Without both labels in it, every score is the share of toxic rows (or 0).
    """
    known = labels.select(F.col(id).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null")
    known = known.filter(fold(F.col("id"), 5) != 0).groupBy("id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(F.lit("sample"), F.col("id").cast("string"))
    sample = known.withColumn("order", order).orderBy("order", "id").limit(how.sample)
    #: At most how.sample rows of three numbers.
    plain = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = plain.join(F.broadcast(sample.withColumn("part", F.pmod("order", F.lit(3)))), "id")
    #: One text for each sampled id, however many rows repeat it: so the bound holds for rows too.
    joined = joined.groupBy("id", "order", "toxic", "part").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    joined = written(joined, "toxicity-sample")

    first = joined.filter("part = 0")
    n_toxic, n_clean = first.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    counts = first.select("text", "toxic").mapInArrow(_grams, "hash long, toxic int").groupBy("hash").agg(
        F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    chance = (F.col("t") + F.col("c")) * (n_toxic / max(1, n_toxic + n_clean))
    counts = counts.filter(F.col("t") - chance >= how.least_z * F.sqrt(chance))
    entries = counts.withColumn("odds", odds).filter((F.col("t") >= how.least_df) & (F.col("odds") >= how.least_odds))
    #: Entries are in four or more documents of a third of the sample, so the sample bounds them.
    rows = entries.orderBy(F.desc("odds"), F.desc("t"), "hash").select("hash", "odds").toPandas()
    hashes = rows["hash"].to_numpy(np.int64).view(np.uint64)
    at = np.argsort(hashes)
    lexicon = (hashes[at], rows["odds"].to_numpy(float)[at])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield extended(part, ["order", "id", "toxic"], x=lists(list(features(texts, lexicon, how.near)), np.float64))

    kind = plain.schema["id"].dataType.simpleString()
    data = joined.filter("part <> 0").select("order", "id", "toxic", "text").mapInArrow(measured, f"order long, id {kind}, toxic int, x array<double>")
    data = data.toPandas().sort_values(["order", "id"], kind="stable")
    y = data["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, None, None, float(y.mean()) if len(y) else 0.0, how.near)
    x = np.stack(data["x"].to_numpy())
    #: Each half is calibrated by trees grown on the other, the final trees are grown on both.
    half = np.arange(len(y)) % 2 == 0
    margin = np.empty(len(y))
    for side in (half, ~half):
        margin[~side] = Trees(x[side], y[side], how).margin(x[~side]) if 0 < y[side].sum() < side.sum() else 0.0
    return Model(lexicon, Trees(x, y, how), isotonic(margin, y), float(y.mean()), how.near)


def toxicity_report(docs: DataFrame, labels: DataFrame, how: Training = Training(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, held_out (its fold of 5 is 0), score (0 to 1) and predicted (1 from 0.5 on).

    Null and empty texts are scored as texts without words. Scores depend on the text alone: repeated rows have the same.
    Null ids are held out. Extra columns are dropped; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, how, id, text))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield extended(part, ["id", "held_out"], score=pa.array(model.value.score(texts)))

    plain = only(docs, id, text).select(F.col(id).alias("id"), (fold(F.col(id), 5) == 0).alias("held_out"), F.col(text).alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    df = plain.mapInArrow(scored, f"id {kind}, held_out boolean, score double")
    return df.select(F.col("id").alias(id), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
