"""MinHash near-deduplication by fast similarity sketching, banding and exact verification.

A sketch has one value for each of its coordinates. In round i every shingle goes to the bin its i-th hash names; a
coordinate keeps the smallest hash of the first round that reached it. After as many rounds as there are coordinates, each
further round serves one bin with all shingles, so that every coordinate fills. Two sets agree in a coordinate with the
probability of their similarity, and the number of agreements concentrates as for independent ones.

Documents with equal sets become one class first. Classes that share a band of the sketch are candidates. In each bucket
all are verified against its hub, the class that shares most buckets with others; then, for buckets that still hold several
components, the members outside the largest one are paired with all others by an exact prefix filter on their rarest
shingles, and verified. So a bucket of copies costs its size, not its square, and no link is given up.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .arrow import chunks, extended, lists
from .components import components
from .shared import dropped, written
from .wordhash import mixed, shingle_sets


@dataclass(frozen=True)
class Near:
    """Sets of distinct shingles of so many words; linked from percent similarity on. bands times rows coordinates: at 80
    percent a link shares no band with a probability of 5e-6."""

    shingle: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 6


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """t coordinates of a set of 64-bit shingle hashes that is not empty."""
    n, out, done = len(shingles), np.full(t, np.iinfo(np.uint64).max, np.uint64), 0
    shingles = mixed(shingles)
    with np.errstate(over="ignore"):
        while done < t and (out == np.iinfo(np.uint64).max).any():
            rounds = np.arange(done, min(t, done + math.ceil(t * (math.log(t) + 3) / n)), dtype=np.uint64)
            h = mixed(shingles[None, :] + mixed(rounds + np.uint64(1))[:, None])
            bins = ((h >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)
            values = (rounds[:, None] << np.uint64(51)) | (mixed(h) >> np.uint64(13))
            np.minimum.at(out, bins.astype(np.int64).ravel(), values.ravel())
            done += len(rounds)
        for b in np.flatnonzero(out == np.iinfo(np.uint64).max):
            h = mixed(mixed(shingles + mixed(np.asarray([t + b + 1], np.uint64))))
            out[b] = (np.uint64(t + b) << np.uint64(51)) | (h.min() >> np.uint64(13))
    return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of a sketch."""
    parts = values.reshape(bands, -1)
    keys = mixed(np.arange(1, bands + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        for j in range(parts.shape[1]):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, j])
    return keys.view(np.int64)


def _sketched(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            sets = shingle_sets(texts, near.shingle)
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            keys = [np.empty(0, np.int64)] * len(sets)
            with np.errstate(over="ignore"):
                for i, s in enumerate(sets):
                    if len(s):
                        h1[i], h2[i] = np.bitwise_xor.reduce(mixed(s)), np.add.reduce(mixed(s + np.uint64(77)))
                        keys[i] = band_keys(sketch(s, near.bands * near.rows), near.bands)
            yield extended(part, ["id", "text_hash"], n=pa.array([len(s) for s in sets], pa.int64()), h1=pa.array(h1.view(np.int64)),
                           h2=pa.array(h2.view(np.int64)), keys=lists(keys, np.int64))

    return run


def _sets(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield extended(part, ["node"], set=lists([s.view(np.int64) for s in shingle_sets(texts, near.shingle)], np.int64))

    return run


def _linked(near: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(*(batch.column(c) for c in ("set_a", "set_b")), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= near.percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").mapInArrow(_linked(near), "a long, b long")


def _may_link(near: Near, n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= near.percent * F.greatest(n, m)


def _rarest_shared(open_: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Pairs (a, b) of an outside class and any other of another part that may be linked: exact prefix filters.

    If each set is put in order of its shingles' frequency, rarest first, two linked sets share a shingle that is among
    the first n - ceil(n * p) + 1 of the larger and the first m - ceil(m * 2p / (1 + p)) + 1 of the smaller one, p the
    least similarity; and where they first meet, enough must be left of both. Passages that many documents share are
    frequent, so they come late and make no pairs here.
    """
    spread = open_.join(sets, "node").select("node", "part", "outside", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    spread = written(spread, "near-spread")
    often = spread.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    #: Shingles that no other has come first and make no pairs; only their number counts.
    shared = spread.join(often, "shingle")
    own = Window.partitionBy("node")
    rank = F.row_number().over(own.orderBy("often", "shingle")) + F.col("n") - F.count("*").over(own)
    p = near.percent
    prefix = shared.withColumn("rank", rank).filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * p / 100) + 1).drop("often")
    prefix = written(prefix, "near-prefix")
    small = prefix.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * (2 * p) / (100 + p)) + 1)
    small = small.select("shingle", *[F.col(c).alias(f"x_{c}") for c in ("node", "part", "outside", "n", "rank")])
    need = F.ceil((F.col("n") + F.col("x_n")) * p / (100 + p))
    may = (
        (F.col("part") != F.col("x_part"))
        & ((F.col("n") > F.col("x_n")) | ((F.col("n") == F.col("x_n")) & (F.col("node") != F.col("x_node"))))
        & _may_link(near, F.col("n"), F.col("x_n"))
        & (1 + F.least(F.col("n") - F.col("rank"), F.col("x_n") - F.col("x_rank")) >= need)
    )
    #: Two of the largest parts never meet: one of a pair is outside.
    pairs = small.filter("x_outside").join(prefix, "shingle").filter(may).select("x_node", "node")
    pairs = pairs.unionByName(small.filter("not x_outside").join(prefix.filter("outside"), "shingle").filter(may).select("x_node", "node"))
    pairs = written(pairs.select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct(), "near-met")
    dropped(spread)
    dropped(prefix)
    return pairs


def _order() -> list[Column]:
    return [F.col("id").isNull().alias("null_id"), F.col("id"), F.col("text_hash")]


def near_groups(docs: DataFrame, near: Near = Near(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, n, first): one row per document, its set's size and the first document (null_id, id, text_hash;
    null ids last) of its group; null for those without words."""
    t = F.coalesce(docs[text], F.lit(""))
    plain = docs.select(docs[id].alias("id"), F.xxhash64(t).alias("text_hash"), t.alias("text"))
    schema = f"id {plain.schema['id'].dataType.simpleString()}, text_hash long, n long, h1 long, h2 long, keys array<long>"
    sketched = written(plain.mapInArrow(_sketched(near), schema), "near-sketches")
    classes = sketched.filter("n > 0").groupBy("h1", "h2", "n").agg(
        F.min(F.struct(*_order())).alias("first"), F.min_by("keys", F.struct(*_order())).alias("keys"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")

    banded = classes.select("node", F.col("n").alias("n"), F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    crowded = written(banded.join(buckets, "key"), "near-crowded")
    #: The hub of a bucket is the class that meets most others over all its buckets: what copies were made of comes first.
    met = crowded.groupBy("node").agg(F.sum("c").alias("met"))
    hubs = crowded.join(met, "node")
    pivots = hubs.groupBy("key").agg(F.max(F.struct("met", (-F.col("node")).alias("first"), "node", "n")).alias("pivot"))
    crowded = written(crowded.join(pivots, "key").select("key", "node", "n", F.struct("pivot.node", "pivot.n").alias("pivot")), "near-buckets")
    stars = crowded.filter(F.col("node") != F.col("pivot.node")).filter(_may_link(near, F.col("n"), F.col("pivot.n")))
    stars = stars.select(F.least("pivot.node", "node").alias("a"), F.greatest("pivot.node", "node").alias("b"))
    stars = written(stars.distinct(), "near-stars")

    wanted = crowded.select("node").distinct().join(classes, "node").select("node", "first")
    on = [plain["id"].eqNullSafe(F.col("first.id")), plain["text_hash"] == F.col("first.text_hash")]
    texts = plain.join(wanted, on).select("node", plain["text"])
    sets = written(texts.mapInArrow(_sets(near), "node long, set array<long>").dropDuplicates(["node"]), "near-sets")
    links = written(_verified(stars, sets, near), "near-links")
    labels = components(links)

    #: Buckets whose members are not all in one component yet: those outside the largest part may link with any other.
    placed = crowded.join(labels, crowded["node"] == labels["id"], "left")
    placed = placed.select("key", "node", F.coalesce("component", "node").alias("part"))
    parts = placed.groupBy("key", "part").agg(F.count("*").alias("c"))
    largest = parts.groupBy("key").agg(F.max(F.struct("c", "part")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = placed.join(largest.select("key", F.col("most.part").alias("main")), "key")
    open_ = written(open_.groupBy("node", "part").agg(F.max(F.col("part") != F.col("main")).alias("outside")), "near-open")
    rest = _rarest_shared(open_, sets, near)
    rest = written(rest.join(stars, ["a", "b"], "left_anti"), "near-rest")
    dropped(stars)
    if rest.limit(1).count():
        more = written(_verified(rest, sets, near), "near-links")
        if more.limit(1).count():
            labels = components(links.unionByName(more))

    firsts = classes.join(labels, classes["node"] == labels["id"], "left").select(
        "h1", "h2", F.col("n").alias("size"), "first", F.coalesce("component", "node").alias("component"))
    of_group = firsts.groupBy("component").agg(F.min("first").alias("group_first"))
    of_class = firsts.join(of_group, "component").select("h1", "h2", "size", F.col("group_first").alias("first"))
    full = sketched.filter("n > 0").drop("keys")
    found = full.join(of_class, (full["h1"] == of_class["h1"]) & (full["h2"] == of_class["h2"]) & (full["n"] == of_class["size"]))
    found = found.select("id", "text_hash", "n", "first")
    none = sketched.filter("n = 0").select("id", "text_hash", "n", F.lit(None).cast(found.schema["first"].dataType).alias("first"))
    return found.unionByName(none)


def near_report(docs: DataFrame, near: Near = Near(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id of its group), kept (its own is that).

    Null, empty and blank texts have no shingles and are groups of their own. Null ids count as the largest; a group of
    null ids alone has a null component_id, and its first text is kept. Repeated rows have the same result. Extra columns
    are dropped; an empty table gives no rows.
    """
    df = near_groups(docs, near, id, text)
    group = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("first.id"))
    return df.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), group.alias("component_id"), F.col("id").eqNullSafe(group).alias("kept"))


def near_clean(docs: DataFrame, near: Near = Near(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each group, all columns; of rows that repeat id and text, one."""
    groups = near_groups(docs, near, id, text)
    own = (F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash")))
    stay = groups.filter(own).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hashed = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    kept = hashed.join(stay, hashed[id].eqNullSafe(stay["__id"]) & (hashed["__text_hash"] == stay["__hash"]), "left_semi")
    #: Of rows that repeat id and text, the one whose columns have the smallest hash: the same in every run.
    own = [c for c in docs.columns if "map" not in docs.schema[c].dataType.simpleString()]
    least = F.min_by(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]), F.xxhash64(*own)).alias("__row")
    kept = kept.groupBy(F.col(id).alias("__key"), "__text_hash").agg(least)
    return kept.select(*[F.col(f"__row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
