"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Words of a source form a stream: its documents in an order shuffled by a hash, cut into blocks of equal words. The
golden-ratio sequence assigns slots to sources in proportion to their targets; the k-th slot of a source takes its k-th
block, beginning again after the last. So every prefix of the schedule holds the sources near their shares.

Running positions inside a source (where a document begins, which slot is the k-th) are prefix sums in two levels: sums
of small cells first, then a window over the cells' sums, then a window within each cell. No window ever holds a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import only, words, written

#: Fraction of the golden ratio.
PHI = 0.6180339887498949
#: Up to so many sources (of under 100 bytes each, a few MB) their table is broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    """share: words of the mix over words of all documents. cap: most passes over a source. cell_rows: documents of a
    cell of the prefix sums; block_words: words of a block."""

    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    cap: int = 2
    block_words: int = 8192
    cell_rows: int = 5000


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def source_targets(totals: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size) with the source's target.

    Sources in order of code points, null last, get the weights in turn. Targets are the least of cap times the size and
    a common level times the weight, the level such that they add up to the share of all words: what resharing every
    excess by weight until none is above ends in. The windows run over one row for each source.
    """
    by_code = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_code) - 1) % len(mix.weights)
    df = totals.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in mix.weights]), turn + 1))
    df = df.withColumn("most", F.col("source_size") * F.lit(mix.cap))
    by_ratio = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    asked = F.sum("source_size").over(everything) * F.lit(float(mix.share))
    capped = F.coalesce(F.sum("most").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    df = df.withColumn("level", (asked - capped) / open_weight)
    level = F.max(F.when(F.col("level") <= F.col("most") / F.col("weight"), F.col("level"))).over(everything)
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * level, F.col("most").cast("double")))
    return df.withColumn("target", target).select("source", "source_size", "target")


def _within(df: DataFrame, group: str, cell: str, order: list, add: Column, name: str) -> DataFrame:
    """df with the sum of add over all rows of its group before it, in order of cell and then of order."""
    sums = df.groupBy(group, cell).agg(F.sum(add).alias("__in_cell"))
    cells = Window.partitionBy(group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(group, cell, F.coalesce(F.sum("__in_cell").over(cells), F.lit(0)).alias("__cell_start"))
    rows = Window.partitionBy(group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__before", F.coalesce(F.sum(add).over(rows), F.lit(0)))
    df = df.join(starts, [group, cell])
    return df.withColumn(name, F.col("__cell_start") + F.col("__before")).drop("__cell_start", "__before")


def schedule(quotas: DataFrame, slots: int, n_sources: int, mix: Mix = Mix()) -> DataFrame:
    """(s, rank, slot): which source each slot of the mix serves, and its rank among the source's slots.

    quotas has s, lo, hi (the source's interval of the unit line) and quota (its slots). Slots beyond a quota are dropped;
    ranks that the sequence has not reached by its end follow after it.
    """
    spark = quotas.sparkSession
    grid = 4 * max(1, n_sources)
    lines = quotas.select("s", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * grid), F.least(F.floor(F.col("hi") * grid), F.lit(grid - 1).cast("long")))).alias("cell"))
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("u", (F.col("slot") + 0.5) * PHI - F.floor((F.col("slot") + 0.5) * PHI))
    points = points.withColumn("cell", F.floor(F.col("u") * grid))
    served = points.join(_small(lines, n_sources), "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
    served = served.select("s", "slot", F.floor(F.col("slot") / mix.cell_rows).alias("chunk"))
    ranked = _within(served, "s", "chunk", [F.col("slot")], F.lit(1), "rank").select("s", "rank", "slot")
    reached = served.groupBy("s").agg(F.count("*").alias("reached"))
    late = quotas.join(reached, "s", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    late = late.filter(F.col("quota") > F.col("reached"))
    late = late.select("s", F.explode(F.sequence(F.col("reached"), F.col("quota") - 1)).alias("rank"))
    late = late.withColumn("slot", F.col("rank") + slots)
    quota = quotas.select("s", "quota")
    kept = ranked.join(_small(quota, n_sources), "s").filter(F.col("rank") < F.col("quota")).drop("quota")
    return kept.unionByName(late.select("s", "rank", "slot"))


def mix_slices(sized: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The mix of the rows of sized: key (any column), source, size (words), shuffle (string: the order within a source).

    Returns (rows, slices). rows: sized with source_size, target and row, an id of the row. slices: what the slots take:
    row, slot, start (in the source's words) and words (the part of the row that the slot's block holds). Each source gives its target, rounded; no row
    more than cap times its size.
    """
    sized = written(only(sized, "key", "source", "size", "shuffle"), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix)
    targets = targets.withColumn("s", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    share = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    targets = targets.withColumn("words", F.floor(F.col("target") + 0.5))
    blocks = F.ceil(F.col("source_size") / F.lit(mix.block_words))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("blocks", blocks).withColumn("passes", passes)
    rest = F.col("words") - F.col("passes") * F.col("source_size")
    targets = targets.withColumn("quota", F.col("passes") * F.col("blocks") + F.ceil(rest / F.lit(mix.block_words)))
    total = F.greatest(F.sum("quota").over(Window.partitionBy()), F.lit(1))
    ahead = F.coalesce(F.sum("quota").over(share), F.lit(0))
    targets = targets.withColumn("lo", ahead / total).withColumn("hi", (ahead + F.col("quota")) / total)
    targets = written(targets, "mix-targets")
    n_sources, slots = targets.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    n = sized.count()

    names = targets.select(F.col("source").alias("__source"), "s", "source_size", "target")
    rows = sized.join(_small(names, n_sources), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    #: Hexadecimal digits of the shuffle that make a cell: so many that a cell of the largest source stays small.
    digits = 2
    while 16**digits * mix.cell_rows < n and digits < 8:
        digits += 1
    rows = rows.withColumn("cell", F.substring("shuffle", 1, digits))
    order = [F.col("shuffle"), F.col("key"), F.col("size")]
    within = Window.partitionBy("s", "cell").orderBy(*order)
    rows = rows.withColumn("n", F.row_number().over(within))
    rows = _within(rows, "s", "cell", [F.col("n")], F.col("size"), "start")
    rows = written(rows.withColumn("row", F.struct("s", "cell", "n")), "mix-rows")

    held = rows.filter("size > 0").select("s", "row", "start", (F.col("start") + F.col("size")).alias("end"))
    held = held.withColumn("block", F.explode(F.sequence(
        F.floor(F.col("start") / mix.block_words), F.floor((F.col("end") - 1) / mix.block_words))))
    quotas = targets.select("s", "lo", "hi", "quota").filter("quota > 0")
    taken = schedule(quotas, slots, n_sources, mix)
    limits = targets.select("s", "words", "blocks", "source_size")
    taken = taken.join(_small(limits, n_sources), "s").withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
    taken = taken.withColumn("block", F.col("rank") - F.col("pass") * F.col("blocks"))
    to = F.least((F.col("block") + 1) * mix.block_words, F.col("source_size"), F.col("words") - F.col("pass") * F.col("source_size"))
    taken = taken.select("s", "block", "slot", (F.col("block") * mix.block_words).alias("from"), to.alias("to"))
    slices = taken.join(held, ["s", "block"])
    part = F.least("to", "end") - F.greatest("from", "start")
    slices = slices.withColumn("words", part).filter("words > 0")
    return rows, slices.select("row", "slot", F.greatest("from", "start").alias("start"), "words")


def mix_report(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row for each row of sized: key, source, size, source_size, target, taken.

    Null sources are a source of their own, the last; rows of size 0 take nothing; repeated rows are rows of their own;
    an empty table gives no rows. Extra columns are dropped.
    """
    rows, slices = mix_slices(sized, mix)
    every = rows.select("row", F.lit(0).cast("long").alias("words")).unionByName(slices.select("row", "words"))
    taken = every.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(taken, "row").select("key", "source", "size", "source_size", "target", "taken")


def sizes(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs as mix_report takes them: key is the id, the order within a source that of an MD5."""
    return docs.select(
        docs[id].alias("key"), docs[source].alias("source"), F.size(words(docs[text])).cast("long").alias("size"),
        _shuffle(docs[id], docs[text]).alias("shuffle"),
    )


def _shuffle(id: Column, text: Column) -> Column:
    """The order within a source: the MD5 of id and text, so that null ids, or rows of one id, spread as others do."""
    return F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))).cast("binary"))


ADDED = ("size", "source_size", "target", "taken")


def _keyed(docs: DataFrame, id: str, text: str, source: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs with a key for each row, what mix_slices takes of them, and the columns of docs that stay.

    Rows that share id and text follow by the hash of their other columns; those that share all are alike.
    """
    own = [c for c in docs.columns if c not in ADDED]
    stored = written(docs.select(*own).withColumn("__key", F.monotonically_increasing_id()), "mix-docs")
    plain = [c for c in own if "map" not in stored.schema[c].dataType.simpleString()]
    order = F.concat(_shuffle(F.col(id), F.col(text)), F.lpad(F.hex(F.xxhash64(*plain)), 16, "0"))
    size = F.size(words(F.col(text))).cast("long")
    sized = stored.select(F.col("__key").alias("key"), F.col(source).alias("source"), size.alias("size"), order.alias("shuffle"))
    return stored, sized, own


def mix_documents(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, all their columns, with size, source_size, target and taken.

    A column of docs by one of these names goes. Documents of which the mix takes nothing go.
    """
    stored, sized, own = _keyed(docs, id, text, source)
    report = mix_report(sized, mix).filter("taken > 0").select(F.col("key").alias("__key"), *ADDED)
    return stored.join(report, "__key").select(*own, *ADDED)


def mix_sequence(docs: DataFrame, mix: Mix = Mix(), id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: (id, source, slot, start, words), a row for each part of a document that a slot takes.

    Read in order of slot, then start (where the part begins among its source's words), it is the training sequence: every
    prefix holds the sources near their shares. Documents may be cut between two slots.
    """
    stored, sized, _ = _keyed(docs, id, text, source)
    rows, slices = mix_slices(sized, mix)
    parts = slices.join(rows.select("row", "key"), "row").select(F.col("key").alias("__key"), "slot", "start", "words")
    return parts.join(stored.select("__key", id, source), "__key").select(id, source, "slot", "start", "words")
