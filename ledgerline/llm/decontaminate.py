"""Benchmark decontamination: a BM25 inverted index of the test items, searched by every training passage.

The index holds the items (long ones in segments) with impacts divided by the segment's own full score, so that a score is
the weighted share of the segment's terms that the passage has. Passages are overlapping windows of words over whole texts.
All segments at or above the threshold are retrieved by block-max WAND. Before it, block maxima are added up for all passages
of a batch at once: a passage is searched only if the largest impacts of its distinct terms reach the threshold in some
group of blocks. That bound is exact: nothing above the threshold is lost. Hits are verified on question and answer: both
parts of the segment, or of the item, must have enough of their three-word shingles near the passage. A question with nearly
all of its shingles in a text counts by itself; texts meet questions by so many of the rarest shingles that one must be there.
Items too short for scores are found as whole sequences of words.

Document frequencies, the number of segments and their mean length are counted once over all items. The index is built in
tasks, in shards of about SHARD_BYTES of text, and written to the shared folder; tasks that search read it from there, shard
by shard, and keep as many as KEPT allows. So scores are the same however many shards there are, and nothing but the paths
of shards passes the driver.
"""

from __future__ import annotations

import bisect
import heapq
import math
import pickle
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import extended, runs, utf8
from .files import file_size, read_range, write_once
from .shared import fresh_path, only, written
from .wordhash import mixed, word_hashes

SHARD_BYTES = 8 << 20
#: Bytes of shards of the index that a Python worker keeps.
KEPT = 256 << 20
#: Groups of segments that bounds are kept for: terms times groups numbers, whatever the size of the index.
GROUPS = 64


@dataclass(frozen=True)
class Leaks:
    """passage, step: words of a window and between windows. threshold: least share of a segment's score. question,
    answer: least shares of their shingles; alone: of a question's that counts without its answer. Items of fewer than
    min_words words must be there word by word; questions of fewer do not count without their answer."""

    passage: int = 128
    step: int = 64
    segment: int = 64
    block: int = 16
    threshold: float = 0.6
    question: float = 0.5
    answer: float = 0.5
    alone: float = 0.9
    min_words: int = 8
    k1: float = 1.2
    b: float = 0.75


def question_and_answer(text: str, shingle: int = 3) -> tuple[str, str]:
    """The last sentence is the answer, or, if it or what is before it is too short for a shingle, the last third of the words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if p.strip()]
    if len(parts) > 1 and len(parts[-1].split()) >= shingle and len(" ".join(parts[:-1]).split()) >= shingle:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = max(shingle, len(w) - max(shingle, len(w) // 3))
    return " ".join(w[:cut]), " ".join(w[cut:])


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k words in a row."""
    out = np.zeros(max(0, len(h) - k + 1), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return out


def _shares(words: np.ndarray, near: np.ndarray) -> float:
    """The share of the distinct shingles of words that near has; 1 without words."""
    k = min(3, len(words))
    return float(np.isin(np.unique(_runs(words, k)), _runs(near, k)).mean()) if k else 1.0


def _cut(words: np.ndarray, rules: Leaks) -> list[tuple[int, int]]:
    """First and last place of the segments of an item."""
    edges = np.linspace(0, len(words), math.ceil(len(words) / rules.segment) + 1).astype(int).tolist()
    return list(zip(edges[:-1], edges[1:], strict=True))


@dataclass
class Corpus:
    """Counts over all items that are long enough for scores: segments, their words, and segments by term."""

    segments: int
    words: int
    df: dict


@dataclass
class Index:
    """Postings of each term in order of segment, with impacts, and the largest impact of each block of segments."""

    rules: Leaks
    items: list = field(default_factory=list)  # by segment: item id
    parts: dict = field(default_factory=dict)  # by item id: words, how many of them are the question's
    spans: list = field(default_factory=list)  # by segment: first and last place in the item's words
    short: dict = field(default_factory=dict)  # by number of words: hashes of the runs, and each one's item and words
    asked: tuple = ()  # the questions' rarest shingles, sorted, and the item of each
    terms: np.ndarray = None
    postings: list = field(default_factory=list)
    most: np.ndarray = None  # by term and group of segments: the largest impact

    @classmethod
    def of(cls, rows: list[tuple], rules: Leaks, corpus: Corpus | None = None) -> Index:
        """The index of rows (id, text); corpus: counts over all items, where rows are not all of them."""
        self, segments, shorts, questions = cls(rules), [], {}, []
        for item, text in rows:
            words = word_hashes([text], marks=False)[0]
            if len(words) < rules.min_words:
                if len(words):
                    shorts.setdefault(len(words), []).append((_runs(words, len(words))[0], item, words))
                continue
            asked = len(word_hashes([question_and_answer(text)[0]], marks=False)[0])
            self.parts[item] = (words, asked)
            if asked >= rules.min_words:
                questions.append((item, np.unique(_runs(words[:asked], 3)).tolist()))
            for a, z in _cut(words, rules):
                self.items.append(item)
                self.spans.append((a, z))
                segments.append(Counter(words[a:z].tolist()))
        for n, found in shorts.items():
            found.sort(key=lambda x: x[0])
            self.short[n] = (np.asarray([x[0] for x in found], np.uint64), [x[1:] for x in found])
        common, keys = Counter(x for _, q in questions for x in q), []
        for item, q in questions:
            spare = len(q) - math.ceil(rules.alone * len(q) - 1e-9)
            keys += [(x, item) for x in sorted(q, key=lambda x: (common[x], x))[: spare + 1]]
        keys.sort(key=lambda x: x[0])
        self.asked = np.asarray([x for x, _ in keys], np.uint64), [item for _, item in keys]
        corpus = corpus or Corpus(len(segments), sum(sum(s.values()) for s in segments), Counter(t for s in segments for t in s))
        df, n = corpus.df, corpus.segments
        self.terms = np.asarray(sorted({t for s in segments for t in s}), np.uint64)
        at = {t: i for i, t in enumerate(self.terms.tolist())}
        mean = corpus.words / max(1, n)
        found = [([], []) for _ in at]
        for j, s in enumerate(segments):
            norm = rules.k1 * (1 - rules.b + rules.b * sum(s.values()) / mean)
            impact = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (rules.k1 + 1) / (c + norm) for t, c in s.items()}
            full = sum(impact.values())
            for t, x in impact.items():
                found[at[t]][0].append(j)
                found[at[t]][1].append(x / full)
        blocks = math.ceil(len(segments) / rules.block)
        for docs, impacts in found:
            most = np.zeros(blocks)
            np.maximum.at(most, np.asarray(docs) // rules.block, impacts)
            self.postings.append((docs, impacts, most))
        group = max(1, math.ceil(len(segments) / GROUPS))
        self.most = np.zeros((len(found), max(1, math.ceil(len(segments) / group))), np.float32)
        for t, (docs, impacts) in enumerate(found):
            np.maximum.at(self.most[t], np.asarray(docs) // group, np.asarray(impacts, np.float32))
        return self

    def search(self, terms: list[int]) -> list[int]:
        """Segments whose score for the distinct terms is at least the threshold, by block-max WAND."""
        floor, size = self.rules.threshold - 1e-9, self.rules.block
        #: (segment the list is at, list, place in the list)
        heads = [(self.postings[t][0][0], t, 0) for t in terms]
        heapq.heapify(heads)
        out = []

        def skip(head: tuple, to: int) -> None:
            docs = self.postings[head[1]][0]
            i = bisect.bisect_left(docs, to, head[2])
            if i < len(docs):
                heapq.heappush(heads, (docs[i], head[1], i))

        top = {t: max(self.postings[t][1]) for t in terms}
        while heads:
            passed, bound, pivot = [], 0.0, None
            while heads:
                head = heapq.heappop(heads)
                passed.append(head)
                bound += top[head[1]]
                if bound >= floor:
                    pivot = head[0]
                    break
            if pivot is None:
                break
            while heads and heads[0][0] == pivot:
                passed.append(heapq.heappop(heads))
            block = pivot // size
            if sum(self.postings[t][2][block] for _, t, _ in passed) < floor:
                #: No list further on starts before heads[0], so nothing of this block up to there can reach the threshold.
                to = min((block + 1) * size, heads[0][0] if heads else len(self.items))
                for head in passed:
                    skip(head, max(to, pivot + 1))
            elif passed[0][0] == pivot:
                score = sum(self.postings[t][1][i] for _, t, i in passed)
                if score >= floor:
                    out.append(pivot)
                for head in passed:
                    skip(head, pivot + 1)
            else:
                for head in passed:
                    skip(head, pivot)
        return out

    def hits(self, words: np.ndarray) -> list:
        """Ids of the items whose question and answer the words of one text hold."""
        return self.all_hits(words, np.asarray([len(words)]))[0]

    def all_hits(self, words: np.ndarray, ends: np.ndarray) -> list[list]:
        """hits of texts one after another; words of text i end before ends[i]."""
        out = self._exact(words, ends)
        if not len(self.terms) or not len(words):
            return [sorted(x) for x in out]
        r = self.rules
        place = np.searchsorted(self.terms, words)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == words
        begins = np.concatenate([[0], ends[:-1]])
        #: Passages of all texts: text, first word, end.
        n = np.maximum(1, -(-(ends - begins - r.passage + r.step) // r.step))
        text = np.repeat(np.arange(len(ends)), n)
        first = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * r.step
        last = np.minimum(first + r.passage, ends[text])
        size = last - first
        inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pairs = (np.repeat(np.arange(len(text)), size) * len(self.terms) + place[inside])[known[inside]]
        passage, term = np.divmod(np.unique(pairs), len(self.terms))
        edges = np.flatnonzero(np.diff(passage, prepend=-1))
        if not len(edges):
            return [sorted(x) for x in out]
        bound = np.add.reduceat(self.most[term], edges, axis=0).max(axis=1)
        stops = np.append(edges[1:], len(term))
        #: The slack is above what 32-bit sums can be off by.
        for k in np.flatnonzero(bound >= r.threshold - 1e-3):
            at = passage[edges[k]]
            i, a, z = text[at], first[at], last[at]
            for segment in self.search(term[edges[k] : stops[k]].tolist()):
                item = self.items[segment]
                if item in out[i]:
                    continue
                more = len(self.parts[item][0])
                if self._verified(segment, words[max(begins[i], a - more) : min(ends[i], z + more)]):
                    out[i].append(item)
        return [sorted(x) for x in out]

    def _exact(self, words: np.ndarray, ends: np.ndarray) -> list[list]:
        """The short items whose words one text has in a row, and the items of which it has nearly the whole question."""
        out: list[list] = [[] for _ in ends]
        for n, (hashes, items) in self.short.items():
            if len(words) < n:
                continue
            runs = _runs(words, n)
            left, right = (np.searchsorted(hashes, runs, side) for side in ("left", "right"))
            for at in np.flatnonzero(left < right):
                i = np.searchsorted(ends, at, "right")
                for item, own in items[left[at] : right[at]] if at + n <= ends[i] else ():
                    if item not in out[i] and (words[at : at + n] == own).all():
                        out[i].append(item)
        hashes, items = self.asked
        if not len(hashes) or len(words) < 3:
            return out
        runs = _runs(words, 3)
        left = np.searchsorted(hashes, runs)
        left[left == len(hashes)] = 0
        at = np.flatnonzero(hashes[left] == runs)
        met = np.stack([np.searchsorted(ends, at, "right"), left[at]], axis=1)
        tried: set = set()
        for i, k in np.unique(met, axis=0).tolist():
            for item in items[k : np.searchsorted(hashes, hashes[k], "right")]:
                if (i, item) not in tried and item not in out[i]:
                    tried.add((i, item))
                    own, asked = self.parts[item]
                    if _shares(own[:asked], words[ends[i - 1] if i else 0 : ends[i]]) >= self.rules.alone:
                        out[i].append(item)
        return out

    def _verified(self, segment: int, near: np.ndarray) -> bool:
        words, asked = self.parts[self.items[segment]]
        a, z = self.spans[segment]
        r, cut = self.rules, min(max(a, asked), z)

        def held(first: int, middle: int, last: int) -> bool:
            return _shares(words[first:middle], near) >= r.question and _shares(words[middle:last], near) >= r.answer

        return held(0, asked, len(words)) or len(words) > r.segment and held(a, cut, z)


def _terms(rules: Leaks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(shard, term, df, words) of the segments of each batch; df of a row without a term counts segments."""
        for batch in batches:
            for shard, text in zip(batch.column("shard").to_pylist(), utf8(batch), strict=True):
                words = word_hashes([text], marks=False)[0]
                if len(words) < rules.min_words:
                    continue
                cut = _cut(words, rules)
                terms, n = np.unique(np.concatenate([np.unique(words[a:z]) for a, z in cut]), return_counts=True)
                columns = [[shard] * (len(terms) + 1), [*terms.view(np.int64).tolist(), None], [*n.tolist(), len(cut)], [0] * len(terms) + [len(words)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["shard", "term", "df", "words"])

    return run


def build_index(benchmark: DataFrame, rules: Leaks, id: str = "item_id", text: str = "text") -> list[str]:
    """Writes the index of the items and returns the paths of its shards.

    A row of a shard's group is an item or a term with its count over all items; a group holds about SHARD_BYTES of text.
    """
    items = benchmark.select(benchmark[id].alias("item"), F.coalesce(benchmark[text], F.lit("")).alias("text")).filter("item is not null and text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    items = written(items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("long")), "leak-items")
    found = items.mapInArrow(_terms(rules), "shard long, term long, df long, words long").groupBy("shard", "term").agg(
        F.sum("df").alias("df"), F.sum("words").alias("words"))
    found = written(found, "leak-terms")
    n, words = found.filter("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    terms = found.filter("term is not null")
    df = terms.groupBy("term").agg(F.sum("df").alias("df"))
    folder = fresh_path(benchmark.sparkSession, "leak-index")

    def build(key: tuple, rows: pa.Table, terms: pa.Table) -> pa.Table:
        known = dict(zip(terms.column("term").to_numpy().view(np.uint64).tolist(), terms.column("df").to_pylist(), strict=True))
        pairs = sorted(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True))
        data = pickle.dumps(Index.of(pairs, rules, Corpus(n, words, known)))
        return pa.table({"path": [write_once(folder, ".index", lambda out: out.write(data))], "items": pa.array([len(pairs)], pa.int64())})

    both = items.groupBy("shard").cogroup(terms.select("shard", "term").join(df, "term").groupBy("shard"))
    return sorted(r["path"] for r in written(both.applyInArrow(build, "path string, items long"), "leak-shards").filter("items > 0").collect())


_LOADED: OrderedDict = OrderedDict()


def _shard(path: str) -> Index:
    """A shard of the index; a Python worker keeps the last ones it used, KEPT bytes at most, or one."""
    if path not in _LOADED:
        size = file_size(path)
        while _LOADED and size + sum(n for n, _ in _LOADED.values()) > KEPT:
            _LOADED.popitem(last=False)
        _LOADED[path] = size, pickle.loads(read_range(path, 0, size))
    _LOADED.move_to_end(path)
    return _LOADED[path][1]


def _found(paths: list[str], texts: list) -> list[list]:
    """The items that each text holds, ascending. All texts of a batch are searched in one shard before the next is read."""
    out: list[set] = [set() for _ in texts]
    for path in paths:
        index = _shard(path)
        for start, stop in runs(texts):
            for own, more in zip(out[start:stop], index.all_hits(*word_hashes(texts[start:stop], marks=False)), strict=True):
                own.update(more)
    return [sorted(x) for x in out]


def leak_report(docs: DataFrame, benchmark: DataFrame, rules: Leaks = Leaks(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, contaminated, n_items and item_ids (the benchmark items found in it, ascending).

    Null and empty texts hold nothing. Benchmark rows without id or text are left out; an empty benchmark finds nothing.
    Repeated rows have the same result. Extra columns are dropped; an empty table gives no rows.
    """
    plain = only(docs, id, text).withColumnRenamed(id, "id").withColumnRenamed(text, "text")
    paths = build_index(benchmark, rules)
    item = benchmark.schema["item_id"].dataType

    def searched(batches: Iterator[pa.RecordBatch], kind=to_arrow_type(item)) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield extended(batch, ["id"], items=pa.array(_found(paths, utf8(batch)), pa.list_(kind)))

    df = plain.mapInArrow(searched, f"id {plain.schema['id'].dataType.simpleString()}, items array<{item.simpleString()}>")
    return df.select(F.col("id").alias(id), (F.size("items") > 0).alias("contaminated"),
                     F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"))


def leak_clean(docs: DataFrame, benchmark: DataFrame, rules: Leaks = Leaks(), text: str = "text") -> DataFrame:
    """The documents that hold no item, all their columns, in one pass without a shuffle: rows of batches are dropped, no
    value of them is touched."""
    paths = build_index(benchmark, rules)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in _found(paths, utf8(batch, text))], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)
