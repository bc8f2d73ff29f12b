"""Fill-in-middle: a text is cut at two unit boundaries, and its middle moves to the end.

Units are runs of ASCII letters and all other characters one by one. They are never listed. One Aho-Corasick automaton
reads the text with its characters folded to classes and reports the places where letters begin or end, and sentinels. In
the gap between two such events the count of units is arithmetic: one for letters, the gap's length for anything else. So
the place of the k-th unit is found by a binary search over events and a subtraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import chunks, extended
from .shared import only

#: Folded characters: anything else, letters, and from there on one for each character of the sentinels.
OTHER, LETTER = ord("0"), ord("1")


@dataclass(frozen=True)
class Fim:
    """Sentinels before prefix, suffix and middle; the seed of the draws; shares in percent (spm: of what is changed)."""

    before_prefix: str = "<P>"
    before_suffix: str = "<S>"
    before_middle: str = "<M>"
    seed: str = "1:"
    changed_percent: int = 90
    spm_percent: int = 20

    def __post_init__(self):
        starts, rest = {s[0] for s in self.sentinels}, {c for s in self.sentinels for c in s[1:]}
        if starts & rest or len(set(self.sentinels)) < 3:
            raise ValueError("sentinels must differ, and the first character of one may occur at no later place")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.before_prefix, self.before_suffix, self.before_middle


class Events:
    """The automaton of a Fim: positions where the class changes, and whether a sentinel occurs."""

    def __init__(self, fim: Fim):
        import ahocorasick

        marks = sorted(set("".join(fim.sentinels)))
        symbol = {c: chr(LETTER + 1 + i) for i, c in enumerate(marks)}
        self.fold = np.full(0x110000, OTHER, np.uint8)
        self.fold[[*range(65, 91), *range(97, 123)]] = LETTER
        self.letters = {chr(LETTER)} | {symbol[c] for c in marks if c.isascii() and c.isalpha()}
        others = {chr(OTHER)} | {symbol[c] for c in marks} - self.letters
        for c, s in symbol.items():
            self.fold[ord(c)] = ord(s)
        self.automaton = ahocorasick.Automaton()
        for a, b in [*product(self.letters, others), *product(others, self.letters)]:
            self.automaton.add_word(a + b, 0)
        for s in fim.sentinels:
            self.automaton.add_word("".join(symbol[c] for c in s), 1)
        self.automaton.make_automaton()

    def find(self, text: str) -> tuple[np.ndarray, bool, bool]:
        """(starts of letter runs and of gaps in turn, whether the first is a run, whether the text has a sentinel)."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        folded = self.fold[codes].tobytes().decode("latin-1")
        seen = np.fromiter((2 * end + kind for end, kind in self.automaton.iter(folded)), np.int64)
        changes = seen[seen % 2 == 0] // 2
        return np.concatenate([np.zeros(1, np.int64), changes]), folded[:1] in self.letters, len(changes) < len(seen)


class Units:
    """Rank lookup of a text's units from its events."""

    def __init__(self, starts: np.ndarray, letters_first: bool, chars: int):
        self.starts = starts
        sizes = np.diff(starts, append=chars)
        sizes[0 if letters_first else 1 :: 2] = 1
        self.ends = np.cumsum(sizes)
        self.n, self.chars = int(self.ends[-1]) if chars else 0, chars

    def place(self, k: int) -> int:
        """Code points in the first k units."""
        if k >= self.n:
            return self.chars
        i = int(np.searchsorted(self.ends, k, "right"))
        return int(self.starts[i]) + k - (int(self.ends[i - 1]) if i else 0)


@dataclass(frozen=True)
class Filled:
    n: int
    form: str
    output: str
    prefix_chars: int | None = None
    middle_chars: int | None = None


@dataclass(frozen=True)
class Filler:
    """Transforms texts one at a time; the automaton is built once in each task."""

    fim: Fim

    @cached_property
    def events(self) -> Events:
        return Events(self.fim)

    def fill(self, key: str, text: str) -> Filled:
        """key, the id in decimal, decides where the text is cut and which form it takes."""
        f = self.fim
        starts, letters_first, marked = self.events.find(text)
        units = Units(starts, letters_first, len(text))
        digest = hashlib.sha256((f.seed + key).encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if not text or marked or h3 % 100 >= f.changed_percent:
            return Filled(units.n, "plain", text)
        a, b = (units.place(k) for k in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
        prefix, middle, suffix = f.before_prefix + text[:a], f.before_middle + text[a:b], f.before_suffix + text[b:]
        if h4 % 100 < f.spm_percent:
            return Filled(units.n, "spm", suffix + prefix + middle, a, b - a)
        return Filled(units.n, "psm", prefix + suffix + middle, a, b - a)


_FIELDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def _filled(fim: Fim, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = Filler(fim)
        for batch, texts in chunks(batches):
            keys = batch.column("key").to_pylist()
            done = [filler.fill(k, (t or b"").decode("utf-8", "replace")) for k, t in zip(keys, texts)]
            yield extended(batch, keep, **{c: pa.array([getattr(d, c) for d in done], kind) for c, kind in _FIELDS.items()})

    return run


def fill_in_middle(docs: DataFrame, fim: Fim = Fim(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row: units, the form taken and the text in it.

    Null texts count as empty, which stay plain, as do texts that hold a sentinel. A null id draws like an empty one.
    Repeated rows are transformed each (alike), extra columns are dropped; an empty table gives no rows.
    """
    plain = docs.select(docs[id].alias("id"), F.coalesce(docs[id].cast("string"), F.lit("")).alias("key"), docs[text].alias("text"))
    kind = plain.schema["id"].dataType.simpleString()
    out = plain.mapInArrow(_filled(fim, ["id"]), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id)


def restored(output: Column, form: Column, fim: Fim = Fim()) -> Column:
    """The text that a form was made of. No sentinel can begin before its place, for the parts hold none."""

    def part(begin: str, *ends: str) -> Column:
        rest = F.substr(output, F.locate(begin, output) + len(begin))
        for e in ends:
            rest = F.when(F.locate(e, rest) > 0, F.substr(rest, F.lit(1), F.locate(e, rest) - 1)).otherwise(rest)
        return rest

    p, s, m = fim.sentinels
    return F.when(form == "plain", output).otherwise(F.concat(part(p, s, m), part(m), part(s, p, m)))


def fim_report(docs: DataFrame, fim: Fim = Fim(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """fill_in_middle with digests of the output and of the text rebuilt from output and form in place of the text."""
    filled = fill_in_middle(only(docs, id, text), fim, id, text)
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return filled.select(
        id, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"), fim)).alias("restored_sha256"),
    )
