"""Figures out of text and markup: pay ranges of ads, pay ratios, cells of HTML tables, links.

Tables and ranges need a parser: small Python helpers that Arrow batches call; Spark spreads the texts. All else is columns.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import count

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _doubles(*names: str) -> StructType:
    return StructType([StructField(n, DoubleType()) for n in names])


#: An amount: its digits, whether a currency stands by it, and a k for thousands.
_AMOUNT = regex.compile(r"(?<![\w.,])(?P<before>USD ?|\$ ?)?(?P<digits>\d[\d,]*(?:\.\d+)?) ?(?P<k>[kK]\b)?(?P<after> ?USD\b)?(?: ?/ ?(?:hr|hour|yr|year)\b)?")
_JOINS = regex.compile(r"\s*(?:-|–|—|to|and)\s*")
#: Words that tell the time an amount is paid for, by the factor that makes it a year's.
_TIMES = ((2080, regex.compile(r"\b(?:per|an) hour|\bhourly|/ ?(?:hr|hour)\b|\bhour\b", regex.I)), (1, regex.compile(r"\b(?:per|a) year|\bannual|\byearly|/ ?(?:yr|year)\b|\bsalary", regex.I)),
          (12, regex.compile(r"\b(?:per|a) month|\bmonthly|/ ?mo\b", regex.I)))
_LARGE = regex.compile(r"\s*(?:million|billion|mm|m|bn?)\b", regex.I)
#: What an hour's and a month's pay may be, and a year's.
BOUNDS = {2080: (7, 500), 12: (1500, 150_000), 1: (0, 3_000_000)}
LEAST_YEAR, MOST_YEAR, WIDEST = 15_000, 3_000_000, 4


def _said(text: str, last: bool = False) -> int | None:
    """The factor of the time that a text names first, or last."""
    found = [(m.start(), times) for times, words in _TIMES if (m := words.search(text))]
    return (max if last else min)(found)[1] if found else None


def first_range(text: str | None) -> dict | None:
    """The first range of two amounts that is a plausible yearly pay: two amounts joined by a dash or a word, one of them in
    dollars, in the time that is named in or behind them, or else before them."""
    text = text or ""
    tokens = list(_AMOUNT.finditer(text))
    for a, b in zip(tokens, tokens[1:]):
        if not _JOINS.fullmatch(text, a.end(), b.start()) or not any(t[g] for t in (a, b) for g in ("before", "after")):
            continue
        if _LARGE.match(text, b.end()):
            continue
        low, high = sorted(float(t["digits"].replace(",", "")) * (1000 if t["k"] else 1) for t in (a, b))
        times = _said(text[a.start() : b.end() + 40]) or _said(text[max(0, a.start() - 80) : a.start()], last=True)
        times = times or (2080 if high < 300 else 1 if high >= LEAST_YEAR else None)
        if times and BOUNDS[times][0] <= high <= BOUNDS[times][1]:
            low, high = low * times, high * times
            if low >= LEAST_YEAR and high <= MOST_YEAR and high <= low * WIDEST:
                return {"pay_min": float(round(low)), "pay_max": float(round(high))}
    return None


@F.pandas_udf(_doubles("pay_min", "pay_max"))
def pay_range(text: pd.Series) -> pd.DataFrame:
    """struct(pay_min, pay_max): the first plausible range of yearly pay in a text without markup, or nulls."""
    found = [first_range(t) or {"pay_min": None, "pay_max": None} for t in text]
    return pd.DataFrame(found, columns=["pay_min", "pay_max"]).astype("float64")


#: A number of a text about a pay ratio, with what stands beside it.
_NUMBER = regex.compile(r"(?<![\w.,])(?P<dollar>\$ ?)?(?P<digits>\d[\d,]*(?:\.\d+)?|one\b)(?: (?P<million>million)\b)?(?P<times> times\b)?", regex.I)
_AGAINST = regex.compile(r" ?(?:to|-to-|:) ?", regex.I)
#: How far around a mention numbers belong to it, before and behind; fixed values: what ratios and amounts may be.
_NEAR = (1500, 5000)
RATIOS, MEDIANS, LEAST_CHIEF = (2, 20_000), (1_000, 1_500_000), 50_000


def ratio_agrees(computed: float, stated: float) -> bool:
    """A stated ratio is rounded: one either way, or two percent."""
    return abs(computed - stated) <= max(1.0, 0.02 * stated)


def stated_ratio(text: str | None) -> dict | None:
    """median, ceo and ratio of a text about pay ratios: a stated ratio and two amounts that have it, the median nearest to
    that word. All mentions count; amounts are sorted, so each ratio and amount looks only at those that fit."""
    text = " ".join((text or "").split())
    spans: list[list[int]] = []
    for m in regex.finditer("pay ratio|median", text, flags=regex.I):
        if spans and m.start() - _NEAR[0] <= spans[-1][1]:
            spans[-1][1] = m.start() + _NEAR[1]
        else:
            spans.append([max(0, m.start() - _NEAR[0]), m.start() + _NEAR[1]])
    best = None
    for start, end in spans:
        numbers = [(m, 1.0 if m["digits"].lower() == "one" else float(m["digits"].rstrip(",").replace(",", "")) * (1e6 if m["million"] else 1)) for m in _NUMBER.finditer(text, start, end)]
        ratios = {v for m, v in numbers if m["times"] and not m["dollar"]}
        for (a, x), (b, y) in zip(numbers, numbers[1:]):
            if not a["dollar"] and not b["dollar"] and 1 in (x, y) and _AGAINST.fullmatch(text, a.end(), b.start()):
                ratios.add(max(x, y))
        ratios = {r for r in ratios if RATIOS[0] <= r <= RATIOS[1] and not 1900 <= r < 2100}
        paid = sorted((round(v), bool(m["dollar"]), m.start()) for m, v in numbers)
        words = [m.start() for m in regex.finditer("median", text, flags=regex.I, pos=start, endpos=end)] or [start]
        for ratio in ratios:
            slack = max(1.0, 0.02 * ratio)
            for low, dollar, where in paid:
                if not dollar or not MEDIANS[0] <= low <= MEDIANS[1]:
                    continue
                for high, marked, _ in paid[bisect_left(paid, (low * (ratio - slack),)) :]:
                    if high > low * (ratio + slack):
                        break
                    if high > low and high >= LEAST_CHIEF and (marked or high >= 1_000_000) and ratio_agrees(high / low, ratio):
                        found = min(abs(w - where) for w in words), where, low, high, ratio
                        best = min(best, found) if best else found
    return best and {"median": float(best[2]), "ceo": float(best[3]), "ratio": best[4]}


@F.pandas_udf(_doubles("median", "ceo", "ratio"))
def pay_ratio(text: pd.Series) -> pd.DataFrame:
    """struct(median, ceo, ratio) of a text about a pay ratio, nulls where no amounts have a stated ratio."""
    found = [stated_ratio(t) or {"median": None, "ceo": None, "ratio": None} for t in text]
    return pd.DataFrame(found, columns=["median", "ceo", "ratio"]).astype("float64")


class _Tables(HTMLParser):
    """Lays out the cells of every table of a page: a set holds the places that are taken, each cell goes to the first free
    one of its row, and takes as many columns and rows as it spans. Tables inside a cell belong to its text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[tuple[int, int, int, str]]] = []
        self.depth, self.row, self.free, self.taken, self.cells, self.open = 0, -1, 0, set(), [], None

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "table"
        if self.depth != 1:
            return
        if tag == "table":
            self.row, self.free, self.taken, self.cells = -1, 0, set(), []
        elif tag == "tr":
            self._close()
            self.row, self.free = self.row + 1, 0
        elif tag in ("td", "th") and self.row >= 0:
            self._close()
            given = dict(attrs)
            wide, tall = (self._span(given.get(a)) for a in ("colspan", "rowspan"))
            column = next(c for c in count(self.free) if (self.row, c) not in self.taken)
            self.taken |= {(self.row + r, column + c) for r in range(tall) for c in range(wide)}
            #: All columns before it are taken.
            self.free = column + wide
            self.open = (self.row, column, column + wide - 1, [])

    @staticmethod
    def _span(text: str | None) -> int:
        digits = "".join(c for c in text or "" if c.isdigit())
        return int(digits) if digits and 0 < int(digits) < 50 else 1

    def handle_endtag(self, tag):
        if self.depth == 1 and tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self.tables.append(self.cells)

    def handle_data(self, data):
        if self.open:
            self.open[3].append(data)

    def _close(self):
        if self.open:
            row, first, last, parts = self.open
            self.cells.append((row, first, last, " ".join(" ".join(parts).split())))
            self.open = None


def grids(page: str | None) -> list[list[tuple[int, int, int, str]]]:
    """(row, first column, last column, text) of the cells of each table of a page; rows without any text do not count."""
    parser = _Tables()
    parser.feed(page or "")
    parser.close()
    out = []
    for cells in parser.tables:
        rows = sorted({row for row, _, _, text in cells if text})
        place = {r: n for n, r in enumerate(rows)}
        out.append([(place[r], a, z, t) for r, a, z, t in cells if r in place])
    return out


#: So many cells leave Python at once.
CELLS = 20_000


def table_cells(pages: DataFrame, id: str, markup: str) -> DataFrame:
    """(id, n_table, row, first_column, last_column, text): every cell of every table of every page."""
    names = ("n_table", "row", "first_column", "last_column")

    def made(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        which, *numbers, texts = map(list, zip(*rows)) if rows else [[] for _ in range(6)]
        return pa.RecordBatch.from_arrays([ids.take(pa.array(which, pa.int64())), *[pa.array(n, pa.int64()) for n in numbers], pa.array(texts, pa.string())], names=["id", *names, "text"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, page in enumerate(batch.column("markup")):
                for k, table in enumerate(grids(page.as_py())):
                    for cell in table:
                        rows.append((i, k, *cell))
                        if len(rows) == CELLS:
                            yield made(batch.column("id"), rows)
                            rows = []
            yield made(batch.column("id"), rows)

    plain = pages.select(F.col(id).alias("id"), F.col(markup).alias("markup"))
    kind = plain.schema["id"].dataType.simpleString()
    return plain.mapInArrow(cells, f"id {kind}, {', '.join(f'{n} long' for n in names)}, text string")


def modal_columns(cells: DataFrame) -> DataFrame:
    """(id, n_table, columns): how many columns most rows of a table have, of equals the more."""
    rows = cells.groupBy("id", "n_table", "row").agg((F.max("last_column") + 1).alias("columns"))
    counts = rows.groupBy("id", "n_table", "columns").agg(F.count("*").alias("n"))
    return counts.groupBy("id", "n_table").agg(F.max_by("columns", F.struct("n", "columns")).alias("columns"))


def links(pages: DataFrame, id: str, markup: str) -> DataFrame:
    """(id, place, href, text): the links of each page in order."""
    pattern = r"(?is)<a\b[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(markup), F.lit(pattern), F.lit(1)).alias("href"), F.regexp_extract_all(F.col(markup), F.lit(pattern), F.lit(2)).alias("text"))
    df = pages.select(F.col(id).alias("id"), F.posexplode(pairs).alias("place", "l"))
    return df.select("id", F.col("place").cast("long").alias("place"), "l.href", F.trim(F.regexp_replace("l.text", r"<[^>]+>", " ")).alias("text"))


def link_score(href: Column, text: Column, scores: dict[str, int]) -> Column:
    """The sum of the scores of the words that a link's address or text holds."""
    both = F.lower(F.concat_ws(" ", text, href))
    total = F.lit(0)
    for word, score in scores.items():
        total = total + F.when(both.contains(word), score).otherwise(0)
    return total.cast("long")


# --- sentences and lines of filings -----------------------------------------------------------------------------------

_SHORT = r"\b(Mr|Mrs|Ms|Dr|Inc|Corp|Co|Ltd|Jr|Sr|St|No|\p{Lu})\."


def sentences(text: Column) -> Column:
    """The sentences of a text; a short form's point does not end one."""
    kept = F.regexp_replace(text, _SHORT, "$1\u0001")
    parts = F.split(kept, r"(?<=[.!?])\s+(?=\p{Lu})")
    return F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\u0001"), F.lit("."))))


#: A dollar amount: its digits and a word of scale.
MONEY = r"(?i)\$ ?(\d[\d,]*(?:\.\d+)?) ?(?:(million|billion|thousand|mm|bn|m|k)\b)?"
_SCALES = {"million": 1e6, "mm": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "thousand": 1e3, "k": 1e3}


def money(text: Column) -> Column:
    """The dollar amounts of a text in order; million, billion and k count."""
    pairs = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(MONEY), F.lit(i)).alias(n) for i, n in ((1, "n"), (2, "u"))])
    unit = F.create_map(*[F.lit(x) for p in _SCALES.items() for x in p])
    return F.transform(pairs, lambda p: F.replace(p["n"], F.lit(","), F.lit("")).cast("double") * F.coalesce(F.try_element_at(unit, F.lower(p["u"])), F.lit(1.0)))


def bonus_percent(text: Column) -> Column:
    """A target bonus in percent of salary, from 5 to 500; none for a range or a most."""
    found = F.regexp_extract(text, r"(?i)target[^.%]{0,80}?\b(\d{1,3}(?:\.\d+)?) ?%", 1).try_cast("double")
    open_ = text.rlike(r"(?i)\d ?% ?(?:-|–|to) ?\d{1,3}|up to \d{1,3} ?%|maximum of \d{1,3} ?%")
    return F.when(found.between(5, 500) & ~open_, found)


def is_total(amounts: Column, i: Column) -> Column:
    """Whether the two or more amounts behind the i-th add up to it, within a percent."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("met"))
    x = F.get(amounts, i)

    def step(a: Column, v: Column) -> Column:
        total = a["sum"] + v
        return F.struct(total.alias("sum"), (a["n"] + 1).alias("n"), (a["met"] | ((a["n"] > 0) & (F.abs(total - x) <= x * 0.01))).alias("met"))

    return F.aggregate(F.slice(amounts, i + 2, F.size(amounts)), start, step)["met"]


def without_totals(amounts: Column) -> Column:
    """An array of amounts without those that the two or more behind them add up to, within a percent."""
    return F.filter(amounts, lambda x, i: ~is_total(amounts, i))


def nearest_kind(clause: Column, at: Column, kinds: list[tuple[str, str]]) -> Column:
    """The kind whose word (pattern) is nearest to a place in a clause; of equally near ones the first."""
    found = [F.when(clause.rlike(p), F.struct(F.abs(F.regexp_instr(clause, F.lit(p)) - at).alias("far"), F.lit(n).alias("n"), F.lit(k).alias("kind"))) for n, (k, p) in enumerate(kinds)]
    return F.least(*found)["kind"]


def statement_unit(line: Column) -> Column:
    """struct(scale, currency) of a statement's header line; null without either."""
    low = F.lower(line)
    scale = F.when(low.rlike(r"\bbillions?\b|\bbn\b"), 1e9).when(low.rlike(r"\bmillions?\b|[$€£]m\b"), 1e6).when(low.rlike(r"\bthousands?\b|['’]000|\b000s?\b"), 1e3)
    #: Single units, said so, take the place of a scale stated before.
    scale = scale.when(low.rlike(r"\bin (?:whole )?(?:dollars|pounds|euros?|rupees)\b"), 1.0)
    currency = F.coalesce(F.nullif(F.regexp_extract(line, r"\b(AUD|NZD|USD|GBP|EUR|PKR|CAD)\b", 1), F.lit("")), F.when(low.rlike(r"a\$"), "AUD").when(low.rlike(r"nz\$"), "NZD")
                          .when(low.rlike(r"us\$"), "USD").when(line.contains("£"), "GBP").when(line.contains("€"), "EUR").when(low.rlike(r"\brs\b|rupees"), "PKR"))
    return F.when(scale.isNotNull() | currency.isNotNull(), F.struct(F.coalesce(scale, F.lit(1.0)).alias("scale"), currency.alias("currency")))


def column_years(line: Column) -> Column:
    """struct(year, newest_first) of a header with two adjacent years or more."""
    years = F.transform(F.regexp_extract_all(line, F.lit(r"\b((?:19|20)\d\d)\b"), F.lit(1)), lambda y: y.cast("int"))
    a, b = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    return F.when(F.abs(a - b) == 1, F.struct(F.greatest(a, b).alias("year"), (a > b).alias("newest_first")))


def labelled_row(line: Column) -> Column:
    """struct(label, amounts) of a statement's line: the text before the figures, without the number of a note; figures with
    brackets are negative, a dash is none at all."""
    digits = r"\(?-?\d{1,3}(?:[, ]\d{3})*(?:\.\d+)?\)?|[-–—](?=\s|$)"
    label = F.regexp_extract(line, r"^\s*(\D.*?)(?:\s+\d{1,2}(?:\.\d)?)?\s+(?=[(\d–—-])", 1)
    rest = F.substr(line, F.length(F.regexp_extract(line, r"^\s*\D.*?(?:\s+\d{1,2}(?:\.\d)?(?=\s+[(\d–—-]))?\s+(?=[(\d–—-])", 0)) + 1)
    found = F.regexp_extract_all(rest, F.lit(f"({digits})"), F.lit(1))
    number = lambda t: F.regexp_replace(t, r"[(), ]", "").try_cast("double") * F.when(t.startswith("("), -1).otherwise(1)
    return F.when(label != "", F.struct(F.trim(label).alias("label"), F.transform(found, number).alias("amounts")))


def table_rows(cells: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(id, n_table, row, a column for each of columns): the rows of tables that have a first row with these headers (text in
    small letters), whatever their order."""
    heads = {name: F.max(F.when((F.col("row") == 0) & (F.lower("text") == head), F.col("first_column"))).alias(f"__{name}") for name, head in columns.items()}
    own = cells.groupBy("id", "n_table").agg(*heads.values())
    for name in columns:
        own = own.filter(F.col(f"__{name}").isNotNull())
    met = cells.filter("row > 0").join(own, ["id", "n_table"])
    picked = [F.max(F.when(F.col(f"__{name}").between(F.col("first_column"), F.col("last_column")), F.col("text"))).alias(name) for name in columns]
    return met.groupBy("id", "n_table", "row").agg(*picked)
