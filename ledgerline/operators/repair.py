"""Repair of filed figures: periods in the wrong unit, and pay rows with broken names, wrong owners or two ids for a person.

Both work company by company, since each correction is judged by figures that may have been corrected before it. A company
has a few dozen rows; Spark brings them together and sorts them, and a task holds one batch of rows and one company's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import names

#: How far from a thousand a ratio may be to count as a slip of the unit, and the sizes that rules begin at.
LEAST, MOST = 600, 1700
ORDINARY_REVENUE, LARGE_QUARTER = 10_000_000, 100_000_000
THOUSAND = Decimal(1000)


def _company_by_company(rows: DataFrame, order: list[str], repaired: Callable[[list[dict]], list[dict]], out: pa.Schema, ddl: str) -> DataFrame:
    """What repaired makes of each company's rows, in order. Many companies go to Python in one batch; one that goes on in the next
    batch waits for it."""

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in given:
            companies = [list(g) for _, g in groupby(held + batch.to_pylist(), lambda r: r["company_id"])]
            held = companies.pop() if companies else []
            yield pa.RecordBatch.from_pylist([r for c in companies for r in repaired(c)], schema=out)
        yield pa.RecordBatch.from_pylist(repaired(held) if held else [], schema=out)

    return rows.repartition("company_id").sortWithinPartitions("company_id", *order).mapInArrow(batches, ddl)


def _sizes(a: Decimal, b: Decimal, factor: int) -> bool:
    """Whether two figures are within a factor of each other, whatever their signs."""
    return a != 0 and b != 0 and abs(b) < abs(a) * factor and abs(a) < abs(b) * factor


def _slip(value: Decimal, by: Decimal) -> Decimal:
    """What a value must be multiplied by for its unit to be that of another figure: 1, 1000 or a thousandth."""
    ratio = abs(value / by)
    return 1 / THOUSAND if LEAST < ratio < MOST else THOUSAND if LEAST < 1 / ratio < MOST else Decimal(1)


class History:
    """The years of one company: figures as they now are, as they were filed, and the first three quarters of each year."""

    MEASURES = ("revenue", "net_income")

    def __init__(self, rows: list[dict]):
        self.now = {r["fiscal_year"]: {m: r[m] for m in self.MEASURES} for r in rows if r["period_type"] == "Annual"}
        self.filed = {y: dict(v) for y, v in self.now.items()}
        self.years = sorted(self.now)
        self.quarters: dict = defaultdict(dict)
        for r in rows:
            if r["period_type"] == "Quarterly":
                self.quarters[r["fiscal_year"]][r["fiscal_quarter"]] = {m: r[m] for m in self.MEASURES}
        self.mended: set = set()
        #: No repair changes these.
        self.firsts = {(y, m): [qs[q][m] for q in (1, 2, 3) if q in qs] for y, qs in self.quarters.items() for m in self.MEASURES}

    def first(self, year: int, measure: str) -> list[Decimal]:
        return self.firsts.get((year, measure), [])

    def outlook(self, year: int, measure: str) -> Decimal | None:
        """The year that its first quarters point to, if there are two of one sign at least."""
        some = self.first(year, measure)
        one_way = all(x > 0 for x in some) or all(x < 0 for x in some)
        return sum(some) / len(some) * 4 if len(some) > 1 and one_way else None

    def around(self, year: int, measure: str) -> list[Decimal]:
        """The figures of the years before and after, if both are there."""
        return [self.now[y][measure] for y in (year - 1, year + 1) if y in self.now] if {year - 1, year + 1} <= self.now.keys() else []

    def beside(self, year: int) -> list[dict]:
        return [self.now[y] for y in (year - 1, year + 1) if y in self.now]

    def confirmed(self, year: int) -> bool:
        """Whether a year beside it has a profit of this size that its own revenue can bear."""
        own = self.now[year]["net_income"]
        return any(_sizes(own, b["net_income"], 10) and abs(b["net_income"]) <= 30 * abs(b["revenue"]) for b in self.beside(year))

    def scaled(self, year: int, measure: str, other_agrees: bool) -> Decimal:
        """A figure in the unit of its quarters, where these can be trusted, else in that of both years around it."""
        value, outlook = self.now[year][measure], self.outlook(year, measure)
        if not value:
            return value
        if other_agrees and outlook:
            return value * _slip(value, outlook)
        around = self.around(year, measure)
        if around and all(x * value > 0 for x in around):
            slips = {_slip(value, x) for x in around}
            return value * slips.pop() if len(slips) == 1 else value
        return value

    def agrees(self, value: Decimal, year: int, measure: str, factor: int) -> bool:
        outlook = self.outlook(year, measure)
        return outlook is not None and outlook * value > 0 and _sizes(value, outlook, factor)

    def mend_year(self, year: int) -> None:
        own = self.now[year]
        revenue = self.scaled(year, "revenue", self.agrees(own["net_income"], year, "net_income", 10))
        trusts_quarters = self.agrees(revenue, year, "revenue", 2)
        net = self.scaled(year, "net_income", trusts_quarters)
        judged_by_quarters = trusts_quarters and bool(self.outlook(year, "net_income"))
        if net == own["net_income"] and not judged_by_quarters and revenue >= ORDINARY_REVENUE and not self.confirmed(year):
            if 100 * revenue < abs(net) < 10 * THOUSAND * revenue:
                net /= THOUSAND
        if net == own["net_income"]:
            around = self.around(year, "net_income")
            moved = own["net_income"] * revenue / own["revenue"] if own["revenue"] else own["net_income"]
            if revenue != own["revenue"] and around and all(_sizes(moved, x, 10) for x in around):
                net = moved
            elif self.in_thousands(year, revenue):
                net /= THOUSAND
        if net != own["net_income"]:
            net = self.signed(year, net, revenue)
        self.now[year] = {"revenue": revenue, "net_income": net}

    def in_thousands(self, year: int, revenue: Decimal) -> bool:
        """Whether a profit of over ten times its revenue would, as a thousandth, be like that of an ordinary year beside it."""
        net = self.now[year]["net_income"]
        if revenue < ORDINARY_REVENUE or not 10 * revenue < abs(net) <= 10 * THOUSAND * revenue or self.confirmed(year):
            return False
        factor = 10 if net > 0 else 2
        return any(abs(b["net_income"]) <= 10 * abs(b["revenue"]) and _sizes(net / THOUSAND, b["net_income"], factor) for b in self.beside(year))

    def signed(self, year: int, net: Decimal, revenue: Decimal) -> Decimal:
        """net as filed, unless only the other sign leaves the fourth quarter a result that its revenue can bear."""
        revenues, nets = self.first(year, "revenue"), self.first(year, "net_income")
        left = revenue - sum(revenues)
        if len(revenues) != 3 or left <= 0:
            return net
        return -net if abs(net - sum(nets)) > left * 3 / 2 and abs(-net - sum(nets)) <= left else net

    def mend_between(self) -> None:
        """Profits between two years whose profits were both a thousand times too big, where a thousandth is in line with both."""
        for year in self.years:
            net, ends = self.now[year]["net_income"], self.around(year, "net_income")
            if not ends or net != self.filed[year]["net_income"] or abs(net) <= 10 * abs(self.now[year]["revenue"]):
                continue
            both = all(self.now[y]["net_income"] * THOUSAND == self.filed[y]["net_income"] for y in (year - 1, year + 1))
            if both and all(_sizes(net / THOUSAND, x, 10) for x in ends):
                self.now[year]["net_income"] = net / THOUSAND

    def mend_ends(self) -> None:
        """Years at the end of the history that are all off by a thousand or a million from the year that they lead up to."""
        for step in (-1, 1):
            for year in self.years[::step]:
                factor = self.end_slip(year, step)
                if factor:
                    self.now[year] = {m: v * factor for m, v in self.now[year].items()}
                    self.mended.add(year)

    def end_slip(self, year: int, step: int) -> Decimal | None:
        anchor, further = year - step, year - 2 * step
        if year in self.mended or anchor not in self.now or min(self.now[year]["revenue"], self.now[anchor]["revenue"]) <= 0:
            return None
        own, good = self.now[year], self.now[anchor]
        if anchor not in self.mended and not (further in self.now and _sizes(self.now[further]["revenue"], good["revenue"], 3)):
            return None
        for factor in (THOUSAND, THOUSAND**2, 1 / THOUSAND, 1 / THOUSAND**2):
            if Decimal("0.6") < good["revenue"] / (own["revenue"] * factor) < Decimal("1.7"):
                if own["net_income"] and not _sizes(own["net_income"] * factor, good["net_income"], 10):
                    return None
                beyond = [y for y in self.years if (y - year) * step > 0]
                return factor if all(_sizes(self.now[y]["revenue"], own["revenue"], 10) for y in beyond) else None
        return None

    def mend_fourth(self, year: int) -> None:
        """The last quarter: follows its corrected year where it was that year less the others; if it is out of line with
        them, it is worked out again or goes."""
        own = self.quarters[year]
        if year not in self.now or not {1, 2, 3, 4} <= own.keys():
            return
        fourth, rest = dict(own[4]), {m: sum(self.first(year, m)) for m in self.MEASURES}
        worked = {m: self.now[year][m] - rest[m] for m in self.MEASURES}

        def follows(m: str) -> bool:
            return self.now[year][m] != self.filed[year][m] and abs(fourth[m] - (self.filed[year][m] - rest[m])) <= 1

        middle = sorted(self.first(year, "revenue"))[1]
        if not follows("revenue") and middle >= LARGE_QUARTER and 0 < fourth["revenue"] < middle / 100:
            if middle / 5 < worked["revenue"] < middle * 5:
                own[4] = worked
            else:
                del own[4]
            return
        own[4] = {m: worked[m] if follows(m) else fourth[m] for m in self.MEASURES}

    def repaired(self) -> None:
        for year in self.years:
            self.mend_year(year)
        self.mend_between()
        self.mend_ends()
        for year in list(self.quarters):
            self.mend_fourth(year)


PERIOD = "company_id long, period_type string, fiscal_year long, fiscal_quarter long, revenue decimal(28,4), net_income decimal(28,4)"


def repair_financials(periods: DataFrame) -> DataFrame:
    """periods with figures in one unit for each company; fourth quarters follow their corrected years.

    A figure changes only where its own quarters, or both years around it, put it a thousand times off; years at an end of
    the history by the year they lead up to. One year and one quarter of a company must be there once at most.
    """
    kinds = pa.schema([("company_id", pa.int64()), ("period_type", pa.string()), ("fiscal_year", pa.int64()), ("fiscal_quarter", pa.int64()),
                       ("revenue", pa.decimal128(28, 4)), ("net_income", pa.decimal128(28, 4))])

    exact = Decimal("0.0001")

    def company(rows: list[dict]) -> list[dict]:
        history = History(rows)
        history.repaired()
        id = rows[0]["company_id"]
        out = [{"company_id": id, "period_type": "Annual", "fiscal_year": y, "fiscal_quarter": None, **v} for y, v in history.now.items()]
        out += [{"company_id": id, "period_type": "Quarterly", "fiscal_year": y, "fiscal_quarter": q, **v} for y, qs in history.quarters.items() for q, v in qs.items()]
        for r in out:
            r.update({m: r[m].quantize(exact) for m in History.MEASURES})
        return out

    plain = periods.select("company_id", "period_type", "fiscal_year", "fiscal_quarter", *[F.col(m).cast("decimal(28,4)").alias(m) for m in History.MEASURES])
    return _company_by_company(plain, [], company, kinds, PERIOD)


PAY = ("company_id", "person_id", "name", "title", "year", "salary", "bonus", "stock", "other", "total", "filing")
AMOUNTS = ("salary", "bonus", "stock", "other", "total")


def _wrong_owners(rows: list[dict]) -> set[int]:
    """Places of rows whose title names another person with the same pay of the year, who is not named back."""
    out, same = set(), defaultdict(list)
    for i, r in enumerate(rows):
        if r["total"] > 0:
            same[(r["year"], *[r[a] for a in AMOUNTS])].append(i)
    for places in same.values():
        first = {rows[i]["person_id"]: i for i in reversed(places)}
        for i in first.values():
            for j in first.values():
                a, b = rows[i], rows[j]
                if i != j and names.titled(a["title"], b["name"]) and not names.titled(b["title"], a["name"]) and not names.same_person(a["name"], b["name"]):
                    out.add(i)
    return out


def _one_person(a: dict, b: dict, insider: dict) -> bool:
    """Whether two rows of one year are one person: the same name; one surname and every amount equal in two filings; or
    names alike and the same total. Two different insiders' numbers are two people."""
    numbers = {insider.get(a["person_id"]), insider.get(b["person_id"])} - {None, ""}
    if len(numbers) == 2:
        return False
    paid = a["total"] > 0 and a["total"] == b["total"]
    family = paid and all(a[x] == b[x] for x in AMOUNTS) and a["filing"] != b["filing"] and len(names.surname(a["name"])) >= 3 and names.surname(a["name"]) == names.surname(b["name"])
    return names.letters(a["name"]) == names.letters(b["name"]) or family or paid and names.same_person(a["name"], b["name"])


def _groups(rows: list[dict], insider: dict) -> list[list[str]]:
    """Ids that are one person, by links within years; a link through a third id counts."""
    label = {r["person_id"]: r["person_id"] for r in rows}
    by_year = defaultdict(dict)
    for r in rows:
        by_year[r["year"]].setdefault(r["person_id"], r)
    for people in by_year.values():
        some = list(people.values())
        for n, a in enumerate(some):
            for b in some[n + 1 :]:
                old, new = label[b["person_id"]], label[a["person_id"]]
                if old != new and _one_person(a, b, insider):
                    label = {k: new if v == old else v for k, v in label.items()}
    groups = defaultdict(list)
    for k, v in label.items():
        groups[v].append(k)
    return [g for g in groups.values() if len(g) > 1]


def _repaired_pay(rows: list[dict], insider: dict) -> list[dict]:
    for r in rows:
        r["name"], r["title"] = names.rejoined(r["name"] or "", r["title"] or "")
        r["name"] = names.clean_name(r["name"])
    rows = [r for r in rows if names.is_person(r["name"])]
    wrong = _wrong_owners(rows)
    rows = [r for i, r in enumerate(rows) if i not in wrong]
    own = defaultdict(list)
    for r in rows:
        own[r["person_id"]].append(r)
    for group in _groups(rows, insider):
        #: An insider's id is kept, else that with most rows, else that with the longest name.
        keep = max(group, key=lambda p: (bool(insider.get(p)), len(own[p]), len(own[p][0]["name"])))
        fullest = max((r["name"] for p in group for r in own[p]), key=lambda n: len(names.letters(n)))
        for p in group:
            for r in own[p]:
                r["person_id"], r["name"] = keep, fullest
    out: dict = {}
    for r in rows:
        r["title"] = names.clean_title(names.without_own_name(r["title"], r["name"]))
        slot = r["person_id"], r["year"]
        held = out.get(slot)
        if held is None or held["total"] == r["total"] and len(r["title"]) > len(held["title"]):
            out[slot] = r
    return list(out.values())


def repair_pay(pay: DataFrame, insiders: DataFrame) -> DataFrame:
    """pay with clean names and titles, one id for each person of a company and one row for a person and a year.

    pay: company_id, person_id (string), name, title, year, the amounts, filing, row (the order of rows); insiders:
    person_id and number. Rows that are no person go, and those that a name in the next cell gave to the wrong one.
    """
    numbers = insiders.filter("number is not null and number <> ''").groupBy("person_id").agg(F.min("number").alias("number"))
    joined = pay.join(numbers, "person_id", "left").select(*PAY, "row", "number")

    def company(rows: list[dict]) -> list[dict]:
        insider = {r["person_id"]: r["number"] for r in rows}
        return [{c: r[c] for c in PAY} for r in _repaired_pay(rows, insider)]

    out = joined.select(*PAY).schema
    return _company_by_company(joined, ["row"], company, to_arrow_schema(out), out)
