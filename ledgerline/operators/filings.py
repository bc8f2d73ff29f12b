"""Filings as tables: who was hired and for what, tables of pay, tags of pay versus performance.

A filing is cut into rows (sentences, cells, tags) and put together again by joins and windows within it, all of them by the
filing's id, so the rows of a filing are shuffled once and no task holds more than some filings. Python is used for the
layout of HTML tables and plain text only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import amount, plain_text
from ..sources.stored import stored
from .markup import MONEY, is_total, money, sentences, table_cells

# --- appointments and their packages -------------------------------------------------------------------------------------

_WORD = r"\p{Lu}[\p{L}'’-]+"
#: A person: two to five words, honours before and after it.
PERSON = rf"(?:(?:Dr|Mr|Ms|Mrs)\. )?({_WORD}(?: (?:\p{{Lu}}\.|de|van|von|der|da|del|{_WORD})){{0,3}} {_WORD}(?:,? (?:Jr|Sr|II|III|IV)\b\.?)?)"
_HONOUR = rf"\b(?:Dr|Mr|Ms|Mrs)\. ({_WORD})"
#: Words that appoint, and those that lead from a person to an office.
_APPOINTS = r"(?i)\b(?:appoint(?:s|ed|ment)?|name[sd]|elect(?:s|ed)?|promot(?:es|ed)|hire[sd]|engage[sd]|join|serve|become)\b"
_LEADS = r"\b(?:as|to be|become|to the (?:position|role|office)s? of)\s+(?:(?:the Company[’']s|the|its|our)\s+)?(?:(?:new|next|incoming)\s+)?"
_OFFICE_ENDS = (r"[.,;(\"]|\s(?:effective|as of|in addition|of the Company|with|commencing|beginning|starting|following|upon|until|replacing|succeeding|to succeed"
                r"|on \p{Lu}|and (?:a|an|as|the|his|her|will|has|to|entered|member|director))\b")  # fmt: skip
_OFFICE = r"(?i)\bchief [\p{L}&, ]{2,40}?officer\b|\bC[EFOTI]O\b|(?<!vice )\bpresident\b|\b(?:executive|senior) vice president\b|general counsel|\btreasurer\b|\bcontroller\b"
_FOR_NOW = r"(?i)\b(?:interim|acting|temporary)\b"
_NO_PERSON = "The Company Board Directors Director Chief Officer President Committee Executive Vice Senior Our Its His Her Effective On In As Item Agreement Plan Mr Ms".split()
#: Whose terms a sentence must not be: those of the board.
_BOARD_PAY = r"(?i)non-employee director|each director|director compensation|\bretainer\b|board fees"
_STARTS = r"\b(?i:effective|commencing|beginning|starting)(?: as of| on)? ((?:January|February|March|April|May|June|July|August|September|October|November|December) \d{1,2}, \d{4})"

#: The kinds of pay by their words; where two stand equally near, the first counts.
KINDS = (
    ("performance stock", r"performance[- ](?:based |vesting )?(?:restricted )?(?:stock|share)|\bPR?SUs?\b"),
    ("options", r"stock options?|options? to purchase|option (?:award|grant)"),
    ("stock", r"restricted stock|\bRSUs?\b|(?:equity|stock|inducement) (?:award|grant)|long[- ]term incentive|grant[- ]date (?:fair )?value"),
    ("sign-on", r"(?:sign[- ]?on|signing|one[- ]time|make[- ]whole|buy[- ]?out|hiring)(?: (?:cash|bonus|payment|award))*"),
    ("relocation", r"relocation(?: (?:bonus|allowance|payment))?|(?:transition|housing|commuting|living) (?:allowance|payment)"),
    ("salary", r"salary"),
    ("bonus", r"\bbonus"),
)
_CAPPED = r"(?i)\b(?:up to|maximum(?: of)?|not to exceed|capped at|no more than|as much as|in excess of)(?: an?)?(?: aggregate)?(?: amount)?(?: of)?\s*$"
_REPEATED_AFTER = r"(?i)^\s*(?:(?:per|a|each|an) (?:month|hour|week|day|share|meeting)\b|(?:in )?monthly\b)"
_REPEATED_BEFORE = r"(?i)\b(?:monthly|weekly|hourly)\b"
_LEAVING = r"(?i)terminat|severance|change (?:in|of) control|good reason|without cause|separation|disability|repay|forfeit|resign|retire"
_NO_PAY = r"(?i)exercise price|per share|price of|director fee|legal fees|attorney|reimburs|stock price|market value|revenue|EBITDA|loan|consideration"
#: What is an amount of a package, what a year's salary may be, and how much more than it anything else.
LEAST, MOST, LEAST_SALARY, TIMES_SALARY = 10_000, 200_000_000, 50_000, 50


def item_section(markup: Column, item: str) -> Column:
    """The text of an item of a filing, without its number, up to the next item or the signatures; null without it."""
    parts = F.split(plain_text(markup), r"(?i)\bitem\s*(?=\d\.\d\d\b)")
    found = F.get(F.filter(parts, lambda p: p.startswith(item)), F.lit(0))
    return F.get(F.split(F.substr(found, F.lit(len(item) + 1)), r"\bSIGNATURES?\b"), F.lit(0))


def surname(name: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(name, r",? (?:Jr|Sr|II|III|IV)\b\.?$", ""), " "), -1)


def appointments(lines: DataFrame) -> DataFrame:
    """(id, surname, name, title): the officers that the sentences (id, n, s) appoint, each by the first that does.

    An office follows a word that leads to it; the person is the last one named before that word, and an appointing word
    stands in what comes before. Those for the time being are none.
    """
    parts = F.split("s", _LEADS)
    links = lines.filter(F.col("s").rlike(_APPOINTS)).select("id", "n", F.posexplode(F.transform(parts, lambda p, i: F.struct(
        F.array_join(F.slice(parts, 1, i + 1), " as ").alias("left"), F.get(parts, i + 1).alias("right")))).alias("i", "l"))
    named = F.regexp_extract("l.left", rf"^.*(?:^|[\s,(]){PERSON}", 1)
    title = F.trim(F.get(F.split("l.right", _OFFICE_ENDS), F.lit(0)))
    found = links.select("id", "n", "i", named.alias("name"), title.alias("title"), F.col("l.left").alias("left"))
    clean = F.col("title").rlike(_OFFICE) & ~F.col("title").rlike(_FOR_NOW) & F.length("title").between(3, 90) & F.col("left").rlike(_APPOINTS)
    clean = clean & (F.col("name") != "") & ~F.arrays_overlap(F.split("name", "[ ,.]+"), F.lit(_NO_PERSON))
    return found.filter(clean).withColumn("surname", surname(F.col("name"))).groupBy("id", "surname").agg(
        F.min_by(F.struct("name", "title"), F.struct("n", "i")).alias("first")).select("id", "surname", "first.*")


def in_focus(lines: DataFrame, hires: DataFrame) -> DataFrame:
    """lines (id, n, s) with surname: whose terms a sentence states, if that is one of hires.

    People are the hires and all that the filing calls Mr., Ms. and so on. A sentence is about the one it names, or about
    the one hire among several; of two hires, about none. One that names nobody ("he", "her") goes on about the one before;
    the pay of the board is nobody's.
    """
    people = hires.select("id", "surname", F.lit(True).alias("hired")).unionByName(
        lines.select("id", F.explode(F.regexp_extract_all("s", F.lit(_HONOUR), F.lit(1))).alias("surname"), F.lit(False).alias("hired")))
    #: A filing's people meet its sentences as one row: the words of sentences never leave them.
    people = people.groupBy("id").agg(F.collect_set("surname").alias("people"), F.collect_set(F.when(F.col("hired"), F.col("surname"))).alias("hires"))
    words = F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(r"[\p{L}'’-]+"), F.lit(0)), lambda w: F.regexp_replace(w, "['’]s$", "")))
    met = lambda names: F.array_intersect(words, F.coalesce(names, F.array().cast("array<string>")))
    df = lines.join(people, "id", "left").withColumn("named", F.size(met("people"))).withColumn("hires", met("hires"))
    df = df.withColumn("n_hired", F.size("hires")).withColumn("hire", F.array_max("hires"))
    about = F.when((F.col("n_hired") == 1), F.col("hire"))
    said = F.when(F.col("s").rlike(_BOARD_PAY), F.struct(F.lit(None).cast("string").alias("who"))).when(F.col("named") > 0, F.struct(about.alias("who")))
    last = F.last(said, ignorenulls=True).over(Window.partitionBy("id").orderBy("n"))
    return df.select("id", "n", "s", *[c for c in lines.columns if c not in ("id", "n", "s")], last["who"].alias("surname"))


def _kind(before: Column, after: Column) -> Column:
    """The kind of pay whose words are nearest to an amount: in its clause before it, or behind it before the clause goes on."""
    near = F.get(F.split(after, r"[;(,]|\b(?:and|with|plus|or)\b"), F.lit(0))
    found = []
    for order, (kind, words) in enumerate(KINDS):
        ends = F.length(F.regexp_extract(before, rf"(?is)^.*(?:{words})", 0))
        starts = F.regexp_instr(near, F.lit(f"(?i){words}"))
        for far, held in ((F.length(before) - ends, ends > 0), (starts - 1, starts.between(1, 40))):
            found.append(F.when(held, F.struct(far.alias("far"), F.lit(order).alias("order"), F.lit(kind).alias("kind"))))
    return F.least(*found)["kind"]


def pay_items(sentence: Column, filed_year: Column) -> Column:
    """array of structs (kind, amount, target): the amounts of a sentence that are a package's, by the words beside them.

    No caps ("up to"), nothing paid by the month or the share, nothing for leaving, no target of each year or of a later
    year than filed_year, no totals that the amounts behind them add up to.
    """
    gaps = F.split(F.regexp_replace(sentence, MONEY, "\u0001"), "\u0001")
    items = F.transform(money(sentence), lambda v, i: F.struct(
        v.alias("amount"), F.right(F.array_join(F.slice(gaps, 1, i + 1), "$"), F.lit(160)).alias("lead"), F.left(F.get(gaps, i + 1), F.lit(70)).alias("after")))
    items = F.transform(items, lambda x: F.struct(
        x["amount"].alias("amount"), F.regexp_replace(x["lead"], r"(?s)^.*(?:;|\(\s*(?:[ivx]{1,4}|[a-z]|\d)\s*\))", "").alias("before"), x["after"].alias("after")))

    def counts(x: Column) -> Column:
        b, a = x["before"], x["after"]
        later = F.exists(F.regexp_extract_all(b, F.lit(r"\b20\d\d\b"), F.lit(0)), lambda y: y.cast("int") > filed_year)
        target = b.rlike(r"(?i)\btarget") & (b.rlike(r"(?i)\bannual(?:ly)?\b|each (?:fiscal )?year") | F.coalesce(later, F.lit(False)))
        leaving = F.right(b, F.lit(70)).rlike(_LEAVING) | F.left(a, F.lit(45)).rlike(_LEAVING)
        other = F.right(b, F.lit(45)).rlike(_NO_PAY) | F.left(a, F.lit(25)).rlike(_NO_PAY)
        repeated = a.rlike(_REPEATED_AFTER) | F.right(b, F.lit(40)).rlike(_REPEATED_BEFORE)
        return (x["amount"] >= LEAST) & ~b.rlike(_CAPPED) & ~repeated & ~leaving & ~other & ~target

    kept = F.transform(F.filter(items, counts), lambda x: F.struct(
        _kind(x["before"], x["after"]).alias("kind"), x["amount"].alias("amount"), F.right(x["before"], F.lit(60)).rlike(r"(?i)\btarget").alias("target")))
    kept = F.filter(kept, lambda x: x["kind"].isNotNull())
    #: Amounts are read once for a sentence, not once more for each of them.
    once = F.transform(F.array(kept), lambda k: F.filter(k, lambda x, i: ~is_total(F.transform(k, lambda y: y["amount"]), i)))
    return F.get(once, F.lit(0))


def bonus_share(sentence: Column) -> Column:
    """A target bonus in percent of salary, from 5 to 500: no most, no range, no equity."""
    pattern = r"(?i)(?:bonus|incentive)[^.;]{0,140}?\b(\d{1,3}(?:\.\d{1,2})?) ?% of (?:(?:his|her|their|the executive['’]s|annual(?:ized)?|base) ){0,3}salary"
    found = F.regexp_extract(sentence, pattern, 1).try_cast("double")
    stated = F.regexp_extract(sentence, r"(?is)^.{0,120}?" + pattern[4:], 0)
    bad = stated.rlike(r"(?i)\bup to\b|\bmaximum\b|\bbetween\b|\d ?% ?(?:to|and|-|–) ?\d{1,3} ?%|long[- ]term|equity|restricted stock|\bR?P?SUs?\b")
    return F.when(stated.rlike(r"(?i)\btarget") & ~bad & found.between(5, 500), found)


def new_hires(filings: DataFrame, id: str = "id", markup: str = "html", filed: str = "filed") -> DataFrame:
    """(id, name, title, starts_on, parts, total): each officer whom a filing's item 5.02 appoints with a package.

    parts are structs (kind, amount, note) in order of the text: one salary, other amounts once for each kind. A target
    bonus that is a share of the salary counts as that amount if no bonus is stated. Amounts beyond 200 million or 50
    salaries, and salaries under 50,000, are misread and go. filed (date, may be null) tells later years. Null and empty
    texts, those without the item, and those without a package give no row; rows with one id are read as one filing each
    only if ids differ, so ids must be unique; extra columns are ignored.
    """
    given = filings.select(filings[id].alias("id"), filings[markup].alias("markup"), F.year(filings[filed]).alias("year"))
    given = given.filter(F.col("markup").rlike(r"(?i)item(?:\s|&nbsp;|<[^>]*>)*5\.02"))
    lines = given.select("id", "year", F.posexplode(sentences(item_section(F.col("markup"), "5.02"))).alias("n", "s")).filter("s <> ''")
    #: A sentence that opens with a later year is about that year's awards, unless they are granted now.
    opens = F.regexp_extract("s", r"^\W{0,3}(?i:in|for|beginning in|starting in) (?:fiscal )?(20\d\d)\b", 1).try_cast("int")
    later = (opens > F.col("year")) & F.col("s").rlike(r"(?i)\bannual") & ~F.exists(
        F.regexp_extract_all("s", F.lit(r"(?i)granted (?:in|on|during) (?:\p{L}+ ){0,4}(20\d\d)"), F.lit(1)), lambda y: y.cast("int") <= F.col("year"))
    items = F.when(~F.coalesce(later, F.lit(False)) & F.col("s").contains("$"), pay_items(F.col("s"), F.col("year")))
    begins = F.try_to_timestamp(F.nullif(F.regexp_extract("s", _STARTS, 1), F.lit("")), F.lit("MMMM d, yyyy")).cast("date")
    #: Sentences are read where they are cut; behind that only those that say something of a hire's terms go on.
    lines = stored(lines.select("id", "n", "s", items.alias("items"), begins.alias("begins"), bonus_share(F.col("s")).alias("share")))
    hires = stored(appointments(lines.select("id", "n", "s")))
    hired = lines.join(hires.select("id").distinct(), "id", "left_semi")
    says = (F.size(F.coalesce("items", F.array().cast(lines.schema["items"].dataType))) > 0) | F.col("begins").isNotNull() | F.col("share").isNotNull()
    read = stored(in_focus(hired, hires).filter(F.col("surname").isNotNull() & says).drop("s"))
    rows = read.select("id", "surname", "n", F.posexplode("items").alias("i", "x")).select("id", "surname", "n", "i", "x.*")
    once = Window.partitionBy("id", "surname", "kind", F.when(F.col("kind") != "salary", F.col("amount"))).orderBy("n", "i")
    rows = rows.withColumn("nth", F.row_number().over(once)).filter("nth = 1")
    parts = rows.groupBy("id", "surname").agg(F.array_sort(F.collect_list(F.struct(
        "n", "i", "kind", "amount", F.when(F.col("target") & (F.col("kind") != "salary"), "target").otherwise("").alias("note")))).alias("parts"))
    when = read.groupBy("id", "surname").agg(F.min_by("begins", F.when(F.col("begins").isNotNull(), F.col("n"))).alias("starts_on"),
                                             F.min_by("share", F.when(F.col("share").isNotNull(), F.col("n"))).alias("share"))
    df = hires.join(when, ["id", "surname"]).join(parts, ["id", "surname"])
    part = lambda kind, sum, note: F.struct(kind.alias("kind"), sum.cast("double").alias("amount"), note.alias("note"))
    plain = F.transform("parts", lambda p: part(p["kind"], p["amount"], p["note"]))
    df = df.withColumn("salary", F.get(F.filter("parts", lambda p: p["kind"] == "salary"), F.lit(0))["amount"])
    add = F.col("salary").isNotNull() & F.col("share").isNotNull() & ~F.exists("parts", lambda p: p["kind"] == "bonus")
    bonus = part(F.lit("bonus"), F.round(F.col("salary") * F.col("share") / 100), F.concat(F.regexp_replace(F.col("share").cast("string"), r"\.0$", ""), F.lit("% of salary")))
    every = F.when(add, F.concat(plain, F.array(bonus))).otherwise(plain)
    salary = (F.col("salary") >= LEAST_SALARY) & F.col("salary").isNotNull()
    sane = F.filter(every, lambda p: (p["amount"] <= MOST) & ~((p["kind"] == "salary") & (p["amount"] < LEAST_SALARY)) & ~(
        salary & (p["kind"] != "salary") & (p["amount"] > F.col("salary") * TIMES_SALARY)))
    df = df.select("id", "name", "title", "starts_on", sane.alias("parts")).filter(F.size("parts") > 0)
    return df.withColumn("total", F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["amount"])).withColumnRenamed("id", id)


# --- tables of pay -------------------------------------------------------------------------------------------------------

#: The roles of a column of a table of pay by its header, the first that holds. (A stock column that has parts has a total.)
ROLES = (
    ("year", r"^(?:fiscal )?year\b|\byear$"),
    ("name", r"\bname\b|principal position"),
    ("total", r"^total"),
    ("incentive", r"non-? ?equity|incentive plan"),
    ("stock_total", r"(?:stock|equity award|\brsu|restricted).* total"),
    ("stock", r"stock|equity award|\brsu|restricted|\bpsu"),
    ("salary", r"salary"),
    ("total", r" total"),
    ("options", r"option"),
    ("bonus", r"bonus"),
    ("pension", r"pension|deferred"),
    ("other", r"other"),
)
_HEADER = r"(?i)salary|bonus|stock|option|total|\byear\b|name|position|\( ?\$ ?\)|compensation"
_YEAR = r"(?i)^(?:FY ?|fiscal (?:year )?)?((?:19|20)\d\d)(?: ?\( ?\d{1,2} ?\))* ?\*?$"
#: What ends a name and begins a title.
_TITLE_WORD = r"(?i)\b(?:co-)?(?:chief|president|officer|vice|executive|former|chairman|chair|ceo|cfo|coo|cto|general counsel|secretary|treasurer|director|senior|evp|svp|interim|founder|head|managing|principal)\b"
#: A mark of a note: in brackets, a star, or a small number behind a name or an amount.
_NOTE = r"\( ?(?:\d{1,2}|[a-z]{1,2}) ?\)|\*|(?<=\d,\d{3}) \d{1,2}$|(?<=[a-z.]) \d{1,2}(?= \p{Lu}|$)"
AMOUNTS = ("salary", "bonus", "stock", "options", "incentive", "pension", "other", "total")


def _cell_amount(text: Column) -> Column:
    """The amount of a cell without marks of notes; null for what is none, or only a mark."""
    bare = F.trim(F.regexp_replace(text, _NOTE, ""))
    return F.when(bare.rlike(r"\d|^\$? ?[-–—]+$"), amount(F.regexp_replace(bare, r"^\$? ?[-–—]+$", "-")))


def _columns(cells: DataFrame) -> DataFrame:
    """(id, n_table, role, nth, first, last, data_row): ranges of columns of the tables that are tables of pay, by header.

    Headers are the rows before the first that has a year and, behind it, an amount over a thousand, from its last row with a
    header's word on three up; the texts over a column are one text, and neighbours with one text are one range.
    """
    year = F.min(F.when(F.col("text").rlike(_YEAR), F.col("first_column"))).alias("at")
    years = cells.groupBy("id", "n_table", "row").agg(year, F.max(F.when(_cell_amount(F.col("text")) > 1000, F.col("first_column"))).alias("paid"))
    data = years.filter("at < paid").groupBy("id", "n_table").agg(F.min("row").alias("first_data"))
    heads = cells.join(data, ["id", "n_table"]).filter(F.col("row") < F.col("first_data"))
    worded = heads.filter(F.col("text").rlike(_HEADER)).select("id", "n_table", "row").distinct()
    own = Window.partitionBy("id", "n_table")
    worded = worded.withColumn("last_head", F.max("row").over(own)).filter(F.col("row") > F.col("last_head") - 4)
    over = heads.join(worded, ["id", "n_table", "row"]).filter("text <> ''").select(
        "id", "n_table", "last_head", "row", "first_column", "text", F.explode(F.sequence("first_column", "last_column")).alias("column"))
    text = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "first_column", "text"))), lambda x: x["text"])), " ")
    columns = over.groupBy("id", "n_table", "last_head", "column").agg(F.lower(F.trim(F.regexp_replace(text, _NOTE, ""))).alias("head"))
    ordered = Window.partitionBy("id", "n_table").orderBy("column")
    fresh = ~((F.lag("column").over(ordered) == F.col("column") - 1) & (F.lag("head").over(ordered) == F.col("head")))
    columns = columns.withColumn("range", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(ordered))
    role = F.coalesce(*[F.when(F.col("head").rlike(words), F.lit(r)) for r, words in ROLES])
    ranges = columns.groupBy("id", "n_table", "range").agg(
        F.min("column").alias("first"), F.max("column").alias("last"), F.first("head").alias("head"), F.first("last_head").alias("last_head"))
    ranges = ranges.withColumn("role", role).filter("role IS NOT NULL")
    held = F.collect_set("role").over(own)
    years_end = F.min(F.when(F.col("role") == "year", F.col("last"))).over(own)
    ranges = ranges.withColumn("held", held).withColumn("years_end", years_end).withColumn(
        "nth", F.row_number().over(Window.partitionBy("id", "n_table", "role").orderBy("first")))
    pays = F.col("role").isin(*AMOUNTS, "stock_total")
    fits = F.forall(F.array(*[F.lit(r) for r in ("year", "name", "salary", "total")]), lambda r: F.array_contains("held", r))
    keep = F.when(F.col("role") == "year", F.col("nth") == 1).when(F.col("role") == "total", F.col("nth") == 1).when(
        F.col("role") == "stock", ~F.array_contains("held", "stock_total")).otherwise(True)
    ranges = ranges.filter(fits & keep & ((pays & (F.col("first") > F.col("years_end"))) | (F.col("role") == "year")))
    return ranges.select("id", "n_table", F.when(F.col("role") == "stock_total", "stock").otherwise(F.col("role")).alias("role"), "first", "last", (F.col("last_head") + 1).alias("data_row"))


def name_and_title(text: Column) -> Column:
    """struct(name, title) of a cell that holds both: the name ends at a comma or where words of an office begin."""
    t = F.trim(F.regexp_replace(F.regexp_replace(text, _NOTE, " "), r"\s+", " "))
    t = F.regexp_replace(t, r"(?i)^(?:mr|mrs|ms|dr)\.? ", "")
    at = F.regexp_instr(t, F.lit(_TITLE_WORD))
    name = F.when(at > 1, F.substr(t, F.lit(1), at - 1)).when(at == 1, F.lit("")).otherwise(t)
    comma = F.regexp_extract(name, r"^([^,]+(?:, (?:Jr|Sr|II|III|IV)\b\.?)?)\s*(?:,|$)", 1)
    title = F.regexp_replace(F.substr(t, F.length(comma) + 1), r"^[\s,;–-]+", "")
    return F.struct(F.regexp_replace(comma, r"[\s,;–-]+$", "").alias("name"), title.alias("title"))


def _is_name(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}[^\d]*$") & F.size(F.split(name, " ")).between(2, 6) & (F.length(name) <= 60) & ~name.rlike(r"(?i)\btotal\b|\byear\b|" + _TITLE_WORD[4:])


def pay_tables(pages: DataFrame, id: str = "id", markup: str = "html") -> DataFrame:
    """(id, n_table, row, name, title, year, salary, bonus, stock, options, incentive, pension, other, total, adds_up): the rows
    of every table of pay of each page, whatever the order of its columns.

    A row with a year is one; its amounts stand under their headers, several cells of a header count as their first amount.
    Where they do not add up to the total and the row has as many amounts as the table has columns of pay, they are taken in
    order if that adds up. The name is the last one written left of the year, in this row or before it; it begins where a
    cell's text is a name and the person before has a year already, all else is more of the title. Rows without a total go.
    Null and empty pages and those without such a table give no rows; ids must be unique; extra columns are ignored.
    """
    given = pages.select(pages[id].alias("id"), pages[markup].alias("html")).filter(F.col("html").rlike("(?is)<table.*salary"))
    cells = stored(table_cells(given, "id", "html"))
    columns = stored(_columns(cells))
    place = columns.groupBy("id", "n_table").agg(F.max("data_row").alias("data_row"), F.max(F.when(F.col("role") == "year", F.col("first"))).alias("year_first"),
                                                F.max(F.when(F.col("role") == "year", F.col("last"))).alias("year_last"), F.sum((F.col("role") != "year").cast("int")).alias("n_columns"))
    body = cells.join(place, ["id", "n_table"]).filter(F.col("row") >= F.col("data_row"))
    is_year = F.col("text").rlike(_YEAR)
    inside = (F.col("first_column") <= F.col("year_last")) & (F.col("last_column") >= F.col("year_first"))
    row = Window.partitionBy("id", "n_table", "row")
    body = body.withColumn("year_at", F.min(F.when(is_year, F.struct((~inside).alias("far"), F.col("first_column").alias("c"),
                                                                     F.regexp_extract("text", _YEAR, 1).cast("int").alias("y")))).over(row))
    value = F.when(F.col("first_column") > F.col("year_at.c"), _cell_amount(F.col("text")))
    body = body.withColumn("value", F.when(~F.col("text").rlike(r"^\(.?\w\)$|^\*+$"), value))
    text = F.when((F.col("year_at").isNull() | (F.col("last_column") < F.col("year_at.c"))) & _cell_amount(F.col("text")).isNull() & (F.col("text") != "$"), F.col("text"))
    rows = body.groupBy("id", "n_table", "row").agg(
        F.first("year_at.y").alias("year"), F.first("n_columns").alias("n_columns"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text != "", F.struct("first_column", text.alias("t"))))), lambda x: x["t"]), " ").alias("text"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull() & ~F.trim("text").rlike(r"^[1-9]\d?$"), F.struct("first_column", "value")))),
                    lambda x: x["value"]).alias("in_order"))
    under = body.filter("value IS NOT NULL").join(columns.filter("role <> 'year'").select("id", "n_table", "role", "first", "last"), ["id", "n_table"])
    under = under.filter((F.col("first_column") <= F.col("last")) & (F.col("last_column") >= F.col("first")))
    under = under.groupBy("id", "n_table", "row", "role", "first").agg(F.min_by("value", "first_column").alias("value"))
    sums = under.groupBy("id", "n_table", "row").agg(*[F.coalesce(F.sum(F.when(F.col("role") == a, F.col("value"))), F.lit(0.0)).alias(a) for a in AMOUNTS])
    order = columns.filter("role <> 'year'").groupBy("id", "n_table").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]).alias("roles"))
    df = rows.join(sums, ["id", "n_table", "row"], "left").join(order, ["id", "n_table"])

    taken = F.arrays_zip(F.col("roles").alias("r"), F.col("in_order").alias("v"))
    of_role = lambda a: F.filter(taken, lambda x: x["r"] == a)
    ordered = {a: F.aggregate(of_role(a), F.lit(0.0), lambda s, x: s + x["v"]) for a in AMOUNTS}
    agree = lambda total, rest: (total > 0) & (F.abs(rest - total) <= F.greatest(F.lit(2.0), total * 0.01))
    parts = lambda of: sum((of[a] for a in AMOUNTS[1:-1]), of["salary"])
    read = {a: F.coalesce(F.col(a), F.lit(0.0)) for a in AMOUNTS}
    by_place = agree(read["total"], parts(read))
    use = ~by_place & (F.size("in_order") == F.size("roles")) & (agree(ordered["total"], parts(ordered)) | (read["total"] <= 0))
    last = F.when((read["total"] <= 0) & (F.size("in_order") > 0), F.element_at("in_order", -1)).otherwise(read["total"])
    values = {a: F.when(use, ordered[a]).otherwise(last if a == "total" else read[a]).alias(a) for a in AMOUNTS}
    df = df.select("id", "n_table", "row", "year", "text", *values.values())
    return _named(df).withColumn("adds_up", agree(F.col("total"), parts({a: F.col(a) for a in AMOUNTS}))).withColumnRenamed("id", id)


def _named(rows: DataFrame) -> DataFrame:
    """Rows of tables with name and title. A text that is a name begins a person, unless the one before has no year yet."""
    own = Window.partitionBy("id", "n_table").orderBy("row")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    split = name_and_title(F.col("text"))
    df = rows.withColumn("split", split).withColumn("begins", (F.col("text") != "") & _is_name(F.col("split.name")))
    #: Rows since the last name that have a year, seen from the row before: a name in between is part of a title.
    df = df.withColumn("years_before", F.coalesce(F.sum(F.when(F.col("year").isNotNull(), 1).otherwise(0)).over(before), F.lit(0)))
    last = F.last(F.when(F.col("begins"), F.col("years_before")), ignorenulls=True).over(before)
    df = df.withColumn("begins", F.col("begins") & (last.isNull() | (F.col("years_before") > last)))
    df = df.withColumn("person", F.sum(F.col("begins").cast("int")).over(own))
    pieces = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("row", F.when(F.col("begins"), F.col("split.title")).otherwise(F.col("text")).alias("t")))))
    heads = df.groupBy("id", "n_table", "person").agg(
        F.max(F.when(F.col("begins"), F.col("split.name"))).alias("name"),
        F.trim(F.regexp_replace(F.regexp_replace(F.array_join(F.transform(pieces, lambda x: x["t"]), " "), _NOTE, " "), r"\s+", " ")).alias("title"))
    named = df.filter("year IS NOT NULL AND total > 0 AND person > 0").join(heads, ["id", "n_table", "person"])
    return named.select("id", "n_table", "row", "name", "title", "year", *AMOUNTS)


# --- tags of pay versus performance --------------------------------------------------------------------------------------


def _attribute(tag: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(tag, rf'(?i)\b{name}\s*=\s*["\']([^"\']*)["\']', 1), F.lit(""))


def tag_contexts(pages: DataFrame, id: str = "id", markup: str = "html") -> DataFrame:
    """(id, context, entity, starts_on, ends_on, members): the contexts of a document of inline tags. ends_on is the end of a
    period or its instant, members a map from dimension to member. A context given twice counts as given first."""
    whole = r"(?is)<(?:xbrli:)?context\b[^>]*>.*?</(?:xbrli:)?context\s*>"
    given = pages.select(pages[id].alias("id"), F.posexplode(F.regexp_extract_all(pages[markup], F.lit(whole), F.lit(0))).alias("n", "c"))
    part = lambda name: F.nullif(F.trim(F.regexp_extract("c", rf"(?is)<(?:xbrli:)?{name}\b[^>]*>\s*([^<]*)<", 1)), F.lit(""))
    member = r"(?is)<xbrldi:explicitMember\b([^>]*)>\s*([^<]*)<"
    pairs = F.arrays_zip(F.regexp_extract_all("c", F.lit(member), F.lit(1)).alias("a"), F.regexp_extract_all("c", F.lit(member), F.lit(2)).alias("m"))
    members = F.map_from_entries(F.transform(pairs, lambda p: F.struct(_attribute(p["a"], "dimension").alias("k"), F.trim(p["m"]).alias("v"))))
    df = given.select("id", "n", _attribute(F.regexp_extract("c", "^<[^>]*>", 0), "id").alias("context"), part("identifier").alias("entity"),
                      part("startDate").try_cast("date").alias("starts_on"), F.coalesce(part("endDate"), part("instant")).try_cast("date").alias("ends_on"),
                      members.alias("members"))
    first = F.min_by(F.struct("entity", "starts_on", "ends_on", "members"), "n").alias("f")
    return df.filter("context IS NOT NULL").groupBy("id", "context").agg(first).select("id", "context", "f.*")


def inline_tags(pages: DataFrame, names: list[str], id: str = "id", markup: str = "html") -> DataFrame:
    """(id, n, name, context, text, value): the inline tags of these names in order. text is without markup; value (numbers
    only) has its scale and sign; a dash, an empty text and a format of zeros are 0."""
    name = "|".join(n.replace(".", r"\.") for n in names)
    found = []
    for kind in ("nonFraction", "nonNumeric"):
        pattern = rf"(?is)<ix:{kind}\b([^>]*\bname\s*=\s*[\"'](?:{name})[\"'][^>]*)>(.*?)</ix:{kind}\s*>"
        both = F.arrays_zip(*[F.regexp_extract_all(pages[markup], F.lit(pattern), F.lit(i)).alias(c) for i, c in ((1, "a"), (2, "t"))])
        found.append(pages.select(pages[id].alias("id"), F.lit(kind == "nonFraction").alias("number"), F.posexplode(both).alias("n", "x")))
    df = found[0].unionByName(found[1])
    text = F.trim(F.regexp_replace(F.regexp_replace("x.t", "<[^>]+>", " "), r"(?:&#160;|&nbsp;|\s)+", " "))
    df = df.select("id", "n", "number", _attribute(F.col("x.a"), "name").alias("name"), _attribute(F.col("x.a"), "contextRef").alias("context"), text.alias("text"),
                   *[_attribute(F.col("x.a"), a).alias(a) for a in ("scale", "sign", "format")])
    zero = F.col("text").rlike(r"^[-–—]?$") | F.coalesce(F.lower("format").contains("zero"), F.lit(False))
    read = F.when(zero, 0.0).otherwise(F.regexp_replace("text", "[, $]", "").try_cast("double"))
    value = read * F.pow(F.lit(10.0), F.coalesce(F.col("scale").try_cast("int"), F.lit(0))) * F.when(F.col("sign") == "-", -1).otherwise(1)
    return df.select("id", "n", "name", "context", "text", F.when(F.col("number"), value).alias("value"))


def performance_pay(pages: DataFrame, id: str = "id", markup: str = "html") -> DataFrame:
    """(id, fiscal_year, ends_on, total, name): the tagged total pay of chief executives, once each.

    A year that ends in January or February is named after the one before. The name is that of the context's member; in a
    context without one, that of the period, if only one is tagged. These are the tags that tagged_pay holds against rows.
    Documents without tags, and null ones, give no rows; ids must be unique; extra columns are ignored.
    """
    held = pages.filter(pages[markup].contains("ecd:PeoTotalCompAmt"))
    contexts = tag_contexts(held, id, markup).select("id", "context", "ends_on", F.try_element_at("members", F.lit("ecd:IndividualAxis")).alias("member"))
    tags = inline_tags(held, ["ecd:PeoTotalCompAmt", "ecd:PeoName"], id, markup).join(contexts.filter("ends_on IS NOT NULL"), ["id", "context"])
    called = F.trim(F.regexp_replace("text", r"(?i)^(?:mr|mrs|ms|miss|dr)\.? ", ""))
    names = tags.filter("name = 'ecd:PeoName'").select("id", "ends_on", F.col("member").alias("whose"), called.alias("called")).filter(F.length("called").between(1, 80)).distinct()
    totals = tags.filter("name = 'ecd:PeoTotalCompAmt' AND value IS NOT NULL").select("id", "n", "ends_on", "member", F.col("value").alias("total"))
    met = totals.join(names, ["id", "ends_on"], "left").withColumn("own", F.col("member").isNull() | F.col("member").eqNullSafe(F.col("whose")))
    named = met.groupBy("id", "n", "ends_on", "member", "total").agg(F.collect_set(F.when(F.col("own"), F.col("called"))).alias("names"))
    name = F.when(F.size("names") == 1, F.get("names", F.lit(0)))
    year = F.year("ends_on") - F.when(F.month("ends_on") <= 2, 1).otherwise(0)
    return named.select(F.col("id").alias(id), year.alias("fiscal_year"), "ends_on", "total", name.alias("name")).distinct()
