"""Who and what a text means: insiders of a company, spellings of one director, the domain that a firm registers, offices.

Names meet by equal words within a company, never all with all; what several could be is counted, and decided only where one
remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import SHORT_FORMS
from ..functions.text import capitals

#: A table of so many rows of a word and an id is broadcast; a longer one is joined by its key.
BROADCAST_ROWS = 200_000


def name_words(name: Column) -> Column:
    """The words of a name in small letters: nicknames in quotes or brackets, suffixes, initials and marks left out."""
    bare = F.regexp_replace(F.replace(name, F.lit("’"), F.lit("'")), r"\([^)]*\)|\"[^\"]*\"|“[^”]*”", " ")
    bare = F.regexp_replace(F.lower(bare), r"\b(?:jr|sr|ii|iii|iv|phd|md|esq|cpa)\b\.?", " ")
    return F.filter(F.split(F.regexp_replace(F.regexp_replace(bare, "[-']", ""), r"[^\p{L}]+", " "), " "), lambda w: F.length(w) > 1)


def _forms(word: Column) -> Column:
    """The word and the groups of short forms that it belongs to."""
    groups: dict[str, list[str]] = {}
    for n, group in enumerate(SHORT_FORMS):
        for w in group:
            groups.setdefault(w, []).append(f"#{n}")
    known = F.create_map(*[x for w, g in groups.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in g]))])
    return F.concat(F.array(word), F.coalesce(F.try_element_at(known, word), F.array().cast("array<string>")))


def insider_matches(people: DataFrame, insiders: DataFrame) -> DataFrame:
    """(company_id, person_id, insider_id, tier): which of a company's insiders its people are.

    people: company_id, person_id, name (first name first). insiders: company_id, insider_id, name (surname first, as
    registers write it), is_officer. They meet where the surname is one of the insider's words. Tier 1: the first name, or a
    short form of it, is another of these words; of several the one officer. Tier 2, if nobody meets in tier 1: its initial
    fits one insider alone. Each insider is one person's: the better tier keeps it, of equals none. Names without two words
    match nobody; null names too.
    """
    p = people.select("company_id", "person_id", name_words(F.col("name")).alias("w")).filter(F.size("w") >= 2)
    p = p.select("company_id", "person_id", F.get("w", F.lit(0)).alias("first"), F.element_at("w", -1).alias("last")).distinct()
    i = insiders.select("company_id", "insider_id", F.coalesce("is_officer", F.lit(False)).alias("officer"), name_words(F.col("name")).alias("words"))
    #: Both sides grow with the companies, whatever their files' sizes say: neither is broadcast.
    met = p.join(i.withColumn("last", F.explode(F.array_distinct("words"))).hint("merge"), ["company_id", "last"])
    others = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    named = F.exists(others, lambda w: F.arrays_overlap(_forms(w), _forms(F.col("first"))))
    initial = F.exists(others, lambda w: F.left(w, F.lit(1)) == F.left(F.col("first"), F.lit(1)))
    met = met.withColumn("named", named).withColumn("initial", initial)
    some = met.groupBy("company_id", "person_id").agg(
        F.count_if("named").alias("n_named"), F.count_if(F.col("named") & F.col("officer")).alias("n_officers"), F.count_if("initial").alias("n_initial"),
        F.min(F.when(F.col("named"), F.col("insider_id"))).alias("by_name"), F.min(F.when(F.col("named") & F.col("officer"), F.col("insider_id"))).alias("by_office"),
        F.min(F.when(F.col("initial"), F.col("insider_id"))).alias("by_initial"))
    first = F.when(F.col("n_named") == 1, F.col("by_name")).when((F.col("n_named") > 1) & (F.col("n_officers") == 1), F.col("by_office"))
    second = F.when((F.col("n_named") == 0) & (F.col("n_initial") == 1), F.col("by_initial"))
    found = some.select("company_id", "person_id", F.coalesce(first, second).alias("insider_id"), F.when(first.isNotNull(), 1).otherwise(2).alias("tier"))
    claims = found.filter("insider_id IS NOT NULL").groupBy("company_id", "insider_id").agg(F.min("tier").alias("best"))
    kept = found.join(claims, ["company_id", "insider_id"]).filter("tier = best")
    alone = kept.groupBy("company_id", "insider_id").agg(F.count("*").alias("n"), F.min("person_id").alias("person_id"), F.min("tier").alias("tier")).filter("n = 1")
    return alone.select("company_id", "person_id", "insider_id", "tier")


_HONOURS = ("mr", "mrs", "ms", "miss", "dr", "sir", "dame", "lord", "baroness")


def canonical_names(rows: DataFrame, group: str = "company_id", name: str = "name") -> DataFrame:
    """(group, name, canonical): each spelling of a name in a group of rows, and the one to use for it.

    A name without a first name ("Ms Halai"), or with its initial alone ("J. Halai"), stands for the full name of that
    surname and initial if the group has exactly one such; every other stands for itself. Full names are counted by surname
    and initial, so no two names are compared. Null names are left out; repeated rows count once.
    """
    names = rows.select(F.col(group).alias("g"), F.col(name).alias("name")).filter("name IS NOT NULL").distinct()
    words = F.filter(F.split(F.trim("name"), r"\s+"), lambda w: ~F.lower(F.regexp_replace(w, r"[.,]", "")).isin(*_HONOURS) & (w != ""))
    last = capitals(F.regexp_replace(F.coalesce(F.try_element_at("w", F.lit(-1)), F.col("name")), r"^[.,]+|[.,]+$", ""))
    first = F.regexp_replace(F.get("w", F.lit(0)), r"\.", "")
    df = names.withColumn("w", words).select("g", "name", last.alias("last"), F.when(F.size("w") >= 2, capitals(F.left(first, F.lit(1)))).alias("initial"),
                                             ((F.size("w") >= 2) & (F.length(first) > 1)).alias("full"))
    by_initial = df.filter("full").groupBy("g", "last", "initial").agg(F.count("*").alias("n"), F.min("name").alias("one"))
    #: The null initial stands for all of a surname.
    every = by_initial.groupBy("g", "last").agg(F.sum("n").alias("n"), F.min("one").alias("one")).withColumn("initial", F.lit(None).cast("string"))
    fits = by_initial.unionByName(every).filter("n = 1").select(F.col("g").alias("g2"), F.col("last").alias("last2"), F.col("initial").alias("initial2"), "one")
    met = df.join(fits, (~F.col("full")) & F.col("g").eqNullSafe(F.col("g2")) & (F.col("last") == F.col("last2")) & F.col("initial").eqNullSafe(F.col("initial2")), "left")
    return met.select(F.col("g").alias(group), F.col("name").alias(name), F.coalesce("one", "name").alias("canonical"))


def registrable_domains(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """urls with host and domain: the registered domain of each address, one label more than the longest of suffixes (suffix)
    that its host ends with.

    The tails of each distinct host meet the suffixes by equality. A host that is itself a suffix, is an address of numbers,
    or ends with none, has no domain; null addresses and those without a host have neither.
    """
    host = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(F.trim(urls[url]), F.lit("HOST")), F.lit("")), r"\.$", ""))
    asked = urls.withColumn("__host", F.nullif(host, F.lit("")))
    hosts = asked.select(F.col("__host").alias("h")).filter("h IS NOT NULL").distinct().withColumn("labels", F.split("h", r"\."))
    hosts = hosts.filter(~F.col("h").rlike(r"^[\d.]+$"))
    tails = hosts.select("h", "labels", F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("k")).withColumn(
        "suffix", F.array_join(F.slice("labels", -F.col("k"), F.col("k")), "."))
    known = suffixes.select(F.lower("suffix").alias("suffix")).distinct()
    known = F.broadcast(known) if known.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else known
    longest = tails.join(known, "suffix").groupBy("h").agg(F.max("k").alias("k"), F.first("labels").alias("labels"))
    found = longest.select("h", F.when(F.size("labels") > F.col("k"), F.array_join(F.slice("labels", -(F.col("k") + 1), F.col("k") + 1), ".")).alias("__domain"))
    return asked.join(found, F.col("__host") == F.col("h"), "left").select(*[asked[c] for c in urls.columns], F.col("__host").alias("host"), F.col("__domain").alias("domain"))


#: Labels of an office in a report's directory, the better first, and those that are somebody else's.
_OFFICES = (r"(?i)\b(?:principal (?:place of business|(?:administrative )?office)|(?:corporate )?head office|corporate office)\b", r"(?i)\bregistered (?:office|address)\b")
_OTHERS = r"(?i)\b(?:share regist|registry|auditor|solicitor|lawyer|banker|stock exchange|securities exchange|postal address|website|telephone|phone|e-?mail)"
_STARTS = r"(?i)^(?:level|suite|unit|floor|ground floor|(?:g?po box)|locked bag)\b|\d"
OFFICE_LINES, TOWN_WORDS = 5, 4


def office_addresses(lines: DataFrame, towns: DataFrame) -> DataFrame:
    """(id, street, town, code): the office in each document's directory.

    lines: id, n, text in order; two columns side by side are parted by two spaces or more, the left one counts. towns:
    town, code. The text behind a label of an office and on the five lines below, up to another label, is read; in front of
    a code stands a town of up to four words that has this code, the longest that there is. A principal place comes before a
    registered office, an earlier label before a later one. The street begins at the first part with a number, a level and so
    on. Documents without such a place give no row; null lines count as empty.
    """
    own = Window.partitionBy("id").orderBy("n")
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = F.when(text.rlike(_OFFICES[0]), 0).when(text.rlike(_OFFICES[1]), 1)
    df = lines.select("id", "n", text.alias("text")).withColumn("kind", F.when(F.length("text") <= 140, kind))
    df = df.withColumn("left", F.get(F.split(F.trim("text"), r"\s{2,}"), F.lit(0)))
    df = df.withColumn("stops", F.col("left").rlike("|".join([*_OFFICES, _OTHERS])))
    below = F.array(*[F.struct(F.lead("left", i).over(own).alias("t"), F.coalesce(F.lead("stops", i).over(own), F.lit(True)).alias("stops")) for i in range(1, OFFICE_LINES + 1)])
    df = df.withColumn("below", below).filter("kind IS NOT NULL")
    free = F.array_position(F.transform("below", lambda x: x["stops"]), F.lit(True)).cast("int")
    rest = F.transform(F.slice("below", F.lit(1), F.when(free == 0, OFFICE_LINES).otherwise(free - 1)), lambda x: x["t"])
    head = F.regexp_replace(F.get(F.split(F.regexp_replace("text", "|".join(_OFFICES), " "), r"\S\s{2,}\S"), F.lit(0)), _OTHERS + ".*$", "")
    parts = F.filter(F.transform(F.concat(F.array(head), rest), lambda x: F.regexp_replace(x, r"^[\s,:]+|[\s,:]+$", "")), lambda x: x != "")
    joined = df.select("id", "n", "kind", F.array_join(parts, ", ").alias("text"))
    #: Words with the marks behind them, so that a town's words and its code are neighbours in an array.
    words = joined.withColumn("words", F.split("text", r"\s+"))
    codes = words.select("id", "n", "kind", "words", F.posexplode("words").alias("at", "w")).withColumn("code", F.regexp_extract("w", r"^\D{0,2}(\d{4,5})\b", 1)).filter("code <> ''")
    #: A state may stand between town and code.
    ends = codes.select("id", "n", "kind", "words", "at", "code", F.explode(F.array(F.col("at"), F.col("at") - 1, F.col("at") - 2)).alias("end")).filter("end > 0")
    spans = ends.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(TOWN_WORDS), F.col("end")))).alias("k"))
    said = F.array_join(F.slice("words", F.col("end") - F.col("k") + 1, F.col("k")), " ")
    spans = spans.withColumn("key", F.lower(F.regexp_replace(said, r"[,.]", "")))
    known = towns.select(F.lower(F.regexp_replace("town", r"[,.]", "")).alias("key"), F.col("code").cast("string").alias("code"), F.col("town")).dropDuplicates(["key", "code"])
    met = spans.join(known, ["key", "code"])
    best = met.groupBy("id").agg(F.min_by(F.struct("words", "end", "k", "town", "code"), F.struct("kind", "n", "at", -F.col("k"), -F.col("end"))).alias("b")).select("id", "b.*")
    pieces = F.split(F.array_join(F.slice("words", F.lit(1), F.col("end") - F.col("k")), " "), r"\s*,\s*")
    begun = F.array_position(F.transform(pieces, lambda x: x.rlike(_STARTS)), F.lit(True)).cast("int")
    street = F.array_join(F.filter(F.slice(pieces, F.greatest(begun, F.lit(1)), F.size(pieces)), lambda x: x != ""), ", ")
    return best.select("id", F.left(street, F.lit(160)).alias("street"), "town", "code")


def appointed_people(appointments: DataFrame, known: DataFrame, insiders: DataFrame, people: DataFrame) -> DataFrame:
    """(appointment_id, person_id, how): who was appointed: known (the company has a person of that name), an insider of the
    company, or the one person of that name anywhere; null where none of these is certain.

    appointments: appointment_id, company_id, name. known: company_id, name, person_id. insiders: as insider_matches takes
    them, their ids are persons'. people: name, person_id. Names count without case; one that several persons of a company
    have is not known.
    """
    alone = lambda df, by: df.groupBy(*by).agg(F.min("person_id").alias("id"), F.count_distinct("person_id").alias("n")).filter("n = 1").drop("n")
    low = F.lower(F.trim("name"))
    own = alone(known.select("company_id", low.alias("k"), "person_id"), ["company_id", "k"])
    every = alone(people.select(low.alias("k"), "person_id"), ["k"]).withColumnRenamed("id", "only")
    df = appointments.select("appointment_id", "company_id", "name", low.alias("k")).join(own, ["company_id", "k"], "left").join(every, "k", "left")
    asked = df.filter("id IS NULL").select("company_id", F.col("appointment_id").alias("person_id"), "name")
    met = insider_matches(asked, insiders).select("company_id", F.col("person_id").alias("appointment_id"), F.col("insider_id").alias("inside"))
    df = df.join(met, ["company_id", "appointment_id"], "left")
    how = F.when(F.col("id").isNotNull(), "known").when(F.col("inside").isNotNull(), "insider").when(F.col("only").isNotNull(), "name")
    return df.select("appointment_id", F.coalesce("id", "inside", "only").alias("person_id"), how.alias("how"))


def pay_by_year(rows: DataFrame, near: DataFrame, others: DataFrame) -> DataFrame:
    """(person_id, year, total, ticker): each person's pay in a year, and the company that paid most of it (of equals the one
    of the smaller id): its ticker among near (company_id, ticker), else among others, else its id."""
    payer = F.max_by("company_id", F.struct("total", (-F.col("company_id")).alias("c")))
    sums = rows.groupBy("person_id", "year").agg(F.sum("total").alias("total"), payer.alias("company_id"))
    n = near.select("company_id", F.col("ticker").alias("__near"))
    o = others.select("company_id", F.col("ticker").alias("__other"))
    df = sums.join(n, "company_id", "left").join(o, "company_id", "left")
    return df.select("person_id", "year", "total", F.coalesce("__near", "__other", F.col("company_id").cast("string")).alias("ticker"))
