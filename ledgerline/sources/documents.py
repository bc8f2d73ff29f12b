"""Rows out of saved JSON and HTML documents, each in a text column: what importers keep from public registers and boards.

Every function takes a DataFrame with a text column (spark.read.text(path, wholetext=True) gives one a file) and states the
schema that it reads, so nothing is inferred and columns that nothing asks for are never built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _parsed(docs: DataFrame, text: str, schema: str) -> DataFrame:
    return docs.withColumn("j", F.from_json(F.col(text), schema))


def submissions(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, place, form, filed, accession, document): filings whose fields a document holds as parallel arrays."""
    fields = {"form": "form", "filingDate": "filed", "accessionNumber": "accession", "primaryDocument": "document"}
    schema = "filings struct<recent:struct<" + ",".join(f"{f}:array<string>" for f in fields) + ">>"
    df = _parsed(docs, text, schema)
    rows = F.arrays_zip(*[F.col(f"j.filings.recent.{f}").alias(n) for f, n in fields.items()])
    df = df.select(F.col(id).alias("id"), F.posexplode(rows).alias("place", "r"))
    return df.select("id", F.col("place").cast("long").alias("place"), *[F.col(f"r.{n}").alias(n) for n in fields.values()])


def tickers(docs: DataFrame, text: str) -> DataFrame:
    """(cik, ticker, name, exchange): of the rows of arrays (cik, name, ticker, exchange), the first of each number."""
    df = _parsed(docs, text, "data array<array<string>>").select(F.posexplode("j.data").alias("place", "r"))
    best = df.groupBy(F.get("r", F.lit(0)).cast("long").alias("cik")).agg(F.min_by("r", "place").alias("r"))
    return best.select("cik", F.get("r", F.lit(2)).alias("ticker"), F.get("r", F.lit(1)).alias("name"), F.get("r", F.lit(3)).alias("exchange"))


def company_facts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Tagged facts (company_id, concept, currency, start, end, value, frame, form, filed, place) of a register's document."""
    fact = "struct<start:date,end:date,val:decimal(28,4),frame:string,form:string,filed:date>"
    df = _parsed(docs, text, f"facts map<string,map<string,struct<units:map<string,array<{fact}>>>>>")
    df = df.select(F.col(id).alias("company_id"), F.explode("j.facts").alias("taxonomy", "concepts"))
    df = df.select("company_id", F.explode("concepts").alias("concept", "c")).select("company_id", "concept", F.explode("c.units").alias("currency", "facts"))
    df = df.select("company_id", "concept", "currency", F.posexplode("facts").alias("place", "f")).filter("f.end is not null and f.val is not null")
    return df.select("company_id", "concept", "currency", "f.start", "f.end", F.col("f.val").alias("value"), "f.frame", "f.form", "f.filed", F.col("place").cast("long").alias("place"))


def report_facts(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(company_id, concept, currency, start, end, value, place): facts without further dimensions of a report in JSON whose
    periods are "start/end" with the day after the last one."""
    df = _parsed(docs, text, "facts map<string,struct<value:string,dimensions:map<string,string>>>")
    df = df.select(F.col(id).alias("company_id"), F.explode("j.facts").alias("key", "f"))
    extra = F.map_filter("f.dimensions", lambda k, v: ~k.isin("concept", "entity", "period", "unit", "language"))
    df = df.filter(F.size(extra) == 0).select("company_id", "key", "f.value", *[F.col("f.dimensions")[x].alias(x) for x in ("concept", "period", "unit")])
    end = F.substring_index("period", "/", -1)
    return df.select("company_id", F.substring_index("concept", ":", -1).alias("concept"), F.substring_index("unit", ":", -1).alias("currency"),
                     F.to_date(F.substring("period", 1, 10)).alias("start"), F.date_sub(F.to_date(F.substring(end, 1, 10)), 1).alias("end"),
                     F.col("value").try_cast("decimal(28,4)").alias("value"), F.xxhash64("key").alias("place")).filter("value is not null")


def paged_filings(docs: DataFrame, text: str) -> DataFrame:
    """(entity, name, period_end, url, errors): from pages of a listing with its entities beside it, of each entity and
    period the filing with fewest errors, of equals the first by address."""
    schema = ("data array<struct<id:string,attributes:struct<period_end:string,report_url:string,error_count:long>,relationships:struct<entity:struct<data:struct<id:string>>>>>,"
              "included array<struct<id:string,attributes:struct<name:string,identifier:string>>>")  # fmt: skip
    df = _parsed(docs, text, schema)
    rows = df.select(F.explode("j.data").alias("d")).select("d.relationships.entity.data.id", "d.attributes.*")
    entities = df.select(F.explode("j.included").alias("e")).select("e.id", "e.attributes.*").dropDuplicates(["id"])
    best = F.min_by(F.struct("name", "report_url", "error_count"), F.struct("error_count", "report_url")).alias("b")
    grouped = rows.join(entities, "id").groupBy(F.col("identifier").alias("entity"), "period_end").agg(best)
    return grouped.select("entity", "b.name", "period_end", F.col("b.report_url").alias("url"), F.col("b.error_count").alias("errors"))


def bindings(docs: DataFrame, id: str, text: str, names: list[str]) -> DataFrame:
    """(id, place, names...): the rows of a query result in JSON; a variable without a binding is null."""
    schema = "results struct<bindings:array<struct<" + ",".join(f"{n}:struct<value:string>" for n in names) + ">>>"
    df = _parsed(docs, text, schema).select(F.col(id).alias("id"), F.posexplode("j.results.bindings").alias("place", "b"))
    return df.select("id", F.col("place").cast("long").alias("place"), *[F.col(f"b.{n}.value").alias(n) for n in names])


#: For each system of job boards: the schema of its document, its list, and its id, title, place and address.
BOARDS = {
    "greenhouse": ("jobs array<struct<id:string,title:string,location:struct<name:string>,absolute_url:string,content:string>>", "jobs", "id", "title", "location.name", "absolute_url", "content"),
    "lever": ("jobs array<struct<id:string,text:string,categories:struct<location:string>,hostedUrl:string,descriptionPlain:string>>", "jobs", "id", "text", "categories.location", "hostedUrl", "descriptionPlain"),
    "ashby": ("jobs array<struct<id:string,title:string,location:string,jobUrl:string,descriptionPlain:string>>", "jobs", "id", "title", "location", "jobUrl", "descriptionPlain"),
    "smartrecruiters": ("content array<struct<id:string,name:string,location:struct<city:string,region:string>,ref:string>>", "content", "id", "name", None, "ref", None),
    "workday": ("jobPostings array<struct<externalPath:string,title:string,locationsText:string>>", "jobPostings", "externalPath", "title", "locationsText", "externalPath", None),
}


def postings(docs: DataFrame, system: str, board: str, text: str) -> DataFrame:
    """(system, board, id, title, location, url, description) of the ads in a board's document."""
    schema, path, id, title, location, url, body = BOARDS[system]
    df = _parsed(docs, text, schema).select(F.lit(system).alias("system"), F.col(board).alias("board"), F.explode(f"j.{path}").alias("a"))
    place = F.col(f"a.{location}") if location else F.concat_ws(", ", "a.location.city", "a.location.region")
    return df.select("system", "board", F.col(f"a.{id}").alias("id"), F.col(f"a.{title}").alias("title"), place.alias("location"), F.col(f"a.{url}").alias("url"),
                     (F.col(f"a.{body}") if body else F.lit(None).cast("string")).alias("description"))


def unseen(found: DataFrame, known: DataFrame) -> DataFrame:
    """Ads that the store (system, board, id) does not have: only these are fetched in full."""
    return found.join(known.select("system", "board", "id"), ["system", "board", "id"], "left_anti")


def _text(markup: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(markup, r"<[^>]+>", " "), r"&nbsp;|&#160;", " "), r"\s+", " "))


def insiders(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(company_id, number, name, role): the owners in a register's table, the first row of each number."""
    row = r"(?is)<tr[^>]*>\s*<td[^>]*>\s*<a[^>]*>(.*?)</a>\s*</td>\s*<td[^>]*>\s*<a[^>]*CIK=0*(\d+)[^>]*>.*?</a>\s*</td>\s*<td[^>]*>.*?</td>\s*<td[^>]*>(.*?)</td>"
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(row), F.lit(i)).alias(n) for i, n in ((1, "name"), (2, "number"), (3, "role"))])
    df = docs.select(F.col(id).alias("company_id"), F.posexplode(parts).alias("place", "r"))
    best = df.groupBy("company_id", F.col("r.number").alias("number")).agg(F.min_by("r", "place").alias("r"))
    return best.select("company_id", "number", _text(F.col("r.name")).alias("name"), _text(F.col("r.role")).alias("role"))


def profile(docs: DataFrame, id: str, text: str, labels: dict[str, str]) -> DataFrame:
    """(company_id, a column for each of labels): the text of the element behind the one that holds a label."""
    found = [F.nullif(_text(F.regexp_extract(text, rf"(?is)>\s*{label}\s*:?\s*</[^>]+>\s*<[^>]+>(.*?)</", 1)), F.lit("")).alias(name) for name, label in labels.items()]
    return docs.select(F.col(id).alias("company_id"), *found)


def symbols(lines: DataFrame, line: str = "value") -> DataFrame:
    """(symbol, name, exchange) of the pipe-separated lines of a symbol directory: no test issues, known exchanges only; of
    lines (place, value) that repeat a symbol the last counts."""
    #: The codes of exchanges.
    codes = {"A": "NYSE American", "N": "NYSE", "P": "NYSE Arca", "Z": "Cboe BZX", "V": "IEX", "Q": "NASDAQ"}
    part = F.split(line, r"\|")
    exchange = F.try_element_at(F.create_map(*[F.lit(x) for p in codes.items() for x in p]), F.get(part, F.lit(2)))
    df = lines.select("place", F.get(part, F.lit(0)).alias("symbol"), F.get(part, F.lit(1)).alias("name"), exchange.alias("exchange"), F.get(part, F.lit(3)).alias("test"))
    df = df.filter("test = 'N' and exchange is not null")
    return df.groupBy("symbol").agg(F.max_by(F.struct("name", "exchange"), "place").alias("b")).select("symbol", "b.*")


def websites(docs: DataFrame, id: str, text: str, name: str) -> DataFrame:
    """(company_id, domain, mentions): the domain that a filing's text names most often and that looks like its company's:
    the first word of the name is in it."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"\b(?:https?://)?(?:www\.)([a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,})"), F.lit(1))
    df = docs.select(F.col(id).alias("company_id"), F.lower(F.regexp_extract(name, r"^\W*(\w+)", 1)).alias("word"), F.explode(found).alias("host"))
    parts = F.split("host", r"\.")
    two = F.size(parts) > 2
    short = F.length(F.get(parts, F.size(parts) - 2)) <= 3
    domain = F.when(two & short, F.array_join(F.slice(parts, -3, 3), ".")).otherwise(F.array_join(F.slice(parts, -2, 2), "."))
    counts = df.withColumn("domain", domain).filter(F.contains("domain", "word") & (F.length("word") >= 3)).groupBy("company_id", "domain").agg(F.count("*").alias("mentions"))
    return counts.groupBy("company_id").agg(F.max_by(F.struct("domain", "mentions"), F.struct("mentions", (-F.length("domain")).alias("l"), "domain")).alias("b")).select("company_id", "b.*")
