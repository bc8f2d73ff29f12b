"""Places in text: countries and regions, postcodes, places of job ads, city names. Column expressions but for folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of countries, states and provinces by code.
COUNTRIES = {
    "US": "United States", "CA": "Canada", "UK": "United Kingdom", "FR": "France", "NL": "Netherlands", "IT": "Italy", "ES": "Spain",
    "AU": "Australia", "NZ": "New Zealand", "PK": "Pakistan", "SE": "Sweden", "DK": "Denmark", "FI": "Finland", "NO": "Norway", "PL": "Poland",
    "BE": "Belgium", "AT": "Austria", "LU": "Luxembourg", "HU": "Hungary", "LT": "Lithuania", "HR": "Croatia", "SI": "Slovenia",
}
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois",
    "IN": "Indiana", "IA": "Iowa", "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts",
    "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada",
    "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "PR": "Puerto Rico", "RI": "Rhode Island", "SC": "South Carolina",
    "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia",
    "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}
#: Further names by code, names that mean a city first, and the digits of postcodes where these are four.
ALIASES = {
    "usa": "US", "us": "US", "u s": "US", "u s a": "US", "america": "US", "united states of america": "US", "uk": "UK", "u k": "UK", "gb": "UK",
    "great britain": "UK", "britain": "UK", "england": "UK", "holland": "NL", "the netherlands": "NL", "aus": "AU", "nz": "NZ", "sverige": "SE",
    "danmark": "DK", "suomi": "FI", "norge": "NO", "polska": "PL", "belgique": "BE", "belgie": "BE", "osterreich": "AT", "oesterreich": "AT",
    "letzebuerg": "LU", "luxemburg": "LU", "magyarorszag": "HU", "lietuva": "LT", "hrvatska": "HR", "slovenija": "SI", "new york state": "US-NY",
    "state of new york": "US-NY", "washington state": "US-WA", "state of washington": "US-WA", "newfoundland": "CA-NL", "pei": "CA-PE",
    "quebec province": "CA-QC",
}
CITY_FIRST = ("new york", "washington")
FOUR_DIGITS = ("NL", "AU", "NZ", "DK", "NO", "BE", "AT", "LU", "HU", "SI")
#: Letters with accents that the names above and European places have, and the plain ones.
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿšžčćđłńśźżąęőűåøæœß", "aaaaaaceeeeiiiinooooouuuuyyszccdlnszzaeouaoaos")


def plain(text: Column) -> Column:
    """Small letters without accents, one space for all that is no letter or digit."""
    low = F.translate(F.lower(text), *ACCENTS)
    return F.trim(F.regexp_replace(low, r"[^a-z0-9]+", " "))


def country_of(state: Column, longitude: Column) -> Column:
    """The country of a location: state codes count west of 30 degrees only, elsewhere the column holds a country."""
    up = F.upper(state)
    west = F.when(up.isin(list(STATES)), "US").when(up.isin(list(PROVINCES)), "CA")
    return F.coalesce(F.when(longitude < -30, west), up)


def in_region(locations: DataFrame, code: str) -> DataFrame:
    """The locations in a country ("UK") or a state of one ("US-TX")."""
    country, _, state = code.partition("-")
    inside = locations.filter(country_of(F.col("state"), F.col("longitude")) == country)
    return inside.filter(F.upper("state") == state) if state else inside


def regions(spark: SparkSession) -> DataFrame:
    """(name, code): every name of a region; of names that several regions have, the one that is meant: a state of the US
    before a country before a province."""
    rows = [(v, f"CA-{k}", 0) for k, v in PROVINCES.items()] + [(k, f"CA-{k}", 0) for k in PROVINCES]
    rows += [(v, k, 1) for k, v in COUNTRIES.items()] + [(k, k, 1) for k in COUNTRIES]
    rows += [(v, f"US-{k}", 2) for k, v in STATES.items()] + [(k, f"US-{k}", 2) for k in STATES] + [(k, v, 3) for k, v in ALIASES.items()]
    rows += [(k, k, 0) for k in (*[f"US-{s}" for s in STATES], *[f"CA-{s}" for s in PROVINCES])]
    df = spark.createDataFrame(rows, "name string, code string, turn int")
    return df.groupBy(plain(F.col("name")).alias("name")).agg(F.max_by("code", "turn").alias("code"))


def find_regions(asked: DataFrame, text: str) -> DataFrame:
    """asked with region: what a text names, or null. A country at its end picks a state or province of it; names that are
    first of all a city need that. The table of names has a few hundred rows."""
    names = F.broadcast(regions(asked.sparkSession))
    key = plain(F.col(text))
    ends = names.filter(~F.contains("code", F.lit("-"))).select(F.col("name").alias("__end"), F.col("code").alias("__country"))
    keyed = asked.withColumn("__key", key)
    #: Each text is looked up once, however many ask for it.
    df = keyed.select("__key").distinct().withColumn("__n", F.size(F.split("__key", " ")))
    #: The last one to four words may be a country.
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.col("__n"))), lambda k: F.struct(
        F.array_join(F.slice(F.split("__key", " "), -k, k), " ").alias("end"),
        F.array_join(F.slice(F.split(F.col("__key"), " "), F.lit(1), F.col("__n") - k), " ").alias("rest")))
    split = df.select(*df.columns, F.explode_outer(cuts).alias("__c")).filter("__c.rest <> ''")
    split = split.join(F.broadcast(ends), F.col("__c.end") == F.col("__end")).select("__key", F.length("__end").alias("__size"), "__country", "__c.rest")
    inner = names.filter(F.contains("code", F.lit("-"))).select(F.col("name").alias("__name"), F.col("code").alias("__code"))
    states = inner.unionByName(inner.select(F.lower(F.substring_index("__code", "-", -1)).alias("__name"), "__code")).distinct()
    meets = (F.col("rest") == F.col("__name")) & F.col("__code").startswith(F.concat("__country", F.lit("-")))
    within = split.join(F.broadcast(states), meets).groupBy("__key").agg(F.max_by("__code", "__size").alias("__state"))
    whole = names.select(F.col("name").alias("__whole"), F.col("code").alias("__found"))
    df = df.join(whole, F.col("__key") == F.col("__whole"), "left").join(within.withColumnRenamed("__key", "__k"), F.col("__key") == F.col("__k"), "left")
    direct = F.when(~F.col("__key").isin(*CITY_FIRST), F.col("__found"))
    found = df.select(F.col("__key").alias("__text"), F.coalesce(direct, F.col("__state")).alias("__region"))
    return keyed.join(found, F.col("__key") == F.col("__text"), "left").select(*[keyed[c] for c in asked.columns], F.col("__region").alias("region"))


def postcode_digits(country: Column, code: Column) -> Column:
    """A postcode as its country's table holds it: four digits, or five with zeros in front; null if it has too few."""
    digits = F.regexp_extract(F.regexp_replace(code, r"[\s-]", ""), r"\d+", 0)
    four = F.upper(country).isin(*FOUR_DIGITS)
    return F.when(four & (F.length(digits) >= 4), F.substring(digits, 1, 4)).when(~four & F.length(digits).between(4, 5), F.lpad(digits, 5, "0"))


def postcode(text: Column) -> Column:
    """struct(kind, key, coarse): what a text that may be a postcode asks for. kind: prefixed (a country and its code), zip,
    ca (a full Canadian code or its first half), uk (a district, coarse without its last letter), or null.

    Codes that could be British or Canadian have both keys: an exact British district comes first, then the Canadian area.
    """
    t = F.upper(F.trim(text))
    country, code = F.regexp_extract(t, r"^([A-Z]{2})[\s:-]+\d{2,3}[\s-]?\d{2,3}(\s*[A-Z]{2})?$", 1), F.regexp_extract(t, r"^[A-Z]{2}[\s:-]+(\d{2,3}[\s-]?\d{2,3})", 1)
    zip_ = F.regexp_extract(t, r"^(\d{5})(-\d{4})?$", 1)
    area, unit = (F.regexp_extract(t, r"^([ABCEGHJ-NPRSTVXY]\d[A-Z])(\s*(\d[A-Z]\d))?$", i) for i in (1, 3))
    district = F.regexp_extract(t, r"^([A-Z]{1,2}\d[A-Z\d]?)(\s*\d[A-Z]{2})?$", 1)
    prefixed = country.isin([c for c in COUNTRIES if c not in ("US", "CA", "UK")])
    none = F.lit(None).cast("string")

    def kind(name: str, key: Column, coarse: Column = none, other: Column = none) -> Column:
        return F.struct(F.lit(name).alias("kind"), key.alias("key"), coarse.alias("coarse"), other.alias("other"))

    coarse = F.when(district.rlike("[A-Z]$"), F.regexp_replace(district, "[A-Z]$", ""))
    return (
        F.when(prefixed, kind("prefixed", F.concat(country, F.lit(":"), postcode_digits(country, code))))
        .when(zip_ != "", kind("zip", zip_))
        .when((area != "") & (unit != ""), kind("ca", F.concat(F.lit("CA:"), area)))
        .when(district != "", kind("uk", district, coarse, F.when(area != "", F.concat(F.lit("CA:"), area))))
        .when(area != "", kind("ca", F.concat(F.lit("CA:"), area)))
    )


def located(asked: DataFrame, text: str, table: DataFrame) -> DataFrame:
    """asked with zip_key, city, state and coordinates of its postcode from table (zip_key, city, state, latitude, longitude)."""
    df = asked.withColumn("__id", F.monotonically_increasing_id()).withColumn("__p", postcode(F.col(text)))
    keys = F.filter(F.array("__p.key", "__p.other", "__p.coarse"), lambda k: k.isNotNull())
    tries = df.select("__id", F.posexplode(keys).alias("__turn", "zip_key")).join(table, "zip_key")
    best = tries.groupBy("__id").agg(F.min_by(F.struct(*table.columns), "__turn").alias("b")).select("__id", "b.*")
    return df.join(best, "__id", "left").drop("__id", "__p")


def zip_key(zip: Column, country: Column, state: Column) -> Column:
    """The key of a row of a table of codes: country and code outside the US, CA and the UK; CA: before Canadian areas."""
    c = F.upper(F.coalesce(country, F.lit("")))
    digits = F.when(zip.rlike(r"^\d{3,4}$"), F.lpad(zip, 5, "0")).otherwise(F.upper(zip))
    other = ~c.isin("", "US", "UK", "CA")
    canadian = (c == "CA") | (c == "") & F.upper(state).isin(list(PROVINCES)) & F.upper(zip).rlike(r"^[A-Z]\d[A-Z]$")
    return F.when(other, F.concat(c, F.lit(":"), postcode_digits(c, zip))).when(canadian, F.concat(F.lit("CA:"), F.upper(zip))).otherwise(digits)


def state_code(text: Column) -> Column:
    """The code of a state named by its code or its name, or null."""
    t = F.regexp_replace(F.trim(text), r"\.$", "")
    by_name = F.create_map(*[F.lit(x) for k, v in STATES.items() for x in (v.lower(), k)])
    return F.when(F.upper(t).isin(list(STATES)), F.upper(t)).otherwise(F.try_element_at(by_name, F.lower(t)))


def title_case(text: Column) -> Column:
    """Capitals at the beginning of words, in words with a hyphen or an apostrophe after these too; McX stays so."""
    t = F.initcap(F.lower(text))
    for mark in ("-", "'"):
        parts = F.transform(F.split(t, mark), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
        t = F.array_join(parts, mark)
    return t


#: The country as ads write it, and words for where work is done.
COUNTRY = ("us", "usa", "u.s.", "u.s.a.", "u.s.a", "united states", "united states of america")
WORKPLACE = ("remote", "hybrid", "onsite", "on-site", "headquarters", "hq")


def us_places(text: Column) -> Column:
    """array<struct<city, state>>: the US cities that the location of a job ad names, each once.

    Ads part places by semicolons, bars, slashes or "or". The pieces of a place, between commas and dashes, are a country, a
    state, a kind of workplace, or else a city; the city is what stands before the last state, or behind it if it is first.
    """
    alone = F.split(F.regexp_replace(text, r"\([^)]*\)", " "), r"[;|/•\n]|\s+or\s+")

    def pieces(part: Column) -> Column:
        cut = F.transform(F.split(F.trim(part), r",|\s[-–]\s|(?<=^USA?)\s?-|(?<=^USA?-[A-Z]{2})-|:"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
        return F.filter(cut, lambda x: (x != "") & ~F.lower(x).isin(*COUNTRY) & ~F.lower(x).isin(*WORKPLACE))

    def cited(p: Column) -> Column:
        city = F.get(p["known"], F.when(p["at"] == 0, 1).otherwise(p["at"] - 1))
        return F.struct(city.alias("city"), F.get(p["states"], p["at"]).alias("state"))

    def place(p: Column) -> Column:
        name = F.when(F.lower(p["city"]).isin("new york city", "nyc"), "New York").otherwise(title_case(p["city"]))
        away = F.exists(F.split(F.lower(p["city"]), "[^a-z-]+"), lambda w: w.isin(*WORKPLACE))
        return F.when(~away, F.struct(name.alias("city"), p["state"].alias("state")))

    #: One step after the other: an expression that is named twice within one lambda is worked out twice.
    known = F.transform(F.transform(alone, pieces), lambda k: F.struct(k.alias("known"), F.transform(k, state_code).alias("states")))
    last = F.transform(known, lambda p: F.struct(p["known"].alias("known"), p["states"].alias("states"), F.array_max(F.transform(p["states"], lambda x, i: F.when(x.isNotNull(), i))).alias("at")))
    cities = F.filter(F.transform(last, cited), lambda p: p["city"].isNotNull() & p["state"].isNotNull())
    found = F.filter(F.transform(cities, place), lambda x: x["city"].isNotNull() & x["state"].isNotNull())
    return F.coalesce(F.array_distinct(found), F.array().cast("array<struct<city:string,state:string>>"))


def is_us(text: Column) -> Column:
    """A job in the US: in one of its cities, or where a piece of its place is the country, alone or with a kind of workplace."""
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[;|/•\n,()-]|\s[–]\s|\s+or\s+")
    bare = lambda x: F.trim(F.regexp_replace(x, rf"\b(?:{'|'.join(WORKPLACE)})\b|\b(?:in|within|the|anywhere)\b", ""))
    return (F.size(us_places(text)) > 0) | F.exists(pieces, lambda x: bare(x).isin(*COUNTRY))


def city_key(city: Column) -> Column:
    """What cities are grouped by: plain letters, one space for dashes, no number of a district behind."""
    return F.trim(F.regexp_replace(plain(city), r" (cedex|arrondissement)?( ?\d+(e|er|eme)?)?( arrondissement| cedex)?$", ""))


def code_centres(rows: DataFrame) -> DataFrame:
    """(country, code, place, latitude, longitude): rows (country, code, place, latitude, longitude) of one code as their mean
    point, named by the most frequent place without the number of its district, of equals the first by letters."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("place", r"\s+(\d+|[IVX]+)(er|e|ème)?(\s+arrondissement)?$", ""), r"(?i)\s+(cedex|bus)(\s+\d+)?$", ""))
    df = rows.select("country", postcode_digits(F.col("country"), F.col("code")).alias("code"), bare.alias("place"), "latitude", "longitude").filter("code is not null")
    names = df.groupBy("country", "code", "place").agg(F.count("*").alias("n"), F.sum("latitude").alias("lat"), F.sum("longitude").alias("lng"))
    best = F.min_by("place", F.struct(-F.col("n"), "place")).alias("place")
    return names.groupBy("country", "code").agg(best, (F.sum("lat") / F.sum("n")).alias("latitude"), (F.sum("lng") / F.sum("n")).alias("longitude"))


def biggest_cities(rows: DataFrame) -> DataFrame:
    """(name, state, latitude, longitude, codes): for each city name, its largest bearer by number of codes, at their mean."""
    cities = rows.groupBy(F.upper("city").alias("name"), F.upper("state").alias("state")).agg(
        F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"), F.count("*").alias("codes"))
    return cities.groupBy("name").agg(F.min_by(F.struct("state", "latitude", "longitude", "codes"), F.struct(-F.col("codes"), "state")).alias("b")).select("name", "b.*")
