"""Searches by place: companies around a point or in a region, nearest places, similar companies, codes and circles.

Points are joined by cells of a grid: each cell of one side meets the cells around it, then distances decide. A circle too
wide for the cell size takes a larger one, so the number of cells around a point stays the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import MILES_PER_DEGREE, box, convert, miles, usd_rate
from ..sources.stored import stored


def near(locations: DataFrame, latitude: float, longitude: float, radius: float) -> DataFrame:
    """(company_id, location_id, city, state, miles, has_hq): each company's nearest location within radius miles.

    The box around the circle comes first: stored coordinates can be skipped by it in a scan. Equally near locations: the one
    with the smaller id.
    """
    south, north, west, east = box(latitude, longitude, radius)
    inside = locations.filter(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    inside = inside.withColumn("exact", miles(F.lit(latitude), F.lit(longitude), F.col("latitude"), F.col("longitude"))).filter(F.col("exact") <= radius)
    nearest = F.min(F.struct("exact", "location_id", "city", "state")).alias("l")
    hits = inside.groupBy("company_id").agg(nearest, F.max(F.col("type") == "Headquarters").alias("has_hq"))
    return hits.select("company_id", "l.location_id", "l.city", "l.state", F.bround("l.exact", 2).alias("miles"), "has_hq")


def in_region(locations: DataFrame, state: str) -> DataFrame:
    """The location that stands for each company in a region: its headquarters, else the first by type and id."""
    inside = locations.filter(F.col("state") == state)
    order = F.struct((F.col("type") != "Headquarters").alias("a"), F.col("type"), F.col("location_id").alias("id"), "latitude", "longitude")
    hits = inside.groupBy("company_id").agg(F.min(order).alias("l"), F.max(F.col("type") == "Headquarters").alias("has_hq"))
    return hits.select("company_id", F.col("l.id").alias("location_id"), "l.latitude", "l.longitude", "has_hq")


def centre(hits: DataFrame) -> DataFrame:
    """The mean point of hits, three places; 0, 0 for none."""
    mean = lambda c: F.coalesce(F.bround(F.avg(c), 3), F.lit(0.0)).alias(c)
    return hits.agg(mean("latitude"), mean("longitude"), F.count("*").alias("companies"))


def results(hits: DataFrame, companies: DataFrame, figures: DataFrame, sector: str | None = None, hq_only: bool = False) -> DataFrame:
    """One row for each hit: the company with its indicators (empty ones where it has no periods)."""
    some = companies.select("company_id", "ticker", "name", "sector", "currency")
    if sector:
        some = some.filter(F.upper("sector") == sector.strip().upper())
    df = (hits.filter("has_hq") if hq_only else hits).join(some, "company_id").join(figures, "company_id", "left")
    empty = {"ttm_revenue": 0.0, "ttm_net": 0.0, "trend": "Flat"}
    return df.fillna(empty)


def dominant_currency(rows: DataFrame) -> DataFrame:
    """(currency): the most frequent one, the first by letters of equals, USD for no rows."""
    counts = rows.groupBy("currency").agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.min_by("currency", F.struct(-F.col("n"), "currency")), F.lit("USD")).alias("main"))


def summary(rows: DataFrame) -> DataFrame:
    """One row: companies, trailing revenue in the main currency, growing, based here, main currency, whether mixed."""
    #: One row against all: the main currency.
    both = rows.join(F.broadcast(dominant_currency(rows)), how="cross")
    return both.agg(
        F.count("*").alias("companies"), F.sum(convert(F.col("ttm_revenue"), F.col("currency"), F.col("main"))).alias("revenue"),
        F.count_if(F.col("trend") == "Up").alias("growing"), F.count_if("has_hq").alias("based_here"), F.max("main").alias("currency"),
        F.max(F.col("currency") != F.col("main")).alias("mixed"))


def order(sort: str, reverse: bool = False) -> list[Column]:
    """Revenue, Profit: largest first; Growth: largest first, none last either way; Distance: nearest first; ties by ticker."""
    dollars = lambda c: F.col(c) * usd_rate(F.col("currency"))
    key = {"Revenue": dollars("ttm_revenue"), "Profit": dollars("ttm_net"), "Growth": F.col("growth"), "Distance": F.col("miles")}[sort]
    up = (sort == "Distance") != reverse
    return [key.asc_nulls_last() if up else key.desc_nulls_last(), F.col("ticker")]


def page(rows: DataFrame, by: list[Column], number: int = 1, size: int = 25) -> DataFrame:
    """One page in order, with place: its rows' numbers in the whole order. A top-k of number * size rows, no full sort."""
    top = rows.orderBy(*by).limit(number * size)
    placed = top.withColumn("place", F.row_number().over(Window.orderBy(*by)))
    return placed.filter(F.col("place") > (number - 1) * size)


def _cells(df: DataFrame, lat: str, lng: str, step: float, around: bool) -> DataFrame:
    y, x = F.floor(F.col(lat) / step), F.floor(F.col(lng) / step)
    if not around:
        return df.withColumn("cell_y", y).withColumn("cell_x", x)
    #: Degrees of longitude shrink with the cosine: the cells to either side that a radius of one step can reach.
    reach = F.ceil(1 / F.greatest(F.lit(0.01), F.cos(F.radians(F.least(F.abs(F.col(lat)) + step, F.lit(89.5))))))
    df = df.withColumn("cell_y", F.explode(F.sequence(y - 1, y + 1)))
    return df.withColumn("cell_x", F.explode(F.sequence(x - reach, x + reach)))


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (latitude, longitude) and right (to_latitude, to_longitude) at most radius miles apart, with miles."""
    step = math.ceil(radius / MILES_PER_DEGREE * 100 + 1) / 100
    a = _cells(left, "latitude", "longitude", step, around=True)
    b = _cells(right, "to_latitude", "to_longitude", step, around=False)
    pairs = a.join(b, ["cell_y", "cell_x"]).drop("cell_y", "cell_x")
    pairs = pairs.withColumn("miles", miles(F.col("latitude"), F.col("longitude"), F.col("to_latitude"), F.col("to_longitude")))
    return pairs.filter(F.col("miles") <= radius)


#: Searches for neighbours widen in these steps, in shares of the radius.
RINGS = (1 / 32, 1 / 4, 1.0)


def nearest_place(points: DataFrame, places: DataFrame, key: str, radius: float) -> DataFrame:
    """points with the nearest of places (place, to_latitude, to_longitude) on a flat map around each, and its distance; null
    if that one is not within radius miles. Only places within twice the radius are looked at: a nearer one on the flat map
    is never further away than that.

    Points at one spot ask once, places at one spot answer once. A small circle is searched first, by the same rule: a wider
    one only for spots whose nearest place in it is not within half of what was looked at.
    """
    flat = F.pow(F.col("to_latitude") - F.col("latitude"), F.lit(2.0)) + F.pow((F.col("to_longitude") - F.col("longitude")) * F.cos(F.radians("latitude")), F.lit(2.0))
    spots = stored(places.groupBy("to_latitude", "to_longitude").agg(F.min("place").alias("place")))
    spot = ["latitude", "longitude"]
    found, open_ = None, stored(points.select(*spot).distinct())
    for n, share in enumerate(RINGS):
        best = within(open_, spots, 2 * radius * share).groupBy(*spot).agg(F.min(F.struct(F.round(flat, 12).alias("flat"), "place", "miles")).alias("b"))
        best = best.filter(F.col("b.miles") <= radius * share).select(*spot, F.col("b.place").alias("place"), F.bround("b.miles", 2).alias("miles"))
        if n + 1 < len(RINGS):
            best = stored(best)
            open_ = open_.join(best, spot, "left_anti")
        found = best if found is None else found.unionByName(best)
    found = found.select(F.col("latitude").alias("__lat"), F.col("longitude").alias("__lng"), "place", "miles")
    return points.join(found, (F.col("latitude") == F.col("__lat")) & (F.col("longitude") == F.col("__lng")), "left").drop("__lat", "__lng")


def areas(points: DataFrame, places: DataFrame, radius: float = 30, top: int = 25) -> DataFrame:
    """(area, events, visitors): search points (latitude, longitude, events, visitors) summed by the nearest place, or as near a
    point where none is within radius; the most visited first."""
    named = nearest_place(points.withColumn("__p", F.monotonically_increasing_id()), places, "__p", radius)
    away = F.format_string("Near %.2f, %.2f", "latitude", "longitude")
    df = named.groupBy(F.coalesce("place", away).alias("area")).agg(F.sum("events").alias("events"), F.sum("visitors").alias("visitors"))
    return df.orderBy(F.desc("visitors"), F.desc("events"), "area").limit(top)


def matching(rows: DataFrame, text: str | None) -> DataFrame:
    """Companies whose name holds a text, whatever its accents and case, or whose ticker begins with it; all without a text."""
    if not text or not text.strip():
        return rows
    asked = text.strip()
    inside = F.contains(F.collate("name", "UNICODE_CI_AI"), F.collate(F.lit(asked), "UNICODE_CI_AI"))
    return rows.filter(inside | F.col("ticker").startswith(asked.upper()))


def _closest(own: DataFrame, other: DataFrame, radius: float, top: int, same: bool) -> DataFrame:
    """The best top of other for each of own within radius: by whole miles, then revenue.

    Companies search a small circle first; only those that it leaves with fewer than top that no further one could push out
    search the next. So where companies are dense each meets few others.
    """
    found, open_ = None, own
    for n, share in enumerate(RINGS):
        reach = radius * share
        pairs = within(open_, other, reach).filter("company_id <> other_id")
        pairs = pairs.filter("sector = other_sector") if same else pairs
        whole = F.bround("miles", 0)
        best = Window.partitionBy("company_id").orderBy(whole, F.desc("revenue_usd"), "other_id")
        pairs = pairs.withColumn("whole", whole).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)
        pairs = pairs.select("company_id", "other_id", "miles", "whole", "place")
        if n + 1 < len(RINGS):
            pairs = stored(pairs)
            #: One further away than reach is at whole miles of floor(reach - 0.5) at least.
            done = pairs.groupBy("company_id").agg(F.count_if(F.col("whole") < F.floor(F.lit(reach) - 0.5)).alias("sure")).filter(F.col("sure") >= top)
            pairs, open_ = pairs.join(done, "company_id", "left_semi"), open_.join(done, "company_id", "left_anti")
        found = pairs if found is None else found.unionByName(pairs)
    return found.withColumn("same_sector", F.lit(same))


def similar(stats: DataFrame, sector_miles: float = 100, any_miles: float = 25, top: int = 5) -> DataFrame:
    """(company_id, other_id, miles, same_sector, place): the five nearest of its sector, or, with fewer than two, of any.

    Whole miles count, then revenue in dollars.
    """
    stats = stats.select("company_id", "sector", "latitude", "longitude", "ttm_revenue", "revenue_usd")
    stats = stored(stats)
    own = stats.select("company_id", "sector", "latitude", "longitude")
    other = stats.filter("ttm_revenue > 0").select(F.col("company_id").alias("other_id"), F.col("sector").alias("other_sector"), "revenue_usd",
                                                   F.col("latitude").alias("to_latitude"), F.col("longitude").alias("to_longitude"))
    same = _closest(own, other, sector_miles, top, True)
    enough = same.groupBy("company_id").agg(F.count("*").alias("n")).filter("n >= 2").select("company_id")
    any_ = _closest(own.join(enough, "company_id", "left_anti"), other, any_miles, top, False)
    pairs = same.join(enough, "company_id", "left_semi").unionByName(any_)
    return pairs.select("company_id", "other_id", F.bround("miles", 1).alias("miles"), "same_sector", F.col("place").cast("long").alias("place"))


def _nearest_number(asked: DataFrame, codes: DataFrame, digits: int) -> DataFrame:
    """(country, code, known, place): for each code asked the numerically nearest known one of its country and length that
    begins with the same digits, of equally near ones the smaller. In the order of the numbers that is the one before or
    behind it: no pairs are made."""
    known = F.struct("country", F.col("known").alias("code"), F.lit(False).alias("asks"), "place")
    both = asked.select("country", "code", F.lit(True).alias("asks"), F.lit(None).cast("string").alias("place")).unionByName(codes.select(known.alias("k")).select("k.*"))
    both = both.filter("country IS NOT NULL").withColumn("number", F.col("code").cast("long"))
    area = [F.col("country"), F.length("code"), F.substring("code", 1, digits)]
    last = F.last(F.when(~F.col("asks"), F.struct("number", F.col("code").alias("known"), "place")), ignorenulls=True)
    for name, order in (("below", F.asc("number")), ("above", F.desc("number"))):
        both = both.withColumn(name, last.over(Window.partitionBy(*area).orderBy(order, "asks").rowsBetween(Window.unboundedPreceding, 0)))
    side = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.col("number") - F.col(f"{s}.number")).alias("gap"), F.col(f"{s}.known").alias("known"), F.col(f"{s}.place").alias("place")))
    return both.filter("asks").select("country", "code", F.least(side("below"), side("above")).alias("b")).filter("b IS NOT NULL").select("country", "code", "b.known", "b.place")


def located_codes(asked: DataFrame, codes: DataFrame) -> DataFrame:
    """asked (id, country, code) with the place of its code: the code itself, else the numerically nearest of those that
    share three digits, else two. codes: country, known, place; of a code's places the first by letters counts."""
    #: Each code is looked up once, however many ask for it.
    every, rest = asked, asked.select("country", "code").distinct()
    codes = stored(codes.groupBy("country", "known").agg(F.min("place").alias("place")))
    hits = rest.join(codes.withColumn("code", F.col("known")), ["country", "code"]).withColumn("tier", F.lit(0))
    for tier, digits in ((1, 3), (2, 2)):
        hits = stored(hits)
        rest = rest.join(hits, ["country", "code"], "left_anti")
        hits = hits.unionByName(_nearest_number(rest, codes, digits).withColumn("tier", F.lit(tier)))
    return every.join(hits.select("country", "code", "tier", "known", "place"), ["country", "code"], "left").select(*every.columns, "tier", "known", "place")


def metro(points: DataFrame, circles: list[tuple[str, float, float, float]], states: dict[str, str], rest: str) -> DataFrame:
    """points with metro: the first circle (name, latitude, longitude, radius) that holds them, else their state's, else rest."""
    inside = [F.when(miles(F.col("latitude"), F.col("longitude"), F.lit(y), F.lit(x)) <= r, name) for name, y, x, r in circles]
    by_state = [F.when(F.col("state") == s, name) for s, name in states.items()]
    return points.withColumn("metro", F.coalesce(*inside, *by_state, F.lit(rest)))
