"""Ratios, trends, currencies and distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_MILES = 3958.8
MILES_PER_DEGREE = 69.0

#: US dollars for one unit of a currency.
USD_PER = {
    "USD": 1.0, "GBP": 1.27, "EUR": 1.08, "CAD": 0.73, "AUD": 0.66, "NZD": 0.60, "PKR": 0.0036, "SEK": 0.095,
    "DKK": 0.145, "NOK": 0.094, "PLN": 0.255, "HUF": 0.0028, "MXN": 0.055, "CNY": 0.14, "HKD": 0.128, "GEL": 0.37,
}


def growth(value: Column, base: Column) -> Column:
    """value over base less one, four places half to even; null unless base is above zero."""
    return F.when(base > 0, F.bround(value.cast("double") / base.cast("double") - 1, 4))


def margin(net: Column, revenue: Column) -> Column:
    return F.when(revenue != 0, F.bround(net.cast("double") / revenue.cast("double"), 4))


def yearly_growth(latest: Column, start: Column, years: int) -> Column:
    """Compound growth a year; null unless both ends are above zero."""
    whole = F.pow(latest.cast("double") / start.cast("double"), F.lit(1.0 / years)) - 1
    return F.when((latest > 0) & (start > 0), F.bround(whole, 4))


def trend(change: Column, net: Column, up: float = 4.0, down: float = -1.0) -> Column:
    """Down for a loss; Flat without a figure; otherwise by percent thresholds."""
    return (
        F.when(net < 0, "Down").when(change.isNull(), "Flat").when(change * 100 > up, "Up").when(change * 100 < down, "Down").otherwise("Flat")
    )


def usd_rate(currency: Column) -> Column:
    """Dollars for one unit; one for a currency without a rate."""
    rates = F.create_map(*[F.lit(x) for pair in USD_PER.items() for x in pair])
    return F.coalesce(F.try_element_at(rates, F.upper(currency)), F.lit(1.0))


def convert(amount: Column, of: Column, to: Column) -> Column:
    """Amounts in another currency are whole units; in their own they stay as they are."""
    other = F.bround(amount.cast("double") * usd_rate(of) / usd_rate(to), 0)
    return F.when(F.upper(of) == F.upper(to), amount.cast("double")).otherwise(other)


def miles(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    """Great-circle distance."""
    h = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), F.lit(2.0)) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(F.radians(lng_b - lng_a) / 2), F.lit(2.0)
    )
    return F.lit(2 * EARTH_MILES) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def box(latitude: float, longitude: float, radius: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) around a point: what a scan can be pruned by before distances are computed."""
    lat = radius / MILES_PER_DEGREE
    lng = radius / (MILES_PER_DEGREE * max(0.01, math.cos(math.radians(latitude))))
    return latitude - lat, latitude + lat, longitude - lng, longitude + lng


def yearly_pay(rate: Column, unit: Column) -> Column:
    """A wage as a whole yearly amount, from text such as "$45.50" and its unit; null where either is unknown."""
    amount = F.regexp_replace(rate, r"[$,]", "").try_cast("double")
    times = F.create_map(*[F.lit(x) for pair in {"year": 1, "hour": 2080, "week": 52, "bi-weekly": 26, "month": 12}.items() for x in pair])
    return F.when(amount > 0, F.bround(amount * F.try_element_at(times, F.lower(F.trim(unit))), 0))


def unit_factor(revenue: Column, net: Column, eps: Column, shares: Column, market_cap: Column) -> Column:
    """1000 if a statement's figures are a thousandth of what earnings a share times shares, or the market's value, say; else 1."""
    by_share = F.when((eps != 0) & (shares > 0) & (net != 0), F.abs(eps * shares / net))
    by_market = F.when((market_cap > 0) & (revenue > 0), market_cap / revenue)
    return F.when(by_share.between(600, 1700), 1000).when(by_share.isNull() & (by_market > 5000), 1000).otherwise(1)


def last_days(days: int | None, today: Column) -> tuple[Column, Column]:
    """The first and last day of a report over so many days up to today; 30 if none are asked for, 1 at least, 400 at most."""
    n = 30 if days is None else max(1, min(400, days))
    return F.date_sub(today, n - 1), today
