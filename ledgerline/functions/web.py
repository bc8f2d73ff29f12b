"""Visitors, user agents and addresses as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a user agent says, first match first.
SYSTEMS = [
    ("iOS", ["iphone", "ipad", "ipod"]), ("Android", ["android"]), ("ChromeOS", ["cros"]), ("Windows", ["windows"]),
    ("macOS", ["macintosh", "mac os x"]), ("Linux", ["linux"]),
]
BROWSERS = [
    ("Edge", ["edg/", "edga/", "edgios/"]), ("Opera", ["opr/", "opera"]), ("Samsung Internet", ["samsungbrowser/"]),
    ("Firefox", ["firefox/", "fxios/"]), ("Chrome", ["crios/", "chrome/"]), ("Safari", ["safari/"]),
]
BOTS = (
    r"bot\b|bot/|crawl|spider|slurp|facebookexternalhit|embedly|preview|headless|lighthouse|pingdom|uptime|monitor|"
    r"curl/|wget/|python|httpclient|okhttp|go-http|java/|axios/|node-fetch|undici|postman|insomnia|scrapy|phantomjs|"
    r"selenium|playwright|puppeteer"
)


def _says(agent: Column, parts: list[str]) -> Column:
    return reduce(Column.__or__, [agent.contains(p) for p in parts])


def _first(agent: Column, table: list[tuple[str, list[str]]]) -> Column:
    return F.coalesce(*[F.when(_says(agent, parts), name) for name, parts in table], F.lit("Other"))


def user_agent(agent: Column) -> Column:
    """struct(device, browser, os, is_bot); an empty agent is a script."""
    low, blank = F.lower(agent), F.coalesce(F.trim(agent), F.lit("")) == ""
    tablet = _says(low, ["ipad", "tablet"]) | (low.contains("android") & ~low.contains("mobile"))
    device = F.when(tablet, "Tablet").when(_says(low, ["mobi", "iphone"]), "Phone").otherwise("Desktop")
    unknown = lambda c: F.when(blank, "Unknown").otherwise(c)
    return F.struct(unknown(device).alias("device"), unknown(_first(low, BROWSERS)).alias("browser"),
                    unknown(_first(low, SYSTEMS)).alias("os"), (blank | low.rlike(BOTS)).alias("is_bot"))


def referrer_host(address: Column, own: str) -> Column:
    """The host that a visitor came from, without www.; null for the site itself and for what is no web address."""
    host = F.lower(F.regexp_extract(address, r"^(?i:https?)://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when((host != "") & (host != own) & ~F.lit(own).endswith(F.concat(F.lit("."), host)), host)


def path_only(path: Column) -> Column:
    return F.when(path.startswith("/"), F.regexp_replace(path, r"[?#].*$", ""))


def visitor_hash(salt: Column, fingerprint: Column) -> Column:
    """32 hexadecimal digits that a day's salt and a fingerprint make; another day gives another hash."""
    return F.substring(F.sha2(F.concat_ws("|", salt, fingerprint), 256), 1, 32)


def event_day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")
