"""The registered queries and their SQL: importing this package registers them all in catalogue."""

from . import queries, text, lists, filings, matching, jobs  # noqa: F401, I001
