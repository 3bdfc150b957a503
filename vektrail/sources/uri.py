"""Store addresses ``scheme://location#collection``, with credentials hidden."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEME = r"^([a-z][a-z0-9+.-]*):"


def _part(col: Column, pattern: str) -> Column:
    got = F.regexp_extract(col, pattern, 1)
    return F.when(got != "", got)


def parsed(rows: DataFrame, col: str) -> DataFrame:
    """``rows`` with scheme, location and collection; null where the address lacks the part."""
    c = F.col(col)
    return rows.withColumns({"scheme": _part(c, _SCHEME), "location": _part(c, r"^[a-z][a-z0-9+.-]*://([^#]*)"), "collection": _part(c, r"#(.*)$")})


def redacted(col: Column) -> Column:
    """User and password of an address, and secret query parameters, replaced by stars."""
    hidden = F.regexp_replace(col, r"://[^/@\s]+@", "://***@")
    return F.regexp_replace(hidden, r"(?i)([?&](?:password|token|api_key|apikey|secret)=)[^&#]*", "$1***")
