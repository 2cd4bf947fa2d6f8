"""Article identity."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 24


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stable_id(url, title) -> Column:
    """First 24 hex chars of sha1(url || "||" || title); title as given (untrimmed)."""
    return F.substring(F.sha1(F.concat(_c(url), F.lit("||"), _c(title))), 1, ID_LENGTH)


def title_id(title) -> Column:
    """First 24 hex chars of sha256(title) -- the demo store's id rule."""
    return F.substring(F.sha2(_c(title), 256), 1, ID_LENGTH)
