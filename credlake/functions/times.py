"""Time expressions (P3, P9, P26, hour buckets).

Spark 4 runs with ANSI on, where ``to_date('garbage')`` raises; every parse
here is a ``try_`` form.  The session time zone must be UTC.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
HOUR_FORMAT = "yyyy-MM-dd'T'HH:00"
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_published(text, fallback) -> Column:
    """ISO-8601 text -> UTC timestamp.

    Offsets are honoured, zone-less text is taken as UTC.  Text that is
    empty, unparsable, or does not start with a calendar date (Spark would
    accept ``2024`` or ``T12:34``) falls back to ``fallback`` -- the row's
    fetch time -- instead of the wall clock.
    """
    t = _c(text)
    parsed = F.when(t.rlike(ISO_DATE_PREFIX), F.try_to_timestamp(t))
    return F.coalesce(parsed, _c(fallback))


def try_date(text) -> Column:
    """Date of ISO text; null when unparsable (never raises)."""
    t = _c(text)
    return F.to_date(F.when(t.rlike(ISO_DATE_PREFIX), F.try_to_timestamp(t)))


def to_iso(ts) -> Column:
    """Timestamp -> ``YYYY-MM-DDTHH:MM:SS+00:00`` (microseconds when present)."""
    c = _c(ts)
    micros = F.date_format(c, "SSSSSS")
    return F.when(c.isNull(), F.lit(None)).otherwise(F.concat(
        F.date_format(c, ISO_SECONDS),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00")))


def hour_bucket(ts) -> Column:
    """``yyyy-MM-ddTHH:00`` in UTC."""
    return F.date_format(_c(ts), HOUR_FORMAT)


def hour_label(hour_text) -> Column:
    """Chart label: the part after ``T`` (``HH:00``), or the text itself."""
    c = _c(hour_text)
    return F.coalesce(F.nullif(F.split_part(c, F.lit("T"), F.lit(2)), F.lit("")), c)
