"""Text expressions (P4 strip, P5, P6-P8, P10, P21)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODEL_TEXT_CHARS = 4000
WS = r"[\s\x1C-\x1F]"
# Python's white space, the characters of (?U)WS one by one
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_ws(col) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends.

    ``F.trim`` alone removes spaces only.  The characters are listed because a pattern
    ``^\\s+|\\s+$`` is tried at every place of the text, and only its ends matter.
    """
    return F.btrim(_c(col), F.lit(SPACES))


def normalize_text(col) -> Column:
    """Control whitespace runs -> one space, collapse runs of 2+ whitespace,
    strip; empty -> null; null -> null."""
    c = F.regexp_replace(_c(col), r"[\r\n\t]+", " ")
    c = F.regexp_replace(c, rf"(?U){WS}{{2,}}", " ")
    c = strip_ws(c)
    return F.nullif(c, F.lit(""))


def title_present(title="title") -> Column:
    """Silver keeps a row only when its title is non-null and non-empty."""
    t = _c(title)
    return t.isNotNull() & (F.length(t) > 0)


def lang_guess(title="title") -> Column:
    """``en`` when the title holds an ASCII letter, else ``other``."""
    return F.when(_c(title).rlike("[A-Za-z]"), F.lit("en")).otherwise(F.lit("other"))


def model_text(title="title", content="content", max_chars: int = MODEL_TEXT_CHARS) -> Column:
    """Classifier input: ``title + ". " + content`` cut to ``max_chars``."""
    joined = F.concat(F.coalesce(_c(title), F.lit("")), F.lit(". "),
                      F.coalesce(_c(content), F.lit("")))
    return F.substring(joined, 1, max_chars)


def truncate(col, n: int, suffix: str = "...") -> Column:
    """Names longer than ``n`` become their first ``n`` chars + ``...``."""
    c = _c(col)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(suffix))).otherwise(c)


def or_default(col, default: str) -> Column:
    """Python ``x or default``: null and empty both take the default."""
    return F.coalesce(F.nullif(_c(col), F.lit("")), F.lit(default))
