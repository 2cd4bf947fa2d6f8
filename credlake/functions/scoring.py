"""Scoring expressions (P11, P12, P13) -- all native Column expressions.

The deterministic scorer runs inside whole-stage codegen: no Python worker,
no Arrow hop, so it scales with the executors like any projection.
"""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from credlake.functions.text import model_text

FAKE, REAL = "Fake", "Real"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest_byte(hex_digest: Column, i: int) -> Column:
    """Byte ``i`` (0-based) of a hex digest as an int 0..255."""
    return F.conv(F.substring(hex_digest, 2 * i + 1, 2), 16, 10).cast("int")


def default_score(text) -> Column:
    """Hash scorer: md5 of the text; confidence = round(0.5 + b0/255*0.49, 4)
    in [0.5, 0.99]; Fake iff byte 1 is even.  Returns struct(label, confidence)."""
    d = F.md5(F.coalesce(_c(text), F.lit("")))
    conf = F.round(F.lit(0.5) + digest_byte(d, 0).cast("double") / F.lit(255.0) * F.lit(0.49), 4)
    label = F.when(digest_byte(d, 1) % 2 == 0, F.lit(FAKE)).otherwise(F.lit(REAL))
    return F.struct(label.alias("label"), conf.alias("confidence"))


def score_article(title="title", content="content") -> Column:
    """Default scorer over the model text of an article."""
    return default_score(model_text(title, content))


def label_rule(raw) -> Column:
    """Fake when the upper-cased label contains FAKE or equals "0", else Real."""
    u = F.upper(_c(raw))
    return F.when(u.contains("FAKE") | (u == "0"), F.lit(FAKE)).otherwise(F.lit(REAL))


def normalize_label(raw, mapping: Mapping[str, str] | Column | None = None) -> Column:
    """Model label -> Fake/Real.

    With a mapping (a dict or a map column): ``mapping[raw]``, or ``raw`` itself
    when absent.  Without: :func:`label_rule` (so ``LABEL_0`` is Real).
    """
    r = _c(raw)
    if isinstance(mapping, Column) or mapping:
        m = mapping if isinstance(mapping, Column) else F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
        return F.coalesce(F.try_element_at(m, r), r)
    return F.when(r.isNull(), F.lit(None)).otherwise(label_rule(r))


def label_map(names) -> Column:
    """Map column of raw model labels to Fake/Real, each by :func:`label_rule`."""
    return F.create_map(*[part for name in sorted(set(names)) for part in (F.lit(name), label_rule(F.lit(name)))])


def softmax_argmax(logits, id2label: dict[int, str], mapping: Mapping[str, str] | Column | None = None) -> Column:
    """Softmax over a logits array, first maximum wins.

    Returns struct(label, confidence) where label = normalised ``id2label[argmax]``
    and confidence = the soft-max probability of that class (= 1 / sum(exp(x - max))).
    """
    lg = _c(logits)
    mx = F.array_max(lg)
    denom = F.aggregate(F.transform(lg, lambda x: F.exp(x - mx)), F.lit(0.0), lambda a, x: a + x)
    idx = F.array_position(lg, mx) - 1
    names = F.create_map(*[F.lit(x) for k, v in sorted(id2label.items()) for x in (k, v)])
    raw = F.try_element_at(names, idx.cast("int"))
    return F.struct(normalize_label(raw, mapping).alias("label"),
                    (F.lit(1.0) / denom).alias("confidence"))
