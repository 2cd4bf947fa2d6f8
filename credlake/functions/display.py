"""Display and explanation text (P20-P24, P26) as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credlake.functions.text import or_default, truncate
from credlake.functions.times import to_iso

# ---------------------------------------------------------------------------
# These strings must equal the reference's output text exactly.
# ---------------------------------------------------------------------------
EXPLAIN_FAKE = (
    "**Classification: {label} ({pct} confidence)**\n\n"
    "This article was flagged by the RoBERTa model based on several indicators:\n\n"
    "1. **Sensationalist Language**: The headline uses emotionally charged phrasing "
    "commonly associated with misinformation.\n\n"
    "2. **Source Credibility**: The source \"{source}\" has patterns consistent "
    "with unreliable content distribution.\n\n"
    "3. **Unverified Claims**: The article makes extraordinary claims without providing "
    "verifiable evidence or credible citations.\n\n"
    "4. **Missing Attribution**: Key claims rely on unnamed or anonymous sources.\n\n"
    "**Recommendation**: Cross-reference with established news sources before sharing."
)
EXPLAIN_REAL = (
    "**Classification: {label} ({pct} confidence)**\n\n"
    "This article was classified as genuine based on several factors:\n\n"
    "1. **Professional Tone**: The writing follows standard journalistic practices "
    "with objective, measured language.\n\n"
    "2. **Source Attribution**: Claims are attributed to named, verifiable sources.\n\n"
    "3. **Factual Consistency**: The content aligns with established facts and "
    "can be corroborated through independent sources.\n\n"
    "4. **Source Credibility**: \"{source}\" is recognized as a reliable "
    "news organization."
)
SUMMARY = (
    "This article titled \"{title}\" was published by {source}. "
    "The RoBERTa classification model determined it to be {label} "
    "with {pct} confidence. {preview}"
)
EXPLAIN_PROMPT = (
    "**Classification**: {label} (confidence: {pct1})\n\n"
    "**Source**: {source}\n\n"
    "**Title**: {title}\n\n"
    "**Content** (first 800 chars):\n{content800}"
)
SUMMARY_PROMPT = (
    "**Title**: {title}\n\n"
    "**Content**:\n{content1500}"
)
UNKNOWN_SOURCE = "an unknown source"
UNKNOWN_SOURCE_PROMPT = "Unknown"
TEMPLATE_MODEL = "demo-fallback"
DEFAULT_CATEGORY = "News"
SUMMARY_CHARS = 200
PREVIEW_CHARS = 200
EXPLAIN_PROMPT_CHARS = 800
SUMMARY_PROMPT_CHARS = 1500
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fill_template(template: str, **cols: Column) -> Column:
    """Render ``{name}`` placeholders with Columns via one ``concat``."""
    parts: list[Column] = []
    rest = template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(cols[rest[i + 1:j]].cast("string"), F.lit("")))
        rest = rest[j + 1:]
    return F.concat(*parts)


def pct0(conf) -> Column:
    """Python ``f"{c:.0%}"``: whole percent, half-even on c*100."""
    return F.concat(F.bround(_c(conf) * 100, 0).cast("long").cast("string"), F.lit("%"))


def pct1(conf) -> Column:
    """``f"{c:.1%}"`` for four-decimal confidences, in exact integers:
    n = round(c*10000); tenths = n/10 rounded half-even."""
    n = F.round(_c(conf) * 10000, 0).cast("long")
    q = F.floor(n / 10).cast("long")
    r = n - q * 10
    tenths = q + F.when((r > 5) | ((r == 5) & (q % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%"))


def summary_snippet(content) -> Column:
    """First 200 chars of content + ``...`` when longer; '' for null."""
    c = _c(content)
    return F.when(c.isNull(), F.lit("")).otherwise(
        F.concat(F.substring(c, 1, SUMMARY_CHARS),
                 F.when(F.length(c) > SUMMARY_CHARS, F.lit("...")).otherwise(F.lit(""))))


def display_columns(category=None) -> list[Column]:
    """Front-end projection of a scored article (P20)."""
    cat = F.lit(DEFAULT_CATEGORY) if category is None else or_default(category, DEFAULT_CATEGORY)
    return [
        F.col("id"),
        F.col("title"),
        F.col("source"),
        F.coalesce(F.col("published_at"), F.col("fetched_at")).alias("publishedAt"),
        F.when(F.col("label") == "Fake", F.lit("FAKE")).otherwise(F.lit("REAL")).alias("classification"),
        F.col("confidence"),
        cat.alias("category"),
        summary_snippet("content").alias("summary"),
        F.col("url"),
        F.coalesce(F.col("scored_at"), F.col("fetched_at")).alias("processedAt"),
        F.coalesce(F.col("content"), F.lit("")).alias("content"),
        truncate("source", 15).alias("source_badge"),
    ]


def explanation_text(label="label", confidence="confidence", source="source") -> Column:
    """Template explanation; Fake wording when the label is fake (any case)."""
    kw = dict(label=_c(label), pct=pct0(confidence), source=_c(source))
    return F.when(F.lower(_c(label)) == "fake", fill_template(EXPLAIN_FAKE, **kw)) \
        .otherwise(fill_template(EXPLAIN_REAL, **kw))


def summary_text(title="title", source="source", label="label", confidence="confidence",
                 content="content") -> Column:
    """Template summary; preview = first 200 chars of content, else the title."""
    c = _c(content)
    preview = F.when(c.isNull() | (c == ""), _c(title)).otherwise(F.substring(c, 1, PREVIEW_CHARS))
    return fill_template(SUMMARY, title=_c(title), source=or_default(source, UNKNOWN_SOURCE),
                         label=_c(label), pct=pct0(confidence), preview=preview)


def explain_prompt(title="title", source="source", label="label", confidence="confidence",
                   content="content") -> Column:
    return fill_template(EXPLAIN_PROMPT, label=_c(label), pct1=pct1(confidence),
                         source=or_default(source, UNKNOWN_SOURCE_PROMPT), title=_c(title),
                         content800=F.substring(F.coalesce(_c(content), F.lit("")), 1,
                                                EXPLAIN_PROMPT_CHARS))


def summary_prompt(title="title", source="source", label="label", confidence="confidence",
                   content="content") -> Column:
    return fill_template(SUMMARY_PROMPT, title=_c(title),
                         content1500=F.substring(F.coalesce(_c(content), F.lit("")), 1,
                                                 SUMMARY_PROMPT_CHARS))


def iso_columns(df, names) -> list[Column]:
    """Outgoing rows: timestamp columns rendered as ISO text."""
    ts_types = {"timestamp", "timestamp_ntz"}
    out = []
    for f in df.schema.fields:
        if f.name in names and f.dataType.simpleString() in ts_types:
            out.append(to_iso(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return out
