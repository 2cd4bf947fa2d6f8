"""DuckDB SQL for the fixtures of FIXTURES.md, used by the oracle queries.

Each fixture is a CTE over the pre-registered driver views.  ``sql(...)``
stitches the CTEs a query needs in dependency order.
"""
from __future__ import annotations

NL = "chr(10)"

# Unicode whitespace as Python's str.strip() sees it (RE2 \s is ASCII only).
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def iso(expr: str) -> str:
    return f"(strftime({expr}, '%Y-%m-%dT%H:%M:%S') || '+00:00')"


def md5_byte(expr: str, i: int) -> str:
    return f"(('0x' || substr(md5({expr}), {2 * i + 1}, 2))::INTEGER)"


def model_text(title: str = "title", content: str = "content") -> str:
    return f"substr(coalesce({title}, '') || '. ' || coalesce({content}, ''), 1, 4000)"


def score_label(text: str) -> str:
    return f"(CASE WHEN {md5_byte(text, 1)} % 2 = 0 THEN 'Fake' ELSE 'Real' END)"


def score_conf(text: str) -> str:
    return f"round(0.5::DOUBLE + {md5_byte(text, 0)}::DOUBLE / 255.0::DOUBLE * 0.49::DOUBLE, 4)"


CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte("f1", [], f"""
SELECT doc_id,
       substr(sha1(('https://news.example/' || substr(md5(text), 1, 16)) || '||'
                   || split_part(text, {NL}, 1)), 1, 24) AS id,
       (CASE WHEN doc_id % 2 = 0 THEN 'newsapi:' ELSE 'gnews:' END) || source AS source,
       split_part(text, {NL}, 1) AS title,
       substr(text, length(split_part(text, {NL}, 1)) + 2) AS content,
       'https://news.example/' || substr(md5(text), 1, 16) AS url,
       TIMESTAMP '2024-01-01' + to_seconds(doc_id * 420) AS published_at,
       TIMESTAMP '2024-01-01' + to_seconds(doc_id * 420 + (doc_id % 60) * 60) AS fetched_at
FROM documents""")

cte("f1t", ["f1"], f"""
SELECT doc_id, id, source, title, content, url,
       {iso('published_at')} AS published_at, {iso('fetched_at')} AS fetched_at
FROM f1""")

cte("silver_all", ["f1"], """
SELECT doc_id, id, source, trim(title) AS title, coalesce(trim(content), '') AS content, url,
       published_at, fetched_at, 'en' AS lang_guess, CAST(published_at AS DATE) AS date
FROM f1
WHERE title IS NOT NULL AND length(title) > 0 AND regexp_matches(trim(title), '[A-Za-z]')""")

cte("silver", ["silver_all"], """
SELECT * FROM silver_all
QUALIFY row_number() OVER (PARTITION BY id ORDER BY fetched_at, doc_id) = 1""")

cte("f3", ["silver"], f"""
SELECT doc_id, id, source, title, content, url, published_at, fetched_at, date,
       {score_label('mt')} AS label, {score_conf('mt')} AS confidence,
       fetched_at + to_seconds(5 + doc_id % 26) AS scored_at
FROM (SELECT *, {model_text()} AS mt FROM silver)""")

cte("f4", ["f3"], """
SELECT doc_id, id, source, title, NULL::VARCHAR AS content, url, published_at, fetched_at, date,
       CASE WHEN label = 'Fake' THEN 'Real' ELSE 'Fake' END AS label,
       round(1.49::DOUBLE - confidence, 4) AS confidence,
       scored_at + INTERVAL 1 DAY AS scored_at
FROM f3 WHERE doc_id % 5 = 0
UNION ALL
SELECT doc_id, id, source, title || ' (updated)', NULL::VARCHAR, url, published_at, fetched_at, date,
       label, NULL::DOUBLE, scored_at + INTERVAL 2 DAY
FROM f3 WHERE doc_id % 15 = 0
UNION ALL
SELECT doc_id, substr(sha1('new:' || id), 1, 24), source, title, content, url, published_at,
       fetched_at, date, label, confidence, scored_at + INTERVAL 3 DAY
FROM f3 WHERE doc_id % 100 = 3""")

cte("as_of", ["f3"], "SELECT max(scored_at) AS as_of FROM f3")


def sql(body: str, *needs: str) -> str:
    """``WITH`` the CTEs in ``needs`` (and their dependencies) + ``body``."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body.strip()
    withs = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":  # the body's own CTEs follow the fixtures
        return f"WITH {withs},\n{body[5:]}"
    return f"WITH {withs}\n{body}"


def lit(s: str) -> str:
    """A SQL string literal (newlines kept verbatim, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def template(tpl: str, **exprs: str) -> str:
    """DuckDB twin of functions.display.fill_template."""
    parts: list[str] = []
    rest = tpl
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(lit(rest[:i]))
        parts.append(f"coalesce(CAST({exprs[rest[i + 1:j]]} AS VARCHAR), '')")
        rest = rest[j + 1:]
    return "(" + " || ".join(parts) + ")"


def pct0(expr: str) -> str:
    return f"(CAST(CAST(round_even({expr} * 100, 0) AS BIGINT) AS VARCHAR) || '%')"


def pct1(expr: str) -> str:
    n = f"CAST(round({expr} * 10000, 0) AS BIGINT)"
    q = f"({n} // 10)"
    r = f"({n} - {q} * 10)"
    tenths = f"({q} + CASE WHEN {r} > 5 OR ({r} = 5 AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
    return f"(CAST({tenths} // 10 AS VARCHAR) || '.' || CAST({tenths} % 10 AS VARCHAR) || '%')"


def or_default(expr: str, default: str) -> str:
    return f"coalesce(nullif({expr}, ''), {lit(default)})"


def truncate(expr: str, n: int) -> str:
    return f"(CASE WHEN length({expr}) > {n} THEN substr({expr}, 1, {n}) || '...' ELSE {expr} END)"
