"""DuckDB SQL for the training-data queries that SQL can express."""
from __future__ import annotations

import hashlib

import regex

from credlake.llm import licences, token_rollup

MIN_WORDS = 50  # op4: shorter documents are deleted by the third batch


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(text: str, tokenizer: str) -> str:
    pattern = token_rollup.TOKENIZERS[tokenizer].replace("\\x0B", "\\x{0B}")
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def token_rollup_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT source, lang, '{name}' AS tokenizer, {_count('kept', name)} AS tokens, strlen(kept) AS bytes FROM d"
        for name in token_rollup.TOKENIZERS)
    # first occurrences of lines, in order
    return f"""
WITH l AS (SELECT doc_id, source, lang, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
d0 AS (SELECT source, lang,
              array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), chr(10)) AS kept FROM l),
d AS (SELECT * FROM d0 WHERE {_count('kept', 'words_v1')} >= {MIN_WORDS})
SELECT source, lang, tokenizer, count(*)::BIGINT AS docs, sum(tokens)::BIGINT AS tokens, sum(bytes)::BIGINT AS bytes
FROM ({parts}) GROUP BY 1, 2, 3"""


def _canonical(lines: str) -> str:
    text = f"regexp_replace(lower({lines}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
    for old, new in licences.SPELLINGS:
        text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    return f"trim({text}, ' ')"


def _digest(form: str) -> str:
    return f"(CASE WHEN {form} <> '' THEN sha256({form}) END)"


def _canonical_text(text: str) -> str:
    return _canonical(f"array_to_string(list_filter(string_split({text}, chr(10)), "
                      f"lambda ln: NOT regexp_matches(lower(substr(ln, 1, 200)), {quoted(licences.COPYRIGHT_LINE)})), ' ')")


def licence_digests() -> list[tuple[str, str, str]]:
    """license_id, scope and digest of the whole catalogue, in plain Python; the texts
    themselves would make a statement of a megabyte."""
    least: dict[tuple[str, str], str] = {}
    for name, scope, body in [*licences.LICENCES, *licences.MORE_TEXTS, *licences.long_texts()]:
        lines = body.split("\n")
        if scope == "text":
            lines = [ln for ln in lines if not regex.search(licences.COPYRIGHT_LINE, ln[:200].lower())]
        form = regex.sub("[^\\p{L}\\p{N}]+", " ", " ".join(lines).lower())
        for old, new in licences.SPELLINGS:
            form = form.replace(old, new)
        form = form.strip(" ")
        if form:
            key = hashlib.sha256(form.encode()).hexdigest(), scope
            least[key] = min(name, least.get(key, name))
    return sorted((name, scope, digest) for (digest, scope), name in least.items())


def licence_sql() -> str:
    known = ", ".join(f"({quoted(i)}, {quoted(s)}, {quoted(d)})" for i, s, d in licence_digests())
    return f"""
WITH k AS (SELECT * FROM (VALUES {known}) AS v(license_id, scope, digest)),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, {_digest('form')} AS digest FROM (SELECT rid, doc_id, {_canonical_text('text')} AS form FROM d)),
n AS (SELECT rid, k.license_id FROM (SELECT rid, {_digest('form')} AS digest FROM (
        SELECT rid, {_canonical('ln')} AS form FROM (SELECT rid, unnest(string_split(text, chr(10))) AS ln FROM d)
        WHERE regexp_matches(lower(ln), {quoted(licences.NOTICE_LINE)}))) x
      JOIN k ON k.digest = x.digest AND k.scope = 'notice'),
g AS (SELECT rid, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices,
             count(DISTINCT license_id)::BIGINT AS n_notices FROM n GROUP BY rid)
SELECT w.doc_id, w.digest, k.license_id, coalesce(g.notices, '') AS notices, coalesce(g.n_notices, 0)::BIGINT AS n_notices
FROM w LEFT JOIN k ON k.digest = w.digest AND k.scope = 'text' LEFT JOIN g ON g.rid = w.rid"""


def decontamination_sql() -> str:
    """Exact windows by their words, joined to every run of as many document words."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
    return f"""
WITH b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS k FROM (
         SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
dw AS (SELECT rid, i, n, w[i:i + n - 1] AS k FROM (
         SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i
         FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
o AS (SELECT dw.rid, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
h AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM o) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item_id) AS n_items,
             string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""


def prefix_trie_sql() -> str:
    """Nodes by the digest of their turns; a node's subtree is the set of nodes whose
    first member passes through it."""
    bits = "list_reduce(list_concat([x], range(8)), lambda s, k: xor(s >> 1, (s & 1) * 3988292384))"
    crc = (f"xor(list_reduce(list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), "
           f"lambda s, b: {bits.replace('[x]', '[xor(s, b)]').replace('lambda s, k', 'lambda t, k').replace('xor(s >> 1, (s & 1)', 'xor(t >> 1, (t & 1)')}), 4294967295)")
    return f"""
WITH o AS (SELECT conv_id, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l, {crc} % 6 AS h
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:o.h], o.l[o.h + 1:]) AS l FROM o LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 100),
p AS (SELECT conv_id, len(l) AS n, d AS depth, md5(l[1:d]::VARCHAR) AS k, CASE WHEN d > 0 THEN md5(l[1:d - 1]::VARCHAR) END AS pk,
             CASE WHEN d > 0 THEN length(l[d].x) ELSE 0 END AS chars FROM r, unnest(range(len(l) + 1)) AS u(d)),
n AS (SELECT depth, k, any_value(pk) AS pk, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256 FROM p GROUP BY depth, k),
c AS (SELECT depth - 1 AS depth, pk AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
f AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c USING (depth, k)),
s AS (SELECT p.depth, p.k, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved_tokens
      FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.depth, p.k)
SELECT f.conv_id, f.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (depth, k) LEFT JOIN n q ON q.depth = f.depth - 1 AND q.k = f.pk"""


ORACLES: dict[str, str] = {
    "op4_token_rollup": token_rollup_sql(),
    "op5_prefix_decontamination": decontamination_sql(),
    "op10_licence_digests": licence_sql(),
    "op12_prefix_trie": prefix_trie_sql(),
}
