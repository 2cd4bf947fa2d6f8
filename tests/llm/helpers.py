"""Plain-Python versions of the training-data operators, to compare with."""
from __future__ import annotations

import collections
import re

import duckdb

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string"


def rows_of(sf_dir: str, table: str, columns: str):
    return duckdb.connect().execute(f"SELECT {columns} FROM read_parquet('{sf_dir}/{table}.parquet')").fetchall()


def jaccard_components(docs: list[tuple[int, str | None]], size: int = 5):
    """doc_id -> (set size, component id), all pairs by an inverted index."""
    sets = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[doc] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = collections.defaultdict(list)
    for d in sorted(sets):
        common = collections.Counter()
        for s in sets[d]:
            common.update(lists[s])
            lists[s].append(d)
        for o, k in common.items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[o]) - k):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items, window: int = 10):
    """doc_id -> (n_words, n_hit, sorted item ids as strings)."""
    wanted = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[i:i + n])].add(str(item))
    sizes = {len(k) for k in wanted}
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if owners := wanted.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out[doc] = (len(w), len(hit), sorted(found))
    return out
