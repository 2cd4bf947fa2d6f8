"""The named query catalogue: every SURVEY operator that yields a table.

Importing this package registers all queries; ``queries()`` and
``oracle_sql()`` expose them to ``__spark_entry__``.
"""
from __future__ import annotations

from credlake.plans.registry import REGISTRY


def _load() -> None:
    from credlake.plans import stats_queries  # noqa: F401
    for mod in ("column_queries", "feed_queries", "merge_queries", "envelope_queries",
                "stream_queries", "train_queries", "serving_queries"):
        try:
            __import__(f"credlake.plans.{mod}")
        except ModuleNotFoundError as exc:  # module not written yet
            if exc.name != f"credlake.plans.{mod}":
                raise


def queries():
    _load()
    return {n: e.build for n, e in REGISTRY.items()}


def oracle_sql():
    _load()
    return {n: e.oracle for n, e in REGISTRY.items() if e.oracle}


def entries():
    _load()
    return dict(REGISTRY)
