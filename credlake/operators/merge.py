"""Keyed upserts of scored articles.

Semantics (document-store ``$set`` + upsert): an update sets the fields it
carries; a null / missing field keeps the stored value; an unknown id is
inserted.  Several updates of one id in one batch fold per field to the
latest *non-null* value in ``seq`` order.

Scale notes
-----------
* The fold is a ``groupBy(id)`` with ``max_by`` -- partially aggregated on
  the map side, so one id carrying a third of all updates is combined
  before the shuffle.
* Every operator is one plan; which side of a join is broadcast, if any, is
  left to the optimizer and to AQE, by the sizes they see.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """Ids that occur more than once (the unique-index audit)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _seq(seq_cols: Sequence[str | Column]) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in seq_cols])


def fold_updates(updates: DataFrame, key: str = "id",
                 seq_cols: Sequence[str | Column] = ("scored_at",)) -> DataFrame:
    """Per id and per field: the last non-null value in ``seq`` order."""
    seq = _seq(seq_cols)
    cols = [c for c in updates.columns if c != key]
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), seq)).alias(c) for c in cols]
    return updates.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def _columns(target: DataFrame, folded: DataFrame, key: str) -> list[str]:
    cols = [c for c in target.columns if c != key]
    return cols + [c for c in folded.columns if c != key and c not in cols]


def merge_folded(target: DataFrame, folded: DataFrame, key: str = "id") -> DataFrame:
    """Apply already-folded updates to ``target``: one full outer join by key."""
    cols = _columns(target, folded, key)

    def merged(c: str) -> Column:
        sides = [F.col(f"{s}.{c}") for s, df in (("u", folded), ("t", target)) if c in df.columns]
        return F.coalesce(*sides).alias(c)

    joined = target.alias("t").join(folded.alias("u"), F.col(f"t.{key}") == F.col(f"u.{key}"), "full_outer")
    order = [*target.columns, *[c for c in cols if c not in target.columns]]
    return joined.select(F.coalesce(F.col(f"u.{key}"), F.col(f"t.{key}")).alias(key), *[merged(c) for c in cols]).select(*order)


def merge_articles(target: DataFrame, updates: DataFrame, key: str = "id",
                   seq_cols: Sequence[str | Column] = ("scored_at",)) -> DataFrame:
    """Field-level upsert of ``updates`` into ``target`` keyed on ``key``."""
    return merge_folded(target, fold_updates(updates, key, seq_cols), key)


def merge_counts(target: DataFrame, updates: DataFrame, key: str = "id",
                 seq_cols: Sequence[str | Column] = ("scored_at",)) -> DataFrame:
    """Matched / modified / upserted ids of one update batch.

    Counted per id after the fold (the store counts per operation).
    """
    folded = fold_updates(updates, key, seq_cols)
    cols = [c for c in folded.columns if c != key and c in target.columns]
    # only stored rows of this batch's ids matter
    stored = target.select(key, *cols).join(updates.select(key).distinct(), key, "left_semi")
    j = folded.alias("u").join(stored.withColumn("_hit", F.lit(1)).alias("t"), key, "left")
    present = F.col("_hit").isNotNull()
    changed = F.lit(False)
    for c in cols:
        new = F.coalesce(F.col(f"u.{c}"), F.col(f"t.{c}"))
        changed = changed | ~new.eqNullSafe(F.col(f"t.{c}"))
    return j.agg(F.count_if(present).alias("matched"),
                 F.count_if(present & changed).alias("modified"),
                 F.count_if(~present).alias("upserted"))


def insert_new(target: DataFrame, updates: DataFrame, key: str = "id",
               seq_cols: Sequence[str | Column] = ("scored_at",)) -> DataFrame:
    """First write wins -- rows whose id is already stored are ignored;
    within the batch the earliest (``seq``) row per id is inserted."""
    from credlake.operators.clean import first_per_key

    firsts = first_per_key(updates.where(F.col(key).isNotNull()), [key], list(seq_cols))
    return target.unionByName(new_only(target, firsts, key).select(*target.columns))


def new_only(target: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a (small) batch whose key is not stored yet.

    The stored keys are first cut to the batch's own by a semi-join; the
    anti-join then runs between two small sets.
    """
    hit = target.select(key).join(batch.select(key), key, "left_semi")
    return batch.join(hit, key, "left_anti")
