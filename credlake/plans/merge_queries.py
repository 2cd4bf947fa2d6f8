"""Catalogue: keyed upserts."""
from __future__ import annotations

from credlake.operators import merge as mg
from credlake.plans.oracle import sql
from credlake.plans.registry import query
from credlake.sources import fixtures as fx

COLS = ["doc_id", "source", "title", "content", "url", "published_at", "fetched_at", "date",
        "label", "confidence", "scored_at"]

FOLD_SQL = "SELECT id, " + ", ".join(
    f"arg_max({c}, scored_at) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in COLS
) + " FROM f4 GROUP BY id"

MERGE_SQL = sql(f"""
SELECT coalesce(u.id, t.id) AS id, {", ".join(f"coalesce(u.{c}, t.{c}) AS {c}" for c in COLS)}
FROM f3 t FULL OUTER JOIN ({FOLD_SQL}) u ON t.id = u.id""", "f3", "f4")


@query("merge", "S12, J5", MERGE_SQL)
def q_merge(spark, sf):
    return mg.merge_articles(fx.articles_scored(spark, sf), fx.updates(spark, sf))


@query("merge_shuffled", "S12, J5 (updates dealt over many partitions first)", MERGE_SQL)
def q_merge_shuffled(spark, sf):
    return mg.merge_articles(fx.articles_scored(spark, sf), fx.updates(spark, sf).repartition(7, "scored_at"))


CHANGED = " OR ".join(f"(coalesce(u.{c}, t.{c}) IS DISTINCT FROM t.{c})" for c in COLS)


@query("merge_counts", "A14", sql(f"""
SELECT count(*) FILTER (WHERE t.id IS NOT NULL) AS matched,
       count(*) FILTER (WHERE t.id IS NOT NULL AND ({CHANGED})) AS modified,
       count(*) FILTER (WHERE t.id IS NULL) AS upserted
FROM ({FOLD_SQL}) u LEFT JOIN f3 t ON t.id = u.id""", "f3", "f4"))
def q_merge_counts(spark, sf):
    return mg.merge_counts(fx.articles_scored(spark, sf), fx.updates(spark, sf))


@query("insert_new", "S12c", sql(f"""
SELECT id, {", ".join(COLS)} FROM f3
UNION ALL
SELECT * FROM (SELECT id, {", ".join(COLS)} FROM f4
               WHERE id NOT IN (SELECT id FROM f3)
               QUALIFY row_number() OVER (PARTITION BY id ORDER BY scored_at) = 1)""", "f3", "f4"))
def q_insert_new(spark, sf):
    return mg.insert_new(fx.articles_scored(spark, sf), fx.updates(spark, sf))
