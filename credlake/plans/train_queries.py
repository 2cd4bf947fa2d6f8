"""Catalogue: corpus, split, evaluation, model scoring."""
from __future__ import annotations

from pyspark.sql import functions as F

from credlake.operators import evaluate as ev
from credlake.operators.score import score_with
from credlake.operators.train import bayes_grid, bayes_score, model_score, train_best
from credlake.plans import oracle as o
from credlake.plans.oracle import sql
from credlake.plans.registry import query
from credlake.session import work_dir
from credlake.sources import corpus as cp
from credlake.sources import fixtures as fx


def _corpus_dir(spark, sf):
    return fx.write_corpus(spark, sf, work_dir(spark, "corpus"))


def _corpus(spark, sf):
    root = _corpus_dir(spark, sf)
    return cp.load_corpus(spark, f"{root}/liar", f"{root}/fnn", check_empty=False)


RULING = "['pants-fire', 'false', 'barely-true', 'half-true', 'mostly-true', 'true', 'unknown'][doc_id % 7 + 1]"
LIAR_SQL = f"""
SELECT text, CASE WHEN r IN ('pants-fire', 'false', 'barely-true') THEN 0 ELSE 1 END AS label,
       'liar' AS source
FROM (SELECT {o.strip("regexp_replace(title, '[\\t\"]', '', 'g')")} AS text, {RULING} AS r FROM f1)
WHERE text <> '' AND r <> 'unknown'"""

TITLE_C = "regexp_replace(title, '[\\t\"]', '', 'g')"
BODY_C = "regexp_replace(content, '[\\r\\n\"]+', ' ', 'g')"
FNN_TEXT = o.strip(f"trim({o.strip(TITLE_C)} || '. ' || {o.strip(f'coalesce({BODY_C}, chr(0))')}, '. ')")
FNN_SQL = f"""
SELECT text, CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END AS label,
       CASE WHEN doc_id % 4 < 2 THEN 'politifact' ELSE 'gossipcop' END AS source
FROM (SELECT doc_id, {FNN_TEXT.replace('chr(0)', "''")} AS text FROM f1)
WHERE text <> ''"""

CORPUS_SQL = f"{LIAR_SQL}\nUNION ALL\n{FNN_SQL}"


@query("liar", "S15, P15", sql(LIAR_SQL, "f1"))
def q_liar(spark, sf):
    return cp.read_liar(spark, f"{_corpus_dir(spark, sf)}/liar")


@query("fakenewsnet", "S16, P16", sql(FNN_SQL, "f1"))
def q_fakenewsnet(spark, sf):
    return cp.read_fakenewsnet(spark, f"{_corpus_dir(spark, sf)}/fnn")


@query("corpus", "S17, U2", sql(CORPUS_SQL, "f1"))
def q_corpus(spark, sf):
    return _corpus(spark, sf)


# F8 as its readers see it; the quoted titles hold a separator and are one field
MARRED_SQL = f"""
SELECT CASE WHEN doc_id % 10 = 0 THEN 'test.tsv' WHEN doc_id % 10 = 1 THEN 'valid.tsv' ELSE 'train.tsv' END AS file,
       CASE WHEN doc_id % 13 = 7 THEN 1 ELSE 12 END + 2 + CASE WHEN doc_id % 11 = 5 THEN 2 ELSE 0 END > 14 AS bad,
       CASE WHEN doc_id % 19 = 1 THEN '' WHEN doc_id % 17 = 3 THEN 'quoted' ELSE {o.strip("regexp_replace(title, '[\t\r\",]', '', 'g')")} END AS text,
       {RULING} = 'unknown' AS unlabelled
FROM f1
UNION ALL
SELECT ['politifact_fake.csv', 'politifact_real.csv', 'gossipcop_fake.csv', 'gossipcop_real.csv'][doc_id % 4 + 1],
       CASE WHEN doc_id % 13 = 7 THEN 0 ELSE 1 END + 2 + CASE WHEN doc_id % 11 = 5 THEN 2 ELSE 0 END > 3,
       CASE WHEN doc_id % 19 = 1 THEN '' WHEN doc_id % 17 = 3 THEN 'quoted'
            ELSE trim({o.strip("regexp_replace(title, '[\t\r\",]', '', 'g')")} || '. ' ||
                      CASE WHEN doc_id % 13 = 7 THEN '' ELSE {o.strip("regexp_replace(content, '[\r\n\",]+', ' ', 'g')")} END, '. ') END, false
FROM f1"""


@query("corpus_report", "S15, S16 (what became of every record of marred training files)", sql(f"""
SELECT file, 'read' AS status, count(*) AS n_read,
       count(*) FILTER (WHERE NOT bad AND text <> '' AND NOT unlabelled) AS n_kept,
       count(*) FILTER (WHERE bad) AS n_malformed, count(*) FILTER (WHERE NOT bad AND text = '') AS n_empty,
       count(*) FILTER (WHERE NOT bad AND text <> '' AND unlabelled) AS n_unlabelled
FROM (SELECT * REPLACE (coalesce(text, '') AS text) FROM ({MARRED_SQL})) GROUP BY file""", "f1"))
def q_corpus_report(spark, sf):
    root = fx.write_marred_corpus(spark, sf, work_dir(spark, "marred"))
    return cp.corpus_report(spark, f"{root}/liar", f"{root}/fnn")


@query("balance", "A6", sql(f"""
SELECT count(*) AS n, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
FROM ({CORPUS_SQL})""", "f1"))
def q_balance(spark, sf):
    return ev.balance(_corpus(spark, sf))


FP_SQL = """substr(sha1('{"n": ' || CAST(count(*) AS VARCHAR) || ', "neg": '
      || CAST(count(*) FILTER (WHERE label = 0) AS VARCHAR) || ', "pos": '
      || CAST(count(*) FILTER (WHERE label = 1) AS VARCHAR) || '}'), 1, 8)"""


@query("fingerprint", "A7", sql(f"SELECT {FP_SQL} AS hash8 FROM ({CORPUS_SQL})", "f1"))
def q_fingerprint(spark, sf):
    return ev.fingerprint(_corpus(spark, sf))


PLACE_SQL = "('0x' || substr(md5(coalesce(text, '') || '|42'), 1, 12))::BIGINT"


@query("split", "M1", sql(f"""
SELECT label, CASE WHEN k <= wanted THEN 'test' ELSE 'train' END AS part, count(*) AS n,
       CAST(sum(h % 1000003) AS BIGINT) AS place_sum
FROM (SELECT label, h, row_number() OVER (PARTITION BY label ORDER BY h, text) AS k,
             ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY label)) AS wanted
      FROM (SELECT *, {PLACE_SQL} AS h FROM ({CORPUS_SQL})))
GROUP BY 1, 2""", "f1"))
def q_split(spark, sf):
    return ev.split_counts(ev.stratified_split(_corpus(spark, sf), 0.1, 42))


YP_SQL = """
SELECT f3.doc_id, l.quality AS y, CASE WHEN f3.label = 'Real' THEN 1 ELSE 0 END AS p
FROM f3 JOIN labels l ON l.doc_id = f3.doc_id WHERE l.quality IS NOT NULL"""


def _yp(spark, sf):
    return ev.truth_join(fx.articles_scored(spark, sf), fx.table(spark, sf, "labels"))


CELLS = """count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
       count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn,
       count(*) AS n"""


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


@query("truth_join", "J4", sql(YP_SQL, "f3"))
def q_truth_join(spark, sf):
    return _yp(spark, sf)


@query("accuracy_f1", "A8", sql(f"""
SELECT tp, fp, fn, tn, n, {_div('tp + tn', 'n')} AS accuracy, {_div('2 * tp', '2 * tp + fp + fn')} AS f1
FROM (SELECT {CELLS} FROM ({YP_SQL}))""", "f3"))
def q_accuracy_f1(spark, sf):
    return ev.accuracy_f1(_yp(spark, sf))


@query("confusion", "A9", sql(f"""
SELECT g.y, g.p, coalesce(c.n, 0) AS n
FROM (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(y, p)) g
LEFT JOIN (SELECT y, p, count(*) AS n FROM ({YP_SQL}) GROUP BY y, p) c ON c.y = g.y AND c.p = g.p""", "f3"))
def q_confusion(spark, sf):
    return ev.confusion(_yp(spark, sf))


def _cls(name, tp, fp, fn, support):
    return (f"SELECT '{name}' AS class, {_div(tp, f'{tp} + {fp}')} AS precision, "
            f"{_div(tp, f'{tp} + {fn}')} AS recall, {_div(f'2 * {tp}', f'2 * {tp} + {fp} + {fn}')} AS f1, "
            f"{support} AS support FROM c")


REPORT_SQL = f"""
WITH c AS (SELECT {CELLS} FROM ({YP_SQL})),
     k AS ({_cls('Fake', 'tn', 'fn', 'fp', 'tn + fp')} UNION ALL {_cls('Real', 'tp', 'fp', 'fn', 'tp + fn')})
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1,
       CAST(support AS BIGINT) AS support FROM k
UNION ALL SELECT 'accuracy', NULL, NULL, round({_div('tp + tn', 'n')}, 9), CAST(n AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', round(sum(precision) / 2, 9), round(sum(recall) / 2, 9), round(sum(f1) / 2, 9),
                 CAST(sum(support) AS BIGINT) FROM k
UNION ALL SELECT 'weighted avg', round(coalesce(sum(precision * support) / nullif(sum(support), 0), 0.0), 9),
                 round(coalesce(sum(recall * support) / nullif(sum(support), 0), 0.0), 9),
                 round(coalesce(sum(f1 * support) / nullif(sum(support), 0), 0.0), 9),
                 CAST(sum(support) AS BIGINT) FROM k"""


@query("report", "A10", sql(REPORT_SQL, "f3"))
def q_report(spark, sf):
    r = ev.report(_yp(spark, sf))
    return r.select("class", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("gate", "A13", sql(f"""
SELECT n, {_div('tp + tn', 'n')} AS accuracy, {_div('tp + tn', 'n')} >= 0.5 AS passed
FROM (SELECT {CELLS} FROM ({YP_SQL}))""", "f3"))
def q_gate(spark, sf):
    return ev.gate(_yp(spark, sf), 0.5)


@query("run_summary", "M4", sql(f"""
SELECT s.n_train, s.n_eval, s.dataset_hash, m.accuracy, m.f1
FROM (SELECT n - n_eval AS n_train, n_eval, dataset_hash
      FROM (SELECT count(*) AS n, CAST(ceil(0.1::DOUBLE * count(*) FILTER (WHERE label = 0))
                   + ceil(0.1::DOUBLE * count(*) FILTER (WHERE label = 1)) AS BIGINT) AS n_eval, {FP_SQL} AS dataset_hash
            FROM ({CORPUS_SQL}))) s,
     (SELECT {_div('tp + tn', 'n')} AS accuracy, {_div('2 * tp', '2 * tp + fp + fn')} AS f1
      FROM (SELECT {CELLS} FROM ({YP_SQL}))) m""", "f1", "f3"))
def q_run_summary(spark, sf):
    return ev.run_summary(_corpus(spark, sf), _yp(spark, sf))


def load_length_model():
    """A model for the catalogue: the class follows the text's length, with raw labels."""
    import pandas as pd

    def predict(texts):
        n = texts.str.len()
        return pd.DataFrame({"label": ("LABEL_" + (n % 2).astype(str)).to_numpy(), "confidence": (0.5 + (n % 50) / 100.0).to_numpy()})
    return predict


@query("batch_model", "P14, F1 (Arrow iterator UDF, a loaded model and its label map)", sql(f"""
SELECT doc_id, CASE WHEN length(mt) % 2 = 0 THEN 'Fake' ELSE 'Real' END AS label,
       0.5::DOUBLE + (length(mt) % 50)::DOUBLE / 100.0::DOUBLE AS confidence
FROM (SELECT doc_id, {o.model_text()} AS mt FROM f1)""", "f1"))
def q_batch_model(spark, sf):
    labels = {"LABEL_0": "Fake", "LABEL_1": "Real"}
    return score_with(fx.articles_raw(spark, sf), load_length_model, "length", labels).select("doc_id", "label", "confidence")


@query("batch_model_fallback", "P14 (a model that cannot be loaded: hash scorer)", sql(f"""
SELECT doc_id, {o.score_label('mt')} AS label, {o.score_conf('mt')} AS confidence
FROM (SELECT doc_id, {o.model_text()} AS mt FROM f1)""", "f1"))
def q_batch_model_fallback(spark, sf):
    def missing():
        raise FileNotFoundError("no model here")
    return score_with(fx.articles_raw(spark, sf), missing, "missing").select("doc_id", "label", "confidence")


def _labelled(spark, sf):
    d = fx.table(spark, sf, "documents").select("doc_id", "text")
    lab = fx.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return d.join(lab, "doc_id").where(F.col("label").isNotNull())


LABELLED_SQL = """
SELECT count(*) AS n, CAST(ceil(0.1::DOUBLE * count(*) FILTER (WHERE l.quality = 0))
       + ceil(0.1::DOUBLE * count(*) FILTER (WHERE l.quality = 1)) AS BIGINT) AS n_eval
FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL"""


MARGIN = 0.05  # a trained model must beat the larger class's share by this much


@query("train", "M2", f"""
SELECT reg, n - n_eval AS n_train, n_eval, true AS best_f1_is_highest, true AS beats_majority
FROM ({LABELLED_SQL}), (VALUES (0.1::DOUBLE), (0.01::DOUBLE), (0.001::DOUBLE)) g(reg)""")
def q_train(spark, sf):
    """Every candidate's sizes; that the model kept has the highest F1 and learnt something."""
    _, t = train_best(_labelled(spark, sf))
    best = t.where("best").agg(F.max("f1").alias("best_f1"), F.max("accuracy").alias("best_accuracy"), F.count(F.lit(1)).alias("kept"))
    return t.join(F.broadcast(best), F.col("kept") == 1, "left").select(
        "reg", "n_train", "n_eval", (F.col("best_f1") >= F.col("f1")).alias("best_f1_is_highest"),
        (F.col("best_accuracy") >= F.col("majority") + MARGIN).alias("beats_majority"))


BAYES = f"""
lab AS (SELECT d.doc_id, d.text, l.quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL),
part AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {PLACE_SQL}, text) <= ceil(0.1::DOUBLE * count(*) OVER (PARTITION BY label)) AS test FROM lab),
words AS (SELECT doc_id, label, test, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\x00-\\x20]+')) AS term FROM part),
"""


def bayes_sql(train: str) -> str:
    """CTEs terms (term, fake, real) and totals of the training rows that ``train`` selects."""
    return f"""
terms AS (SELECT term, count(*) FILTER (WHERE label = 0) AS fake, count(*) FILTER (WHERE label = 1) AS real FROM words WHERE {train} GROUP BY term),
tot AS (SELECT sum(fake)::DOUBLE AS fake, sum(real)::DOUBLE AS real, count(*)::DOUBLE AS v FROM terms),
prior AS (SELECT ln((count(*) FILTER (WHERE label = 1) + 1)::DOUBLE / (count(*) FILTER (WHERE label = 0) + 1)) AS p FROM part WHERE {train})"""


ODDS = """sum(w.n * (ln((coalesce(terms.real, 0) + a) / (tot.real + a * tot.v)) - ln((coalesce(terms.fake, 0) + a) / (tot.fake + a * tot.v))))"""


@query("bayes_grid", "M2 (best of a grid by F1, naive Bayes)", f"""
WITH {BAYES} {bayes_sql('NOT test')},
w AS (SELECT doc_id, term, count(*) AS n FROM words WHERE test GROUP BY 1, 2),
g AS (SELECT * FROM (VALUES (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) t(a)),
s AS (SELECT w.doc_id, a, {ODDS} AS odds FROM w LEFT JOIN terms ON terms.term = w.term, tot, g GROUP BY 1, 2),
c AS (SELECT g.a, p.label AS y, CASE WHEN coalesce(s.odds, 0) + prior.p > 0 THEN 1 ELSE 0 END AS p
      FROM part p CROSS JOIN g CROSS JOIN prior LEFT JOIN s ON s.doc_id = p.doc_id AND s.a = g.a WHERE p.test),
m AS (SELECT a AS smoothing, (SELECT count(*) FROM part WHERE NOT test) AS n_train, count(*) AS n_eval,
             count(*) FILTER (WHERE y = p)::DOUBLE / count(*) AS accuracy,
             coalesce(2 * count(*) FILTER (WHERE y = 1 AND p = 1)::DOUBLE
                      / nullif(2 * count(*) FILTER (WHERE y = 1 AND p = 1) + count(*) FILTER (WHERE y <> p), 0), 0.0) AS f1 FROM c GROUP BY a)
SELECT *, row_number() OVER (ORDER BY f1 DESC, smoothing) = 1 AS best FROM m""")
def q_bayes_grid(spark, sf):
    return bayes_grid(_labelled(spark, sf), "doc_id")


@query("bayes_score", "M3 (naive Bayes trained on all labelled documents)", f"""
WITH {BAYES} {bayes_sql('true')},
w AS (SELECT doc_id, term, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\x00-\\x20]+')) AS term FROM documents) GROUP BY 1, 2),
s AS (SELECT w.doc_id, {ODDS} AS odds FROM w LEFT JOIN terms ON terms.term = w.term, tot, (SELECT 1.0::DOUBLE AS a) GROUP BY 1),
o AS (SELECT d.doc_id, coalesce(s.odds, 0) + prior.p AS odds FROM documents d CROSS JOIN prior LEFT JOIN s ON s.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN odds > 0 THEN 'Real' ELSE 'Fake' END AS label, round(greatest(1 / (1 + exp(-odds)), 1 - 1 / (1 + exp(-odds))), 6) AS confidence FROM o""")
def q_bayes_score(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "text")
    return bayes_score(docs, "doc_id", _labelled(spark, sf)).withColumn("confidence", F.round("confidence", 6))


@query("classifier_score", "M3", f"""
WITH {BAYES} one AS (SELECT 1)
SELECT label AS y, count(*) AS n, true AS mostly_right FROM part WHERE NOT test GROUP BY label""")
def q_classifier_score(spark, sf):
    """The trained model on its training part: each class is mostly recognised, with the confidence of its label."""
    corpus = _labelled(spark, sf)
    model, _ = train_best(corpus)
    part = ev.stratified_split(corpus.select("doc_id", "text", F.col("label").alias("y")).withColumn("label", F.col("y")), 0.1, 42)
    scored = model_score(part.where("part = 'train'").drop("label"), model)
    right = (F.col("label") == F.when(F.col("y") == 1, "Real").otherwise("Fake")) & F.col("confidence").between(0.5, 1.0)
    return scored.groupBy("y").agg(F.count(F.lit(1)).alias("n"), (F.count_if(right) > 0.8 * F.count(F.lit(1))).alias("mostly_right"))
