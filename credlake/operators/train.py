"""Distributed text classifier (M2, M3).

The reference fine-tunes a transformer on one GPU; here the same (text, label)
contract trains a ``pyspark.ml`` pipeline -- tokenizer, hashed term
frequencies, IDF, logistic regression -- that fits and scores on the
executors.  Scoring returns the P14 contract: label Fake/Real + confidence.

Like the reference, which keeps the epoch of the best F1 on the evaluation
part, :func:`train_best` fits a grid of settings on the train part of the M1
split and keeps the model of the best F1.  :func:`bayes_grid` does the same with a
naive Bayes classifier made of joins and grouped sums alone: its vocabulary is a
table, so it never reaches the driver, and any SQL engine can recompute it.
"""
from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credlake.operators.evaluate import accuracy_f1, stratified_split

NUM_FEATURES = 1 << 18


def classifier_pipeline(max_iter: int = 20, reg: float = 0.01) -> Pipeline:
    return Pipeline(stages=[
        # words, and runs of marks: they tell shouting and junk
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\w+|[^\w\s]+", gaps=False, toLowercase=True),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=NUM_FEATURES),
        IDF(inputCol="tf", outputCol="features", minDocFreq=2),
        LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg),
    ])


def train_classifier(corpus: DataFrame, test_fraction: float = 0.1, seed: int = 42,
                     max_iter: int = 20) -> tuple[PipelineModel, DataFrame]:
    """M2: fit on the train part of the stratified split; metrics on the test part."""
    data = stratified_split(corpus.select("text", F.col("label").cast("double").alias("label")), test_fraction, seed)
    model = classifier_pipeline(max_iter).fit(data.where(F.col("part") == "train"))
    pred = model.transform(data.where(F.col("part") == "test"))
    yp = pred.select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    m = accuracy_f1(yp).select("accuracy", "f1", F.col("n").alias("n_eval_scored"))
    sizes = data.agg(F.count_if(F.col("part") == "train").alias("n_train"),
                     F.count_if(F.col("part") == "test").alias("n_eval")).first()
    # the two sizes are plain numbers; attach them as literals
    row = m.select(F.lit(sizes["n_train"]).cast("long").alias("n_train"),
                   F.lit(sizes["n_eval"]).cast("long").alias("n_eval"), "accuracy", "f1")
    return model, row


GRID = ({"reg": 0.1}, {"reg": 0.01}, {"reg": 0.001})


def train_best(corpus: DataFrame, grid=GRID, test_fraction: float = 0.1, seed: int = 42, max_iter: int = 20) -> tuple[PipelineModel, DataFrame]:
    """M2: of the settings in ``grid``, the model with the best F1 on the test part.

    Returns it with one row per candidate: reg, n_train, n_eval, accuracy, f1,
    majority (share of the larger class in the test part) and best.  Token
    frequencies and document frequencies are fitted once; ties go to the earlier
    candidate."""
    data = stratified_split(corpus.select("text", F.col("label").cast("double").alias("label")), test_fraction, seed)
    train, test = (data.where(F.col("part") == part) for part in ("train", "test"))
    *features, _ = classifier_pipeline().getStages()
    shared = Pipeline(stages=features).fit(train)
    prepared, held = shared.transform(train).select("label", "features").persist(), shared.transform(test).select("label", "features").persist()
    rows, models = [], []
    for setting in grid:
        model = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=setting["reg"]).fit(prepared)
        m = accuracy_f1(model.transform(held).select(F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))).first()
        larger = max(m["tp"] + m["fn"], m["tn"] + m["fp"]) / max(m["n"], 1)
        rows.append((setting["reg"], prepared.count(), m["n"], m["accuracy"], m["f1"], larger))
        models.append(model)
    best = max(range(len(rows)), key=lambda k: (rows[k][4], -k))
    prepared.unpersist()
    held.unpersist()
    table = corpus.sparkSession.createDataFrame([(*r, k == best) for k, r in enumerate(rows)],
                                                "reg double, n_train long, n_eval long, accuracy double, f1 double, majority double, best boolean")
    return PipelineModel(stages=[*shared.stages, models[best]]), table


# -- naive Bayes as joins and grouped sums -----------------------------------

TERM = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x00-\x20]+"  # words, and runs of marks
SMOOTHING = (0.1, 1.0, 10.0)


def term_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, term, n): how often each term occurs."""
    terms = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    return rows.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def bayes_terms(train: DataFrame) -> DataFrame:
    """(term, fake, real): occurrences in training texts by class (label 0 / 1)."""
    return term_counts(train, ["label"]).groupBy("term").agg(
        *(F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(name) for k, name in ((0, "fake"), (1, "real"))))


def bayes_log_odds(rows: DataFrame, key: str, train: DataFrame, terms: DataFrame, smoothing=SMOOTHING) -> DataFrame:
    """(key, one column ``odds_k`` per smoothing): log odds of Real for every row.

    p(term | class) = (n + a) / (all + a * vocabulary); p(class) from the training
    rows.  Only class totals reach the driver; rows without terms have the prior."""
    t = terms.agg(F.sum("fake").alias("fake"), F.sum("real").alias("real"), F.count(F.lit(1)).alias("v")).first()
    c = train.agg(F.count_if(F.col("label") == 0).alias("fake"), F.count_if(F.col("label") == 1).alias("real")).first()
    prior = math.log((c["real"] + 1) / (c["fake"] + 1))
    known = term_counts(rows, [key]).join(terms, "term", "left")

    def odds(a: float):
        real, fake = (F.log((F.coalesce(name, F.lit(0)) + a) / F.lit((t[name] or 0) + a * t["v"])) for name in ("real", "fake"))
        return F.sum(F.col("n") * (real - fake))
    sums = known.groupBy(key).agg(*(odds(a).alias(f"odds_{k}") for k, a in enumerate(smoothing)))
    return rows.select(key).join(sums, key, "left").select(
        key, *((F.coalesce(f"odds_{k}", F.lit(0.0)) + F.lit(prior)).alias(f"odds_{k}") for k in range(len(smoothing))))


def bayes_grid(corpus: DataFrame, key: str, smoothing=SMOOTHING, test_fraction: float = 0.1, seed: int = 42) -> DataFrame:
    """One row per smoothing: n_train, n_eval, accuracy, f1 on the test part of M1, and whether it is the best.

    The best F1 wins; ties go to the earlier smoothing."""
    data = stratified_split(corpus.select(key, "text", F.col("label").cast("int").alias("label")), test_fraction, seed)
    train, test = (data.where(F.col("part") == part) for part in ("train", "test"))
    odds = bayes_log_odds(test, key, train, bayes_terms(train), smoothing).join(test.select(key, "label"), key)
    cells = odds.select(F.col("label").alias("y"), F.explode(F.array(*(
        F.struct(F.lit(float(a)).alias("smoothing"), (F.col(f"odds_{k}") > 0).cast("int").alias("p")) for k, a in enumerate(smoothing)))).alias("c"))
    y, p = F.col("y"), F.col("c.p")
    rows = cells.groupBy("c.smoothing").agg(
        F.count(F.lit(1)).alias("n_eval"), F.count_if(y == p).alias("right"), F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if(y != p).alias("wrong")).select(
        "smoothing", F.lit(train.count()).alias("n_train"), "n_eval", (F.col("right") / F.col("n_eval")).alias("accuracy"),
        F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")), F.lit(0.0)).alias("f1"))
    first = F.row_number().over(Window.orderBy(F.desc("f1"), "smoothing"))  # a row per smoothing
    return rows.withColumn("best", first == 1)


def bayes_score(df: DataFrame, key: str, train: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """M3 with the naive Bayes model: (key, label, confidence)."""
    odds = bayes_log_odds(df, key, train, bayes_terms(train), [smoothing])
    real = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("odds_0")))
    return odds.select(key, F.when(F.col("odds_0") > 0, F.lit("Real")).otherwise(F.lit("Fake")).alias("label"),
                       F.greatest(real, 1 - real).alias("confidence"))


def model_score(df: DataFrame, model: PipelineModel, text_col: str = "text") -> DataFrame:
    """M3: score a table (or stream) with the fitted model: label + confidence."""
    scored = model.transform(df.withColumnRenamed(text_col, "text") if text_col != "text" else df)
    prob = vector_to_array(F.col("probability"))
    out = scored.withColumn("label", F.when(F.col("prediction") == 1.0, F.lit("Real")).otherwise(F.lit("Fake"))) \
                .withColumn("confidence", F.array_max(prob))
    return out.drop("tokens", "tf", "features", "rawPrediction", "probability", "prediction")
