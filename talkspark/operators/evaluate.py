"""Measures of predictions: surface features against references, and shifts of P(spoken)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkspark.functions import counts, text
from talkspark.operators.formats import extract_formal
from talkspark.operators.stats import distributions, unpivot, with_words


def item_measures(body: Column, words: Column) -> dict[str, Column]:
    chars = {"commas": ",", "questions": "?", "periods": ".", "exclaims": "!"}
    return {
        "tokens": F.size(words),
        "fillers": counts.filler_count(words),
        "pause_short": counts.pause_count(body, "short"),
        "pause_long": counts.pause_count(body, "long"),
        **{k: counts.char_count(body, c) for k, c in chars.items()},
        "space_before_punct": counts.space_before_punctuation(body),
    }


def evaluate(predictions: DataFrame) -> DataFrame:
    """(side, metric, n, min, max, mean, median): predictions and references, and side ``ratio`` with the length ratio."""
    rows = predictions.select(F.coalesce("prediction", F.lit("")).alias("p"), F.coalesce("reference", F.lit("")).alias("r"))
    rows = with_words(rows, pw=F.col("p"), rw=F.col("r"))
    one = lambda side, measures: F.array(*[F.struct(F.lit(side).alias("side"), F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in measures.items()])
    ratio = {"length_pred_over_ref": counts.rate(F.size("pw"), F.size("rw")), "empty_prediction": (F.regexp_replace("p", r"(?U)\s+", "") == "").cast("int")}
    sides = F.concat(one("prediction", item_measures(F.col("p"), F.col("pw"))), one("reference", item_measures(F.col("r"), F.col("rw"))), one("ratio", ratio))
    return distributions(rows.select(F.inline(sides)), ["side"])


FEATURES = ("filler_rate", "tokens_per_sentence", "contraction_rate")


def with_features(rows: DataFrame, body: str, more: Callable[[Column], dict[str, Column]] | None = None, prefix: str = "") -> DataFrame:
    """The rows with the surface features of a text column; ``more`` adds others (parts of speech) where a tagger is at hand."""
    rows = rows.withColumn("_body", F.coalesce(F.col(body), F.lit("")))
    rows = with_words(rows, _words=F.col("_body"))
    found = counts.surface_features(F.col("_body"), F.col("_words"))
    features = {k: found[k] for k in ("filler_rate", "tokens_per_sentence")} | {"contraction_rate": counts.contraction_rate(F.col("_body"), F.col("_words"))} | (more(F.col("_body")) if more else {})
    return rows.withColumns({prefix + k: v for k, v in features.items()}).drop("_body", "_words")


def train_spokenness(pairs: DataFrame, features: tuple[str, ...] = FEATURES, seed: int = 42, more: Callable[[Column], dict[str, Column]] | None = None) -> tuple[PipelineModel, dict]:
    """A logistic regression of spoken against formal text on standardised features, and its quality on a fifth held out.

    The fifth is of pairs, so both labels have equal shares in both parts. Without a tagger (``more``) it has three of the six
    features, so it is a model of surface features. The scaler divides by the sample's deviation; the penalty makes up
    for it, so that the model is that of features divided by the population's.
    """
    sides = F.array(F.struct(F.col("spoken_text").alias("body"), F.lit(1.0).alias("label")), F.struct(F.col("formal_text").alias("body"), F.lit(0.0).alias("label")))
    rows = with_features(pairs.select("pair_id", F.inline(sides)), "body", more)
    n = rows.count()
    if not n:
        raise ValueError("no pairs to train on")
    held = F.pmod(F.xxhash64(F.lit(seed), "pair_id"), F.lit(5)) == 0

    def fit(part: DataFrame, size: int) -> PipelineModel:
        return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(regParam=max(size - 1, 1) / max(size, 1) ** 2, standardization=False, maxIter=1000)]).fit(part)

    part, rest = rows.where(~held), rows.where(held)
    model = fit(part, part.count())
    scored = model.transform(rest)
    metrics = {"n_samples": n, "holdout_accuracy": MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored), "holdout_auc": BinaryClassificationEvaluator().evaluate(scored), "coefficients": dict(zip(features, model.stages[-1].coefficients.tolist(), strict=True))}
    return fit(rows, n), metrics


def logistic_score(rows: DataFrame, body: str, weights: dict[str, float], bias: float, out: str = "p_spoken", more: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """P(spoken) from given weights of raw features, within codegen."""
    z = sum((F.col(f"_f_{k}") * w for k, w in weights.items()), F.lit(bias))
    return with_features(rows, body, more, "_f_").withColumn(out, 1 / (1 + F.exp(-z))).select(*[f"`{c}`" for c in rows.columns if c != out], out)


def score_spokenness(rows: DataFrame, body: str, model: PipelineModel, out: str = "p_spoken", more: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """P(spoken) by a trained model, its scaling folded into the weights."""
    assembler, scaler, classifier = model.stages
    scales = [(c, m, s) for c, m, s in zip(classifier.coefficients, scaler.mean, scaler.std, strict=True)]
    weights = {k: float(c / s) if s else 0.0 for k, (c, _, s) in zip(assembler.getInputCols(), scales, strict=True)}
    bias = float(classifier.intercept) - sum(float(c * m / s) if s else 0.0 for c, m, s in scales)
    return logistic_score(rows, body, weights, bias, out, more)


def spoken_shift(predictions: DataFrame, score: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """(style, metric, n, min, ...): P(spoken) of inputs, predictions and references and the shift; style null: all."""
    rows = predictions.withColumn("_in", F.coalesce(extract_formal(F.coalesce("input", F.lit(""))), "input", F.lit("")))
    rows = score(score(score(rows, "_in", "p_in"), "prediction", "p_out"), "reference", "p_ref")
    long = unpivot(rows, ["style"], {"input": F.col("p_in"), "prediction": F.col("p_out"), "delta": F.col("p_out") - F.col("p_in"), "reference": F.col("p_ref")})
    return distributions(long, ["style"], totals="style")


def loss_series(history: DataFrame) -> DataFrame:
    """(series, step, loss, pos) of a training log; rows without step or loss go, eval_loss comes first."""
    series = F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")
    return history.where("step is not null").select(series.alias("series"), "step", F.coalesce("eval_loss", "loss").alias("loss"), "pos").where("series is not null")


def generate(rows: DataFrame, make: Callable[[list[str]], list[str]], batch: int = 8) -> DataFrame:
    """The rows with ``prediction`` by an injected generator, in batches, punctuation normalised."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        values = prompts.fillna("").tolist()
        return pd.Series([x for i in range(0, len(values), batch) for x in make(values[i : i + batch])])

    return rows.withColumn("prediction", text.normalize_punctuation(run(F.col("input"))))
