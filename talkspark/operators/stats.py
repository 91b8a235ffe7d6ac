"""Distributions, pair statistics and style separation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.functions import counts

# Which style is expected to have more of a feature, and which features decide.
CASUAL_HIGHER = {"filler_rate": True, "pause_rate": True, "tokens_per_sentence": False, "phrasal_verb_ratio": True, "lexical_density": False, "tokens": None}
VERDICT_FEATURES = ("filler_rate", "tokens_per_sentence", "phrasal_verb_ratio", "lexical_density")
COLLAPSE = 0.2
# End of fixed values.


def unpivot(rows: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """(keys, metric, value). Word arrays that several measures need should be columns of the rows: expressions are repeated."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in measures.items()])
    return rows.select(*keys, F.inline(pairs))


def distributions(long: DataFrame, keys: list[str], totals: str | None = None) -> DataFrame:
    """(keys, metric, n, min, max, mean, median); exact medians from counted values, so that no group's rows meet in one task.

    totals: a key for which a row over all of its values is added, with null.
    """
    counted = long.groupBy(*keys, "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    if totals:
        counted = counted.withColumn(totals, F.explode(F.array(F.col(totals), F.lit(None))))
        counted = counted.groupBy(*keys, "metric", "value").agg(F.sum("n").alias("n"))
    return counted.groupBy(*keys, "metric").agg(F.sum("n").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.percentile("value", F.lit(0.5), F.col("n")).alias("median"))


def with_words(rows: DataFrame, **texts: Column) -> DataFrame:
    """The rows with the words of each text as a column."""
    return rows.withColumns({name: counts.tokens(body) for name, body in texts.items()})


def pair_measures(spoken: Column, formal: Column) -> dict[str, Column]:
    """Measures of spoken_text and of both texts' words."""
    return {
        "spoken.tokens": F.size(spoken),
        "spoken.fillers": counts.filler_count(spoken),
        "spoken.pause_short": counts.pause_count(F.col("spoken_text"), "short"),
        "spoken.pause_long": counts.pause_count(F.col("spoken_text"), "long"),
        "formal.tokens": F.size(formal),
        "formal.fillers": counts.filler_count(formal),
        "reduction_ratio": counts.rate(F.size(formal), F.size(spoken)),
    }


More = Callable[[Column], dict[str, Column]]


def pair_statistics(pairs: DataFrame, keys: tuple[str, ...] = ("source", "stem"), more: More | None = None) -> DataFrame:
    """Distributions by stem and, with a null stem, by corpus. ``more`` adds features of each side's text (parts of speech)."""
    rows = with_words(pairs, _spoken=F.col("spoken_text"), _formal=F.col("formal_text"))
    measures = pair_measures(F.col("_spoken"), F.col("_formal"))
    if more:
        measures |= {f"{side}.{k}": v for side in ("spoken", "formal") for k, v in more(F.col(f"{side}_text")).items()}
    return distributions(unpivot(rows, list(keys), measures), list(keys), totals=keys[-1])


def speakers(pairs: DataFrame, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """(keys, n_pairs, n_unique_speakers, speakers); speakers are a dimension."""
    each = pairs.groupBy(*keys, "speaker").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy(*keys).agg(F.sum("n").alias("n_pairs"), F.count(F.lit(1)).alias("n_unique_speakers"), F.array_sort(F.collect_list("speaker")).alias("speakers"))


def style_separation(rows: DataFrame, text: str = "text", verdict: tuple[str, ...] = VERDICT_FEATURES, more: More | None = None) -> DataFrame:
    """rows: style (casual or semi_formal) and a text. A row a feature: means, Cohen's d, expectation, and the verdict over all.

    A group without rows is an error, raised when the result is read.
    """
    rows = rows.where(F.col("style").isin("casual", "semi_formal")).withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    measures = counts.surface_features(F.col("_body"), F.col("_words")) | (more(F.col("_body")) if more else {})
    long = unpivot(with_words(rows, _words=F.col("_body")), ["style"], measures)
    by = long.groupBy("metric").pivot("style", ["casual", "semi_formal"]).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    na, nb = F.coalesce(F.col("casual_n"), F.lit(0)), F.coalesce(F.col("semi_formal_n"), F.lit(0))
    pooled = F.when((na >= 2) & (nb >= 2), ((na - 1) * F.col("casual_var") + (nb - 1) * F.col("semi_formal_var")) / (na + nb - 2))
    d = F.when(pooled > 0, (F.col("semi_formal_mean") - F.col("casual_mean")) / F.sqrt(pooled)).otherwise(F.lit(0.0))
    higher = F.create_map(*[x for k, v in CASUAL_HIGHER.items() if v is not None for x in (F.lit(k), F.lit(v))])[F.col("metric")]
    out = by.withColumn("cohens_d", F.when((na > 0) & (nb > 0), d).otherwise(F.raise_error(F.lit("both styles need texts"))))
    out = out.withColumn("matches_expected", F.when(higher.isNotNull(), F.when(higher, F.col("cohens_d") < 0).otherwise(F.col("cohens_d") > 0)))
    out = out.withColumn("used_for_verdict", F.col("metric").isin(*verdict))
    every = W.partitionBy()  # a row a feature
    out = out.withColumn("max_abs_d", F.coalesce(F.max(F.when(F.col("used_for_verdict"), F.abs("cohens_d"))).over(every), F.lit(0.0))).withColumn("max_abs_d_all", F.max(F.abs("cohens_d")).over(every))
    expected = F.when(higher, F.lit("casual_higher")).when(~higher, F.lit("semi_formal_higher"))
    return out.select(F.col("metric").alias("feature"), "casual_mean", "semi_formal_mean", "cohens_d", expected.alias("expected"), "matches_expected", "used_for_verdict", "max_abs_d", "max_abs_d_all", (F.col("max_abs_d") < COLLAPSE).alias("collapsed"))
