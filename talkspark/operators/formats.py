"""Training rows from pairs, style and model dimensions, and their inverse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Styles with their control tokens and instructions; models with their row format and hub id.
STYLES = {
    "casual": ("<style:casual>", "Rewrite the input into natural casual spoken English. Preserve the meaning, use conversational phrasing, and avoid sounding like a formal written essay."),
    "semi_formal": ("<style:semi_formal>", "Rewrite the input into clear semi-formal spoken English suitable for an English speaking test. Preserve the meaning and make it sound spoken, but keep it organized and not overly casual."),
}
MODELS = {
    "gemma4-e4b": ("chat", "unsloth/gemma-4-E4B-it-unsloth-bnb-4bit"),
    "gemma4-e2b": ("chat", "unsloth/gemma-4-E2B-it-unsloth-bnb-4bit"),
    "t5gemma2-270m": ("seq2seq", "google/t5gemma-2-270m-270m"),
    "t5gemma2-1b": ("seq2seq", "google/t5gemma-2-1b-1b"),
    "t5gemma2-4b": ("seq2seq", "google/t5gemma-2-4b-4b"),
    "qwen3-4b": ("chat", None),
    "qwen3-1.7b": ("chat", None),
}
INPUT_MARK, OUTPUT_MARK = "Input:\n", "\n\nOutput:"
# End of fixed values.


def style_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in STYLES.items()], "style string, style_token string, instruction string")


def model_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in MODELS.items()], "model string, format string, hub_id string")


def model_format(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"no model {model!r}; there are {', '.join(sorted(MODELS))}")
    return MODELS[model][0]


def hub_id(model: str) -> str:
    model_format(model)
    if MODELS[model][1] is None:
        raise ValueError(f"model {model!r} has no hub id")
    return MODELS[model][1]


def build_input(formal: Column, token: Column, instruction: Column) -> Column:
    return F.concat(token, F.lit("\n"), instruction, F.lit("\n\n" + INPUT_MARK), formal, F.lit(OUTPUT_MARK))


def extract_formal(wrapped: Column) -> Column:
    """The text between the first marks, stripped; to the end without the second, null without the first."""
    start = F.locate(INPUT_MARK, wrapped)
    body = F.substring(wrapped, start + len(INPUT_MARK), F.char_length(wrapped))
    end = F.locate(OUTPUT_MARK, body)
    cut = F.when(end > 0, F.substring(body, F.lit(1), end - 1)).otherwise(body)
    return F.when(start > 0, F.regexp_replace(cut, r"(?U)^\s+|\s+$", ""))


def format_pairs(pairs: DataFrame, kind: str) -> DataFrame:
    """Chat rows (messages) or seq2seq rows (input, target), with ``split`` where the pairs have it. A style that isn't known is an error, raised when the row is read."""
    known = F.create_map(*[x for k, (t, i) in STYLES.items() for x in (F.lit(k), F.struct(F.lit(t).alias("token"), F.lit(i).alias("instruction")))])[F.col("style")]
    rows = pairs.withColumn("_s", F.when(known.isNull(), F.raise_error(F.concat(F.lit("no style "), F.coalesce("style", F.lit("null"))))).otherwise(known))
    wrapped = build_input(F.col("formal_text"), F.col("_s.token"), F.col("_s.instruction"))
    meta = ["pair_id", "source", "style", "speaker", "monologue_id", F.col("_s.token").alias("style_token"), F.col("metadata").alias("source_metadata"), *(["split"] if "split" in pairs.columns else [])]
    if kind == "chat":
        say = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
        return rows.select(F.array(say("user", wrapped), say("assistant", F.col("spoken_text"))).alias("messages"), *meta)
    if kind == "seq2seq":
        return rows.select(wrapped.alias("input"), F.col("spoken_text").alias("target"), *meta)
    raise ValueError(f"no format {kind!r}")


def format_manifest(formatted: DataFrame, model: str, source: str) -> DataFrame:
    """One row: the stage, model and format, where the pairs came from, rows a split, the style tokens and the styles that occur."""
    each = formatted.groupBy("split", "style").agg(F.count(F.lit(1)).alias("n"))
    rows = each.groupBy("split").agg(F.sum("n").alias("n"), F.collect_set("style").alias("styles"))
    tokens = F.create_map(*[F.lit(x) for k, (t, _) in sorted(STYLES.items()) for x in (k, t)])
    return rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("counts"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("styles")))).alias("styles_present")).select(F.lit("finetune_format").alias("stage"), F.lit(model).alias("model_key"), F.lit(model_format(model)).alias("format"), F.lit(source).alias("source_splits"), "counts", tokens.alias("style_tokens"), "styles_present")
