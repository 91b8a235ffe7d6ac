"""Command line: the stages as tables under a data folder, each one Spark job over all stems.

Stage tables are Parquet, partitioned by source: parsed, cleaned, monologues, pairs. A stage
reads the one before it; --stems and --limit narrow it. Exit codes: 0, 1 (nothing found or failed), 2 (usage).
"""

from __future__ import annotations

import argparse
import importlib
import sys
import urllib.request
import uuid
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkspark.operators import clients, evaluate, formats, pairs, split, stats, turns
from talkspark.sources import archives, files

STAGES = ("parse", "clean", "monologue", "pairs", "stats")


def _write(rows: DataFrame, path: str) -> int:
    """One source's rows replace those of before; other sources stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)
    return 0


def _table(spark: SparkSession, a: argparse.Namespace, name: str) -> DataFrame:
    source = files.CORPORA[a.corpus].source
    rows = spark.read.parquet(f"{a.data_dir}/{name}").where(F.col("source") == source)
    return rows.where(F.col("stem").isin(*a.stems)) if a.stems else rows


def _callable(name: str) -> Callable:
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run_download(spark: SparkSession, a: argparse.Namespace) -> int:
    fetch = _callable(a.fetcher) if a.fetcher else lambda url: urllib.request.urlopen(url).read()  # noqa: S310
    print(f"{len(archives.download(a.corpus, a.url, a.dest, fetch, a.force))} files")
    return 0


def run_parse(spark: SparkSession, a: argparse.Namespace) -> int:
    corpus = files.CORPORA[a.corpus]
    found = files.read_whole(spark, a.input)
    if a.corpus == "ami":
        meetings = files.read_whole(spark, a.meetings) if a.meetings else spark.createDataFrame([], "file string, content string")
        rows = corpus.parse(found, files.nxt_speakers(meetings))
    else:
        rows = corpus.parse(found)
    rows = rows.where(F.col("stem").isin(*a.stems)) if a.stems else rows
    _write(rows, f"{a.data_dir}/parsed")
    written = _table(spark, a, "parsed")
    if written.isEmpty():
        print("no utterances found", file=sys.stderr)
        return 1
    # stems that were asked for and aren't there, and those with files that can't be read: the others are written
    missing = [(s, "no input") for s in sorted(set(a.stems) - {r[0] for r in written.select("stem").distinct().collect()})] if a.stems else []
    failed = [(r["stem"], f"{r['agent']}: {r['error']}") for r in files.nxt_failures(found).collect()] if a.corpus == "ami" else []
    broken = {s for s, _ in failed}
    a.failed = failed + [x for x in missing if x[0] not in broken]
    spark.createDataFrame(a.failed, "stem string, error string").withColumn("source", F.lit(corpus.source)).coalesce(1).write.mode("overwrite").json(f"{a.data_dir}/failed/{corpus.source}")
    for stem, error in a.failed:
        print(f"{stem} failed: {error}", file=sys.stderr)
    return 0


def run_clean(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _table(spark, a, "parsed").withColumn("text_raw", F.col("text"))
    return _write(files.clean(rows, files.CORPORA[a.corpus].cleaner), f"{a.data_dir}/cleaned")


def run_monologue(spark: SparkSession, a: argparse.Namespace) -> int:
    return _write(turns.build_monologues(_table(spark, a, "cleaned"), lexicon=files.CORPORA[a.corpus].backchannels, min_tokens=a.min_tokens), f"{a.data_dir}/monologues")


def run_sample(spark: SparkSession, a: argparse.Namespace) -> int:
    kinds = split.stem_types(_table(spark, a, "parsed").withColumn("meeting_type", F.nullif(F.get_json_object("metadata", "$.meeting_type"), F.lit(""))))
    rows = _table(spark, a, "monologues").join(kinds, "stem", "left")
    rows = rows.withColumn("pos", F.struct("stem", "seq"))
    return _write(split.sample_balanced(rows, a.target, a.seed).drop("pos"), f"{a.data_dir}/{a.output_subdir}")


def _cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; only a folder that isn't there is an empty cache."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], pairs.CACHE_SCHEMA)
    return spark.read.schema(pairs.CACHE_SCHEMA).parquet(path)


def _storing(spark: SparkSession, path: str, use: bool) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(the cache, a store that adds answers to it before they are used): no call is made twice, whatever fails later."""
    cache = _cache(spark, path) if use else spark.createDataFrame([], pairs.CACHE_SCHEMA)

    def store(answers: DataFrame) -> DataFrame:
        new = f"{path}-asked/{uuid.uuid4().hex}"
        answers.write.parquet(new)
        kept = spark.read.schema(answers.schema).parquet(new)
        kept.where("response is not null").select("key", "response", "call").write.mode("append").parquet(path)
        return kept

    return cache, store


def run_pairs(spark: SparkSession, a: argparse.Namespace) -> int:
    """Pairs, and with --repunct their spoken side re-punctuated; both have a cache of their own."""
    rows = _table(spark, a, a.monologues_subdir)
    rows = turns.first_per_stem(rows, a.limit) if a.limit else rows
    cache, store = _storing(spark, f"{a.data_dir}/cache/pairs", not a.no_cache)
    made, _ = pairs.to_pairs(rows.withColumn("_stem", F.col("stem")), cache, pairs.patient(_client(a.client, a.model)), model=a.model, alias=a.model_alias, version=a.prompt_version, style=a.style, store=store)
    if a.repunct:
        cache, store = _storing(spark, f"{a.data_dir}/cache/repunct", not a.no_cache)
        made, _ = pairs.repunctuate_pairs(made, cache, pairs.patient(_client(a.repunct, a.model)), model=a.model, alias=a.model_alias, store=store)
    return _write(made.withColumn("stem", F.substring_index("monologue_id", "#", 1)), f"{a.data_dir}/pairs")


def _client(name: str, model: str) -> Callable:
    """A callable by its place (module:name), or ``openai``: an endpoint that the environment names."""
    return clients.ChatClient(model) if name == "openai" else _callable(name)


def run_stats(spark: SparkSession, a: argparse.Namespace) -> int:
    files.write_summary(stats.pair_statistics(_table(spark, a, "pairs")), f"{a.data_dir}/stats/{files.CORPORA[a.corpus].source}")
    return 0


def run_aggregate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _table(spark, a, "pairs")
    n = files.write_jsonl(rows.repartitionByRange("stem", "pair_id").sortWithinPartitions("stem", "pair_id"), f"{a.data_dir}/aggregate/{files.CORPORA[a.corpus].source}")
    print(f"{n} pairs")
    return 0


def run_split(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = _table(spark, a, "pairs").withColumn("pos", F.struct("stem", "pair_id"))
    ratios = (a.train_ratio, a.validation_ratio, a.test_ratio)
    done = split.split_by_speaker(rows, ratios, a.seed).drop("pos")
    done.write.mode("overwrite").partitionBy("split").json(a.output)
    files.write_summary(split.split_manifest(spark.read.json(a.output), ratios, a.seed), f"{a.output}/_MANIFEST")
    return 0


def run_format(spark: SparkSession, a: argparse.Namespace) -> int:
    """A folder of rows for each split, as it is in the input, and a manifest."""
    rows = spark.read.schema(files.PAIR_SCHEMA + ", split string").json(a.input).withColumn("split", F.coalesce("split", F.lit("all")))
    formats.format_pairs(rows, formats.model_format(a.model)).write.mode("overwrite").partitionBy("split").json(a.output)
    written = spark.read.schema("style string, split string").json(a.output)
    files.write_summary(formats.format_manifest(written, a.model, a.input), f"{a.output}/_MANIFEST")
    return 0


def run_spokenness(spark: SparkSession, a: argparse.Namespace) -> int:
    model, metrics = evaluate.train_spokenness(spark.read.schema(files.PAIR_SCHEMA).json(a.input), seed=a.seed)
    model.write().overwrite().save(a.output)
    print(metrics)
    return 0


def run_generate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.json(a.input)
    rows = rows.limit(a.limit) if a.limit else rows
    made = evaluate.generate(rows, _callable(a.generator), a.batch_size)
    made.select("pair_id", "style", "speaker", "input", F.col("target").alias("reference"), "prediction").write.mode("overwrite").json(a.output)
    return 0


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = spark.read.schema("pair_id string, style string, speaker string, input string, reference string, prediction string").json(a.input)
    if rows.isEmpty():
        print("no predictions", file=sys.stderr)
        return 1
    files.write_summary(evaluate.evaluate(rows), f"{a.output}/metrics")
    if a.spokenness_model:
        model = PipelineModel.load(a.spokenness_model)
        score = lambda r, body, out: evaluate.score_spokenness(r, body, model, out)
        files.write_summary(evaluate.spoken_shift(rows, score), f"{a.output}/spokenness")
    return 0


def run_plot(spark: SparkSession, a: argparse.Namespace) -> int:
    history = spark.read.schema("step long, loss double, eval_loss double").json(a.input).withColumn("pos", F.monotonically_increasing_id())
    files.write_summary(evaluate.loss_series(history), a.output)
    return 0


def run_train(spark: SparkSession, a: argparse.Namespace) -> int:
    print("fine-tuning needs accelerators and isn't part of this engine; `format` writes what a trainer reads", file=sys.stderr)
    return 2


def run_all(spark: SparkSession, a: argparse.Namespace) -> int:
    """All stems go through the stages together; stems that fail are left out and told, and the others are finished."""
    for stage in STAGES[: STAGES.index(a.through) + 1]:
        if code := COMMANDS[stage](spark, a):
            print(f"{stage} failed", file=sys.stderr)
            return code
    if a.failed:
        print(f"{len({s for s, _ in a.failed})} stems failed", file=sys.stderr)
    return 1 if a.failed else 0


COMMANDS: dict[str, Callable[[SparkSession, argparse.Namespace], int]] = {
    "download": run_download, "parse": run_parse, "clean": run_clean, "monologue": run_monologue, "sample": run_sample, "pairs": run_pairs, "stats": run_stats, "aggregate": run_aggregate,
    "split": run_split, "spokenness-train": run_spokenness, "format": run_format, "train": run_train, "generate": run_generate, "evaluate": run_evaluate, "plot": run_plot, "run": run_all,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("talkspark", description=__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("corpus", nargs="?", choices=sorted(files.CORPORA))
    p.add_argument("--stems", nargs="*", default=[])
    for flag, default in (("data-dir", "data"), ("input", None), ("output", None), ("meetings", None), ("url", None), ("dest", None), ("fetcher", None), ("client", None), ("repunct", None), ("generator", None), ("model", "model"), ("model-alias", None), ("prompt-version", pairs.PROMPT_VERSION), ("style", pairs.STYLE), ("monologues-subdir", "monologues"), ("output-subdir", "sampled"), ("spokenness-model", None)):
        p.add_argument(f"--{flag}", default=default)
    for flag, default in (("min-tokens", turns.MIN_TOKENS), ("target", 2000), ("seed", 42), ("limit", 0), ("batch-size", 8)):
        p.add_argument(f"--{flag}", type=int, default=default)
    for flag, default in (("train-ratio", 0.8), ("validation-ratio", 0.1), ("test-ratio", 0.1)):
        p.add_argument(f"--{flag}", type=float, default=default)
    p.add_argument("--through", choices=STAGES, default="monologue")
    p.add_argument("--force", action="store_true")
    p.add_argument("--no-cache", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    a.failed = []
    if a.corpus is None and a.command not in ("format", "train", "generate", "evaluate", "plot", "spokenness-train"):
        print("name a corpus", file=sys.stderr)
        return 2
    return COMMANDS[a.command](spark or SparkSession.builder.appName("talkspark").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
