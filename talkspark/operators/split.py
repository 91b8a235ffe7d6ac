"""Splits and samples that keep speakers whole."""

from __future__ import annotations

import heapq
import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Speakers that the greedy plan handles on the driver; beyond it, the caller chooses the plan by hash.
MOST_SPEAKERS = 1_000_000
SPLITS = ("train", "validation", "test")


def _check_ratios(ratios: tuple[float, ...]) -> None:
    if min(ratios) <= 0:
        raise ValueError("each ratio must be above 0")
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"the ratios add up to {sum(ratios)}, not 1")


def speaker_sizes(rows: DataFrame, order: str = "pos") -> DataFrame:
    return rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))


def plan_splits(sizes: list[tuple[str, int]], ratios: tuple[float, ...], seed: int) -> dict[str, str]:
    """sizes: (speaker, rows) as first seen. The largest speaker goes first, each to the split that has the least of its share; the seed orders equals."""
    rows = dict(sizes)
    order = [speaker for speaker, _ in sizes]
    random.Random(seed).shuffle(order)
    order.sort(key=lambda speaker: -rows[speaker])
    # (how full, place, rows) of each split; of equally full ones the first is next
    shares = [(0.0, i, 0) for i in range(len(SPLITS))]
    plan, total = {}, sum(rows.values())
    for speaker in order:
        _, i, held = shares[0]
        plan[speaker] = SPLITS[i]
        heapq.heapreplace(shares, ((held + rows[speaker]) / (total * ratios[i]), i, held + rows[speaker]))
    return plan


def split_by_speaker(rows: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42, order: str = "pos") -> DataFrame:
    """The rows with ``split``. Speaker sizes, not rows, are planned on the driver, up to MOST_SPEAKERS."""
    _check_ratios(ratios)
    few = speaker_sizes(rows, order).orderBy("seen", "speaker").limit(MOST_SPEAKERS + 1).collect()
    if len(few) > MOST_SPEAKERS:
        raise ValueError(f"more than {MOST_SPEAKERS} speakers: split by split_by_hash")
    plan = plan_splits([(r["speaker"], r["n"]) for r in few], ratios, seed)
    return rows.join(rows.sparkSession.createDataFrame(list(plan.items()), "speaker string, split string"), "speaker")


def split_by_hash(rows: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """The rows with ``split`` by a hash of the speaker: for any number of speakers, without a plan and a shuffle; shares are met on average."""
    _check_ratios(ratios)
    u = F.pmod(F.xxhash64(F.lit(seed), "speaker"), F.lit(1 << 30)) / (1 << 30)
    return rows.withColumn("split", F.when(u < ratios[0], SPLITS[0]).when(u < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2]))


def split_manifest(split: DataFrame, ratios: tuple[float, float, float] | None = None, seed: int | None = None) -> DataFrame:
    """A row a split: n_rows, n_speakers, speakers and, where told, its ratio and the seed."""
    each = split.groupBy("split", "speaker").agg(F.count(F.lit(1)).alias("n"))
    out = each.groupBy("split").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_speakers"), F.array_sort(F.collect_list("speaker")).alias("speakers"))
    if ratios is None:
        return out
    ratio = F.create_map(*[F.lit(x) for pair in zip(SPLITS, ratios, strict=True) for x in pair])[F.col("split")]
    return out.withColumns({"ratio": ratio, "seed": F.lit(seed), "strategy": F.lit("speaker_aware_greedy")})


def majority_type(rows: DataFrame) -> DataFrame:
    """(speaker, meeting_type): the type of most of a speaker's rows; of equals, the first by name. No type: unknown."""
    n = rows.groupBy("speaker", F.coalesce("meeting_type", F.lit("unknown")).alias("meeting_type")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("speaker").agg(F.min_by("meeting_type", F.struct(-F.col("n"), "meeting_type")).alias("meeting_type"))


def stem_types(parsed: DataFrame) -> DataFrame:
    """(stem, meeting_type) from each stem's first row."""
    return parsed.groupBy("stem").agg(F.coalesce(F.min_by("meeting_type", "pos"), F.lit("unknown")).alias("meeting_type"))


def plan_sample(speakers: list[tuple[str, str, int]], target: int, seed: int) -> set[str]:
    """speakers: (speaker, type, rows) as first seen. Half of the target from each type, then more from all until it is met."""
    by_type: dict[str, list[str]] = {}
    for name, kind, _ in speakers:
        by_type.setdefault(kind, []).append(name)
    rng, size = random.Random(seed), {s: n for s, _, n in speakers}
    for kind in by_type:  # one generator goes through the types as first seen
        by_type[kind] = sorted(by_type[kind])
        rng.shuffle(by_type[kind])
    chosen: dict[str, int] = {}

    def take(names: list[str], enough: int, have: int) -> None:
        for name in names:
            if have >= enough:
                return
            if name not in chosen:
                chosen[name] = size[name]
                have += size[name]

    for kind in sorted(by_type):
        take(by_type[kind], target // 2, 0)
    take([s for kind in sorted(by_type) for s in by_type[kind]], target, sum(chosen.values()))
    return set(chosen)


def sample_balanced(rows: DataFrame, target: int = 2000, seed: int = 42, order: str = "pos") -> DataFrame:
    """Whole speakers, in balance of meeting types; needs meeting_type. Rows keep their order column."""
    kinds = speaker_sizes(rows, order).join(majority_type(rows), "speaker").orderBy("seen", "speaker").limit(MOST_SPEAKERS + 1).collect()
    if len(kinds) > MOST_SPEAKERS:
        raise ValueError(f"more than {MOST_SPEAKERS} speakers: sample by sample_by_hash")
    chosen = plan_sample([(r["speaker"], r["meeting_type"], r["n"]) for r in kinds], target, seed)
    return rows.join(rows.sparkSession.createDataFrame([(s,) for s in sorted(chosen)], "speaker string"), "speaker", "left_semi")


def sample_by_hash(rows: DataFrame, target: int = 2000, seed: int = 42) -> DataFrame:
    """Half of the target from each type by a hash order of speakers, without the driver; windows run over speakers of a type."""
    sizes = rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("n")).join(majority_type(rows), "speaker")
    before = W.partitionBy("meeting_type").orderBy(F.xxhash64(F.lit(seed), "speaker"), "speaker").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(sizes.where(F.col("before") < target // 2).select("speaker"), "speaker", "left_semi")
