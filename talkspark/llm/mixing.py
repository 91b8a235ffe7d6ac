"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree (operator 6).

DataFrame and SQL functions only. Each source's documents are hashed into blocks; the
hash is the source's permutation. A source with S words and a target of T lays its blocks
on a line of S words; the blocks of its quota are those that begin in the first min(T, S) words and,
drawn a second time, in the first T - S. These exact block quotas of all sources are split among the
output shards by a binary tree: each node splits its counts by source between its two halves
with a multivariate hypergeometric draw. Each shard then draws disjoint ranges of each
source's permuted blocks, as many as its leaf says, and orders its rows by a local hash. What is
taken of a document is what the drawn blocks bring of it: all its words, but for the last block of
a draw, which is cut where the source's target, rounded, is met. So a source's words are its
target exactly and no document is taken more than twice.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a null
doc_id is a value like any other. Repeated rows are separate documents: they are counted first and
told apart at the end, so that many equal rows are one row of a block. Very long texts are one
document of their block, cut only where a target ends in them. Ties: equal hashes go by doc_id.
Empty tables give empty results. Extra columns are ignored.

What is kept on one row are the block counts by source; the mixture's sources are a
dimension (a few to some thousands), not data. Everything by document is partitioned by
(source, block), about ``docs_per_block`` rows each, however large the source. The number of shards
follows from the words of the mix, ``shard_words`` each, 16 at least.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.llm.common import Staged, read_table, row_key

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(slim: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row a source: n, source_size, weight, target (water-filling up to cap x size), in a window over the sources alone."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    by_fill = W.orderBy("fill", "seq")
    total = F.sum("source_size").over(W.partitionBy())
    left = F.lit(share) * total - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum("weight").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    out = slim.groupBy("source").agg(F.sum("copies").alias("n"), F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    out = out.withColumn("seq", F.row_number().over(by_name).cast("long"))
    out = out.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("seq") - 1, F.lit(len(weights))) + 1).cast("int")))
    out = out.withColumn("cap", cap * F.col("source_size")).withColumn("fill", F.col("cap") / F.col("weight")).withColumn("level", level)
    # the sources filled before the first whose cap is above the level stop at their caps
    out = out.withColumn("chosen", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "seq", "level"))).over(W.partitionBy())["level"])
    return out.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("chosen"), F.lit(0.0)) * F.col("weight"))).drop("cap", "fill", "level", "chosen")


#: A hypergeometric draw by inversion: N items of which K are wanted, L drawn, u in [0, 1). The walk covers 10 standard deviations either side.
_DRAW = """aggregate(filter(sequence(z.a, z.b), k -> k < z.b),
  named_struct('p', 1D, 's', 1D, 'x', z.a, 'goal', z.u * aggregate(filter(sequence(z.a, z.b), k -> k < z.b), named_struct('p', 1D, 's', 1D),
    (c, k) -> named_struct('p', c.p * {r}, 's', c.s + c.p * {r}), c -> c.s)),
  (c, k) -> named_struct('p', c.p * {r}, 's', c.s + c.p * {r}, 'x', if(c.s < c.goal, k + 1, c.x), 'goal', c.goal), c -> c.x)""".format(r="(z.K - k) * (z.L - k) / (double(k + 1) * (z.N - z.K - z.L + k + 1))")
_SPLIT = f"""aggregate(sequence(1, size(counts)),
  named_struct('N', aggregate(counts, 0L, (a, x) -> a + x), 'L', aggregate(counts, 0L, (a, x) -> a + x) div 2, 'out', cast(array() as array<bigint>)),
  (t, i) -> element_at(transform(transform(transform(array(named_struct('N', t.N, 'L', t.L, 'K', element_at(counts, i), 'u', pmod(xxhash64(seed, node, i), 9007199254740992L) / 9007199254740992D)),
      z -> named_struct('N', z.N, 'L', z.L, 'K', z.K, 'u', z.u,
        'm', bigint(if(z.N = 0, 0D, (z.L + 1D) * (z.K + 1D) / (z.N + 2D))),
        'd', bigint(10 + 10 * sqrt(if(z.N < 2, 0D, double(z.L) * z.K / z.N * (1 - double(z.K) / z.N) * (z.N - z.L) / (z.N - 1)))))),
      z -> named_struct('N', z.N, 'L', z.L, 'K', z.K, 'u', z.u, 'a', greatest(0L, z.L - (z.N - z.K), least(z.m - z.d, z.K, z.L)), 'b', least(z.K, z.L, greatest(z.m + z.d, 0L, z.L - (z.N - z.K))))),
      z -> named_struct('N', z.N - z.K, 'L', z.L - {_DRAW}, 'out', concat(t.out, array({_DRAW})))), 1),
  t -> t.out)"""


def split_tree(counts: DataFrame, depth: int, seed: int) -> DataFrame:
    """counts: one row with ``counts`` array<bigint>. Returns (node, counts), one row for each of 2**depth shards."""
    out = counts.select(F.lit(1).cast("long").alias("node"), "counts")
    for _ in range(depth):
        out = out.withColumn("seed", F.lit(seed).cast("long")).withColumn("near", F.when(F.size("counts") > 0, F.expr(_SPLIT)).otherwise(F.col("counts")))
        out = out.select(F.inline(F.expr("array(named_struct('node', node * 2, 'counts', near), named_struct('node', node * 2 + 1, 'counts', zip_with(counts, near, (a, b) -> a - b)))")))
    return out.select((F.col("node") - (1 << depth)).alias("shard"), "counts")


def mix(docs: DataFrame, *, depth: int | None = None, shard_words: int = 1 << 26, docs_per_block: int = 256, blocks_per_group: int = 1024, seed: int = 7) -> DataFrame:
    """One row a document: rid, doc_id, source, size, source_size, target, taken and draws.

    draws: array of (pass, shard, place, words), one for each time the mix takes words of the
    document; ``place`` orders the shard's rows.
    """
    spark = docs.sparkSession
    st = Staged(spark, "mix")
    slim = docs.select(row_key().alias("rid"), "doc_id", "source", F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    slim = slim.groupBy("rid", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies"))
    slim = st.put(slim.withColumn("h", F.xxhash64(F.lit(seed), "rid")), "slim")
    src = source_targets(slim).withColumn("goal", F.least(F.floor(F.col("target") + 0.5), 2 * F.col("source_size")))
    src = st.put(src.withColumn("n_blocks", F.ceil(F.col("n") / docs_per_block)), "sources")
    if depth is None:
        words = src.agg(F.sum("goal")).collect()[0][0] or 0
        depth = max(4, (max(1, int(words) // shard_words) - 1).bit_length())
    dealt = slim.join(src.select("seq", F.col("source").alias("s"), "source_size", "target", "goal", "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.col("h")), F.col("n_blocks"))).withColumn("span", F.col("size") * F.col("copies"))
    # offsets of blocks on their source's line, by groups of blocks so that no window holds a whole source
    blocks = dealt.groupBy("seq", "block").agg(F.sum("span").alias("words"), F.first("source_size").alias("size_s"), F.first("goal").alias("goal_s"))
    blocks = st.put(blocks.withColumn("grp", F.floor(F.col("block") / blocks_per_group)), "blocks")
    groups = blocks.groupBy("seq", "grp").agg(F.sum("words").alias("g_words"), F.count(F.lit(1)).alias("g_n"))
    before = W.partitionBy("seq").orderBy("grp").rowsBetween(W.unboundedPreceding, -1)
    groups = groups.select("seq", "grp", F.coalesce(F.sum("g_words").over(before), F.lit(0)).alias("g_at"), F.coalesce(F.sum("g_n").over(before), F.lit(0)).alias("g_rank"))
    within = W.partitionBy("seq", "grp").orderBy("block")
    blocks = blocks.join(groups, ["seq", "grp"]).withColumn("at", F.col("g_at") + F.sum("words").over(within) - F.col("words")).withColumn("rank", F.col("g_rank") + F.row_number().over(within) - 1)
    blocks = st.put(blocks.select("seq", "block", "at", "rank", (F.col("at") < F.least("goal_s", "size_s")).alias("first"), (F.col("at") < F.col("goal_s") - F.col("size_s")).alias("second")), "places")
    # exact block quotas by source, split among the shards
    draws = blocks.groupBy("seq").agg(F.sum(F.col("first").cast("long")).alias("n1"), F.sum(F.col("second").cast("long")).alias("n2"))
    quotas = split_tree(draws.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", (F.col("n1") + F.col("n2")).alias("q")))), lambda x: x["q"]).alias("counts")), depth, seed)
    order = draws.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "n1"))), lambda x: x).alias("names"))
    quotas = quotas.crossJoin(F.broadcast(order)).select("shard", F.posexplode("counts").alias("i", "quota"), "names")  # one row of names
    quotas = quotas.select("shard", "quota", F.col("names")[F.col("i")]["seq"].alias("seq"), F.col("names")[F.col("i")]["n1"].alias("n1"))
    upto = F.sum("quota").over(W.partitionBy("seq").orderBy("shard"))
    quotas = quotas.withColumn("upto", upto).groupBy("seq").agg(F.max("n1").alias("n1"), F.array_sort(F.collect_list("upto")).alias("ends"))
    # each shard draws as many of the permuted blocks as its leaf says: ranks below its end and from the end before it on
    shard_of = lambda r: F.when(r < F.element_at("ends", -1), F.size(F.filter("ends", lambda e: e <= r)))
    second = F.when(F.col("second"), F.col("n1") + F.col("rank"))
    placed = blocks.join(quotas, "seq").select("seq", "block", "at", shard_of(F.when(F.col("first"), F.col("rank"))).alias("shard1"), shard_of(second).alias("shard2"))
    inside = W.partitionBy("seq", "block").orderBy("h", "doc_id", "size")
    out = dealt.join(st.put(placed, "placed"), ["seq", "block"]).withColumn("from", F.col("at") + F.sum("span").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("span"))
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("from", F.col("from") + F.col("copy") * F.col("size"))
    part = lambda end: F.least("size", F.greatest(F.lit(0).cast("long"), end - F.col("from")))
    out = out.withColumn("w1", part(F.least("goal", "source_size"))).withColumn("w2", part(F.col("goal") - F.col("source_size")))
    drawn = lambda p: F.col(f"shard{p}").isNotNull() & (F.col(f"w{p}") > 0)
    draw = lambda p: F.when(drawn(p), F.struct(F.lit(p).alias("pass"), F.col(f"shard{p}").alias("shard"), F.xxhash64(F.lit(seed + p), "h", "copy").alias("place"), F.col(f"w{p}").alias("words")))
    out = out.withColumn("draws", F.array_compact(F.array(draw(1), draw(2))))
    return out.select("rid", "doc_id", "source", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws")


def write_shards(docs: DataFrame, plan: DataFrame, path: str) -> None:
    """Writes the mix: the first ``words`` words of each document drawn, by shard, in the shard's own order."""
    rows = plan.select("rid", "source", F.inline("draws")).withColumnRenamed("source", "of")
    texts = docs.select(row_key().alias("rid"), "doc_id", "source", "text").dropDuplicates(["rid", "source"])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    out = texts.join(rows, (texts["rid"] == rows["rid"]) & texts["source"].eqNullSafe(rows["of"])).select("shard", "place", "doc_id", "source", cut.alias("text"))
    out.repartition("shard", F.pmod(F.col("place"), F.lit(64))).sortWithinPartitions("shard", "place").write.mode("overwrite").partitionBy("shard").parquet(path)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, then what the shards draw: an array each of their numbers, the row's place in them and the words taken."""
    out = mix(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.col("draws.shard").alias("shards"), F.col("draws.place").alias("places"), F.col("draws.words").alias("words"))
