"""Exact top-k by inner product with a vector-approximation file (operator 9).

Components become floor(256 x) as integers. Two tables are written: the exact vectors, a row
each, and the approximation file, blocks of vectors as cells of a byte a component (4 bits left 6 % of
10,000 vectors to be read for a query, 8 leave 0.2 %). A cell lies
between two edges of its component in its block; edges stand at quantiles, the outermost
cells being narrow, so that a few extreme values widen the bounds of few vectors.

1. The file is scanned: cells give each score an upper bound (for inner products the bound that
   orders and decides, as the lower bound of a distance does), and each query keeps its
   ``FIRST`` vectors of the highest bounds.
2. Their exact vectors are read and scored. A query's k-th score is its threshold.
3. The file is scanned again for the vectors whose bound reaches the threshold; the exact vectors
   of those are read, and no others. The k best of both are certain.

The queries are every row whose id is divisible by 50, a stated query set; they meet all
rows in blocks: one unit of work holds a block of queries and a group of blocks of cells, both of
bounded size, whatever the data. Exact vectors are shuffled once a step, not once a query block.

Of equal vectors only the k + 1 smallest ids can be among the k best of a query beside itself,
so only those stay candidates: a vector that a third of all rows have costs as much as a few.

Bounds are floats widened by their rounding errors; scores are exact: in 64-bit integers where
they fit, else in Python's, and stop at the ends of 64 bits.

Nulls: vectors that are null or hold null or non-finite components take no part, nor rows
with null vec_id; empty vectors take part with score 0. Vectors of different lengths
are not compared. A row is not its own candidate; other rows are, also those that repeat it or its
vec_id, and repeated query rows each get their own ranks. Ties go to the smaller vec_id. Empty
tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from talkspark.llm.common import Staged, read_table

QUERY_BLOCK, VECTOR_BLOCK = 1024, 4096
BITS = 8
CELLS = 1 << BITS
FIRST = 16
#: Groups of blocks of cells; each holds at most MOST_BLOCKS.
GROUPS, MOST_BLOCKS = 32, 64
_TYPES = {2: np.int16, 4: np.int32, 8: np.int64}


def _packed(v: np.ndarray) -> bytes:
    """A vector's width in bytes, then its components in the least integers that hold them."""
    most = int(max(v.max(initial=0), -(v.min(initial=0) + 1)))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + v.astype(_TYPES[width]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, _TYPES[raw[0]], offset=1).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): the vectors that take part, as packed integers."""
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where(good).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("x"):
                x = np.floor(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) * 256)
                # 64 bits at most; 2**63 itself is no 64-bit integer
                out.append(np.where(x >= 2.0**63, 2**63 - 1, np.where(x < -(2.0**63), -(2**63), np.clip(x, -(2.0**63), np.nextafter(2.0**63, 0))).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([len(x) for x in out], pa.int32()), pa.array([_packed(x) for x in out], pa.binary())], ["vec_id", "dim", "v"])

    return rows.mapInArrow(work, "vec_id long, dim int, v binary")


def _edges(data: np.ndarray) -> np.ndarray:
    """(CELLS + 1, dim): cell c of a component has the values from edge c to below edge c + 1; the last edge is the largest value."""
    low = 1 / max(len(data), 1000) * 2
    at = np.concatenate([[0.0], np.linspace(low, 1 - low, CELLS - 1), [1.0]])
    return np.quantile(data, at, axis=0, method="lower").astype(np.int64)


def approximate(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edges, cells) of a block's vectors."""
    edges = _edges(data)
    cells = np.zeros(data.shape, np.uint8)
    for j in range(data.shape[1]):
        cells[:, j] = np.minimum(np.searchsorted(edges[:-1, j], data[:, j], "right") - 1, CELLS - 1)
    return edges, cells


def upper_bounds(q: np.ndarray, edges: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """No less than the score of each query with each vector of the block, from the cells alone."""
    dim = edges.shape[1]
    j = np.arange(dim)
    real = edges.astype(float)
    low, high = real[:-1][cells, j], real[1:][cells, j]
    plus, minus = np.maximum(q, 0.0), np.minimum(q, 0.0)
    error = (np.abs(q) @ np.abs(real).max(0)) * (2 * dim + 4) * 2.0**-52
    return plus @ high.T + minus @ low.T + error[:, None]


def write_file(rows: DataFrame, n: int) -> DataFrame:
    """rows: (uid, dim, v). The approximation file: (dim, block, uids, edges, cells), about VECTOR_BLOCK vectors a row."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uids, data = [], []
        for b in batches:
            uids.append(np.asarray(b.column("uid"), np.int64))
            data += [_unpacked(x.as_py()) for x in b.column("v")]
        uids, data = np.concatenate(uids), np.array(data, np.int64).reshape(len(data), key[0].as_py())
        for a in range(0, len(uids), VECTOR_BLOCK):
            edges, cells = approximate(data[a : a + VECTOR_BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (uids[a : a + VECTOR_BLOCK], edges, cells))], ["dim", "block", "uids", "edges", "cells"])

    blocks = max(1, -(-n // VECTOR_BLOCK))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(1), "uid"), F.lit(blocks)))
    return rows.select("dim", "block", "uid", "v").groupBy("dim", "block").applyInArrow(work, "dim int, block long, uids binary, edges binary, cells binary")


def query_blocks(queries: DataFrame, n: int) -> DataFrame:
    """queries: (uid, dim, v, least). (dim, q_block, q): about QUERY_BLOCK queries a row, with what their scores must reach."""
    blocks = max(1, -(-n // QUERY_BLOCK))
    queries = queries.withColumn("q_block", F.pmod(F.xxhash64(F.lit(2), "uid"), F.lit(blocks)))
    return queries.groupBy("dim", "q_block").agg(F.collect_list(F.struct("uid", "v", "least")).alias("q"))


def scan_file(cells: DataFrame, queries: DataFrame, groups: int, first: int | None) -> DataFrame:
    """(query, uid): for each query the ``first`` vectors of the highest bounds of each group, with the bound; or all whose bound reaches ``least``."""

    def work(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        dim = key[0].as_py()
        asked = [x for r in rows if r["q"] is not None for x in r["q"]]
        if not asked:
            return
        ids = np.array([x["uid"] for x in asked], np.int64)
        q = np.array([_unpacked(x["v"]) for x in asked], np.int64).reshape(len(asked), dim).astype(float)
        least = np.array([-np.inf if x["least"] is None else x["least"] for x in asked])
        top, who = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for r in rows:
            if r["cells"] is None:
                continue
            uids = np.frombuffer(r["uids"], np.int64)
            bound = upper_bounds(q, np.frombuffer(r["edges"], np.int64).reshape(CELLS + 1, dim), np.frombuffer(r["cells"], np.uint8).reshape(len(uids), dim))
            bound[ids[:, None] == uids[None]] = -np.inf  # its own row
            if first is None:
                i, j = np.nonzero((bound >= least[:, None]) & (bound > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(uids[j]), pa.array(bound[i, j])], ["query", "uid", "bound"])
                continue
            if len(uids) > first:
                best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
            else:
                best = np.broadcast_to(np.arange(len(uids)), bound.shape)
            top = np.concatenate([top, np.take_along_axis(bound, best, 1)], 1)
            who = np.concatenate([who, uids[best]], 1)
            if top.shape[1] > first:
                keep = np.argpartition(-top, first - 1, axis=1)[:, :first]
                top, who = np.take_along_axis(top, keep, 1), np.take_along_axis(who, keep, 1)
        if first is not None:
            real = top > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.shape[1])[real.ravel()]), pa.array(who[real]), pa.array(top[real])], ["query", "uid", "bound"])

    numbers = queries.select("dim", "q_block").distinct()
    units = cells.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups))).join(numbers, "dim")
    units = units.select("dim", "q_block", "grp", "uids", "edges", "cells", F.lit(None).cast(queries.schema["q"].dataType).alias("q"))
    none = [F.lit(None).cast("binary").alias(c) for c in ("uids", "edges", "cells")]
    units = units.unionByName(queries.withColumn("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).select("dim", "q_block", "grp", *none, "q"))
    return units.groupBy("dim", "q_block", "grp").applyInArrow(work, "query long, uid long, bound double")


def exact_scores(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs: (query, uid). (query, uid, vec_id, score): the exact vectors of the pairs are read and no others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a, b in zip(batch.column("q").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x, y = _unpacked(a), _unpacked(b)
                if a[0] + b[0] <= 6 and len(x) < 1 << 16:  # products below 2**46
                    scores.append(int(x @ y))
                else:
                    s = sum(i * j for i, j in zip(x.tolist(), y.tolist(), strict=True))
                    scores.append(max(min(s, 2**63 - 1), -(2**63)))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("uid"), batch.column("vec_id"), pa.array(scores, pa.int64())], ["query", "uid", "vec_id", "score"])

    found = pairs.select("query", "uid").join(rows.select("uid", "vec_id", "v"), "uid")
    found = found.join(rows.select(F.col("uid").alias("query"), F.col("v").alias("q")), "query")
    return found.select("query", "uid", "vec_id", "q", "v").mapInArrow(work, "query long, uid long, vec_id long, score long")


def search(vectors: DataFrame, *, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    st = Staged(spark, "topk")
    rows = st.put(usable(vectors).withColumn("uid", F.monotonically_increasing_id()), "rows")
    of_equal = W.partitionBy("dim", "v").orderBy("vec_id", "uid")
    some = rows.withColumn("n", F.row_number().over(of_equal)).where(F.col("n") <= k + 1).drop("n")
    n = rows.count()
    blocks = max(1, -(-n // VECTOR_BLOCK))
    cells = st.put(write_file(some, n), "cells")
    groups = max(min(blocks, GROUPS), -(-blocks // MOST_BLOCKS))
    asked = rows.where(F.col("vec_id") % every == 0).select("uid", "dim", "v", "vec_id")
    n_asked = asked.count()
    queries = st.put(query_blocks(asked.withColumn("least", F.lit(None).cast("double")), n_asked), "queries")
    # 1: the highest bounds of all groups; 2: their exact scores, and what the k-th is
    order = W.partitionBy("query").orderBy(F.desc("bound"), "uid")
    highest = scan_file(cells, queries, groups, max(FIRST, k)).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(FIRST, k))
    one = st.put(exact_scores(highest, rows), "first")
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    kth = one.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select(F.col("query").alias("uid"), F.col("score").cast("double").alias("least"))
    # 3: all others whose bound reaches it
    queries = st.put(query_blocks(asked.join(kth, "uid", "left"), n_asked), "thresholds")
    more = scan_file(cells, queries, groups, None).join(one.select("query", "uid"), ["query", "uid"], "left_anti")
    two = st.put(exact_scores(more, rows), "second")
    out = one.unionByName(two).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.join(asked.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for op9_topk: every query with every row but itself.
ORACLE = """
with e as (select row_number() over () r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.r q, q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint score from e q join e c on q.r <> c.r and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by q order by score desc, vec_id)::int rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5"""
