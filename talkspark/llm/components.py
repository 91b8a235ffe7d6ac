"""Connected components by alternating large-star and small-star rounds, each one staged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkspark.llm.common import Staged


def _star(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star: every edge (a > b) moves to the smallest node near it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").dropDuplicates()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return small.where("a <> b").dropDuplicates()


def components(links: DataFrame, st: Staged, tag: str, most: int = 60) -> DataFrame:
    """(node, comp) of the nodes with links (a, b): comp is the smallest node reachable."""
    edges = st.put(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").dropDuplicates(), f"{tag}-0")
    before = None
    for i in range(1, most + 1):
        edges = st.put(_star(edges), f"{tag}-{i}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
        if i > 1:
            st.drop(f"{tag}-{i - 1}")
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {most} rounds")
    # settled: every edge leads to its component's smallest node
    return st.put(edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp"))).dropDuplicates(), f"{tag}-out")
