"""Helpers shared by the operators: staged tables, row keys, text chunks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text, and rows, that one vectorised step works on at a time.
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 4096


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only a local master may do without."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = getattr(context, "_talkspark_shared", None)
        if not found:
            found = context._talkspark_shared = "file://" + tempfile.mkdtemp(prefix="talkspark-")
    return found.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Staged:
    """Tables written to the shared folder to cut lineage.

    ``drop`` deletes those that are no longer read, ``release`` all that were opened after
    ``mark``; the rest goes when the driver's JVM ends.
    """

    _open: list[Staged] = []

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self._marked = False
        Staged._open.append(self)

    def _path(self, path: str) -> tuple:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")  # nothing reads the shuffle files of a table that is written
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            conf.set(_CLEANUP, before)
        if not self._marked:
            root, fs = self._path(self.root)
            self._marked = fs.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._path(f"{self.root}/{name}")
            fs.delete(path, True)

    @classmethod
    def mark(cls) -> int:
        return len(cls._open)

    @classmethod
    def release(cls, mark: int) -> None:
        for st in cls._open[mark:]:
            path, fs = st._path(st.root)
            fs.delete(path, True)
        del cls._open[mark:]


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A 128-bit key of a row's content: equal rows share it, and all that is computed by it holds for each of them."""
    body = F.coalesce(F.concat(F.lit("t"), F.col(text)), F.lit("n"))
    return F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.lit(":"), body))


def keyed(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, body): the row key, the id and the whole text as UTF-8 bytes (null: empty)."""
    return docs.select(row_key().alias("rid"), "doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))


def numbered(rows: DataFrame, again: dict[str, int] | None = None) -> DataFrame:
    """The rows with ``did``, 64 bits of the row key ``rid``; ``again`` has other numbers for keys whose bits clash."""
    did = F.xxhash64("rid")
    if again:
        did = F.coalesce(F.create_map(*[F.lit(x) for pair in again.items() for x in pair])[F.col("rid")], did)
    return rows.withColumn("did", did)


#: Keys whose numbers clash; some tens are expected among 2e10 documents.
MOST_CLASHES = 10_000


def clashes(meta: DataFrame) -> dict[str, int]:
    """New numbers for the row keys of ``meta`` (rid, did) that share a did with another; empty where none does."""
    twice = meta.groupBy("did").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high").select("did")
    bad = [r[0] for r in meta.join(twice, "did", "left_semi").select("rid").distinct().limit(MOST_CLASHES + 1).collect()]
    if not bad:
        return {}
    if len(bad) > MOST_CLASHES:
        raise RuntimeError(f"more than {MOST_CLASHES} row keys share their 64-bit numbers")
    taken: set[int] = set()
    out = {}
    for rid in sorted(bad):  # bits 64 to 127 of the key, moved on past numbers in use
        new = int.from_bytes(bytes.fromhex(rid)[8:], "big", signed=True)
        while new in taken or not meta.where(F.col("did") == new).isEmpty():
            new = (new + 1 + (1 << 63)) % (1 << 64) - (1 << 63)
        taken.add(new)
        out[rid] = new
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string or binary column; null: empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def chunked(batches: Iterator[pa.RecordBatch], column: str = "body", limit: int = CHUNK_BYTES, most: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text and ``most`` rows, or one row."""
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0), np.int64)
        at = 0
        while at < len(size):
            ends = np.cumsum(size[at : at + most])
            n = max(1, int(np.searchsorted(ends, limit, "right")))
            part = batch.slice(at, n)
            yield part, texts_of(values.slice(at, n))
            at += n
