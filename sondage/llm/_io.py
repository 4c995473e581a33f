"""Tables, checkpoints and files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a local session gets one of this process's own; on a
    cluster executors would not see it, so it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local-cluster[")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sondage-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Rows written to the shared folder; Spark deletes them once no plan refers to them."""
    spark = df.sparkSession
    where = shared_dir(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(where)
    return df.checkpoint()


class Scratch:
    """Intermediate tables of one operator call, in the shared folder; closing deletes them.

    A lost executor costs no finished table. Whatever outlives the call goes through ``keep``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep(self, df: DataFrame) -> DataFrame:
        return checkpoint(df)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()


#: Bits of a ``BitFilter``: 4 MB, whatever the number of keys.
FILTER_BITS = 25


def slot(keys: np.ndarray) -> np.ndarray:
    """The bit of a key (a long) in a bit filter."""
    return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def bit_filter(keys: DataFrame) -> np.ndarray:
    """A packed bitset with the bits of all keys (one column of longs) set. Its size is fixed, so it can be sent everywhere: it
    holds back what no key can meet. With very many keys it holds back less, and never a key that is there."""

    def mark(batches):
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[slot(batch.column(0).to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
    for row in keys.coalesce(4).mapInArrow(mark, "bits binary").toLocalIterator():
        out |= np.frombuffer(row[0], dtype=np.uint8)
    return out


def runs(column: pa.Array, most: int = 1 << 20):
    """(from, to) of consecutive texts of an Arrow column with about ``most`` bytes together, before any of them becomes a
    Python object; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(sizes, dtype=np.int64) // most + np.arange(len(sizes)) // 4096
    edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def slices(texts: list, most: int = 1 << 20):
    """(from, to) of consecutive texts with about ``most`` characters together, so that a batch stays small in Python."""
    begin = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
