"""Shared plumbing: scratch tables, Arrow batches, byte-level word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch sent to a Python worker; keeps long texts from piling up in one batch.
BATCH_BYTES = 8 << 20

#: Rows that the Parquet reader decodes at once, 4096 by default: its buffers hold that many texts.
BATCH_ROWS = 512

#: The six ASCII white-space characters that separate words: space and U+0009 to U+000D.
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, since documents may be long and wavelet shards are, and read Parquet in batches of fewer rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's. Only a local session, where all is one machine, gets an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestar-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing reads any more."""
    jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("lodestar-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done: it does so when the driver has collected their plans, which else may be much later."""
    gc.collect()
    spark._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The needed columns, and all others in one struct, so that no name of theirs clashes with an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, (F.struct(*rest) if rest else F.lit(0)).alias("_rest"))


def unpacked(df: DataFrame, columns: list[str], needed: list[str]) -> DataFrame:
    """The columns of ``packed`` as they were."""
    return df.select(*[F.col(c) if c in needed else F.col(f"_rest.`{c}`").alias(c) for c in columns])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Pack an iterator of row tuples into record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pack(held, schema)
            held = []
    if held:
        yield pack(held, schema)


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Remembered(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and what is used again comes back."""

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        if len(key) <= 64:
            self[key] = value
        return value

    def forget(self) -> None:
        self.old = {}
        self.clear()


def release() -> None:
    """Give memory back to the system: Python workers live on, and the next stage may run in the same one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow`` whose tasks release their memory when they end."""

    def lean(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(it)
        finally:
            release()

    return df.mapInArrow(lean, schema)
