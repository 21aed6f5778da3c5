"""Session settings the operators count on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """Bound what a Python worker and the Parquet reader hold at once: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "512")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``, or the context's; a local session without one gets its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestar-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: later steps don't repeat it, and Spark knows its size."""
    path = f"{shared_folder(df.sparkSession)}/lodestar-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(cores: int | str = "*", partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A local session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestar").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def register(spark: SparkSession) -> list[str]:
    """Make the functions that SQL lacks callable by name in SQL: word_stem, nfkc, html_page, parse_document."""
    from lodestar.functions import fold
    from lodestar.operators import html, office

    functions = {"word_stem": fold.stem, "nfkc": fold.nfkc, "html_page": html.page, "parse_document": office.document}
    for name, function in functions.items():
        spark.udf.register(name, function)
    return sorted(functions)
