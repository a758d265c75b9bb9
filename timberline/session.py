"""Session settings the library relies on, and tables kept in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

REQUIRED_SETTINGS = {
    # zone-less log times are read as UTC
    "spark.sql.session.timeZone": "UTC",
    # repeated keys in a JSON line: the last one wins
    "spark.sql.variant.allowDuplicateKeys": "true",
    # the JVM does not compile methods beyond 8000 bytes of bytecode; a long parse
    # expression is faster as several smaller methods than as one interpreted one
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # whole texts go to Python in batches; executors and workers hold several of these at a time
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator expects; safe to call repeatedly."""
    for key, value in REQUIRED_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a session without that setting (local tests) gets a temporary folder,
    and a cluster session without it is refused: a machine-local folder would
    lose its data with the executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")  # a local path is taken to be a mount that all executors share
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="timberline-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but the result is a Parquet
    relation: columnar, prunable, and with a real size, so Catalyst's own
    broadcast threshold decides how later joins run.
    """
    path = f"{shared_dir(df.sparkSession)}/timberline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, which nothing still to be run may read.

    Shuffle files of plans that are no longer held go with a garbage collection of the driver.
    """
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()
    for table in tables:
        path = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# A scan below this size is worth spreading over idle cores; larger ones have enough splits.
SMALL_SCAN_BYTES = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """Repartition a small scan that would keep most cores idle; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < SMALL_SCAN_BYTES and len(df.inputFiles()) < cores:
        return df.repartition(cores)
    return df
