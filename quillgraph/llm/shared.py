"""Tables and checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a session in one JVM (``local[...]``) may go without that setting; it
    then gets a temporary folder.  On a cluster a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillgraph-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a file, where the number of rows is known beforehand.
FILE_ROWS = 1_000_000


def written(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None, gather: bool = False) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again.

    Cuts the lineage: what was computed survives the loss of any executor.
    ``rows``: about how many rows there are, at most; a small table then
    becomes few files, however many partitions it was computed in.  ``gather``:
    small rows of many tasks, of unknown number, are dealt to as few files as
    their size asks for, by one more shuffle.  (A local file system without
    Hadoop's native library starts processes for each file.)
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if gather:
        df = df.hint("rebalance")
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of whole texts that a worker is handed at once; Spark's own default is ten times that.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of ``BATCH_ROWS`` rows, unless the session says how many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or a longer one if a column is called that already."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name
