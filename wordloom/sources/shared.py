"""Tables kept in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a session on one machine gets a folder of its own, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-wordloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_KEPT: list[str] = []  # where this process's kept tables are
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Limits what goes to a Python worker at once to BATCH_BYTES, so that long texts don't fill its memory; a smaller limit of the session stays."""
    if not 0 < int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends, and lost executors cost no rerun."""
    bounded_batches(df.sparkSession)
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _KEPT.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a kept table. Only for one whose readers have all been written themselves."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.replace("file:///", "file:/").startswith(folder.replace("file:///", "file:/")):
            _delete(spark, path)


def cleared(spark: SparkSession) -> int:
    """Deletes all tables that this process has kept, and gives their number. For when every result that reads them has been written."""
    n = len(_KEPT)
    while _KEPT:
        _delete(spark, _KEPT.pop())
    return n


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
