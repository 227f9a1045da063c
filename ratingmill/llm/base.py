"""Reading the corpus tables, cutting lineage, and small SQL helpers."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOLD_OUT = 5
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_FOLDERS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that all executors share, named in ``spark.checkpoint.dir``. Only a local
    session, whose executors see the driver's files, may go without; it gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept as a table in the shared folder, so that later jobs
    neither recompute it nor depend on one executor's disk. Shuffle files of plans that nothing
    refers to any more are freed."""
    spark = df.sparkSession
    folder = f"{shared(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    spark.sparkContext._jvm.System.gc()
    kept = spark.read.schema(df.schema).parquet(folder)
    _FOLDERS[kept] = folder
    return kept


def drop(*kept: DataFrame) -> None:
    """Deletes tables of settle() that nothing reads any more."""
    for df in kept:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop(df))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow``, in Arrow batches of ``BATCH_BYTES`` where the session keeps Spark's limit of 64 MB,
    copies of which fill an executor's memory beside the heap. The setting stays in the session."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH, "67108864b") in ("67108864b", "64m"):
        conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def held_out(doc_id) -> "F.Column":
    """True for the rows that no classifier learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % HOLD_OUT == 0, F.lit(False))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcasting if a count shows at most ``rows`` rows; as it is
    otherwise, so that Spark picks a shuffle join. For narrow tables."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
