"""Written tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes handed to Python at once, so that long texts don't fill a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: The library's own setting; spark.checkpoint.dir itself can't be set once a session is up.
OWN_DIR = "spark.tidemark.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session gets a temporary one, kept in its setting
    OWN_DIR; on a cluster, whose executors have folders of their own, it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set(OWN_DIR, found)
    return found


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def new_path(spark: SparkSession, what: str) -> str:
    """A place in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/tables/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: later steps neither compute it twice nor need its lineage."""
    spark = df.sparkSession
    path = path or new_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes a table of new_path() that no step needs any more."""
    if f"{shared_dir(spark)}/tables/" not in path:
        raise ValueError(f"not a table of this module: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
