"""Tables that are kept where driver and executors both see them, so that what follows starts from them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The library's own setting for a local session whose spark.checkpoint.dir is unset.
OWN_DIR = "spark.tidemark.checkpoints"


def _folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set(OWN_DIR, found)
    return found


def kept(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint in that folder."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, what: str) -> DataFrame:
    """df as files of columns in that folder: what follows starts from them, and reads only the columns that it needs."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, what: str) -> str:
    """A place in the folder of kept() that nothing else has."""
    return f"{_folder(spark)}/files/{what}-{uuid.uuid4().hex}"
