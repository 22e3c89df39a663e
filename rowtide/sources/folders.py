"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where no one has set it, a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_folder(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that no one else uses; it isn't made yet."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def staged(found: DataFrame, kind: str) -> DataFrame:
    """The rows written to the shared folder and read back, so that they are made once."""
    path = new_folder(found.sparkSession, kind)
    found.write.parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)
