"""A stream run to its end into a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """A fresh folder name below the session's checkpoint folder; where none is set, a temporary one if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.gettempdir(), "rulesieve-streams").as_uri()
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_to_table(source: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs every micro-batch that there is; a batch writes a folder of its own, again if it is run again."""
    spark, folder = source.sparkSession, shared_folder(source.sparkSession)

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    schema = work(spark.createDataFrame([], source.schema)).schema
    source.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/rows")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):  # a stream without rows has no batch
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema.add("batch", "long")).option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/*").drop("batch")
