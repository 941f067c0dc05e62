"""What the operators share: the shared scratch folder, batch mapping and byte-level helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress
from pathlib import Path

import pyarrow as pa
import pyarrow.fs
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import importable

#: Columns that an operator adds to rows it carries along start like this, so that they clash with no input column.
OWN = "__rs_"
#: Tasks that may share the rows of one key in a join; as many as a bigint has bits.
SALTS, SALT = 64, f"{OWN}salt"
#: What an Arrow batch holds at most, but for a single longer row.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder name below the checkpoint folder that the session names, removed when the driver ends.

    Where none is named, a temporary one if all runs on this machine; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = Path(tempfile.gettempdir(), "rulesieve-checkpoints").as_uri()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/rulesieve-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    atexit.register(_removed, jvm, conf, folder)
    return folder


def _removed(jvm, conf, path: str) -> None:
    with suppress(Py4JError, OSError):  # the JVM may have gone before
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows as a table in the shared folder and reads them back."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def numbered(narrow: DataFrame, order: list) -> tuple[DataFrame, int]:
    """The rows with __rs_row, gapless from 0 in the given order, and their count."""
    spark = narrow.sparkSession
    shared_dir(spark)
    sorted_rows = narrow.repartitionByRange(*order).sortWithinPartitions(*order).checkpoint()
    at = sorted_rows.withColumn("__rs_at", F.monotonically_increasing_id())
    part = F.shiftright("__rs_at", 33)
    counts = {r[0]: r[1] for r in at.groupBy(part.alias("p")).count().collect()}  # one row a partition
    firsts, total = [], 0
    for p in sorted(counts):
        firsts.append((int(p), total))
        total += counts[p]
    starts = F.broadcast(spark.createDataFrame(firsts, "__rs_p bigint, __rs_first bigint"))  # one row a partition
    out = at.join(starts, part == F.col("__rs_p"), "left").withColumn("__rs_row", F.col("__rs_first") + F.col("__rs_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return out.drop("__rs_at", "__rs_p", "__rs_first"), total


def dropped(spark: SparkSession, path: str) -> None:
    """Removes a table in the shared folder that nothing reads any more."""
    _removed(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def opened(folder: str):
    """pyarrow's file system for a folder, and the folder's path in it."""
    return pyarrow.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def salted(rows: DataFrame, by: str) -> DataFrame:
    """Adds a number from 0 to SALTS - 1 that spreads the rows of one key."""
    return rows.withColumn(SALT, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def salts_met() -> F.Column:
    """An aggregate: the salts of a group's rows, as bits."""
    return F.bit_or(F.expr(f"shiftleft(1L, {SALT})"))


def unfolded(salts: str) -> F.Column:
    """A row for each salt that the bits name."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col(salts), i) == 1))


def looked_up(rows: DataFrame, told: DataFrame, key: list[str], by: str, how: str = "inner") -> DataFrame:
    """rows joined with told, which has one row a key at most, where a key may hold any share of rows.

    The rows of one key are spread by `by` over up to SALTS tasks, and what is told of a key is sent only to those it meets.
    """
    spread = salted(rows, by)
    asked = spread.groupBy(*key).agg(salts_met().alias(f"{SALT}s")).join(told, key)
    return spread.join(asked.withColumn(SALT, unfolded(f"{SALT}s")).drop(f"{SALT}s"), [*key, SALT], how).drop(SALT)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on an Arrow batch, which a task holds in the JVM and again in Python."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.match(r"-?[0-9]+", spark.conf.get(key))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(key, str(most))


def returned() -> None:
    """Gives memory that a task has freed back to the system: workers live on, and the allocators would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow whose workers can import this package."""
    importable(df.sparkSession)
    bounded_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        returned()

    return df.mapInArrow(task, schema)


def keyed_remainder(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo modulus."""
    return F.crc32(F.col(column).cast("string")) % modulus


def texts_of(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
