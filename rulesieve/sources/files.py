"""Definition, rule and event files."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.printer import text
from ..registry import Config, Registry
from ..schema import Schema
from .events import decoded


def read_schema(spark: SparkSession, path: str) -> Schema:
    """Lines `name<TAB>type`; a schema is small."""
    return Schema.from_lines(r[0] for r in spark.read.text(path, wholetext=False).collect())


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """sub_id (null where it isn't a number) and rule of each line `id<TAB>rule`; empty lines and comments are left out."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith("#") & (F.trim("value") != ""))
    parts = F.split("value", "\t", 2)
    return lines.select(F.try_to_number(F.trim(parts[0]), F.lit("99999999999999999999")).cast("decimal(20,0)").alias("sub_id"), F.get(parts, 1).alias("rule"))


def load_rules(registry: Registry, rules: DataFrame) -> DataFrame:
    """Inserts the rules; returns those rejected: sub_id, rule, status, offset, message."""
    spark = rules.sparkSession
    bad = [(str(s), t, e.status.name, e.offset, e.message) for s, t, e in registry.insert_table(rules.where("sub_id IS NOT NULL AND rule IS NOT NULL"))]
    out = spark.createDataFrame(bad, "sub_id string, rule string, status string, offset int, message string")
    unread = rules.where("sub_id IS NULL OR rule IS NULL").select(F.col("sub_id").cast("string"), "rule", F.lit("SYNTAX").alias("status"), F.lit(0).alias("offset"), F.lit("expected an id, a tab and a rule").alias("message"))
    return out.union(unread)


def save_rules(registry: Registry, spark: SparkSession, path: str) -> None:
    """Writes the registered rules as a table (sub_id, rule) that parses to the same rules."""
    rows = [(Decimal(s), text(r)) for s, r in sorted(registry.given.items())]
    spark.createDataFrame(rows, "sub_id decimal(20,0), rule string").write.mode("overwrite").parquet(path)


def restored(spark: SparkSession, path: str, schema: Schema, config: Config | None = None) -> Registry:
    """A registry of a saved table; raises the first error, as a saved rule must be right."""
    out = Registry(schema, config)
    for _, _, error in out.insert_table(spark.read.parquet(path)):
        raise error
    return out


def read_events(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """Decoded lines; event_id is unique and grows inside a file, but has gaps."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return decoded(lines.select(F.monotonically_increasing_id().alias("event_id"), F.col("value").alias("payload")), schema)


def stream_events(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """New files' lines as a stream.  event_id is a hash of the file's name and the line's number, so a micro-batch that is run
    again has the same ids; for that a file is read as one text and should have some MB at most."""
    files = spark.readStream.format("text").option("wholetext", True).load(path).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line", "payload"))
    return decoded(files.where(F.trim("payload") != "").select(F.xxhash64("file", "line").alias("event_id"), "payload"), schema)
