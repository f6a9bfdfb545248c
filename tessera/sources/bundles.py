"""Capture bundles (files of raw replies), transaction sinks and text snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encodings import parse_assignment


def read_bundle(spark: SparkSession, folder: str, name_part: str = "", suffix: str = "-in.bin") -> DataFrame:
    """(path, length, content) of the matching files; content is read only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{name_part}*{suffix}").load(folder).select("path", "length", "content")


def last_file(bundle: DataFrame) -> DataFrame:
    """The last file by name (one row, or none)."""
    last = bundle.agg(F.max("path").alias("last"))  # of names only; one row
    return bundle.join(F.broadcast(last), F.col("path") == F.col("last")).select("path", "length", "content")


def write_transactions(found: DataFrame, path: str) -> None:
    """The session log: one row a transaction, phases as columns, partitioned by operation."""
    found.write.partitionBy("op").parquet(path)


def read_text_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``0xCODE value`` or ``CODE=VALUE`` as (code, value); other lines are left out."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), r"^(\S+)\s+", "$1=").alias("line"))
    return lines.select(parse_assignment(F.col("line")).alias("p")).select("p.code", "p.value").where("code IS NOT NULL AND value IS NOT NULL")


def write_text_snapshot(df: DataFrame, path: str, code: str = "code", value: str = "value") -> None:
    df.select(F.format_string("0x%04X %d", F.col(code).cast("int"), F.col(value).cast("long")).alias("value")).write.text(path)


def downloads(objects: DataFrame, contents: DataFrame, handle: str = "handle", block: int | None = None) -> DataFrame:
    """Objects with their bytes and whether the length is the announced one (or it padded to ``block``).

    An object without bytes stays, incomplete.
    """
    out = objects.join(contents, handle, "left")
    n = F.octet_length("content")
    ok = n == F.col("size")
    if block:
        ok = ok | (n == F.ceil(F.col("size") / block) * block)
    return out.withColumn("complete", F.coalesce(ok, F.lit(False)))
