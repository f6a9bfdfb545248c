"""Aggregations and ordered-row operators over frames, events and transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def channel_totals(bins: DataFrame, keys: Sequence[str], last_bin: int = 255) -> DataFrame:
    """Samples of each channel and the share in the last bin (0 without samples)."""
    total, clipped = F.sum("n"), F.sum(F.when(F.col("bin") == last_bin, F.col("n")).otherwise(0))
    return bins.groupBy(*keys).agg(total.alias("total"), clipped.alias("clipped")).withColumn("share", F.coalesce(F.try_divide(F.col("clipped"), F.col("total")), F.lit(0.0)))


def burst(frames: DataFrame, keys: Sequence[str], seconds: str, change_seconds: str) -> DataFrame:
    """Frames, total and mean seconds a frame, the slowest, and the mean cost of an exposure change."""
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.sum(seconds).alias("total"), F.avg(seconds).alias("mean"), F.max(seconds).alias("slowest"), F.avg(change_seconds).alias("mean_change"))


def changes(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str) -> DataFrame:
    """Whether a row differs from the one before it (the first of a group counts as a change)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("changed", ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1))


def repeats(frames: DataFrame, keys: Sequence[str], order: Sequence[str], content: str) -> DataFrame:
    """Distinct and repeated frames of a stream, by content against the frame before."""
    marked = changes(frames.withColumn("__h", F.md5(content)), keys, order, "__h")
    return marked.groupBy(*keys).agg(F.count_if("changed").alias("n_distinct"), F.count_if(~F.col("changed")).alias("n_repeated"))


def rate(frames: DataFrame, keys: Sequence[str], content: str, at: str) -> DataFrame:
    """Frames, bytes and frames a second over a run (null for a run without length)."""
    span = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.sum(F.octet_length(content)).alias("bytes"), F.try_divide(F.count("*").cast("double"), span).alias("per_second"))


def until_failures(rows: DataFrame, keys: Sequence[str], order: Sequence[str], failed: Column, most: int) -> DataFrame:
    """Rows up to and with the ``most``-th failure in a row; what follows is not looked at."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ok_before = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    run = rows.withColumn("__ok", ok_before).withColumn("__run", F.sum(F.when(failed, 1).otherwise(0)).over(Window.partitionBy(*keys, "__ok").orderBy(*order)))
    stop = F.coalesce(F.sum(F.when(F.col("__run") >= most, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return run.withColumn("__stop", stop).where("__stop = 0").drop("__ok", "__run", "__stop")


def sweep(rows: DataFrame, keys: Sequence[str], described: Column, declined: Column) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_if(described).alias("described"), F.count_if(declined).alias("declined"), F.count_if(~described & ~declined).alias("failed"))


def sweep_until(rows: DataFrame, keys: Sequence[str], order: Sequence[str], described: Column, declined: Column, gone: Column, most: int = 5) -> DataFrame:
    """A sweep that gives up: described, declined and failed rows up to where it ends, and whether it was aborted.

    A device that is gone ends it at once, ``most`` failures without a description between them
    end it as well; a declined row is neither and does not interrupt a run of failures.
    """
    kind = F.when(gone, "gone").when(described, "ok").when(declined, "no").otherwise("failed")
    w = Window.partitionBy(*keys).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(F.when(F.col("sweep_kind") == "failed", 1).otherwise(0)).over(w)
    marked = rows.select(*keys, *order, kind.alias("sweep_kind")).withColumn("fails", total)
    # failures so far less those up to the last description: the length of the run
    base = F.coalesce(F.max(F.when(F.col("sweep_kind") == "ok", F.col("fails"))).over(w), F.lit(0))
    ends = (F.col("sweep_kind") == "gone") | ((F.col("sweep_kind") == "failed") & (F.col("fails") - base >= most))
    seen = marked.withColumn("ends", ends).withColumn("over", F.coalesce(F.max(F.col("ends").cast("int")).over(before), F.lit(0))).where("over = 0")
    count = lambda k: F.count_if(F.col("sweep_kind") == k)
    return seen.groupBy(*keys).agg(count("ok").alias("described"), count("no").alias("declined"), (count("failed") + count("gone")).alias("failed"), F.bool_or("ends").alias("aborted"))


def first_of(events: DataFrame, keys: Sequence[str], wanted: Column, order: Column, values: Sequence[str]) -> DataFrame:
    """The first wanted event of each group."""
    best = events.where(wanted).groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{v}").alias(v) for v in values))


def in_step(containers: DataFrame, keys: Sequence[str], order: str, tx: str, expected: str, most_stale: int = 8) -> DataFrame:
    """The stale replies so far of each transaction, and whether the stream is still in step."""
    w = Window.partitionBy(*keys, expected).orderBy(order)
    out = containers.withColumn("stale", F.sum(F.when(F.col(tx) < F.col(expected), 1).otherwise(0)).over(w))
    return out.withColumn("in_step", (F.col(tx) <= F.col(expected)) & (F.col("stale") <= most_stale))


def suggest(names: Sequence[DataFrame], column: str, part: str, most: int = 8) -> DataFrame:
    """Distinct names of several sources that contain a text, sorted, the first few."""
    out = names[0].select(column)
    for n in names[1:]:
        out = out.union(n.select(column))
    return out.where(F.lower(column).contains(part.lower())).distinct().orderBy(column).limit(most)


def one_device(devices: DataFrame, serial: str | None = None) -> DataFrame:
    """Exactly one device (of that serial); none or several raise when the query runs."""
    some = devices if serial is None else devices.where(F.col("serial") == serial)
    checked = some.limit(2).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in devices.columns))
    return checked.where(F.assert_true(F.col("__n") == 1, F.concat(F.lit("devices found: "), F.col("__n").cast("string"))).isNull()).drop("__n")
