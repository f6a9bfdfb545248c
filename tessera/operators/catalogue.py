"""Object catalogues: (handle, property, value) rows to one row or map an object, and handle sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_handle(eav: DataFrame, handle: str = "handle", prop: str = "prop", value: str = "value", ordinal: str = "ordinal") -> DataFrame:
    """One map an object, the last value of a property counting (so no key is there twice)."""
    one = eav.groupBy(handle, prop).agg(F.max_by(value, ordinal).alias("__v"))
    return one.groupBy(handle).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(prop).alias("key"), F.col("__v").alias("value"))))).alias("properties"))


def pivot(eav: DataFrame, columns: dict[str, int | tuple[int, str]], handle: str = "handle", prop: str = "prop", value: str | Column = "value", ordinal: str = "ordinal") -> DataFrame:
    """Outer merge of property scans: listed properties as nullable columns, without a shuffle for each.

    A property may be given with the column of its own value, so types can differ.
    """
    of = lambda v: F.col(v) if isinstance(v, str) else v
    pairs = {n: c if isinstance(c, tuple) else (c, value) for n, c in columns.items()}
    aggs = [F.max_by(of(v), F.when(F.col(prop) == c, F.col(ordinal))).alias(n) for n, (c, v) in pairs.items()]
    return eav.groupBy(handle).agg(*aggs)


def merge_scans(scans: Sequence[DataFrame]) -> DataFrame:
    """Scans of single properties as one relation; an ``error`` row is kept unless every scan failed."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    ok = out.where("error IS NULL").limit(1).withColumn("__ok", F.lit(True)).select("__ok")
    return out.join(F.broadcast(ok), F.lit(True), "left").withColumn("error", F.when(F.col("__ok").isNull(), F.concat(F.lit("every scan failed: "), F.coalesce("error", F.lit("no rows")))).otherwise(F.col("error"))).drop("__ok")


def unseen(now: DataFrame, seen: DataFrame, handle: str = "handle") -> DataFrame:
    """Handles that were not there before (order and repeats are kept)."""
    return now.join(seen.select(handle), handle, "left_anti")


def append_unseen(seen: DataFrame, now: DataFrame, handle: str = "handle") -> DataFrame:
    return seen.unionByName(unseen(now, seen, handle), allowMissingColumns=True)


def tag_new(now: DataFrame, before: DataFrame, handle: str = "handle") -> DataFrame:
    """Each row of ``now`` with whether its handle is new."""
    known = before.select(handle).distinct().withColumn("__known", F.lit(True))
    return now.join(known, handle, "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


def _selected(storage: int | None, fmt: int | None, parent: int | None, handle: int | None) -> Column:
    out = F.lit(True)
    for name, v in (("storage_id", storage), ("format", fmt), ("parent", parent), ("handle", handle)):
        if v is not None:
            out = out & (F.col(name) == v)
    return out


def select_objects(objects: DataFrame, storage: int | None = None, fmt: int | None = None, parent: int | None = None, handle: int | None = None) -> DataFrame:
    """Pushed-down predicates; an omitted one matches everything."""
    return objects.where(_selected(storage, fmt, parent, handle))


def count_objects(objects: DataFrame, keys: Sequence[str] = (), storage: int | None = None, fmt: int | None = None, parent: int | None = None) -> DataFrame:
    """How many objects of each group match, 0 where none does; without keys one row for all."""
    return objects.groupBy(*keys).agg(F.count_if(F.coalesce(_selected(storage, fmt, parent, None), F.lit(False))).alias("n_objects"))


def format_counts(objects: DataFrame, keys: Sequence[str], name: str, ordinal: str, last: int = 8) -> DataFrame:
    """Objects of each group, and the names of the last few, in order."""
    rank = Window.partitionBy(*keys).orderBy(F.desc(ordinal))
    tail = objects.select(*keys, name, ordinal, F.row_number().over(rank).alias("__r")).where(F.col("__r") <= last)
    names = tail.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct(ordinal, name))), lambda s: s[name]).alias("last_names"))
    return objects.groupBy(*keys).agg(F.count("*").alias("n")).join(names, list(keys), "left")


def byte_range(content: Column, offset: Column, length: Column) -> Column:
    """``length`` bytes from ``offset`` on, as far as there are any; both may be 64-bit."""
    size = F.octet_length(content).cast("long")
    at, n = F.least(F.greatest(offset.cast("long"), F.lit(0)), size), F.greatest(length.cast("long"), F.lit(0))
    return F.substring(content, (at + 1).cast("int"), F.least(n, size - at).cast("int"))
