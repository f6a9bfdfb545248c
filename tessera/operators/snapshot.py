"""Property snapshots as relations: lookup, predicates, projection, difference, readiness.

A snapshot has one row per property entry and an ``ordinal``, its place in the dataset;
distributed rows have no order of their own, so first and last always mean that column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encodings as E


def first_match(df: DataFrame, keys: Sequence[str], ordinal: str, values: Sequence[str]) -> DataFrame:
    """The first entry of each key, with partial aggregation and no sort."""
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*values), F.col(ordinal)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{v}").alias(v) for v in values))


def last_wins(df: DataFrame, keys: Sequence[str], ordinal, values: Sequence[str]) -> DataFrame:
    """The last entry of each key; ``ordinal`` may be a column name or a struct of several."""
    at = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*values), at).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{v}").alias(v) for v in values))


def required(df: DataFrame, codes: DataFrame, code: str) -> DataFrame:
    """Every required code with what the snapshot has of it, and whether it is absent."""
    seen = df.withColumn("__here", F.lit(True))
    return codes.join(seen, code, "left").withColumn("absent", F.col("__here").isNull()).drop("__here")


def writable(getset: Column, enabled: Column | None = None) -> Column:
    """Standard: getset is 1.  Vendor (with ``enabled``): bit 0x80 is set, or enabled is 1."""
    return getset == 1 if enabled is None else (getset.bitwiseAND(0x80) != 0) | (enabled == 1)


def settable(can_write: Column, choices: Column) -> Column:
    """Struct of settable and the reason why not; a single choice means the device decides."""
    reason = F.when(~can_write, "read-only").when(F.size(choices) == 1, "controlled by the device")
    return F.struct(reason.isNull().alias("settable"), reason.alias("reason"))


def valid(value: Column, form: Column, choices: Column, low: Column, high: Column) -> Column:
    """Whether a value is among the choices or in the (signed) range; anything goes without a form."""
    return F.when(form == 2, F.array_contains(choices, value)).when(form == 1, value.between(low, high)).otherwise(True)


def supports_all(codes: Column, wanted: Sequence[int]) -> Column:
    """Every wanted code is listed."""
    out = F.lit(True)
    for w in wanted:
        out = out & F.array_contains(codes, w)
    return out


def visible(df: DataFrame, code: str, supported: DataFrame, names: DataFrame, everything: bool = False) -> DataFrame:
    """Entries to show, sorted by code: supported ones unless ``everything``; unknown codes are flagged."""
    some = df if everything else df.join(supported.select(code).distinct(), code, "left_semi")
    known = names.select(F.col("code").alias(code), "name").dropDuplicates([code])
    return some.join(known, code, "left").withColumn("unknown", F.col("name").isNull()).orderBy(code)


def named_share(df: DataFrame, code: str, names: DataFrame) -> DataFrame:
    """How many reported properties have a name and how many do not."""
    known = names.select(F.col("code").alias(code)).distinct().withColumn("__known", F.lit(True))
    return df.join(known, code, "left").agg(F.count_if(F.col("__known").isNotNull()).alias("n_named"), F.count_if(F.col("__known").isNull()).alias("n_unknown"))


def difference(old: DataFrame, new: DataFrame, code: str, value: str, ignore: Sequence[int] = ()) -> DataFrame:
    """Codes that both snapshots have with different values; codes missing on a side, and the clock, do not count."""
    o, n = old.select(code, F.col(value).alias("old")), new.select(code, F.col(value).alias("new"))
    out = o.join(n, code).where(~F.col("old").eqNullSafe(F.col("new")))
    return out.where(~F.col(code).isin(*ignore)) if ignore else out


def exposure(df: DataFrame, keys: Sequence[str], aperture: int, shutter: int, iso: int) -> DataFrame:
    """The exposure triangle of each snapshot, decoded; the last of repeated entries counts."""
    wire = lambda c: F.max_by("current.num", F.when(F.col("code") == c, F.col("ordinal")))
    out = df.where(F.col("code").isin(aperture, shutter, iso)).groupBy(*keys).agg(wire(aperture).alias("__a"), wire(shutter).alias("__s"), wire(iso).alias("__i"))
    return out.select(*keys, E.aperture_decode(F.col("__a")).alias("f_number"), E.shutter_decode(F.col("__s")).alias("seconds"), E.iso_decode(F.col("__i")).alias("iso"), (F.col("__s") == E.SHUTTER_BULB).alias("bulb"))


def projection(df: DataFrame, keys: Sequence[str], columns: dict[str, int]) -> DataFrame:
    """Named properties as nullable columns, the last of repeated entries counting."""
    aggs = [F.max_by("current.num", F.when(F.col("code") == c, F.col("ordinal"))).alias(n) for n, c in columns.items()]
    return df.where(F.col("code").isin(*columns.values())).groupBy(*keys).agg(*aggs)


def flags(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[int, int]]) -> DataFrame:
    """Booleans: whether a property has a given value; an absent property is false."""
    return df.groupBy(*keys).agg(*(F.coalesce(F.bool_or(F.when(F.col("code") == c, F.col("current.num") == v)), F.lit(False)).alias(n) for n, (c, v) in columns.items()))


def readiness(slots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slots (usable, writing, remaining; all null where not reported) to one row of each snapshot.

    Ready: no slot writes, and a slot is usable, or none is reported at all.
    """
    seen = F.col("usable").isNotNull()
    out = slots.groupBy(*keys).agg(F.count_if(seen).alias("n_slots"), F.coalesce(F.bool_or("usable"), F.lit(False)).alias("any_usable"), F.coalesce(F.bool_or("writing"), F.lit(False)).alias("any_writing"), F.max(F.when(F.col("usable"), F.col("remaining"))).alias("remaining"))
    return out.withColumn("ready", (F.col("n_slots") == 0) | (F.col("any_usable") & ~F.col("any_writing")))


def precondition(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that fails, in order; null if all hold."""
    out = None
    for ok, reason in checks:
        out = F.when(~ok, reason) if out is None else out.when(~ok, reason)
    return out


def settable_exposure(descriptors: DataFrame, keys: Sequence[str], shutter: int, aperture: int, iso: int) -> DataFrame:
    """Seconds, f-number and sensitivity of each device, and of each whether the host can set it.

    From the standard descriptors (code, getset, ordinal, current.num, choices): one is settable if
    it is writable and offers more than one choice.  The first descriptor of a code counts; what a
    device does not describe is null.
    """
    can = writable(F.col("getset")) & (F.coalesce(F.size("choices"), F.lit(0)) > 1)
    row = F.struct(F.col("current.num").alias("v"), F.coalesce(can, F.lit(False)).alias("can"))
    first = lambda code: F.min_by(row, F.when(F.col("code") == code, F.col("ordinal")))
    found = descriptors.where(F.col("code").isin(shutter, aperture, iso)).groupBy(*keys).agg(first(shutter).alias("s_"), first(aperture).alias("a_"), first(iso).alias("i_"))
    micros, hundredths = F.col("s_.v"), F.col("a_.v")
    return found.select(
        *keys, E.shutter_micros_decode(micros).alias("seconds"), F.col("s_.can").alias("seconds_settable"), E.aperture_decode(hundredths, sentinels=False).alias("f_number"), F.col("a_.can").alias("f_number_settable"),
        F.col("i_.v").alias("iso"), F.col("i_.can").alias("iso_settable"))


def metadata(df: DataFrame, keys: Sequence[str], texts: dict[str, int], embedding: int, on: int) -> DataFrame:
    """String properties as columns (null where absent), whether they are written to files, and whether that is reported.

    The first entry of a code counts.
    """
    first = lambda v, code: F.min_by(v, F.when(F.col("code") == code, F.col("ordinal")))
    flag = first("current.num", embedding) == on
    reported = F.count_if(F.col("code") == embedding) > 0
    aggs = [first("current.str", c).alias(n) for n, c in texts.items()]
    return df.groupBy(*keys).agg(*aggs, F.coalesce(flag, F.lit(False)).alias("embedding"), reported.alias("has_embedding"))


def known(df: DataFrame, code: str, captured: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows with what a reference capture (code, ordinal, values) has of their code: its first entry; ``is_known`` false and nulls without one."""
    one = first_match(captured.withColumnRenamed("code", code), [code], "ordinal", values).withColumn("is_known", F.lit(True))
    return df.join(one, code, "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))
