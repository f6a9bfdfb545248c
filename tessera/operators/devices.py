"""Devices as a table: selection by vendor, exposure ladders of a descriptor, frames that wait."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import encodings as E
from ..functions import rendering as R


def of_vendors(devices: DataFrame, vendors: Sequence[int] | DataFrame, vendor: str = "vendor_id") -> DataFrame:
    """Devices of listed vendors, or of those of a registry (usb_id), in order of their place."""
    if isinstance(vendors, DataFrame):
        return devices.join(vendors.select(F.col("usb_id").alias(vendor)).distinct(), vendor, "left_semi")
    return devices.where(F.col(vendor).isin(*vendors))


def described(devices: DataFrame) -> DataFrame:
    """With the USB mode, whether the device can be driven, and a label."""
    label = R.device_label(F.col("serial"), F.col("vendor_id"), F.col("product_id"), F.col("location"))
    return devices.withColumns({"mode": R.mode_name(F.col("interface_class")), "is_ptp": F.col("interface_class") == 6, "label": label})


def shutter_ladder(choices: Column) -> Column:
    """Struct of the decoded durations, shortest first, and whether Bulb is among the choices; undecodable ones are left out."""
    seconds = F.filter(F.transform(choices, E.shutter_decode), lambda s: s.isNotNull())
    return F.struct(F.array_sort(seconds).alias("seconds"), F.exists(choices, lambda v: v == E.SHUTTER_BULB).alias("has_bulb"))


def waiting(objects: DataFrame, keys: Sequence[str], store: int, storage: str = "storage_id") -> DataFrame:
    """How many frames wait in the volatile store (0 where none does)."""
    return objects.groupBy(*keys).agg(F.count_if(F.col(storage) == store).alias("n_waiting"))


def with_models(devices: DataFrame, vendors: DataFrame, models: DataFrame) -> DataFrame:
    """Devices of any vendor with ``vendor`` and ``model``: by the registries (usb_id, vendor) and (usb_id, product_id, model).

    An unknown product is named after its vendor and its number, an unknown vendor has null names and ``is_known`` false.
    """
    known = vendors.select(F.col("usb_id").cast("int").alias("vendor_id"), "vendor").dropDuplicates(["vendor_id"]).withColumn("is_known", F.lit(True))
    named = models.select(F.col("usb_id").cast("int").alias("vendor_id"), F.col("product_id").cast("int").alias("product_id"), "model").groupBy("vendor_id", "product_id").agg(F.min("model").alias("model"))
    out = devices.join(known, "vendor_id", "left").join(named, ["vendor_id", "product_id"], "left")
    fallback = F.when(F.col("is_known"), F.format_string("%s device 0x%04X", "vendor", F.col("product_id").cast("int")))
    model = F.when(F.col("is_known"), F.coalesce("model", fallback))
    return out.withColumns({"model": model, "is_known": F.coalesce("is_known", F.lit(False))})
