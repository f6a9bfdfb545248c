"""Code tables as small DataFrames, and naming by broadcast joins with a hex fallback.

Each table below has under two hundred fixed rows, which is what allows broadcasting it.
Larger vendor tables are not part of the library: ``named`` takes any prioritised list of
(code, name) DataFrames, and lets Spark decide how to join those whose size is not known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .encodings import SHUTTER_BULB, aperture_decode, duration_text, ev_decode, hex_label, iso_decode, shutter_decode

# Response codes.
RESPONSES = {
    0x2000: "Undefined", 0x2001: "OK", 0x2002: "GeneralError", 0x2003: "SessionNotOpen", 0x2004: "InvalidTransactionID",
    0x2005: "OperationNotSupported", 0x2006: "ParameterNotSupported", 0x2007: "IncompleteTransfer", 0x2008: "InvalidStorageID",
    0x2009: "InvalidObjectHandle", 0x200A: "DevicePropNotSupported", 0x200B: "InvalidObjectFormat", 0x200C: "StoreFull",
    0x200D: "ObjectWriteProtected", 0x200E: "StoreReadOnly", 0x200F: "AccessDenied", 0x2010: "NoThumbnailPresent", 0x2011: "SelfTestFailed",
    0x2012: "PartialDeletion", 0x2013: "StoreNotAvailable", 0x2014: "SpecByFormatUnsupported", 0x2015: "NoValidObjectInfo",
    0x2016: "InvalidCodeFormat", 0x2017: "UnknownVendorCode", 0x2018: "CaptureAlreadyTerminated", 0x2019: "DeviceBusy",
    0x201A: "InvalidParentObject", 0x201B: "InvalidDevicePropFormat", 0x201C: "InvalidDevicePropValue", 0x201D: "InvalidParameter",
    0x201E: "SessionAlreadyOpen", 0x201F: "TransactionCancelled", 0x2020: "SpecOfDestUnsupported",
}

# Operation codes.
OPERATIONS = {
    0x1001: "GetDeviceInfo", 0x1002: "OpenSession", 0x1003: "CloseSession", 0x1004: "GetStorageIDs", 0x1005: "GetStorageInfo",
    0x1006: "GetNumObjects", 0x1007: "GetObjectHandles", 0x1008: "GetObjectInfo", 0x1009: "GetObject", 0x100A: "GetThumb",
    0x100B: "DeleteObject", 0x100C: "SendObjectInfo", 0x100D: "SendObject", 0x100E: "InitiateCapture", 0x100F: "FormatStore",
    0x1010: "ResetDevice", 0x1012: "SetObjectProtection", 0x1013: "PowerDown", 0x1014: "GetDevicePropDesc", 0x1015: "GetDevicePropValue",
    0x1016: "SetDevicePropValue", 0x1017: "ResetDevicePropValue", 0x1018: "TerminateOpenCapture", 0x1019: "MoveObject", 0x101A: "CopyObject",
    0x101B: "GetPartialObject", 0x101C: "InitiateOpenCapture", 0x9801: "GetObjectPropsSupported", 0x9802: "GetObjectPropDesc",
    0x9803: "GetObjectPropValue", 0x9804: "SetObjectPropValue", 0x9805: "GetObjPropList",
}

# Event codes, standard and vendor.
EVENTS = {
    0x4001: "CancelTransaction", 0x4002: "ObjectAdded", 0x4003: "ObjectRemoved", 0x4004: "StoreAdded", 0x4005: "StoreRemoved",
    0x4006: "DevicePropChanged", 0x4007: "ObjectInfoChanged", 0x4008: "DeviceInfoChanged", 0x4009: "RequestObjectTransfer",
    0x400A: "StoreFull", 0x400B: "DeviceReset", 0x400C: "StorageInfoChanged", 0x400D: "CaptureComplete", 0x400E: "UnreportedStatus",
    0xC001: "FujiPreviewAvailable", 0xC004: "FujiObjectAdded", 0xC201: "SonyPropertyChanged", 0xC202: "SonyObjectAdded",
}

# Object formats.
FORMATS = {
    0x3000: "undefined", 0x3001: "folder", 0x3002: "script", 0x3006: "DPOF", 0x3800: "undefined image", 0x3801: "JPEG",
    0x380D: "TIFF", 0xB101: "ARW (older)", 0xB103: "RAF", 0xB301: "MPO", 0xB310: "ARW",
}

# Object properties.
OBJECT_PROPERTIES = {
    0xDC01: "StorageID", 0xDC02: "ObjectFormat", 0xDC03: "ProtectionStatus", 0xDC04: "ObjectSize", 0xDC05: "AssociationType",
    0xDC06: "AssociationDesc", 0xDC07: "ObjectFileName", 0xDC08: "DateCreated", 0xDC09: "DateModified", 0xDC0A: "Keywords",
    0xDC0B: "ParentObject", 0xDC0D: "Hidden", 0xDC0E: "SystemObject", 0xDC41: "PersistentUID", 0xDC44: "Name", 0xDC46: "Artist",
    0xDC48: "Description", 0xDC4B: "Copyright", 0xDC87: "Width", 0xDC88: "Height", 0xDC89: "Duration",
}

# Standard device properties, and the portable-device ones.
PROPERTIES = {
    0x5001: "BatteryLevel", 0x5002: "FunctionalMode", 0x5003: "ImageSize", 0x5004: "CompressionSetting", 0x5005: "WhiteBalance",
    0x5006: "RGBGain", 0x5007: "FNumber", 0x5008: "FocalLength", 0x5009: "FocusDistance", 0x500A: "FocusMode",
    0x500B: "ExposureMeteringMode", 0x500C: "FlashMode", 0x500D: "ExposureTime", 0x500E: "ExposureProgramMode", 0x500F: "ExposureIndex",
    0x5010: "ExposureBiasCompensation", 0x5011: "DateTime", 0x5012: "CaptureDelay", 0x5013: "StillCaptureMode", 0x5014: "Contrast",
    0x5015: "Sharpness", 0x5016: "DigitalZoom", 0x5017: "EffectMode", 0x5018: "BurstNumber", 0x5019: "BurstInterval",
    0x501A: "TimelapseNumber", 0x501B: "TimelapseInterval", 0x501C: "FocusMeteringMode", 0x501D: "UploadURL", 0x501E: "Artist",
    0x501F: "CopyrightInfo", 0xD401: "SynchronizationPartner", 0xD402: "DeviceFriendlyName", 0xD403: "Volume", 0xD405: "DeviceIcon",
    0xD406: "SessionInitiatorInfo", 0xD407: "PerceivedDeviceType",
}

TABLES = {
    "response": RESPONSES, "operation": OPERATIONS, "event": EVENTS, "format": FORMATS,
    "object_property": OBJECT_PROPERTIES, "property": PROPERTIES,
}


def dimension(spark: SparkSession, name: str) -> DataFrame:
    """(code, name) of one of the fixed tables."""
    return spark.createDataFrame(sorted(TABLES[name].items()), "code int, name string")


def vendors(spark: SparkSession, rows) -> DataFrame:
    """A vendor registry (usb_id, vendor); an id given twice is refused."""
    rows = list(rows)
    if len({r[0] for r in rows}) != len(rows):
        raise ValueError("a vendor is registered twice")
    return spark.createDataFrame(rows, "usb_id int, vendor string").orderBy("usb_id")


def folded(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Layers as one table: a row for each key, with the (layer, models, name) that it has, best first.

    A layer may have a column ``models``, a bit for each model it holds for (null: all of them);
    of a key that it repeats for the same models the least name counts.
    """
    every = None
    for k, layer in enumerate(layers):
        models = F.col("models").cast("long") if "models" in layer.columns else F.lit(None).cast("long")
        part = layer.select(*keys, F.struct(F.lit(k).alias("layer"), models.alias("models"), "name").alias("layered"))
        every = part if every is None else every.unionAll(part)
    return every.groupBy(*keys).agg(F.array_sort(F.collect_set("layered")).alias("layered"))


def _best_name(layered: Column, model: Column | None) -> Column:
    """The name of the first layer that holds for a model (without a model: of layers for all models)."""
    holds = lambda e: e["models"].isNull() if model is None else e["models"].isNull() | (F.getbit(e["models"], model.cast("int")) == 1)
    fit = F.filter(layered, lambda e: F.coalesce(holds(e), F.lit(False)) & e["name"].isNotNull())
    first = F.get(fit, F.lit(0))
    # the least name of that layer, whatever models its rows list
    return F.array_min(F.transform(F.filter(fit, lambda e: e["layer"] == first["layer"]), lambda e: e["name"]))


def _joined(df: DataFrame, pairs: list[tuple[str, str]], layers: list[DataFrame], model: str | None) -> tuple[DataFrame, Column, list[str]]:
    """One join whatever the number of layers: the rows, the name (null where no layer has one), and the columns to drop."""
    if not layers:
        return df, F.lit(None).cast("string"), []
    taken, extra = {c.lower() for c in df.columns}, []
    for label in (*(f"key_{k}" for k, _ in enumerate(pairs)), "layered"):
        while label in taken:
            label += "_"
        extra.append(label)
    table = folded(layers, [of for _, of in pairs]).toDF(*extra)
    same = None
    for (own, _), key in zip(pairs, extra):
        one = F.col(own) == F.col(key)
        same = one if same is None else same & one
    return df.join(table, same, "left"), _best_name(F.col(extra[-1]), None if model is None else F.col(model)), extra


def named(df: DataFrame, code: str, layers: list[DataFrame], kind: str, into: str = "name", model: str | None = None) -> DataFrame:
    """Add a name: of the first layer that has the code, else the code in hex.

    A layer that repeats a code gives its least name, so the result does not depend on order.
    ``model`` is a column with the number of a model (0 to 62), for layers that hold for some only.
    """
    out, name, extra = _joined(df, [(code, "code")], layers, model)
    return out.withColumn(into, F.coalesce(name, hex_label(kind, F.col(code)))).drop(*(x for x in extra if x != into))


def codes_of(names: DataFrame, name: str, layers: list[DataFrame]) -> DataFrame:
    """Reverse lookup without regard to case: the first layer wins, then the lowest code."""
    every = None
    for k, layer in enumerate(layers):
        part = layer.select(F.lower("name").alias("__name"), F.struct(F.lit(k).alias("layer"), F.col("code")).alias("__at"))
        every = part if every is None else every.unionAll(part)
    best = every.groupBy("__name").agg(F.min("__at").alias("__at"))
    return names.join(best, F.lower(F.col(name)) == F.col("__name"), "left").withColumn("code", F.col("__at.code")).drop("__name", "__at")


def values_named(df: DataFrame, prop: str, value: str, layers: list[DataFrame], decoded: Column | None = None, into: str = "label", enums: list[DataFrame] | None = None, model: str | None = None) -> DataFrame:
    """Name (property, value) pairs: curated layers first, then a decoded text, then enum layers, then the signed number."""
    curated = list(layers)
    out, name, extra = _joined(df, [(prop, "prop"), (value, "value")], curated, model)
    names = [name, *([decoded] if decoded is not None else [])]
    if enums:
        out, name, more = _joined(out, [(prop, "prop"), (value, "value")], enums, model)
        names, extra = [*names, name], [*extra, *more]
    return out.withColumn(into, F.coalesce(*names, F.col(value).cast("string"))).drop(*(x for x in extra if x != into))


def exposure_text(prop: Column, value: Column, shutter: int, aperture: int, iso: int, bias: int) -> Column:
    """Text of the encoded exposure properties; null for others and for values that say nothing."""
    f, at = aperture_decode(value), iso_decode(value)
    sensitivity = F.when(at["auto"], "AUTO").when(at["mode"] != 0, F.format_string("%d (mode %d)", at["iso"], at["mode"])).otherwise(at["iso"].cast("string"))
    return (
        F.when(prop == shutter, F.when(value.bitwiseAND(0xFFFFFFFF) == SHUTTER_BULB, "Bulb").otherwise(duration_text(shutter_decode(value))))
        .when(prop == aperture, F.when(f.isNotNull(), F.format_string("f/%.1f", f)))
        .when(prop == iso, sensitivity)
        .when(prop == bias, F.format_string("%+.1f EV", ev_decode(value)))
    )
