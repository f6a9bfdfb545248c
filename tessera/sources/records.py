"""Decode operators: one blob a row in, its records out, with the rows before an error kept.

The kernels of ``functions.cursor`` run in Arrow batches.  Filter on other columns before
decoding: Catalyst prunes and pushes down up to the kernel, not through it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructType

from ..functions import columnar, cursor

KERNELS: dict[str, tuple[Callable, str]] = {
    "prop_list": (cursor.prop_list, cursor.PROP_LIST), "snapshot": (cursor.snapshot, cursor.SNAPSHOT), "descriptor": (cursor.descriptor, cursor.DESCRIPTOR),
    "object_info": (cursor.object_info, cursor.OBJECT_INFO), "device_info": (cursor.device_info, cursor.DEVICE_INFO), "storage_info": (cursor.storage_info, cursor.STORAGE_INFO),
    "ext_info": (cursor.ext_info, cursor.EXT_INFO), "licenses": (cursor.licenses, cursor.LICENSES), "object_prop_desc": (cursor.object_prop_desc, cursor.OBJECT_PROP_DESC),
    "event": (cursor.event, cursor.EVENT), "histogram": (cursor.histogram, cursor.HISTOGRAM), "tiff": (cursor.tiff_entries, cursor.TIFF_ENTRY), "jpeg": (cursor.jpeg_span, "image binary"),
}
#: Rows of one output batch, and blobs that are read together.
BATCH, BLOBS = 8192, 4096


class Kernel(Protocol):
    """What a decoder is: the rows of one blob as dicts; ``cursor.Short`` where it ends early."""

    def __call__(self, data: bytes) -> Iterator[dict]: ...


class ColumnarKernel(Protocol):
    """What a decoder of many blobs is: the bytes with their errors, and the rows in steps (see ``columnar``)."""

    def __call__(self, blobs: pa.Array) -> tuple[columnar.Blobs, list]: ...


def register_kernel(name: str, kernel: Kernel, ddl: str, many: ColumnarKernel | None = None) -> None:
    """Add a decoder of the caller's under a new name, for :func:`decode` and for table functions.

    ``ddl`` names the fields of its rows; ``many`` reads batches of blobs instead.
    """
    if name in KERNELS:
        raise ValueError(f"there is a decoder named {name}")
    KERNELS[name] = (kernel, ddl)
    if many is not None:
        columnar.KERNELS[name] = many


def decode(df: DataFrame, blob: str, kernel: str, keys: list[str]) -> DataFrame:
    """``keys`` + ordinal + the kernel's columns + error.

    A blob that ends early gives the rows read so far and then one row that has only the
    keys, the ordinal and the error.  A null blob gives no row.
    """
    function, ddl = KERNELS[kernel]
    many = columnar.KERNELS.get(kernel)
    fields = StructType.fromDDL(ddl)
    kinds = [df.schema[k].dataType for k in keys]
    names = [*keys, "ordinal", *fields.names, "error"]
    arrow = [*map(to_arrow_type, kinds), pa.int32(), *to_arrow_schema(fields).types, pa.string()]
    own = fields.names

    def run(batches):
        rows: list[list] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow)], names=names)
        for batch in batches:
            for *key, data in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None:
                    continue
                n = 0
                try:
                    for row in function(data):
                        rows.append([*key, n, *(row[k] for k in own), None])
                        n += 1
                        if len(rows) >= BATCH:
                            yield flush()
                            rows = []
                except cursor.Short as e:
                    rows.append([*key, n, *(None for _ in own), str(e)])
        if rows:
            yield flush()

    def run_columns(batches):
        inner = pa.schema(list(zip(own, arrow[len(keys) + 1 : -1])))
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOBS):
                some = batch.slice(begin, BLOBS)
                blobs = some.column(len(keys))
                announced = np.array([int.from_bytes(x[:4], "little") if x is not None else -1 for x in blobs.to_pylist()]) if many in columnar.COUNTED else np.where(blobs.is_valid().to_numpy(zero_copy_only=False), 1, -1)
                here = np.flatnonzero((announced >= 0) & (announced <= columnar.MOST_RECORDS))
                which, ordinal, columns, errors = columnar.decode(many, blobs.take(pa.array(here)), inner)
                at = pa.array(here[which])
                yield pa.RecordBatch.from_arrays([*(some.column(k).take(at).cast(t) for k, t in zip(range(len(keys)), arrow)), pa.array(ordinal.astype(np.int32)), *columns, errors], names=names)
                long = np.flatnonzero(announced > columnar.MOST_RECORDS)
                if len(long):
                    yield from run([some.take(pa.array(long))])

    schema = StructType()
    for k, kind in zip(keys, kinds):
        schema.add(k, kind)
    schema.add("ordinal", IntegerType())
    for f in fields:
        schema.add(f.name, f.dataType)
    schema.add("error", StringType())
    return df.select(*keys, F.col(blob).cast("binary").alias("__blob")).mapInArrow(run_columns if many else run, schema)


def datagram(df: DataFrame, blob: str, vendors: list[int] | None = None) -> DataFrame:
    """Hot-plug datagrams of USB devices: action, vendor_id, product_id and location (bus and device number).

    The first field is ACTION@PATH; KEY=VALUE fields follow, each behind a NUL byte, of which
    the last of a repeated key counts.  Other actions, subsystems and device types give no
    row, nor do vendors outside ``vendors`` where those are given.  Identifiers that are no
    16-bit hexadecimal number are 0.  Bytes stand for themselves (ISO-8859-1), so none is malformed.
    """
    fields = F.split(F.decode(F.col(blob), "ISO-8859-1"), "\0")
    last = lambda k: F.try_element_at(F.filter(fields, lambda f, i: (i > 0) & f.startswith(k + "=")), F.lit(-1))
    get = lambda k: F.substring(F.coalesce(last(k), F.lit("")), len(k) + 2, 1 << 30)
    product = F.split(get("PRODUCT"), "/")
    part = lambda k: F.coalesce(F.get(product, k), F.lit(""))
    ident = lambda k: F.when((F.size(product) >= 2) & part(k).rlike("^0*[0-9A-Fa-f]{1,4}$"), F.conv(part(k), 16, 10).cast("int")).otherwise(0)
    number = lambda k: F.coalesce(F.when(get(k).rlike("^[+-]?[0-9]+$"), get(k).try_cast("int")), F.lit(0))
    out = df.withColumns({
        "action": F.split_part(F.get(fields, 0), F.lit("@"), F.lit(1)), "vendor_id": ident(0), "product_id": ident(1),
        "location": F.shiftleft(number("BUSNUM").cast("long"), 16).bitwiseOR(number("DEVNUM").bitwiseAND(0xFFFF).cast("long")),
    })
    out = out.where((get("SUBSYSTEM") == "usb") & (get("DEVTYPE") == "usb_device") & F.col("action").isin("add", "remove"))
    return out if vendors is None else out.where(F.col("vendor_id").isin(*vendors))
