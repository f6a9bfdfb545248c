"""Lines of text for volumes, objects, property descriptors and devices, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Storage types, access capabilities and USB interface classes.
STORAGE = {1: "fixed ROM", 2: "removable ROM (card)", 3: "fixed RAM (internal buffer)", 4: "removable RAM (card)"}
ACCESS = {0: "read-write", 1: "read-only", 2: "read + delete, no write"}
MODES = {6: "still image (PTP)", 8: "mass storage", 0: "unknown"}


def _one_of(names: dict[int, str], code: Column, other: str) -> Column:
    out = F.format_string(other, code.cast("int"))
    for k, name in names.items():
        out = F.when(code == k, name).otherwise(out)
    return out


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))


def is_removable(storage_type: Column) -> Column:
    return storage_type.isin(2, 4)


def storage_line(storage_type: Column, access: Column, capacity: Column, free_bytes: Column, description: Column, label: Column) -> Column:
    """Name, kind, access and free space; a capacity of all ones is unknown."""
    name = F.coalesce(F.nullif(description, F.lit("")), label, F.lit(""))
    size = F.when(capacity == -1, "capacity unknown").otherwise(F.format_string("%d of %d bytes free", free_bytes.cast("long"), capacity.cast("long")))
    return F.format_string("%s %s, %s, %s", quoted(name), _one_of(STORAGE, storage_type, "type 0x%04X"), _one_of(ACCESS, access, "access 0x%04X"), size)


def is_folder(fmt: Column) -> Column:
    return fmt == 0x3001


def is_image(fmt: Column) -> Column:
    return fmt.isin(0x3801, 0xB101, 0xB310, 0x380D, 0xB301, 0x3800)


def object_line(name: Column, fmt: Column, fmt_name: Column, size: Column, width: Column, height: Column) -> Column:
    line = F.format_string("%-16s %-14s %8d bytes  %dx%d", name, fmt_name, size.cast("long"), width.cast("long"), height.cast("long"))
    return F.when(is_folder(fmt), F.concat(name, F.lit("/"))).otherwise(line)


def descriptor_line(name: Column, code: Column, kind: Column, getset: Column, current: Column) -> Column:
    return F.format_string("%s(0x%04X) type=0x%04X getset=%d cur=%d", name, code.cast("int"), kind.cast("int"), getset.cast("int"), current.cast("long"))


def mode_name(interface_class: Column) -> Column:
    return _one_of(MODES, interface_class, "USB class %d")


def device_label(serial: Column, vendor: Column, product: Column, location: Column) -> Column:
    """The serial number, or where the device is."""
    place = F.format_string("%04x:%04x@0x%08x", vendor.cast("int"), product.cast("int"), location.cast("long"))
    return F.coalesce(F.nullif(serial, F.lit("")), place)


def first_values(values: Column, most: int = 12) -> Column:
    """The first few values of an array, for display."""
    return F.slice(values, 1, most)
