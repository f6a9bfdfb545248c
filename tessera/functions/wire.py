"""Little-endian wire values of fixed place, as Column expressions (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .cursor import OBJECT_FIELDS, OBJECT_TEXTS
from .encodings import sign_extend


def put_uint(v: Column, size: int) -> Column:
    """An integer as ``size`` little-endian bytes (negative ones in two's complement)."""
    digits = F.right(F.lpad(F.hex(v.cast("long")), 16, "0"), F.lit(2 * size))
    return F.unhex(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))))


def get_uint(data: Column, offset: int | Column, size: int) -> Column:
    """``size`` bytes at an offset as an unsigned integer; null where the bytes end before.

    Eight bytes give the raw bits in a long.
    """
    digits = F.concat(*(F.hex(F.substring(data, offset + k + 1, 1)) for k in reversed(range(size))))
    value = F.conv(digits, 16, -10 if size == 8 else 10).cast("long")
    return F.when(F.octet_length(data) >= offset + size, value)


def get_int(data: Column, offset: int, size: int) -> Column:
    return sign_extend(get_uint(data, offset, size), 8 * size) if size < 8 else get_uint(data, offset, size)


def event_packet(data: Column) -> Column:
    """An event packet of fixed layout as (code, tx_id, params): 12 bytes of header, 32-bit parameters behind it."""
    length = F.least(get_uint(data, 0, 4), F.octet_length(data).cast("long"))
    params = F.transform(F.sequence(F.lit(0), F.floor((length - 12) / 4).cast("int") - 1), lambda k: get_uint(data, k * 4 + 12, 4))
    params = F.when(length >= 16, params).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.octet_length(data) >= 12, F.struct(get_uint(data, 6, 2).cast("int").alias("code"), get_uint(data, 8, 4).alias("tx_id"), params.alias("params")))


def scalar_entries(data: Column, size: int) -> Column:
    """A property snapshot whose entries are all scalars of ``size`` bytes without a form: (code, type, getset, enabled, initial, current) of each."""
    n, step = get_uint(data, 0, 4), 7 + 2 * size
    field = lambda k, at, w: get_uint(data, k * step + (8 + at), w)
    entry = lambda k: F.struct(field(k, 0, 2).cast("int").alias("code"), field(k, 2, 2).cast("int").alias("type"), field(k, 4, 1).cast("int").alias("getset"), field(k, 5, 1).cast("int").alias("enabled"), field(k, 6, size).alias("initial"), field(k, 6 + size, size).alias("current"))
    whole = (n > 0) & (F.octet_length(data) >= 8 + n * step)
    return F.when(whole, F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), entry)).otherwise(F.array())


def put_string(s: Column) -> Column:
    """Counted UTF-16LE with a closing NUL; longer strings than the count can tell are refused by null."""
    units = F.octet_length(F.encode(s, "UTF-16LE")) / 2
    body = F.concat(put_uint(F.lit(0) + units + 1, 1), F.encode(s, "UTF-16LE"), F.unhex(F.lit("0000")))
    return F.when(s == "", F.unhex(F.lit("00"))).when(units <= 254, body)


def get_string(data: Column, offset: int = 0) -> Column:
    """Counted UTF-16LE at an offset; a NUL counts and is dropped only where it comes last, half a surrogate pair becomes U+FFFD."""
    units = get_uint(data, offset, 1)
    # in hexadecimal digits, four a unit: whole characters are passed over, what then follows is half a pair
    digits = F.hex(F.substring(data, F.lit(offset + 2), (units * 2).cast("int")))
    whole = F.regexp_replace(digits, r"\G((?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*+)....", "$1FDFF")
    closed = F.regexp_replace(whole, "^((?:....)*?)(?:0000)?.{0,3}$", "$1")
    text = F.decode(F.unhex(closed), "UTF-16LE")
    return F.when(units == 0, "").when(F.octet_length(data) >= offset + 1 + 2 * units, text)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once; in a lambda function Spark would compute it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _swapped(digits: Column, place: Column) -> Column:
    """Four hexadecimal digits, from a place on, with their bytes in the other order."""
    return F.concat(F.substring(digits, place + 3, F.lit(2)), F.substring(digits, place + 1, F.lit(2)))


def put_code_list(codes: Column) -> Column:
    """An array of 16-bit codes behind its 32-bit count."""
    four = lambda c: F.right(F.lpad(F.hex(c.cast("long")), 16, "0"), F.lit(4))
    return F.concat(put_uint(F.size(codes), 4), F.unhex(F.array_join(F.transform(codes, lambda c: _once(four(c), lambda d: _swapped(d, F.lit(0)))), "")))


def code_list(data: Column, offset: int = 0) -> Column:
    """The 16-bit codes behind a 32-bit count; null where the bytes end before."""

    def codes(data):
        n = get_uint(data, offset, 4)
        tail = F.hex(F.substring(data, F.lit(offset + 5), (2 * n).cast("int")))
        some = _once(tail, lambda t: F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: F.conv(_swapped(t, k * 4), 16, 10).cast("int")))
        return F.when(n == 0, F.array().cast("array<int>")).when(F.octet_length(data) >= offset + 4 + 2 * n, some)

    return _once(data, codes)


def put_object_info(fields: dict[str, Column]) -> Column:
    """An object's dataset: the fields of ``cursor.OBJECT_FIELDS`` and the four texts; what is not given is 0 or empty."""
    if unknown := set(fields) - {k for k, _ in OBJECT_FIELDS} - set(OBJECT_TEXTS):
        raise ValueError(f"no such fields: {sorted(unknown)}")
    numbers = [put_uint(fields.get(k, F.lit(0)), n) for k, n in OBJECT_FIELDS]
    return F.concat(*numbers, *(put_string(fields.get(k, F.lit(""))) for k in OBJECT_TEXTS))
