"""Small per-blob kernels: a bounds-checked cursor and the record layouts read with it.

Spark deals the blobs; a kernel sees one of them.  A kernel is a generator of dicts, so
the rows before an error are kept, and the error becomes a row of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

STRING, ARRAY = 0xFFFF, 0x4000
WIDTH = {1: 1, 2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 8, 8: 8}
RANGE, ENUM = 1, 2


class Short(ValueError):
    """The bytes end before the record does, or a count cannot fit in them."""


class Cursor:
    def __init__(self, data: bytes, big: bool = False):
        self.data, self.at, self.order = data, 0, "big" if big else "little"

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise Short(f"{n} bytes wanted at {self.at}, {self.left} left")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, size: int) -> int:
        return int.from_bytes(self.take(size), self.order)

    def scalar(self, kind: int) -> int:
        """A typed integer; odd type codes are signed.  64 unsigned bits keep their pattern."""
        size = WIDTH.get(kind & ~ARRAY)
        if size is None:
            raise Short(f"no width for type 0x{kind:04X}")
        return int.from_bytes(self.take(size), self.order, signed=bool(kind & 1) or size == 8)

    def text(self) -> str:
        n = self.uint(1)
        s = self.take(2 * n).decode("utf-16-le", "replace")
        return s[:-1] if s.endswith("\0") else s

    def many(self, n: int, kind: int) -> list[int]:
        size = WIDTH.get(kind & ~ARRAY)
        if size is None or n * size > self.left:
            raise Short(f"{n} values of type 0x{kind:04X} do not fit in {self.left} bytes")
        return [self.scalar(kind & ~ARRAY) for _ in range(n)]

    def value(self, kind: int) -> dict:
        """The tagged union; the string code has the array bit too, so it is told first."""
        out = {"type": kind, "num": None, "str": None, "arr": None}
        if kind == STRING:
            out["str"] = self.text()
        elif kind & ARRAY:
            out["arr"] = self.many(self.uint(4), kind)
        else:
            out["num"] = self.scalar(kind)
        return out


VALUE = "struct<type:int,num:bigint,str:string,arr:array<bigint>>"

PROP_LIST = f"handle long, prop int, value {VALUE}"


def prop_list(data: bytes) -> Iterator[dict]:
    c = Cursor(data)
    n = c.uint(4)
    if n > c.left // 8:
        raise Short(f"{n} rows do not fit in {c.left} bytes")
    for _ in range(n):
        handle, prop, kind = c.uint(4), c.uint(2), c.uint(2)
        yield {"handle": handle, "prop": prop, "value": c.value(kind)}


SNAPSHOT = f"code int, type int, getset int, enabled int, initial {VALUE}, current {VALUE}, form int, low long, high long, step long, choices array<bigint>"


def snapshot(data: bytes) -> Iterator[dict]:
    """Property entries; a second list of choices, told by its small count, replaces the first."""
    c = Cursor(data)
    n = c.uint(4)
    c.take(4)
    for _ in range(n):
        row = dict.fromkeys(("form", "low", "high", "step", "choices", "current"))
        row |= {"code": c.uint(2), "type": (kind := c.uint(2)), "getset": c.uint(1), "enabled": c.uint(1)}
        row["initial"] = c.value(kind)
        if kind == STRING and not c.left:
            yield row
            continue
        row["current"] = c.value(kind)
        row["form"] = c.uint(1)
        if row["form"] == RANGE:
            row |= {k: c.scalar(kind) for k in ("low", "high", "step")}
        elif row["form"] == ENUM:
            row["choices"] = c.many(c.uint(2), kind)
            if c.left >= 2 and int.from_bytes(c.data[c.at : c.at + 2], "little") < 0x200:
                row["choices"] = c.many(c.uint(2), kind)
        yield row


DESCRIPTOR = f"code int, type int, getset int, initial {VALUE}, current {VALUE}, form int, low long, high long, step long, low_str string, high_str string, step_str string, choices array<bigint>, choices_str array<string>"


def descriptor(data: bytes) -> Iterator[dict]:
    """A standard property descriptor; array-typed values are read as arrays."""
    c = Cursor(data)
    row = dict.fromkeys(("initial", "current", "form", "low", "high", "step", "low_str", "high_str", "step_str", "choices", "choices_str"))
    row |= {"code": c.uint(2), "type": (kind := c.uint(2)), "getset": c.uint(1)}
    if kind == 0:
        row["form"] = c.uint(1) if c.left else None
        yield row
        return
    row |= {"initial": c.value(kind), "current": c.value(kind)}
    if c.left:
        row["form"] = c.uint(1)
    if row["form"] == RANGE:
        names = ("low", "high", "step")
        row |= {f"{k}_str": c.text() for k in names} if kind == STRING else {k: c.scalar(kind) for k in names}
    elif row["form"] == ENUM:
        n = c.uint(2)
        if kind == STRING:
            if n > c.left:
                raise Short(f"{n} strings do not fit in {c.left} bytes")
            row["choices_str"] = [c.text() for _ in range(n)]
        else:
            row["choices"] = c.many(n, kind)
    yield row


OBJECT_FIELDS = (("storage_id", 4), ("format", 2), ("protection", 2), ("size", 4), ("thumb_format", 2), ("thumb_size", 4), ("thumb_width", 4), ("thumb_height", 4), ("width", 4), ("height", 4), ("depth", 4), ("parent", 4), ("association", 2), ("association_desc", 4), ("sequence", 4))
OBJECT_TEXTS = ("file_name", "captured", "modified", "keywords")
OBJECT_INFO = ", ".join([f"{k} long" for k, _ in OBJECT_FIELDS] + [f"{k} string" for k in OBJECT_TEXTS])


def object_info(data: bytes) -> Iterator[dict]:
    c = Cursor(data)
    yield {k: c.uint(n) for k, n in OBJECT_FIELDS} | {k: c.text() for k in OBJECT_TEXTS}


DEVICE_INFO = "standard int, extension_id long, extension_version int, extension string, mode int, operations array<bigint>, events array<bigint>, properties array<bigint>, capture_formats array<bigint>, image_formats array<bigint>, manufacturer string, model string, version string, serial string"


def device_info(data: bytes) -> Iterator[dict]:
    c = Cursor(data)
    row = {"standard": c.uint(2), "extension_id": c.uint(4), "extension_version": c.uint(2), "extension": c.text(), "mode": c.uint(2)}
    row |= {k: c.many(c.uint(4), 4) for k in ("operations", "events", "properties", "capture_formats", "image_formats")}
    yield row | {k: c.text() for k in ("manufacturer", "model", "version", "serial")}


STORAGE_INFO = "storage_type int, file_system int, access int, capacity long, free_bytes long, free_images long, description string, label string"


def storage_info(data: bytes) -> Iterator[dict]:
    """All-ones capacity means unknown and becomes null."""
    c = Cursor(data)
    row = {"storage_type": c.uint(2), "file_system": c.uint(2), "access": c.uint(2), "capacity": c.scalar(8), "free_bytes": c.scalar(8), "free_images": c.uint(4), "description": c.text(), "label": c.text()}
    row["capacity"] = None if row["capacity"] == -1 else row["capacity"]
    yield row


EXT_INFO = "version int, protocol_mode int, properties array<bigint>, controls array<bigint>"


def ext_info(data: bytes) -> Iterator[dict]:
    c = Cursor(data)
    v = c.uint(2)
    yield {"version": v, "protocol_mode": 3 if v == 300 else 2, "properties": c.many(c.uint(4), 4), "controls": c.many(c.uint(4), 4)}


LICENSES = "hours long, license string"


def licenses(data: bytes) -> Iterator[dict]:
    """All-ones hours mean no expiry and become null."""
    c = Cursor(data)
    for _ in range(c.uint(1)):
        hours = c.uint(4)
        yield {"hours": None if hours == 0xFFFFFFFF else hours, "license": c.take(c.uint(1)).decode("utf-8", "replace")}


OBJECT_PROP_DESC = f"prop int, type int, writable boolean, initial {VALUE}, group_id long, form int"


def object_prop_desc(data: bytes) -> Iterator[dict]:
    c = Cursor(data)
    row = {"prop": c.uint(2), "type": (kind := c.uint(2)), "writable": c.uint(1) == 1, "initial": c.value(kind), "group_id": None, "form": None}
    if c.left >= 4:
        row["group_id"] = c.uint(4)
        row["form"] = c.uint(1) if c.left else None
    yield row


EVENT = "code int, tx_id long, params array<bigint>"


def event(data: bytes) -> Iterator[dict]:
    """An event packet; the smaller of the declared and the actual length counts."""
    c = Cursor(data)
    length, kind, code, tx = c.uint(4), c.uint(2), c.uint(2), c.uint(4)
    if kind != 4:
        raise Short(f"container type {kind} is no event")
    end = min(length, len(data))
    yield {"code": code, "tx_id": tx, "params": [int.from_bytes(data[k : k + 4], "little") for k in range(12, end - 3, 4)]}


HISTOGRAM = "channel int, bin int, n long"


def histogram(data: bytes) -> Iterator[dict]:
    if len(data) != 4096:
        raise Short(f"{len(data)} bytes are no histogram")
    for k in range(1024):
        yield {"channel": k >> 8, "bin": k & 255, "n": int.from_bytes(data[4 * k : 4 * k + 4], "little")}


TIFF_ENTRY = "ifd int, tag int, type int, count long, value binary, offset long"
TIFF_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}


def tiff_entries(data: bytes) -> Iterator[dict]:
    """Every entry of every directory, sub-directories (tag 330) included; each directory once."""
    if data[:2] not in (b"II", b"MM"):
        raise Short("no TIFF byte order mark")
    c = Cursor(data, data[:2] == b"MM")
    c.at = 4
    todo, seen = [c.uint(4)], set()
    while todo:
        ifd = todo.pop(0)
        if not ifd or ifd in seen:
            continue
        seen.add(ifd)
        c.at = ifd
        n = c.uint(2)
        if n * 12 > c.left:
            raise Short(f"{n} entries do not fit")
        entries = [(c.uint(2), c.uint(2), c.uint(4), c.take(4)) for _ in range(n)]
        following = c.uint(4) if c.left >= 4 else 0
        for k, (tag, kind, count, inline) in enumerate(entries):
            size = TIFF_WIDTH.get(kind, 1) * count
            at = ifd + 2 + 12 * k + 8
            if size > 4:
                at = int.from_bytes(inline, c.order)
                if at + size > len(data):
                    raise Short(f"the value of tag {tag} leaves the file")
            value = data[at : at + size]
            yield {"ifd": ifd, "tag": tag, "type": kind, "count": count, "value": value, "offset": at}
            if tag == 330 and kind in (4, 13):
                todo += [int.from_bytes(value[j : j + 4], c.order) for j in range(0, len(value), 4)]
        todo.append(following)


def jpeg_span(data: bytes) -> Iterator[dict]:
    """First start of image to the last end behind it; without an end, to the end of the bytes."""
    a = data.find(b"\xff\xd8")
    if a < 0:
        raise Short("no start of image")
    b = data.rfind(b"\xff\xd9")
    yield {"image": data[a : b + 2] if b > a else data[a:]}


# --- writing, for round trips and fixtures ----------------------------------------


def put_text(s: str) -> bytes:
    units = len(s.encode("utf-16-le")) // 2
    if not s:
        return b"\0"
    if units > 254:
        raise ValueError("a counted string holds 254 units at most")
    return bytes([units + 1]) + s.encode("utf-16-le") + b"\0\0"


def put_value(kind: int, v) -> bytes:
    if kind == STRING:
        return put_text(v)
    if kind & ARRAY:
        return len(v).to_bytes(4, "little") + b"".join(put_value(kind & ~ARRAY, x) for x in v)
    return (v & ((1 << 8 * WIDTH[kind]) - 1)).to_bytes(WIDTH[kind], "little")
