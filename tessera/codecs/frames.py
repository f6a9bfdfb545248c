"""Raw frames as tables: a row of metadata a frame, and tiles of samples that decode in parallel.

``open_frames`` reads the containers and lists each frame's independent units (strip, or
tiles of a tiled frame) with their bytes; ``decode_tiles`` deals the units to tasks and
turns them to samples.  A frame is never exploded to one row a pixel: a unit stays one
BINARY of 16-bit little-endian samples, and ``samples`` explodes a crop only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from ..functions import cursor
from . import lossless_jpeg

FRAME = "model string, width int, height int, depth int, pattern array<int>, pattern_w int, pattern_h int, black array<int>, white int, crop_x int, crop_y int, crop_w int, crop_h int"
UNIT = "unit int, x0 int, y0 int, w int, h int, codec string, bits int, knots array<int>, payload binary"

# Tags of the containers.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, MODEL, STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 272, 273, 279
TILE_W, TILE_H, TILES, TILE_BYTES, PATTERN_DIM, PATTERN, TONE, BLACK, WHITE, CROP_AT, CROP_SIZE = 322, 323, 324, 325, 33421, 33422, 0x7010, 0x7310, 0xC61D, 0xC61F, 0xC620
CFA, NONE, JPEG, PACKED = 32803, 1, 7, 32767


class Unsupported(ValueError):
    """A layout that is refused rather than guessed."""


def _names(ddl: str) -> list[str]:
    """Column names of a flat schema; workers have no session to parse it with."""
    return [c.split()[0] for c in ddl.split(", ")]


def _numbers(entry: dict, order: str) -> list[int]:
    size = cursor.TIFF_WIDTH.get(entry["type"], 1)
    v = entry["value"]
    return [int.from_bytes(v[k : k + size], order) for k in range(0, len(v), size)]


def tiff_frame(data: bytes) -> tuple[dict, list[dict]]:
    """The mosaic directory of a TIFF-like raw file: the frame and its units."""
    order = "big" if data[:2] == b"MM" else "little"
    dirs: dict[int, dict[int, dict]] = {}
    for e in cursor.tiff_entries(data):
        dirs.setdefault(e["ifd"], {})[e["tag"]] = e
    get = lambda d, tag, other=None: _numbers(d[tag], order) if tag in d else ([] if other is None else [other])
    model = next((d[MODEL]["value"].split(b"\0")[0].decode("latin-1") for d in dirs.values() if MODEL in d), "")
    raw = next((d for d in dirs.values() if get(d, PHOTOMETRIC) == [CFA]), None)
    if raw is None:
        raise Unsupported("no directory holds a mosaic")
    width, height, bits, how = (get(raw, tag, 0)[0] for tag in (WIDTH, LENGTH, BITS, COMPRESSION))
    dim = get(raw, PATTERN_DIM) or [2, 2]
    crop_at, crop = get(raw, CROP_AT) or [0, 0], get(raw, CROP_SIZE) or [0, 0]
    if not all(crop):
        crop_at, crop = [0, 0], [width, height]
    black = get(raw, BLACK)
    if len(black) > 1 and len(black) != dim[0] * dim[1]:
        black = black[:1]
    frame = dict(zip(_names(FRAME), (model, width, height, bits, get(raw, PATTERN), dim[0], dim[1], black, (get(raw, WHITE) or [0])[0], *crop_at, *crop)))
    piece = lambda a, n: data[a : a + n] if a > 0 and a + n <= len(data) else _past(a, n)
    if tiles := get(raw, TILES):
        sizes, tw, th = get(raw, TILE_BYTES), get(raw, TILE_W)[0], get(raw, TILE_H)[0]
        across, down = -(-width // tw), -(-height // th)
        if len(tiles) != len(sizes) or len(tiles) != across * down:
            raise Unsupported(f"{len(tiles)} tiles for {across} by {down}")
        if how != JPEG:
            raise Unsupported(f"tiles of compression {how}")
        return frame, [_unit(k, k % across * tw, k // across * th, tw, th, "jpeg", bits, [], piece(a, n)) for k, (a, n) in enumerate(zip(tiles, sizes))]
    at, size = get(raw, STRIP, 0)[0], get(raw, STRIP_BYTES, 0)[0]
    strip = piece(at, size)
    knots = [v >> 2 & 0xFFF for v in get(raw, TONE)[:4]]
    if how == NONE:
        codec = "packed"
    elif how == PACKED and bits == 12 and size == width * height:
        codec, frame["depth"], frame["white"] = "arw2", 14, frame["white"] or 16383
    elif how == JPEG or (how == PACKED and strip[:2] == b"\xff\xd8"):
        codec = "jpeg"
    else:
        raise Unsupported(f"compression {how} at {bits} bits")
    return frame, [_unit(0, 0, 0, width, height, codec, bits, knots if len(knots) == 4 else [], strip)]


def _past(at: int, n: int):
    raise cursor.Short(f"bytes {at}+{n} run past the file")


def _unit(*values) -> dict:
    return dict(zip(_names(UNIT), values))


RAF_MAGIC, RAF_MODEL, RAF_OFFSETS = b"FUJIFILMCCD-RAW ", 28, 84


def raf_frame(data: bytes) -> tuple[dict, list[dict]]:
    """A big-endian wrapper with a tagged header and an inner TIFF for the strip."""
    at = [int.from_bytes(data[RAF_OFFSETS + 4 * k : RAF_OFFSETS + 4 * k + 4], "big") for k in range(6)]
    if len(data) < RAF_OFFSETS + 24 or at[2] + at[3] > len(data) or at[4] + at[5] > len(data):
        raise cursor.Short("the header or the block runs past the file")
    head, block = cursor.Cursor(data[at[2] : at[2] + at[3]], big=True), data[at[4] : at[4] + at[5]]
    tags = {}
    for _ in range(head.uint(4)):
        if head.left < 4:
            break
        tag, n = head.uint(2), head.uint(2)
        if n > head.left:
            break
        tags[tag] = head.take(n)
    pair = lambda tag: [int.from_bytes(tags[tag][k : k + 2], "big") for k in (2, 0)] if tag in tags else [0, 0]
    pattern = list(tags.get(0x0131, b""))
    if len(pattern) != 36 or max(pattern) > 2:
        raise Unsupported("no 6 by 6 pattern")
    width, height = pair(0x0100)
    crop_at, crop = pair(0x0110), pair(0x0111)
    inner = {e["tag"]: e for e in _fuji_entries(block)}
    get = lambda tag: _numbers(inner[tag], "little") if tag in inner else [0]
    width, height = get(0xF001)[0] or width, get(0xF002)[0] or height
    bits, strip_at, size, black = get(0xF003)[0], get(0xF007)[0], get(0xF008)[0], get(0xF00A)
    if not bits or strip_at <= 0 or strip_at + size > len(block):
        raise cursor.Short("no depth or no strip")
    strip = block[strip_at : strip_at + size]
    frame = dict(zip(_names(FRAME), (data[RAF_MODEL : RAF_MODEL + 32].split(b"\0")[0].decode("latin-1"), width, height, bits, pattern, 6, 6, black if len(black) == 36 else black[:1], (1 << bits) - 1, *crop_at, *crop)))
    if strip[:2] == b"IS":
        raise Unsupported("block-compressed strip")
    if len(strip) != 2 * width * height:
        raise cursor.Short(f"{len(strip)} bytes for {width} by {height}")
    return frame, [_unit(0, 0, 0, width, height, "packed", 16, [], strip)]


def _fuji_entries(block: bytes) -> list[dict]:
    """Entries of the vendor directory that tag 0xF000 of the first one points to."""
    if block[:4] != b"II*\0":
        raise cursor.Short("no inner TIFF")
    root = list(cursor.tiff_entries(block))
    sub = next((e for e in root if e["tag"] == 0xF000), None)
    if sub is None:
        raise Unsupported("no vendor directory")
    at = int.from_bytes(sub["value"][:4], "little")
    return list(cursor.tiff_entries(block[:4] + at.to_bytes(4, "little") + block[8:]))


def open_frame(data: bytes) -> tuple[dict, list[dict]]:
    if data[:16] == RAF_MAGIC:
        return raf_frame(data)
    if data[:2] in (b"II", b"MM"):
        return tiff_frame(data)
    raise Unsupported("neither container is recognised")


def check_frame(frame: dict) -> str | None:
    """The first structural error of a frame."""
    if frame["width"] <= 0 or frame["height"] <= 0:
        return f"dimensions {frame['width']} by {frame['height']}"
    cells = frame["pattern_w"] * frame["pattern_h"]
    if cells <= 0 or len(frame["pattern"]) != cells:
        return f"{len(frame['pattern'])} pattern entries for {cells} cells"
    if len(frame["black"]) not in (0, 1, cells):
        return f"{len(frame['black'])} black levels for {cells} cells"
    return None


# --- sample codecs -------------------------------------------------------------------


def unpack(strip: bytes, n: int, bits: int) -> np.ndarray:
    """Samples of 12, 14 or 16 bits, least significant first, without row padding."""
    if bits not in (12, 14, 16):
        raise Unsupported(f"{bits} bits a sample")
    if len(strip) < (n * bits + 7) // 8:
        raise cursor.Short(f"{len(strip)} bytes for {n} samples")
    if bits == 16:
        return np.frombuffer(strip, "<u2", n)
    raw = np.frombuffer(strip + bytes(4), np.uint8).astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * bits
    word = raw[at >> 3] | raw[(at >> 3) + 1] << 8 | raw[(at >> 3) + 2] << 16
    return ((word >> (at & 7).astype(np.uint32)) & ((1 << bits) - 1)).astype(np.uint16)


def tone_curve(knots: list[int]) -> np.ndarray:
    """4,096 entries: segments between the knots with steps 1, 2, 4, 8, 16; identity without knots."""
    v = np.arange(4096)
    if len(knots) != 4:
        return v.astype(np.uint16)
    edges = [0, *knots, 4095]
    return sum(np.clip(np.minimum(v, b) - a, 0, None) << k for k, (a, b) in enumerate(zip(edges, edges[1:]))).astype(np.uint16)


def unpack_arw2(strip: bytes, width: int, height: int, knots: list[int]) -> np.ndarray:
    """16 bytes hold 16 samples of every other column: two extremes, their places, 7-bit steps above the lesser.

    Columns behind the last whole span of a row stay zero.
    """
    if len(strip) < width * height:
        raise cursor.Short(f"{len(strip)} bytes for {width} by {height}")
    spans = sum(1 for c in range(0, width, 32) if c < width - 30)
    groups = min(2 * spans, width // 16)
    raw = np.frombuffer(strip, np.uint8, width * height).reshape(height, width)[:, : 16 * groups].reshape(-1, 16)
    low, high = raw[:, :8].copy().view("<u8")[:, 0], raw[:, 8:].copy().view("<u8")[:, 0]
    most, least = (low & 0x7FF).astype(np.int64), (low >> 11 & 0x7FF).astype(np.int64)
    at_most, at_least = (low >> 22 & 15).astype(np.int64), (low >> 26 & 15).astype(np.int64)
    shift = np.zeros(len(raw), np.int64)
    for _ in range(4):
        shift += (0x80 << shift) <= most - least
    shift = np.minimum(shift, 4)
    out, taken = np.empty((len(raw), 16), np.int64), np.zeros(len(raw), np.int64)
    for k in range(16):
        bit = 30 + 7 * taken
        inner = np.where(bit < 64, low >> np.minimum(bit, 63).astype(np.uint64), 0)
        cross = np.where((bit > 57) & (bit < 64), high << (64 - np.minimum(bit, 64)).astype(np.uint64) % np.uint64(64), 0)
        outer = np.where((bit >= 64) & (bit < 128), high >> np.maximum(bit - 64, 0).astype(np.uint64) % np.uint64(64), 0)
        v = ((inner | cross | outer) & 0x7F).astype(np.int64)
        plain = (k != at_most) & (k != at_least)
        out[:, k] = np.where(k == at_most, most, np.where(k == at_least, least, np.minimum(0x7FF, (v << shift) + least)))
        taken += plain
    px = np.zeros((height, width + 32), np.uint16)
    value = tone_curve(knots)[out << 1].reshape(height, groups, 16)
    for g in range(groups):
        col = 32 * (g // 2) + (g & 1)
        px[:, col : col + 32 : 2] = value[:, g]
    return px[:, :width]


def decode_unit(unit: dict) -> np.ndarray:
    """Samples of one strip or tile as (h, w)."""
    w, h = unit["w"], unit["h"]
    if unit["codec"] == "packed":
        return unpack(unit["payload"], w * h, unit["bits"]).reshape(h, w)
    if unit["codec"] == "arw2":
        return unpack_arw2(unit["payload"], w, h, list(unit["knots"]))
    out = lossless_jpeg.mosaic(lossless_jpeg.decode(lossless_jpeg.Scan(unit["payload"])))
    if out.shape != (h, w):
        raise Unsupported(f"a stream of {out.shape[1]} by {out.shape[0]} for a unit of {w} by {h}")
    return out


# --- Spark operators -----------------------------------------------------------------


def _rows(df: DataFrame, columns: list[str], keys: list[str], ddl: str, each) -> DataFrame:
    """mapInArrow with one output row per dict of ``each(row)``, keys first, ``error`` last."""
    fields = StructType.fromDDL(ddl + ", error string")
    kinds = [df.schema[k].dataType for k in keys]
    types = [*map(to_arrow_type, kinds), *to_arrow_schema(fields).types]
    names = [*keys, *fields.names]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                try:
                    out: Iterator[dict] = list(each(row))
                except (cursor.Short, Unsupported, lossless_jpeg.Malformed) as e:
                    out = [{"error": str(e)}]
                cols = [[row[n] if n in keys else o.get(n) for o in out] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    schema = StructType()
    for n, kind in zip(keys, kinds):
        schema.add(n, kind)
    for f in fields:
        schema.add(f)
    return df.select(*columns).mapInArrow(run, schema)


def open_frames(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row a unit: the key, the frame's columns, the unit's columns, and an error where the file is refused."""

    def each(row):
        frame, units = open_frame(row[content])
        if error := check_frame(frame):
            raise Unsupported(error)
        return [frame | u for u in units]

    return _rows(files, [key, content], [key], f"{FRAME}, {UNIT}", each)


def decode_tiles(units: DataFrame, key: str = "path", partitions: int | None = None) -> DataFrame:
    """Samples of each unit, clipped to the frame: key, unit, x0, y0, w, h, samples (16-bit little-endian)."""

    def each(row):
        px = decode_unit(row)[: max(0, row["height"] - row["y0"]), : max(0, row["width"] - row["x0"])]
        return [{"unit": row["unit"], "x0": row["x0"], "y0": row["y0"], "w": px.shape[1], "h": px.shape[0], "samples": np.ascontiguousarray(px).astype("<u2").tobytes()}]

    good = units.where("error IS NULL")
    dealt = good.repartition(partitions, key, "unit") if partitions else good.repartition(key, "unit")
    columns = [key, "width", "height", *_names(UNIT)]
    return _rows(dealt, columns, [key], "unit int, x0 int, y0 int, w int, h int, samples binary", each)


def samples(tiles: DataFrame, x0: int, y0: int, w: int, h: int, key: str = "path") -> DataFrame:
    """Pixels (x, y, v) of one crop; only the tiles it touches are exploded, and only its part of them."""
    touched = tiles.where((F.col("x0") < x0 + w) & (F.col("x0") + F.col("w") > x0) & (F.col("y0") < y0 + h) & (F.col("y0") + F.col("h") > y0))
    ys = F.sequence(F.greatest(F.col("y0"), F.lit(y0)), F.least(F.col("y0") + F.col("h"), F.lit(y0 + h)) - 1)
    xs = F.sequence(F.greatest(F.col("x0"), F.lit(x0)), F.least(F.col("x0") + F.col("w"), F.lit(x0 + w)) - 1)
    px = touched.withColumn("y", F.explode(ys)).withColumn("x", F.explode(xs))
    at = ((F.col("y") - F.col("y0")) * F.col("w") + F.col("x") - F.col("x0")) * 2
    byte = lambda k: F.conv(F.hex(F.substring(F.col("samples"), at + 1 + k, F.lit(1))), 16, 10).cast("int")
    return px.select(key, "x", "y", (byte(0) + byte(1) * 256).alias("v"))
