"""The columnar cursor against the kernels that read one blob at a time."""

import random

import pyarrow as pa
import pytest

from tessera.functions import columnar, cursor
from tessera.sources import records

KINDS = [1, 2, 3, 4, 5, 6, 7, 8, 0x4001, 0x4002, 0x4004, 0x4005, 0x4008, 0xFFFF]


def value(rnd, kind):
    if kind == cursor.STRING:
        return cursor.put_text(rnd.choice(["", "a", "ä漢", "x" * rnd.randrange(40)]))
    one = lambda: rnd.getrandbits(8 * cursor.WIDTH[kind & ~cursor.ARRAY])
    return cursor.put_value(kind, [one() for _ in range(rnd.randrange(5))] if kind & cursor.ARRAY else one())


def u(v, n):
    return v.to_bytes(n, "little")


def prop_list(rnd):
    n = rnd.randrange(9)
    return u(n, 4) + b"".join(u(rnd.getrandbits(32), 4) + u(rnd.randrange(1 << 16), 2) + u(k, 2) + value(rnd, k) for k in rnd.choices(KINDS, k=n))


def snapshot(rnd):
    n, out = rnd.randrange(7), b""
    for k, kind in enumerate(rnd.choices(KINDS, k=n)):
        out += u(rnd.randrange(1 << 16), 2) + u(kind, 2) + bytes([rnd.randrange(2), rnd.randrange(2)]) + value(rnd, kind)
        if kind == cursor.STRING and k == n - 1 and rnd.random() < 0.5:
            break
        out += value(rnd, kind)
        form = rnd.choice([0, 1, 2, 2]) if kind < cursor.ARRAY else 0
        out += bytes([form])
        if form == cursor.RANGE:
            out += b"".join(value(rnd, kind) for _ in range(3))
        elif form == cursor.ENUM:
            for _ in range(rnd.choice([1, 2])):
                m = rnd.randrange(4)
                out += u(m, 2) + b"".join(value(rnd, kind) for _ in range(m))
    return u(n, 4) + bytes(4) + out


def descriptor(rnd):
    kind = rnd.choice([0, *KINDS])
    out = u(rnd.randrange(1 << 16), 2) + u(kind, 2) + bytes([rnd.randrange(2)])
    if kind:
        out += value(rnd, kind) + value(rnd, kind)
    form = rnd.choice([None, 0, 1, 2, 2])
    if form is None:
        return out
    out += bytes([form])
    one = kind if kind == cursor.STRING else kind & ~cursor.ARRAY
    if kind and form == cursor.RANGE:
        out += b"".join(value(rnd, one) for _ in range(3))
    elif kind and form == cursor.ENUM:
        m = rnd.randrange(5)
        out += u(m, 2) + b"".join(value(rnd, one) for _ in range(m))
    return out


def blobs(make, seed, n):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        b = make(rnd)
        kind = rnd.random()
        if kind < 0.3:
            b = b[: rnd.randrange(len(b) + 1)]
        elif kind < 0.5 and len(b) > 8:
            at = rnd.randrange(len(b))
            b = b[:at] + bytes([rnd.randrange(256)]) + b[at + 1 :]
        out.append(b)
    return [*out, b"", b"\0", bytes(4), bytes(8), u(3, 4), u(2**32 - 1, 4) + bytes(50)]


def plain(kernel, data):
    function, rows = records.KERNELS[kernel][0], []
    try:
        for row in function(data):
            rows.append((row, None))
    except cursor.Short as e:
        rows.append((None, str(e)))
    return rows


@pytest.mark.parametrize("kernel, make", [("prop_list", prop_list), ("snapshot", snapshot), ("descriptor", descriptor)])
def test_equal_on_random_and_cut_blobs(spark, kernel, make):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    data = blobs(make, 11, 3000)
    data = [b for b in data if kernel == "descriptor" or int.from_bytes(b[:4], "little") < 10_000 or len(b) < 60]
    fields = to_arrow_schema(StructType.fromDDL(records.KERNELS[kernel][1]))
    which, ordinal, columns, errors = columnar.decode(columnar.KERNELS[kernel], pa.array(data, pa.binary()), fields)
    got = list(zip(which.tolist(), ordinal.tolist(), *(c.to_pylist() for c in columns), errors.to_pylist()))
    want = []
    for k, b in enumerate(data):
        for n, (row, error) in enumerate(plain(kernel, b)):
            want.append((k, n, *((None,) * len(fields) if row is None else (row[f] for f in fields.names)), error))
    assert sum(e is not None for e in errors.to_pylist()) > 300
    assert got == want


def test_decode_in_spark(spark):
    data = blobs(prop_list, 12, 400)
    long = u(5000, 4) + b"".join(u(k, 4) + u(7, 2) + u(2, 2) + b"x" for k in range(4900))
    rows = [(k, "a", bytearray(b)) for k, b in enumerate([*data, long])] + [(-1, None, None)]
    df = spark.createDataFrame(rows, "id long, error2 string, raw binary").repartition(3)
    got = records.decode(df, "raw", "prop_list", ["id"]).collect()
    want = [(k, n, None if row is None else row["handle"], error) for k, b in enumerate([*data, long]) for n, (row, error) in enumerate(plain("prop_list", b))]
    assert sorted((r["id"], r["ordinal"], r["handle"], r["error"]) for r in got) == sorted(want, key=lambda w: w[:2])
    assert records.decode(df.limit(0), "raw", "snapshot", ["id"]).collect() == []
