"""Reading byte ranges of objects: a seek and a read for each, never the whole object."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import located

#: Bytes that a task gathers before it hands them on.
HELD = 16 << 20


def read_ranges(requests: DataFrame, path: str = "path", offset: str = "offset", length: str = "length") -> DataFrame:
    """``requests`` with the column ``bytes`` of the asked range (64-bit offsets).

    A range that passes the end is cut there, one behind the end is empty; a null or negative
    offset or length gives null, and so does an object that is not there.  Requests are dealt
    by object and ordered by offset, so a task opens an object once and reads forward; an object with
    many requests is dealt by stretches of its offsets as well.
    """
    if "bytes" in requests.columns:
        raise ValueError("requests have a column named bytes")
    schema = StructType([*requests.schema.fields, *StructType.fromDDL("bytes binary").fields])
    names = requests.columns
    at, o, n = names.index(path), names.index(offset), names.index(length)

    def run(batches):
        opened = source = None

        def fetch(uri, start, size):
            nonlocal opened, source
            if uri is None or start is None or size is None or start < 0 or size < 0:
                return None
            if uri != opened:
                files, place = located(uri)
                opened, source = uri, None
                try:
                    source = files.open_input_file(place)
                except FileNotFoundError:
                    pass
            if source is None:
                return None
            end = source.size()
            return source.read_at(min(size, end - start), start) if start < end else b""

        for batch in batches:
            begin, held, got = 0, 0, []
            for k, (uri, start, size) in enumerate(zip(*(batch.column(i).to_pylist() for i in (at, o, n)))):
                got.append(fetch(uri, start, size))
                held += len(got[-1] or b"")
                if held > HELD or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*batch.slice(begin, k + 1 - begin).columns, pa.array(got, pa.binary())], names=[*names, "bytes"])
                    begin, held, got = k + 1, 0, []

    stretch = F.floor(F.col(offset) / (256 << 20))
    dealt = requests.repartition(F.col(path), stretch).sortWithinPartitions(path, offset)
    return dealt.mapInArrow(run, schema)
