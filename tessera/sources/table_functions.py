"""The decoders as table functions for SQL: ``SELECT t.* FROM blobs, LATERAL decode_tiff(content) t``.

``decode_<kernel>(blob)`` gives the ordinal, the kernel's columns and the error of each record, as
``records.decode`` does; ``decode_<kernel>(blob, 'tag, value')`` only the named columns, of which
the schema is made when the query is analysed.  A null blob gives no row.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import cursor
from .records import KERNELS


def _asked(whole: StructType, fields: str | None) -> StructType:
    if fields is None:
        return whole
    names = [f.strip() for f in fields.split(",")]
    if unknown := [n for n in names if n not in whole.names]:
        raise ValueError(f"no such columns: {', '.join(unknown)}; there are {', '.join(whole.names)}")
    return StructType([whole[n] for n in names])


def table_function(kernel: str, schema: StructType):
    """The table function of a kernel; ``schema`` is that of its columns."""
    whole = StructType([*StructType().add("ordinal", IntegerType()).fields, *schema.fields, *StructType().add("error", StringType()).fields])
    own, function = schema.names, KERNELS[kernel][0]

    class Decode:
        @staticmethod
        def analyze(blob: AnalyzeArgument, fields: AnalyzeArgument | None = None) -> AnalyzeResult:
            if blob.dataType.typeName() not in ("binary", "void"):
                raise ValueError("the first argument is a binary column")
            if fields is not None and not fields.isConstantExpression:
                raise ValueError("the names of the columns must be constant")
            return AnalyzeResult(_asked(whole, None if fields is None else fields.value))

        def eval(self, blob: Any, fields: str | None = None):
            if blob is None:
                return
            names = _asked(whole, fields).names
            n = 0
            try:
                for row in function(bytes(blob)):
                    found = {"ordinal": n, "error": None} | row
                    yield tuple(found[c] for c in names)
                    n += 1
            except cursor.Short as e:
                found = {"ordinal": n, "error": str(e)} | dict.fromkeys(own)
                yield tuple(found[c] for c in names)

    # with Arrow, Spark makes a table of its own for every blob
    return udtf(Decode, useArrow=False)


def register(spark: SparkSession) -> list[str]:
    """Make every kernel known to SQL; the names."""
    for kernel, (_, ddl) in KERNELS.items():
        spark.udtf.register(f"decode_{kernel}", table_function(kernel, StructType.fromDDL(ddl)))
    return [f"decode_{k}" for k in KERNELS]
