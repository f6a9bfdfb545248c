"""Helpers shared by the operators: reading tables, scratch tables, prefix sums."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_scratch: list[tuple] = []
_shipped: "weakref.WeakSet" = weakref.WeakSet()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark itself (any file system it knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors of a real cluster; local masters share its folder."""
    sc = spark.sparkContext
    if sc.master.startswith("local") or sc in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master (tests) gets a temporary folder; any other
    master is refused, since a machine-local folder is not shared there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root[len("file://"):], True)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared scratch folder and read it again.

    Lost executors cost a re-run of unfinished tasks only; the committed table stays.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the written table of a :func:`materialize` that nothing reads any more."""
    _delete(df.sparkSession, df.scratch)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        if "/" not in path:
            spark.sql(f"DROP TABLE IF EXISTS {path}")
        else:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; its owner cleans the folder
        pass
    finally:
        _scratch.remove((spark, path))


def remember_table(spark: SparkSession, name: str) -> None:
    """A scratch table of the catalog (in the warehouse, which the cluster shares)."""
    _scratch.append((spark, name))


def drop_scratch(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables made so far (of one session, or of all)."""
    for s, path in list(_scratch):
        if spark is None or s is spark:
            _delete(s, path)


def scale_partitions(spark: SparkSession, least: int = 1) -> int:
    """How many partitions to deal rows to: the session's shuffle setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """Names like ``labels`` that are no columns of ``df``, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in labels:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def match_rows(docs: DataFrame, keys: DataFrame, how: str, **more: Column) -> DataFrame:
    """The rows of ``docs`` that ``keys(doc_id, text_key, ...)`` name (``left_semi``) or do not (``left_anti``).

    ``text_key`` is the 64-bit hash of the text; ``more`` gives what other columns of ``keys`` equal.
    """
    names = ["doc_id", "text_key", *more]
    new = fresh(docs, *(f"key_{n}" for n in names))
    same = F.col("doc_id").eqNullSafe(F.col(new[0])) & (F.xxhash64("text") == F.col(new[1]))
    for name, value in zip(new[2:], more.values()):
        same = same & value.eqNullSafe(F.col(name))
    return docs.join(keys.select(*(F.col(n).alias(a) for n, a in zip(names, new))), same, how)


def once(docs: DataFrame) -> DataFrame:
    """One of the rows that repeat ``doc_id`` and text."""
    key, n = fresh(docs, "row_key", "row_number")
    rows = docs.withColumn(key, F.xxhash64("text"))
    first = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(key))
    return rows.withColumn(n, first).where(F.col(n) == 1).select(*docs.columns)


#: A table of so many bytes may go to every executor.
BROADCAST_BYTES = 32 << 20


def join_small(big: DataFrame, small: DataFrame, on: list[str], spread: list[str], how: str = "inner", most: int = BROADCAST_BYTES, salts: int = 32) -> DataFrame:
    """``big`` joined to a written table that is small as a rule, without gathering a hot key of ``big``.

    The table's bytes are counted: up to ``most`` it is broadcast; beyond, every key is dealt
    to ``salts`` tasks by the ``spread`` columns of ``big``, with a copy of the small side each.
    """
    size = small.agg(F.sum(64 + F.octet_length(F.to_json(F.struct(*small.columns))))).first()[0] or 0
    if size <= most:
        return big.join(F.broadcast(small), on, how)
    (salt,) = fresh(big, "salt")
    dealt = big.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    return dealt.join(small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, salt], how).drop(salt)


def prefix_offsets(totals: DataFrame, key: str, total: str, offset: str) -> DataFrame:
    """Exclusive prefix sums of ``total`` in ``key`` order.

    ``totals`` has one row per partition of a written table, so its size is bounded
    by the number of partitions, not by the rows; that is why one task may order it
    and why the result may be broadcast.
    """
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(key, F.coalesce(F.sum(total).over(w), F.lit(0)).cast("long").alias(offset))


atexit.register(drop_scratch)
