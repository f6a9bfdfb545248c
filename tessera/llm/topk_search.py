"""Operator 7: exact top-k inner products by multi-resolution segment statistics.

Vectors become integers ``floor(scale * x)``.  A vector is cut into 1, 4, 16, ... equal
segments; of each segment its mean and its deviation (norm around the mean) are kept.
For a query q and a candidate x, with m the means, s the deviations and w the widths,

    |q - x|^2 >= sum over segments of w (mq - mx)^2 + (sq - sx)^2

is a lower bound of the distance, the tighter the finer the segments; with the exact
norms it is an upper bound of the inner product (|q|^2 + |x|^2 - |q - x|^2) / 2, which
multiplied out is the sum of w mq mx + sq sx.

Rows are put in order of their coarse statistics and written in blocks, each with a box:
the least and greatest mean and deviation of its rows for every segment.  A box bounds
all its rows at once, so for a block of queries

1. the boxes of all row blocks are bounded (boxes travel, rows do not),
2. the row block of the best bound is searched, which gives each query a k-th best score,
3. the other row blocks are visited only where a query's bound reaches that score.

Inside a block the rows' own bounds are taken coarse to fine the same way, and the
survivors' scores are computed exactly.  Blocks hold rows of one class of lengths and at most
``CELLS`` numbers, so a long vector costs its own block only.  A task holds one row block and about
``QUERIES_TOGETHER`` query blocks; it yields at most k rows a query, and a window over
these few picks the best k.  The query set is a stated one and every row is a candidate.

Defined results: null vectors, those with null or non-finite components (scaled or not)
and rows with a null ``vec_id`` take no part; an empty vector scores 0; of vectors of
unequal length the missing components count as 0; rows that repeat a ``vec_id`` are rows
of their own: each is a query with k results if its id is, and a candidate for all rows
but itself (results of such queries share their ``query_id``); scores beyond 64 bits are
ranked exactly and shown as the end of the range; an empty table gives no rows; columns
but ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, K, EVERY = 1024, 10, 100
QUERY_BLOCK, ROW_BLOCK = 256, 2048
#: Query blocks that meet a row block in one task, and boxes bounded at once.
QUERIES_TOGETHER, BOXES_TOGETHER = 32, 4096
#: Numbers of a block (rows times the longest one's length), which bounds it where vectors are long.
CELLS = 1 << 20
#: Segments of the successive levels (as many as the vector's length allows).
LEVELS = (1, 4, 16)
LONG = 2**63 - 1


def levels_of(dim: int) -> list[int]:
    return [n for n in LEVELS if n <= dim]


def segment_statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and widths of each row's segments."""
    cuts = np.linspace(0, x.shape[1], segments + 1).astype(int)
    widths = np.diff(cuts)
    means = np.add.reduceat(x, cuts[:-1], axis=1) / widths
    devs = np.sqrt(np.add.reduceat((x - np.repeat(means, widths, axis=1)) ** 2, cuts[:-1], axis=1))
    return means, devs, widths.astype(float)


def small(x: np.ndarray, *more: np.ndarray) -> float:
    """What to divide by so that squares stay within floating point (1 as a rule)."""
    return max(1.0, *(float(np.abs(y).max(initial=0)) / 1e100 for y in (x, *more)))


def box_of(x: np.ndarray) -> np.ndarray:
    """Least and greatest means, then greatest deviations, of a block at the finest level, and its greatest norm."""
    means, devs, _ = segment_statistics(x, levels_of(x.shape[1])[-1])
    return np.concatenate([means.min(axis=0), means.max(axis=0), devs.max(axis=0), [np.sqrt((x * x).sum(axis=1).max())]])


def box_bounds(q: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """(queries, boxes): upper bounds of the inner products with any row of each box."""
    n = levels_of(q.shape[1])[-1]
    means, devs, w = segment_statistics(q, n)
    low, high, dev, norm = boxes[:, :n], boxes[:, n : 2 * n], boxes[:, 2 * n : 3 * n], boxes[:, -1]
    # a positive mean meets the box's greatest mean, a negative one its least
    best = np.maximum(means, 0) @ (w * high).T + np.minimum(means, 0) @ (w * low).T + devs @ dev.T
    both = np.sqrt((q * q).sum(axis=1))[:, None] * norm
    return np.minimum(best, both) + 1e-9 * both + 1e-6  # the margin is above the rounding of the bound


def block_topk(q_rids: np.ndarray, q: np.ndarray, x_rids: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each query the (score, vec_id) of its k best rows of one block that reach ``least``, ties to smaller ids."""
    s = small(q, x)
    fq, fx = q / s, x / s
    stats = [(segment_statistics(fq, n), segment_statistics(fx, n)) for n in levels_of(x.shape[1])]
    q2, x2 = (fq * fq).sum(axis=1), (fx * fx).sum(axis=1)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52

    def bound(i: int, some: np.ndarray, level: int) -> np.ndarray:
        (mq, sq, w), (mx, sx, _) = stats[level]
        far = (w * (mx[some] - mq[i]) ** 2).sum(axis=1) + ((sx[some] - sq[i]) ** 2).sum(axis=1)
        both = q2[i] + x2[some]
        return (both - far) / 2 + 1e-9 * both + 1e-6

    def scores(i: int, some: np.ndarray) -> list[int]:
        if exact:
            return (x[some] @ q[i]).astype(np.int64).tolist()
        v = [int(a) for a in q[i].tolist()]
        return [sum(a * int(b) for a, b in zip(v, row)) for row in x[some].tolist()]

    out = []
    for i in range(len(q)):
        some, need = np.flatnonzero(x_rids != q_rids[i]), least[i] / s / s
        for level in range(len(stats)):
            high = bound(i, some, level)
            if len(some) > k and level < 2:
                # the k best by the coarse bounds raise the threshold
                first = some[np.argpartition(-high, k - 1)[:k]]
                need = max(need, float(min(scores(i, first))) / s / s if exact or s == 1 else need)
            some = some[high >= need]
        found = sorted(zip((-v for v in scores(i, some)), x_ids[some].tolist()))[:k]
        out.append([(-v, j) for v, j in found])
    return out


def order_key(score: int) -> bytes:
    """Bytes that sort as the scores at and beyond the ends of 64 bits do; empty for the others."""
    if -LONG < score < LONG:
        return b""
    n = -(-score.bit_length() // 8)
    raw = n.to_bytes(4, "big") + abs(score).to_bytes(n, "big")
    return b"\1" + raw if score > 0 else b"\0" + bytes(255 - c for c in raw)


def length_class(n: int) -> int:
    """The least power of two that is no less: rows of a block are of one class, and padded to their longest only."""
    return 1 << max(0, n - 1).bit_length()


def fitted(x: np.ndarray, dim: int) -> np.ndarray:
    """Rows cut or padded with zeros; components that the other side has not got count for nothing in a product."""
    if x.shape[1] >= dim:
        return x[:, :dim]
    out = np.zeros((len(x), dim))
    out[:, : x.shape[1]] = x
    return out


def _matrix(lists: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of list rows, padded with zeros; whole numbers that float64 holds exactly."""
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), dim))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(flat * scale)
    return out


def _cells(x: np.ndarray) -> np.ndarray:
    """A coarse cell of each row: in which quarter of the usual range the means of its four segments lie."""
    x = x / small(x)
    means, _, w = segment_statistics(x, min(4, x.shape[1]))
    z = means * np.sqrt(w) / np.maximum(np.sqrt((x * x).mean(axis=1)), 1e-300)[:, None]
    cell = np.zeros(len(x), np.int64)
    for c in z.T:
        cell = 4 * cell + np.searchsorted([-0.67, 0, 0.67], c)
    return cell


def row_blocks(vectors: DataFrame, is_query, scale: float, size: int) -> DataFrame:
    """block, first_rid, dim, ids, is_query, data and box of blocks of similar rows; written once."""

    def cells(batches):
        for batch in batches:
            sizes = np.diff(np.asarray(batch.column(1).offsets))
            classes = np.array([length_class(n) for n in sizes.tolist()], np.int64)
            for c in np.unique(classes).tolist():
                rows = np.flatnonzero(classes == c)
                for k in range(0, len(rows), max(1, CELLS // c)):
                    some = rows[k : k + max(1, CELLS // c)]
                    at = pa.array(some)
                    x = _matrix(batch.column(1).take(at), c, scale)
                    raw = pa.array([r[:n].tobytes() for r, n in zip(x, sizes[some].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array([c] * len(some), pa.int64()), pa.array(_cells(x)), pa.array(x[:, : c // 2 + 1].sum(axis=1)), raw], names=["vec_id", "asked", "class", "cell", "part", "x"])

    def blocks(batches):
        from pyspark import TaskContext

        task, n, held, now = TaskContext.get().partitionId(), 0, [], 1

        def close(rows, c):
            dim = max(1, *(len(r[2]) // 8 for r in rows))
            x = np.zeros((len(rows), dim))
            for k, r in enumerate(rows):
                x[k, : len(r[2]) // 8] = np.frombuffer(r[2], np.float64)
            first = (task << 40) + n
            values = (first, first, dim, np.array([r[0] for r in rows], np.int64).tobytes(), np.array([r[1] for r in rows], bool).tobytes(), x.tobytes(), box_of(fitted(x, c)).tobytes() if small(x) == 1 else None)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["block", "first_rid", "dim", "ids", "asked", "data", "box"])

        for batch in batches:
            for vec_id, asked, c, x in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5))):
                if held and (c != now or len(held) >= min(size, max(1, CELLS // now))):
                    yield close(held, now)
                    held, n = [], n + len(held)
                now = c
                held.append((vec_id, asked, x))
        if held:
            yield close(held, now)

    rows = vectors.select("vec_id", "v", is_query.alias("asked")).mapInArrow(cells, "vec_id long, asked boolean, class long, cell long, part double, x binary")
    # many equal vectors are split by a hash of their ids
    order = ["class", "cell", "part", "h"]
    dealt = rows.withColumn("h", F.xxhash64("vec_id")).repartitionByRange(common.scale_partitions(vectors.sparkSession), *order).sortWithinPartitions(*order).drop("h")
    return common.materialize(dealt.mapInArrow(blocks, "block long, first_rid long, dim long, ids binary, asked binary, data binary, box binary"), "topk-blocks")


def query_blocks(blocks: DataFrame, size: int) -> DataFrame:
    """qb, dim, rids, ids and data of blocks of the asked rows, in the order of the row blocks."""

    def run(batches):
        from pyspark import TaskContext

        task, n, now = TaskContext.get().partitionId(), 0, 0
        rids, ids, data = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1))

        def block(rids, ids, data):
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + n]), pa.array([data.shape[1]]), *(pa.array([v.tobytes()], pa.binary()) for v in (rids, ids, data))], names=["qb", "dim", "rids", "q_ids", "q"])

        for batch in batches:
            for first, dim, i, asked, d in zip(*(batch.column(c).to_pylist() for c in range(5))):
                some = np.flatnonzero(np.frombuffer(asked, bool))
                if not len(some):
                    continue
                if len(rids) and length_class(dim) != now:
                    yield block(rids, ids, data)
                    rids, ids, data, n = rids[:0], ids[:0], data[:0], n + 1
                now = length_class(dim)
                most = min(size, max(1, CELLS // now))
                width = max(dim, data.shape[1] if len(data) else 1)
                rids, ids = np.append(rids, first + some), np.append(ids, np.frombuffer(i, np.int64)[some])
                data = np.concatenate([fitted(data, width), fitted(np.frombuffer(d, np.float64).reshape(-1, dim)[some], width)])
                while len(rids) >= most:
                    yield block(rids[:most], ids[:most], data[:most])
                    rids, ids, data, n = rids[most:], ids[most:], data[most:], n + 1
        if len(rids):
            yield block(rids, ids, data)

    return common.materialize(blocks.select("first_rid", "dim", "ids", "asked", "data").mapInArrow(run, "qb long, dim long, rids binary, q_ids binary, q binary"), "topk-queries")


def bounded_pairs(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """qb, block, top (the best bound) and every query's bound, of all pairs of a query block and a row block's box."""
    chunks = max(1, -(-blocks.count() // BOXES_TOGETHER))
    boxes = blocks.select(F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int").alias("chunk"), "block", "dim", "box").groupBy("chunk").agg(F.collect_list(F.struct("block", "dim", "box")).alias("boxes"))
    asked = queries.select("qb", "dim", "q", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def run(batches):
        for batch in batches:
            for qb, dim, q, boxes in zip(*(batch.column(c).to_pylist() for c in range(4))):
                q = np.frombuffer(q, np.float64).reshape(-1, dim)
                # blocks of values beyond the range of squares are not bounded, so always visited
                high = np.full((len(q), len(boxes)), np.inf)
                groups: dict[int, list[int]] = {}
                for k, b in enumerate(boxes):
                    if b["box"] is not None and small(q) == 1:
                        groups.setdefault(length_class(b["dim"]), []).append(k)
                for c, at in groups.items():
                    known = np.frombuffer(b"".join(boxes[k]["box"] for k in at), np.float64).reshape(len(at), -1)
                    step = max(1, CELLS // c)
                    for k in range(0, len(q), step):
                        high[k : k + step, at] = box_bounds(fitted(q[k : k + step], c), known)
                per = list(high.T)
                yield pa.RecordBatch.from_arrays([pa.array([qb] * len(per), pa.int64()), pa.array([b["block"] for b in boxes], pa.int64()), pa.array([float(p.sum()) for p in per]), pa.array([p.tobytes() for p in per], pa.binary())], names=["qb", "block", "top", "bounds"])

    return common.materialize(asked.join(boxes, "chunk").select("qb", "dim", "q", "boxes").mapInArrow(run, "qb long, block long, top double, bounds binary"), "topk-bounds")


def search_pairs(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """``pairs(qb, block, least)``: qb, the new k-th best scores, and the (query, query_id, vec_id, score, key) found."""
    together = max(1, -(-queries.count() // QUERIES_TOGETHER))
    asked = pairs.withColumn("salt", F.pmod(F.xxhash64("qb"), F.lit(together)).cast("int"))
    wanted = asked.select(F.col("block").alias("x_block"), F.col("salt").alias("x_salt")).distinct()
    rows = blocks.join(wanted, F.col("block") == F.col("x_block")).select("x_block", "x_salt", "first_rid", "dim", "ids", "data")
    asked = asked.join(queries, "qb").select("block", "salt", "qb", "least", "dim", "rids", "q_ids", "q")

    def run(key, left, right):
        out = {n: [] for n in ("qb", "least", "found")}
        for row in right.to_pylist():
            ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"], np.float64).reshape(-1, row["dim"])
            x_rids = row["first_rid"] + np.arange(len(ids))
            for ask in left.to_pylist():
                rids, q = np.frombuffer(ask["rids"], np.int64), np.frombuffer(ask["q"], np.float64).reshape(-1, ask["dim"])
                least = np.frombuffer(ask["least"], np.float64) if ask["least"] is not None else np.full(len(q), -np.inf)
                shared = min(ask["dim"], row["dim"])
                got = block_topk(rids, q[:, :shared], x_rids, ids, x[:, :shared], k, least)
                out["qb"].append(ask["qb"])
                # a score that floating point cannot hold is no threshold
                out["least"].append(np.array([float(g[-1][0]) if len(g) == k and abs(g[-1][0]) < 1 << 1000 else -np.inf for g in got]).tobytes())
                out["found"].append([(int(r), int(i), j, min(max(v, -LONG - 1), LONG), order_key(v)) for r, i, g in zip(rids, np.frombuffer(ask["q_ids"], np.int64), got) for v, j in g])
        item = pa.struct([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("key", pa.binary())])
        found = pa.array([[dict(zip(("query", "query_id", "vec_id", "score", "key"), f)) for f in fs] for fs in out["found"]], pa.list_(item))
        return pa.table({"qb": pa.array(out["qb"], pa.int64()), "least": pa.array(out["least"], pa.binary()), "found": found})

    return asked.groupBy("block", "salt").cogroup(rows.groupBy("x_block", "x_salt")).applyInArrow(run, "qb long, least binary, found array<struct<query: long, query_id: long, vec_id: long, score: long, key: binary>>")


def reaching(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """Those pairs, with the thresholds, where a query's bound reaches its k-th best score so far (and the first block is another)."""

    def run(batches):
        for batch in batches:
            keep = [bool((np.frombuffer(b, np.float64) >= np.frombuffer(n, np.float64)).any()) for b, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3)], names=["qb", "block", "least"]).filter(pa.array(keep, pa.bool_()))

    rest = pairs.join(first.select("qb", F.col("block").alias("done"), "least"), "qb").where("block <> done")
    return rest.select("qb", "block", "bounds", "least").mapInArrow(run, "qb long, block long, least binary")


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``vectors(vec_id, embedding)``: query_id, rank, vec_id, score; ``is_query`` is a condition on vec_id."""
    common.ship(vectors.sparkSession)
    usable = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * F.lit(float(scale))) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(usable)
    blocks = row_blocks(rows, is_query, scale, row_block)
    queries = query_blocks(blocks, query_block)
    pairs = bounded_pairs(queries, blocks)
    start = pairs.groupBy("qb").agg(F.max_by("block", F.struct("top", "block")).alias("block"))
    found = common.materialize(search_pairs(start.withColumn("least", F.lit(None).cast("binary")), queries, blocks, k).join(start, "qb"), "topk-first")
    more = common.materialize(reaching(pairs, found), "topk-pairs")
    every = found.select("found").unionAll(search_pairs(more, queries, blocks, k).select("found")).select(F.inline("found"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("key"), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


QUERIES = {"op7_segment_topk": op7_segment_topk}
#: The whole query in SQL: exact integers, every row against the stated queries.
ORACLES = {
    "op7_segment_topk": """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.own, q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON x.own <> q.own
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""
}
