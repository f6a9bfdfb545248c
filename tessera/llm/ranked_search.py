"""Operator 13: ranked lexical search of all documents, term-at-a-time over short lists, document-at-a-time over long ones.

The stated items are the queries.  Two narrow passes, a grouped count between them:

1. *Index.*  An Arrow function cuts whole texts into terms and writes, for every document with
   terms, its length and the frequencies of those terms that any item has.  From that written
   table come N, L and the document frequencies, hence the weight of each term.
2. *Search.*  A task turns the documents it reads into segments of at most ``SEGMENT_DOCS``
   documents and ``SEGMENT_POSTINGS`` postings, each with inverted lists of exact impacts in the
   order of ids.  For each item and segment

   * the short lists (at most one document in ``SHORT``) are summed term at a time into
     accumulators; with the greatest sum of each block of documents they are one bounded iterator;
   * this iterator and the long lists, bounded by their greatest impact in each block, are walked
     document at a time, block by block: a block whose bounds do not reach the item's k-th best
     score is skipped; in the others the long lists are added from the greatest bound down, only
     at documents that can still reach it, by jumping in the list where those are few.

   The k-th best score carries over the segments of a task, which yields at most k rows an item.

A window over these few rows (k for each task and item) ranks them.  A bound that equals the k-th
score is not skipped, since a tie may go to a smaller id, so the result is exact.

Items are taken in blocks of about ``ITEM_BYTES`` of text (their terms travel to every task), as
many blocks as the items need; each reads the documents again.

Terms are runs of ASCII letters and digits and of characters beyond ASCII; only A-Z are lower-cased.

Defined results: null and empty texts hold no terms, so such documents do not count and such
items give no rows; a null id sorts behind all others; rows that repeat a ``doc_id`` are documents
of their own; rows that repeat an item's id and text are one item, those with another text items of
their own; empty tables give no rows; a term that all documents hold may weigh 0 and then counts
for nothing; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from math import floor, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import balanced

K = 50
#: Bytes of items that are searched for together.
ITEM_BYTES = 4 << 20
SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK = 16384, 4_000_000, 1024
#: A list is short if it holds at most one document in so many of its segment.
SHORT = 16
#: Where at most one document in so many can still reach the k-th score, lists are probed instead of added.
PROBE = 8
#: Bytes of text that are cut into terms together.
GROUP_BYTES = 1 << 20
MISSING = 2**63 - 1
INDEX = "doc_id long, missing boolean, n long, terms array<int>, tfs array<int>"

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


def slices(raw: bytes) -> Iterator[bytes]:
    """A long text in parts that cut no term."""
    plain, begin = raw.translate(_TERM_BYTES), 0
    while begin < len(plain):
        end = plain.find(b" ", begin + GROUP_BYTES)
        yield plain[begin : end if end >= 0 else len(plain)]
        begin = end if end >= 0 else len(plain)


def frequencies(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of the texts in terms, and (text, term, frequency) of the terms in the vocabulary, in order."""
    get, width = vocabulary.get, max(1, len(vocabulary))
    if len(texts) == 1 and len(texts[0]) > GROUP_BYTES:
        n, found = 0, Counter()
        for part in slices(texts[0]):
            words = part.split()
            n += len(words)
            found.update(map(get, words, repeat(-1)))
        found.pop(-1, None)
        terms = np.array(sorted(found), np.int64)
        return np.array([n]), np.zeros(len(terms), np.int64), terms, np.array([found[t] for t in terms.tolist()], np.int64)
    cut = [terms_of(t) for t in texts]
    lengths = np.array([len(words) for words in cut], np.int64)
    ids = np.fromiter((i for words in cut for i in map(get, words, repeat(-1))), np.int64, int(lengths.sum()))
    keys = (np.repeat(np.arange(len(texts)), lengths) * width + ids)[ids >= 0]
    keys, tfs = np.unique(keys, return_counts=True)
    return lengths, keys // width, keys % width, tfs


def index(docs: DataFrame, vocabulary: dict[bytes, int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Length and frequencies of the vocabulary's terms of each document that has terms."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), b"").to_pylist()
            for part in balanced(list(map(len, texts)), GROUP_BYTES):
                lengths, owner, terms, tfs = frequencies(texts[part], vocabulary)
                some = np.flatnonzero(lengths)
                bounds = np.append(np.searchsorted(owner, some), len(owner)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (terms, tfs)]
                own = ids.slice(part.start, part.stop - part.start).take(pa.array(some))
                yield pa.RecordBatch.from_arrays([own, pc.is_null(own), pa.array(lengths[some]), *lists], names=["doc_id", "missing", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("raw"))
    return rows.mapInArrow(run, INDEX)


def term_weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def length_norms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """100 - 50 + ((50 n N) div L), also where the product leaves 64 bits."""
    if 50 * int(n.max(initial=0)) * n_docs < 2**63:
        return 50 + 50 * n * n_docs // total
    return np.array([50 + 50 * x * n_docs // total for x in n.tolist()], np.int64)


class Segment:
    """Inverted lists of a bounded number of documents, with impacts and their bounds by block."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, total: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.size = ids[order], len(ids)
        owner = np.repeat(np.arange(len(ids)), sizes)
        tfs = tfs.astype(np.int64)
        impact = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * length_norms(n, n_docs, total)[owner]))
        by = np.lexsort((place[owner], terms))
        self.docs, self.impacts, terms = place[owner][by], impact[by], terms[by]
        here, starts, counts = np.unique(terms, return_index=True, return_counts=True)
        self.lists = {t: (s, s + c) for t, s, c in zip(here.tolist(), starts.tolist(), counts.tolist()) if weights[t] > 0}
        self.blocks = -(-self.size // BLOCK)
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def long_list(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each block the greatest impact, and where its part of the list begins."""
        if t not in self.bounds:
            a, b = self.lists[t]
            cuts = np.searchsorted(self.docs[a:b], np.arange(self.blocks + 1) * BLOCK) + a
            most = np.zeros(self.blocks, np.int64)
            full = np.flatnonzero(np.diff(cuts))
            most[full] = np.maximum.reduceat(self.impacts[:b], cuts[full])
            self.bounds[t] = most, cuts
        return self.bounds[t]

    def search(self, terms: list[int], best: "Best") -> None:
        """Offer the documents that may be among the best of one item."""
        here = [t for t in terms if t in self.lists]
        length = lambda t: self.lists[t][1] - self.lists[t][0]
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        long = []
        for t in here:  # term at a time
            if length(t) * SHORT <= self.size:
                a, b = self.lists[t]
                sums[self.docs[a:b]] += self.impacts[a:b]
            else:
                long.append(t)
        iterator = sums.reshape(self.blocks, BLOCK)
        lists = [self.long_list(t) for t in long]
        bounds = np.array([most for most, _ in lists], np.int64).reshape(len(lists), self.blocks)
        reach = iterator.max(axis=1) + bounds.sum(axis=0)
        for block in range(self.blocks):  # document at a time, skipping
            if reach[block] < max(1, best.least):
                continue
            first, now = block * BLOCK, iterator[block]
            rest = int(bounds[:, block].sum())
            some = None
            for k in np.argsort(-bounds[:, block], kind="stable").tolist():
                if not bounds[k, block]:
                    break
                able = now + rest >= best.least if some is None else now[some] + rest >= best.least
                a, b = lists[k][1][block : block + 2].tolist()
                rest -= int(bounds[k, block])
                if some is None and PROBE * int(able.sum()) > BLOCK:
                    now[self.docs[a:b] - first] += self.impacts[a:b]
                    continue
                some = np.flatnonzero(able) if some is None else some[able]
                if not len(some):
                    break
                at = np.searchsorted(self.docs[a:b], some + first)
                hit = (at < b - a) & (self.docs[a + np.minimum(at, b - a - 1)] == some + first)
                now[some[hit]] += self.impacts[a + at[hit]]
            some = np.arange(BLOCK) if some is None else some
            some = some[now[some] >= max(1, best.least)]
            if len(some):
                best.offer(now[some], self.ids[first + some])


class Best:
    """The k best (score, id) of one item so far; ties go to smaller ids."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.scores = self.ids = np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def best_of_tasks(found: DataFrame, items: list[list[int]], weights: np.ndarray, n_docs: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score) of the k best documents of each task."""

    def run(batches):
        best = [Best(k) for _ in items]
        held: list[tuple] = []

        def close():
            if held:
                segment = Segment(*(np.concatenate(x) for x in zip(*held)), weights, n_docs, total)
                for terms, b in zip(items, best):
                    segment.search(terms, b)
                held.clear()

        for batch in batches:
            ids, missing, n, terms, tfs = batch.columns
            ids = np.where(missing.to_numpy(zero_copy_only=False), MISSING, pc.fill_null(ids, 0).to_numpy())
            n, sizes = n.to_numpy(), np.diff(terms.offsets.to_numpy()).astype(np.int64)
            ends = np.append(0, np.cumsum(sizes))
            flat = [x.flatten().to_numpy() for x in (terms, tfs)]
            begin = 0
            while begin < len(ids):
                docs, postings = sum(len(x[0]) for x in held), sum(len(x[3]) for x in held)
                end = min(len(ids), begin + SEGMENT_DOCS - docs)
                end = max(begin + (not held), min(end, int(np.searchsorted(ends, ends[begin] + SEGMENT_POSTINGS - postings, "right")) - 1))
                if end > begin:
                    held.append((ids[begin:end], n[begin:end], sizes[begin:end], *(x[ends[begin] : ends[end]] for x in flat)))
                if end < len(ids):
                    close()
                begin = end
        close()
        rows = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([np.full(len(b.ids), i) for i, b in enumerate(best)], [b.ids for b in best], [b.scores for b in best])]
        ids = pa.array(rows[1], pa.int64(), mask=rows[1] == MISSING)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0].astype(np.int32)), ids, pa.array(rows[2])], names=["item", "doc_id", "score"])

    return found.where(F.size("terms") > 0).mapInArrow(run, "item int, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, rank, doc_id and score of the k best documents of each item."""
    spark = docs.sparkSession
    common.ship(spark)
    asked = items.select(F.col(item_id).alias("item_id"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    size = asked.agg(F.sum(64 + F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_BYTES))
    out = [_rank_block(docs, asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), k, doc_id, text) for b in range(blocks)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def _rank_block(docs: DataFrame, asked: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.orderBy("item_id", "text").collect()  # about ITEM_BYTES
    vocabulary: dict[bytes, int] = {}
    terms = [[vocabulary.setdefault(w, len(vocabulary)) for w in dict.fromkeys(terms_of(r["text"].encode()))] for r in rows]
    found = common.materialize(index(docs, vocabulary, doc_id, text), "ranked-index")
    n_docs, total = found.agg(F.count("*"), F.sum("n")).first()
    weights = np.full(len(vocabulary), 0, np.int64)
    for t, df in found.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the items
        weights[t] = max(0, term_weight(n_docs, df))
    best = best_of_tasks(found, terms, weights, n_docs, total or 1, k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, item_id {asked.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # names: at most ITEM_BYTES / 64 rows


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_CUT = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS MATERIALIZED (SELECT r, {_CUT} FROM docs),
lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
asked AS (SELECT DISTINCT i, item_id, term FROM (SELECT dense_rank() OVER (ORDER BY item_id, text) AS i, item_id, {_CUT} FROM benchmark WHERE text IS NOT NULL)),
tfs AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole),
impacts AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // total))) AS impact FROM tfs JOIN weights USING (term) JOIN lengths USING (r), whole),
scores AS (SELECT i, any_value(item_id) AS item_id, r, CAST(sum(impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY i, r HAVING sum(impact) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores JOIN docs USING (r)) WHERE rank <= {K}"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": _SQL}
