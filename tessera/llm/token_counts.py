"""Operator 11: token counts of whole texts, computed in batches that return lengths only.

One narrow pass: an Arrow function reads texts as UTF-8 bytes and hands nothing on but numbers.

* Long texts are split at safe boundaries.  For a byte-level vocabulary that is before a space
  between two non-space characters (the space goes with what follows) and around a line feed
  between two of them (it is a pre-token of its own); for a merge-type SentencePiece model
  without normalisation it is at such a space, which the dummy prefix of the second part
  stands for.  No token crosses these places, so lengths of parts add up.
* Words are parts as well, and recur.  A group of about ``GROUP_BYTES`` of text is cut into
  words, the distinct words that are not remembered yet are encoded by the library, in batches
  of at most ``BATCH_BYTES``, and every text adds up the lengths of its words.
* A vocabulary for which no boundary is known to be safe has its texts encoded whole, in
  batches balanced by bytes.

Memory: one group of words, the remembered lengths (about ``MEMO_BYTES``) and one
Arrow batch, whose bytes Spark bounds; none grows with the table.  No shuffle, no state on
disk: a lost executor costs its unfinished tasks.

Defined results: a null or empty text has 0 bytes and 0 tokens; special tokens that stand in
a text count as the library takes them by default; rows that repeat are counted each; an
empty table gives no rows; columns that are not asked for are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common, tokens

#: Tokens above which ``over_limit`` is set.
LIMIT = 512
#: Bytes of text whose words are looked at together, and of one call of the library.
GROUP_BYTES, BATCH_BYTES = 1 << 20, 1 << 18
#: Bytes that the remembered words of a worker take, and of these what Python needs for each beside
#: the word itself; beyond, all are forgotten at once, and frequent ones are soon back.
MEMO_BYTES, WORD_BYTES = 96 << 20, 150

#: Pairs of spaces and line feeds, and further white space in UTF-8: texts with any of these are cut with more care.
_PAIRS = (b"  ", b" \n", b"\n ", b"\n\n")
_FURTHER = (b"\t", b"\x0b", b"\x0c", b"\r", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
_MARK = "▁".encode()
_PIECE_CUT = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


class Lengths:
    """Numbers of tokens by the ``tokenizers`` library."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        pre, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.by_word = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
        self.first: dict[bytes, int] = {}
        self.inner: dict[bytes, int] = {}
        self.held = 0

    def batch(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, raw: bytes) -> tuple[list[bytes], list[bytes]]:
        """Words as they stand, and words with a space before them, whose lengths add up."""
        if raw[:1] in b" \n" or raw[-1:] in b" \n" or any(p in raw for p in _PAIRS) or any(c in raw for c in _FURTHER) or not raw.isascii() and any(c in raw for c in _WIDE):
            head, *rest = tokens._CUT.split(raw.decode())
            return [head.encode()], [w.encode() for w in rest]
        if b"\n" not in raw:
            head, *rest = raw.split(b" ")
            return [head], rest
        first, inner = [b"\n"] * raw.count(b"\n"), []
        for line in raw.split(b"\n"):
            head, *rest = line.split(b" ")
            first.append(head)
            inner += rest
        return first, inner

    def learn(self, memo: dict, words: set[bytes], before: str) -> None:
        new = [w for w in words if w not in memo]
        self.held += sum(map(len, new)) + WORD_BYTES * len(new)
        for part in balanced(list(map(len, new)), BATCH_BYTES):
            some = new[part]
            memo.update(zip(some, self.batch([before + w.decode() for w in some])))

    def group(self, texts: list[bytes]) -> list[int]:
        """Tokens of each text."""
        if not self.by_word:
            return self.batch([raw.decode() for raw in texts])
        if self.held > MEMO_BYTES:
            self.first.clear()
            self.inner.clear()
            self.held = 0
        cut = [self.words(raw) if raw else ([], []) for raw in texts]
        self.learn(self.first, set().union(*(a for a, _ in cut)), "")
        self.learn(self.inner, set().union(*(b for _, b in cut)), " ")
        first, inner = self.first.__getitem__, self.inner.__getitem__
        return [sum(map(first, a)) + sum(map(inner, b)) for a, b in cut]

    def parts(self, raw: bytes) -> Iterator[bytes]:
        """A long text in parts of about ``GROUP_BYTES`` that may be counted on their own."""
        if not self.by_word or len(raw) <= GROUP_BYTES:
            yield raw
            return
        text, begin = raw.decode(), 0
        while found := tokens._CUT.search(text, begin + GROUP_BYTES):
            yield text[begin : found.start()].encode()
            begin = found.start()
        yield text[begin:].encode()


class PieceLengths(Lengths):
    """Numbers of tokens by the ``sentencepiece`` library, without begin and end ids."""

    def __init__(self, model: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        norm, mark = spec.normalizer_spec, _MARK.decode()
        plain = spec.trainer_spec.model_type == 2 and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        self.by_word = plain and norm.add_dummy_prefix and not spec.trainer_spec.treat_whitespace_as_suffix and not any(mark in p.piece.lstrip(mark) for p in spec.pieces if p.type in (1, 4))
        self.first, self.inner, self.held = {}, {}, 0

    def batch(self, texts: list[str]) -> list[int]:
        return list(map(len, self.library.encode(texts, num_threads=1)))

    def words(self, raw: bytes) -> tuple[list[bytes], list[bytes]]:
        if raw[:1] == b" " or raw[-1:] == b" " or b"  " in raw or _MARK in raw:
            return [w.encode() for w in _PIECE_CUT.split(raw.decode())], []
        return raw.split(b" "), []

    def parts(self, raw: bytes) -> Iterator[bytes]:
        if not self.by_word or len(raw) <= GROUP_BYTES:
            yield raw
            return
        text, begin = raw.decode(), 0
        while found := _PIECE_CUT.search(text, begin + GROUP_BYTES):
            yield text[begin : found.start()].encode()
            begin = found.end()
        yield text[begin:].encode()


_counters: dict[str, Lengths] = {}


def counter(vocabulary: str) -> Lengths:
    """One counter per worker process and vocabulary: ``sentencepiece`` for ``.model``, ``tokenizers`` otherwise."""
    if vocabulary not in _counters:
        _counters[vocabulary] = (PieceLengths if vocabulary.endswith(".model") else Lengths)(vocabulary)
    return _counters[vocabulary]


def balanced(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices whose sizes add up to at most ``most`` (a larger single one stands alone)."""
    begin = total = 0
    for k, size in enumerate(sizes):
        if k > begin and total + size > most:
            yield slice(begin, k)
            begin, total = k, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def lengths(counter: Lengths, texts: list[bytes]) -> list[int]:
    """Tokens of whole texts, long ones part by part."""
    parts = [(k, p) for k, raw in enumerate(texts) for p in counter.parts(raw)] if any(len(t) > GROUP_BYTES for t in texts) else list(enumerate(texts))
    out = [0] * len(texts)
    for some in balanced([len(p) for _, p in parts], GROUP_BYTES):
        for (k, _), n in zip(parts[some], counter.group([p for _, p in parts[some]])):
            out[k] += n
    return out


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = LIMIT) -> DataFrame:
    """``keep`` + n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row."""
    added = ["n_bytes", "n_tokens", "over_limit"]
    if clash := {k.lower() for k in keep} & set(added):
        raise ValueError(f"columns to keep have names of results: {sorted(clash)}")
    common.ship(docs.sparkSession)
    schema = StructType([docs.schema[k] for k in keep]).add("n_bytes", "long").add("n_tokens", "long").add("over_limit", "boolean")

    def run(batches):
        count = counter(vocabulary)
        for batch in batches:
            *kept, column = batch.columns
            column = pc.fill_null(column, b"")
            sizes = pc.binary_length(column).cast(pa.int64())
            found = pa.array(lengths(count, column.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*kept, sizes, found, pc.greater(found, limit)], names=[*keep, *added])

    (raw,) = common.fresh(docs, "raw_text")
    return docs.select(*keep, F.col(text).cast("string").cast("binary").alias(raw)).mapInArrow(run, schema)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), tokens.default_vocabulary())


QUERIES = {"op11_token_counts": op11_token_counts}
#: SQL has no tokenizer; tests hold the counts against the library on whole texts.
ORACLES: dict[str, str] = {}
