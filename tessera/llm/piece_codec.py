"""Operator 2: exact SentencePiece (merge-type) encoding by backtracking, and decoding.

Encoding a run of characters takes the longest piece at each place (found for all places
at once by an Aho-Corasick automaton).  A piece may follow another only if merging their
joined characters by the model's scores gives these two back; such pairs are
remembered.  Where no piece fits, a shorter prefix is tried, then the last piece is
given up and its end is marked in a bitfield of failed positions, so no place is tried
twice.  A sequence whose adjacent pieces are all compatible is the one that merging the
whole run would give, so the result is exact.  No piece holds a space mark behind another
character, so words are encoded on their own and a bounded memo answers recurring ones.

Supported models: merge type (BPE), identity normalisation, no user-defined pieces; any
other is refused.  Defined results: a null text is an empty one (begin and end ids only);
repeated rows are kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MARK = "▁"
#: Words and pairs kept by one Python worker; a full memo is emptied.
MEMO_WORDS, MEMO_CHARS, MEMO_PAIRS = 500_000, 48, 2_000_000

_BREAK = re.compile("(?<=[^ ]) ")


class PieceCodec:
    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        spec.ParseFromString(sp.serialized_model_proto())
        norm, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        if spec.trainer_spec.model_type != 2 or len(norm.precompiled_charsmap) or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix or 4 in kinds or 5 in kinds:
            raise ValueError("only merge-type models with identity normalisation and no user-defined or unused pieces")
        self.prefix_space = norm.add_dummy_prefix
        n = len(spec.pieces)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        self.score = {p: (spec.pieces[i].score, -i) for p, i in normal.items()}
        self.id = normal
        self.by_word = not any(MARK in p.lstrip(MARK) for p in normal)
        #: what each id stands for when decoded
        self.plain = [b""] * n
        for p, i in normal.items():
            self.plain[i] = p.replace(MARK, " ").encode()
        for b, i in self.bytes.items():
            self.plain[i] = bytes([b])
        self.plain[self.unk] = " ⁇ ".encode()
        # pieces that merging can reach, their longest proper prefix, and the automaton over them
        reachable = [p for p in normal if self.merge(p) == [p]]
        self.reach = set(reachable)
        self.prefix = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reach), None) for p in reachable}
        self.automaton = ahocorasick.Automaton()
        for p in reachable:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo: dict[str, bytes] = {}

    def merge(self, run: str) -> list[str]:
        """The plain rule: join the adjacent pair of the best score, leftmost first, until none is a piece."""
        parts, score = list(run), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s[0] > best):
                    best, at = s[0], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether merging the joined characters of two pieces gives these two back."""
        got = self.pairs.get((a, b))
        if got is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            got = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return got

    def backtrack(self, run: str) -> list[str]:
        """Pieces of a run whose characters are all pieces themselves."""
        n = len(run)
        longest = [1] * n
        for end, size in self.automaton.iter(run):
            at = end - size + 1
            if size > longest[at]:
                longest[at] = size
        out: list[str] = []
        failed, at = 0, 0
        piece = run[: longest[0]]
        while True:
            end = at + len(piece)
            if not failed >> end & 1 and (not out or self.fits(out[-1], piece)):
                out.append(piece)
                at = end
                if at == n:
                    return out
                piece = run[at : at + longest[at]]
                continue
            shorter = self.prefix[piece]
            if shorter is not None:
                piece = shorter
                continue
            failed |= 1 << at
            if not out:
                raise ValueError("the model cannot encode this run")
            piece = out.pop()
            at -= len(piece)

    def run_ids(self, run: str) -> list[int]:
        """Ids of a run of characters; those outside the vocabulary become bytes and part what surrounds them."""
        ids: list[int] = []
        begin = 0
        for k in [*(k for k, c in enumerate(run) if c not in self.reach), len(run)]:
            if k > begin:
                ids += [self.id[p] for p in self.backtrack(run[begin:k])]
            if k < len(run):
                ids += [self.bytes[b] for b in run[k].encode()] if self.bytes else [self.unk]
            begin = k + 1
        return ids

    def word(self, word: str) -> bytes:
        got = self.memo.get(word)
        if got is None:
            got = np.array(self.run_ids(MARK + word.replace(" ", MARK)), dtype="<u4").tobytes()
            if len(word) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_WORDS:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit bytes."""
        body = b""
        if text:
            text = text.replace(MARK, " ")
            if not (self.by_word and self.prefix_space):
                body = np.array(self.run_ids((MARK if self.prefix_space else "") + text.replace(" ", MARK)), dtype="<u4").tobytes()
            else:
                if text[0] == " " or "  " in text:  # a run of spaces stays with the word behind it
                    words = [w[1:] for w in _cut_runs(" " + text)]
                else:
                    words = text.split(" ")
                memo = self.memo
                body = b"".join([memo[w] if w in memo else self.word(w) for w in words])
        ends = np.array([self.bos, self.eos], dtype="<u4").tobytes()
        return ends[:4] + body + ends[4:]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text, in UTF-8: pieces joined, space marks to spaces, the added space dropped."""
        plain = self.plain
        raw = b"".join([plain[i] for i in ids.tolist()])
        if self.prefix_space and raw[:1] == b" ":
            raw = raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = raw.decode(errors="replace").encode()
        return raw


def _cut_runs(text: str) -> list[str]:
    """Cut before the first space of every run of spaces (the text begins with one)."""
    at = [0, *(m.start() for m in _BREAK.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(at, at[1:])]


_codecs: dict[str, PieceCodec] = {}


def codec(model: str) -> PieceCodec:
    """One codec per worker process and model."""
    if model not in _codecs:
        _codecs[model] = PieceCodec(model)
    return _codecs[model]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def round_trip(docs: DataFrame, model: str | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded)."""
    model = model or default_model()
    common.ship(docs.sparkSession)
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        for batch in batches:
            c = codec(model)
            texts = batch.column(1).to_pylist()
            for some in tokens.chunks(texts):
                ids = [c.encode(t) for t in texts[some]]
                text = [c.decode(np.frombuffer(x, "<u4")) for x in ids]
                k = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(some.start, k), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, text), pa.string()), pa.array(ids if with_text else [None] * k, pa.binary()), pa.array([t.decode() for t in text] if with_text else [None] * k, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
    return out if with_text else out.drop("ids", "decoded")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_piece_codec": op2_piece_codec}
ORACLES: dict[str, str] = {}
