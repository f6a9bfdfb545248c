"""Byte-level BPE encoding with the ``tokenizers`` library, memoised by word.

The pre-tokenizer of such a vocabulary never joins the two sides of a single space
that stands between two non-space characters (the space goes with what follows), so a
text may be cut before every such space and the words encoded on their own.  Words
recur, so a bounded per-worker memo answers most of them; the library encodes the rest.
A word of letters, perhaps with punctuation behind it, is one or two pre-tokens, which
go to the library's BPE model directly; any other word goes through the whole library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Words kept by one Python worker; a full memo is emptied, so memory stays bounded.
MEMO_WORDS = 500_000
#: Longer words (bytes) are encoded each time and not kept.
MEMO_BYTES = 64

#: UTF-8 of what may make the space beside it part of a longer run of white space.
_BESIDE = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_BESIDE += [pair for c in b"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " for pair in (bytes([c, 32]), bytes([32, c]))]
_CUT = re.compile(r"(?<=\S) (?=\S)")
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ſ]+)([!-/:-@[-`{-~]*)")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Memo(dict):
    """Encoded words; a missing one is encoded on access."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: bytes) -> bytes:
        got = self.encode(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = got
        return got


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # the memo stands in for it
        spec = json.loads(self.tokenizer.to_str())
        pre = spec["pre_tokenizer"] or {}
        #: whether words can be cut out: a byte-level vocabulary without normalizer or added space
        self.by_word = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in spec["added_tokens"])
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"\b\B")
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = lambda text: "".join(p for p, _ in level.pre_tokenize_str(text))
        self.letters = {c: shown(chr(c)) for c in range(128)}
        for c in range(0xC0, 0x180):  # two UTF-8 bytes, two letters of the byte alphabet
            self.letters[c] = shown(chr(c))
        self.raw = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.first, self.inner = _Memo(lambda w: self._word("", w.decode())), _Memo(lambda w: self._word(" ", w.decode()))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _word(self, before: str, word: str) -> bytes:
        m = _PLAIN.fullmatch(word)
        if m is None or self.added.search(word):
            lines = word.split("\n")  # a line feed between two words is a pre-token of its own
            if len(lines) > 1 and all(map(_PLAIN.fullmatch, lines)) and not self.added.search(word):
                return self.first[b"\n"].join([(self.inner if before else self.first)[lines[0].encode()], *(self.first[x.encode()] for x in lines[1:])])
            return self._whole(before + word)
        got = b"".join([self.raw[t.id] for t in self.model.tokenize((before + m[1]).translate(self.letters))])
        return got + self.first[m[2].encode()] if m[2] else got

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(t) for t in texts]
        out, first, inner = [], self.first.__getitem__, self.inner.__getitem__
        for text in texts:
            raw = text.encode()
            if raw[:1] == b" " or raw[-1:] == b" " or any(b in raw for b in _BESIDE):
                words = [w.encode() for w in _CUT.split(text)]
            else:
                words = raw.split(b" ")
            head = words[0]
            words[0] = b""
            parts = list(map(inner, words))
            parts[0] = first(head) if head else b""
            out.append(b"".join(parts))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(vocabulary: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = WordEncoder(vocabulary)
    return _encoders[vocabulary]


def chunks(texts: list, most_chars: int = 1 << 20):
    """Slices of a list of texts with about ``most_chars`` characters each: bounded memory for any batch."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most_chars:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
