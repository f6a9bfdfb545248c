"""Token counts of whole texts against the libraries."""

import random

import public_tokenizers
import pytest

from tessera.llm import token_counts as C

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")


def plain(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(sp.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    return [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


def odd_texts(seed, n):
    """Texts of letters, marks and every kind of white space, side by side."""
    rnd = random.Random(seed)
    parts = ["the", "Inha", "don't", "é", "漢字", "▁", "x" * 90, "12345", "…", "<|endoftext|>", "<s>", ".", "!!"]
    gaps = [" "] * 12 + ["\n"] * 4 + ["  ", "\n\n", " \n", "\n ", "\t", "\r\n", " ", " ", "　", "\u0085", "\x1c", "", "▁"]
    return ["".join(rnd.choice(parts) + rnd.choice(gaps) for _ in range(rnd.randrange(30))) for _ in range(n)] + ["", " ", "\n", " a", "a ", "\na", "a\n", "a\nb", "▁▁", " ▁a"]


@pytest.mark.parametrize("name", FILES)
def test_random_texts(name):
    texts = odd_texts(7, 1500)
    count = C.counter(public_tokenizers.path(name))
    assert count.by_word == (name != "word_bpe_49k.json")
    assert C.lengths(count, [t.encode() for t in texts]) == plain(name, texts)


@pytest.mark.parametrize("name", FILES)
def test_long_texts_are_split(name, monkeypatch):
    monkeypatch.setattr(C, "GROUP_BYTES", 200)
    monkeypatch.setattr(C, "BATCH_BYTES", 50)
    monkeypatch.setattr(C, "MEMO_BYTES", 500)
    texts = [" ".join(odd_texts(k, 60)) for k in range(8)] + ["x" * 5000, "a " * 3000, "ab " * 3000 + "\n" * 40]
    count = C.counter(public_tokenizers.path(name))
    parts = [len(p) for p in count.parts(texts[-1].encode())]
    assert (len(parts) > 20 and max(parts) < 300) == count.by_word
    assert C.lengths(count, [t.encode() for t in texts]) == plain(name, texts)


def test_balanced():
    sizes = [5, 1, 1, 9, 2, 2, 2, 30, 1]
    parts = list(C.balanced(sizes, 6))
    assert [k for p in parts for k in range(len(sizes))[p]] == list(range(len(sizes)))
    assert all(sum(sizes[p]) <= 6 or p.stop - p.start == 1 for p in parts)
    assert list(C.balanced([], 6)) == []


def test_rows(spark, odd_docs, no_docs):
    path = public_tokenizers.path(FILES[0])
    got = C.count_tokens(odd_docs, path, keep=("doc_id", "lang"), limit=5).collect()
    rows = odd_docs.collect()
    texts = [r["text"] or "" for r in rows]
    want = [(r["doc_id"], r["lang"], len(t.encode()), n, n > 5) for r, t, n in zip(rows, texts, plain(FILES[0], texts))]
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert C.count_tokens(no_docs, path).collect() == []
    with pytest.raises(ValueError, match="n_tokens"):
        C.count_tokens(odd_docs.withColumn("n_tokens", odd_docs["part"]), path, keep=("n_tokens",))


def test_query_counts_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r)[1:] for r in C.op11_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    counts = plain(FILES[0], [r["text"] or "" for r in rows])
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 512) for r, n in zip(rows, counts)}
