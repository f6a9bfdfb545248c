"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import zlib

import brute
import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common, license_scan, line_templates, packing, piece_codec, quality_bayes, registry, simhash_pivots, suffix_dedup, token_files, topk_search, webp_media

SF = "/root/testdata/sf0.001"
sha = lambda b: hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return common.table(spark, SF, "documents")


def by_id(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))


# 1


@pytest.mark.parametrize("n", [2, 24, 60, 400])
def test_suffix_dedup(spark, docs, n):
    rnd = random.Random(n)
    base = ["".join(rnd.choice("abé ") for _ in range(300)) for _ in range(4)]
    rows = [(k, "".join(rnd.choice(base)[a : a + rnd.randrange(200)] for a in rnd.sample(range(200), 3))) for k in range(40)] + [(40, None), (41, ""), (42, "abab" * 300), (42, base[0]), (43, base[0] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string") if n < 400 else docs
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted((d, len(r), sum(g), brute.runs(g), sha(bytes(b for b, x in zip(r, g) if not x))) for (d, _), (r, g) in zip(rows, brute.removed([t for _, t in rows], n)))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(df, n).collect())
    assert got == want


def test_suffix_dedup_odd(odd_docs, no_docs):
    got = suffix_dedup.without_repeats(odd_docs)
    assert got.columns == odd_docs.columns
    assert got.count() == odd_docs.count()
    assert {r["doc_id"]: r["text"] for r in got.collect() if r["doc_id"] is not None}[4] == ""
    assert suffix_dedup.without_repeats(no_docs).count() == 0


def test_cover_differences():
    for v, cover in suffix_dedup.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


# 2


def test_piece_codec(docs, odd_docs, no_docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    for df in (docs, odd_docs):
        want = []
        for d, t in by_id(df):
            ids = sp.encode(t or "", add_bos=True, add_eos=True)
            want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(sp.decode(ids).encode())))
        got = [tuple(r) for r in piece_codec.round_trip(df).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert piece_codec.round_trip(no_docs).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"abcdeths .,-é▁\n\t漢", "  ", "the", "ing", "\U0001f600"]), max_size=60).map("".join))
def test_piece_codec_any_text(text):
    import sentencepiece

    model = piece_codec.default_model()
    sp = test_piece_codec_any_text.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=model))
    ids = sp.encode(text, add_bos=True, add_eos=True)
    got = np.frombuffer(piece_codec.codec(model).encode(text), "<u4")
    assert got.tolist() == ids
    assert piece_codec.codec(model).decode(got).decode() == sp.decode(ids)


# 3 and 6, against SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_license_scan_odd(spark, odd_docs, no_docs):
    got = license_scan.scan(odd_docs).collect()
    assert [(r["doc_id"], r["license_id"], r["containment"]) for r in got] == [(10, "mit", 1.0)]
    assert license_scan.scan(no_docs).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(odd_docs, spark.createDataFrame([("short", "too few words")], "license_id string, text string"))


def test_line_templates(spark, odd_docs, no_docs):
    rows = [(k, f"own words of number{k} and nothing else at all {'x' * k}\nUser {k} logged in from host{k} today at noon\nlast {'y' * k} line") for k in range(12)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == rows[0][1]  # the first document keeps what recurs
    assert all("logged in" not in got[k] and "last" in got[k] for k in range(1, 12))
    same = line_templates.drop_recurring(odd_docs)
    assert same.columns == odd_docs.columns
    assert sorted(map(str, same.collect())) == sorted(map(str, odd_docs.collect()))
    assert line_templates.drop_recurring(no_docs).count() == 0


# 4 and 9


def tokenized(df, end):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokens.default_vocabulary())
    return [(d, tok.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in by_id(df)]


def test_packing(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        for sequence in (2048, 7) if df is odd_docs else (2048,):
            rows = packing.pack(df, sequence, with_ids=True).collect()
            stream = {}
            for r in rows:
                assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["offset"] + r["length"] <= sequence
                stream[r["sequence_id"] * sequence + r["offset"]] = r
            whole, at, docs_found = b"", 0, []
            for place in sorted(stream):
                r = stream[place]
                assert place == at  # gapless
                at += r["length"]
                if r["start"] == 0:
                    docs_found.append([r["doc_id"], r["doc_tokens"], b""])
                assert docs_found[-1][0] == r["doc_id"] and len(docs_found[-1][2]) == 4 * r["start"]
                docs_found[-1][2] += bytes(r["ids"])
            want = [(d, len(i), np.array(i, "<u4").tobytes()) for d, i in tokenized(df, 1)]
            assert sorted(map(str, map(tuple, docs_found))) == sorted(map(str, want))
    assert packing.pack(no_docs).count() == 0


def test_token_files(spark, docs, odd_docs, no_docs, tmp_path):
    for k, df in enumerate((docs, odd_docs)):
        token_files.write_token_files(df, f"file://{tmp_path}/{k}", shards=3)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, f"file://{tmp_path}/{k}").collect())
        want, at = [], 0
        for d, ids in tokenized(df, 0):
            want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
        assert got == want
    token_files.write_token_files(no_docs, f"file://{tmp_path}/none")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300))
def test_elias_fano(values):
    values = sorted(values)
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.of(values).to_bytes())
    assert code.select_all().tolist() == values
    assert all(values[k] == v for v in values[:5] for k in code.places_of(v)) and all(len(code.places_of(v)) == values.count(v) for v in values[:5])
    assert [code.select(k) for k in range(len(values))] == values


# 5


@pytest.mark.parametrize("transforms,cache", [([], 0), ([("subtract_green",)], 0), ([], 6), ([("subtract_green",)], 11)])
def test_webp_images(transforms, cache):
    rng = np.random.default_rng(5)
    for shape in ((1, 1), (3, 5), (40, 64)):
        image = (rng.integers(0, 4, shape).astype(np.uint32) * np.uint32(0x112233)) | np.uint32(0xFF000000)
        assert (webp_media.decode(webp_media.encode(image, transforms, cache_bits=cache)) == image).all()


def test_webp_column(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in webp_media.media_column(odd_docs, with_media=True).collect()}
    for d, t in by_id(odd_docs):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[d]
        if d is not None:
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), sha(payload), zlib.crc32(payload[-64:]))
            assert r["media"][:4] == b"RIFF" and sha(r["media"]) == r["media_sha256"]
            assert webp_media.load_payload(bytes(r["media"])).tobytes() == payload
    assert webp_media.media_column(no_docs).count() == 0


# 7


def test_topk(spark):
    rnd = random.Random(7)
    rows = [(k, [rnd.gauss(0, 1) for _ in range(24)]) for k in range(300)] + [(300, None), (400, [None] * 24), (500, [float("nan")] * 24), (301, [0.5] * 24), (302, [0.5] * 24), (600, [0.5] * 24)]
    got = sorted(tuple(r) for r in topk_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, k=5).collect())
    vec = {k: np.floor(np.array(v, np.float32).astype(float) * 1024) for k, v in rows if v and all(x is not None and x == x for x in v)}
    want = []
    for q in vec:
        if q % 100 == 0:
            best = sorted((-int(vec[q] @ vec[x]), x) for x in vec if x != q)[:5]
            want += [(q, n + 1, x, -s) for n, (s, x) in enumerate(best)]
    assert got == sorted(want)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk_search.top_k(empty, F.col("vec_id") % 100 == 0).count() == 0


# 8


def test_quality(spark, odd_docs, no_docs):
    docs, labels = (common.table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    held = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0)
    scored = quality_bayes.score(docs, labels.join(held, "doc_id", "left_anti"))
    right = scored.join(held, "doc_id").select(((F.col("p_good") >= 0.5) == (F.col("quality") == 1)).cast("int").alias("right")).agg(F.avg("right"), F.count("*")).first()
    assert right[0] >= 0.95 and right[1] > 50
    none = quality_bayes.score(odd_docs, labels.limit(0)).collect()
    assert len(none) == odd_docs.count() and len({round(r["p_document"], 9) for r in none}) == 1
    assert quality_bayes.keep_good(odd_docs, labels).columns == odd_docs.columns
    assert quality_bayes.keep_good(no_docs, labels).count() == 0


# 10


def test_simhash(spark, docs, odd_docs):
    for df in (docs, odd_docs):
        rows = by_id(df)
        fps = [brute.simhash(t, 4) for _, t in rows]
        got = simhash_pivots.near_duplicates(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fp"), "component_id").collect()
        roots = brute.components(fps, 4)
        least = {}
        for (d, _), r in zip(rows, roots):
            least[r] = d if least.get(r) is None else min(least[r], d if d is not None else least[r])
        want = [(d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, roots)]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_links_of_close_fingerprints(spark):
    rnd = random.Random(10)
    fps = []
    for _ in range(60):
        f = rnd.getrandbits(64)
        fps.append(f)
        for n in (1, 3, 4, 5, 6):
            fps.append(f ^ sum(1 << b for b in rnd.sample(range(64), n)))
    fps = list(dict.fromkeys(fps + [fps[0] ^ k for k in range(200)]))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    links = simhash_pivots.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), group=64)
    found = simhash_pivots.components(links, "a", "b")
    got = {r["node"]: r["component"] for r in found.collect()}
    roots = brute.components(fps, 4)
    for i, f in enumerate(fps):
        same = [signed(fps[j]) for j in range(len(fps)) if roots[j] == roots[i]]
        assert got.get(signed(f), signed(f)) == min(same)


def test_keep_first(odd_docs, no_docs):
    got = simhash_pivots.keep_first(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"] is not None)[0] == 0
    assert {4, 6} <= {r["doc_id"] for r in got.collect()} and not {1, 2, 5, 7} & {r["doc_id"] for r in got.collect()}
    assert simhash_pivots.keep_first(no_docs).count() == 0
