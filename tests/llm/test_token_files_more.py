"""Ids far apart, null and repeated ids, and single documents by select."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from tessera.llm import token_files, tokens


def test_wanted_documents(spark, tmp_path):
    rows = [(None, "no id"), (None, None), (-(2**62) - 7, "far below"), (3, "three"), (3, "three again"), (4, ""), (2**62 + 9, "far above")] + [(k, "word " * (k % 50)) for k in range(100, 1100)]
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, shards=2)
    tok = Tokenizer.from_file(tokens.default_vocabulary())
    code = lambda t: np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
    wanted = [-(2**62) - 7, 3, 4, 777, 2**62 + 9, 5]
    got = sorted((r["doc_id"], bytes(r["ids"])) for r in token_files.fetch_documents(spark, path, wanted).collect())
    assert got == sorted((d, code(t)) for d, t in rows if d in wanted)
    every = token_files.read_token_files(spark, path).collect()
    assert sorted(map(str, ((r["doc_id"], r["ids_crc32"]) for r in every))) == sorted(map(str, ((d, zlib.crc32(code(t))) for d, t in rows)))
    assert "array" not in str(spark.read.parquet(path).schema).lower()
