"""Several templates a leaf, and lines made of masked words."""

from tessera.llm import line_templates


def kept(spark, texts):
    rows = line_templates.drop_recurring(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r["doc_id"]: r["text"] for r in rows}


def test_several_templates_in_a_leaf(spark):
    name = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    one = "This site uses cookies to give you the best possible visit"
    two = "This site uses scripts from other places so please allow them"
    near = "This site uses scripts from other places so please permit them"
    texts = [f"{one if k % 2 else two}\nown text {'x' * k}" for k in range(80)]
    texts += [f"{near}\nmore {'z' * k}" for k in range(3)]
    texts += [f"This site uses {' '.join(name(k * 8 + j) for j in range(8))}" for k in range(200)]
    got = kept(spark, texts)
    for k in range(83):
        assert ("This site" in got[k]) == (k < 2), k
    assert all(got[k] == texts[k] for k in range(83, 283))


def test_rows_of_numbers_stay(spark):
    texts = [f"12 {k}.5 2024-01-{k:02}\nTotal {k} {k * k}\ncell{k} 1,{k} a@{k}\nown {'w' * k}" for k in range(30)]
    assert kept(spark, texts) == dict(enumerate(texts))
