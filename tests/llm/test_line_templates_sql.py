"""The query against its SQL where leaves hold several templates, masked words and null texts."""

import random

import duckdb

from tessera.llm import common, line_templates


def test_query_against_sql(spark, tmp_path):
    rnd = random.Random(6)
    words = [f"w{chr(97 + k)}" for k in range(12)]
    fixed = [f"This site uses {' '.join(rnd.choices(words, k=9))}" for _ in range(4)]
    rows = []
    for k in range(260):
        lines = [rnd.choice(fixed), f"User {k} came in from host{k % 7} today", f"{k} {k * 3} 4 5"]
        lines.append(f"This site uses {' '.join(rnd.choices(words, k=9))}")
        near = fixed[k % 4].split()
        near[3 + k % 9] = "changed"
        lines.append(" ".join(near))
        rnd.shuffle(lines)
        rows.append((k, "\n".join(lines[: rnd.randint(0, 5)]) if k % 20 else None, "en"))
    spark.createDataFrame(rows, "doc_id long, text string, __gone string").write.parquet(str(tmp_path / "documents.parquet"))
    got = line_templates.op6_line_templates(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(line_templates.ORACLES["op6_line_templates"])
    order = [want.columns.index(c) for c in got.columns]
    want = sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == want
    assert sum("None" in r for r in want) == 13


def test_clashing_names_and_other_whitespace(spark):
    rows = [(k, f"see\x0bthe vertical tab line here\nown {'z' * k}", "a", "b", "c") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, gone_row string, __lines string, text_key string")
    got = {r["doc_id"]: r for r in line_templates.drop_recurring(docs).collect()}
    assert got[0]["text"] == rows[0][1] and got[5]["text"] == f"own {'z' * 5}"
    assert got[5]["gone_row"] == "a" and list(got[5].asDict()) == docs.columns


def test_join_small_beyond_its_bound(spark):
    big = spark.createDataFrame([(k % 3, k) for k in range(100)], "key int, n int")
    small = spark.createDataFrame([(0, "x"), (1, "y")], "key int, what string")
    some, all_ = (sorted(map(tuple, common.join_small(big, small, ["key"], ["n"], how, most=0).collect())) for how in ("inner", "left"))
    assert some == sorted((k % 3, k, "xy"[k % 3]) for k in range(100) if k % 3 < 2) and len(all_) == 100
