"""Whole license texts, comment marks, changed words, and the bands' collision probability."""

import random

import duckdb
from pyspark.sql import functions as F

from tessera.llm import license_scan as L

TEXTS = dict(L.TEMPLATES)


def prose(rnd, n):
    return [f"{rnd.choice('bcdfg')}{rnd.randrange(4000)}" for _ in range(n)]


def test_forms_of_whole_texts(spark):
    rnd = random.Random(3)
    mit = TEXTS["mit-text"].split()
    comment = lambda text, mark: "\n".join(f"{mark} {' '.join(text.split()[k : k + 9])}" for k in range(0, len(text.split()), 9))
    rows = [
        (0, "x = 1\n" + comment(TEXTS["apache-2.0-header"], "#")),
        (1, comment(TEXTS["gpl-3.0-header"], " *").upper() + " " + " ".join(prose(rnd, 900))),
        (2, " ".join(prose(rnd, 333)) + "\n" + comment(TEXTS["mit-text"], "//")),
        (3, "Released under the MIT License, see LICENSE"),
        (4, "licensed under the apache license version 2 0"),
        (5, " ".join(mit[: len(mit) // 2])),
        (6, " ".join(prose(rnd, 2000))),
        (7, None),
    ]
    got = {(r["doc_id"], r["license_id"]) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(0, "apache-2.0-header"), (0, "apache-2.0"), (1, "gpl-3.0-header"), (2, "mit-text"), (3, "mit"), (4, "apache-2.0")}


def test_band_settings():
    s = L.least_similarity()
    assert (1 - s**L.ROWS) ** L.bands_for() <= L.MISS < (1 - s**L.ROWS) ** (L.bands_for() - 1)


def test_collision_probability_of_sections(spark):
    """A section of which 0.8 is left, at any place of a text, shares a band with its template as often as the settings say."""
    rnd, rows = random.Random(4), []
    for k in range(400):
        section = prose(rnd, L.SECTION + L.SHINGLE - 1)
        copy = list(section)
        at = rnd.randrange(len(copy) - 14)
        copy[at : at + 10] = prose(rnd, 10)  # 14 shingles of 73 go
        before = rnd.randrange(120)
        rows.append((k, " ".join(section), " ".join(prose(rnd, before) + copy + prose(rnd, 120))))
    bands = L.bands_for()
    hashes = lambda c: L._shingles(L._words(c))
    df = spark.createDataFrame(rows, "k int, section string, text string")
    met = df.select(F.arrays_overlap(L.section_bands(hashes("section"), bands), L.window_bands(hashes("text"), bands)).alias("met"))
    assert met.where("met").count() >= 398
    other = df.select("section").withColumn("n", F.monotonically_increasing_id())
    apart = df.limit(20).crossJoin(other.limit(20).select(F.col("section").alias("s"), "n")).where("section <> s")
    assert apart.where(F.arrays_overlap(L.section_bands(hashes("s"), bands), L.window_bands(hashes("text"), bands))).count() <= 2


def test_changed_copies_against_sql(spark, tmp_path):
    rnd, rows = random.Random(5), []
    for k in range(120):
        words = TEXTS[rnd.choice(sorted(TEXTS))].split()
        share = rnd.choice([0, 0.01, 0.02, 0.04])
        rows.append((k // 2 if k < 20 else k, " ".join(prose(rnd, rnd.randrange(200)) + [w if rnd.random() > share else "changed" for w in words] + prose(rnd, rnd.randrange(200)))))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in con.sql("SELECT doc_id, license_id, n_shingles, n_found FROM (" + L.ORACLES["op3_license_scan"] + ")").fetchall()}
    got = {tuple(r)[:4] for r in L.op3_license_scan(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 60
