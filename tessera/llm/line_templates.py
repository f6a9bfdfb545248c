"""Operator 6: line dedup with a log-template tree, in DataFrame operations.

A line becomes words, with words that hold a digit or an ``@`` masked.  Its leaf in the
tree of fixed depth is its number of words and its first ``depth`` masked words.  A leaf
has a main template: at every place the word that more than half of the leaf's distinct
texts have there, else a variable field; a masked place is a field too.  A line belongs to
it if the two agree at 0.8 or more of its places, a field agreeing with anything; the
template must be known at as many places and have words at more than half of them, so
rows of numbers have none.  Of the lines left, each masked line of that many words that
``least`` or more distinct texts have is a template of its own, however small its share of
the leaf, and the others belong to the one they share most places with, 0.8 at least
(masked words as they are).  Lines that vary in unmasked words, of which none recurs
as a whole, are found by the main template only.

A template that lines of ``least`` or more distinct texts belong to recurs: its lines are
dropped from every document but the first (the smallest ``doc_id``), so what is copied as
a whole stays in the corpus once.  Equal texts count as one text, so exact copies alone
make no template.

Texts are cut into lines once, in Arrow batches, and the lines written with their leaf.
Only the lines of leaves with enough distinct texts are looked into word by word; the
tables of wide leaves, templates and assignments are small as a rule and joined by
``common.join_small``, so no text travels with a leaf as its key.  All counts are
aggregations with map-side combine, so a line that a third of all documents have is no
hot spot.  Leaves and masked lines are compared as they are; texts are told apart by
``doc_id`` and a 64-bit hash, so only rows that repeat a ``doc_id`` can be mistaken for
each other, with a chance of 2**-64.

Defined results: null texts stay null and empty ones empty; a text that loses no line
is unchanged to the byte; a document whose lines are all dropped stays with an empty
text; rows that repeat both ``doc_id`` and text are treated alike; other columns are
kept as they are; an empty table gives no rows.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

DEPTH, LEAST, SIMILAR, MAJORITY = 3, 10, 0.8, 0.5
#: A word with a digit or an ``@``, from its first byte on.
MASK = r"(?<![^ \t\n\r])[^ \t\n\r0-9@]*+[0-9@][^ \t\n\r]*+"
#: What a masked word becomes.
FIELD = "<*>"


def lines_of(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, text_key, place, leaf and bytes of every line that has words."""
    common.ship(docs.sparkSession)
    names = ["doc_id", "text_key", "place", "leaf", "line"]

    def run(batches):
        masked, blank = re.compile(rb"[0-9@]").search, re.compile(rb"[^ \t\r]+").findall
        field, gap = FIELD.encode(), b" "
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for some in tokens.chunks(texts):
                rows, places, leaves, lines = [], [], [], []
                for k, text in enumerate(texts[some], some.start):
                    raw = text.encode()
                    # bytes.split knows two more kinds of white space
                    split = blank if b"\x0b" in raw or b"\x0c" in raw else bytes.split
                    for place, line in enumerate(raw.split(b"\n")):
                        words = split(line)
                        if words:
                            head = gap.join(words[:depth])
                            if masked(head):
                                head = gap.join([field if masked(w) else w for w in words[:depth]])
                            rows.append(k)
                            places.append(place)
                            leaves.append(b"%d %b" % (len(words), head))
                            lines.append(line)
                rows = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(places, pa.int32()), pa.array(leaves, pa.binary()), pa.array(lines, pa.binary())], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, place int, leaf binary, line binary")


def _masked_words(line):
    masked = F.regexp_replace(line.cast("string"), MASK, FIELD)
    return F.filter(F.split(masked, r"[ \t\r]+"), lambda w: w != "")


def _real(words):
    """Whether more than half of the places hold words that are not masked."""
    return F.size(F.filter(words, lambda w: w != FIELD)) > MAJORITY * F.size(words)


def _blocks(depth: int, similar: float):
    """Keys of the blocks of a line's places behind ``depth``: similar lines of a leaf have one in common."""
    rest = F.size("words") - depth
    n = F.floor(F.size("words") * (1 - similar) + 1e-9).cast("int") + 1
    edge = lambda k: F.floor(rest * k / n).cast("int")
    return F.when(rest <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.xxhash64(k, F.slice("words", edge(k) + depth + 1, edge(k + 1) - edge(k)))))


def _main_templates(lines: DataFrame, similar: float) -> DataFrame:
    """(leaf, constant): the words of each leaf that more than half of its texts have at their place, where they make a template."""
    words = lines.select("leaf", "size", "texts", "text_key", F.posexplode("words").alias("at", "word")).distinct()
    counts = words.groupBy("leaf", "size", "texts", "at", "word").agg(F.count("*").alias("n")).where(F.col("n") > MAJORITY * F.col("texts"))
    # two words may both pass where texts have several lines in the leaf: the more frequent one counts
    best = counts.groupBy("leaf", "size", "at").agg(F.max(F.struct("n", "word")).alias("best"))
    known = best.groupBy("leaf", "size").agg(F.map_from_entries(F.collect_list(F.struct("at", "best.word"))).alias("constant"))
    real = F.size(F.filter(F.map_values("constant"), lambda w: w != FIELD))
    known = known.where((F.size("constant") >= similar * F.col("size")) & (real > MAJORITY * F.col("size")))
    return known.select("leaf", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda at: F.element_at("constant", at)).alias("constant"))


def _other_templates(rest: DataFrame, depth: int, least: int, similar: float) -> DataFrame:
    """``rest`` with the recurring masked line of its leaf that each of them is, or is most similar to, as ``template``."""
    rest = rest.where(_real("words")).withColumn("masked", F.array_join("words", " "))
    counts = rest.groupBy("leaf", "masked", "text_key").agg(F.lit(1).alias("one")).groupBy("leaf", "masked").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    counts = common.materialize(counts, "recurring-lines")
    with_one = common.join_small(rest, counts.select("leaf").distinct(), ["leaf"], ["text_key", "place"], "left_semi")
    some = common.materialize(with_one.groupBy("leaf", "masked").agg(F.first("words").alias("words")), "rest-lines")
    some = some.join(counts, ["leaf", "masked"], "left").withColumn("block", F.explode(_blocks(depth, similar)))
    templates = some.where("n IS NOT NULL").select("leaf", F.col("masked").alias("template"), F.col("words").alias("constant"), "n", "block")
    others = some.where("n IS NULL").select("leaf", "masked", "words", "block")
    same = F.size(F.filter(F.zip_with("words", "constant", lambda x, y: x == y), lambda x: x))
    near = others.join(templates, ["leaf", "block"]).withColumn("same", same).where(F.col("same") >= similar * F.size("words"))
    near = near.groupBy("leaf", "masked").agg(F.max(F.struct("same", "n", "template")).alias("best")).select("leaf", "masked", "best.template")
    given = common.materialize(counts.select("leaf", "masked", F.col("masked").alias("template")).unionAll(near), "line-templates")
    return common.join_small(rest, given, ["leaf", "masked"], ["text_key", "place"])


def recurring_lines(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, text_key, place) of every line to drop."""
    lines = common.materialize(lines_of(docs, depth), "lines")
    wide = lines.groupBy("leaf", "text_key").agg(F.lit(1).alias("one")).groupBy("leaf").agg(F.count("*").alias("texts")).where(F.col("texts") >= least)
    # from here on only leaves that many texts share, by number
    wide = common.materialize(wide.select(F.col("leaf").alias("key"), F.monotonically_increasing_id().alias("leaf"), "texts"), "wide-leaves")
    lines = common.join_small(lines.withColumnRenamed("leaf", "key"), wide, ["key"], ["text_key", "place"])
    lines = common.materialize(lines.select("leaf", "texts", "doc_id", "text_key", "place", _masked_words(F.col("line")).alias("words")), "leaf-lines").withColumn("size", F.size("words"))
    main = common.materialize(_main_templates(lines, similar), "main-templates")
    fields = F.size(F.filter(F.zip_with("words", "constant", lambda w, c: (c != FIELD) & (w != c)), lambda x: x))
    marked = common.join_small(lines, main, ["leaf"], ["text_key", "place"], "left").withColumn("belongs", F.coalesce(F.col("size") - fields >= similar * F.col("size"), F.lit(False)))
    columns = ["leaf", "template", "doc_id", "text_key", "place"]
    whole = marked.where("belongs").withColumn("template", F.lit("")).select(*columns)  # no masked line is empty
    other = _other_templates(marked.where("NOT belongs").drop("constant", "belongs"), depth, least, similar).select(*columns)
    member = common.materialize(whole.unionAll(other), "template-lines")
    recurs = member.groupBy("leaf", "template", "text_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    recurs = recurs.groupBy("leaf", "template").agg(F.count("*").alias("n"), F.min("first").alias("first")).where(F.col("n") >= least)
    recurs = common.materialize(recurs.select("leaf", "template", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_text")), "recurring-templates")
    found = common.join_small(member, recurs, ["leaf", "template"], ["text_key", "place"])
    return found.where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_text")))).select("doc_id", "text_key", "place")


def drop_recurring(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, similar: float = SIMILAR, with_counts: bool = False) -> DataFrame:
    """``docs`` without the lines of recurring templates (and n_lines, n_dropped)."""
    row, text, gone, marks = common.fresh(docs, "gone_row", "gone_text", "gone_places", "gone_marks")
    found = recurring_lines(docs, depth, least, similar).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("place")).alias(gone))
    # a byte for each line up to the last dropped one, so that a line is tested in constant time
    byte = lambda g, j: F.concat(F.repeat(F.lit("00"), (g - F.coalesce(F.get(gone, j - 1), F.lit(-1)) - 1).cast("int")), F.lit("01"))
    found = found.withColumn(marks, F.unhex(F.array_join(F.transform(gone, byte), "")))
    found = found.withColumnsRenamed({"doc_id": row, "text_key": text})
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col(row)) & (F.xxhash64("text") == F.col(text)), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda _, i: F.substring(F.col(marks), i + 1, F.lit(1)) != F.unhex(F.lit("01"))), "\n")
    more = [F.size(lines).alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).alias("n_dropped")] if with_counts else []
    return rows.select(*(F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(c) for c in docs.columns), *more)


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_recurring(docs, with_counts=True)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"), F.when(F.col("n_dropped") < 0, 0).otherwise(F.col("n_dropped")).alias("n_dropped"), F.md5(F.col("text")).alias("kept_md5"))


QUERIES = {"op6_line_templates": op6_line_templates}
ORACLES = {
    "op6_line_templates": f"""
WITH rawline AS (
  SELECT doc_id, text, unnest(string_split(regexp_replace(text, '[^ \\t\\n\\r]*[0-9@][^ \\t\\n\\r]*', '<*>', 'g'), chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, text, place, words, len(words) AS n, words[1:{DEPTH}] AS head
  FROM (SELECT *, list_filter(string_split_regex(line, '[ \\t\\r]+'), lambda x: x <> '') AS words FROM rawline)
  WHERE len(words) > 0
), wideleaf AS (SELECT n, head, count(DISTINCT text) AS texts FROM lines GROUP BY n, head HAVING count(DISTINCT text) >= {LEAST}),
inleaf AS (SELECT lines.*, texts FROM lines JOIN wideleaf USING (n, head)),
words AS (SELECT DISTINCT n, head, texts, text, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM inleaf),
counts AS (SELECT n, head, texts, pos, word, count(*) AS c FROM words GROUP BY ALL HAVING count(*) > {MAJORITY} * texts),
fixedword AS (SELECT n, head, pos, word FROM counts QUALIFY row_number() OVER (PARTITION BY n, head, pos ORDER BY c DESC, word DESC) = 1),
sizes AS (
  SELECT n, head FROM fixedword GROUP BY ALL
  HAVING count(*) >= {SIMILAR} * n AND count(*) FILTER (word <> '{FIELD}') > {MAJORITY} * n
), miss AS (
  SELECT s.doc_id, s.text, s.place, s.n, s.head, count(*) FILTER (c.word <> '{FIELD}' AND s.words[c.pos] <> c.word) AS misses
  FROM inleaf s JOIN sizes USING (n, head) JOIN fixedword c ON c.n = s.n AND c.head = s.head GROUP BY ALL
), main AS (SELECT n, head, '' AS template, doc_id, text, place FROM miss WHERE n - misses >= {SIMILAR} * n),
rest AS (
  SELECT n, head, array_to_string(words, ' ') AS masked, words, doc_id, text, place
  FROM inleaf ANTI JOIN main USING (n, head, doc_id, text, place)
  WHERE len(list_filter(words, lambda x: x <> '{FIELD}')) > {MAJORITY} * n
), recurring AS (SELECT n, head, masked AS template, any_value(words) AS constant, count(DISTINCT text) AS c FROM rest GROUP BY n, head, masked HAVING count(DISTINCT text) >= {LEAST}),
others AS (SELECT DISTINCT n, head, masked, words FROM rest WHERE (n, head, masked) NOT IN (SELECT (n, head, template) FROM recurring)),
near AS (
  SELECT o.n, o.head, o.masked, r.template, r.c, len(list_filter(list_zip(o.words, r.constant), lambda p: p[1] = p[2])) AS same
  FROM others o JOIN recurring r ON o.n = r.n AND o.head = r.head
), given AS (
  SELECT n, head, template AS masked, template FROM recurring
  UNION ALL
  SELECT n, head, masked, template FROM near WHERE same >= {SIMILAR} * n
  QUALIFY row_number() OVER (PARTITION BY n, head, masked ORDER BY same DESC, c DESC, template DESC) = 1
), members AS (
  SELECT * FROM main UNION ALL SELECT n, head, template, doc_id, text, place FROM rest JOIN given USING (n, head, masked)
), recurs AS (SELECT n, head, template, min(doc_id) AS firstdoc FROM members GROUP BY ALL HAVING count(DISTINCT text) >= {LEAST}),
gone AS (SELECT DISTINCT doc_id, place FROM members JOIN recurs USING (n, head, template) WHERE doc_id <> firstdoc),
allline AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.place) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (g.place IS NULL), '') AS text
  FROM allline e LEFT JOIN gone g USING (doc_id, place) GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_dropped, 0) AS INTEGER) AS n_dropped, md5(kept.text) AS kept_md5
FROM documents d LEFT JOIN kept USING (doc_id)
"""
}
