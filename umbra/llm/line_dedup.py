"""Line dedup: lines that several documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.staging import written
from umbra.llm.common import table

#: Characters stripped at both ends of a line before it is compared.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LAST_ID = 2**63 - 1


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Drop lines whose key is found in ``min_docs`` documents or more, except in the smallest doc_id.

    Lines are exploded, keys are compared by two 64-bit hashes, each hash is aggregated before the
    shuffle, and only positions to drop come back to their documents, so texts move once.
    Returns ``doc`` (the whole input row as a struct, so no column can clash), ``n_lines``,
    ``n_dropped`` and ``kept_text``.

    Defined cases: a null or empty text is one empty line. A null doc_id ranks behind all others and
    such rows count as one document. Rows that repeat a doc_id are one document when documents are
    counted, and each keeps its own lines. Empty tables give empty results.
    """
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"),
        F.xxhash64("text").alias("_row"),
        F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("_lines"),
        F.struct(*[c for c in docs.columns if c != "text"]).alias("_rest"),
        F.col("text").isNull().alias("_null"),
    )
    lines = (
        rows.select("_id", "_row", F.posexplode("_lines").alias("_pos", "_line"))
        .select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(29), "_key").alias("_h2"))
    )
    first = F.min("_id").alias("_first")
    if min_docs == 2:  # two documents or more: the smallest and the largest id differ
        shared = lines.groupBy("_h1", "_h2").agg(first, F.max("_id").alias("_last")).where("_first < _last")
    else:
        shared = lines.groupBy("_h1", "_h2").agg(first, F.count_distinct("_id").alias("_n")).where(F.col("_n") >= min_docs)
    # written, so that both sides of the join come straight from a shuffle and Spark can split a common line's rows
    shared = written(shared.select("_h1", "_h2", "_first"))
    drops = (
        lines.join(shared, ["_h1", "_h2"])
        .where("_id > _first")
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    joined = rows.join(drops.hint("shuffle_hash"), ["_id", "_row"], "left")
    n_lines = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(0), n_lines - 1), "_drop")
    kept = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    whole = F.array_join("_lines", "\n")
    doc = F.struct(*[F.when(~F.col("_null"), whole).alias(c) if c == "text" else F.col("_rest").getField(c).alias(c) for c in docs.columns])
    return joined.select(
        doc.alias("doc"),
        n_lines.cast("long").alias("n_lines"),
        F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), whole).otherwise(kept).alias("kept_text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id > shared.first_id, false) AS gone FROM keyed LEFT JOIN shared USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
