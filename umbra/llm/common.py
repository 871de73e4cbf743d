"""What the operators of this package share."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.shipping import python_ready as python_ready
from umbra.functions.staging import forget, spread, written

WORD = re.compile(r"\w+")
#: Latin-1 characters by what ``words_of`` makes of each: lower case, or a blank where it is no part of a word.
_LATIN = bytes(ord(c) if WORD.match(c := chr(i).lower()) else 32 for i in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) pairs: node and label, the smallest node of its component.

    Every round hooks each node to its smallest neighbour, follows these hooks to their ends by doubling
    (so that a path of n nodes takes log n steps, whatever the order of its ids), contracts the pairs and
    forgets doubles. Steps are written to the shared folder. Null ends and loops are ignored.
    """
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b").distinct()
    pairs, labels = written(pairs), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = _ends(written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("label"))))
        if labels is None:
            labels = up
        else:
            step, old = up.select(F.col("node").alias("label"), F.col("label").alias("next")), labels
            labels = written(labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
            forget(old)
        left = up.select(F.col("node").alias("a"), F.col("label").alias("pa"))
        right = up.select(F.col("node").alias("b"), F.col("label").alias("pb"))
        done = pairs
        pairs = written(
            pairs.join(left, "a").join(right, "b").where("pa != pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct()
        )
        forget(done)
        if up is not labels:
            forget(up)
        if pairs.isEmpty():
            return labels.select("node", "label")


def _ends(up: DataFrame) -> DataFrame:
    """Each node's label once every chain of labels is followed to its end; a label is never larger than its node."""
    while True:
        step = up.select(F.col("node").alias("label"), F.col("label").alias("next"))
        further = written(up.join(step, "label").select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
        forget(up)
        up = further
        if further.where("moved").isEmpty():
            return up


def is_held_out(doc_id: Column) -> Column:
    """The fifth of the ids whose labels must not be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_of(text: str | None) -> list[str]:
    """Lower-case words of a text; Latin-1 texts go through a table: there no character's lower case depends on its neighbours."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORD.findall(text.lower())


def local_table(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    """A small driver-side table as a plain SQL relation."""
    names = [c.split()[0] for c in ddl.split(",")]
    packed = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    fields = ",".join(":".join(c.split()) for c in ddl.split(","))
    return spark.range(1).select(F.inline(F.from_json(F.lit(packed), f"array<struct<{fields}>>")))
