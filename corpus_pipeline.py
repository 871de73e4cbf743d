"""Quality, line dedup, near duplicates, decontamination, mixing: the stages that turn raw documents into a training mix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.staging import written
from umbra.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from umbra.llm.common import table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Defined cases: null and empty texts are judged by their size alone; without labels every score is 0.5
    and all stay; repeated rows stay or go together; an empty table stays empty.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select("doc.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines stay in the smallest doc_id only; a document that loses all its lines goes.

    Defined cases: null and empty texts have one empty line, which is never shared, and stay as they are;
    n_chars is counted anew where lines went; rows that repeat a doc_id are one holder of their lines;
    columns of any other name, also of the operator's own, pass through; an empty table stays empty.
    """
    out = line_dedup.dedup_lines(docs).where("n_dropped < n_lines")
    changed = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("doc.text"))}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast(kind)).otherwise(F.col("doc.n_chars"))
    return out.select(*[changed.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays.

    Defined cases: rows with a null doc_id, and texts without words, stay; of rows that repeat a doc_id
    each goes or stays by its own text; an empty table stays empty.
    """
    gone = ngram_join.ngram_join(docs).where("doc_id != class_id").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_text")).distinct()
    same = (docs["doc_id"] == gone["_gone"]) & (F.xxhash64(docs["text"]) == gone["_text"])
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go.

    Defined cases: null and empty texts hold none and stay; without a benchmark all stay; each row is judged
    by its own text; an empty table stays empty.
    """
    detector, _ = decontaminate.fit(docs, table(spark, sf_dir, "benchmark"))
    return decontaminate.is_leaky(docs, detector).where("not leaky").select("doc.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents with their place in the mix: order by mix_slot and mix_pos.

    Defined cases: a null source is a source of its own; repeated rows have places of their own; columns
    of the input that have the names of the places give way to them; an empty table stays empty.
    """
    own = {f"mix_{c}": F.col(c).alias(f"mix_{c}") for c in ("block", "slot", "pos", "on_target")}
    return mixing.mix_sources(docs).select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in own], *own.values())


STAGES = [
    ("quality", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: Learnt scores, latent spaces and component search can't be put as one DuckDB statement; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs)
    return docs
