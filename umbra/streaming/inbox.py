"""A watched folder: new files become findings once each, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BINARY = "path string, modificationTime timestamp, length long, content binary"


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 4) == F.unhex(F.lit("25504446"))


def watch(spark: SparkSession, folder: str, glob: str = "*.pdf", archive: str | None = None, per_batch: int = 16) -> DataFrame:
    """Files in a folder, those there at the start included. Writers must move finished files in by renaming them.

    With ``archive`` Spark moves files there once their batch is done.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(folder)


def received_name(path: Column, time: Column) -> Column:
    """A unique name for a file that was taken in."""
    base, ext = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.regexp_extract(path, r"(\.[^./]*)$", 1)
    return F.concat(base, F.lit("-"), F.date_format(time, "yyyyMMdd-HHmmss"), F.lit("-"), F.substring(F.md5(path.cast("binary")), 1, 8), ext)


def run(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, rejects: str, checkpoint: str, accept: Column | None = None) -> StreamingQuery:
    """Hand each micro-batch's good files to ``handle`` and write its rows; files that fail the check go to a table of rejects.

    Batches follow one another. Output is kept by batch number, so a batch that is repeated after a failure replaces its own rows.
    """
    good = (F.col("length") > 0) & F.coalesce(is_pdf(F.col("content")) if accept is None else accept, F.lit(False))

    def batch(files: DataFrame, number: int) -> None:
        handle(files.where(good)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        files.where(~good).select("path", "modificationTime", "length").write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
