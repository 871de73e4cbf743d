"""Makes this package importable in Python workers that don't share the driver's folders, and bounds what they are handed."""

from __future__ import annotations

import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: weakref.WeakSet = weakref.WeakSet()

#: Rows and bytes that one Arrow batch carries to Python: they bound a worker's memory when texts are long.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors once for each Spark context; Spark's own file server carries it."""
    context = spark.sparkContext
    if context in _DONE:
        return
    home = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp()) / "umbra.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(home.rglob("*.py")):
            out.write(path, f"{home.name}/{path.relative_to(home)}")
    context.addPyFile(str(target))
    _DONE.add(context)


def python_ready(spark: SparkSession) -> None:
    """Ready a session for Python operators: ship this package and bound the Arrow batches; smaller settings stay.

    The bounds are settings of the session: Spark has none for a single operator.
    """
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
