"""Every registered query that has SQL gives the rows that DuckDB gives for it."""

import math
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
from umbra.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(frame):
    out = []
    for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False):
        out.append(tuple("null" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    mine, theirs = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert canonical(mine) == canonical(theirs)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 19 and sum(r["n_findings"] for r in rows) > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


ODD_TEXTS = (
    "one two three", "mail a@b.co now", "x y\x1cz\x85", "a@b.co", " \t a@b.co\x0b c@d.org,e \r\n", "", None, " \n ", " ", "a  b\f\x0bc ", "é@b.co 😀a@b.co x@y.c1",
)


def test_redacted_documents_on_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    rows = [*enumerate(ODD_TEXTS), (None, "null key a@b.co stays"), (None, None)]
    rows += [(100, "same a@b.co row"), (100, "same a@b.co row"), (101, "a@b.co"), (101, "keep"), (102, "p a@b.co"), (102, "a@b.co q r"), (103, "a@b.co"), (103, "c@d.co")]
    rows += [(1000 + i, "".join(rng.choice("aB1.@-_%+ \n\té ") for _ in range(rng.randrange(60)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    mine, theirs = registry.QUERIES["redacted_documents"](spark, str(tmp_path)), con.execute(registry.ORACLES["redacted_documents"]).df()
    want = {(None if key != key or key is None else str(key), md5, n) for key, md5, n in theirs.itertuples(index=False)}
    assert {tuple(r) for r in mine.collect()} == want and len(want) == len(theirs) > 250


def test_redacted_documents_makes_no_table_of_words(spark, sf_dir):
    """A row for each word, or a batch's words as Python objects, took more than an executor's memory at 1 GB."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = registry.QUERIES["redacted_documents"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
