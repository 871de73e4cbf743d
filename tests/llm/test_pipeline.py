"""Each stage against what it should do to its own input."""

import os
import shutil

import pytest

import corpus_pipeline
from umbra.llm import decontaminate, quality
from umbra.llm.common import words_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The rows before and after each stage on a small table."""
    frames = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, frames[-1], sf_dir)
        rows = out.collect()
        frames.append(spark.createDataFrame(rows, out.schema))
    return [{r["doc_id"]: r.asDict() for r in f.collect()} for f in frames], frames


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    for frame in stages[1][:-1]:
        assert frame.columns == COLUMNS


def test_quality_stage(spark, sf_dir, stages):
    rows, frames = stages
    model = quality.fit(frames[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = [r["text"] for r in rows[0].values()]
    keep = {i for i, s in zip(rows[0], model.score(texts), strict=True) if s >= 0.3}
    assert set(rows[1]) == keep and all(rows[1][i] == rows[0][i] for i in keep)


def test_line_stage(stages):
    from tests.llm.test_line_dedup import brute

    rows = stages[0]
    want = {i: t for i, n, d, t in brute([(i, r["text"]) for i, r in rows[1].items()]) if d < n}
    assert {i: r["text"] for i, r in rows[2].items()} == want
    assert all(r["n_chars"] == len(r["text"]) for i, r in rows[2].items() if r["text"] != rows[1][i]["text"])


def test_near_duplicate_stage(stages):
    from tests.llm.test_ngram_join import brute

    rows = stages[0]
    classes = brute([(i, r["text"]) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, (_, c, _) in classes.items() if c == i}


def test_decontamination_stage(spark, sf_dir, stages):
    rows, frames = stages
    items = [" ".join(words_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    verbatim = {i for i, r in rows[3].items() if any(f" {t} " in f" {' '.join(words_of(r['text']))} " for t in items)}
    gone = set(rows[3]) - set(rows[4])
    assert verbatim <= gone and len(gone - verbatim) <= 1
    assert decontaminate.VERBATIM <= 1


def test_mixing_stage_keeps_all(stages):
    rows = stages[0]
    assert set(rows[5]) == set(rows[4]) and all({c: r[c] for c in COLUMNS} == rows[4][i] for i, r in rows[5].items())
    assert len({(r["mix_slot"], r["mix_pos"]) for r in rows[5].values()}) == len(rows[5])


def test_run_is_the_stages(spark, sf_dir, stages):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in out.collect()} == set(stages[0][5])


ODD = "doc_id long, text string, lang string, source string, n_chars long, slot int, line int, mix_slot int, block string, node int"


def test_stages_with_odd_rows(spark, sf_dir):
    """Null, empty, very long and repeated rows, clashing names, and an empty table go through every stage."""
    words = " ".join(f"w{i % 97} v{i % 89}" for i in range(30_000))
    plain = "A sentence that holds some words of its own, and a few more of them.\nAnother line stands here."
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, plain, "en", "s", len(plain)), (2, plain, "en", "s", len(plain)), (2, "something else, with the same number", "en", "t", 36), (3, words, "en", None, len(words)), (4, plain, "en", "s", len(plain))]
    docs = spark.createDataFrame([(*r, 1, 2, 3, "b", 4) for r in rows], ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        last = name == "mixing"
        assert [c for c in out.columns if c in docs.columns or not last] == [c for c in docs.columns if c != "mix_slot" or not last] + (["mix_slot"] if last else [])
        kept = out.collect()
        assert len(kept) <= len(rows) and all(r["slot"] == 1 for r in kept)
        if name == "line_dedup":
            assert {r["doc_id"] for r in kept} == {None, 1, 2, 3}
        if name == "near_duplicates":
            assert sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in kept) == [(0, ""), (1, ""), (2, "A sen"), (2, "A sen"), (2, "somet"), (3, "w0 v0")]
        if name in ("decontamination", "mixing"):
            assert len(kept) == len(rows)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_rest_works_without_this_package(tmp_path):
    """The entry file imports and lists the other queries when this package and the pipeline are gone."""
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(home, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); print('ok')"], cwd=tmp_path / "r", capture_output=True, text=True, check=False)
    assert said.stdout.strip().endswith("ok"), said.stderr
