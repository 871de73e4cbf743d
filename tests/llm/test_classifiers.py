import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.llm import quality, toxicity
from umbra.llm.common import is_held_out, words_of
from umbra.llm.labelled import KnownWords, document_frequencies, isotonic

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    return spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")


def held_out(rows, labels, label):
    y = {r["doc_id"]: r[label] for r in labels.where(is_held_out(F.col("doc_id"))).collect()}
    pairs = [(r["score"], r["predicted"], y[r["doc_id"]]) for r in rows if r["doc_id"] in y]
    return np.array(pairs)


@pytest.fixture(scope="module")
def toxic_model(labelled):
    return toxicity.fit(*labelled)


def test_toxicity_on_held_out_labels(labelled, toxic_model):
    docs, labels = labelled
    wanted = labels.where(is_held_out(F.col("doc_id"))).select("doc_id")
    rows = toxicity.score_toxicity(docs.join(wanted, "doc_id"), toxic_model).collect()
    found = held_out(rows, labels, "toxic")
    assert (found[:, 1] == found[:, 2]).mean() >= 0.98
    assert found[found[:, 2] == 1, 1].mean() >= 0.88 and found[found[:, 2] == 0, 1].mean() <= 0.01
    assert all(len(r["evidence"]["cosines"]) == len(r["evidence"]["labels"]) == len(r["evidence"]["examples"]) == 5 for r in rows)


def test_toxicity_scores_against_brute_force(labelled, toxic_model):
    """Every cosine with every example, term by term in dictionaries; weights, votes and calibration worked out again."""
    docs, labels = labelled
    m = toxic_model
    assert m.empty < 0.05 and len(m.terms) > 20_000
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()] + [None, "", "idiot", "zzzz qqqq"]
    n, every = docs.count(), {}
    for r in docs.select("text").collect():
        for w in set(re.findall(r"\w+", (r["text"] or "").lower())):
            every[w] = every.get(w, 0) + 1
    rows = [[] for _ in m.y]
    for i in range(len(m.y)):
        ids, weights = m.index.vectors.row(i)
        rows[i] = {m.terms[t]: w for t, w in zip(ids, weights, strict=True)}
    known = {t: i for i, t in enumerate(m.terms)}
    for text, got in zip(texts, m.score(texts), strict=True):
        vector = {}
        for w, c in Counter(re.findall(r"\w+", (text or "").lower())).items():
            if w in known:
                vector[w] = (1 + math.log(c)) * (math.log((1 + n) / (1 + every[w])) + 1) * m.tie[known[w]]
        norm = math.sqrt(sum(x * x for x in vector.values())) or 1
        cosines = [sum(x / norm * row.get(w, 0.0) for w, x in vector.items()) for row in rows]
        near = sorted((-round(c, 12), i) for i, c in enumerate(cosines) if c > 0)[:25]
        assert got[1] == pytest.approx([-c for c, _ in near[:5]], abs=1e-9)
        assert got[2] == [int(m.y[i]) for _, i in near[:5]]
        votes = [(c / (0.05 + 1 - c) * m.w[int(m.y[i])], m.y[i]) for c, i in ((min(-c, 1.0), i) for c, i in near)]
        want = m.none if not votes else float(np.interp(sum(v * y for v, y in votes) / sum(v for v, _ in votes), *m.steps))
        assert got[0] == pytest.approx(want, abs=1e-6)


def test_quality_on_held_out_labels(labelled):
    docs, labels = labelled
    wanted = labels.where(is_held_out(F.col("doc_id"))).select("doc_id")
    rows = [r for r in quality.score_quality(docs.join(wanted, "doc_id"), quality.fit(docs, labels)).select("doc.doc_id", "score", "predicted").collect()]
    found = held_out(rows, labels, "quality")
    assert (found[:, 1] == found[:, 2]).mean() >= 0.96


@pytest.mark.parametrize("long_lists", [0, 6, 100])
def test_block_max_search_is_exact(long_lists):
    rng = random.Random(3)
    rows = []
    for _ in range(700):
        raw = {t: rng.random() for t in rng.sample(range(40), rng.randrange(0, 8))}
        norm = sum(x * x for x in raw.values()) ** 0.5
        rows.append({t: x / norm for t, x in sorted(raw.items())})
    packed = [(np.array(list(v), dtype=np.int64), np.array(list(v.values()))) for v in rows]
    index = toxicity.BlockMaxIndex(toxicity.Vectors(packed), 40, block=16, long_lists=long_lists)
    for q, (ids, cosines) in zip(rows[:120], index.nearest_many(packed[:120], 10), strict=True):
        dots = [(-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(rows)]
        want = [(i, -d) for d, i in sorted(dots)[:10] if d < 0]
        assert [round(c, 9) for c in cosines] == [round(min(c, 1.0), 9) for _, c in want]
        assert list(ids) == [i for i, _ in want]


def test_a_batch_is_searched_as_a_whole(monkeypatch):
    """As many steps for many texts as for a few, but for one part after another; texts without words or neighbours among them."""
    rng = random.Random(4)
    rows = [{t: rng.random() for t in sorted(rng.sample(range(200), rng.randrange(0, 9)))} for _ in range(600)]
    packed = [(np.array(list(v), dtype=np.int64), np.array(list(v.values())) / 4) for v in rows]
    index = toxicity.BlockMaxIndex(toxicity.Vectors(packed), 201, block=8, long_lists=20)
    queries = [*packed[:150], (np.array([200]), np.ones(1)), (np.empty(0, dtype=np.int64), np.empty(0))]
    steps, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda *args: steps.append(1) or ranges(*args))
    found = index.nearest_many(queries, 10)
    assert len(steps) <= 20
    for (ids, weights), (near, cosines) in zip(queries, found, strict=True):
        full = np.zeros(201)
        full[ids] = weights
        dots = np.array([full[i] @ w for i, w in packed])
        want = sorted(np.flatnonzero(dots > 0).tolist(), key=lambda i: (-round(dots[i], 12), i))[:10]
        assert near.tolist() == want and np.allclose(cosines, np.minimum(dots[want], 1), atol=1e-12)
    assert index.nearest_many([], 10) == [] and [len(x) for x, _ in index.nearest_many(queries[-2:], 10)] == [0, 0]


def test_counts_of_known_words(spark):
    """Terms of a text by number, and the documents that hold each, against counters."""
    words = ["b", "a", "d", "é"]
    known = KnownWords(words, words_of, toxicity.parts_of)
    texts = ["a b A x", "É é é", "x y", "", None, "d"]
    for text in texts:
        want = Counter(re.findall(r"\w+", (text or "").lower()))
        assert known.counts(text) == {i: want[w] for i, w in enumerate(words) if w in want}
    n, df = document_frequencies(spark.createDataFrame([(t,) for t in texts], "text string"), known)
    assert n == 6 and df.tolist() == [1, 1, 1, 1]


def test_quality_scores_against_brute_force(labelled):
    """Weights, projection, cosines, votes and calibration of some texts, worked out one by one."""
    docs, labels = labelled
    m = quality.fit(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(30).collect()] + [None, "", "x" * 5000]
    ids = m.known.ids
    for text, got in zip(texts, m.score(texts), strict=True):
        point = np.zeros(m.directions.shape[1])
        bag = {t: n for t, n in quality.terms_of(text).items() if t in ids}
        weights = {t: (1 + math.log(n)) * m.idf[ids[t]] for t, n in bag.items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1
        for t, w in weights.items():
            point += w / norm * m.directions[ids[t]]
        point /= np.linalg.norm(point) or 1
        cosines = [float(point @ p) for p in m.points]
        last = sorted(cosines, reverse=True)[24]
        votes = [(max(c, 1e-3) ** 8 * m.weight[i], m.y[i]) for i, c in enumerate(cosines) if c >= last - 1e-6]
        want = float(np.interp(sum(v * y for v, y in votes) / sum(v for v, _ in votes), *m.steps))
        assert got == pytest.approx(want, abs=2e-3)


def test_tokens_are_not_cut():
    one, two = "a" * 64 + "b", "a" * 64 + "c"
    assert quality.parts_of(one)[0] != quality.parts_of(two)[0]
    assert quality.shape_of("a1" * 40) != quality.shape_of("a1" * 400) and quality.shape_of("A-" * 6 + "9") != quality.shape_of("A-" * 6 + "x")
    assert quality.terms_of("x" * 100) != quality.terms_of("x" * 100_000)


def test_isotonic_steps_rise():
    rng = np.random.default_rng(0)
    raw = rng.random(500)
    y = (rng.random(500) < raw).astype(float)
    xs, ps = isotonic(raw, y, np.ones(500))
    assert (np.diff(xs) > 0).all() and (np.diff(ps) >= 0).all() and 0 < ps[0] <= ps[-1] < 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_no_labels_and_ties(spark, module):
    schema = "doc_id long, text string, score string, _text int"
    docs = spark.createDataFrame([(None, None, "s", 1), (1, "", "s", 1), (1, "", "s", 1), (2, "a scum b " * 20000, "s", 1), (3, "x", None, None)], schema)
    for labels in (spark.createDataFrame([], LABELS), spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (3, 0, 5)], LABELS)):
        model = module.fit(docs, labels)
        rows = (toxicity.score_toxicity if module is toxicity else quality.score_quality)(docs, model).collect()
        assert len(rows) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert (toxicity.score_toxicity if module is toxicity else quality.score_quality)(docs.limit(0), model).count() == 0


def test_held_out_labels_are_not_read(spark):
    ids = [r["id"] for r in spark.range(200).where(is_held_out(F.col("id"))).collect()]
    docs = spark.createDataFrame([(i, f"text number {i} scum") for i in range(200)], "doc_id long, text string")
    plain = [(i, 1, i % 2) for i in range(200)]
    flipped = [(i, q, 1 - t if i in ids else t) for i, q, t in plain]
    one, two = (toxicity.fit(docs, spark.createDataFrame(x, LABELS)) for x in (plain, flipped))
    assert one.terms == two.terms and (one.y == two.y).all() and one.prior == two.prior
