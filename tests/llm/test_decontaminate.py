import random
import re

import numpy as np
import pytest

from umbra.llm import decontaminate as dc
from umbra.llm.common import words_of


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_bit_parallel_common_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        masks = {}
        for i, x in enumerate(b):
            masks[x] = masks.get(x, 0) | 1 << i
        assert dc.common_words(a, masks, len(b)) == lcs(a, b)


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 48, 59, 100])
def test_passages_cover_all_words(n):
    covered = set()
    for lo, hi in dc.passages(n):
        covered |= set(range(lo, hi))
    assert covered == set(range(n))


def find(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string, common string")
    detector, encoded = dc.fit(frame, spark.createDataFrame(items, "item_id long, text string"))
    rows = dc.find_leaks(encoded, detector).collect()
    leaky = {(r["doc"]["doc_id"], r["leaky"]) for r in dc.is_leaky(frame, detector).collect()}
    assert {i for i, yes in leaky if yes} == {r["doc_id"] for r in rows}
    return {(r["doc_id"], r["item_id"]) for r in rows}


def made(rng, n):
    return " ".join(f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(n))


def test_exact_shortened_and_reworded_passages(spark):
    rng = random.Random(7)
    items = [(i, made(rng, rng.randrange(15, 60))) for i in range(30)]
    docs, want = [], set()
    for d in range(240):
        text = made(rng, rng.randrange(20, 300)).split()
        if d % 4 == 0:
            item = rng.randrange(30)
            passage = items[item][1].split()
            if d % 8 == 0:
                passage = [w if rng.random() > 0.08 else "other" for w in passage]
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
            want.add((d, item))
        docs.append((d, " ".join(text), "c"))
    found = find(spark, docs, items)
    assert len(want - found) <= 2 and not found - want


def test_tables_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = {r["item_id"]: " ".join(words_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if f" {t} " in f" {' '.join(words_of(r['text']))} "}
    found = {(r["doc_id"], r["item_id"]) for r in dc.query(spark, sf_dir).collect()}
    assert want <= found and len(found - want) <= 1


def test_odd_rows_and_empty_tables(spark):
    docs = [(None, None, None), (1, "", "x"), (2, "one two", "x"), (3, "x y " * 20000 + "a b c d e f g h i j", "x"), (3, "x y " * 20000 + "a b c d e f g h i j", "x")]
    items = [(1, "a b c d e f g h i j"), (1, "a b c d e f g h i j"), (2, None), (None, "a b c d e f g h"), (3, "too short")]
    assert find(spark, docs, items) == {(3, 1)}
    assert find(spark, docs, items[2:3]) == set()
    assert find(spark, docs[:0], items) == set()
    assert find(spark, [(4, "this is too short, said one", "x"), (5, "too very short", "x")], items) == {(4, 3)}
    with pytest.raises(ValueError):
        dc.fit(spark.createDataFrame(docs, "doc_id long, text string, c string"), spark.createDataFrame(items, "item_id long, text string"), max_items=1)


def test_item_ids_of_another_type(spark):
    docs = spark.createDataFrame([(1, "so w1 w2 w3 w4 w5 w6 w7 w8 w9 it is")], "doc_id long, text string")
    items = spark.createDataFrame([("q-1", "w1 w2 w3 w4 w5 w6 w7 w8 w9")], "item_id string, text string")
    detector, encoded = dc.fit(docs, items)
    assert [tuple(r)[:2] for r in dc.find_leaks(encoded, detector).collect()] == [(1, "q-1")]


def test_few_passages_are_compared_word_by_word(spark, sf_dir, monkeypatch):
    """Passages that only look alike in the latent space are told apart before their words are compared, and no find is lost by that."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [r["text"] for r in docs.collect()]
    detector, _ = dc.fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    calls, compare = [], dc.Detector._compare
    monkeypatch.setattr(dc.Detector, "_compare", lambda *args: calls.append(1) or compare(*args))
    found = detector.hits_of(texts)
    assert any(found) and len(calls) <= 2 * len(texts)
    few = len(calls)
    detector.least = detector.least - 10**6  # every passage of a near enough vector is compared
    assert detector.hits_of(texts) == found and len(calls) > 10 * few


def test_sketch_against_brute_force(spark):
    """Passages of 32 words' own counts, for texts of many lengths and more passages than are added up at once."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(0, 200))) for _ in range(50)] + ["b a " * 40_000, None, "", "z"]
    model = dc.Benchmark([(1, "a b c d e f g h i j k l")])
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkey, dc.SKETCHED = dc.SKETCHED, 16
    try:
        total, df, got = dc.sketch(dc.encode(frame, model), model, 5)
    finally:
        dc.SKETCHED = monkey
    column, sign = dc.test_matrix(12, 5, 17)
    want, held = np.zeros((12, 5)), np.zeros(12)
    for text in texts:
        ids = model.ids(text)
        held[np.unique(ids[ids >= 0])] += 1
        for lo in range(0, len(ids), dc.PASSAGE):
            n = np.bincount(ids[lo : lo + dc.PASSAGE][ids[lo : lo + dc.PASSAGE] >= 0], minlength=12).astype(float)
            part = np.bincount(column, weights=n * sign, minlength=5)
            want += n[:, None] * part
    assert total == len(texts) and (df == held).all() and np.allclose(got, want)


def test_words_of_any_text():
    rng = random.Random(1)
    every = [chr(i) for i in range(256)]
    for text in [*every, "".join(every), *("".join(rng.choices(every + list("ΣİǅЖ漢’  "), k=40)) for _ in range(500)), "ΑΣ ΑΣ’", "", None]:
        assert words_of(text) == re.findall(r"\w+", (text or "").lower())
