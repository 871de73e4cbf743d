import random

import numpy as np
import pytest

from umbra.functions.staging import written
from umbra.llm.common import components, words_of
from umbra.llm.ngram_join import BLOCK_DOCS, band_keys, candidates, choose_bands, links_between, ngram_join, shingles, signatures

SCHEMA = "doc_id long, text string"


def gram_set(text, n=5):
    words = words_of(text)
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def brute(rows, similarity=0.8):
    sets = {i: gram_set(t) for i, t in rows}
    ids = sorted(sets)
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if shared + 1e-9 >= similarity * (len(sets[a]) + len(sets[b]) - shared):
                    near[a].add(b)
                    near[b].add(a)
    label = {}
    for i in ids:
        if i not in label:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            label |= {j: min(seen) for j in seen}
    return {i: (min([j for j in ids if sets[j] == sets[i] and sets[i]] or [i]), label[i], len(near[i])) for i in ids}


def got(spark, rows, **kw):
    return {r["doc_id"]: (r["copy_of"], r["class_id"], r["n_links"]) for r in ngram_join(spark.createDataFrame(rows, SCHEMA), **kw).collect()}


def corpus(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows + [(i, None), (i + 1, ""), (i + 2, "..."), (i + 3, "only four words here"), (i + 4, "Only FOUR, words here!"), (i + 5, "x " * 30_000)]


def test_against_brute_force(spark):
    rows = corpus()
    assert got(spark, rows) == brute(rows)


def test_one_large_group_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("umbra.llm.ngram_join.BLOCK_DOCS", 8)
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(100)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(100)] = f"z{i}"
        rows.append((i, " ".join(copy)))
    rows += [(100 + i, rows[0][1]) for i in range(40)]
    assert got(spark, rows) == brute(rows)
    assert BLOCK_DOCS > 8


def test_a_long_chain_needs_few_tasks(spark, monkeypatch):
    """Texts that meet their neighbours only are sent to a few blocks, though their bands join all of them."""
    monkeypatch.setattr("umbra.llm.ngram_join.BLOCK_DOCS", 4)
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(300)]
    assert got(spark, rows) == brute(rows)
    bands, each = choose_bands()
    classes = signatures(spark.createDataFrame(rows, SCHEMA), 5, bands, each).selectExpr("node", "doc_id AS rep", "1L AS copies", "bytes", "bands")
    members, tasks = candidates(classes)
    assert members.count() == 300 and tasks.count() < 300 * 12


def test_chain_with_a_dissimilar_leader(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 120])) for i in range(9)]
    assert got(spark, rows) == brute(rows)


def test_null_and_repeated_ids_extra_columns_empty_table(spark):
    text = "one two three four five six seven"
    other = "quite another text stands under this very number here"
    frame = spark.createDataFrame([(None, text, 1), (5, text, 2), (5, text, 3), (7, text + " eight", 4), (3, other, 5), (7, other, 6)], "doc_id long, text string, node int")
    rows = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in ngram_join(frame).collect())
    assert rows == [(0, 0, 0), (3, 3, 1), (5, 5, 1), (5, 5, 1), (7, 3, 1), (7, 7, 0)]
    assert ngram_join(frame.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.99999)
    assert (1 - 0.8**rows) ** bands <= 1e-5 and bands <= 40
    rng = np.random.default_rng(0)
    met = 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 100).astype(np.uint64)
        b = np.concatenate([a[:89], rng.integers(0, 2**63, 11).astype(np.uint64)])  # similarity 89 / 111
        keys = band_keys([np.unique(a), np.unique(b)], bands, rows)
        met += bool((keys[0] == keys[1]).any())
    assert met == 200


@pytest.mark.parametrize("sides", [False, True])
def test_links_between_counts_exactly(sides):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)]
    side = np.arange(30) % 2 if sides else np.zeros(30, dtype=int)
    linked = links_between(sets, side, 0.5)
    for i in range(30):
        for j in range(30):
            shared = len(np.intersect1d(sets[i], sets[j]))
            want = shared >= 0.5 * (len(sets[i]) + len(sets[j]) - shared) and i != j and (not sides or side[i] != side[j])
            assert linked[i, j] == want


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4), (2, 1)] + [(100 + i, 101 + i) for i in range(60)] + [(500, i) for i in range(300, 400)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: 1 for n in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20} | {100 + i: 100 for i in range(61)} | {i: 300 for i in [*range(300, 400), 500]}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_path_takes_steps_in_proportion_to_its_logarithm(spark, monkeypatch):
    steps = []
    monkeypatch.setattr("umbra.llm.common.written", lambda df: steps.append(1) or written(df))
    path = spark.range(1, 1000).selectExpr("id AS a", "id + 1 AS b")
    got = components(path)
    assert got.count() == 1000 and got.where("label != 1").count() == 0
    assert len(steps) <= 15


def test_shingles_of_short_and_long_texts():
    assert len(shingles("a b c d e f")) == 2 and len(shingles("a b")) == 1 and len(shingles("")) == 0
    assert len(shingles("a b c d e " * 5000)) == 5
