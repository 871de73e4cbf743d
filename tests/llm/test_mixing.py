import hashlib
import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from umbra.llm.mixing import mix_sources, pfair_slots, query, slot_shares


@pytest.mark.parametrize("weights", [{"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 60, "b": 25, "c": 10, "d": 5}, {f"s{i}": math.sqrt(i + 1) for i in range(21)}, {"big": 1000, **{f"t{i}": 1e-6 for i in range(30)}}])
def test_schedule_stays_within_one_block(weights):
    shares = slot_shares(weights)
    period = sum(shares.values())
    assert period == 1000 and all(n >= 1 for n in shares.values())
    slots = pfair_slots(shares)
    assert sorted(s for _, _, s in slots) == list(range(period))
    done = Counter()
    for source, k, slot in sorted(slots, key=lambda x: x[2]):
        assert k == done[source]
        assert (k * period) // shares[source] <= slot < -(-(k + 1) * period // shares[source])
        done[source] += 1
        for name, n in shares.items():
            assert abs(done[name] - n * (slot + 1) / period) < 1


def test_whole_and_interleaved(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"t{i}") for i in range(9000)] + [(None, None, "x"), (1, "hot", "again")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, source string, block string"), weights={"hot": 3, "s0": 1}, block_rows=16).collect()
    assert Counter((r["doc"]["doc_id"], r["doc"]["source"], r["doc"]["block"]) for r in out) == Counter(rows)
    blocks = defaultdict(list)
    for r in out:
        blocks[r["slot"]].append(r)
    for members in blocks.values():
        assert len({(m["source_key"], m["block"]) for m in members}) == 1 and sorted(m["pos"] for m in members) == list(range(len(members)))
    by_source = defaultdict(set)
    for r in out:
        by_source[r["source_key"]].add((r["block"], r["slot"]))
    for pairs in by_source.values():
        assert [b for b, _ in sorted(pairs)] == list(range(len(pairs)))
        assert [s for _, s in sorted(pairs)] == sorted(s for _, s in pairs)


def test_query_against_plain_rules(spark, sf_dir):
    """Orders, blocks, windows and the bound, each worked out here from the rows' ids and the square roots of the counts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    counts = Counter(r["source"] for r in docs)
    weight = {s: Fraction(math.sqrt(n)) for s, n in counts.items()}
    total = sum(weight.values())
    out = query(spark, sf_dir).collect()
    assert len(out) == len(docs)
    at = {}
    for source in counts:
        mine = sorted((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["doc_id"]) for r in docs if r["source"] == source)
        at |= {i: (source, n // 64, n % 64) for n, (_, i) in enumerate(mine)}
    assert {r["doc_id"]: (r["source"], r["block"], r["pos"]) for r in out} == at
    slots = {(r["source"], r["block"]): r["slot"] for r in out}
    assert len(set(slots.values())) == len(slots)
    for (s, k), slot in slots.items():  # each block within its window: a schedule that keeps to the weights by less than one block
        w = weight[s] / total
        assert math.floor(k / w) <= slot + 1e-6 and slot < math.ceil((k + 1) / w) + 1e-6
    on = sorted((r["slot"], r["source"]) for r in out if r["on_target"] and r["pos"] == 0)
    done = Counter()
    for n, (slot, source) in enumerate(on):
        assert slot == n
        done[source] += 1
        assert all(abs(done[s] - weight[s] / total * (n + 1)) < 1 for s in counts)


def test_odd_weights(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(300)] + [(None, "a")] * 5, "doc_id long, source string")
    with pytest.raises(ValueError):
        mix_sources(rows, weights={"a": -1, "b": 1})
    with pytest.raises(ValueError):
        mix_sources(rows, weights={"a": math.nan})
    default = {tuple(r) for r in mix_sources(rows).select("doc.doc_id", "slot", "pos").collect()}
    assert {tuple(r) for r in mix_sources(rows, weights={}).select("doc.doc_id", "slot", "pos").collect()} == default
    equal = mix_sources(rows, weights={"a": 0, "b": 0}, block_rows=10).collect()
    assert len(equal) == 305 and sorted({r["slot"] for r in equal})[-1] < 40
    late = mix_sources(rows, weights={"a": 1, "b": 1, "c": 0}, block_rows=10).collect()
    assert len(late) == 305 and max(r["slot"] for r in late if r["source_key"] != "c") < min(r["slot"] for r in late if r["source_key"] == "c" and r["block"] > 0)


def test_less_than_a_block_off_while_all_sources_last(spark, monkeypatch):
    monkeypatch.setattr("umbra.llm.mixing.MAX_SLOTS", 3000)
    counts = {f"s{i:03}": 200 + i for i in range(40)} | {"big": 30000}
    rows = spark.createDataFrame([(f"{s}-{i}", s) for s, c in counts.items() for i in range(c)], "doc_id string, source string")
    out = mix_sources(rows, weights={s: 1 / (n + 1) for n, s in enumerate(counts)}, block_rows=1)
    blocks = sorted((r["slot"], r["source_key"]) for r in out.where("on_target and pos = 0").select("slot", "source_key").collect())
    total = sum(Fraction(1, n + 1) for n in range(len(counts)))
    done = Counter()
    for n, (slot, source) in enumerate(blocks):
        assert slot == n
        done[source] += 1
        assert all(abs(done[s] - (n + 1) / (k + 1) / total) < 1 + 1e-6 for k, s in enumerate(counts))
    assert len(blocks) <= 3000 and out.select("slot", "pos").distinct().count() == sum(counts.values())


def test_empty_and_too_many(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mix_sources(empty).count() == 0
    with pytest.raises(ValueError):
        mix_sources(spark.createDataFrame([(i, f"s{i}") for i in range(5)], "doc_id long, source string"), max_sources=4)


@pytest.mark.parametrize("n", [20, 400])
def test_keeps_to_the_unrounded_weights_over_many_periods(spark, n):
    counts = {f"s{i:03}": 20000 // n for i in range(1, n)} | {"big": 10000}
    rows = spark.createDataFrame([(f"{s}-{i}", s) for s, c in counts.items() for i in range(c)], "doc_id string, source string")
    out = mix_sources(rows, block_rows=1).where("on_target").select("source_key", "block", "slot").collect()
    assert sorted(r["slot"] for r in out) == list(range(len(out))) and len(out) > 10000
    weight = {s: math.sqrt(c) / math.fsum(map(math.sqrt, counts.values())) for s, c in counts.items()}
    for s, k, t in out:
        assert abs(k - weight[s] * t) < 2 and abs(k + 1 - weight[s] * (t + 1)) < 2
