import hashlib
from collections import defaultdict

from umbra.llm.line_dedup import dedup_lines, query


def brute(rows, least=10):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 2 and i > min(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, rows, **kw):
    return sorted((r["doc"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect())


ROWS = [
    (3, "A shared line here\nown\n\tA SHARED LINE HERE \x0b\nÀ shared line here"), (1, "a shared line here\nshort\nshort"), (2, None), (4, ""), (5, "short\n\n\n"),
    (6, "a shared line here"), (7, "x" * 50_000 + "\na shared line here\n" + "y\n" * 3000), (8, "É" * 10), (9, "é" * 10),
]


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS)


def test_many_holders_of_one_line(spark):
    rows = [(i, f"the very common line\nline of {i} only, no more\nthe very common line") for i in range(3000)]
    assert run(spark, rows) == brute(rows)


def test_threshold_of_three(spark):
    rows = [(i, "two of us hold it" if i < 2 else "three of us hold it") for i in range(5)]
    assert [r[2] for r in run(spark, rows, min_docs=3)] == [0, 0, 0, 1, 1]


def test_repeated_ids_null_ids_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, "a shared line here", "k"), (1, "a shared line here", "k"), (None, "a shared line here", "n")], "doc_id long, text string, n_lines string")
    rows = dedup_lines(docs).collect()
    assert sorted((r["doc"]["doc_id"] or 0, r["n_dropped"], r["doc"]["n_lines"]) for r in rows) == [(0, 1, "n"), (1, 0, "k"), (1, 0, "k")]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(docs)]
    assert sorted(tuple(r) for r in query(spark, sf_dir).collect()) == want
