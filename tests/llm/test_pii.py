import hashlib
import random
import re

import pytest

from umbra.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), order, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(found)]


def noisy(n, seed=1):
    rng = random.Random(seed)
    parts = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "255", "256", "4111111111111111", "a", "b.c", "x_y", "%", "😀", "é", "\n", "com", "0004", "+49 (0) 123", "a@b.c_d@e.fg", "1.2.3.4.5.6.7.8", "4242 4242 4242 4242", ",", "[at]", " at ", " dot "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("texts", [noisy(400), [None, "", " ", "1 " * 6000, "9" * 20000, "a" * 20000, "a" * 5000 + "@", "+" + "1(" * 5000, "1.2.3.4 " * 500]])
def test_base_spans_equal_plain_scan(spark, texts):
    rows = pii.find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in r["base"]] == brute(r["doc"]["text"]), r["doc"]["text"][:200]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert set(brute(r["doc"]["text"])) <= set(spans)


def test_query_equals_plain_scan_on_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = pii.query(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for k, _, _ in want) for kind in PLAIN]


def test_trees_add_written_out_values_and_leave_plain_text(spark):
    texts = [
        "you can reach me at anna.b [at] host [dot] example [dot] org please",
        "call (212) 555-0147 after six",
        "server 10[.]0[.]0[.]7 is down",
        "On 2021-03-04 order 1234-5678 went out, see page 12 and lines 100 200 300.",
        "The the and of to in, at home. dot after dot.",
        "version 2021.11.3 and ratio 3.1415926535",
    ]
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc.doc_id").collect()
    kinds = [[s["kind"] for s in r["spans"]] for r in rows]
    assert kinds[:3] == [["email"], ["phone"], ["ip"]]
    assert kinds[3:] == [[], [], []]


def test_held_out_sentences(spark):
    from umbra.llm.common import local_table

    made = pii.generated(400, 99)
    rows = pii.find_pii(local_table(spark, [(i, t) for i, (t, *_) in enumerate(made)], "doc_id long, text string")).collect()
    right = wrong = 0
    for r in rows:
        _, start, end, kind = made[r["doc"]["doc_id"]]
        base = {(s["start"], s["end"]) for s in r["base"]}
        hit = [kind >= 0 and s["kind"] == pii.KINDS[kind] and s["start"] < end and start < s["end"] for s in r["spans"]]
        right += any(hit)
        wrong += sum(not h and (s["start"], s["end"]) not in base for h, s in zip(hit, r["spans"], strict=True))
    planted = sum(k >= 0 for *_, k in made)
    assert right >= 0.8 * planted
    assert wrong <= 0.05 * (right + wrong)


def test_additions_on_the_tables(spark, sf_dir):
    """Every key after "token =" is found, a card and a phone number that others run into too, and nothing that isn't one of these."""
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text")
    want = [(r["doc_id"], m.start(1), m.end(1)) for r in docs.collect() for m in re.finditer(r'(?i)token = "([0-9a-f]+)"', r["text"] or "")]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    added = set()
    for r in pii.find_pii(docs).select("doc.doc_id", "base", "spans").collect():
        base = {(s["start"], s["end"]) for s in r["base"]}
        added |= {(r["doc_id"], s["start"], s["end"], s["kind"]) for s in r["spans"] if (s["start"], s["end"]) not in base}
    assert len(want) > 100 and {(*w, "secret") for w in want} <= added
    for doc, lo, hi, kind in added - {(*w, "secret") for w in want}:
        value = texts[doc][lo:hi]
        assert kind == "phone" and value.startswith("+1 (") or kind == "card" and luhn(value), (kind, value)
    assert {"card", "phone"} <= {k for *_, k in added}


@pytest.mark.parametrize("piece", ["call (212) 555-0147 or a@b.co ", "token = abcd1234efgh5678ijkl "])
def test_walks_of_many_matches(spark, piece):
    n = 1500
    row = pii.find_pii(spark.createDataFrame([(1, piece * n)], "doc_id long, text string")).first()
    assert len(row["spans"]) == n * (2 if "@" in piece else 1)
    assert all(a["end"] <= b["start"] for a, b in zip(row["spans"], row["spans"][1:]))
    assert {piece * n}.pop()[row["spans"][-1]["start"] : row["spans"][-1]["end"]] in piece


def test_empty_clashing_and_repeated(spark):
    schema = "doc_id long, text string, base string, spans int, doc string"
    assert pii.find_pii(spark.createDataFrame([], schema)).count() == 0
    rows = pii.find_pii(spark.createDataFrame([(None, "a@b.c", "x", 1, "y")] * 2, schema)).collect()
    assert [len(r["spans"]) for r in rows] == [1, 1]


def test_redact(spark):
    found = pii.find_pii(spark.createDataFrame([(1, "Mail a@b.co and +1 (212) 555-0147."), (2, None)], "doc_id long, text string"))
    assert [r["redacted"] for r in pii.redact(found).orderBy("doc.doc_id").collect()] == ["Mail [EMAIL] and [PHONE].", None]
