import os
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from umbra.functions import text as T
from umbra.operators import findings as fi
from umbra.operators import redact, resolve, review
from umbra.functions import reading
from umbra.operators.detect import Detector, Found, PATTERN_RULES, Scanner, detect_rules
from umbra.operators.forms import KIND_OF, _labels_of, form_spans, may_have_label
from umbra.operators.names import Lexicon, name_detector
from umbra.plans import fixtures as fx
from umbra.plans import registry
from umbra.schemas import CATEGORIES, SPANS
from umbra.sources import files
from umbra.streaming import inbox


def pages_of(spark, *texts):
    return spark.createDataFrame([("d", i, t) for i, t in enumerate(texts, 1)], "doc_id string, page int, text string")


def test_look_alikes_find_nothing(spark):
    for group, rules in fx.GROUPS.items():
        texts = [t for c, g, t in fx.TEXTS if g == group and c.startswith("no")]
        found = detect_rules(pages_of(spark, *texts), only=set(rules)).collect() if texts else []
        assert [r["spans"] for r in found] == [[] for _ in texts], group
    assert Scanner([name_detector()])(dict(fx.NAME_TEXTS)["no name"]) == []


def test_offsets_are_code_points(spark):
    text = "😀 a@b.co then é 10.0.0.7 x@y.org"
    spans = detect_rules(pages_of(spark, text), only={"email", "ipv4"}).first()["spans"]
    assert [(s["start"], s["text"], text[s["start"] : s["start"] + s["length"]]) for s in spans] == [(2, "a@b.co", "a@b.co"), (25, "x@y.org", "x@y.org"), (16, "10.0.0.7", "10.0.0.7")]


def test_no_match_crosses_a_page_and_null_text(spark):
    rows = detect_rules(pages_of(spark, "call 212-555-", "0147", None, ""), only={"phone"}).collect()
    assert all(r["spans"] == [] for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_resolution_is_greedy_and_maximal(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.randrange(60), rng.randrange(0, 12), "Name", rng.choice([0.6, 0.7, 0.9]), "r", n, "") for n in range(40)]
    frame = spark.createDataFrame([(spans,)], f"spans {SPANS}")
    kept = [tuple(s) for s in frame.select(resolve.resolve(F.col("spans")).alias("k")).first()["k"]]
    want = []
    for s in sorted((s for s in spans if s[1] > 0), key=lambda s: (-s[3], -s[1], s[0], s[5])):
        if all(s[0] >= k[0] + k[1] or k[0] >= s[0] + s[1] for k in want):
            want.append(s)
    assert kept == sorted(want)


def test_report_end_to_end(spark):
    text = "\n".join([
        "Victim: Marta Okafor", "DOB 04/17/1988", "SSN 219-55-0143", "Phone (212) 555-0147", "Email marta@example.org",
        "Incident date 5/6/2021", "Address: 12 Elm Street", "Okafor said she left.", "The weather was mild.",
    ])
    pages = pages_of(spark, text)
    found = fi.detect(pages).persist()
    rows = {(r["category"], r["text"]): r for r in found.collect()}
    for key in [("Name", "Marta Okafor"), ("DateOfBirth", "04/17/1988"), ("SocialSecurityNumber", "219-55-0143"), ("PhoneNumber", "(212) 555-0147"), ("EmailAddress", "marta@example.org"), ("Address", "12 Elm Street")]:
        assert rows[key]["accepted"], key
    assert not rows["Date", "5/6/2021"]["accepted"]
    assert any(k[0] == "Name" and k[1].startswith("Okafor") for k in rows)
    words = fi.add_words(pages).select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*")
    left = redact.text_layer(redact.surviving_words(words, found)).first()["text"]
    for gone in ("Marta", "219-55-0143", "555-0147", "marta@example.org", "Elm"):
        assert gone not in left
    for stays in ("5/6/2021", "weather", "mild."):
        assert stays in left
    groups = review.value_groups(found)
    assert groups.agg(F.sum("n_findings")).first()[0] == len(rows) if len(rows) == found.count() else True
    found.unpersist()


def test_options(spark):
    pages = pages_of(spark, "Victim: Marta Okafor\ncall (212) 555-0147", "Okafor 2125550199")
    assert {r["category"] for r in fi.detect(pages, fi.Options(disabled=["Name"])).collect()} == {"PhoneNumber"}
    seeded = fi.detect(pages, fi.Options(disabled=["PhoneNumber"])).where("page = 2").collect()
    assert [r["text"] for r in seeded] == ["Okafor"]
    assert fi.detect(pages, fi.Options(propagate=False)).where("page = 2").count() == 0
    assert all(len(r["text"]) == 64 for r in fi.detect(pages, fi.Options(keep_text=False)).collect())
    assert [r["text"] for r in fi.find_term(pages, "okafor").orderBy("page").collect()] == ["Okafor", "Okafor"]


def test_scalar_functions(spark):
    assert reading.digit_run("12 345 STATE TX") == (0, 6) and reading.digit_run("none here") == (0, 0) and reading.digit_run("A 7B 9 x 1") == (2, 6)
    assert reading.trim(": #x-1,; ", 0, 9) == (3, 6)
    assert reading.luhn("79927398713") and not reading.luhn("79927398710") and not reading.luhn("") and not reading.luhn("\u0664" * 11)
    assert reading.lowered("İA") == "İa"
    assert spark.range(1).select(T.label_key(F.lit("S. S. No"))).first()[0] == "SSNO"


def test_form_geometry():
    words = [{"idx": i, "text": t, "text_start": s, "line": n, "rect": {"x": x, "y": y, "w": w, "h": h}} for _, _, i, t, s, n, x, y, w, h in fx.FORM]
    assert sorted(form_spans(words, 612.0)) == [(18, 28, "date"), (29, 40, "ssn")]
    assert form_spans([], 612.0) == []


def test_readers_and_rejects(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo".encode())
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>para</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.exe").write_bytes(b"x")
    rows = {r["doc_id"].rsplit("/", 1)[-1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.txt"]["text"] == "one\ntwo" and rows["b.docx"]["text"] == "para\nx    y"
    assert rows["c.docx"]["text"] is None and rows["c.docx"]["warning"].startswith("unreadable") and rows["d.exe"]["warning"]


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert files.load_settings(path) == files.DEFAULTS
    files.save_settings(path, files.DEFAULTS | {"terms": ["x"], "dpi": 150})
    assert files.load_settings(path)["terms"] == ["x"]
    (tmp_path / "s.json").write_text("{")
    assert files.load_settings(path) == files.DEFAULTS
    assert review.add_terms(["Abc"], " aBC ") == ["Abc"]


def test_watched_folder(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (source / "b.pdf").write_bytes(b"nope")
    (source / "c.txt").write_bytes(b"%PDF")

    def run():
        q = inbox.run(inbox.watch(spark, str(source)), lambda f: f.select("path", "length"), str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check"))
        q.awaitTermination()
        return sorted(r["path"].rsplit("/", 1)[-1] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a.pdf"]
    (source / "d.pdf").write_bytes(b"%PDF-1.7 y")
    assert run() == ["a.pdf", "d.pdf"]
    assert [r["path"].rsplit("/", 1)[-1] for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == ["b.pdf"]


def test_review_state(spark):
    rows = [("d", 1, 0, 3, "Ann", "Name", [(0.0, 0.0, 1.0, 1.0)], False, True), ("d", 1, 9, 4, " ANN", "Address", [(5.0, 0.0, 1.0, 1.0)], False, False), ("d", 2, 0, 3, "ann", "Name", [(0.0, 0.0, 1.0, 1.0)], False, True)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, start int, length int, text string, category string, rects array<struct<x:double,y:double,w:double,h:double>>, is_manual boolean, accepted boolean")
    group = review.value_groups(frame).first()
    assert (group["n_findings"], group["n_accepted"], group["category"], group["pages"], group["state"], group["text"]) == (3, 2, "Name", [1, 2], "some", "Ann")
    assert review.summary(review.set_accepted(frame, None)).first()["selected"] == 1
    assert review.remove(frame, frame.where("page = 2")).count() == 2
    areas = spark.createDataFrame([("d", 1, (4.0, 0.0, 9.0, 9.0))], "doc_id string, page int, rect struct<x:double,y:double,w:double,h:double>")
    assert [r["start"] for r in review.select_by_drag(frame, areas).collect()] == [9]
    assert [r["page"] for r in review.ordered(frame).collect()] == [1, 1, 2]


def test_whole_roll_ups_against_brute_force(spark, tmp_path):
    texts = [
        "Victim: Marta Okafor\nDOB 04/17/1988\nSSN 219-55-0143\nPhone (212) 555-0147\nEmail Marta@example.org\nmarta@example.org again, from 10.0.0.7\nOkafor said she left.",
        "Incident date 5/6/2021\nSee https://example.org/x\nPhone 212-555-0148, then 212-555-0148", "The weather was mild.", None,
    ]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: registry.QUERIES[name](spark, str(tmp_path)).collect()
    found = fi.detect(registry.document_pages(spark, str(tmp_path))).collect()
    n, ok = Counter(r["category"] for r in found), Counter(r["category"] for r in found if r["accepted"])
    assert {"Name", "DateOfBirth", "Date", "SocialSecurityNumber", "PhoneNumber", "EmailAddress", "IpAddress", "WebAddress"} <= set(n) and n["PhoneNumber"] == 3
    rolled = run("all_category_rollup")
    assert {r["category"]: (r["n_findings"], r["n_accepted"]) for r in rolled} == {c: (n[c], ok[c]) for c, _, _ in CATEGORIES}
    assert all(r["state"] == ("none" if not r["n_accepted"] else "all" if r["n_accepted"] == r["n_findings"] else "some") for r in rolled)
    assert [tuple(r) for r in run("all_summary_counts")] == [(len(found), sum(ok.values()))]
    assert {(r["category"], r["accepted"]): r["n"] for r in run("all_accept_rule")} == Counter((r["category"], r["accepted"]) for r in found)
    groups = Counter((r["doc_id"], " ".join(r["text"].split()).lower()) for r in found)
    assert {(r["doc_id"], r["key"]): r["n_findings"] for r in run("all_value_groups")} == groups and max(groups.values()) == 2
    assert {r["category"] for r in entry.entry(spark).collect() if r["n_findings"]} > {"EmailAddress", "IpAddress"}


def test_labels_spelt_with_other_signs(spark):
    pages = pages_of(spark, "D.O.B.\n04 17 1988", "d . o . b\n04 17 1988", "(1)D-O-B:\n04 17 1988")
    for given in (pages, fi.add_words(pages)):
        found = fi.detect(given).where("category = 'DateOfBirth'").select("page", "rule").collect()
        assert sorted(tuple(r) for r in found) == [(1, "form date"), (2, "form date"), (3, "form date")]


def test_gate_passes_all_that_the_form_detector_accepts(spark):
    rng = random.Random(5)
    spelt = []
    for label in KIND_OF:
        for signs in ([""], ["", "."], ["", "", "", " ", "/", "7"], ["", "", "-", "\u00a0"]):
            for case in (str.lower, str.upper, str.title):
                spelt.append("7) " + "".join(c + rng.choice(signs) for c in case(label)) + ": x")
    spelt += ["ßN", "phoneme", "adobe", "The weather was mild."]
    accepted = [bool(_labels_of(fi.words_of_text(t))) for t in spelt]
    gate = [r[1] for r in sorted(spark.createDataFrame(list(enumerate(spelt)), "n int, text string").select("n", may_have_label(F.col("text"))).collect())]
    assert sum(accepted) > 300 and all(g for a, g in zip(accepted, gate, strict=True) if a)
    assert accepted[-4] and gate[-4:] == [True, False, False, False]


def test_own_detectors(spark):
    def ticket(page):
        at = page.low.find("ticket ")
        return [Found(at + 7, reading.run_of(page.text, at + 7), 0.9)] if at >= 0 else []

    mine = Detector("ticket", "CustomTerm", ticket)
    pages = pages_of(spark, "Ticket AB12 from marta@example.org", None, "")
    found = fi.detect(pages, fi.Options(detectors=[mine], propagate=False)).collect()
    assert [(r["category"], r["text"], r["rule"]) for r in found] == [("CustomTerm", "AB12", "ticket")]
    both = fi.detect(pages, fi.Options(detectors=(*fi.BUILT_IN, mine), propagate=False)).collect()
    assert sorted(r["text"] for r in both) == ["AB12", "marta@example.org"]


def test_many_matches_in_one_text():
    text = "call (212) 555-0147 or a@b.co on 10.0.0.7; " * 5000
    spans = [dict(zip(("start", "length", "category", "confidence", "rule", "seq", "text"), s, strict=True)) for s in Scanner(fi.BUILT_IN)(text)]
    kept = resolve.keep_best(spans)
    assert len(kept) == 15000 and all(text[s["start"] : s["start"] + s["length"]] == s["text"] for s in kept)
    assert len(fi.placed(kept, fi.words_of_text(text))) == 15000


def test_shapes_of_values():
    scanner = Scanner(PATTERN_RULES)
    for text, rule, value in (
        ("call +1 (212) 555-0147 now", "phone", "+1 (212) 555-0147"),
        ("1-212-555-0147", "phone", "1-212-555-0147"),
        ("on 3 Mar. 2020, then", "date d month yyyy", "3 Mar. 2020"),
        ("100 W. Oak Ave., Suite 200, Troy, MI 48083-1234 etc", "street", "100 W. Oak Ave., Suite 200, Troy, MI 48083-1234"),
        ("44 Pine Hollow\nStreet", "street", "44 Pine Hollow\nStreet"),
        ("12 North Street", "street", "12 North Street"),
        ("plate 2027 ABC", "plate", "2027 ABC"),
        ("LP: OH ABC-1234", "plate", "ABC-1234"),
        ("acct no: AB12345678", "account", "AB12345678"),
        ("DOC ID: A123456", "justice id", "A123456"),
        ("St. Louis, MO 63101", "city line", "St. Louis, MO 63101"),
        ("Badge ID No. 4471", "badge", "4471"),
        ("P O Box 12, Dayton, OH 45402", "po box", "P O Box 12, Dayton, OH 45402"),
    ):
        assert (rule, value) in {(s[4], s[6]) for s in scanner(text)}, text
    for text in ("+12125550147 no", "15th of May", "VIN: 1HGBH41JXMN109186_", "paid 4111 1111 1111 1112", "meet at 10:30 Main Street"):
        assert not scanner(text), (text, scanner(text))


def test_staging_folders(spark, tmp_path):
    from umbra.functions import staging

    one = staging.written(spark.range(5))
    path = staging._PATHS[one]
    assert one.count() == 5 and path.startswith(staging.shared_folder(spark))
    staging.forget(one)
    assert not any(os.path.exists(p) for p in (path, path.removeprefix("file:")))
    assert staging.spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_words_under_boxes_by_brute_force(spark):
    rng = random.Random(11)
    rect = lambda most: (rng.uniform(-20, 600), rng.uniform(-20, 780), rng.uniform(0, most), rng.uniform(0, 30))
    words = [("d", rng.randrange(2), i, "w", rect(200)) for i in range(300)] + [("d", 0, 300, "none", None), ("d", 0, 301, "negative", (5.0, 5.0, -1.0, 5.0))]
    boxes = [("d", rng.randrange(2), [rect(300), rect(5)], rng.random() < 0.7) for _ in range(40)]
    kind = "struct<x:double,y:double,w:double,h:double>"
    left = redact.surviving_words(
        spark.createDataFrame(words, f"doc_id string, page int, idx int, text string, rect {kind}"),
        spark.createDataFrame(boxes, f"doc_id string, page int, rects array<{kind}>, accepted boolean"),
    )
    padded = [(p, x - 1.5, y - 1.5, w + 3, h + 3) for _, p, rects, ok in boxes if ok for x, y, w, h in rects]
    touched = lambda page, r: any(p == page and r[0] < x + w and x < r[0] + r[2] and r[1] < y + h and y < r[1] + r[3] for p, x, y, w, h in padded)
    want = [i for _, page, i, _, r in words if r is None or r[2] < 0 or not touched(page, r)]
    assert sorted(r["idx"] for r in left.collect()) == want and 50 < len(want) < 280


def test_order_of_groups(spark):
    rows = [("Name", 1, "b"), ("Name", 3, "z"), ("Name", 1, "A"), ("Address", 1, "q"), ("WebAddress", 9, "w")]
    shown = {c: name for c, name, _ in CATEGORIES}
    got = review.ordered_groups(spark.createDataFrame(rows, "category string, n_findings long, text string")).collect()
    assert [(r["category"], r["n_findings"], r["text"]) for r in got] == sorted(rows, key=lambda r: (shown[r[0]], -r[1], r[2].lower()))


def test_written_pages(spark, tmp_path):
    pages = pages_of(spark, "one a@b.co two", "three", "four")
    assert [r["page"] for r in redact.page_range(pages, 0, 2).collect()] == [1, 2] and redact.page_range(pages, 3, 99).count() == 1
    words = fi.add_words(pages).select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*")
    redact.write_redacted(words, fi.detect(pages), str(tmp_path / "out"))
    assert {r["page"]: r["text"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: "one two", 2: "three", 3: "four"}
    row = spark.createDataFrame([("  a \t b  \n c",)], "text string").select(files.normalised_layout(F.col("text")).alias("t")).first()
    assert row["t"] == "a b\nc"


def test_plain_text_layer_is_the_layer_of_surviving_words(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é😀 \t\r\n") for _ in range(rng.randrange(80))) for _ in range(60)] + ["", None]
    spans = [
        [(rng.randrange(len(t)), rng.randrange(12), rng.choice(["Name", "Date"]), rng.choice([0.5, 0.7, 0.9]), "r", n, "") for n in range(rng.randrange(9))] if t else [] for t in texts
    ]
    pages = spark.createDataFrame([(f"d{i // 2}", i % 2, t, s) for i, (t, s) in enumerate(zip(texts, spans, strict=True))], f"doc_id string, page int, text string, spans {SPANS}")
    words = fi.add_words(pages).select("doc_id", "page", F.explode("words").alias("w")).select("doc_id", "page", "w.*")
    want = redact.text_layer(redact.surviving_words(words, fi.to_findings(pages))).collect()
    got = redact.plain_text_layer(pages).collect()
    assert sorted(got) == sorted(want) and 40 < len(got)
    assert sum(len(r["text"].split(" ")) for r in got) < words.count() - 50
