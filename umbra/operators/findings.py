"""Words of a page, and findings with their geometry."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import rects as R
from umbra.functions.shipping import ship
from umbra.functions.staging import written
from umbra.operators.detect import PATTERN_RULES, Detector, detect_rules
from umbra.operators.forms import add_form_fields, may_have_label
from umbra.operators.names import Lexicon, name_detector
from umbra.operators.propagate import with_pass2
from umbra.operators.resolve import accepted, keep_best, without
from umbra.schemas import RECT

WORD_ARRAY = f"array<struct<idx:int,text:string,text_start:int,line:int,rect:{RECT}>>"
PLACED = f"array<struct<start:int,length:int,text:string,category:string,confidence:double,rule:string,rects:array<{RECT}>>>"
#: The detectors that run unless others are given: patterns, then names with our own lists.
BUILT_IN: tuple[Detector, ...] = (*PATTERN_RULES, name_detector())


@dataclass(frozen=True)
class Options:
    """What to detect and how. ``detectors`` replaces the built-in ones; ``(*BUILT_IN, mine)`` adds to them."""

    terms: list[str] = field(default_factory=list)
    threshold: float = 0.6
    propagate: bool = True
    disabled: list[str] = field(default_factory=list)
    names: bool = True
    forms: bool = True
    keep_text: bool = True
    lexicon: Lexicon = field(default_factory=Lexicon)
    detectors: Sequence[Detector] | None = None

    def in_order(self) -> tuple[Detector, ...]:
        if self.detectors is not None:
            return tuple(self.detectors)
        return (*PATTERN_RULES, name_detector(self.lexicon)) if self.names else PATTERN_RULES


def words_of_text(text: str | None) -> list[dict]:
    """Words of plain text on a plain grid: 5 points a character, 4 between words, 10 high, 12 from line to line."""
    out, line, x, end = [], 0, 0.0, 0
    for m in re.finditer(r"\S+", text or ""):
        breaks = text.count("\n", end, m.start())
        if breaks:
            line, x = line + breaks, 0.0
        width = 5.0 * len(m[0])
        out.append({"idx": len(out), "text": m[0], "text_start": m.start(), "line": line, "rect": {"x": x, "y": 12.0 * line, "w": width, "h": 10.0}})
        x, end = x + width + 4.0, m.end()
    return out


def add_words(pages: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``pages`` with ``words``, an array; pages that aren't ``wanted`` get an empty one. Arrow-batched, in one pass over the texts."""
    ship(pages.sparkSession)

    @F.pandas_udf(WORD_ARRAY)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([words_of_text(t) for t in texts])

    text = F.coalesce("text", F.lit(""))
    return pages.withColumn("words", found(text if wanted is None else F.when(wanted, text).otherwise("")))


def merge_by_line(words: Column) -> Column:
    """One rectangle for each visual line that an array of words touches, by line."""
    lines = F.array_sort(F.array_distinct(F.transform(words, lambda w: w["line"])))
    return F.transform(lines, lambda n: R.union_of(F.transform(F.filter(words, lambda w: w["line"] == n), lambda w: w["rect"])))


def _line_rects(words: list[dict]) -> list[dict]:
    """The same over one span's words, in Python."""
    lines: dict[int, list[float]] = {}
    for w in words:
        r = w["rect"]
        edges = (r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"])
        old = lines.setdefault(w["line"], list(edges))
        lines[w["line"]] = [min(old[0], edges[0]), min(old[1], edges[1]), max(old[2], edges[2]), max(old[3], edges[3])]
    return [{"x": x, "y": y, "w": right - x, "h": bottom - y} for _, (x, y, right, bottom) in sorted(lines.items())]


def placed(spans: Sequence[dict], words: Sequence[dict]) -> list[dict]:
    """Spans that touch a word which isn't blank, with a rectangle for each line."""
    own = sorted((w for w in words if w["text"] and w["text"].strip(" ")), key=lambda w: w["text_start"])
    starts, longest = [w["text_start"] for w in own], max((len(w["text"]) for w in own), default=0)
    out = []
    for s in spans:
        lo, hi = s["start"], s["start"] + s["length"]
        near = own[bisect_left(starts, lo - longest) : bisect_left(starts, hi)]
        hit = [w for w in near if w["text_start"] + len(w["text"]) > lo]
        if hit:
            keep = {k: s[k] for k in ("start", "length", "category", "confidence", "rule")}
            out.append(keep | {"text": s["text"].replace("\n", " ").strip(" "), "rects": _line_rects(hit)})
    return out


def _plain(word: object) -> dict:
    return word if isinstance(word, dict) else word.asDict(True)


def to_findings(pages: DataFrame, threshold: float = 0.6, keep_text: bool = True) -> DataFrame:
    """One row for each span that stays when overlaps are resolved and that touches a word.

    Pages without a ``words`` column have those of their plain text. One Arrow-batched pass; a span is
    bounded by its page, so words and spans meet without a join.
    """
    ship(pages.sparkSession)
    given = "words" in pages.columns

    @F.pandas_udf(PLACED)
    def found(spans: pd.Series, of: pd.Series) -> pd.Series:
        out = []
        for each, page in zip(spans, of, strict=True):
            kept = keep_best(each) if each is not None else []
            words = [_plain(w) for w in page if w is not None] if given and page is not None else words_of_text(page) if kept and not given else []
            out.append(placed(kept, words))
        return pd.Series(out)

    rows = pages.where(F.size("spans") > 0).select("doc_id", "page", F.explode_outer(found("spans", "words" if given else "text")).alias("s")).where("s is not null")
    return rows.select(
        "doc_id", "page", "s.start", "s.length", (F.col("s.text") if keep_text else F.sha2(F.col("s.text").cast("binary"), 256)).alias("text"),
        "s.category", "s.confidence", "s.rule", "s.rects", F.lit(False).alias("is_manual"), accepted(F.col("s.category"), F.col("s.confidence"), threshold).alias("accepted"),
    )


def detect(pages: DataFrame, options: Options | None = None) -> DataFrame:
    """All findings of a table of pages (doc_id, page, text, optionally words): both passes, overlap resolution, geometry."""
    o = options or Options()
    keep = ["doc_id", "page", "text", *(["words"] if "words" in pages.columns else [])]
    found = detect_rules(pages.select(*keep), o.terms, o.in_order())
    if o.forms:
        if "words" not in keep:  # only pages that may have a label need geometry here
            found = add_words(found, may_have_label(F.col("text")))
        found = add_form_fields(found)
        found = found if "words" in keep else found.drop("words")
    if o.propagate:  # pass 2 reads pass 1 several times, so it is written once
        found = with_pass2(written(found), o.lexicon)
    return to_findings(found.withColumn("spans", without(F.col("spans"), o.disabled)), o.threshold, o.keep_text)


def find_term(pages: DataFrame, term: str, accept: bool = True) -> DataFrame:
    """Every match of a term on every page as a sure finding."""
    return to_findings(detect_rules(pages, [term], ())).withColumn("accepted", F.lit(accept))
