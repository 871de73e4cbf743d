"""Redacted output: boxes to paint, words that survive, and text without what was accepted."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import rects as R
from umbra.functions.shipping import python_ready
from umbra.operators.resolve import accepted, keep_best

PADDING, DPI = 1.5, 200
#: Side of a square of the grid in which words and boxes meet, in points.
CELL = 72.0
#: What parts the words of a plain text, and what they are made of.
BLANKS, SOLID = r"[ \t\n\r\f\x0B]+", re.compile(r"[^ \t\n\r\f\x0B]+")


def boxes(findings: DataFrame, padding: float = PADDING, dpi: int = DPI) -> DataFrame:
    """Accepted rectangles, padded, in points and as whole pixels that cover them."""
    rows = findings.where("accepted").select("doc_id", "page", F.explode("rects").alias("r")).select("doc_id", "page", R.inflate(F.col("r"), padding).alias("box"))
    by = dpi / 72
    return rows.select(
        "doc_id", "page", "box",
        F.floor(F.col("box.x") * by).alias("px_left"), F.floor(F.col("box.y") * by).alias("px_top"),
        F.ceil((F.col("box.x") + F.col("box.w")) * by).alias("px_right"), F.ceil((F.col("box.y") + F.col("box.h")) * by).alias("px_bottom"),
    )


def _cells(r: Column) -> Column:
    """The squares of a page's grid that a rectangle touches."""
    across = F.sequence(F.floor(r["x"] / CELL), F.floor((r["x"] + r["w"]) / CELL))
    down = F.sequence(F.floor(r["y"] / CELL), F.floor((r["y"] + r["h"]) / CELL))
    return F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: F.struct(x.alias("cx"), y.alias("cy")))))


def surviving_words(words: DataFrame, findings: DataFrame, padding: float = PADDING) -> DataFrame:
    """Words that no padded accepted rectangle of their page touches.

    Words and boxes meet by the squares of a grid, so a page of many words and many boxes isn't
    compared word by box. Words without a rectangle, or with one of negative size, touch nothing.
    """
    cover = boxes(findings, padding).select("doc_id", "page", "box").where("box.w >= 0 and box.h >= 0")
    cover = cover.select("doc_id", "page", "box", F.inline(_cells(F.col("box"))))
    # a word lies in few squares; those it doesn't share with a box cost one probe each
    place = words.where("rect.w >= 0 and rect.h >= 0").select("doc_id", "page", "idx", "rect", F.inline(_cells(F.col("rect"))))
    same = [place[c] == cover[c] for c in ("doc_id", "page", "cx", "cy")]
    hit = place.join(cover, [*same, R.intersects(place["rect"], cover["box"])], "left_semi").select("doc_id", "page", "idx").distinct()
    return words.join(hit, ["doc_id", "page", "idx"], "left_anti")


def text_layer(words: DataFrame) -> DataFrame:
    """The surviving text of each page, in word order; words thinner than half a point are left out."""
    shown = words.where("rect.w > 0.5 and rect.h > 0.5")
    parts = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return shown.groupBy("doc_id", "page").agg(F.array_join(F.transform(parts, lambda w: w["text"]), " ").alias("text"))


def cut_words(text: str, spans: Sequence[dict]) -> str:
    """A text's words with one blank between two; nothing is left of those that an accepted span touches once overlaps are resolved."""
    gone = [(s["start"], s["start"] + s["length"]) for s in keep_best(spans) if s["accepted"]]
    out, i = [], 0
    for word in SOLID.finditer(text):
        while i < len(gone) and gone[i][1] <= word.start():
            i += 1
        out.append("" if i < len(gone) and gone[i][0] < word.end() else word[0])
    return " ".join(out)


def plain_text_layer(pages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``text_layer`` of plain texts with their ``spans``, without a table of words: only texts with spans go to Python, each moves once.

    Words of plain text lie further apart than the padding, so a box touches just the words its spans
    touch. Rows that repeat a doc_id and page are one page; their words meet by place, then by text.
    Pages without surviving words have no row; null keys are a page like any other.
    """
    python_ready(pages.sparkSession)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else cut_words(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    keys = ("start", "length", "confidence", "seq")
    judged = F.transform("spans", lambda s: F.struct(*[s[k].alias(k) for k in keys], accepted(s["category"], s["confidence"], threshold).alias("accepted")))
    text = F.coalesce("text", F.lit(""))
    # a word that went leaves its blanks, so the n-th of the parts between blanks is the text's n-th word
    kept = F.coalesce(cut(F.when(F.size("spans") > 0, text), judged), F.trim(F.regexp_replace(text, BLANKS, " ")))
    rows = pages.select("doc_id", "page", kept.alias("kept")).groupBy("doc_id", "page").agg(F.collect_list("kept").alias("rows"))
    words = F.flatten(F.transform("rows", lambda r: F.transform(F.split(r, " "), lambda w, n: F.struct(n.alias("n"), w.alias("w")))))
    met = F.array_join(F.transform(F.sort_array(F.filter(words, lambda x: x["w"] != "")), lambda x: x["w"]), " ")
    left = F.when(F.size("rows") == 1, F.trim(F.regexp_replace(F.col("rows")[0], " {2,}", " "))).otherwise(met)
    return rows.where(F.exists("rows", lambda r: F.trim(r) != "")).select("doc_id", "page", left.alias("text"))


def write_redacted(words: DataFrame, findings: DataFrame, path: str, mode: str = "error") -> None:
    """The redacted text of all pages as Parquet."""
    text_layer(surviving_words(words, findings)).write.mode(mode).parquet(path)


def output_name(path: Column) -> Column:
    """base.ext becomes base-REDACTED.pdf in the same folder."""
    return F.concat(F.regexp_replace(path, r"\.[^./\\]*$", ""), F.lit("-REDACTED.pdf"))


def page_range(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages of a user's range, cut to what there is."""
    return pages.where(F.col("page").between(max(1, first), last))
