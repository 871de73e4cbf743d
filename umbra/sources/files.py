"""Files as documents and pages."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.shipping import ship

# The file types that are known.
WORD_TYPES = ("docx", "docm", "doc", "dotx", "dot", "rtf", "odt", "txt")
IMAGE_TYPES = ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp")
BUILT_IN = ("txt", "docx", "docm")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A Letter page with its margin, and the layout's line height and mean character width in points.
PAGE_W, PAGE_H, MARGIN, LINE_H, CHAR_W = 612.0, 792.0, 54.0, 15.0, 5.5


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_supported(path: Column) -> Column:
    return extension(path).isin("pdf", *WORD_TYPES, *IMAGE_TYPES)


def kind_of(path: Column) -> Column:
    e = extension(path)
    return F.when(e == "pdf", "pdf").when(e.isin(*WORD_TYPES), "word").when(e.isin(*IMAGE_TYPES), "image").otherwise("unsupported")


def docx_paragraphs(content: bytes) -> list[str]:
    """Paragraphs of a document's body; a table row is one, its cells four blanks apart."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            out.append(text(child))
        elif child.tag == f"{_W}tbl":
            out += ["    ".join(text(cell) for cell in row.findall(f"{_W}tc")) for row in child.findall(f"{_W}tr")]
    return out


def wrapped_lines(paragraphs: list[str]) -> list[str]:
    """Paragraphs broken at words to the page's width; a blank one is a blank line."""
    room = int((PAGE_W - 2 * MARGIN) / CHAR_W)
    out = []
    for paragraph in paragraphs:
        line = ""
        for word in paragraph.split(" "):
            if line and len(line) + 1 + len(word) > room:
                out.append(line)
                line = word
            else:
                line = f"{line} {word}" if line else word
        out.append(line)
    return out


def laid_out(paragraphs: list[str]) -> list[str]:
    """The text of each page of a simple layout. Font metrics are approximated by one mean character width."""
    lines, per_page = wrapped_lines(paragraphs), int((PAGE_H - 2 * MARGIN) / LINE_H)
    return ["\n".join(lines[i : i + per_page]) for i in range(0, max(1, len(lines)), per_page)]


def read_documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Pages of all readable files under a path: doc_id (the path), page, width, height, text, from_ocr, note, warning.

    txt and docx/docm files are read here; PDF text, images and old Word formats need engines that a
    cluster need not have, so such files, and broken ones, come as one row with a warning and no text.
    """
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                kind = name.rsplit(".", 1)[-1].lower()
                note, warning, texts = None, None, [None]
                try:
                    if kind == "txt":
                        texts, note = laid_out(bytes(content).decode("utf-8-sig", "replace").replace("\r\n", "\n").split("\n")), "plain text"
                    elif kind in ("docx", "docm"):
                        texts, note = laid_out(docx_paragraphs(bytes(content))), "built-in reader"
                    else:
                        warning = "no reader for this file type"
                except Exception as broken:  # noqa: BLE001 - one bad file must not stop the others
                    warning = f"unreadable: {type(broken).__name__}"
                rows += [(name, n, PAGE_W, PAGE_H, t, False, note, warning) for n, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "page", "width", "height", "text", "from_ocr", "note", "warning"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, page int, width double, height double, text string, from_ocr boolean, note string, warning string")


def image_page(width_px: Column, height_px: Column, dpi: Column) -> Column:
    """Size in points of the one page that an image becomes."""
    per = F.when(dpi > 0, dpi).otherwise(F.lit(96.0))
    return F.struct((width_px * 72.0 / per).alias("width"), (height_px * 72.0 / per).alias("height"))


def load_report(pages: DataFrame) -> DataFrame:
    """Per document: note, pages, pages read by OCR, warnings."""
    return pages.groupBy("doc_id").agg(
        F.max("note").alias("note"), F.count("*").alias("n_pages"), F.count_if("from_ocr").alias("ocr_pages"), F.array_sort(F.collect_set("warning")).alias("warnings")
    )


def full_text(pages: DataFrame) -> DataFrame:
    """Per document: its pages' texts, a form feed on a line of its own between them."""
    parts = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\f\n").alias("text"))


def documents_as_pages(docs: DataFrame) -> DataFrame:
    """A documents table with each text as one page."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(1).alias("page"), F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"), "text", F.lit(False).alias("from_ocr"))


def normalised_layout(text: Column) -> Column:
    """Runs of blanks as one and no blanks at line ends, as text taken from laid-out pages has it."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?m) +$|^ +", "")


def needs_ocr(words: Column, text: Column) -> Column:
    """Fewer than three words, or letters and digits under 30 % of the text."""
    solid = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{Nd}]", ""))
    return (words < 3) | (solid < 0.3 * F.char_length(text))


def ocr_dpi(width: Column, height: Column) -> Column:
    """Resolution that makes the long side some 2500 pixels, between 96 and 300."""
    return F.least(F.greatest(F.floor(2500 * 72 / F.greatest(width, height)), F.lit(96)), F.lit(300))


def reconciled(rendered: Column, extracted: Column) -> Column:
    """The renderer's page size where it has one."""
    return F.when(rendered > 0, rendered).otherwise(extracted)


DEFAULTS = {"terms": [], "disabled_categories": [], "dpi": 200, "keep_text_layer": True, "propagate_names": True, "folder": None}


def load_settings(path: str) -> dict:
    """Settings from a JSON file; a missing or broken file, or a wrong type, gives the defaults."""
    try:
        found = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return dict(DEFAULTS)
    if not isinstance(found, dict):
        return dict(DEFAULTS)
    return {k: found[k] if k in found and (v is None or isinstance(found[k], type(v))) else v for k, v in DEFAULTS.items()}


def save_settings(path: str, settings: dict) -> None:
    Path(path).write_text(json.dumps(settings, indent=2), "utf-8")
