"""Values beneath the labels of boxed forms, found by geometry."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions.shipping import ship
from umbra.operators.detect import FORM_SEQ, STREET_TYPES
from umbra.schemas import SPANS

# Label phrases, letters only and in capitals, by the kind of value beneath them.
LABELS = {
    "date": "DATEOFBIRTH DOB BIRTHDATE DATEOFBIRTHMMDDYYYY DOBMMDDYYYY",
    "ssn": "SSN SSNUMBER SSNO SOCIALSECURITYNUMBER SOCIALSECURITYNO SOCIALSECURITY SOCSECNO",
    "id": "IDNUMBER IDNO DLNUMBER DLNO DL OLN OLNUMBER DRIVERSLICENSENUMBER DRIVERSLICENSENO DRIVERLICENSENUMBER LICENSENUMBER LICENSENO OPERATORSLICENSENUMBER STATEIDNUMBER",
    "phone": "HOMEPHONE PHONE PHONENUMBER PHONENO TELEPHONE TELEPHONENUMBER CELLPHONE CELL MOBILE WORKPHONE EMERGENCYPHONE CONTACTNUMBER CONTACTPHONE",
    "place": "ADDRESS HOMEADDRESS RESIDENCEADDRESS STREETADDRESS ADDRESSNUMBERNAMESUFFIX ADDRESSNUMBERSTREETSUFFIX EXACTLOCATIONOFVIOLATION EXACTLOCATIONOFARREST "
    "LOCATIONOFVIOLATION LOCATIONOFARREST LOCATIONOFOFFENSE LOCATIONOFINCIDENT INCIDENTLOCATION OFFENSELOCATION LOCATIONOFOCCURRENCE",
}
RESULT = {"date": ("DateOfBirth", 0.95), "ssn": ("SocialSecurityNumber", 0.95), "id": ("DriverLicense", 0.9), "phone": ("PhoneNumber", 0.9), "place": ("Address", 0.75)}
KIND_OF = {label: kind for kind, labels in LABELS.items() for label in labels.split()}
LONGEST = 5

_DATE = re.compile(r"(?:0?[1-9]|1[0-2])[/\-.](?:0?[1-9]|[12]\d|3[01])[/\-.](?:(?:19|20)\d{2}|\d{2})$")
_SSN = re.compile(r"\d{3}-?\d{2}-?\d{4}$")
_ID = re.compile(r"[A-Z0-9\-]{5,20}$", re.IGNORECASE)
_STREET_TYPE = re.compile(rf"(?:{STREET_TYPES})\.?,?$", re.IGNORECASE)
_PHONE_CHARS = re.compile(r"[\d().+\-]+$")


def _number(token: str, low: int, high: int) -> bool:
    return token.isdigit() and len(token) <= 4 and low <= int(token) <= high


def _accept(kind: str, tokens: list[str]) -> int:
    """How many of the tokens, from the first on, make a value of the kind; 0 for none."""
    first = tokens[0]
    if kind == "date":
        boxed = len(tokens) >= 3 and _number(tokens[0], 1, 12) and _number(tokens[1], 1, 31) and re.fullmatch(r"(?:19|20)?\d{2}", tokens[2])
        return 1 if _DATE.match(first) else 3 if boxed else 0
    if kind == "ssn":
        boxed = [len(t) for t in tokens[:3] if t.isdigit()] == [3, 2, 4]
        return 1 if _SSN.match(first) else 3 if boxed else 0
    if kind == "id":
        return 1 if _ID.match(first) and sum(c.isdigit() for c in first) >= 2 else 0
    if kind == "phone":
        digits = ""
        for n, token in enumerate(tokens[:3], 1):
            if not _PHONE_CHARS.match(token):
                return 0
            digits += "".join(c for c in token if c.isdigit())
            if len(digits) == 10 + digits.startswith("1"):
                return n
        return 0
    run = tokens[:6]
    return len(run) if any(c.isdigit() for c in run[0]) or _STREET_TYPE.match(run[-1]) else 0


def _labels_of(line: list[dict]) -> list[tuple[int, int, str]]:
    """(first, last, kind) of the label phrases in a line's words by left edge, longest phrases first."""
    keys = ["".join(c for c in w["text"] if c.isalpha()).upper() for w in line]
    out, at = [], 0
    while at < len(line):
        for n in range(min(LONGEST, len(line) - at), 0, -1):
            kind = KIND_OF.get("".join(keys[at : at + n]))
            if kind and keys[at]:
                out.append((at, at + n - 1, kind))
                at += n - 1
                break
        at += 1
    return out


def form_spans(words: list[dict], page_width: float) -> list[tuple]:
    """(start, end, kind) of the values that stand beneath labels on one page."""
    lines: dict[int, list[dict]] = {}
    for w in words:
        lines.setdefault(w["line"], []).append(w)
    edge = lambda w: (w["rect"]["x"], w["rect"]["x"] + w["rect"]["w"], w["rect"]["y"], w["rect"]["y"] + w["rect"]["h"])
    out = []
    for line in lines.values():
        line.sort(key=lambda w: w["rect"]["x"])
        for first, last, kind in _labels_of(line):
            label = line[first : last + 1]
            left, right = min(edge(w)[0] for w in label), max(edge(w)[1] for w in label)
            top, bottom = min(edge(w)[2] for w in label), max(edge(w)[3] for w in label)
            height = bottom - top
            level = [w for w in words if w not in label and top <= (edge(w)[2] + edge(w)[3]) / 2 <= bottom]
            cell_left = max((edge(w)[1] for w in level if edge(w)[1] <= left), default=0.0)
            cell_right = min((edge(w)[0] for w in level if edge(w)[0] >= right), default=page_width)
            below = [w for w in words if bottom - 0.5 <= edge(w)[2] <= bottom + max(3 * height, 16) and cell_left <= (edge(w)[0] + edge(w)[1]) / 2 <= cell_right]
            if not below:
                continue
            head = min(edge(w)[2] for w in below)
            row = sorted((w for w in below if edge(w)[2] - head <= 4), key=lambda w: w["rect"]["x"])
            begin = next((i for i, w in enumerate(row) if edge(w)[1] > left - 4), 0)
            run = [row[begin]]
            for w in row[begin + 1 :]:
                if edge(w)[0] - edge(run[-1])[1] > max(16, 3 * height):
                    break
                run.append(w)
            for offset in range(len(run)):
                n = _accept(kind, [w["text"] for w in run[offset:]])
                if n:
                    out += [(lo, hi, kind) for lo, hi in _joined(run[offset : offset + n])]
                    break
    return out


def _joined(words: list[dict]) -> list[tuple[int, int]]:
    """Spans of words, with neighbours in the text made one."""
    out: list[list[int]] = []
    for w in sorted(words, key=lambda w: w["text_start"]):
        lo, hi = w["text_start"], w["text_start"] + len(w["text"])
        if out and lo == out[-1][1] + 1:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def add_form_fields(pages: DataFrame, page_width: float = 612.0) -> DataFrame:
    """``pages`` (with text and words) whose ``spans`` also hold the values beneath form labels."""
    ship(pages.sparkSession)

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series, words: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, words, strict=True):
            own = [w if isinstance(w, dict) else w.asDict(True) for w in own] if own is not None else []
            if not any("".join(c for c in w["text"] if c.isalpha()).upper() in _STARTS for w in own):
                out.append([])
                continue
            spans = form_spans(own, page_width)
            out.append([
                {"start": lo, "length": hi - lo, "category": RESULT[k][0], "confidence": RESULT[k][1], "rule": f"form {k}", "seq": FORM_SEQ, "text": text[lo:hi]} for lo, hi, k in spans
            ])
        return pd.Series(out)

    return pages.withColumn("spans", F.concat("spans", found("text", "words")) if "spans" in pages.columns else found("text", "words"))


#: What the first word of a label can be.
_STARTS = frozenset(label[:n] for label in KIND_OF for n in range(1, len(label) + 1))


def _spelt(labels: list[str]) -> str:
    """A pattern of the labels with any characters but letters between their letters; common beginnings are tried once."""
    tails: dict[str, list[str]] = {}
    for label in labels:
        tails.setdefault(label[0], []).append(label[1:])
    ways = []
    for first, rest in sorted(tails.items()):
        more = [r for r in rest if r]
        longer = rf"(?:\P{{L}}*+{_spelt(more)})" if more else ""
        ways.append(first + longer + ("?" if more and "" in rest else ""))
    return f"(?:{'|'.join(ways)})"


#: A text in capitals without this has no label: all that ``_labels_of`` finds in words by their order in the text, and more.
LABEL = r"(?<!\p{L})" + _spelt(sorted(KIND_OF)) + r"(?!\p{L})"


def may_have_label(text: Column) -> Column:
    return F.upper(text).rlike(LABEL)
