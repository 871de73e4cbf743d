"""Detectors: each reads a page's digit runs, marked words and neighbours and says where its values stand."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.functions.reading import Page, alnum, blanks, count, digit_run, first_words, luhn, over, phrases, run_of, solid_end, spaces, trim, wrap
from umbra.functions.shipping import python_ready
from umbra.schemas import SPANS


class Found(NamedTuple):
    """A value's place on its page; ``category`` and ``rule`` only where they differ from the detector's."""

    start: int
    end: int
    confidence: float
    category: str | None = None
    rule: str | None = None


@dataclass(frozen=True)
class Detector:
    """A named rule. ``find`` gets a Page; ``leads`` are the words whose places it looks up there.

    Users pass their own in ``findings.Options(detectors=[...])``, alone or after ``BUILT_IN``.
    """

    name: str
    category: str
    find: Callable[[Page], Iterable[Found]]
    leads: frozenset[str] = frozenset()


# Names, codes and abbreviations that addresses, dates and labels are written with.
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec".split()
STATES = frozenset("AL AK AZ AR CA CO CT DC DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY".split())
STREET_TYPES = frozenset(
    "alley aly avenue ave bend boulevard blvd circle cir court ct cove cv creek crk crossing xing drive dr estates ests expressway expy freeway fwy gardens gdns "
    "grove grv harbor hbr heights hts highway hwy hill hls island junction jct lake lk landing lndg lane ln loop manor mnr meadows mdws mount mt orchard orch park "
    "parkway pkwy pass path pike place pl plaza plz point pt ranch rnch ridge rdg road rd route rte row run shore shr spring spg springs spgs square sq station sta "
    "street st summit smt terrace ter trace trce trail trl turnpike tpke valley vly view vw village vlg vista vis walk way".split()
)
GLUED_TYPES = ("street", "avenue", "ave", "road", "drive", "lane", "court", "circle", "trail", "pike", "parkway", "pkwy", "highway", "hwy", "boulevard", "blvd")
UNITS = frozenset("apt apartment unit suite ste bldg building floor fl rm room lot space spc #".split())
DIRECTIONS = frozenset("n s e w ne nw se sw north south east west".split())
FUNCTION_WORDS = frozenset("a an and are at by for from in is of on or the to was were with".split())
COUNTED = frozenset("am pm hrs hours min minutes seconds days months years ft feet miles deg degrees dollars percent people rounds shots".split())
PLATFORMS = (
    "instagram", "insta", "ig", "facebook", "fb", "snapchat", "snap chat", "snap", "tiktok", "tik tok", "twitter", "telegram", "whatsapp", "discord", "kik", "reddit", "youtube",
    "cashapp", "cash app", "venmo",
)
SSN_LABELS = ("ssn", "ssan", "ss#", "ss #", "ss no", "social security", "social sec", "soc security", "soc sec", "soc. sec")
BIRTH_LABELS = ("dob", "d.o.b", "date of birth", "birth date", "birthdate", "birthday", "born", "b/d", "age/dob", "dob/age")
PHONE_LABELS = ("phone", "telephone", "tel", "cell", "mobile", "fax", "pager", "ph", "home", "work", "contact", "call", "number", "no", "#")
ADDRESS_LABELS = ("address", "addr", "residence", "resides", "residing", "lives at", "home", "located at", "location", "street")
PLACE_LEADS = (
    "at", "to", "located at", "in front of", "lives at", "lives on", "live at", "live on", "resides at", "residing at", "residence at", "residence of", "address at", "address of",
    "address is", "address for",
)
LICENCE_LABELS = (
    "dl", "d.l.", "dln", "oln", "dl no", "state id", "state identification", "id no", "id number", "id card", "id #",
    *(f"{who} {what}" for who in ("driver's", "drivers", "driver", "operator's", "operators", "operator") for what in ("license", "licence")),
    *(f"{what} {number}" for what in ("license", "licence", "state id", "state identification") for number in ("no", "num", "number", "#")),
    "state id card", "state identification card",
)
ACCOUNT_LABELS = ("account", "acct", "routing", "aba", "iban", "checking", "savings", "card", "credit card", "debit")
JUSTICE_LABELS = ("fbi", "ucn", "sid", "sbi", "oca", "tcn", "dcn", "doc", "mni", "cch", "ncic", "inmate", "booking", "offender", "arrest", "jacket", "state identification")
PLATE_LABELS = ("plate", "license plate", "licence plate", "tag", "lp", "lic", "registration")
BIRTHPLACE_LABELS = ("place of birth", "birth place", "birthplace", "born in", "pob")
VIN_LABELS = ("vin", "vehicle id", "vehicle identification")
MAIDEN_LABELS = ("maiden name", "mother's maiden name", "mothers maiden name")

_SSN, _BIRTH, _PHONE, _ADDRESS, _VIN = (phrases(x) for x in (SSN_LABELS, BIRTH_LABELS, PHONE_LABELS, ADDRESS_LABELS, VIN_LABELS))
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


# --- numbers ------------------------------------------------------------------------------------


def _ssn_parts(area: str, group: str, serial: str) -> bool:
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def _ssn(page: Page) -> Iterator[Found]:
    for i, (lo, _) in enumerate(page.numbers):
        if (page.size(i), page.size(i + 1), page.size(i + 2)) == (3, 2, 4) and page.gap(i) in ("-", " ") and page.gap(i + 1) in ("-", " "):
            if _ssn_parts(page.digits(i), page.digits(i + 1), page.digits(i + 2)):
                yield Found(lo, page.numbers[i + 2][1], 0.98 if page.said_before(lo, _SSN, 40) else 0.9)


def _ssn_plain(page: Page) -> Iterator[Found]:
    for i, (lo, hi) in enumerate(page.numbers):
        if hi - lo == 9 and _ssn_parts(page.text[lo : lo + 3], page.text[lo + 3 : lo + 5], page.text[lo + 5 : hi]) and page.said_before(lo, _SSN, 50):
            yield Found(lo, hi, 0.9)


def _between(digits: str, low: int, high: int) -> bool:
    return 1 <= len(digits) <= 2 and low <= int(digits) <= high


def _year(digits: str) -> bool:
    return len(digits) == 4 and digits[:2] in ("19", "20")


def _date_found(page: Page, lo: int, hi: int) -> Found:
    return Found(lo, hi, 0.95, "DateOfBirth", "date of birth") if page.said_before(lo, _BIRTH, 45) else Found(lo, hi, 0.4)


def _number_date(order: str) -> Callable[[Page], Iterator[Found]]:
    """Dates of three numbers with a sign between; only before a four-digit year may the line end."""

    def find(page: Page) -> Iterator[Found]:
        until = 0
        for i in range(len(page.numbers) - 2):
            lo, hi = page.numbers[i][0], page.numbers[i + 2][1]
            one, two = page.gap(i), page.gap(i + 1)
            if one not in ("/", "-", ".") or two[:1] not in ("/", "-", ".") or lo < until or page.char(lo - 1) == "/" or page.char(hi) == "/":
                continue
            a, b, c = page.digits(i), page.digits(i + 1), page.digits(i + 2)
            if len(two) > 1 and (order != "mdy" or wrap(page.text, page.numbers[i + 1][1] + 1) != page.numbers[i + 2][0]):
                continue
            good = _year(a) and _between(b, 1, 12) and _between(c, 1, 31) if order == "ymd" else _between(a, 1, 12) and _between(b, 1, 31) and (_year(c) if order == "mdy" else len(c) == 2)
            if good:
                until = hi
                yield _date_found(page, lo, hi)

    return find


def _ordinal(page: Page, at: int) -> int:
    return at + 2 if page.low[at : at + 2] in ("st", "nd", "rd", "th") else at


def _year_at(page: Page, at: int) -> int:
    """The end of the year that stands after white space, or -1."""
    lo = spaces(page.text, at)
    hi = over(page.text, lo, DIGITS, 5)
    after = page.char(hi)
    return hi if lo > at and _year(page.text[lo:hi]) and not (after.isalnum() or after == "_") else -1


def _month_words(page: Page) -> Iterator[tuple[int, int]]:
    for month in MONTHS:
        for at in page.marks.get(month, ()):
            before = page.char(at - 1)
            if not (before.isalnum() or before == "_"):
                end = at + len(month)
                yield at, end + (page.char(end) == ".")


def _month_day(page: Page) -> Iterator[Found]:
    for at, end in sorted(_month_words(page)):
        day = spaces(page.text, end)
        stop = over(page.text, day, DIGITS, 3)
        if day == end or not 1 <= stop - day <= 2:
            continue
        stop = _ordinal(page, stop)
        hi = _year_at(page, stop + (page.char(stop) == ","))
        if hi > 0:
            yield _date_found(page, at, hi)


def _day_month(page: Page) -> Iterator[Found]:
    ends = {hi: lo for lo, hi in page.numbers if hi - lo <= 2}
    for at, end in sorted(_month_words(page)):
        back = at
        while back and page.text[back - 1].isspace():
            back -= 1
        if back == at:
            continue
        lo = ends.get(back, ends.get(back - 2, -1) if page.low[back - 2 : back] in ("st", "nd", "rd", "th") else -1)
        before = page.char(lo - 1)
        hi = _year_at(page, end + (page.char(end) == ","))
        if lo >= 0 and hi > 0 and not (before.isalpha() or before == "_"):
            yield _date_found(page, lo, hi)


def _after_sign(text: str, at: int) -> list[int]:
    """Where the next group of a phone number may begin: after a dot or dash, wrapped or not, or after one white space."""
    out = []
    sign = wrap(text, at)
    if sign < len(text) and text[sign] in ".-":
        out.append(blanks(text, sign + 1))
    if at < len(text) and text[at] in ".-":
        out.append(wrap(text, at + 1))
    if at < len(text) and text[at].isspace():
        out.append(at + 1)
    return out


def _phone(page: Page) -> Iterator[Found]:
    text, begins, until = page.text, {lo: i for i, (lo, _) in enumerate(page.numbers)}, 0
    for i, (lo, hi) in enumerate(page.numbers):
        start = lo
        if page.size(i) == 4 and text[lo] == "1":  # the country's code stands right before the area
            lo += 1
        elif page.size(i) != 3:
            continue
        bracket = page.char(lo - 1) == "(" and page.char(hi) == ")"
        if bracket:
            start, after = lo - 1, [hi + 1, *([hi + 2] if page.char(hi + 1).isspace() else [])]
        else:
            after = [x for x in (wrap(text, hi + 1) if page.char(hi) in (".", "-") and page.char(hi) else -1, hi + 1 if page.char(hi).isspace() else -1) if x > 0]
        groups = [begins[x] for x in after if page.size(begins.get(x, len(begins))) == 3]
        ends = [page.numbers[begins[y]][1] for g in groups for y in _after_sign(text, page.numbers[g][1]) if page.size(begins.get(y, len(begins))) == 4]
        if not ends:
            continue
        code = start - 1 if i and page.char(start - 1) and (page.char(start - 1).isspace() or page.char(start - 1) in ".-") else start
        if start == page.numbers[i][0] == lo or bracket:
            if page.char(code - 1) == "1" and not page.char(code - 2).isdigit() and page.char(code - 2) != "-":
                start = code - 1
        if page.char(start) == "1" and page.char(start - 1) == "+":
            start -= 1
        guard = page.char(start - 1)
        if start >= until and not (guard.isdigit() or guard == "-"):
            until = ends[0]
            yield Found(start, ends[0], 0.9)


def _said_phone(page: Page, at: int) -> bool:
    return page.said_before(at, _PHONE, 30) or "#" in page.text[max(0, at - 30) : at]


def plain_phones(page: Page) -> Iterator[tuple[int, int, bool]]:
    """(start, end, labelled) of ten digits in a row that can be a phone number."""
    for lo, hi in page.numbers:
        if hi - lo == 10 and page.text[lo] in "23456789":
            yield lo, hi, _said_phone(page, lo)


def _phone_plain(page: Page) -> Iterator[Found]:
    return (Found(lo, hi, 0.7) for lo, hi, labelled in plain_phones(page) if labelled)


def _card(page: Page) -> Iterator[Found]:
    i = 0
    while i < len(page.numbers):
        total, last, j = 0, -1, i
        while j < len(page.numbers) and total + page.size(j) <= 19:
            total += page.size(j)
            if total >= 13:
                last = j
            if page.gap(j) not in (" ", "-"):
                break
            j += 1
        if last < 0:
            i += 1
            continue
        lo, hi = page.numbers[i][0], page.numbers[last][1]
        digits = page.text[lo:hi].replace(" ", "").replace("-", "")
        if len(set(digits)) > 1 and luhn(digits):
            yield Found(lo, hi, 0.9)
        i = last + 1


def _ipv4(page: Page) -> Iterator[Found]:
    for i, (lo, _) in enumerate(page.numbers[:-3] if len(page.numbers) > 3 else ()):
        if page.gap(i) == page.gap(i + 1) == page.gap(i + 2) == ".":
            parts = [page.digits(i + k) for k in range(4)]
            hi = page.numbers[i + 3][1]
            if page.char(lo - 1) != "." and page.char(hi) != "." and all(len(p) <= 3 and int(p) <= 255 and str(int(p)) == p for p in parts):
                yield Found(lo, hi, 0.7)


def _vin(page: Page) -> Iterator[Found]:
    until = 0
    for lo, hi in page.numbers:
        if lo < until:
            continue
        while lo and (alnum(page.text[lo - 1]) or page.text[lo - 1] == "_"):
            lo -= 1
        hi = until = run_of(page.text, hi, "_", 1 << 30)
        code = page.text[lo:hi]
        if len(code) == 17 and code == code.upper() and not set(code) & set("IOQ_") and not page.char(hi).isalnum() and count(code, "digits") >= 3 and count(code, "letters") >= 3:
            yield Found(lo, hi, 0.97 if page.said_before(lo, _VIN, 30) else 0.8)


# --- e-mail, addresses --------------------------------------------------------------------------

_LOCAL, _HOST = frozenset(LETTERS + DIGITS + "._%+-"), frozenset(LETTERS + DIGITS + ".-")


def _email(page: Page) -> Iterator[Found]:
    text, floor = page.text, 0
    at = text.find("@")
    while at >= 0:
        lo, end = at, at + 1
        while lo > floor and text[lo - 1] in _LOCAL:
            lo -= 1
        while end < len(text) and text[end] in _HOST:
            end += 1
        dot = text.rfind(".", at + 2, end)
        while dot > 0 and over(text, dot + 1, LETTERS, 2) < dot + 3:
            dot = text.rfind(".", at + 2, dot)
        if lo < at and dot > 0:
            floor = over(text, dot + 1, LETTERS)
            yield Found(lo, floor, 0.97)
        at = text.find("@", max(at + 1, floor))


_NAME_SIGNS = ".'-"


def _zip_end(page: Page, at: int) -> int:
    """The end of a blank, a state's code, blanks and a ZIP code, or -1."""
    lo = blanks(page.text, at)
    if lo == at or page.text[lo : lo + 2].upper() not in STATES:
        return -1
    mark = lo + 2 + (page.char(lo + 2) == ".")
    digits = blanks(page.text, mark)
    end = over(page.text, digits, DIGITS, 5)
    if digits == mark or end - digits != 5:
        return -1
    more = over(page.text, end + 1, DIGITS, 4)
    return more if page.char(end) == "-" and more == end + 5 else end


def _city_end(page: Page, at: int) -> int:
    """The end of a city, state and ZIP code that go on an address, on this line or the next; else ``at``."""
    text = page.text
    word = blanks(text, at)
    word = wrap(text, word + (page.char(word) == ","))
    for _ in range(4):
        if not (page.char(word).isascii() and page.char(word).isalpha()):
            return at
        end = word
        while end < len(text) and (text[end].isascii() and text[end].isalpha() or text[end] in _NAME_SIGNS):
            end += 1
        comma = blanks(text, end)
        found = _zip_end(page, comma + 1 if page.char(comma) == "," else end)
        if found > 0:
            return found
        word = blanks(text, end)
        if word == end:
            return at
    return at


def _house_numbers(page: Page) -> Iterator[tuple[int, int]]:
    """(start, end) of one to six digits with perhaps a letter that blanks follow and nothing bars."""
    for lo, hi in page.numbers:
        before = page.char(lo - 1)
        if hi - lo > 6 or before.isalnum() or before in ("_", "/") or before == ":" and page.char(lo - 2).isdigit():
            continue
        end = hi + (page.char(hi).isascii() and page.char(hi).isalpha())
        if page.char(end) in (" ", "\t", "\n", "\r") and page.char(end):
            yield lo, end


def _street_end(page: Page, at: int) -> int:
    """The end of the street's type, one to four words after the place of a house number, or -1."""
    text, words, directed = page.text, 0, False
    for _ in range(6):
        nxt = blanks(text, at)
        wrapped = nxt < len(text) and text[nxt] in "\r\n"
        if wrapped:  # the type alone may stand on the next line, and only after plain words
            nxt = wrap(text, nxt)
        if nxt == at or wrapped and not plain if words else nxt == at or wrapped:
            return -1
        end = run_of(text, nxt, _NAME_SIGNS)
        word = text[nxt:end].lower()
        letters = word.rstrip(".")
        if words and letters in STREET_TYPES:
            return nxt + len(letters) + (page.char(nxt + len(letters)) == ".")
        if not word or wrapped or words >= 4 or letters in FUNCTION_WORDS:
            return -1
        if not words and not directed and letters in DIRECTIONS and run_of(text, blanks(text, end), _NAME_SIGNS) > blanks(text, end):
            directed, after = True, text[blanks(text, end) : run_of(text, blanks(text, end), _NAME_SIGNS)].lower().rstrip(".")
            words += after in STREET_TYPES  # "5 North Street": the direction is the name
        else:
            words += 1
        plain = not any(c.isdigit() for c in word) and "." not in word
        at = end
    return -1


def _street(page: Page) -> Iterator[Found]:
    text, until = page.text, 0
    for lo, at in _house_numbers(page):
        end = _street_end(page, at) if lo >= until else -1
        if end < 0:
            continue
        way = blanks(text, end)
        stop = run_of(text, way)
        if way > end and text[way:stop].lower() in DIRECTIONS and stop - way <= 2:
            end = stop
        unit = blanks(text, end)
        unit = blanks(text, unit + (page.char(unit) == ","))
        stop = unit + 1 if page.char(unit) == "#" else run_of(text, unit)
        if text[unit:stop].lower() in UNITS:
            number = blanks(text, stop + (page.char(stop) == "."))
            last = run_of(text, number, "-")
            if last > number:
                end = last
        end = until = _city_end(page, end)
        lo, end = trim(text, lo, end)
        yield Found(lo, end, 0.95 if page.said_before(lo, _ADDRESS, 40) else 0.85)


def _po_box(page: Page) -> Iterator[Found]:
    for at in page.marks.get("box", ()):
        number = spaces(page.text, at + 3)
        end = over(page.text, number, DIGITS)
        lead = re.search(r"(?<![a-z0-9_])p\.?\s?o\.?\s?$", page.low[max(0, at - 8) : at])
        if lead and number > at + 3 and end > number:
            yield Found(at - len(lead[0]), trim(page.text, at, _city_end(page, end))[1], 0.9)


_PLACE_LEAD = phrases(PLACE_LEADS, r"\s+\Z")


def _capital_word(page: Page, at: int, signs: str, least: int) -> int:
    """The end of a word that begins with a capital, or -1."""
    end = at
    while end < len(page.text) and (page.text[end].isascii() and page.text[end].isalpha() or page.text[end] in signs):
        end += 1
    return end if "A" <= page.char(at) <= "Z" and end - at >= least else -1


def _located(page: Page) -> Iterator[Found]:
    text = page.text
    for lo, hi in page.numbers:
        at = hi + (page.char(hi).isascii() and page.char(hi).isalpha())
        word = spaces(text, at)
        if hi - lo > 6 or word == at or not _PLACE_LEAD.search(page.low[max(0, lo - FAR_LEAD) : lo]):
            continue
        end = run_of(text, word, ".")
        if text[word:end].lower().rstrip(".") in DIRECTIONS and spaces(text, end) > end:
            word = spaces(text, end)
        words, end = 0, -1
        while words < 3 and (stop := _capital_word(page, word, "'-", 3)) > 0:
            if page.char(stop).isdigit():
                break
            if not words and text[word:stop].lower() in COUNTED:
                break
            words, end, word = words + 1, stop, spaces(text, stop)
            if word == stop:
                break
        if end > 0:
            lo, end = trim(text, lo, end)
            yield Found(lo, end, 0.7)


FAR_LEAD = 24


def _glued(page: Page) -> Iterator[Found]:
    for lo, at in _house_numbers(page):
        word = blanks(page.text, at)
        end = over(page.text, word, LETTERS)
        low = page.low[word:end]
        kind = next((t for t in GLUED_TYPES if low.endswith(t) and len(low) >= 4 + len(t)), None)
        after = page.char(end)
        if kind and word > at and page.text[at - 1].isdigit() and not (after.isalnum() or after == "_"):
            yield Found(lo, end, 0.75)


def _city_line(page: Page) -> Iterator[Found]:
    """Read backwards from a ZIP code: state, comma, and up to four words with capitals."""
    text = page.text
    back = lambda at: len(text[:at].rstrip()) if at and text[at - 1].isspace() else at
    for lo, hi in page.numbers:
        if hi - lo != 5 or page.char(hi).isalpha() or page.char(hi) == "_" or not (lo and text[lo - 1].isspace()):
            continue
        at = back(lo)
        at -= page.char(at - 1) == "."
        if at < 4 or text[at - 2 : at] not in STATES:
            continue
        comma = back(at - 2)
        if page.char(comma - 1) != ",":
            continue
        at, start = back(comma - 1), -1
        for _ in range(4):
            word = at
            while word and (text[word - 1].isascii() and text[word - 1].isalpha() or text[word - 1] in _NAME_SIGNS):
                word -= 1
            while word < at and not "A" <= text[word] <= "Z" and text[word] in _NAME_SIGNS:
                word += 1
            if at - word < 2 or not "A" <= text[word] <= "Z" or page.char(word - 1).isalnum():
                break
            start, nxt = word, back(word)
            if nxt == word:
                break
            at = nxt
        if start >= 0:
            more = over(text, hi + 1, DIGITS, 5)
            end = more if page.char(hi) == "-" and more == hi + 5 else hi
            yield Found(start, end, 0.75)


# --- labels with values -------------------------------------------------------------------------


def _after_label(page: Page, at: int) -> int:
    """Past a word for "number" and one mark after a label."""
    text = page.text
    at = spaces(text, at)
    for word in ("number", "num", "no", "#"):
        if page.low.startswith(word, at) and (word == "#" or not page.char(at + len(word)).isalpha()):
            at += len(word)
            at = spaces(text, at + (page.char(at) == "."))
            break
    return spaces(text, at + 1) if page.char(at) in (":", "#", "-") and page.char(at) else at


def _labelled(items: Sequence[str], confidence: float, value: Callable[[Page, int], tuple[int, int] | None], name: str, category: str, skip: Callable[[Page, int], int] = _after_label, tail: str = r"(?![a-z])") -> Detector:
    """A detector of the values that stand after labels; a value can't begin a second match."""
    label, leads = phrases(items, tail), frozenset(first_words(items))

    def find(page: Page) -> Iterator[Found]:
        until = 0
        for lo, hi in page.labels(leads, label):
            found = value(page, skip(page, hi)) if lo >= until else None
            if found and found[1] > found[0]:
                until = found[1]
                yield Found(*found, confidence)

    return Detector(name, category, find, leads)


def _licence_value(page: Page, at: int) -> tuple[int, int] | None:
    end = solid_end(page.text, at, " -", 20, 5) if alnum(page.char(at)) else -1
    if end < 0:
        return None
    lo, hi = digit_run(page.text[at:end])
    value = page.text[at + lo : at + hi]
    return (at + lo, at + hi) if count(value, "digits") >= 2 and count(value, "letters") <= 6 else None


def _passport_value(page: Page, at: int) -> tuple[int, int] | None:
    end = run_of(page.text, at)
    return (at, end) if 6 <= end - at <= 9 and page.char(end) != "_" and count(page.text[at:end], "digits") >= 4 else None


def _account_value(page: Page, at: int) -> tuple[int, int] | None:
    text = page.text
    digit = over(text, at, LETTERS, 2)
    end = digit
    while end < len(text) and (text[end] in DIGITS or text[end].isspace() or text[end] == "-") and end - digit < 32:
        end += 1
    while end > digit and not (text[end - 1] in DIGITS and page.char(end) not in tuple(DIGITS)):
        end -= 1
    return (at, end) if text[digit : digit + 1] in tuple(DIGITS) and end - digit >= 7 and count(text[at:end], "digits") >= 6 else None


def _justice_value(page: Page, at: int) -> tuple[int, int] | None:
    end = run_of(page.text, at, "-", 16)
    while end - at >= 5 and alnum(page.char(end)):
        end -= 1
    return (at, end) if end - at >= 5 and alnum(page.char(at)) and count(page.text[at:end], "digits") >= 3 else None


def _after_justice(page: Page, at: int) -> int:
    word = spaces(page.text, at)
    return _after_label(page, word + 2) if page.low.startswith("id", word) and not page.char(word + 2).isalpha() else _after_label(page, at)


def _after_badge(page: Page, at: int) -> int:
    text = page.text
    at = blanks(text, at)
    at = blanks(text, at + (page.char(at) == "/"))
    found = re.compile(r"i\.?[ \t]?d\.?(?![a-z])").match(page.low, at)
    at = blanks(text, found.end()) if found else at
    for word in ("number", "num", "no", "#"):
        if page.low.startswith(word, at):
            at += len(word)
            at = blanks(text, at + (page.char(at) == "."))
            break
    return wrap(text, at + (page.char(at) in (":", "#", "-") and page.char(at) != ""))


def _badge_value(page: Page, at: int) -> tuple[int, int] | None:
    end = over(page.text, at, DIGITS)
    return (at, end) if 2 <= end - at <= 8 else None


def _plate_end(page: Page, at: int) -> int:
    """The end of four to eight signs in one or two groups, one of them a digit, or -1."""
    text = page.text
    one = run_of(text, at)
    end = one
    if 2 <= one - at <= 4 and page.char(one) in ("-", " ") and page.char(one):
        two = run_of(text, one + 1)
        end = two if 2 <= two - one - 1 <= 4 else one
    size = end - at
    return end if (4 <= size <= 8 or end != one) and any(c in DIGITS for c in text[at:end]) else -1


_PLATE_FILLERS = frozenset("no num number # state st year yr".split())


def _plate_value(page: Page, at: int) -> tuple[int, int] | None:
    places, text = [at], page.text
    while len(places) < 8:  # sub-labels, states, years and marks may stand between
        at = places[-1]
        end = run_of(text, at)
        word = text[at:end]
        if page.char(at) in (":", ",", "/", "-", "#") and page.char(at):
            end = at + 1
        elif word.lower() in _PLATE_FILLERS or word.upper() in STATES or _year(word):
            end += page.char(end) == "." and word.lower() in _PLATE_FILLERS
        else:
            break
        places.append(wrap(text, end))
    return next(((p, e) for p in reversed(places) if (e := _plate_end(page, p)) > 0), None)


def _birthplace_value(page: Page, at: int) -> tuple[int, int] | None:
    end = _capital_word(page, at, _NAME_SIGNS, 2)
    if end < 0:
        return None
    for _ in range(3):
        word = end + (page.char(end) == ",")
        stop = _capital_word(page, word + 1, _NAME_SIGNS, 2) if page.char(word) == " " else -1
        if stop < 0 or page.char(stop) == ":":
            break
        end = stop
    return trim(page.text, at, end)


def _maiden_value(page: Page, at: int) -> tuple[int, int] | None:
    end = at
    while end < len(page.text) and (page.text[end].isascii() and page.text[end].isalpha() or page.text[end] in "'-"):
        end += 1
    return (at, end) if page.char(at).isalpha() and end - at >= 2 else None


def _only_mark(page: Page, at: int) -> int:
    at = spaces(page.text, at)
    return spaces(page.text, at + 1) if page.char(at) in (":", "#", "-") and page.char(at) else at


# --- handles and links --------------------------------------------------------------------------

_KINDS = ("handle", "account", "username", "user name", "name", "user", "id")
_SAYING = ("username", "user name", "screen name", "display name")
_HANDLE_LABELS = (*(f"{p} {k}" for p in PLATFORMS for k in _KINDS), *_SAYING, "handle")
_ACCOUNT_LABELS = tuple(f"{p} {k}" for p in PLATFORMS for k in ("account", "user", "profile", "page"))
_HANDLE_LABEL, _ACCOUNT_LABEL, _PLATFORM = phrases(_HANDLE_LABELS), phrases(_ACCOUNT_LABELS), phrases(PLATFORMS)
_LINKS = ("of", "is", "was", "named", "name")
HANDLE_LEADS = frozenset(first_words(_HANDLE_LABELS))


def _linker(page: Page, at: int, words: Sequence[str] = _LINKS) -> tuple[int, str]:
    """Past a linking word or colon after a label; which it was."""
    word = spaces(page.text, at)
    if page.char(word) == ":":
        return spaces(page.text, word + 1), ":"
    end = over(page.low, word, LETTERS)
    return (spaces(page.text, end), page.low[word:end]) if page.low[word:end] in words else (word, "")


def _token(page: Page, at: int) -> tuple[int, int] | None:
    """The handle-like token at a place without the stops that end it."""
    stop = run_of(page.text, at, "._")
    end = at + len(page.text[at:stop].rstrip("."))
    return (at, end) if alnum(page.char(at)) and 3 <= end - at <= 39 and page.char(stop) != "_" else None


def _handle_after(page: Page, label: re.Pattern, leads: frozenset[str], articles: bool) -> Iterator[Found]:
    until = 0
    for lo, hi in page.labels(leads, label):
        at, link = _linker(page, hi)
        said = any(page.low[lo:hi].endswith(x.split()[-1]) and x in " ".join(page.low[lo:hi].split()) for x in (*_SAYING, "handle"))
        bare = page.low[lo:hi] == "handle"
        if at == hi or lo < until or bare and not link or page.low[hi : hi + 1].isalnum():
            continue
        if articles:
            for word in ("of", "a", "the"):
                if page.low.startswith(word + " ", at):
                    at, link = spaces(page.text, at + len(word)), link or ("of" if word == "of" else "")
        found = _token(page, at)
        if found and (said or link in ("of", "named", "name", ":") or T.handle_like(page.text[slice(*found)])):
            until = found[1]
            yield Found(*found, 0.9)


def _handle_labelled(page: Page) -> Iterator[Found]:
    return _handle_after(page, _HANDLE_LABEL, HANDLE_LEADS, True)


def _handle_account(page: Page) -> Iterator[Found]:
    return _handle_after(page, _ACCOUNT_LABEL, HANDLE_LEADS, False)


def _handle_export(page: Page) -> Iterator[Found]:
    """Read backwards from a platform's name and number in brackets."""
    for lo, hi in page.labels(HANDLE_LEADS, _PLATFORM):
        number = spaces(page.text, hi)
        number = spaces(page.text, number + (page.char(number) == ":"))
        close = over(page.text, number, DIGITS)
        if page.char(lo - 1) != "(" or close - number < 5 or page.char(close) != ")":
            continue
        end = lo - 1
        while end and page.text[end - 1].isspace():
            end -= 1
        start = end
        while start and end - start < 40 and (alnum(page.text[start - 1]) or page.text[start - 1] in "._"):
            start -= 1
        if 3 <= end - start <= 39 and alnum(page.text[start]) and page.char(start - 1) not in ("@", "/"):
            yield Found(start, end - (len(page.text[start:end]) - len(page.text[start:end].rstrip("."))), 0.95)


def line_heads(page: Page) -> Iterator[tuple[int, int]]:
    """(start, end) of the token that begins a line and that a dash and more text follow."""
    at = 0
    while at < len(page.text):
        stop = page.text.find("\n", at)
        stop = len(page.text) if stop < 0 else stop
        lo = blanks(page.text, at)
        hi = run_of(page.text, lo, "._", 40)
        if 3 <= hi - lo <= 39 and page.char(hi) == "-" and alnum(page.char(lo)):
            after = page.char(blanks(page.text, hi + 1))
            if after and not after.isspace():
                yield lo, lo + len(page.text[lo:hi].rstrip("."))
        at = stop + 1


def _handle_line(page: Page) -> Iterator[Found]:
    return (Found(lo, hi, 0.85) for lo, hi in line_heads(page) if T.handle_like(page.text[lo:hi]))


_ODD = re.compile(r"[0-9_]|\.(?=[A-Za-z0-9])")


def shaped_tokens(page: Page, every: bool = False) -> Iterator[tuple[int, int]]:
    """(start, end) of the free-standing tokens that could be handles; those with a digit, stop or underscore unless ``every``."""
    text, at = page.text, 0
    seek = re.compile(r"[A-Za-z0-9]") if every else _ODD
    while m := seek.search(text, at):
        lo, hi = m.start(), run_of(text, m.end(), "._", 1 << 30)
        while lo and (alnum(text[lo - 1]) or text[lo - 1] in "._"):
            lo -= 1
        at = hi
        end = lo + len(text[lo:hi].rstrip("."))
        before, after = page.char(lo - 1), page.char(end)
        if not 5 <= end - lo <= 40 or not alnum(text[lo]) or before in tuple("@/%&=") or after in ("@", "/"):
            continue
        if before == "-" and alnum(page.char(lo - 2)) or after == "-" and alnum(page.char(end + 1)):
            continue
        yield lo, end


def _handle_shape(page: Page) -> Iterator[Found]:
    return (Found(lo, hi, 0.7) for lo, hi in shaped_tokens(page) if T.handle_like(page.text[lo:hi]))


_URL_END = re.compile(r"[\s<>\"]|\Z")


def _link(page: Page) -> Iterator[Found]:
    text, at = page.text, 0
    while True:
        begins = [(p, p + len(s)) for s in ("http://", "https://", "www.") if (p := page.low.find(s, at)) >= 0]
        if not begins:
            return
        lo, body = min(begins)
        end = _URL_END.search(text, body).start()
        at = max(end, body)
        if end == body:
            continue
        while text.startswith(("\n", "\r\n"), end):  # the rest of a wrapped address stands alone on its line
            nxt = wrap(text, end)
            stop = _URL_END.search(text, nxt).start()
            more = text[nxt:stop]
            if stop - nxt < 6 or page.char(stop) not in ("\n", "\r", "") or not any(c in more for c in "&=?%/_.-"):
                break
            if text[end - 1] not in "-&?=%/_" and not any(c in more for c in "&=?%"):
                break
            end = at = stop
        yield Found(lo, lo + len(text[lo:end].rstrip(".,;:)")), 0.8)


def _mail_link(page: Page) -> Iterator[Found]:
    at = page.low.find("<mailto:")
    while at >= 0:
        end = at + 8
        while end < len(page.text) and page.text[end] != ">" and not page.text[end].isspace():
            end += 1
        if end > at + 8 and page.char(end) == ">":
            yield Found(at, end + 1, 0.8)
        at = page.low.find("<mailto:", at + 8)


# --- the registry -------------------------------------------------------------------------------

_MONTH_LEADS = frozenset(MONTHS)
#: In emission order: earlier detectors win exact ties between spans.
RULES: tuple[Detector, ...] = (
    Detector("ssn", "SocialSecurityNumber", _ssn),
    Detector("ssn plain", "SocialSecurityNumber", _ssn_plain),
    Detector("date m/d/yyyy", "Date", _number_date("mdy")),
    Detector("date m/d/yy", "Date", _number_date("mdyy")),
    Detector("date yyyy/m/d", "Date", _number_date("ymd")),
    Detector("date month d yyyy", "Date", _month_day, _MONTH_LEADS),
    Detector("date d month yyyy", "Date", _day_month, _MONTH_LEADS),
    Detector("phone", "PhoneNumber", _phone),
    Detector("phone plain", "PhoneNumber", _phone_plain),
    Detector("email", "EmailAddress", _email),
    Detector("street", "Address", _street),
    Detector("po box", "Address", _po_box, frozenset(["box"])),
    Detector("located at", "Address", _located),
    Detector("glued street", "Address", _glued),
    Detector("city line", "Address", _city_line),
    _labelled(LICENCE_LABELS, 0.9, _licence_value, "licence", "DriverLicense"),
    _labelled(("passport",), 0.9, _passport_value, "passport", "PassportNumber"),
    Detector("card", "FinancialAccount", _card),
    _labelled(ACCOUNT_LABELS, 0.85, _account_value, "account", "FinancialAccount"),
    Detector("vin", "VehicleIdentifier", _vin),
    _labelled(PLATE_LABELS, 0.85, _plate_value, "plate", "VehicleIdentifier", lambda page, at: wrap(page.text, at)),
    _labelled(JUSTICE_LABELS, 0.85, _justice_value, "justice id", "CriminalJusticeIdentifier", _after_justice),
    _labelled(("badge",), 0.8, _badge_value, "badge", "CriminalJusticeIdentifier", _after_badge),
    _labelled(BIRTHPLACE_LABELS, 0.8, _birthplace_value, "birth place", "PlaceOfBirth", _only_mark),
    _labelled(MAIDEN_LABELS, 0.85, _maiden_value, "maiden name", "MaidenName", _only_mark),
    Detector("ipv4", "IpAddress", _ipv4),
)
HANDLE_RULES: tuple[Detector, ...] = (
    Detector("handle labelled", "OnlineHandle", _handle_labelled, HANDLE_LEADS),
    Detector("handle export account", "OnlineHandle", _handle_export, HANDLE_LEADS),
    Detector("handle account", "OnlineHandle", _handle_account, HANDLE_LEADS),
    Detector("handle export line", "OnlineHandle", _handle_line),
    Detector("handle shape", "OnlineHandle", _handle_shape),
)
LINK_RULES: tuple[Detector, ...] = (Detector("link", "WebAddress", _link), Detector("mail link", "WebAddress", _mail_link))
#: All rules but names, which umbra.operators.names adds; see ``findings.BUILT_IN``.
PATTERN_RULES = RULES + HANDLE_RULES + LINK_RULES
#: Places in the emission order of what doesn't come from a list of detectors.
TERM_SEQ, FORM_SEQ, PASS2_SEQ = 10_000, 20_000, 30_000


def term_detectors(terms: Iterable[str]) -> list[Detector]:
    """A detector for each of a user's terms that isn't blank."""

    def finder(pattern: str) -> Callable[[Page], Iterator[Found]]:
        compiled = re.compile(pattern)
        return lambda page: (Found(m.start(), m.end(), 1.0) for m in compiled.finditer(page.text))

    return [Detector(f"term {i}", "CustomTerm", finder(T.term_pattern(t))) for i, t in enumerate(terms) if t and t.strip()]


class Scanner:
    """What a list of detectors and terms finds on a page: tuples (start, length, category, confidence, rule, seq, text)."""

    def __init__(self, detectors: Sequence[Detector], terms: Iterable[str] = ()) -> None:
        self.ranked = [*enumerate(detectors), *enumerate(term_detectors(terms), TERM_SEQ)]
        self.wanted = frozenset(w for _, d in self.ranked for w in d.leads)

    def __call__(self, text: str | None) -> list[tuple]:
        if not text:
            return []
        page = Page(text, self.wanted)
        out, handles = [], set()
        for seq, d in self.ranked:
            for lo, hi, sure, *other in d.find(page):
                category, rule = (other + [None, None])[:2]
                if d.category == "OnlineHandle":  # of the rules that find the same token the first keeps it
                    if (lo, hi) in handles:
                        continue
                    handles.add((lo, hi))
                out.append((lo, hi - lo, category or d.category, float(sure), rule or d.name, seq, text[lo:hi]))
        return out


FIELDS = ("start", "length", "category", "confidence", "rule", "seq", "text")


def spans_of(scanner: Callable[[str | None], list[tuple]], spark: SparkSession) -> Callable[[Column | str], Column]:
    """A column function that gives the spans a scanner finds in a text; Arrow-batched, one pass for all its detectors."""
    python_ready(spark)

    @F.pandas_udf(SPANS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(FIELDS, s, strict=True)) for s in scanner(t)] for t in texts])

    return found


def detect_rules(pages: DataFrame, terms: Iterable[str] = (), detectors: Sequence[Detector] = PATTERN_RULES, only: set[str] | None = None) -> DataFrame:
    """``pages`` with ``spans``, the array of what detectors and the user's terms find on each page.

    ``only`` limits the detectors to some names. Null and empty texts have no spans; no match crosses a page.
    """
    wanted = [d for d in detectors if only is None or d.name in only]
    return pages.withColumn("spans", spans_of(Scanner(wanted, list(terms)), pages.sparkSession)("text"))
