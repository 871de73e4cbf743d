"""Reading a page: places are indexes into its text, and each step takes one and returns the next."""

from __future__ import annotations

import re
from collections.abc import Iterable

_DIGITS = re.compile(r"[0-9]+")
_WORDS = re.compile(r"[a-z]+")
#: How far before a value any rule looks for a label.
FAR = 60


def lowered(text: str) -> str:
    """Lower case with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def phrases(items: Iterable[str], after: str = r"(?![a-z])") -> re.Pattern:
    """Any of some lower-case phrases, the longest that fits; a blank in one stands for white space."""
    longest = sorted(set(items), key=len, reverse=True)
    return re.compile(r"(?<![a-z0-9_])(?:" + "|".join(r"\s+".join(map(re.escape, p.split(" "))) for p in longest) + ")" + after)


def first_words(items: Iterable[str]) -> set[str]:
    return {_WORDS.search(p)[0] for p in items}


class Page:
    """One page's text, its runs of digits, and where the words stand that begin a label."""

    __slots__ = ("text", "low", "numbers", "marks")

    def __init__(self, text: str, wanted: frozenset[str] = frozenset()) -> None:
        self.text, self.low = text, lowered(text)
        self.numbers = [m.span() for m in _DIGITS.finditer(text)]
        self.marks: dict[str, list[int]] = {}
        if wanted:
            for m in _WORDS.finditer(self.low):
                if m[0] in wanted:
                    self.marks.setdefault(m[0], []).append(m.start())

    def char(self, at: int) -> str:
        """The character at a place; nothing beyond the ends."""
        return self.text[at] if 0 <= at < len(self.text) else ""

    def gap(self, i: int) -> str:
        """What parts a run of digits from the next; a form feed, which no rule allows, after the last."""
        return self.text[self.numbers[i][1] : self.numbers[i + 1][0]] if i + 1 < len(self.numbers) else "\f"

    def size(self, i: int) -> int:
        """The length of a run of digits; 0 beyond the last."""
        return self.numbers[i][1] - self.numbers[i][0] if i < len(self.numbers) else 0

    def digits(self, i: int) -> str:
        lo, hi = self.numbers[i] if i < len(self.numbers) else (0, 0)
        return self.text[lo:hi]

    def said_before(self, at: int, label: re.Pattern, window: int) -> bool:
        """Whether a label stands in the ``window`` characters before a place; the cut counts as a word's edge."""
        return label.search(self.low[max(0, at - window) : at]) is not None

    def labels(self, leads: Iterable[str], label: re.Pattern) -> list[tuple[int, int]]:
        """(start, end) of the labels of one kind, in page order and apart from each other."""
        out: list[tuple[int, int]] = []
        for at in sorted(p for w in leads for p in self.marks.get(w, ())):
            found = label.match(self.low, at)
            if found and (not out or at >= out[-1][1]):
                out.append(found.span())
        return out


def over(text: str, at: int, allowed: str, most: int = 1 << 30) -> int:
    end = min(len(text), at + most)
    while at < end and text[at] in allowed:
        at += 1
    return at


def blanks(text: str, at: int) -> int:
    return over(text, at, " \t")


def wrap(text: str, at: int) -> int:
    """Past blanks and at most one line break."""
    at = blanks(text, at)
    if text.startswith("\r\n", at):
        return blanks(text, at + 2)
    return blanks(text, at + 1) if text.startswith("\n", at) else at


def spaces(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def alnum(c: str) -> bool:
    """An ASCII letter or digit."""
    return c.isascii() and c.isalnum()


def run_of(text: str, at: int, also: str = "", most: int = 64) -> int:
    """The end of the stretch of ASCII letters, digits and some other signs."""
    end = min(len(text), at + most)
    while at < end and (alnum(text[at]) or text[at] in also):
        at += 1
    return at


def solid_end(text: str, at: int, also: str, most: int, least: int) -> int:
    """The end of the longest stretch of letters, digits and other signs that ends a word, or -1."""
    end = run_of(text, at, also, most)
    while end - at >= least:
        if alnum(text[end - 1]) and not (end < len(text) and alnum(text[end])):
            return end
        end -= 1
    return -1


def trim(text: str, lo: int, hi: int) -> tuple[int, int]:
    """A stretch without leading blanks, colons, number signs and dashes and without trailing blanks and marks."""
    while lo < hi and (text[lo].isspace() or text[lo] in ":#-"):
        lo += 1
    while lo < hi and (text[hi - 1].isspace() or text[hi - 1] in ",.;:"):
        hi -= 1
    return lo, hi


def digit_run(value: str) -> tuple[int, int]:
    """The first run of blank-separated tokens that hold a digit; (0, 0) if there is none."""
    lo, at = -1, 0
    for token in value.split(" "):
        has = any(c.isdigit() for c in token)
        if lo < 0 and has:
            lo = at
        elif lo >= 0 and not has:
            return lo, at - 1
        at += len(token) + 1
    return (lo, len(value)) if lo >= 0 else (0, 0)


def count(value: str, kind: str) -> int:
    """How many decimal digits or letters."""
    return sum(c.isdecimal() for c in value) if kind == "digits" else sum(c.isalpha() for c in value)


def luhn(digits: str) -> bool:
    """Luhn's check of ASCII digits; false for an empty text."""
    if not (digits.isascii() and digits.isdigit()):
        return False
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
