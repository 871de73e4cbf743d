"""PII: overlapping candidates from generous patterns, boosted trees and calibrated thresholds; SQL expressions throughout."""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.boosting import BoostedTrees, threshold
from umbra.llm.common import local_table, table

#: The kinds of base spans, then what only the trees find.
KINDS = ("email", "ip", "card", "phone", "secret")
EMAIL, IP, CARD, PHONE, SECRET = range(5)

# Possessive and guarded forms of the wanted patterns: the same matches, without backtracking over long runs.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before the pattern is tried.
BASE_GATE = {EMAIL: r"@[A-Za-z0-9-]", IP: r"[0-9]\.[0-9]", CARD: r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", PHONE: r"\+[0-9]"}

_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_AT = r"(?:\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?|\x20@\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|\.)\x20?[\])}]\x20?|\x20dot\x20|\.)"
#: Generous patterns: written-out addresses, defanged or version 6 addresses, chains of digits, numbers of the usual
#: grouping inside such chains (a base match that runs on into the next number fails as a whole), keys and tokens.
WIDE = {
    "mail": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "mail in words": rf"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20at\x20[A-Za-z0-9-]++(?:(?:\x20dot\x20|\.)[A-Za-z0-9-]++)++",
    "address": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}(?:\x20?[\[(]\x20?(?:\.|dot)\x20?[\])]\x20?[0-9]{1,3}){3}|[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7})(?![0-9A-Za-z:])",
    "digits": r"(?<![0-9A-Za-z+])(?<![0-9][\x20().\x2D/_])\(?[0-9](?:[\x20().\x2D/_]{0,3}[0-9]){6,}+",
    "card in a chain": r"(?<![0-9A-Za-z])(?:[0-9]{13,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9A-Za-z])",
    "phone in a chain": r"\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}|(?:[\x20.-][0-9]{2,4}){2,4})(?![0-9])",
    "key": r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]{0,60}[0-9])(?=[0-9+/_.-]{0,60}[A-Za-z])[A-Za-z0-9+/_.-]{8,}+=*",
}
WIDE_GATE = {
    "mail": r"(?i)[\[({]\x20?(?:at|@)\x20?[\])}]|\x20@\x20",
    "mail in words": r"(?i)\x20at\x20[A-Za-z0-9-]++(?:\.[A-Za-z0-9]|\x20dot\x20)",
    "address": r"[0-9]\x20?[\[(]\x20?(?:\.|dot)|[0-9A-Fa-f]:{1,2}[0-9A-Fa-f]{1,4}:",
    "digits": r"[0-9][\x20().\x2D/_]{0,3}[0-9][\x20().\x2D/_]{0,3}[0-9][\x20().\x2D/_]{0,3}[0-9]",
    "card in a chain": r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}",
    "phone in a chain": r"\+[0-9]",
    "key": r"(?i)(?:token|secret|passw|pwd|key|auth|credential|bearer|kennwort|passwort|contrase|mot\x20de\x20passe)|[0-9A-Fa-f]{32}",
}
WIDE_KINDS = {"mail": (EMAIL,), "mail in words": (EMAIL,), "address": (IP,), "digits": (CARD, PHONE), "card in a chain": (CARD,), "phone in a chain": (PHONE,), "key": (SECRET,)}

#: Words before a candidate that speak for a kind, and words that speak for other numbers.
CONTEXT = (
    r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel)",
    r"(?i)(?:\bip\b|host|server|address|login|client|peer)",
    r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta)",
    r"(?i)(?:phone|tel\b|tel\.|call|mobile|cell|fax|whatsapp|telefon|t[eé]l[eé]fono|t[eé]l[eé]phone|handy|m[oó]vil|ring)",
    r"(?i)(?:token|secret|passw(?:or[dt]|d)?|pwd|key|auth|credentials?|bearer|kennwort|passwort|contrase[nñ]a|mot\x20de\x20passe)[A-Za-z]{0,4}[\"']?\x20{0,3}(?:[:=]|is|ist|es|est)?\x20{0,3}[\"']?$",
    r"(?i)(?:order|invoice|isbn|issn|version|item|serial|part|page|ref|ticket|date|section|lines?|rows?|id|no\.|nr\.|\#|total|sum|score)",
)
FEATURES = ("digits", "groups", "luhn", "opens", "marks", "longest", "issuer", "year", "shape", "brackets", "domain", "letters", "hex", "words", *(f"context{i}" for i in range(len(CONTEXT))), "kind")
SPAN = "array<struct<start:int,end:int,kind:int>>"
CANDIDATE = "array<struct<start:int,end:int,kind:int,f:array<double>>>"
#: Precision that a kind's threshold must reach on the calibration half.
PRECISION = 0.98


def _pieces(text: Column, pattern: str, gate: str) -> Column:
    """(text before, match) pairs in order; the lambda sees no outer column, so nothing is computed again for each match."""
    some = F.when(text.rlike(gate), text).otherwise("")
    found = F.regexp_extract_all(some, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(some, pattern, -1), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))


#: Items that are walked in one go; a walk's cost grows with the square of this, and only in proportion to a text.
STEP = 256


def _with(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _walk(items: Column, zero: Column, kind: str, step) -> Column:  # noqa: ANN001
    """Walk an array with a state; ``step(state, item)`` gives the new state and an array to put out: a struct (state, out).

    What is put out is copied whenever it grows, so it is gathered for some items at a time and joined at the end.
    """
    chunks = lambda all_: F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / STEP).cast("int")), lambda i: F.slice(all_, i * STEP + 1, F.lit(STEP)))
    inner = lambda acc, x: _with(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"].cast(kind)).alias("out")))
    outer = lambda acc, chunk: _with(
        F.aggregate(chunk, F.struct(acc["state"].alias("state"), F.array().cast(kind).alias("out")), inner),
        lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")),
    )
    done = lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out"))
    return F.aggregate(_with(items, chunks), F.struct(zero.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), outer, done)


def _fold(text: Column, pattern: str, gate: str, kind: str, make) -> Column:  # noqa: ANN001
    """Walk the matches, adding up lengths in code points; ``make`` gives an array to append for a match."""

    def step(at: Column, x: Column) -> Column:
        start = at + F.coalesce(F.char_length(x["p"]), F.lit(0))
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        return F.struct(end.alias("state"), F.when(x["m"].isNull(), F.array().cast(kind)).otherwise(make(x, start, end).cast(kind)).alias("out"))

    return _walk(_pieces(text, pattern, gate), F.lit(0), kind, step)["out"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The wanted spans of a text, by start and then kind."""
    good = {
        EMAIL: lambda m: F.lit(True),
        IP: lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        CARD: lambda m: F.char_length(_digits(m)).between(12, 19) & F.call_function("luhn_check", _digits(m)),
        PHONE: lambda m: F.char_length(_digits(m)).between(9, 15),
    }

    def of(kind: int) -> Column:
        def make(x: Column, start: Column, end: Column) -> Column:
            span = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))
            return F.when(good[kind](x["m"]), F.array(span)).otherwise(F.array().cast(SPAN))

        return _fold(text, BASE[kind], BASE_GATE[kind], SPAN, make)

    return _by_start(F.concat(*[of(k) for k in range(4)]))


def _by_start(spans: Column) -> Column:
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )


def _features(m: Column, before: Column, digits: Column) -> Column:
    """The features of a match but for its kind."""
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    # "555-0147" has runs 3-4; a match without digits has none
    shape = lambda groups: F.array_join(F.transform(groups, lambda r: F.char_length(r).cast("string")), "-")
    shapes = lambda s: F.when(s.isin("3-3-4", "1-3-3-4", "3-4-4", "2-2-2-2-2", "3-3-3", "2-4-4"), 1.0).when(s.isin("4-4-4-4", "4-6-5"), 2.0).when(s.isin("4-2-2", "2-2-4", "4-2-2-2-2-2", "4-2-2-2-2"), 3.0).otherwise(0.0)
    return _with(
        F.filter(F.split(m, "[^0-9]+"), lambda r: r != ""),
        lambda runs: F.array(
            F.char_length(digits).cast("double"),
            F.size(runs).cast("double"),
            flag(F.call_function("luhn_check", digits)),
            F.when(m.startswith("("), 2.0).when(digits.startswith("00"), 1.0).otherwise(0.0),
            F.size(F.array_distinct(F.filter(F.split(F.regexp_replace(m, "[0-9A-Za-z]", ""), ""), lambda c: c != ""))).cast("double"),
            F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0)).cast("double"),
            flag(digits.rlike("^(?:4|5[1-5]|3[47]|6(?:011|5)|2[2-7])")),
            flag(m.rlike("(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)")),
            shapes(shape(runs)),
            flag(m.rlike(r"[\[({]")),
            flag(m.rlike(r"(?i)[.\x20)\]](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$")),
            F.char_length(F.regexp_replace(m, "[^A-Za-z]", "")).cast("double"),
            flag(m.rlike("^[0-9A-Fa-f]+$")),
            flag(m.rlike("[/._-].*[/._-]|[A-Za-z]{9}")),
            *[flag(before.rlike(words)) for words in CONTEXT],
        ),
    )


MATCH = "array<struct<start:int,end:int,m:string,near:string,rule:int>>"


def candidates(text: Column) -> Column:
    """Generous, overlapping candidates with their features; chains of digits stand once as a card and once as a phone."""

    def of(rule: int, name: str) -> Column:
        def make(x: Column, start: Column, end: Column) -> Column:
            near = F.substring(F.coalesce(x["p"], F.lit("")), -32, 32)
            return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["m"].alias("m"), near.alias("near"), F.lit(rule).alias("rule")))

        return _fold(text, WIDE[name], WIDE_GATE[name], MATCH, make)

    def expand(c: Column) -> Column:
        def with_digits(digits: Column) -> Column:
            n = F.char_length(digits)
            fits = lambda k: F.when(k == CARD, n.between(12, 19)).when(k == PHONE, n.between(7, 15)).otherwise(True)
            kinds = F.filter(F.get(F.array(*[F.array(*map(F.lit, WIDE_KINDS[name])) for name in WIDE]), c["rule"]), fits)
            one = lambda f: F.transform(kinds, lambda k: F.struct(c["start"].alias("start"), c["end"].alias("end"), k.alias("kind"), F.concat(f, F.array(k.cast("double"))).alias("f")))
            return F.when(F.size(kinds) > 0, _with(_features(c["m"], c["near"], digits), one)).otherwise(F.array().cast(CANDIDATE))

        return _with(_digits(c["m"]), with_digits)

    return F.flatten(F.transform(F.concat(*[of(rule, name) for rule, name in enumerate(WIDE)]), expand))


def _number(rng: random.Random, groups: tuple) -> list[str]:
    return ["".join(rng.choice("0123456789") for _ in range(n)) for n in groups]


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def generated(n: int, seed: int) -> list[tuple]:
    """Labelled sentences made by rule: (text, start, end, kind) of a planted span, kind -1 where only look-alikes stand in the text."""
    rng = random.Random(seed)
    words = "anna ben carl dora emil finn gina hugo ida jan".split()
    hosts = "mail.example host.example example sample".split()
    ends = "com org net de fr io".split()
    lead = {
        EMAIL: ("write to ", "contact me: ", "e-mail ", "mail ", "reach me under ", "mein Kontakt: "),
        IP: ("server ", "host ", "from client ", "login from ip ", "address "),
        CARD: ("card ", "my visa ", "credit card number ", "paid with card no ", "carte "),
        PHONE: ("call ", "phone: ", "tel. ", "mobile ", "fax ", "ring me at ", "whatsapp "),
        SECRET: ('token = "', "api_key: ", "password is ", "secret=", "auth key ", "bearer ", "access token: ", "Passwort: "),
        -1: ("order ", "invoice no. ", "isbn ", "version ", "see page ", "date ", "total ", "we met ", "item ", "on ", "score ", "the ", "lines "),
    }
    plain = ("", "and ", "so we took ", "here is ", "it was ")
    out = []
    for i in range(n):
        kind = (EMAIL, IP, CARD, PHONE, SECRET, -1, -1, -1, -1, -1)[i % 10]
        if kind == EMAIL:
            at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."), (" (at) ", "."), (" @ ", ".")))
            value = f"{rng.choice(words)}{rng.choice(['', '.b', '7', '_x'])}{at}{rng.choice(hosts).replace('.', dot)}{dot}{rng.choice(ends)}"
        elif kind == IP:
            parts = [str(rng.randrange(1, 255)) for _ in range(4)]
            value = rng.choice(("[.]", "(.)", "[dot]", " [.] ")).join(parts) if rng.random() < 0.6 else ":".join(f"{rng.randrange(65536):x}" for _ in range(8))
        elif kind == CARD:
            digits = rng.choice(("4", "51", "37", "6011")) + "".join(rng.choice("0123456789") for _ in range(14))
            digits = digits[:15]
            digits += _luhn_digit(digits)
            value = rng.choice((".", "  ", "/", " - ", "_")).join(digits[j : j + 4] for j in range(0, 16, 4))
            if i % 3 == 0:  # a number of another kind runs into it
                value = rng.choice((digits, " ".join(digits[j : j + 4] for j in range(0, 16, 4))))
        elif kind == SECRET:
            value = rng.choice((
                "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40, 64)))), "sk_" + "".join(rng.choice(LETTERS) for _ in range(24)) + str(rng.randrange(100)),
                "".join(rng.choice(LETTERS) for _ in range(6)) + str(rng.randrange(1000)) + "".join(rng.choice(LETTERS) for _ in range(5)),
            ))
        elif kind == PHONE:
            a, b, c = _number(rng, (3, 3, 4))
            if i % 3 == 0:
                value = f"+{rng.choice(('1', '49', '44'))} ({a}) {b}-{c}"
            else:
                value = rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0049 {a} {b}{c}", f"1-{a}-{b}-{c}", f"0{a[1:]}/{b}{c}"))
        else:
            a, b, c, d = _number(rng, (4, 4, 4, 4))
            odd = "".join(rng.choice("123456789") for _ in range(15))
            odd += str((int(_luhn_digit(odd)) + rng.randrange(1, 10)) % 10)
            day = f"{rng.randrange(1, 29):02d}"
            month = f"{rng.randrange(1, 13):02d}"
            year = str(rng.randrange(1950, 2040))
            value = rng.choice((
                f"{year}-{month}-{day} {day}:{month}", f"{day}.{month}.{year}", f"{year}{month}{day}", f"{year}-{month}-{day}", f"{a}{b}", f"{a}{b}{c}{d}",
                f"978-{a[:1]}-{b}-{c}-{d[:1]}", f"{a[:2]}.{b[:1]}.{c[:2]} and {d}", f"{a[:2]} {b[:2]} {c[:2]} {d[:2]}", f"{a[:3]} {b[:3]} {c[:3]}", f"{year}/{a}/{b[:2]}",
                f"{a}-{b}-{c[:2]}", f"{day}:{month}:{day}:{month}", "we met at dawn. then left", "looked at home.page of all", f"{a} {b} {c} {d}", f"{a}/{b}/{c}",
                f"{a[:1]}.{b}{c}{d}", f"{a[:2]}.{b}{c[:2]}", f"{a[:1]}.{b[:3]}.{c[:3]}.{d[:3]}", f"{a[:3]}.{b}{c[:1]}", f"0.{b}{c}", f"{a}.{b}{c[:3]}",
                odd, odd, "report_2024_final", f"release-{year}.{month}", f"www.page{a}.example/{b}", f"keyboard{a[:2]}layout", f"monkey-{a}-tokens", f"file{a}.tar.gz",
            ))
        opening = rng.choice(lead[kind]) if rng.random() < 0.8 else rng.choice(plain)
        before = f"{rng.choice(words)} said {opening}"
        after = rng.choice((".", " please", ", thanks", ""))
        if i % 3 == 0 and kind in (CARD, PHONE):
            if kind == CARD and rng.random() < 0.5:
                before += f"{_number(rng, (16,))[0]} "
            else:
                after = f" {_number(rng, (12,))[0]} {after}"
        out.append((before + value + after, len(before), len(before) + len(value), kind))
    return out


#: Sentences written by hand, not by the rules above, that the thresholds are set on: ``<kind|value>`` marks what must be found.
WRITTEN = (
    "Reach Maria under <email|maria.lopez [at] uni-example [dot] es> before noon, or <email|office(at)example(dot)org>.",
    "My address is <email|jon_smith at example dot net>, thanks. We looked at dot plots at noon.",
    "Mail goes to <email|billing @ shop.example.com> and nowhere else. Meet me at example hall. Then dot the i.",
    "Der Server steht unter <ip|192[.]168[.]0[.]12>, der andere unter <ip|10(.)2(.)44(.)9>.",
    "Login from <ip|2001:db8:85a3:0:0:8a2e:370:7334> was refused at 12:30:45, twice.",
    "The clock showed 10:11:12 and then 09:30:00:15 in the log of 2021-05-06.",
    "Please charge card <card|4111.1111.1111.1111>, or the visa <card|4012 8888  8888 1881>.",
    "He pays with <card|4929 1234 5678 9015> 4417123456789010 these days.",
    "numbers 7536784127813050 <card|4845168114407329> and nothing more",
    "Bestellung 4929123456789011 vom 03.04.2022, Artikel 1234-5678-9012, Seite 17.",
    "serial 1234567890123456, batch 0000 1111 2222 3333 and 99 88 77 66",
    "Ring <phone|(212) 555-0147> or <phone|212-555-0188> after six; tel. <phone|0049 30 1234567> works too.",
    "Téléphone: <phone|01 44 55 66 77>, bureau 12, étage 3, le 12.05.2020.",
    "Call <phone|+1 (487) 555-7209> 47369625730995 now",
    "the office <phone|+44 (020) 555-0123> 190.12.3.4 is closed",
    "isbn 978-3-16-148410-0, version 2.13.0.1, ratio 3.14159265, pages 100-200-300",
    "on 2021-03-04 and 2021-03-05 we sold 1200 200 300 items for 12.000.000 in total",
    'token = "<secret|04dbebab91ab85687d33eeaaf9ac699e1188f962>" is set',
    "api_key: <secret|AKzq81LmPa09xWvT4bRr> must not be shown, password is <secret|hunter2ForEver>",
    "export SECRET=<secret|9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08>",
    "Das Passwort: <secret|Sommer2019xY> bitte sofort ändern.",
    "the keyboard2000 and the key point of 2019, a token of thanks to 300 authors",
    "see report_2024_final.pdf, release-2021.03 and http://example.org/a1b2c3d4e5f6/page7",
    "commit notes in file0042.tar.gz, the monkey-12-islands level and authors-2020-list",
    "id 550e8400-e29b-41d4-a716-446655440000 in the table rows 17 to 29",
)
_MARK = re.compile(r"<([a-z]+)\|([^>]*)>")


def written_cases() -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(text, marked spans (start, end, kind)) of WRITTEN."""
    out = []
    for line in WRITTEN:
        text, at, spans = "", 0, []
        for m in _MARK.finditer(line):
            text += line[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), KINDS.index(m[1])))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out


@cache
def _fitted(examples: int, seed: int, key: int) -> tuple[BoostedTrees, dict[int, float]]:
    spark = SparkSession.getActiveSession()
    made = [(text, [(lo, hi, kind)]) for text, lo, hi, kind in generated(examples, seed)]
    cases = [*made, *written_cases()]
    texts = local_table(spark, [(i, text) for i, (text, _) in enumerate(cases)], "case int, text string")
    rows = sorted(texts.select("case", F.explode(candidates(F.col("text"))).alias("c")).select("case", "c.*").collect(), key=lambda r: r["case"])
    x = np.array([r["f"] for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    near = lambda r, s: r["kind"] == s[2] and abs(r["start"] - s[0]) <= 2 and abs(r["end"] - s[1]) <= 2
    y = np.array([any(near(r, s) for s in cases[r["case"]][1]) for r in rows], dtype=float)
    kind, by_hand = np.array([r["kind"] for r in rows]), np.array([r["case"] >= len(made) for r in rows])
    trees = BoostedTrees().fit(x[~by_hand], y[~by_hand])
    p = trees.probability(x)
    return trees, {k: threshold(p[by_hand & (kind == k)], y[by_hand & (kind == k)], PRECISION) for k in range(len(KINDS))}


def fit(spark: SparkSession, examples: int = 800, seed: int = 5) -> tuple[BoostedTrees, dict[int, float]]:
    """Trees from sentences made by rule, bounded by ``examples``; thresholds from sentences written by hand, and at least 0.5."""
    return _fitted(examples, seed, id(spark))


def find_pii(docs: DataFrame, model: tuple[BoostedTrees, dict[int, float]] | None = None) -> DataFrame:
    """Personal data in every whole text.

    Base spans are what the fixed patterns and their tests accept; they always stay. Generous patterns
    propose more spans, the trees score each by its format and the words before it, and those at or
    over their kind's threshold are added where they overlap no base span; of overlapping additions
    the likelier stays (then the earlier, longer, first kind). Offsets are code points, ends exclusive.

    Columns: ``doc`` (the input row as a struct), ``base`` and ``spans``, arrays of (start, end, kind,
    score) by start and kind; base spans have score 1.

    Defined cases: null and empty texts have no spans; repeated rows stay repeated; column names can't
    clash; an empty table gives an empty result.
    """
    trees, least = model or fit(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.select("doc", base_spans(F.col("_text")).alias("_base"), candidates(F.col("_text")).alias("_wide"))

    def scored(c: Column) -> Column:
        return F.struct(trees.column(c["f"]).alias("score"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))

    limit = lambda kind: F.element_at(F.array(*[F.lit(least[k]) for k in range(len(KINDS))]), kind + 1)
    good = F.filter(F.transform("_wide", scored), lambda c: c["score"] >= limit(c["kind"]))
    # by start, base spans first among equals; of equal additions the likelier, longer, first kind
    row = lambda s, score, base: F.struct(s["start"].alias("start"), base.alias("added"), (-score).alias("a"), (-s["end"]).alias("b"), s["kind"].alias("kind"))
    together = F.array_sort(F.concat(F.transform("_base", lambda s: row(s, F.lit(1.0), F.lit(0))), F.transform(good, lambda c: row(c, c["score"], F.lit(1)))))
    kind = "array<struct<start:int,end:int,kind:int,score:double>>"
    span = lambda x: F.struct(x["start"].alias("start"), (-x["b"]).alias("end"), x["kind"].alias("kind"), (-x["a"]).alias("score"))
    nothing = F.array().cast(kind)

    def step(state: Column, x: Column) -> Column:
        last, here = F.get(state["last"], F.lit(0)), F.array(span(x))
        free = last.isNull() | (last["end"] <= x["start"])
        better = (-x["a"]) > last["score"]
        taken = F.when(x["added"] == 0, F.when(free, state["last"]).otherwise(nothing)).when(x["start"] < state["base"], state["last"]).when(free | better, here).otherwise(state["last"])
        gone = (x["added"] == 1) & (x["start"] >= state["base"]) & free
        out = F.when(x["added"] == 0, here).when(gone, state["last"]).otherwise(nothing)
        base = F.when(x["added"] == 0, F.greatest(state["base"], -x["b"])).otherwise(state["base"])
        return F.struct(F.struct(base.alias("base"), taken.alias("last")).alias("state"), out.alias("out"))

    walked = _walk(together, F.struct(F.lit(0).alias("base"), nothing.alias("last")), kind, step)
    kept = _with(walked, lambda w: F.concat(w["out"], w["state"]["last"]))
    empty = nothing
    named = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["score"].alias("score")))),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _name(s["kind"]).alias("kind"), s["score"].alias("score")),
    )
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), _name(s["kind"]).alias("kind"), F.lit(1.0).alias("score")))
    return rows.select("doc", base.alias("base"), F.when(F.size("_wide") > 0, named(kept)).otherwise(F.coalesce(base, empty.cast("array<struct<start:int,end:int,kind:string,score:double>>"))).alias("spans"))


def _name(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), kind + 1)


def redact(found: DataFrame) -> DataFrame:
    """``doc``, ``spans`` and ``redacted``: each stretch covered by spans becomes [KIND] of its first span."""
    text = F.col("doc.text")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"),
            s["end"].alias("at"),
        )
        grown = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when((s["start"] < acc["at"]) & (acc["at"] > 0), grown).otherwise(fresh)

    end = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text)))
    return found.select("doc", "spans", F.aggregate("spans", zero, step, end).alias("redacted"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    more = [F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"), F.size("spans").cast("long").alias("n_found")]
    return found.select(
        F.col("doc.doc_id").alias("doc_id"), *[count(k) for k in KINDS[:4]], *more, F.sha2(_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans")
    )
