"""Labelled examples, corpus statistics and calibration for the two neighbour classifiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions.staging import written
from umbra.llm.common import is_held_out, python_ready


def examples(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict]:
    """At most ``most`` labelled documents (id, y, text), half of them of each class, and the labelled rows of each class.

    Only rows outside the held-out fifth are looked at. The rows with the smallest hashes of their ids
    are taken, so the choice doesn't depend on partitions. The rows are written to the shared folder.
    """
    python_ready(docs.sparkSession)
    usable = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["n"] for r in usable.groupBy("y").agg(F.count("*").alias("n")).collect()}
    parts = [usable.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most // 2) for y in (0, 1)]
    # at most `most` ids of 8 bytes: the bound is the parameter
    picked = F.broadcast(parts[0].unionByName(parts[1]))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(picked, "id")
    return written(rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))), counts


def class_frequencies(rows: DataFrame, terms: Callable[[str], Counter]) -> DataFrame:
    """(term, n0, n1): how many examples of either class hold a term."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for y, text in zip(batch["y"], batch["text"], strict=True):
                seen[y].update(terms(text).keys())
            names = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"term": names, "n0": [seen[0][t] for t in names], "n1": [seen[1][t] for t in names]})

    found = rows.select("y", "text").mapInPandas(count, "term string, n0 long, n1 long")
    return found.groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def term_counts(rows: DataFrame, known: KnownTerms) -> list[tuple[int, dict[int, int], int]]:
    """(label, counts of the known terms, id) of the examples, in an order that depends on their texts alone but for equal texts."""
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [shared.value.counts(x) for x in batch["text"]]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "t": [list(b) for b in bags], "n": [list(b.values()) for b in bags]})

    found = rows.select(F.col("id").cast("string").alias("id"), "y", "text").mapInPandas(count, "id string, y int, t array<int>, n array<int>").toLocalIterator()
    out = [(r["y"], dict(sorted(zip(r["t"], r["n"], strict=True))), r["id"]) for r in found]
    return sorted(out, key=lambda p: (list(p[1].items()), p[0], p[2]))


class KnownTerms:
    """Counts of the terms of a vocabulary in a text.

    What each token stands for is kept, up to a bound, as the number of a group of terms; a text's
    tokens are counted by group, and there are few of these.
    """

    #: Tokens that are remembered, and how long these may be; others are looked up each time.
    KEPT, SHORT = 200_000, 64

    def __init__(self, vocabulary: list[str], tokens: Callable[[str], list[str]], parts: Callable[[str], list[str]], extras: Callable[[list, Counter], dict] | None = None) -> None:
        self.ids = {t: i for i, t in enumerate(vocabulary)}
        self.tokens, self.parts, self.extras = tokens, parts, extras
        self._forget()

    def _forget(self) -> None:
        self.groups: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.kept = _Kept(self)

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("ids", "tokens", "parts", "extras")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def group(self, token: str) -> int:
        own = tuple(i for t in self.parts(token) if (i := self.ids.get(t)) is not None)
        if own not in self.numbers:
            self.numbers[own] = len(self.groups)
            self.groups.append(own)
        return self.numbers[own]

    def counts(self, text: str | None) -> dict[int, int]:
        tokens = self.tokens(text) if text else []
        if len(self.kept) > self.KEPT:
            self._forget()
        out: dict[int, int] = {}
        for number, n in Counter(map(self.kept.__getitem__, tokens)).items():
            for i in self.groups[number]:
                out[i] = out.get(i, 0) + n
        if self.extras:
            for t, n in self.extras(tokens, Counter(tokens)).items():
                if t in self.ids:
                    out[self.ids[t]] = n
        return out


    def present(self, text: str | None) -> list[int] | np.ndarray:
        """The numbers of the terms that a text holds."""
        return list(self.counts(text))


class KnownWords(KnownTerms):
    """The same where terms are the words themselves: whole arrays instead of dictionaries."""

    def arrays(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and counts of a text's terms, by number."""
        words = self.tokens(text) if text else []
        ids = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        ids.sort()
        ids = ids[np.searchsorted(ids, 0) :]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
        return ids[first], np.diff(first, append=len(ids))

    def counts(self, text: str | None) -> dict[int, int]:
        ids, n = self.arrays(text)
        return dict(zip(ids.tolist(), n.tolist(), strict=True))

    def present(self, text: str | None) -> np.ndarray:
        """Without an order; -1 if there are words that are no terms."""
        words = set(self.tokens(text)) if text else ()
        return np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))


class _Kept(dict):
    """Group numbers by token; a new token is looked up once."""

    def __init__(self, terms: KnownTerms) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, token: str) -> int:
        number = self.terms.group(token)
        if len(token) <= KnownTerms.SHORT:
            self[token] = number
        return number


def document_frequencies(docs: DataFrame, known: KnownTerms) -> tuple[int, np.ndarray]:
    """Number of documents, and of documents that hold each term, over the whole corpus.

    Every task counts for itself; at most one row for each term and task is shuffled.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = shared.value
        total, seen = 0, np.zeros(len(terms.ids) + 1, dtype=np.int64)  # the last is for words that are no terms
        for batch in batches:
            for text in batch["text"]:
                total += 1
                seen[terms.present(text)] += 1
        held = np.flatnonzero(seen[:-1])
        yield pd.DataFrame({"t": np.append(held, -1), "n": np.append(seen[held], total)})

    rows = docs.select("text").mapInPandas(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(known.ids)), 0
    for r in rows:
        if r["t"] < 0:
            total = r["n"]
        else:
            out[r["t"]] = r["n"]
    return total, out


def class_weights(y: np.ndarray, counts: dict) -> np.ndarray:
    """Weight of an example of class 0 and 1, so that the balanced sample votes like all labelled rows."""
    have = np.bincount(np.asarray(y, dtype=np.int64), minlength=2)
    return np.array([counts.get(y, 0) / max(1, have[y]) for y in (0, 1)])


def isotonic(raw: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing steps from raw votes to probabilities (pool adjacent violators)."""
    order = np.argsort(raw, kind="stable")
    merged: list[list[float]] = []  # smallest raw vote, weight, weighted sum of labels
    for x, t, v in zip(raw[order], y[order], w[order], strict=True):
        if merged and merged[-1][0] == x:
            merged[-1][1] += v
            merged[-1][2] += v * t
        else:
            merged.append([x, v, v * t])
        while len(merged) > 1 and merged[-2][2] * merged[-1][1] >= merged[-1][2] * merged[-2][1] and merged[-2][0] != merged[-1][0]:
            _, v2, s2 = merged.pop()
            merged[-1][1] += v2
            merged[-1][2] += s2
    total, positive = w.sum(), (w * y).sum()
    prior = positive / total if total else 0.5
    # one pseudo-example at the prior keeps the steps off 0 and 1
    unit = total / max(1, len(raw))
    xs = np.array([m[0] for m in merged])
    ps = np.array([(m[2] + unit * prior) / (m[1] + unit) for m in merged])
    return xs, np.maximum.accumulate(ps) if len(ps) else ps


def calibrated(raw: np.ndarray, steps: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Probabilities of raw votes, linear between steps so that the order of votes survives."""
    xs, ps = steps
    return np.interp(raw, xs, ps) if len(xs) else np.full(len(raw), 0.5)
