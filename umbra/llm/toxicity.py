"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine over a block-max index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import is_held_out, python_ready, table, words_of
from umbra.llm.labelled import KnownWords, calibrated, class_frequencies, class_weights, document_frequencies, examples, isotonic, term_counts

#: Labelled documents that are fitted on, half of each class.
MAX_EXAMPLES = 4000
#: The space holds every word of at least so many examples, whichever their class; the commonest where there are more words than the bound.
LEAST_DF, MAX_TERMS = 3, 100_000
NEIGHBOURS = 25
#: Examples of a block, and words whose lists are so long that they are kept as rows of a matrix.
BLOCK, LONG_LISTS = 64, 512
#: Blocks that are opened first.
FIRST_BLOCKS = 8
#: Parts that the examples are split into for calibration.
FOLDS = 4
#: Texts that are searched for at once, and those whose blocks are opened at once.
QUERIES, PART = 256, 32
#: More than rounding may add to a cosine.
SLACK = 1e-9


def parts_of(word: str) -> list[str]:
    """A word is one term."""
    return [word]


def terms_of(text: str | None) -> Counter:
    """Lower-case words of a whole text with their counts."""
    return Counter(words_of(text))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of some ranges, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vectors:
    """Sparse rows in three flat arrays."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.ptr = np.cumsum([0, *(len(i) for i, _ in rows)])
        self.ids = np.concatenate([i for i, _ in rows]).astype(np.int32) if rows else np.empty(0, dtype=np.int32)
        self.weights = np.concatenate([w for _, w in rows]).astype(float) if rows else np.empty(0)

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[self.ptr[i] : self.ptr[i + 1]], self.weights[self.ptr[i] : self.ptr[i + 1]]

    def take(self, rows: np.ndarray) -> Vectors:
        return Vectors([self.row(i) for i in rows])


class BlockMaxIndex:
    """Inverted index over example vectors in blocks, with each word's largest weight in each block.

    The longest lists are rows of a matrix, so what they add to each cosine comes from one product. The
    other words' block maxima are added to the best of that in each block, which bounds every cosine
    there. The blocks of the largest bounds are opened, then all others that can reach the k-th best of these.
    All of it is in double precision, and blocks are left out by more than its rounding: the result is exact.
    """

    def __init__(self, vectors: Vectors, n_terms: int, block: int = BLOCK, long_lists: int = LONG_LISTS) -> None:
        self.vectors, self.n, self.block, self.n_terms = vectors, len(vectors), block, n_terms
        self.n_blocks = -(-self.n // block)
        df = np.bincount(vectors.ids, minlength=n_terms)
        common = np.argsort(-df, kind="stable")[:long_lists]
        common = common[df[common] > 1]
        self.place = np.full(n_terms, -1, dtype=np.int32)
        self.place[common] = np.arange(len(common))
        owner = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(vectors.ptr))
        long = self.place[vectors.ids] >= 0
        self.matrix = np.zeros((len(common), self.n_blocks * block))
        self.matrix[self.place[vectors.ids[long]], owner[long]] = vectors.weights[long]
        ids, owner, weights = vectors.ids[~long], owner[~long], vectors.weights[~long]
        order = np.lexsort((owner, ids))
        ids, self.owner, self.weights = ids[order], owner[order], weights[order]
        # one entry for each word and block it stands in
        key = ids.astype(np.int64) * max(1, self.n_blocks) + self.owner // block
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        self.starts, self.sizes = first, np.diff(np.r_[first, len(key)])
        self.blocks = (self.owner[first] // block).astype(np.int32)
        self.maxima = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.entries = np.searchsorted(ids[first], np.arange(n_terms + 1))

    def nearest_many(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the numbers and cosines of the k nearest examples with a cosine over 0, nearest first, ties to the smaller number."""
        if not self.n or not queries:
            return [(np.empty(0, dtype=np.int64), np.empty(0))] * len(queries)
        rows = len(queries)
        ids, weights = (np.concatenate([q[i] for q in queries]) for i in (0, 1))
        of = np.repeat(np.arange(rows), [len(q[0]) for q in queries])
        place = self.place[ids]
        long = place >= 0
        dense = np.zeros((rows, len(self.matrix)))
        dense[of[long], place[long]] = weights[long]
        scores = dense @ self.matrix
        rare, row, factor = ids[~long], of[~long], weights[~long]
        least, parts = np.zeros((rows, 1)), range(0, rows, PART)
        for lo, (start, end) in zip(parts, np.searchsorted(row, [(lo, lo + PART) for lo in parts]), strict=True):
            least[lo : lo + PART] = self._open(scores[lo : lo + PART], rare[start:end], row[start:end] - lo, factor[start:end], k)
        at, near = np.divmod(np.flatnonzero(scores.ravel() >= np.repeat(np.maximum(least - SLACK, np.nextafter(0, 1)), scores.shape[1])), scores.shape[1])
        cosines = scores[at, near]
        order = np.lexsort((near, -np.round(cosines, 12), at))
        firsts = np.searchsorted(at, np.arange(rows + 1))
        order = order[np.arange(len(at)) - firsts[at] < k]  # ``at`` is in order before and after
        near, cosines = near[order], np.minimum(cosines[order], 1.0)
        ends = np.cumsum(np.minimum(np.diff(firsts), k))[:-1]
        return list(zip(np.split(near, ends), np.split(cosines, ends), strict=True))

    def _open(self, scores: np.ndarray, rare: np.ndarray, row: np.ndarray, factor: np.ndarray, k: int) -> np.ndarray:
        """Add the other words to the scores of all blocks that may matter; gives a cosine that each text's k-th best reaches."""
        rows, width, blocks = *scores.shape, self.n_blocks
        n = self.entries[rare + 1] - self.entries[rare]
        entry, row, factor = _ranges(self.entries[rare], n), np.repeat(row, n), np.repeat(factor, n)
        cell = row * blocks + self.blocks[entry]
        bounds = np.bincount(cell, factor * self.maxima[entry], minlength=rows * blocks).astype(float).reshape(rows, blocks)
        inside = scores.reshape(rows, blocks, self.block)
        bounds += inside.max(2) + SLACK
        best = np.argpartition(-bounds, min(FIRST_BLOCKS, blocks) - 1, axis=1)[:, :FIRST_BLOCKS]  # the best bounds' blocks are opened first
        opened, least = np.zeros((rows, blocks), dtype=bool), np.zeros((rows, 1))
        np.put_along_axis(opened, best, True, axis=1)
        for again in (False, True):
            if again and best.shape[1] * self.block >= k:
                least = np.partition(inside[np.arange(rows)[:, None], best].reshape(rows, -1), -k, axis=1)[:, -k, None]
            fresh = ~opened & (bounds > np.maximum(least - SLACK, SLACK)) if again else opened
            chosen = np.flatnonzero(fresh.ravel()[cell])
            mine = entry[chosen]
            sizes = self.sizes[mine]
            posting = _ranges(self.starts[mine], sizes)
            target = np.repeat(row[chosen] * width, sizes) + self.owner[posting]
            scores += np.bincount(target, np.repeat(factor[chosen], sizes) * self.weights[posting], minlength=rows * width).reshape(rows, width)
        return least


class ToxicityModel:
    """Term space, index, votes and their calibration; a plain object that is broadcast.

    A word weighs (1 + log of its count) x idf over all documents x how far the examples tie it to
    either class: the geometric mean of its absolute log odds ratio and that ratio's standard score.
    Words of both classes and of neither are in the space; the latter weigh little.
    """

    def __init__(self, examples: list, counts: dict, known: KnownWords, n_docs: int, df: np.ndarray, k: int = NEIGHBOURS) -> None:
        self.k, self.known, self.terms = k, known, list(known.ids)
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1
        self.y = np.array([y for y, *_ in examples], dtype=float)
        self.ids = [i for *_, i in examples]
        raw = Vectors([self.raw(np.array(list(bag), dtype=np.int64), np.array(list(bag.values()), dtype=float)) for _, bag, _ in examples])
        self.w = class_weights(self.y, counts)
        weight = self.w[self.y.astype(int)] if len(examples) else np.empty(0)
        votes = np.full(len(examples), np.nan)
        for fold in range(FOLDS):  # an example's own label tells nothing of the words that it is scored by
            mine = np.arange(len(examples)) % FOLDS == fold
            others = np.flatnonzero(~mine)
            if mine.any() and len(others):
                tie = self.ties(raw, others)
                index = self.indexed(raw.take(others), tie)
                votes[mine] = self.votes(index, [self.unit(*raw.row(i), tie) for i in np.flatnonzero(mine)], others)
        self.tie = self.ties(raw, np.arange(len(examples)))
        self.index = self.indexed(raw, self.tie)
        self.empty = float((np.diff(raw.ptr) == 0).mean()) if len(examples) else 0.0
        self.prior = self._rate(weight, self.y, np.ones(len(examples), dtype=bool), 0.5)
        self.none = self._rate(weight, self.y, np.isnan(votes), self.prior)
        seen = ~np.isnan(votes)
        self.steps = isotonic(votes[seen], self.y[seen], weight[seen])

    @staticmethod
    def _rate(w: np.ndarray, y: np.ndarray, which: np.ndarray, prior: float) -> float:
        total = w[which].sum()
        unit = w.mean() if len(w) else 1.0
        return float(((w * y)[which].sum() + unit * prior) / (total + unit)) if total + unit else prior

    def raw(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and TF-IDF weights."""
        return ids, (1 + np.log(n)) * self.idf[ids]

    def ties(self, raw: Vectors, rows: np.ndarray) -> np.ndarray:
        """How far some of the examples tie each word to a class."""
        part = raw.take(rows)
        y = np.repeat(self.y[rows], np.diff(part.ptr))
        n1 = np.bincount(part.ids[y == 1], minlength=len(self.terms)) + 0.5
        n0 = np.bincount(part.ids[y == 0], minlength=len(self.terms)) + 0.5
        log_odds = np.abs(np.log(n1 / ((self.y[rows] == 1).sum() + 1)) - np.log(n0 / ((self.y[rows] == 0).sum() + 1)))
        return np.sqrt(log_odds * log_odds / np.sqrt(1 / n1 + 1 / n0)) + 1e-6

    def unit(self, ids: np.ndarray, weights: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = weights * tie[ids]
        norm = np.sqrt((x * x).sum())
        return ids, x / norm if norm else x

    def indexed(self, raw: Vectors, tie: np.ndarray) -> BlockMaxIndex:
        return BlockMaxIndex(Vectors([self.unit(*raw.row(i), tie) for i in range(len(raw))]), len(self.terms))

    def votes(self, index: BlockMaxIndex, queries: list, of: np.ndarray) -> np.ndarray:
        found = [f for i in range(0, len(queries), QUERIES) for f in index.nearest_many(queries[i : i + QUERIES], self.k)]
        return self._votes([(of[ids], cosines) for ids, cosines in found])

    def _votes(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Share of class 1 among the neighbours of each text; one at distance 1 - cosine counts as cosine / (0.05 + distance)."""
        if not found:
            return np.empty(0)
        of = np.repeat(np.arange(len(found)), [len(ids) for ids, _ in found])
        ids, cosines = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        y = self.y[ids]
        w = cosines / (0.05 + 1 - cosines) * self.w[y.astype(int)]
        total, toxic = (np.bincount(of, x, minlength=len(found)) for x in (w, w * y))
        return np.divide(toxic, total, out=np.full(len(found), np.nan), where=total > 0)

    def score(self, texts: list[str | None]) -> Iterator[tuple[float, list[float], list[int], list[str], list[str]]]:
        """Probability, the five nearest neighbours' cosines, labels and ids, and the five strongest words, of each text."""
        queries = [self.unit(*self.raw(*self.known.arrays(text)), self.tie) for text in texts]
        found = self.index.nearest_many(queries, self.k)
        votes = self._votes(found)
        scores = np.clip(np.where(np.isnan(votes), self.none, calibrated(votes, self.steps)), 0.0, 1.0)
        for p, (ids, cosines), (words, weights) in zip(scores.tolist(), found, queries, strict=True):
            strongest, ids = words[np.argsort(-weights, kind="stable")[:5]].tolist(), ids[:5].tolist()
            yield p, cosines[:5].tolist(), [int(self.y[i]) for i in ids], [self.ids[i] for i in ids], [self.terms[t] for t in strongest]


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, label: str = "toxic") -> ToxicityModel:
    """Examples from the rows that may be learnt from; document frequencies from all documents."""
    rows, counts = examples(docs, labels, label, max_examples)
    held = class_frequencies(rows, terms_of).select("term", F.expr("n0 + n1").alias("n")).where(F.col("n") >= LEAST_DF)
    terms = [r["term"] for r in held.orderBy(F.desc("n"), "term").limit(MAX_TERMS).collect()]
    known = KnownWords(terms, words_of, parts_of)
    n, df = document_frequencies(docs, known)
    return ToxicityModel(term_counts(rows, known), counts, known, n, df)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Score every whole text: doc_id, score, predicted and evidence.

    ``evidence`` holds the nearest examples' cosines, labels and ids and the text's strongest words.
    Defined cases: null and empty texts, and those without a known word, get the rate of class 1 among
    such examples; with no labelled example at all the score is 0.5; repeated rows stay repeated; ties
    between neighbours go by the order of the examples, which depends on their texts alone, so equal
    texts score alike; other columns are ignored.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples and terms fitted on
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"])
            found = [f for i in range(0, len(texts), QUERIES) for f in shared.value.score(texts[i : i + QUERIES])]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "score": [f[0] for f in found],
                "predicted": [int(f[0] >= 0.5) for f in found],
                "evidence": [dict(zip(("cosines", "labels", "examples", "terms"), f[1:], strict=True)) for f in found],
            })

    evidence = "struct<cosines:array<double>,labels:array<int>,examples:array<string>,terms:array<string>>"
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, score double, predicted int, evidence {evidence}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence.*")
