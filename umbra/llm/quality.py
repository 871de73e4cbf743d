"""Quality classifier: votes of the nearest labelled documents in a latent-semantic space."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm.common import is_held_out, python_ready, table
from umbra.llm.labelled import KnownTerms, calibrated, class_frequencies, class_weights, document_frequencies, examples, isotonic, term_counts

#: Labelled documents that are fitted on, half of each class; their vectors are broadcast.
MAX_EXAMPLES = 4000
#: Terms (the commonest of the examples) and dimensions of the latent space.
MAX_TERMS, DIMENSIONS = 4096, 48
NEIGHBOURS = 25
#: Documents whose cosines with all examples are held at once.
BLOCK = 512
SHARPNESS = 8
LONG_FORM, LONG_TOKEN = 12, 64

_RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]{2,}"), "X"), (re.compile(r"[A-ZÀ-ÖØ-Þ]"), "C"), (re.compile(r"[^\W\d_A-ZÀ-ÖØ-ÞXC]+"), "x"), (re.compile(r"\d+"), "9"))


def shape_of(token: str) -> str:
    """Form of a whole token: X for a run of capitals, C for one, x for small letters, 9 for digits, marks as they are.

    A longer form than LONG_FORM signs is told by the signs it has and the power of two of its length.
    """
    if token.isalpha():
        if token.islower():
            return "~x"
        if token[0].isupper() and (len(token) == 1 or token[1:].islower()):
            return "~Cx" if len(token) > 1 else "~C"
    found = token
    for pattern, letter in _RUNS:
        found = pattern.sub(letter, found)
    if len(found) <= LONG_FORM:
        return "~" + found
    return f"~{''.join(sorted(set(found)))[:LONG_FORM]}:{len(found).bit_length()}"


def parts_of(token: str) -> list[str]:
    """The lower-case word and its form."""
    return [token.lower(), shape_of(token)]


def extras_of(tokens: list[str], bag: Counter) -> dict[str, int]:
    """Terms for repetition and size of a whole text."""
    n = len(tokens)
    repeated = sum(map(eq, tokens, islice(tokens, 1, None)))
    shares = (("again", repeated), ("distinct", len(bag)), ("commonest", max(bag.values(), default=0)))
    out = {f"~{name}:{min(9, 10 * x // max(1, n))}": 4 for name, x in shares}
    out[f"~size:{min(10, n.bit_length())}"] = 4
    longest = max(map(len, bag), default=0)
    if longest > LONG_TOKEN:  # what has no blanks is told by its size
        out[f"~longest:{min(16, longest.bit_length())}"] = 4
    if repeated:
        out["~again"] = repeated
    return out


def terms_of(text: str | None) -> Counter:
    """Lower-case words, forms of tokens, repetitions and size classes of a whole text, with their counts."""
    tokens = text.split() if text else []
    bag, out = Counter(tokens), Counter()
    for token, n in bag.items():
        for part in parts_of(token):
            out[part] += n
    out.update(extras_of(tokens, bag))
    return out


class QualityModel:
    """TF-IDF weights, term directions, example vectors and the calibration of their votes."""

    def __init__(self, pairs: list, counts: dict, known: KnownTerms, n_docs: int, df: np.ndarray, dimensions: int = DIMENSIONS) -> None:
        self.known = known
        self.idf = np.log((1 + n_docs) / (1 + df)) + 1
        matrix = np.zeros((len(pairs), len(known.ids)), dtype=np.float32)
        for row, (_, bag, _) in enumerate(pairs):
            ids, weights = self.weigh(bag)
            matrix[row, ids] = weights
        self.directions = _right_vectors(matrix, dimensions)
        self.points = _unit(matrix @ self.directions)
        self.y = np.array([y for y, *_ in pairs], dtype=np.float32)
        self.w = class_weights(self.y, counts)
        self.weight = self.w[self.y.astype(int)].astype(np.float32) if pairs else np.empty(0, dtype=np.float32)
        raw = np.concatenate([self.votes(self.points[i : i + BLOCK], own=i) for i in range(0, len(pairs), BLOCK)] or [np.empty(0)])
        self.steps = isotonic(raw, self.y, self.weight)

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
        x = (1 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))) * self.idf[ids]
        norm = np.sqrt((x * x).sum())
        return ids, (x / norm if norm else x).astype(np.float32)

    def votes(self, points: np.ndarray, own: int | None = None) -> np.ndarray:
        """Share of class 1 among each point's nearest examples; a cosine c counts as c to the power SHARPNESS.

        All examples as near as the last neighbour vote, so ties need no order.
        """
        if not len(self.y):
            return np.full(len(points), 0.5)
        cosines = points @ self.points.T
        if own is not None:
            cosines[np.arange(len(points)), own + np.arange(len(points))] = -2
        k = min(NEIGHBOURS, cosines.shape[1])
        last = np.partition(cosines, -k, axis=1)[:, -k, None]
        w = np.where(cosines >= last, np.maximum(cosines, 1e-3), 0)
        for _ in range(SHARPNESS.bit_length() - 1):
            w *= w
        w *= self.weight
        return w @ self.y / w.sum(1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        points = np.zeros((len(texts), self.directions.shape[1]), dtype=np.float32)
        for row, text in enumerate(texts):
            ids, weights = self.weigh(self.known.counts(text))
            if len(ids):
                points[row] = weights @ self.directions[ids]
        return np.clip(calibrated(self.votes(_unit(points)), self.steps), 0.0, 1.0)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _right_vectors(matrix: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """Randomised SVD with two power steps: the k leading term directions."""
    k = min(k, *matrix.shape)
    if not k:
        return np.zeros((matrix.shape[1], 1), dtype=np.float32)
    test = np.random.default_rng(seed).standard_normal((matrix.shape[1], min(k + 10, *matrix.shape))).astype(np.float32)
    basis = matrix @ test
    for _ in range(2):
        basis = matrix @ (matrix.T @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    return np.ascontiguousarray(np.linalg.svd(basis.T @ matrix, full_matrices=False)[2][:k].T)


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES, label: str = "quality") -> QualityModel:
    """Examples from the rows that may be learnt from; document frequencies from all documents."""
    rows, counts = examples(docs, labels, label, max_examples)
    held = class_frequencies(rows, terms_of).select("term", F.expr("n0 + n1").alias("n")).where("n > 2")
    terms = [r["term"] for r in held.orderBy(F.desc("n"), "term").limit(MAX_TERMS).collect()]
    known = KnownTerms(terms, str.split, parts_of, extras_of)
    n, frequencies = document_frequencies(docs, known)
    return QualityModel(term_counts(rows, known), counts, known, n, frequencies)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """Score every whole text: ``doc`` (the input row as a struct), ``score`` and ``predicted``.

    Defined cases: null and empty texts have only size terms and are scored by them; with no labelled
    example the score is 0.5; repeated rows stay repeated and score alike; examples tied with the last
    neighbour all vote.
    """
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the examples and terms fitted on

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.concatenate([shared.value.score(list(texts[i : i + BLOCK])) for i in range(0, len(texts), BLOCK)] or [np.empty(0)]))

    score = _iterator_udf(run)
    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("_text"))
    return rows.select("doc", score("_text").alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def _iterator_udf(run):  # noqa: ANN001, ANN202
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run(batches)

    return score


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("doc.doc_id").alias("doc_id"), is_held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted")
