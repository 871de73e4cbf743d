"""Benchmark decontamination: latent semantic retrieval of passages, confirmed by common subsequences and answer words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.staging import written
from umbra.llm.common import python_ready, table, words_of

#: Words of a passage, and words from one passage's start to the next.
PASSAGE, STRIDE = 32, 16
DIMENSIONS, OVERSAMPLE = 128, 16
#: Cosine in the latent space from which a passage is compared word by word.
COSINE = 0.5
#: Passages of up to this many words are also held against stretches of two blocks, half a passage long.
SHORT = 20
#: Words of a block, of which a text's passages are put together.
BLOCK = 8
#: Texts whose passages are multiplied with the benchmark's at once, and blocks of a stretch of them.
BATCH, STRETCH = 64, 2048
#: Passages that the sketch adds up at once.
SKETCHED = 16384
#: Bits of the sets that bound how many words a stretch and a passage can share.
BITS = 256
#: Share of a benchmark passage that must stand in the text in order; for paraphrases a smaller one
#: will do if the passage's answer words (its rarest) are there too.
VERBATIM, PARAPHRASE, ANSWER = 0.75, 0.55, 0.7
#: Shorter items say too little to be recognised by part of their words: they must stand in a text word for word.
LEAST_WORDS = 8
#: The benchmark is held by the driver and every executor, and so is a row of the latent space for each of its terms; a larger
#: one must be given in parts, whose results add up.
MAX_ITEMS, MAX_WORDS, MAX_TERMS = 50_000, 5_000_000, 200_000


def passages(n: int, size: int = PASSAGE, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Stretches that cover n words; the last one ends with them."""
    if n <= size:
        return [(0, n)] if n else []
    starts = list(range(0, n - size + 1, stride))
    if starts[-1] + size < n:
        starts.append(n - size)
    return [(s, s + size) for s in starts]


def common_words(a: list[int], masks: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence of a and the n words behind the masks (bit-parallel)."""
    full = (1 << n) - 1
    row = full
    for word in a:
        mask = masks.get(word)
        if mask:
            low = row & mask
            row = ((row + low) | (row - low)) & full
    return n - row.bit_count()


class Benchmark:
    """Passages of the benchmark over its own vocabulary; short items by their first word."""

    def __init__(self, items: list[tuple], kind: str = "bigint") -> None:
        self.known: dict[str, int] = {}
        self.kind = kind
        self.brief: dict[int, list[tuple]] = {}
        self.passages: list[tuple] = []  # item, start, word numbers
        for item, text in items:
            words = words_of(text)
            ids = [self.known.setdefault(w, len(self.known)) for w in words]
            if len(ids) < LEAST_WORDS:
                if ids:
                    self.brief.setdefault(ids[0], []).append((item, np.array(ids)))
                continue
            self.passages += [(item, lo, ids[lo:hi]) for lo, hi in passages(len(ids))]
        self.masks = []
        for _, _, ids in self.passages:
            masks: dict[int, int] = {}
            for place, word in enumerate(ids):
                masks[word] = masks.get(word, 0) | 1 << place
            self.masks.append(masks)

    def width(self) -> type:
        return np.int16 if len(self.known) < 2**15 else np.int32

    def unpacked(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.width()).astype(np.int64)

    def ids(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words in order, -1 for words that no benchmark item has."""
        words = words_of(text)
        return np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))


def encode(docs: DataFrame, benchmark: Benchmark) -> DataFrame:
    """(doc_id, ids): each text's word numbers as bytes, written once for the passes that follow; other words are -1."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(benchmark)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [model.ids(t).astype(model.width()).tobytes() for t in batch["text"]]})

    return written(docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, ids binary"))


def sketch(encoded: DataFrame, benchmark: Benchmark, width: int, seed: int = 17) -> tuple[int, np.ndarray, np.ndarray]:
    """One pass over all documents: their number, the terms' document frequencies and G W.

    G is the terms' Gram matrix over all passages of the corpus and W a sparse random test matrix; every task
    adds up its own share of G W and hands on a row for each term that it met.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(benchmark)
    terms = len(benchmark.known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        test = test_matrix(terms, width, seed)
        total, df, out = 0, np.zeros(terms, dtype=np.int64), np.zeros((terms, width))
        for batch in batches:
            rows, groups, at = [], [], 0
            for packed in batch["ids"]:
                total += 1
                ids = model.unpacked(packed)
                place = np.flatnonzero(ids >= 0)
                if len(place):
                    rows.append(ids[place])
                    groups.append(at + place // PASSAGE)
                    df[np.unique(rows[-1])] += 1
                    at += len(ids) // PASSAGE + 1
                if at >= SKETCHED:
                    _add(out, test, rows, groups)
                    rows, groups, at = [], [], 0
            if rows:
                _add(out, test, rows, groups)
        met = np.flatnonzero(df)
        yield pd.DataFrame({"t": np.append(met, -1), "n": np.append(df[met], total), **{f"y{k}": np.append(out[met, k], 0.0) for k in range(width)}})

    schema = "t long, n long, " + ", ".join(f"y{k} double" for k in range(width))
    found = encoded.select("ids").mapInPandas(run, schema).groupBy("t").agg(F.sum("n").alias("n"), *[F.sum(f"y{k}").alias(f"y{k}") for k in range(width)])
    total, df, out = 0, np.zeros(terms), np.zeros((terms, width))
    for r in found.collect():  # one row for each benchmark term
        if r["t"] < 0:
            total = r["n"]
        else:
            df[r["t"]] = r["n"]
            out[r["t"]] = [r[f"y{k}"] for k in range(width)]
    return total, df, out


def test_matrix(terms: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A sparse random test matrix: each term's one column and sign."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, width, terms), rng.choice(np.array([-1.0, 1.0], dtype=np.float32), terms)


def _add(out: np.ndarray, test: tuple[np.ndarray, np.ndarray], rows: list, groups: list) -> None:
    """Add the sum over passages p of p (p' W)."""
    column, sign = test
    width = out.shape[1]
    ids, group = np.concatenate(rows), np.concatenate(groups)
    of = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    sums = np.bincount(of * width + column[ids], weights=sign[ids], minlength=(of[-1] + 1) * width).astype(np.float32).reshape(-1, width)
    order = np.argsort(ids.astype(np.uint16) if len(out) < 65536 else ids, kind="stable")
    ids, of = ids[order], of[order]
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    # a sum for each term: adding whole rows up is many times faster than reduceat along the other axis
    for term, lo, hi in zip(ids[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ids)], strict=True):
        out[term] += sums[of[lo:hi]].sum(0)


class Detector:
    """IDF weights, latent directions and the benchmark's passage vectors; a plain object that is broadcast."""

    def __init__(self, benchmark: Benchmark, total: int, df: np.ndarray, gram: np.ndarray, sketched: tuple[np.ndarray, np.ndarray], dimensions: int = DIMENSIONS) -> None:
        self.benchmark = benchmark
        test = np.zeros(gram.shape)
        test[np.arange(len(gram)), sketched[0]] = sketched[1]
        idf = np.log((1 + total) / (1 + df)) + 0.1
        # the TF-IDF Gram matrix M = D G D in one pass: M (D^-1 W) = D (G W), and Nystrom's formula gives its leading directions
        left = gram * idf[:, None]
        core = (test / idf[:, None]).T @ left
        core = (core + core.T) / 2
        values, vectors = np.linalg.eigh(core)
        good = values > max(values.max(initial=0.0), 0.0) * 1e-9
        root = left @ (vectors[:, good] / np.sqrt(values[good])) if good.any() else np.eye(len(idf), min(dimensions, len(idf)))
        if root.size:
            directions, strength, _ = np.linalg.svd(root, full_matrices=False)
            # each direction counts by its inverse strength: what all texts of a language share says little
            real = int((strength[:dimensions] > 1e-4 * strength[0]).sum())  # the rest is rounding
            directions = directions[:, :real] / strength[:real]
        else:
            directions = root
        # the last row, which is also row -1, is that of all words that no item has
        self.space = np.vstack([idf[:, None] * directions, np.zeros((1, directions.shape[1]))]).astype(np.float32)
        self.points = _unit(np.array([self.space[ids].sum(0) for _, _, ids in benchmark.passages], dtype=np.float32).reshape(len(benchmark.passages), directions.shape[1]))
        self.short = np.array([i for i, (_, _, ids) in enumerate(benchmark.passages) if len(ids) <= SHORT], dtype=np.int64)
        order = np.argsort(-idf, kind="stable")
        place = np.empty(len(idf), dtype=np.int64)
        place[order] = np.arange(len(idf))
        # each word is one of the bits; words that share a bit, and repeated words, may count once too often but never too seldom
        self.bits = np.zeros((len(idf) + 1, BITS // 64), dtype=np.uint64)
        words = np.arange(len(idf))
        self.bits[words, words % BITS // 64] = np.uint64(1) << (words % 64).astype(np.uint64)
        own = [np.bitwise_or.reduce(self.bits[ids], axis=0) for _, _, ids in benchmark.passages]
        self.sets = np.array(own, dtype=np.uint64).reshape(len(own), BITS // 64)
        lengths = np.array([len(ids) for _, _, ids in benchmark.passages], dtype=np.int64)
        self.least = PARAPHRASE * lengths - (lengths - np.bitwise_count(self.sets).sum(1, dtype=np.int64))
        # the third of a passage's words that is rarest in the corpus answers for its content
        self.answers = [frozenset(sorted(set(ids), key=lambda t: place[t])[: max(2, len(set(ids)) // 3)]) for _, _, ids in benchmark.passages]

    def hits(self, text: str | None) -> list[tuple]:
        return self.hits_of([text])[0]

    def hits_of(self, texts: list[str | None]) -> list[list[tuple]]:
        return self.hits_in(texts, self.benchmark.ids)

    def hits_in(self, docs: list, ids: Callable[[object], np.ndarray]) -> list[list[tuple]]:
        """(item, common share, answer share, cosine) of every benchmark item found in each whole text, best passage each."""
        out = []
        for lo in range(0, len(docs), BATCH):
            out += self._some([ids(d) for d in docs[lo : lo + BATCH]])
        return out

    def _some(self, docs: list[np.ndarray]) -> list[list[tuple]]:
        best: list[dict] = [{} for _ in docs]
        if len(self.points) and any(len(d) for d in docs):
            sizes = np.array([-(-len(ids) // BLOCK) for ids in docs])
            firsts = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(docs)), sizes)
            at = (np.arange(len(owner)) - firsts[owner]) * BLOCK
            words = np.full((len(owner), BLOCK), -1)
            for first, ids in zip((firsts * BLOCK).tolist(), docs, strict=True):
                words.ravel()[first : first + len(ids)] = ids
            for lo in range(0, len(at), STRETCH):  # long texts go in stretches; three more blocks complete the last passage
                hi = min(lo + STRETCH + 3, len(at))
                one, more = self.space[words[lo:hi, 0]], np.empty((hi - lo, self.space.shape[1]), dtype=np.float32)
                for k in range(1, BLOCK):
                    one += np.take(self.space, words[lo:hi, k], axis=0, out=more, mode="wrap")
                two = _with_next(one, owner[lo:hi], 1)
                stop = min(STRETCH, hi - lo)
                every = np.arange(stop)
                whole = np.flatnonzero(at[lo : lo + stop] % STRIDE == 0)
                four = _with_next(two, owner[lo:hi], 2)
                for sums, rows, which in ((four, whole, np.arange(len(self.points))), (two, every, self.short)):
                    if not len(which):
                        continue
                    cosines = _unit(sums[rows]) @ self.points[which].T
                    w, p = np.divmod(np.flatnonzero(cosines.ravel() >= COSINE), len(which))
                    fit = self._can_hold(words, lo + rows[w], which[p], firsts[owner[lo + rows[w]]], sizes[owner[lo + rows[w]]])
                    last, near, there = -1, [], set()
                    for w, p in zip(w[fit].tolist(), p[fit].tolist(), strict=True):
                        i = owner[lo + rows[w]]
                        if w != last:  # one passage of the text meets several of the benchmark's
                            last, start = w, int(at[lo + rows[w]])
                            near = docs[i][max(0, start - STRIDE) : start + PASSAGE + STRIDE]
                            near = near[near >= 0].tolist()
                            there = set(near)
                        self._compare(best[i], near, there, int(which[p]), float(cosines[w, p]))
        for b, ids in zip(best, docs, strict=True):
            self._verbatim(b, ids)
        return [sorted((item, *found) for item, found in b.items()) for b in best]

    def _can_hold(self, words: np.ndarray, block: np.ndarray, passage: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether enough of a passage's words can stand around a block, in any order; false only where ``_compare`` finds too few for sure."""
        new = np.r_[True, block[1:] != block[:-1]][: len(block)]
        span = block[new, None] + np.arange(-STRIDE // BLOCK, (PASSAGE + STRIDE) // BLOCK)
        span = np.clip(span, first[new, None], (first + size)[new, None] - 1)
        around = np.bitwise_or.reduce(self.bits[words[span]], axis=(1, 2))
        return np.bitwise_count(around[np.cumsum(new) - 1] & self.sets[passage]).sum(1, dtype=np.int64) >= self.least[passage]

    def _verbatim(self, best: dict, ids: np.ndarray) -> None:
        """The short items that stand in a text word for word."""
        if self.benchmark.brief:
            for at in np.flatnonzero(np.isin(ids, list(self.benchmark.brief))):
                for item, words in self.benchmark.brief[int(ids[at])]:
                    if np.array_equal(ids[at : at + len(words)], words):
                        best[item] = (1.0, 1.0, 1.0)

    def _compare(self, best: dict, near: list[int], there: set[int], p: int, cosine: float) -> None:
        item, _, words = self.benchmark.passages[p]
        n = len(words)
        masks = self.benchmark.masks[p]
        if len(masks.keys() & there) + n - len(masks) < PARAPHRASE * n:
            return  # too few of the passage's words stand there in any order
        common = common_words(near, masks, n) / n
        if common < PARAPHRASE:
            return
        answer = len(self.answers[p] & there) / len(self.answers[p])
        if common >= VERBATIM or answer >= ANSWER:
            found = (common, answer, cosine)
            best[item] = max(best.get(item, found), found)


def _with_next(sums: np.ndarray, owner: np.ndarray, step: int) -> np.ndarray:
    """Each row with the row ``step`` further on, if that belongs to the same text."""
    out = sums.copy()
    out[:-step] += sums[step:]
    apart = np.flatnonzero(owner[:-step] != owner[step:])
    out[apart] = sums[apart]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def fit(docs: DataFrame, benchmark: DataFrame, max_items: int = MAX_ITEMS, max_words: int = MAX_WORDS) -> tuple[Detector, DataFrame]:
    """Read the benchmark after a check of its size, and take the statistics of all documents; also gives the encoded documents.

    A benchmark of more than ``max_items`` rows or about ``max_words`` words is refused with ValueError:
    its passages are broadcast; so is one of more than ``MAX_TERMS`` different words, since the sketch
    and the space hold a row for each. Null items and texts, and texts without words, are left out.
    """
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()
    if size["n"] > max_items or size["chars"] > 6 * max_words:
        raise ValueError("the benchmark is too large to be broadcast; give it in parts")
    model = Benchmark([(r["item_id"], r["text"]) for r in rows.distinct().orderBy("item_id", "text").collect()], dict(benchmark.dtypes)["item_id"])
    if len(model.known) > MAX_TERMS:
        raise ValueError("the benchmark has too many different words to be broadcast; give it in parts")
    width = DIMENSIONS + OVERSAMPLE
    encoded = encode(docs, model)
    total, df, gram = sketch(encoded, model, width)
    return Detector(model, total, df, gram, test_matrix(len(model.known), width, 17)), encoded


def find_leaks(encoded: DataFrame, detector: Detector) -> DataFrame:
    """Benchmark items found in encoded documents: one row for each document row and item, doc_id, item_id, common, answer, cosine.

    All passages of every whole text are held against all benchmark passages in the latent space; those
    close enough must share a long common subsequence, or a shorter one with the passage's answer words.
    Items of fewer than eight words must stand in the text word for word.
    Defined cases: null and empty texts hold nothing; repeated rows are reported each; an empty
    benchmark or table gives an empty result; other columns are ignored.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(detector)  # bounded with the benchmark
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = shared.value.hits_in(list(batch["ids"]), shared.value.benchmark.unpacked)
            out = [(doc, *hit) for doc, hits in zip(batch["doc_id"], found, strict=True) for hit in hits]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "common", "answer", "cosine"])

    return encoded.mapInPandas(run, f"doc_id {kind}, item_id {detector.benchmark.kind}, common double, answer double, cosine double")


def is_leaky(docs: DataFrame, detector: Detector) -> DataFrame:
    """``doc`` (the input row as a struct) and ``leaky``, whether the text holds any benchmark item."""
    python_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(detector)

    @F.pandas_udf("boolean")
    def leaky(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bool(hits) for hits in shared.value.hits_of(list(texts))], dtype=bool)

    rows = docs.select(F.struct("*").alias("doc"), F.col("text").alias("_text"))
    return rows.select("doc", leaky("_text").alias("leaky"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    detector, encoded = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return find_leaks(encoded, detector)
