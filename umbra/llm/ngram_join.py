"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions.staging import written
from umbra.llm.common import components, python_ready, table, words_of

WORDS, SIMILARITY = 5, 0.8
#: Share of the pairs at exactly the wanted similarity that must meet in a band.
RECALL = 0.99999
MAX_BANDS = 40
#: Candidates that are compared at once with another block's: documents and bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 128, 2_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_WORD_IDS: dict[str, int] = {}


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """The sharpest (bands, rows) whose bands miss a pair at the wanted similarity with at most 1 - recall."""
    best = (most, 1)
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows))) if similarity < 1 else 1
        if bands <= most:
            best = (max(1, bands), rows)
    return best


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word n-grams; one of all words where they are fewer than n."""
    words = words_of(text)
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_WORD_IDS) > 500_000:
        _WORD_IDS.clear()
    ids = np.empty(len(words), dtype=np.uint64)
    for i, word in enumerate(words):
        own = _WORD_IDS.get(word)
        if own is None:
            own = _WORD_IDS[word] = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
        ids[i] = own
    n = min(n, len(words))
    out = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        out *= _MIX
        out += ids[k : len(ids) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def band_keys(sets: list[np.ndarray], bands: int, rows: int, seed: int = 3) -> np.ndarray:
    """One 64-bit bucket key for each set and band. Sets must not be empty."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 2**31, bands * rows, dtype=np.uint64) * 2 + 1).astype(np.uint32)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint64).astype(np.uint32)
    least = np.empty((bands * rows, len(sets)), dtype=np.uint32)
    at = 0
    while at < len(sets):  # some 64k hashes at a time stay in the processor's cache
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 65536):
            total += len(sets[end])
            end += 1
        flat = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        buffer = np.empty_like(flat)
        for k in range(bands * rows):
            np.multiply(flat, a[k], out=buffer)
            np.add(buffer, b[k], out=buffer)
            least[k, at:end] = np.minimum.reduceat(buffer, starts)
        at = end
    keys = np.empty((len(sets), bands), dtype=np.uint64)
    for band in range(bands):
        own = np.full(len(sets), band + 1, dtype=np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            own = (own ^ least[k]) * _MIX
            own ^= own >> np.uint64(29)
        keys[:, band] = own
    return keys.view(np.int64)


def digest_of(grams: np.ndarray) -> bytes:
    return blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, a hash of the text, a 128-bit digest of the n-gram set, its size, the text's bytes and the band keys."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, n) for t in batch["text"]]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(full, bands, rows)) if full else iter(())
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "text_hash": batch["text_hash"],
                "node": [digest_of(s) for s in sets],
                "grams": [len(s) for s in sets],
                "bytes": [len(t) if t else 0 for t in batch["text"]],
                "bands": [next(keys) if len(s) else [] for s in sets],
            })

    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows_of.mapInPandas(run, "doc_id long, text_hash long, node binary, grams int, bytes long, bands array<long>")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What must be compared: members (rep, node, copies) and tasks (node, i, j, side).

    Texts that share a band meet. Each joins the group of the smallest text that it meets, which keeps
    most that meet together; a large group is cut by hash into blocks. A text is held against its own
    group and every group that holds a text it shares a band with, block against block: a task is a
    pair of blocks. So the tasks follow the bands, however long the chains that these form, and a bucket
    of near copies, which are nearly all in one group, isn't joined with itself.
    """
    keys = classes.select("node", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last").select("key", "lead")
    met = written(keys.join(buckets, "key"))
    anchored = met.groupBy("node").agg(F.min("lead").alias("anchor")).join(classes.select("node", "rep", "copies", "bytes"), "node")
    sizes = anchored.groupBy("anchor").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("bytes") / BLOCK_BYTES)).alias("parts"))
    members = written(anchored.join(sizes, "anchor").select("rep", "node", "copies", "anchor", "parts"))
    placed = met.select("key", "node").join(members.select("node", "anchor", "parts"), "node")
    groups = placed.groupBy("key", "anchor").agg(F.max("parts").alias("other_parts")).withColumnRenamed("anchor", "other")
    against = placed.join(groups, "key").select("node", "anchor", "parts", "other", "other_parts").distinct()
    own = F.xxhash64("anchor", F.pmod(F.xxhash64("node"), F.col("parts")))
    dealt = against.select("node", own.alias("block"), "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("other_parts") - 1)).alias("part"))
    dealt = dealt.select("node", "block", F.xxhash64("other", "part").alias("with"))
    return members.select("rep", "node", "copies"), dealt.select("node", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("side"))


def links_between(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs reach the similarity: all pairs if there is one side, else those across the sides."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    shared = np.zeros((n, n))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    count = np.diff(np.r_[new, len(flat)])
    column = np.repeat(np.arange(len(new)), count)
    column, owner = column[np.repeat(count > 1, count)], owner[np.repeat(count > 1, count)]
    if len(column):
        column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
    width = 4096
    total = column[-1] + 1 if len(column) else 0
    for lo in range(0, total, width):  # n-grams that several texts hold, some thousand at a time
        first, last = np.searchsorted(column, (lo, lo + width))
        block = np.zeros((n, min(width, total - lo)), dtype=np.float32)
        block[owner[first:last], column[first:last] - lo] = 1
        shared += block @ block.T
    union = sizes[:, None] + sizes[None, :] - shared
    linked = shared + 1e-9 >= similarity * union
    linked &= side[:, None] != side[None, :] if side.any() else ~np.eye(n, dtype=bool)
    return linked


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each text the smallest number in its connected group."""
    root = np.arange(len(linked))
    while True:
        low = np.where(linked, root[None, :], len(root)).min(1, initial=len(root))
        new = np.minimum(root, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def ngram_join(docs: DataFrame, n: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """For each document the class of texts it is linked with and the number of its links.

    Two documents are linked if the Jaccard similarity of their sets of word n-grams (lower case) is at
    least ``similarity``. Columns: doc_id; copy_of, the smallest doc_id with the same set; class_id, the
    smallest doc_id that a chain of links leads to; n_links, the number of other documents linked
    directly, copies included.

    Equal sets count as one text from the start, so copies never meet each other. Texts that share a band
    are compared on their full n-gram sets, block against block (see ``candidates``), and only counts
    and a spanning forest leave a task: no list of all pairs exists, and no link is lost however large a
    bucket is. A set's hashes are worked out once and are what is shuffled.

    Defined cases: texts without words have no n-grams: they are their own class with no links. Texts of
    fewer than n words have one n-gram of all their words. A null doc_id has null classes and no links of
    its own and is not counted in the others'. Rows that repeat a doc_id count as so many documents, each
    with its own text's links; ``text_hash`` (xxhash64 of the text) tells them apart. Other columns are
    ignored.
    """
    bands, rows = choose_bands(similarity, recall)
    sig = written(signatures(docs, n, bands, rows))
    classes = written(
        sig.where("grams > 0 and doc_id is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.first("bands").alias("bands"))
    )
    members, tasks = candidates(classes)

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                few = batch.iloc[lo : lo + 256]
                grams = [shingles(t, n) for t in few["text"]]
                same = [digest_of(g) == bytes(node) for g, node in zip(grams, few["node"], strict=True)]
                yield pd.DataFrame({"node": few["node"][same], "copies": few["copies"][same], "grams": [g.view(np.int64) for g, s in zip(grams, same, strict=True) if s]})

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members.select("rep", "node", "copies").hint("shuffle_hash"), "rep")
    dealt = texts.select("node", "copies", "text").mapInPandas(sets, "node binary, copies long, grams array<long>").join(tasks, "node")
    dealt = dealt.select("i", "j", "side", "node", "copies", "grams").repartition("i", "j").sortWithinPartitions("i", "j")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, out = None, {}, []

        def done() -> None:
            if len(group) > 1:
                nodes = sorted(group)
                side = np.array([group[x][0] for x in nodes])
                if key[0] != key[1] and side.min() == side.max():
                    return
                linked = links_between([group[x][2] for x in nodes], side, similarity)
                copies = np.array([group[x][1] for x in nodes], dtype=np.int64)
                roots, found = _forest(linked), linked @ copies
                out.extend((nodes[x], int(found[x]), nodes[roots[x]]) for x in np.flatnonzero(found))

        for batch in batches:
            for i, j, side, node, copies, grams in batch.itertuples(index=False, name=None):
                if (i, j) != key:
                    done()
                    key = (i, j)
                    group.clear()
                group.setdefault(bytes(node), (side, copies, np.asarray(grams)))
            if out:
                yield pd.DataFrame(out, columns=["node", "n", "root"])
                out.clear()
        done()
        if out:
            yield pd.DataFrame(out, columns=["node", "n", "root"])

    found = written(dealt.mapInPandas(compare, "node binary, n long, root binary"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("node", "rep", "copies").join(counts, "node", "left").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = labelled.groupBy("label").agg(F.min("rep").alias("class_id"))
    known = labelled.join(smallest, "label").select("node", "rep", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), "class_id")
    ids = sig.select("doc_id", "text_hash", F.when(F.expr("grams > 0 and doc_id is not null"), F.col("node")).alias("node"))
    return ids.join(known, "node", "left").select(
        "doc_id",
        F.coalesce("rep", "doc_id").alias("copy_of"),
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("text_hash")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w
), sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(sa.n) AS nx, any_value(sb.n) AS ny, count(*) AS c
  FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN sizes sa ON sa.doc_id = a.doc_id JOIN sizes sb ON sb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 5 * count(*) >= 4 * (any_value(sa.n) + any_value(sb.n) - count(*))
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y
), classes AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY 1),
same AS (SELECT x AS doc_id, min(y) AS first_copy FROM links WHERE c = nx AND c = ny GROUP BY 1),
counts AS (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(first_copy, doc_id)) AS copy_of, class_id, coalesce(n, 0) AS n_links
FROM classes LEFT JOIN same USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
