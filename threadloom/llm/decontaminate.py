"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Words are runs of letters, digits and underscores, lower-cased; shingles are five words. A document matches an item if it
holds at least ``threshold`` of the item's distinct shingles.

Items are partitioned by their number of shingles (powers of two). The signature of an item is its bottom-k MinHash: the ``k``
smallest shingle hashes, where ``k`` is ``SIGNATURE`` more than the shingles that a match of the partition's largest size may miss.
A document, however long, is compared with a signature by how many of its hashes it holds. The partition's containment threshold
is what of a signature a match can't miss, so the search loses nothing: a match holds at least ``k`` less the shingles that it may
miss. Documents stream by, map-side, without a shuffle; each looks up its own shingle hashes among the signatures, and candidates
above the threshold are verified first on all hashes of the item, then on the shingles themselves.

The benchmark is dealt into blocks of bounded size. Each is sent to all executors alone, in one pass over the documents, whose
result is written before the next block.

Defined cases: items of fewer than five words are one shingle of their own length; items without words match nothing;
repeated items count once; null and empty texts match nothing; null ids are kept; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, mix64, written

WORDS = 5
THRESHOLD = 0.8
#: Hashes of a signature beyond those that a match may miss.
SIGNATURE = 6
#: Words of the benchmark that are sent to the executors at once.
BLOCK_WORDS = 2_000_000
_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    """Hash of each run of ``n`` words. Holds within one process only, as Python's string hash does."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    many = len(one) - n + 1
    total = np.zeros(many, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total = total * _MULTIPLIER + one[k : k + many]
    return mix64(total)


class Sketches:
    """Sketches of a block of items, for look-ups by the shingle hashes of documents."""

    def __init__(self, items: list[tuple], words: int, threshold: float):
        self.threshold, self.by_length = threshold, {}
        self.items, least = [], []
        anchors: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            found = words_of(text)
            if not found:
                continue
            n = min(words, len(found))
            hashes = np.unique(shingle_hashes(found, n))
            texts = {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}
            largest = (1 << len(hashes).bit_length()) - 1  # of the partition that holds this size
            k = min(len(hashes), int((1 - threshold) * largest + 1e-9) + SIGNATURE)
            least.append(max(1, k - int((1 - threshold) * len(hashes) + 1e-9)))
            anchors.setdefault(n, []).extend((int(h), len(self.items)) for h in hashes[:k])
            self.items.append((item_id, hashes, texts, n))
        self.least = np.array(least, np.int64)
        for n, pairs in anchors.items():
            pairs.sort()
            keys = np.array([p[0] for p in pairs], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.by_length[n] = (keys, np.array([p[1] for p in pairs], np.int64), seen)

    def matches(self, text: str | None) -> list[tuple]:
        """``(item_id, shared, shingles)`` of the items that the text holds."""
        found, out = words_of(text), []
        for n, (keys, of, seen) in self.by_length.items():
            hashes = shingle_hashes(found, n)
            hashes = hashes[seen[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)]]
            if not len(hashes):
                continue
            hashes = np.unique(hashes)
            a, b = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
            held = [of[x:y] for x, y in zip(a[a < b], b[a < b])]
            if not held:
                continue
            candidates, shared = np.unique(np.concatenate(held), return_counts=True)
            candidates = candidates[shared >= self.least[candidates]]
            if not len(candidates):
                continue
            everything = np.unique(shingle_hashes(found, n))
            texts = None
            for c in candidates.tolist():
                item_id, own, shingles, _ = self.items[c]
                if np.isin(own, everything, assume_unique=True).sum() >= self.threshold * len(own) - 1e-9:
                    texts = texts or {tuple(found[i : i + n]) for i in range(len(found) - n + 1)}
                    shared = len(shingles & texts)
                    if shared >= self.threshold * len(shingles) - 1e-9:
                        out.append((item_id, shared, len(shingles)))
        return out


def _blocks(benchmark: DataFrame, words: int, threshold: float, block_words: int):
    """Broadcasts of the items, ``block_words`` words at a time, and whether it's the last."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield benchmark.sparkSession.sparkContext.broadcast([tuple(x) for x in own.collect()]), k == blocks - 1


def leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, item_id, n_shared, n_shingles, containment)`` of every match."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = pa.int64() if item_kind == "bigint" else pa.int32() if item_kind == "int" else pa.string()
    out, texts = [], docs.select("doc_id", F.col("text").cast("string").alias("text"))
    for items, last in _blocks(benchmark, words, threshold, block_words):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(items.value, words, threshold)
            for batch in batches:
                rows = [(k, *m) for k, t in enumerate(batch.column("text").to_pylist()) for m in sketches.matches(t)]
                at = pa.array([r[0] for r in rows], pa.int64())
                shared, size = (np.array([r[k] for r in rows], np.int64) for k in (2, 3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(at), pa.array([r[1] for r in rows], item_type), pa.array(shared), pa.array(size), pa.array(shared / np.maximum(size, 1))],
                    ["doc_id", "item_id", "n_shared", "n_shingles", "containment"],
                )

        found = texts.transform(map_arrow, run, f"doc_id {kind}, item_id {item_kind}, n_shared bigint, n_shingles bigint, containment double")
        if not last:
            found = written(found, "leaks")
            items.unpersist()
        out.append(found)
    return reduce(DataFrame.union, out)


def without_leaks(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that match no item, with all columns."""
    schema = docs.schema
    for items, last in _blocks(benchmark, words, threshold, block_words):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            sketches = Sketches(items.value, words, threshold)
            for batch in batches:
                yield batch.filter(pa.array([not sketches.matches(t) for t in batch.column("text").cast(pa.string()).to_pylist()], pa.bool_()))

        docs = docs.transform(map_arrow, run, schema)
        if not last:
            docs = written(docs, "clean")
            items.unpersist()
    return docs
