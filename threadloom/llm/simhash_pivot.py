"""SimHash near-duplicates: fingerprints, pivot distance tables, links and components.

``fingerprints``: one 64-bit SimHash for each document, over whole texts.
``links``: all pairs of different fingerprints within ``radius`` bits.
``near_groups``: document, fingerprint, and the smallest document id reachable over links.

How links are found. Distances to reference fingerprints (pivots) are 1-Lipschitz: if two fingerprints are within
``radius`` bits, their distances to any pivot differ by at most ``radius``. The pivot table has two parts.

* Unit pivots (all zeros, and one pivot for each single bit). The distance to a unit pivot less the distance to the
  zero pivot is -1 or +1, which is just that bit, so this part of the table is kept as the fingerprint itself. Its
  coordinates are dealt into ``BLOCKS`` groups; ``radius`` differing bits touch at most ``radius`` groups, so close
  fingerprints agree in all coordinates of some ``BLOCKS - radius`` groups. Those coordinates are the join keys: this
  is exact, and no key is shared by more than a handful of unrelated fingerprints.
* Dense pivots: ``DENSE`` pseudo-random fingerprints. Distances are computed once for each distinct fingerprint; a pair
  whose largest coordinate difference is above ``radius`` is discarded. Survivors are verified by their exact distance.

Copies never meet in pairs: equal fingerprints are one row from the start. Fingerprints that share a key are
compared in vectorized sweeps; of a bucket with over ``SMALL`` members only a spanning forest of its links is emitted, so
the output stays in proportion to the input however many near copies there are. Buckets of over ``HOT`` members are dealt
once more, by the same rule over the coordinates that their key leaves free, so that no task holds an unbounded bucket.

Defined cases: null, empty and wordless texts have fingerprint zero and link like any other; null ids are kept, and sort
after all others when the smallest id is chosen; repeated rows come back as often as they went in.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, checkpointed, components, map_arrow, mix64, over_batches, written

BLOCKS = 6
DENSE = 16
SEED = 42
WORDS = 3


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half of the shingle hashes; ASCII case is folded, shingles repeat."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) <= words:
        spans = [b" ".join(found)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        whole, last = b" ".join(found), ends - 1
        first = np.concatenate(([0], ends[: len(found) - words]))
        spans = [whole[a:b] for a, b in zip(first.tolist(), last[words - 1 :].tolist())]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in spans), np.uint64, len(spans))
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    on = 2 * bits.sum(axis=0, dtype=np.int64) > len(spans)
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(doc_id, fp long)`` for every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(x, words, seed) for x in as_bytes(batch.column(1))], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).transform(map_arrow, over_batches(run), f"doc_id {kind}, fp bigint")


def _masks(radius: int) -> list[int]:
    edges = np.linspace(0, 64, BLOCKS + 1).round().astype(int)
    blocks = [((1 << int(b)) - (1 << int(a))) for a, b in zip(edges[:-1], edges[1:])]
    return [sum(x) for x in combinations(blocks, BLOCKS - radius)]


def _finer(mask: int, radius: int) -> list[int]:
    """Masks that add to ``mask`` all but ``radius`` of ``BLOCKS`` groups of the coordinates that it leaves free."""
    free = [k for k in range(64) if not mask >> k & 1]
    groups = [sum(1 << int(k) for k in g) for g in np.array_split(free, BLOCKS)]
    return [mask + sum(x) for x in combinations(groups, BLOCKS - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pivots(n: int = DENSE) -> list[int]:
    return [_signed(int(x)) for x in mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))]


#: Buckets up to this size are compared in one vectorized sweep; larger ones give a spanning forest.
SMALL = 64
#: Buckets with more fingerprints than this are dealt by finer keys.
HOT = 4096


def _near(x: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no pivot discards, verified."""
    gap = np.abs(table[i] - table[j]).max(axis=1)
    i, j = i[gap <= radius], j[gap <= radius]
    good = np.bitwise_count(x[i] ^ x[j]) <= radius
    return i[good], j[good]


def _outside(rows: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each row of distances the largest coordinate difference to the ranges of a block: no row of the block is closer than that."""
    low, high = block.min(axis=0), block.max(axis=0)
    return np.maximum(np.maximum(low - rows, rows - high), 0).max(axis=1)


def _forest(x: np.ndarray, table: np.ndarray, radius: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all close fingerprints of one large bucket, fewer than it has rows.

    Sorted by the distance to the first pivot, only rows at most ``radius`` further on can be close. Among those, rows are in cells of
    the other pivots, so that a block covers a small range of each distance: a row whose distance to any pivot lies more than
    ``radius`` outside the range of a block is close to none of it and discarded, on both sides, before fingerprints are compared.
    Blocks bound memory; blocks that are connected already aren't compared.
    """
    cells = table // (radius + 1)
    order = np.lexsort((*(cells[:, k] for k in range(cells.shape[1] - 1, 0, -1)), table[:, 0]))
    x, table = x[order], table[order]
    parent = np.arange(len(x))

    def roots(k: np.ndarray) -> np.ndarray:
        r = parent[k]
        while not np.array_equal(up := parent[r], r):
            r = up
        parent[k] = r
        return r

    out: list[tuple[int, int]] = []
    for a in range(0, len(x), block):
        end = int(np.searchsorted(table[:, 0], table[min(a + block, len(x)) - 1, 0] + radius, side="right"))
        rows = np.arange(a, min(a + block, len(x)))
        for b in range(a, end, block):
            others = np.arange(b, min(b + block, end))
            left, right = roots(rows), roots(others)
            if (left == left[0]).all() and (right == left[0]).all():
                continue
            here = rows[_outside(table[rows], table[others]) <= radius]
            there = others[_outside(table[others], table[here]) <= radius] if len(here) else here
            if not len(there):
                continue
            left, right = roots(here), roots(there)
            close = np.bitwise_count(x[here][:, None] ^ x[there][None, :]) <= radius
            for u in np.flatnonzero(close.any(axis=1)):
                near = np.flatnonzero(close[u])
                near = near[right[near] != left[u]]
                if not len(near):
                    continue
                apart, first = np.unique(right[near], return_index=True)
                out.extend((int(here[u]), int(there[v])) for v in near[first])
                joined = np.append(apart, left[u])
                parent[joined] = joined.min()
                left[np.isin(left, joined)] = joined.min()
                right[np.isin(right, joined)] = joined.min()
    i, j = (np.array([p[k] for p in out], np.int64) for k in (0, 1))
    return order[i], order[j]


def _bucket_links(batches, pivots: list[int], radius: int):
    """Rows ``(block, key, fp)`` sorted by block and key to links."""
    reference = np.array(pivots, np.int64).view(np.uint64)
    table = lambda x: np.bitwise_count(x[:, None] ^ reference[None, :]).astype(np.int16)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def links(block: np.ndarray, key: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (key[1:] != key[:-1]))))
        sizes = np.diff(np.concatenate((starts, [len(fp)])))
        size = np.repeat(sizes, sizes)
        place = np.arange(len(fp)) - np.repeat(starts, sizes)
        keep = (size > 1) & (size <= SMALL)
        x, place, size = fp[keep], place[keep], size[keep]
        found = []
        if len(x):
            rows = table(x)
            for lag in range(1, int(size.max())):
                i = np.flatnonzero(place + lag < size)
                i, j = _near(x, rows, i, i + lag, radius)
                found.append((x[i], x[j]))
        for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            y = fp[s : s + n]
            i, j = _forest(y, table(y), radius)
            found.append((y[i], y[j]))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.empty(0, np.uint64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)))
        block, key, fp = (np.concatenate([h[k] for h in held]) for k in range(3))
        last = (block != block[-1]) | (key != key[-1])
        cut = int(last.sum())  # the last bucket may go on in the next batch
        if cut:
            yield links(block[:cut], key[:cut], fp[:cut])
        held = [(block[cut:], key[cut:], fp[cut:])]
    if held:
        yield links(*held[0])


def _keyed(block: int, mask: int) -> Column:
    return F.struct(F.lit(block).alias("block"), F.col("fp").bitwiseAND(F.lit(_signed(mask))).alias("key"))


def links(distinct: DataFrame, radius: int = 3, hot: int = HOT) -> DataFrame:
    """``(a, b)`` that connect all fingerprints of ``distinct(fp)`` within ``radius`` bits of each other.

    All close pairs of small buckets, a spanning forest of large ones; repeated if several keys agree. Members of a bucket of
    over ``hot`` fingerprints are dealt by finer keys, which leave some 17 coordinates free: no task holds more than that.
    """
    masks, pivots = _masks(radius), _pivots()
    dealt = distinct.select("fp", F.explode(F.array(*(_keyed(n, m) for n, m in enumerate(masks)))).alias("k")).select("k.block", "k.key", "fp")
    large = written(dealt.groupBy("block", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("block", "key"), "simhash-hot")
    if not large.isEmpty():
        finer = [F.array(*(_keyed((n + 1) * 1000 + k, m) for k, m in enumerate(_finer(mask, radius)))) for n, mask in enumerate(masks)]
        chosen = reduce(lambda other, n: F.when(F.col("block") == n, finer[n]).otherwise(other), range(1, len(finer)), finer[0])
        again = dealt.join(large, ["block", "key"], "left_semi").select("fp", F.explode(chosen).alias("k")).select("k.block", "k.key", "fp")
        dealt = dealt.join(large, ["block", "key"], "left_anti").union(again)
    dealt = dealt.repartition("block", "key").sortWithinPartitions("block", "key")
    return dealt.transform(map_arrow, lambda it: _bucket_links(it, pivots, radius), "a bigint, b bigint")


def near_groups(docs: DataFrame, radius: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs(doc_id, text)``."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), radius))
    mapped = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = mapped.groupBy("root").agg(F.min("least").alias("component_id"))
    of = checkpointed(mapped.join(smallest, "root").select("fp", "component_id"))
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def simhash_rows(docs: DataFrame) -> DataFrame:
    """The query's digest: fingerprint as 16 hex digits."""
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 3) -> DataFrame:
    """One row of each component: that of the smallest id, of several the one with the smallest text hash, then with the smallest other
    columns as text.

    Null ids count as the largest. All columns are kept as they are, whatever their types.
    """
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"))
    heads = near_groups(docs.select(key.alias("doc_id"), "text"), radius).select(F.col("component_id").alias("_key")).distinct()
    same = docs.select(key.alias("_key"), F.struct("*").alias("_row")).join(heads, "_key", "left_semi")
    others = [f"_row.`{c}`" for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(others)))) if others else F.lit("")
    return same.groupBy("_key").agg(F.min_by("_row", order).alias("_row")).select("_row.*")
