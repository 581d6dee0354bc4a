"""Documents as token ids in Parquet: list column, chosen encodings, row groups and page indexes.

One row a document, in ascending ``doc_id`` order over all files: ``doc_id``, ``part`` (number of the file's range),
``before`` (ids of the range before the document), ``n_tokens`` and ``ids``. Metadata and ids are separate columns, so
either can be read alone, and sorted ids give page indexes that let a range of documents be read without the rest.

Defined cases: null, empty and blank texts are the end id alone; null ids sort first; rows with equal ids are ordered by
text hash; texts of any length are encoded whole; an empty table gives a readable table without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, map_arrow

END_ID = 2


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one after the other, and the number of words of each text; null has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(words, "")
    if not pc.all(full).as_py():
        words, of = words.filter(full), of[full.to_numpy(zero_copy_only=False)]
    return pc.ascii_lower(words) if lower else words, np.bincount(of, minlength=len(texts))


#: ASCII marks other than the apostrophe.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes with: printable ones stand for themselves, the others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class WordEncoder:
    """Ids of texts, through a table of the words seen so far.

    Exact for tokenizers that split at white space and don't encode it. ``limit`` bounds the table: when it is full, the half
    that was used least goes. The words are one Arrow column, a few bytes each, so that a worker that keeps its table between
    tasks holds little memory.

    Words of letters with closing marks are split into both parts by rule, and the lower-case letters are spelled by the
    tokenizer's own merge model; everything else goes through the whole tokenizer. The rule holds for lower-casing
    byte-level tokenizers that part letters from marks, which is tried on a few words when the tokenizer is loaded; for
    others, all words go through the whole.
    """

    def __init__(self, path: str, limit: int = 250_000):
        self.limit = limit
        self.load(path)
        self.dtype = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.clear()

    def load(self, path: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.letters, self.by_rule = _byte_letters(), True
        tried = ["The", "straße", "ÉCOLE", "naïve.", "x...", "y),", "LÍNEA!!", "encyclopædia;", "it's", "a1", "</s>."]
        stems, tails = self.split(pa.array(tried))
        self.by_rule = all(self._unit(a) + self._unit(b) == self._whole([w])[0] for w, a, b in zip(tried, stems.to_pylist(), tails.to_pylist()))

    def _whole(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _unit(self, unit: str) -> list[int]:
        if self.by_rule and unit.isalpha() and unit.islower():
            return [t.id for t in self.tokenizer.model.tokenize(unit if unit.isascii() else "".join(map(self.letters.__getitem__, unit.encode())))]
        return self._whole([unit])[0]

    def split(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Lower-case letters and closing marks where the rule holds, else the word and nothing."""
        if not self.by_rule:
            return words, pa.array([""] * len(words), words.type)
        stems = pc.utf8_rtrim(words, MARKS)
        # letters without marks in these ranges are composed already, and but for U+0130 have one lower-case letter each
        good = pc.and_(pc.utf8_is_alpha(stems), pc.invert(pc.match_substring_regex(stems, r"[^\x00-\x{36F}\x{400}-\x{52F}]|\x{130}")))
        lower = pc.utf8_lower(stems)
        tail = pc.replace_substring_regex(words, pattern="^.*[^" + "".join("\\" + m for m in MARKS) + "]", replacement="")
        return pc.if_else(good, lower, words), pc.if_else(good, tail, "")

    def spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words or parts, one after the other, and how many each has."""
        found = [self._unit(w.decode("utf-8", "replace")) for w in words]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), sizes

    def clear(self) -> None:
        self.words = pa.array([], pa.large_binary())
        self.flat = np.empty(1 << 20, self.dtype)
        self.used, self.starts, self.sizes, self.uses = 0, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _shrink(self) -> None:
        """Drop the half of the words that was used least."""
        keep = np.sort(np.argpartition(-self.uses, len(self.uses) // 2)[: len(self.uses) // 2])
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.starts[keep] - ends + sizes, sizes) + np.arange(ends[-1])]
        self.flat[: len(flat)] = flat
        self.used, self.starts, self.sizes, self.uses = len(flat), ends - sizes, sizes, self.uses[keep] // 2
        self.words = self.words.take(pa.array(keep))
        self.shrunk(keep)

    def _learn(self, unknown: pa.Array) -> None:
        words = unknown.to_pylist()
        ids, sizes = self.spelled(words)
        self.words = pa.concat_arrays([self.words, unknown])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(sizes) - sizes
        self.starts, self.sizes = np.concatenate((self.starts, first)), np.concatenate((self.sizes, sizes))
        self.uses = np.concatenate((self.uses, np.zeros(len(words), np.int64)))
        self.used += len(ids)
        self.learned(words)

    def learned(self, words: list[bytes]) -> None:
        """For subclasses that keep more about each word."""

    def shrunk(self, keep: np.ndarray) -> None:
        """The same for the words that stay."""

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Number of each of the distinct ``words`` in the table; unknown ones are added. Numbers hold until the next call."""
        words = words.cast(pa.large_binary())
        if len(self.words) > self.limit:
            self._shrink()
        code = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        unknown = np.flatnonzero(code < 0)
        if len(unknown):
            first = len(self.starts)
            self._learn(words.take(pa.array(unknown)))
            code[unknown] = np.arange(first, first + len(unknown))
        return code

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of each word of an Arrow column; each distinct word is looked up once."""
        if not len(words):
            return np.empty(0, np.int64)
        table = words.dictionary_encode()
        code = self.lookup(table.dictionary)
        at = table.indices.to_numpy()
        self.uses[code] += np.bincount(at, minlength=len(code))
        return code[at]

    def _joined(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the parts ``a[i]`` and ``b[i]`` together, where each pair's begin, and how many they are."""
        pair = np.stack((a, b), 1).ravel()
        sizes = self.sizes[pair]
        ends = np.cumsum(sizes)
        flat = self.flat[np.repeat(self.starts[pair] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        return flat, (ends - sizes)[::2], sizes[::2] + sizes[1::2]

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text. ``end`` closes each text."""
        words, of_text = split_words(texts)
        table = words.dictionary_encode()
        parts = pa.concat_arrays([*self.split(table.dictionary)]).dictionary_encode()
        code = self.lookup(parts.dictionary)
        self.uses[code] += 1
        of_part = code[parts.indices.to_numpy()]
        a, b = of_part[: len(table.dictionary)], of_part[len(table.dictionary) :]
        # the ids of each distinct word here, then those of each word of the texts
        spelled, first, size = self._joined(a, b)
        at = table.indices.to_numpy()
        sizes = size[at]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        upto = np.concatenate(([0], np.cumsum(of_text)))
        counts = bounds[upto[1:]] - bounds[upto[:-1]]
        ids = spelled[np.repeat(first[at] - bounds[:-1], sizes) + np.arange(bounds[-1])]
        if end is None:
            return ids, counts
        out = np.empty(len(ids) + len(texts), ids.dtype)
        ends = np.cumsum(counts + 1) - 1
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[ends], out[keep] = end, ids
        return out, counts + 1


_KEPT: dict = {}


def kept_encoder(make, key) -> WordEncoder:
    """One table of words for each Python worker, kept from task to task."""
    if _KEPT.get("key") != key:
        _KEPT.clear()
        _KEPT.update(key=key, encoder=make())
    return _KEPT["encoder"]


def pieces(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about ``most`` bytes of text, so that memory doesn't follow the batch size."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def encoded(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, part, before, n_tokens, ids)``, range-partitioned and sorted by ``doc_id``."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = ["doc_id", "_hash"]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", F.spark_partition_id().alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = kept_encoder(lambda: WordEncoder(path), path), 0
        for whole in batches:
            for batch in pieces(whole, 2 << 20) if whole.num_rows else ():
                ids, counts = encoder.encode(batch.column("text"), end_id)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(before + ends - counts), pa.array(counts), lists], ["doc_id", "part", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    return ranged.transform(map_arrow, run, f"doc_id {kind}, part int, before bigint, n_tokens bigint, ids array<int>")


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 128 << 10, page_rows: int = 2_000) -> None:
    """``encoding``: ``dictionary`` (ids as bit-packed positions in a table) or ``delta`` (packed differences)."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(encoding)
    out = encoded(docs, tokenizer).write.option("parquet.block.size", row_group_bytes).option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
    out = out.option("parquet.writer.version", "v2").option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", str(encoding == "dictionary").lower())
    out.option("parquet.dictionary.page.size", 1 << 20).option("compression", "zstd").parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``(part, base)``: ids before each range. Reads two metadata columns; one row a range comes to the driver."""
    base, rows = 0, []
    for x in sorted(spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda x: x["part"]):
        rows.append((x["part"], base))
        base += x["n"]
    return spark.createDataFrame(rows, "part int, base bigint")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens)`` without touching the ids."""
    table = spark.read.parquet(path).select("doc_id", "part", "before", "n_tokens")
    return table.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens")


def read_tokens(spark: SparkSession, path: str, least=None, most=None) -> DataFrame:
    """``(doc_id, ids)`` of documents from ``least`` to ``most``; page indexes skip the rest."""
    table = spark.read.parquet(path).select("doc_id", "ids")
    if least is not None:
        table = table.where(F.col("doc_id") >= least)
    return table if most is None else table.where(F.col("doc_id") <= most)


def ids_crc32(table: DataFrame, keep: list[str]) -> DataFrame:
    """Checksum of each list as little-endian unsigned 32-bit integers, with the columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            at = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    fields = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keep)
    return table.select(*keep, "ids").transform(map_arrow, run, f"{fields}, ids_crc32 bigint")


def token_rows(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the table, read it back, and digest what was read."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    write_tokens(docs, path, **options)
    table = spark.read.parquet(path)
    done = ids_crc32(table, ["doc_id", "part", "before", "n_tokens"])
    return done.join(F.broadcast(starts(spark, path)), "part").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
