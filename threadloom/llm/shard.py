"""Contiguous shards of near-equal bytes by global prefix sums.

Defined cases: null text has no bytes; null ids sort first; rows with equal ids are ordered by text hash, and rows equal
in all returned columns are interchangeable; an empty table gives an empty result; a row larger than a shard's share
stays whole, so neighbours of its shard may be empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, with_prefix_sums

SHARDS = 24
ROW_BYTES = 8


def balanced_shards(docs: DataFrame, shards: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``: shards are runs of the order by id.

    Row ``r`` with ``b`` bytes before it goes to shard ``floor((b + size/2) * shards / total)``, so each cut is within half a
    row of an equal target. ``slot`` counts from 0 in each shard.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))  # deals out rows that are equal in all else
    summed = checkpointed(with_prefix_sums(rows, ["doc_id", "text_crc32", "size", "_salt"], "size").drop("_salt"))
    total = summed.agg(F.max(F.col("before") + F.col("size"))).first()[0] or 1
    cut = summed.withColumn("shard", F.least(F.lit(shards - 1), F.floor((F.col("before") * 2 + F.col("size")) * shards / (2 * total))).cast("int"))
    firsts = {x["shard"]: x["f"] for x in cut.groupBy("shard").agg(F.min("row").alias("f")).collect()}  # at most one row a shard
    first = F.array(*(F.lit(firsts.get(k, 0)).cast("long") for k in range(shards)))
    return cut.select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.element_at(first, F.col("shard") + 1)).alias("slot"))


def shard_rows(docs: DataFrame) -> DataFrame:
    placed = balanced_shards(docs)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
