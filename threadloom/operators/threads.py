"""Messages to threads: time bursts, reply links, components, capped splitting, rendering.

Messages are rows ``(chat, msg_id, ts, reply_to, ...)``; ``(chat, msg_id)`` is unique. Every grouping and join has the chat in its
key. A chat may hold most of all messages, so running values are computed by buckets of ``BUCKET`` message ids, with one
carried row a bucket, and no chat is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import ANONYMOUS, gap_label
from threadloom.operators.graph import components

GAP_SECONDS = 600
CAP = 50
PAUSE_MINUTES = 30
BUCKET = 1 << 20


def bursts(messages: DataFrame, gap_seconds: int = GAP_SECONDS, bucket: int = BUCKET) -> DataFrame:
    """Add ``burst`` (from 0 in each chat): it grows where both this and the message just before have a time and lie more than
    ``gap_seconds`` apart. A null time never splits."""
    rows = messages.withColumn("_b", F.expr(f"msg_id div {bucket}"))
    in_bucket, by_bucket = Window.partitionBy("chat", "_b").orderBy("msg_id"), Window.partitionBy("chat").orderBy("_b")
    tails = rows.groupBy("chat", "_b").agg(F.max(F.struct("msg_id", "ts")).alias("t"))
    tails = tails.select("chat", "_b", F.lag("t.ts").over(by_bucket).alias("_before"))
    rows = rows.join(tails, ["chat", "_b"])
    first = F.row_number().over(in_bucket) == 1
    rows = rows.withColumn("_prev", F.when(first, F.col("_before")).otherwise(F.lag("ts").over(in_bucket)))
    rows = rows.withColumn("_new", F.coalesce(F.expr("timestampdiff(MICROSECOND, _prev, ts)") > gap_seconds * 1_000_000, F.lit(False)).cast("long"))
    sums = rows.groupBy("chat", "_b").agg(F.sum("_new").alias("_n"))
    sums = sums.select("chat", "_b", F.coalesce(F.sum("_n").over(by_bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    rows = rows.withColumn("_run", F.sum("_new").over(in_bucket.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(sums, ["chat", "_b"]).withColumn("burst", F.col("_base") + F.col("_run")).select(*messages.columns, "burst")


def burst_chunks(with_bursts: DataFrame, cap: int = CAP, bucket: int = BUCKET) -> DataFrame:
    """Add ``chunk`` (from 0 in each burst) and ``head``, the first message of the chunk.

    A burst may be a whole chat, so its messages are numbered by buckets of ids: in each bucket, plus the messages before it.
    """
    rows = with_bursts.withColumn("_b", F.expr(f"msg_id div {bucket}"))
    earlier = Window.partitionBy("chat", "burst").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("chat", "burst", "_b").agg(F.count(F.lit(1)).alias("_n")).select("chat", "burst", "_b", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy("chat", "_b", "burst").orderBy("msg_id")) - 1).join(before, ["chat", "burst", "_b"])
    rows = rows.withColumn("chunk", F.expr(f"(_before + _i) div {cap}")).select(*with_bursts.columns, "chunk")
    return rows.withColumn("head", F.min("msg_id").over(Window.partitionBy("chat", "burst", "chunk")))


def reply_edges(messages: DataFrame) -> DataFrame:
    """``(chat, msg_id, parent)`` for replies to messages that are there; a reply to itself makes no edge."""
    parents = messages.select(F.col("chat"), F.col("msg_id").alias("parent"))
    replies = messages.where("reply_to is not null and reply_to <> msg_id").select("chat", "msg_id", F.col("reply_to").alias("parent"))
    return replies.join(parents, ["chat", "parent"]).select("chat", "msg_id", "parent")


def _labelled(messages: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Add the smallest message id of each message's component over ``edges(chat, a, b)``. Nodes are pairs of chat and id."""
    node = lambda x: F.struct("chat", F.col(x).alias("msg_id"))
    found = components(edges.select(node("a").alias("a"), node("b").alias("b"))).select("node.chat", "node.msg_id", F.col("root.msg_id").alias(name))
    return messages.join(found, ["chat", "msg_id"], "left").withColumn(name, F.coalesce(name, "msg_id"))


def thread_components(messages: DataFrame, gap_seconds: int = GAP_SECONDS, cap: int = CAP) -> DataFrame:
    """Add ``component``: the smallest message id reachable over reply links and shared chunks of bursts."""
    chunks = burst_chunks(bursts(messages, gap_seconds), cap)
    stars = chunks.where("head <> msg_id").select("chat", F.col("head").alias("a"), F.col("msg_id").alias("b"))
    return _labelled(messages, stars.union(reply_edges(messages).select("chat", "parent", "msg_id")), "component")


def _pack(blocks: DataFrame, cap: int) -> DataFrame:
    """Next-fit packing of ``(chat, component, block, size)`` in the order of blocks: adds ``bin`` and ``offset``.

    The reset point depends on the running state, so blocks stream by in order, with only the state kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, number, filled = None, 0, 0
        for batch in batches:
            bins, offsets = [], []
            for chat, component, size in zip(batch.column("chat").to_pylist(), batch.column("component").to_pylist(), batch.column("size").to_pylist()):
                if (chat, component) != group:
                    group, number, filled = (chat, component), 0, 0
                if filled and filled + size > cap:
                    number, filled = number + 1, 0
                bins.append(number)
                offsets.append(filled)
                if size > cap:
                    number += -(-size // cap)
                else:
                    filled += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names, "bin", "offset"])

    ordered = blocks.repartition("chat", "component").sortWithinPartitions("chat", "component", "block")
    return ordered.mapInArrow(run, f"chat {blocks.schema['chat'].dataType.simpleString()}, component bigint, block bigint, size bigint, bin bigint, offset bigint")


def build_threads(messages: DataFrame, gap_seconds: int = GAP_SECONDS, cap: int = CAP) -> DataFrame:
    """Add ``root_msg_id`` and ``thread_pos`` (from 0).

    Components up to ``cap`` are threads. Larger ones are cut into blocks by reply links alone, and blocks are packed in order
    into threads of at most ``cap``; a block above ``cap`` is chopped. Rows of a packed thread stand block by block.
    """
    rows = thread_components(messages, gap_seconds, cap)
    sizes = rows.groupBy("chat", "component").agg(F.count(F.lit(1)).alias("_size"))
    rows = rows.join(sizes, ["chat", "component"])
    small = rows.where(F.col("_size") <= cap).withColumn("root_msg_id", F.col("component"))
    small = small.withColumn("thread_pos", F.row_number().over(Window.partitionBy("chat", "component").orderBy("msg_id")) - 1)
    big = rows.where(F.col("_size") > cap).drop("_size")
    same = big.select("chat", F.col("msg_id").alias("parent"), F.col("component").alias("_pc"))
    edges = big.where("reply_to is not null and reply_to <> msg_id").select("chat", "msg_id", F.col("reply_to").alias("parent"), "component").join(same, ["chat", "parent"]).where("component = _pc")
    big = _labelled(big, edges.select("chat", F.col("msg_id").alias("a"), F.col("parent").alias("b")), "block")
    packed = _pack(big.groupBy("chat", "component", "block").agg(F.count(F.lit(1)).alias("size")), cap)
    big = big.withColumn("_p", F.row_number().over(Window.partitionBy("chat", "component", "block").orderBy("msg_id")) - 1).join(packed, ["chat", "component", "block"])
    whole = F.col("size") <= cap
    big = big.withColumn("_bin", F.col("bin") + F.when(whole, 0).otherwise(F.expr(f"_p div {cap}"))).withColumn("thread_pos", F.when(whole, F.col("offset") + F.col("_p")).otherwise(F.expr(f"_p % {cap}")).cast("int"))
    big = big.withColumn("root_msg_id", F.max(F.when(F.col("thread_pos") == 0, F.col("msg_id"))).over(Window.partitionBy("chat", "component", "_bin")))
    kept = [*messages.columns, "root_msg_id", F.col("thread_pos").cast("long").alias("thread_pos")]
    return small.select(*kept).union(big.select(*kept))


def thread_stats(threads: DataFrame) -> DataFrame:
    """Messages, threads, threads of several messages and the largest, for each chat."""
    sizes = threads.groupBy("chat", "root_msg_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("chat").agg(F.sum("n").alias("n_messages"), F.count(F.lit(1)).alias("n_threads"), F.sum((F.col("n") > 1).cast("long")).alias("n_multi"), F.coalesce(F.max("n"), F.lit(0)).alias("max_size"))


def select_threads(threads: DataFrame, min_size: int = 2, since: str | None = None, limit: int | None = None) -> DataFrame:
    """``(chat, root_msg_id, size, latest)`` of threads that are large and recent enough; the first ``limit`` by root."""
    out = threads.groupBy("chat", "root_msg_id").agg(F.count(F.lit(1)).alias("size"), F.max("ts").alias("latest")).where(F.col("size") >= min_size)
    if since is not None:
        out = out.where(F.col("latest").isNull() | (F.col("latest") >= F.lit(since).cast("timestamp_ntz")))
    return out if limit is None else out.orderBy("chat", "root_msg_id").limit(limit)


def pause_markers(threads: DataFrame, minutes: int = PAUSE_MINUTES) -> DataFrame:
    """Add ``gap_minutes`` and ``pause`` (its label) where a message follows ``minutes`` or more after the last dated one."""
    before = Window.partitionBy("chat", "root_msg_id").orderBy("thread_pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = threads.withColumn("_last", F.last("ts", ignorenulls=True).over(before))
    gap = F.expr("timestampdiff(MICROSECOND, _last, ts)") / 60_000_000
    rows = rows.withColumn("gap_minutes", F.when(gap >= minutes, gap)).drop("_last")
    return rows.withColumn("pause", gap_label(F.col("gap_minutes")))


def thread_text(threads: DataFrame, sender: str = "sender", minutes: int = PAUSE_MINUTES) -> DataFrame:
    """``(chat, root_msg_id, text)``: one line a message, with replies and pauses marked. Threads are capped, so lists are short."""
    rows = pause_markers(threads, minutes)
    name = F.when(F.col(sender).isNull() | (F.col(sender).cast("string") == ""), F.lit(ANONYMOUS)).otherwise(F.col(sender).cast("string"))
    reply = F.when(F.coalesce(F.col("reply_to"), F.lit(0)) != 0, F.concat(F.lit(" ↩"), F.col("reply_to").cast("string"))).otherwise("")
    line = F.concat(F.lit("["), F.col("msg_id").cast("string"), F.lit("]"), reply, F.lit(" "), name, F.lit(": "), F.coalesce("text", F.lit("")))
    line = F.concat(F.when(F.col("gap_minutes").isNull(), "").otherwise(F.concat(F.lit("— пауза "), F.col("pause"), F.lit(" —\n"))), line)
    lines = F.array_sort(F.collect_list(F.struct("thread_pos", line.alias("line"))))
    return rows.groupBy("chat", "root_msg_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def branch_messages(branches: DataFrame, threads: DataFrame) -> DataFrame:
    """``branches(chat, root_msg_id, branches array<struct<topic, message_ids>>)`` to their messages, in the order of the branch; unknown ids go."""
    flat = branches.select("chat", "root_msg_id", F.posexplode("branches").alias("branch", "b")).select("chat", "root_msg_id", "branch", "b.topic", F.posexplode("b.message_ids").alias("pos", "msg_id"))
    return flat.join(threads.select("chat", "root_msg_id", "msg_id", *[c for c in ("ts", "text", "reply_to", "sender") if c in threads.columns]), ["chat", "root_msg_id", "msg_id"])
