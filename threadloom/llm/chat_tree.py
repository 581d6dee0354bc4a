"""Chat formatting as a prefix tree: turns that conversations share from the start are emitted once.

Template of a turn: ``<s>[role]`` line end, text, ``</s>`` line end. Control strings inside texts and roles are broken by a
backslash after their first character, and backslashes are doubled, so the text comes back exactly.

A node is a turn in its context: the same turns from the start, in the same order. Its key is its depth and two 64-bit
hashes of that run (exclusive or of hashes salted with the position, so a running window suffices). The smallest
conversation that passes a node owns it. What a conversation owns is always the rest of its path from some depth on: a
chain. Chains hang below one node of another chain; the nesting is resolved by pointer doubling over chains, not over turns.
Sorted by the nested keys (deeper branches first, then the smaller conversation), nodes stand in depth-first order, each
chain in one piece. Token offsets are prefix sums over that order, by range partitions. So no tree, however many
conversations share its first turn, is gathered in one task.

``tree`` returns nodes ``(owner, depth, start, n_tokens, token_ids, loss_from, loss_to, position, attention, n_convs)`` and
paths ``(conv, depth, owner)``. A node's tokens have positions from ``position`` on, attend to each other causally and to all
tokens in the intervals ``attention`` (the ancestors, as few intervals as there are branchings above).

Defined cases: null texts and roles are empty; turns are ordered by number, then role, then text, nulls first, and repeated
turns are kept; null conversation ids are one conversation; an empty table gives empty results.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_arrow, with_prefix_sums, written

BEGIN, END, LINE = "<s>[", "</s>\n", "]\n"
_CONTROL = re.compile(r"(<)(?=/?s>)|(\[)(?=/?INST\])|(<)(?=\|)")
_BACK = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>\[(.*?)\]\n(.*?)</s>\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    return escape(role).replace("]", "]\\")


def segments(role: str, text: str) -> tuple[str, str, str]:
    """Before, inside and after the text."""
    return BEGIN + escape_role(role) + LINE, escape(text), END


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _tokenizer(path: str):
    """``path``: a file of ranks, one base64 piece and its number a line."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _tokens(nodes: DataFrame, path: str) -> DataFrame:
    """Add ``token_ids``, ``n_tokens``, ``loss_from`` and ``loss_to`` (offsets in the node) for ``role`` and ``text``."""
    kept = [c for c in nodes.columns if c not in ("role", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            parts = [x for r, t in zip(roles, texts) for x in segments(r, t)]
            ids = [tokenizer.encode_ordinary(x) for x in parts]
            whole = [a + b + c for a, b, c in zip(ids[::3], ids[1::3], ids[2::3])]
            first = [len(a) for a in ids[::3]]
            last = [f + len(b) if r == "assistant" else f for f, b, r in zip(first, ids[1::3], roles)]
            cols = [pa.array(whole, pa.list_(pa.int32())), pa.array([len(w) for w in whole], pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *cols], [*kept, "token_ids", "n_tokens", "loss_from", "loss_to"])

    fields = ", ".join(f"`{c}` {nodes.schema[c].dataType.simpleString()}" for c in kept)
    return nodes.transform(map_arrow, run, f"{fields}, token_ids array<int>, n_tokens bigint, loss_from int, loss_to int")


def _nested(chains: DataFrame) -> DataFrame:
    """``(c, key)`` from ``(c, key, parent)``: keys of all chains above, outermost first."""
    while not chains.where("parent is not null").isEmpty():
        up = chains.select(F.col("c").alias("_c"), F.col("key").alias("_key"), F.col("parent").alias("_parent"))
        joined = chains.join(up, F.col("parent") == F.col("_c"), "left")
        chains = checkpointed(joined.select("c", F.when(F.col("_c").isNotNull(), F.concat("_key", "key")).otherwise(F.col("key")).alias("key"), F.col("_parent").alias("parent")))
    return chains.select("c", "key")


def tree(conversations: DataFrame, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and paths, see above. Conversations appear as ``struct<n: boolean, i: id>`` (``n``: the id is null)."""
    rows = conversations.select(
        F.struct(F.col("conv_id").isNull().alias("n"), F.col("conv_id").alias("i")).alias("c"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("d", F.row_number().over(Window.partitionBy("c").orderBy("turn", "role", "text")))
    so_far = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    for k in ("h1", "h2"):
        rows = rows.withColumn(k, F.bit_xor(F.xxhash64(F.lit(k), "d", "role", "text")).over(so_far))
    rows = written(rows, "chat-turns")
    # written, so that the join reads both sides from their own shuffles and adaptive execution can split the turns of one hot node
    owners = written(rows.groupBy("d", "h1", "h2").agg(F.min("c").alias("owner"), F.count(F.lit(1)).alias("n_convs")), "chat-owners")
    placed = written(rows.select("c", "d", "h1", "h2").join(owners, ["d", "h1", "h2"]).select("c", "d", "owner", "n_convs"), "chat-paths")
    own = F.col("owner") == F.col("c")
    chains = placed.groupBy("c").agg(F.min(F.when(own, F.col("d"))).alias("k"), F.max(F.when(~own, F.struct("d", "owner"))).alias("up")).where("k is not null")
    chains = checkpointed(chains.select("c", F.array(F.struct((-F.col("k")).alias("k"), F.col("c"))).alias("key"), F.col("up.owner").alias("parent")))
    chains = checkpointed(_nested(chains))

    nodes = rows.select("c", "d", "role", "text").join(placed.where(own).select("c", "d", "n_convs"), ["c", "d"]).join(chains, "c")
    nodes = with_prefix_sums(nodes, ["key", "d"], "n_tokens", "start", "_row", lambda rows: _tokens(rows, tokenizer or default_tokenizer()))
    nodes = written(nodes.drop("_row"), "chat-nodes")

    small = nodes.select(F.col("c").alias("owner"), "d", "n_tokens", "start")
    before = Window.partitionBy("c").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    positions = placed.join(small, ["owner", "d"]).withColumn("position", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).where("owner = c").select("c", "d", "position")
    # the part of each chain above that lies on the path: from its first node to the one where the next chain branches off
    steps = chains.select("c", F.posexplode(F.transform("key", lambda e, n: F.struct(e["c"].alias("a"), (-e["k"]).alias("from"), (-F.get("key", n + 1)["k"] - 1).alias("to"))))).select("c", "pos", "col.*")
    first, last = small.select(F.col("owner").alias("a"), F.col("d").alias("from"), F.col("start").alias("x")), small.select(F.col("owner").alias("a"), F.col("d").alias("to"), (F.col("start") + F.col("n_tokens")).alias("y"))
    spans = steps.join(first, ["a", "from"]).join(last, ["a", "to"], "left")
    spans = spans.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("spans"))
    above = F.transform(F.filter("spans", lambda s: s["y"].isNotNull()), lambda s: F.struct(s["x"].alias("from"), s["y"].alias("to")))
    own_start = F.element_at("spans", -1)["x"]
    attention = F.concat(above, F.filter(F.array(F.struct(own_start.alias("from"), F.col("start").alias("to"))), lambda s: s["from"] < s["to"]))
    nodes = nodes.join(positions, ["c", "d"]).join(spans, "c")
    nodes = nodes.select(F.col("c").alias("owner"), F.col("d").alias("depth"), "start", "n_tokens", "token_ids", "loss_from", "loss_to", "position", attention.alias("attention"), "n_convs")
    return nodes, placed.select(F.col("c").alias("conv"), F.col("d").alias("depth"), "owner")


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digest of each conversation, from the emitted tokens of the nodes on its path. Streams; no conversation is gathered."""
    path = tokenizer or default_tokenizer()
    kind = paths.schema["conv"].dataType["i"].dataType.simpleString()
    stored = nodes.select("owner", "depth", "token_ids", "loss_from", "loss_to")
    turns = paths.join(stored, ["owner", "depth"]).select("conv", "depth", "token_ids", "loss_from", "loss_to")
    turns = turns.repartition("conv").sortWithinPartitions("conv", "depth").select(F.col("conv.n").alias("n"), F.col("conv.i").alias("i"), "token_ids", "loss_from", "loss_to")
    id_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, now, done = _tokenizer(path), None, []

        def row():
            return (now["i"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["formatted"])

        def out():
            cols = list(zip(*done)) if done else [()] * 6
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return made

        for batch in batches:
            ids = batch.column("token_ids").to_pylist()
            texts = map(tokenizer.decode, ids)
            masked = (tokenizer.decode(x[a:b]) for x, a, b in zip(ids, batch.column("loss_from").to_pylist(), batch.column("loss_to").to_pylist()))
            for null, i, text, loss in zip(batch.column("n").to_pylist(), batch.column("i").to_pylist(), texts, masked):
                if now is None or now["id"] != (null, i):
                    if now:
                        done.append(row())
                    now = {"id": (null, i), "i": i, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                for role, inner in parse(text):
                    now["n"] += 1
                    now["turns"].update(f"{role}\n{inner}\n".encode())
                now["formatted"] += len(text)
                learned = unescape(loss)
                now["chars"] += len(learned)
                now["loss"].update(learned.encode())
            yield out()
        if now:
            done.append(row())
        yield out()

    return turns.transform(map_arrow, run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def chat_rows(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings."""
    spark = conversations.sparkSession
    trap = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).union(trap)
    return read_back(*tree(rows))
