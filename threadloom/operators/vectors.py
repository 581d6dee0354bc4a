"""Cosine search, similarity pairs, near-duplicate clusters, consolidation.

Vectors are ``(id, embedding array<float>)``; cosines are computed in double precision. Both searches are exact: a stated set of
queries goes to the executors in blocks of bounded size, and pairs of all vectors are computed block by block, so a task holds
two blocks at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadloom.operators.graph import components
from threadloom.storage import written

QUERY_BLOCK = 4096
PAIR_BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(rows) -> np.ndarray:
    """Rows of unit length, from an Arrow column of lists (its flat values) or a list of lists."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1) if isinstance(rows, pa.Array) else np.array([np.asarray(r, np.float64) for r in rows])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    return np.trunc(x * 10.0**digits + np.copysign(0.5, x)) / 10.0**digits


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 6, least: float | None = None, exclude_self: bool = False, digits: int = 9) -> DataFrame:
    """``(query_id, id, score, rank)``: the ``k`` nearest vectors of each query, then those with at least ``least``.

    Scores are rounded once, to ``digits``, halves away from zero; those that are equal then are ties, which go to the smaller id. Each batch of vectors keeps its own best ``k``, so the ranking shuffles little. Of several blocks of
    queries one is sent at a time, and its result written before the next.
    """
    total = queries.count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    kind, asked = vectors.schema["id"].dataType, queries.schema["id"].dataType
    fields = f"query_id {asked.simpleString()}, id {kind.simpleString()}, score double"
    types = [to_arrow_type(asked), to_arrow_type(kind), pa.float64()]
    out = None
    for n in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n) if blocks > 1 else queries
        rows = own.select("id", "embedding").collect()  # a block of the stated queries
        if not rows:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast(([r["id"] for r in rows], _unit([r["embedding"] for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                own = np.array(batch.column("id").to_pylist())
                scores = _rounded(q @ _unit(batch.column("embedding")).T, digits)
                found = []
                for i, s in enumerate(scores):
                    good = np.flatnonzero(own != ids[i]) if exclude_self else np.arange(len(own))
                    best = good[np.lexsort((own[good], -s[good]))[:k]]
                    found.extend((ids[i], own[j].item(), float(s[j])) for j in best)
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(types)], ["query_id", "id", "score"])

        part = vectors.select("id", "embedding").mapInArrow(run, fields)
        if n < blocks - 1:
            part = written(part, "nearest")
            shared.unpersist()
        out = part if out is None else out.union(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], f"{fields}, rank int")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked if least is None else ranked.where(F.col("score") >= least)


def similar_pairs(vectors: DataFrame, least: float, block: int = PAIR_BLOCK, spanning: bool = False) -> DataFrame:
    """``(a, b, score)`` with ``a < b``: all pairs with a cosine of at least ``least``, by pairs of blocks.

    ``spanning``: of each pair of blocks only as many pairs as connect what all of them connect, with no score; so the output stays
    in proportion to the input where most vectors are alike.
    """
    blocks = max(1, -(-vectors.count() // block))
    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.select("id", "embedding").withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(F.col("_b"), o).alias("i"), F.greatest(F.col("_b"), o).alias("j")))
    dealt = rows.select("id", "embedding", "_b", F.explode(pair).alias("p")).select("id", "embedding", "_b", "p.i", "p.j")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        i, j = int(df["i"].iloc[0]), int(df["j"].iloc[0])
        x, y = df[df["_b"] == i], df[df["_b"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        scores = _unit(list(x["embedding"])) @ _unit(list(y["embedding"])).T
        close = np.round(scores, 9) >= least
        if spanning:
            found = _spanning(np.triu(close, 1) if i == j else close, x["id"].to_numpy(), y["id"].to_numpy())
            a, b = (np.array([f[k] for f in found], x["id"].to_numpy().dtype) for k in (0, 1))
            return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": np.full(len(a), np.nan)})
        p, q = np.nonzero(close)
        a, b = x["id"].to_numpy()[p], y["id"].to_numpy()[q]
        good = a < b if i == j else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[good], "b": np.maximum(a, b)[good], "score": scores[p, q][good]})

    return dealt.groupBy("i", "j").applyInPandas(compare, f"a {kind}, b {kind}, score double")


def clusters(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(id, cluster)``: the smallest id that each vector reaches over pairs."""
    found = components(pairs.select("a", "b"))
    return vectors.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


#: Units of one link up to this number are compared by a join; larger links block by block.
SMALL_LINK = 64


def _spanning(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Links enough to connect what the matrix links, fewer than it has rows and columns. ``x`` and ``y``: ids, equal ids are one."""
    ids, of = np.unique(np.concatenate((x, y)), return_inverse=True)
    label, left, right, out = np.arange(len(ids)), of[: len(x)], of[len(x) :], []
    for u in np.flatnonzero(linked.any(axis=1)):
        near = right[linked[u]]
        apart, first = np.unique(label[near], return_index=True)
        for new, v in zip(apart, near[first]):
            if label[left[u]] != new:
                out.append((ids[left[u]], ids[v]))
        label[np.isin(label, np.append(apart, label[left[u]]))] = apart.min()
    return out


def _link_edges(units: DataFrame, least: float, small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """``(a, b)`` that connect the clusters of each link, and ``(pos, n)``: close pairs, each counted at one end."""
    sizes = units.groupBy("link").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    rows = written(units.join(sizes, "link").select("link", "pos", F.trim("question").alias("q"), "embedding", "_n"), "same-link")
    few, many = rows.where(F.col("_n") <= small), rows.where(F.col("_n") > small)
    a, b = (few.select("link", F.col("pos").alias(s), F.col("q").alias(f"{s}_q"), F.col("embedding").alias(f"{s}_e")) for s in "ab")
    pairs = a.join(b, "link").where("a < b").select("a", "b", (F.col("a_q") == F.col("b_q")).alias("same"), (F.round(cosine(F.col("a_e"), F.col("b_e")), 9) >= least).alias("close"))
    found = pairs.where("same or close").select("a", "b", F.col("close").cast("long").alias("n"))
    dealt = many.withColumn("_k", F.expr(f"cast(ceil(_n / {block}) as int)")).withColumn("_b", F.expr("cast(pmod(xxhash64(pos), _k) as int)"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda o: F.struct(F.least(F.col("_b"), o).alias("i"), F.greatest(F.col("_b"), o).alias("j")))
    dealt = dealt.select("link", "pos", "q", "embedding", "_b", F.explode(pair).alias("p")).select("link", "pos", "q", "embedding", "_b", "p.i", "p.j")

    def compare(df: pd.DataFrame) -> pd.DataFrame:
        i, j = int(df["i"].iloc[0]), int(df["j"].iloc[0])
        x, y = df[df["_b"] == i], df[df["_b"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})
        close = np.round(_unit(list(x["embedding"])) @ _unit(list(y["embedding"])).T, 9) >= least
        codes = pd.factorize(pd.concat((x["q"], y["q"])))[0]
        same = (codes[: len(x), None] == codes[None, len(x) :]) & (codes[: len(x), None] >= 0)
        if i == j:
            close, same = np.triu(close, 1), np.triu(same, 1)
        edges = [(*e, 0) for e in _spanning(close | same, x["pos"].to_numpy(), y["pos"].to_numpy())]
        counted = [(p, p, n) for p, n in zip(x["pos"], close.sum(axis=1)) if n]
        return pd.DataFrame(edges + counted, columns=["a", "b", "n"]).astype("int64")

    found = written(found.union(dealt.groupBy("link", "i", "j").applyInPandas(compare, "a bigint, b bigint, n bigint")), "link-pairs")
    return found.where("a <> b").select("a", "b"), found.groupBy(F.col("a").alias("pos")).agg(F.sum("n").alias("n"))


def same_link_clusters(units: DataFrame, least: float = 0.97, small: int = SMALL_LINK, block: int = PAIR_BLOCK) -> DataFrame:
    """``(pos, cluster, action)`` for ``units(pos, link, question, embedding)``: among units with one link, edges join equal
    questions and cosines of ``least`` or more. A cluster whose pairs all reach ``least`` keeps its first unit and drops the
    rest; any other is merged into its first. Units alone are kept.

    A link may hold most units: then it is compared by pairs of blocks, which return spanning links and counts, not all pairs.
    """
    edges, close = _link_edges(units, least, small, block)
    roots = components(edges)
    rows = written(units.select("pos").join(roots.withColumnRenamed("node", "pos"), "pos", "left").join(close, "pos", "left").select("pos", F.coalesce("root", "pos").alias("cluster"), F.coalesce("n", F.lit(0)).alias("n")), "link-clusters")
    folded = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
    folded = folded.select("cluster", F.when(F.col("m") > 1, F.col("n") * 2 == F.col("m") * (F.col("m") - 1)).alias("tight"))
    first = F.col("pos") == F.col("cluster")
    return rows.join(folded, "cluster").select("pos", "cluster", F.when(F.col("tight").isNull(), "keep").when(F.col("tight"), F.when(first, "keep").otherwise("drop")).otherwise(F.when(first, "merge").otherwise("merged")).alias("action"))


def merge_record(units: DataFrame) -> DataFrame:
    """For each ``cluster`` of ``units(cluster, pos, date, ...)`` the member with the largest date (missing: empty), of several the first."""
    best = units.groupBy("cluster").agg(F.max(F.struct(F.coalesce("date", F.lit("")).alias("d"), (-F.col("pos")).alias("p"))).alias("m"))
    best = best.select("cluster", (-F.col("m.p")).alias("pos"))
    return units.join(best, ["cluster", "pos"], "left_semi")


def consolidate(units: DataFrame) -> DataFrame:
    """Fold ``units(cluster, pos, date, type, ...)``: support, date range (empty dates don't count), majority type (of a tie the
    one seen first by date), and the last of the newest as representative. See ``fold_sources`` for the sources of a fold, and
    ``most_supported`` for the order."""
    dated = F.coalesce("date", F.lit(""))
    rows = units.withColumn("_d", dated)
    kinds = rows.groupBy("cluster", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_d", "pos")).alias("first"))
    majority = kinds.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "type")).alias("m")).select("cluster", F.col("m.type").alias("type"))
    real = F.nullif(F.col("_d"), F.lit(""))
    folded = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("support_count"), F.min(real).alias("date_start"), F.max(real).alias("date_end"), F.max(F.struct("_d", "pos")).alias("r"))
    return folded.join(majority, "cluster").select("cluster", "support_count", "date_start", "date_end", F.col("r.pos").alias("representative"), "type")


def fold_sources(units: DataFrame) -> DataFrame:
    """``(cluster, n, link, date, type)``: the sources of each fold in the order of their dates, one row each, so that a cluster of any
    size needs no list."""
    rows = units.withColumn("_d", F.coalesce("date", F.lit("")))
    n = F.row_number().over(Window.partitionBy("cluster").orderBy("_d", "pos")) - 1
    return rows.select("cluster", n.alias("n"), "link", F.col("_d").alias("date"), F.coalesce("type", F.lit("vote_based")).alias("type"))


def most_supported(folds: DataFrame) -> DataFrame:
    """Folds with the most units first; of equal ones the smaller cluster."""
    return folds.orderBy(F.desc("support_count"), "cluster")
