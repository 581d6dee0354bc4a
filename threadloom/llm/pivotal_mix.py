"""Mix sources to target word counts by pivotal dependent rounding; DataFrame functions only.

Every document of a source has the same expected number of copies, ``target / source_size``, from 0 to 2. The whole part is
taken; the fractional parts are rounded by pairs: of two documents, mass moves from one to the other, in the direction and by
the amount that chance decides, until one of the two is whole. Moves are weighed by size, so that each pair keeps its
expected number of words exactly and each document keeps its expected number of copies. What is left of a bounded group is at
most one fractional document; these residuals meet in the next level of a reduction tree, up to one for each source, which
is rounded by a draw. So each source misses its target by less than one document.

Chance comes from hashes of the paired ids, so reruns agree, whatever the partitioning.

Defined cases: null or blank texts have size 0 and take nothing; null sources are one source, last; rows that agree in key,
source and size are one item with a multiplicity, and its copies go to its rows in turn; sources without words have target
0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Documents that one task pairs at a time, and residuals that meet in a node of the tree.
FAN = 256
_EPS = 1e-9


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, n, target)`` from rows ``(source, size, m)``: ``m`` rows alike.

    A source stops at ``most`` times its size. With sources in the order of ``most * size / weight``, the level at which
    the rest share what the stopped ones leave is largest at the right number of stopped sources.
    """
    by = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place - 1) % len(weights) + 1).cast("double"))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    by = by.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))))
    return by.select("source", "source_size", "n", F.least("cap", F.col("w") * F.max("level").over(everything)).alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11)).cast("double") / F.lit(float(1 << 53))


def _snap(x: Column) -> Column:
    return F.when(x < _EPS, 0.0).when(x > 1 - _EPS, 1.0).otherwise(x)


def _pair(acc: Column, item: Column, seed: int) -> Column:
    """One pivotal step between the carried document and the next."""
    a, b = acc["held"], item

    def moved(s: Column) -> Column:
        step = F.when(s["u"] * (s["up"] + s["down"]) < s["down"], s["up"]).otherwise(-s["down"])
        return F.struct(_snap(a["x"] + step).alias("xa"), _snap(b["x"] - step * s["ratio"]).alias("xb"))

    ratio = a["p"]["size"] / b["p"]["size"]
    state = F.struct(
        _uniform(a["p"]["key"], b["p"]["key"], F.lit(seed)).alias("u"), ratio.alias("ratio"),
        F.least(1 - a["x"], b["x"] / ratio).alias("up"), F.least(a["x"], (1 - b["x"]) / ratio).alias("down"),
    )

    def ended(m: Column) -> Column:
        at = lambda side, x: F.struct(side["p"].alias("p"), x.alias("x"))
        whole = lambda x: (x == 0) | (x == 1)
        na, nb = at(a, m["xa"]), at(b, m["xb"])
        held = F.when(~whole(m["xa"]), na).when(~whole(m["xb"]), nb)
        return F.struct(held.alias("held"), F.concat(acc["out"], F.filter(F.array(na, nb), lambda y: whole(y["x"]))).alias("out"))

    step = _let(state, lambda s: _let(moved(s), ended))
    return F.when(a.isNull(), F.struct(item.alias("held"), acc["out"].alias("out"))).otherwise(step)


def _level(items: DataFrame, seed: int) -> DataFrame:
    """Rows ``(source, g, p, x)`` to ``(source, g, held, out)``: one row a group."""
    grouped = items.groupBy("source", "g").agg(F.sort_array(F.collect_list(F.struct("p", "x"))).alias("items"))
    first = F.slice("items", 1, 1)
    start = F.struct(F.element_at(first, 1).alias("held"), F.filter(first, lambda y: F.lit(False)).alias("out"))
    rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
    folded = F.aggregate(rest, start, lambda acc, item: _pair(acc, item, seed))
    return grouped.select("source", "g", folded.alias("f")).select("source", "g", "f.held", "f.out")


def mix(rows: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 0) -> DataFrame:
    """Rows ``(key, source, size)`` to ``(key, source, size, m, copies, source_size, target)``.

    ``m`` equal rows take ``copies`` copies between them.
    """
    spark = rows.sparkSession
    items = written(rows.groupBy("key", "source", "size").agg(F.count(F.lit(1)).alias("m")), "mix-items")
    goals = written(targets(items, weights, share, most), "mix-targets")
    expected = F.when(F.col("source_size") > 0, F.col("m") * F.col("target") / F.col("source_size")).otherwise(0.0)
    to = F.broadcast(goals) if goals.count() <= 10_000 else goals
    marked = items.join(to, items.source.eqNullSafe(goals.source)).select("key", items.source, "size", "m", "n", expected.alias("e"))
    marked = marked.withColumn("whole", F.floor(F.col("e") + _EPS)).withColumn("x", _snap(F.col("e") - F.col("whole")))
    marked = marked.withColumn("x", F.when(F.col("size") > 0, F.col("x")).otherwise(0.0))
    p = F.struct("key", F.col("size").cast("double").alias("size"), "m", "whole").alias("p")
    settled = marked.where("x = 0").select("source", p, F.lit(0.0).alias("x"))
    open_ = marked.where("x > 0").select("source", p, "x", F.expr(f"pmod(xxhash64(key, size, {seed}), ceil(n / {FAN}))").alias("g"))
    groups = -(-(goals.agg(F.max("n")).first()[0] or 1) // FAN)
    results, depth = [settled], 0
    while True:
        depth += 1
        level = written(_level(open_, seed + depth), "mix-level")
        results.append(level.select("source", F.explode("out").alias("o")).select("source", "o.p", "o.x"))
        rest = level.where("held is not null").select("source", "held.p", "held.x", F.expr(f"g div {FAN}").alias("g"))
        if groups <= 1:
            break
        open_, groups = rest, -(-groups // FAN)
    results.append(rest.select("source", "p", F.when(_uniform(F.col("p.key"), F.lit(seed), F.lit("last")) < F.col("x"), 1.0).otherwise(0.0).alias("x")))
    done = results[0]
    for r in results[1:]:
        done = done.unionByName(r)
    return done.join(to, done.source.eqNullSafe(goals.source)).select(
        "p.key", done.source, F.col("p.size").cast("long").alias("size"), "p.m", (F.col("p.whole") + F.col("x")).cast("long").alias("copies"), "source_size", "target"
    )


def _numbered(rows: DataFrame, n: str, k: str, run: int = 1 << 16) -> DataFrame:
    """Each row ``n`` times, with its number ``k`` from 0. In runs, so that no long array is built."""
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {run}"))).alias("_run"))
    first = F.col("_run") * run
    return rows.select("*", F.explode(F.sequence(first, F.least(first + run, F.col(n)) - 1)).alias(k)).drop("_run")


def mix_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row."""
    rows = docs.select(F.col("doc_id").alias("key"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    mixed = _numbered(mix(rows), "m", "k")
    own = F.expr("copies div m") + (F.col("k") < F.col("copies") % F.col("m")).cast("long")
    return mixed.select(F.col("key").alias("doc_id"), "size", "source_size", "target", (own * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; all columns are kept, whatever their types. Rows that agree in
    all columns share their copies."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    key = F.struct("doc_id", F.xxhash64("text", "source", F.to_json(F.struct(*others)) if others else F.lit("")).alias("h"))
    rows = docs.select(key.alias("key"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    copies = mix(rows).select(F.col("key").alias("_key"), "m", "copies").where("copies > 0")
    kept = docs.select(key.alias("_key"), F.struct("*").alias("_row")).join(copies, "_key")
    alone = kept.where("m = 1").select("_row", "copies")
    # equal rows share their copies: those of one key are one row here, taken as often as all of them together
    equal = kept.where("m > 1").groupBy("_key").agg(F.any_value("_row").alias("_row"), F.max("copies").alias("copies")).select("_row", "copies")
    return _numbered(alone.union(equal), "copies", "_k").select("_row.*")
