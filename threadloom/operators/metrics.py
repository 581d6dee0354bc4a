"""Reports: verdicts, retrieval metrics over a parameter grid, usage.

A metric that has no cases is null. Rates in percent are cut to whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = ("faithful", "atomic", "useful", "type_ok", "city_ok")
KS = (4, 6, 8, 10, 15, 20)
THRESHOLDS = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7)


def verdict_report(judged: DataFrame, signals: tuple = SIGNALS) -> DataFrame:
    """``(name, n, percent)``: judged units by verdict, then how many each signal is true for."""
    rows = judged.where(F.col("verdict").isin("keep", "fix", "drop"))
    counts = [F.sum((F.col("verdict") == v).cast("long")).alias(v) for v in ("keep", "fix", "drop")] + [F.sum(F.coalesce(F.col(s), F.lit(False)).cast("long")).alias(s) for s in signals]
    names = ["keep", "fix", "drop", *signals]
    total = rows.agg(F.count(F.lit(1)).alias("total"), *counts)
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in names))
    return total.select("total", F.explode(pairs).alias("p")).select("p.name", "p.n", F.expr("100 * p.n div greatest(total, 1)").alias("percent"))


def sweep_grid(queries: DataFrame, hits: DataFrame, ks: tuple = KS, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """Metrics for every ``k`` and threshold from ``queries(query_id, category, subtype)`` and ``hits(query_id, rank, score, relevant)``.

    Counts are made once for each query and grid point from its own hits, kept as an array; queries without hits count.
    """
    grid = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(t)).alias("threshold")) for k in ks for t in thresholds))
    own = hits.where(F.col("rank") <= max(ks)).groupBy("query_id").agg(F.collect_list(F.struct("rank", "score", F.coalesce("relevant", F.lit(False)).alias("relevant"))).alias("hits"))
    rows = queries.join(own, "query_id", "left").select("query_id", "category", "subtype", F.explode(grid).alias("g"), "hits").select("*", "g.k", "g.threshold")
    hits_ = F.coalesce(F.col("hits"), F.array().cast("array<struct<rank:int,score:double,relevant:boolean>>"))
    n = lambda test: F.size(F.filter(hits_, test)).cast("long")
    rows = rows.select(
        "category", "subtype", "k", "threshold",
        n(lambda h: (h["rank"] <= F.col("k")) & (h["score"] >= F.col("threshold"))).alias("kept"),
        n(lambda h: (h["rank"] <= F.col("k")) & h["relevant"]).alias("relevant"),
        n(lambda h: (h["rank"] <= F.col("k")) & (h["score"] >= F.col("threshold")) & h["relevant"]).alias("good"),
    )
    some = (F.col("good") > 0).cast("double")
    # decimals add up alike in any order, so that a metric doesn't depend on how rows were dealt
    mean = lambda part, of: F.try_divide(F.sum(F.when(of > 0, part / of).cast("decimal(30,18)")).cast("double"), F.sum((of > 0).cast("long")))
    unanswerable, critical = F.col("category") == "no_answer", (F.col("category") == "critical") & ~F.col("subtype").eqNullSafe("scope_leakage")
    out = rows.groupBy("k", "threshold").agg(
        mean(F.col("good"), F.col("kept")).alias("precision"),
        mean(F.col("good"), F.col("relevant")).alias("recall"),
        F.avg(F.when(~unanswerable, some)).alias("hit_rate"),
        F.avg("kept").alias("avg_hits"),
        F.avg(F.when(unanswerable, some)).alias("no_answer_leak"),
        F.avg(F.when(critical, some)).alias("critical_hit_rate"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when((p > 0) & (r > 0), 2 * p * r / (p + r)))


def pick_best(grid: DataFrame) -> DataFrame:
    """The row with the largest F1 (null: 0), then the fewest hits, among those that leak nothing and miss nothing critical."""
    good = grid.where((F.coalesce("no_answer_leak", F.lit(0.0)) == 0) & (F.col("critical_hit_rate").isNull() | (F.col("critical_hit_rate") == 1)))
    return good.orderBy(F.desc(F.round(F.coalesce("f1", F.lit(0.0)), 12)), F.round("avg_hits", 12), "k", "threshold").limit(1)


def answer_fails(critical: Column, citation_left: Column, date_suspect: Column) -> Column:
    """Names of the checks that fail, from columns ``faithful``, ``relevant``, ``scope_ok`` and ``honest_uncertainty``."""
    no = lambda c: F.coalesce(~F.col(c), F.lit(False))
    tests = [(no("faithful"), "faithful"), (no("relevant"), "relevant"), (no("scope_ok"), "scope_ok"), (critical & no("honest_uncertainty"), "honest_uncertainty"), (citation_left, "citation_leftover"), (date_suspect, "date_suspect")]
    return F.filter(F.array(*(F.when(t, F.lit(n)) for t, n in tests)), lambda x: x.isNotNull())


def city_options(units: DataFrame, least: int = 5, excluded: tuple = ()) -> DataFrame:
    """``(city, n)`` of cities with enough units, most first (of a tie the one seen first)."""
    named = units.where(F.col("city").isNotNull() & (F.col("city") != ""))
    counts = named.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counts.where((F.col("n") >= least) & ~F.col("city").isin(*(excluded or ("",)))).orderBy(F.desc("n"), "first").select("city", "n")


def usage_by_user(log: DataFrame) -> DataFrame:
    """Questions of each ``(user_id, username)``."""
    return log.groupBy("user_id", "username").agg(F.count(F.lit(1)).alias("n"))


def usage_totals(log: DataFrame) -> DataFrame:
    """``(questions, users)``: all questions, and pairs of user and name."""
    return usage_by_user(log).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("questions"), F.count(F.lit(1)).alias("users"))


def supporters_of_day(supporters: DataFrame, day: str) -> DataFrame:
    """``(new_supporters, supporters)`` from ``supporters(key, value)``, the ISO time at which each came."""
    return supporters.agg(F.count_if(F.col("value").startswith(day)).alias("new_supporters"), F.count(F.lit(1)).alias("supporters"))


def drop_other_days(counters: DataFrame, day: str) -> DataFrame:
    """Counters ``(key, value)`` of one day: keys end with it."""
    return counters.where(F.col("key").endswith(day))


def daily_digest(log: DataFrame, day: str, top: int = 10) -> DataFrame:
    """The ``top`` users of a day with their last name, and the day's totals; of a tie the user seen first."""
    rows = log.where(F.col("ts").cast("string").startswith(day))
    users = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("username", "pos").alias("username"), F.min("pos").alias("first"))
    totals = rows.agg(F.count(F.lit(1)).alias("day_questions"), F.count_distinct("user_id").alias("day_users"))
    return users.orderBy(F.desc("n"), "first").limit(top).select("user_id", "username", "n").join(F.broadcast(totals))


def allowed_questions(log: DataFrame, limit: int = 5, supporter_limit: int = 100, supporters: DataFrame | None = None, exempt: tuple = ()) -> DataFrame:
    """Add ``nth`` question of the user's day and ``allowed``; exempt users aren't counted."""
    nth = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "pos"))
    rows = log.withColumn("nth", nth)
    most = F.lit(limit)
    if supporters is not None:
        rows = rows.join(supporters.select("user_id", F.lit(True).alias("_s")).distinct(), "user_id", "left")
        most = F.when(F.coalesce("_s", F.lit(False)), supporter_limit).otherwise(limit)
    free = F.col("user_id").isin(*exempt) if exempt else F.lit(False)
    return rows.withColumn("allowed", free | (F.col("nth") <= most)).withColumn("nth", F.when(~free, F.col("nth"))).drop("_s")


def history_tail(history: DataFrame, last: int = 20) -> DataFrame:
    """The last messages of each ``chat``, by ``seq``."""
    n = F.row_number().over(Window.partitionBy("chat").orderBy(F.desc("seq")))
    return history.withColumn("_n", n).where(F.col("_n") <= last).drop("_n")
