"""Question-answer units: normalization, verdicts, routing, deduplication, incremental maintenance, index differences.

``pos`` is the explicit order of a unit; every "first" below means the smallest ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import city_or_null, content_hash, effective_link, is_non_answer, strip

KINDS = ("date_based", "vote_based")


def source_id(text: Column) -> Column:
    """Whole numbers, and numbers with a fraction cut toward zero when they come as numbers, else null."""
    return F.coalesce(text.try_cast("bigint"), F.when(text.rlike(r"^-?\d+\.\d+$"), text.try_cast("double").cast("bigint")))


def normalize(items: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Items ``(chat, root_msg_id, pos, question, answer, type, city, source_msg_id string)`` to units.

    Items without question or answer, and answers that say there is none, go. A source outside the thread (``members(chat,
    root_msg_id, msg_id)``) becomes the root.
    """
    rows = items.withColumn("question", strip(F.coalesce("question", F.lit("")))).withColumn("answer", strip(F.coalesce("answer", F.lit(""))))
    rows = rows.where((F.col("question") != "") & (F.col("answer") != "") & ~is_non_answer(F.col("answer")))
    kind = F.lower(strip(F.coalesce("type", F.lit("vote_based"))))
    rows = rows.withColumn("type", F.when(kind.isin(*KINDS), kind).otherwise("vote_based")).withColumn("city", city_or_null(F.col("city")))
    rows = rows.withColumn("source_msg_id", source_id(F.col("source_msg_id").cast("string")))
    if members is None:
        return rows.withColumn("source_msg_id", F.coalesce("source_msg_id", "root_msg_id"))
    inside = members.select("chat", "root_msg_id", F.col("msg_id").alias("source_msg_id"), F.lit(True).alias("_in"))
    return rows.join(inside, ["chat", "root_msg_id", "source_msg_id"], "left").withColumn("source_msg_id", F.when(F.col("_in"), F.col("source_msg_id")).otherwise(F.col("root_msg_id"))).drop("_in")


def thread_dates(threads: DataFrame) -> DataFrame:
    """``(chat, root_msg_id, date)``: date of the last message in the thread's order, else of the first, else empty."""
    ends = threads.groupBy("chat", "root_msg_id").agg(F.max(F.struct("thread_pos", "date")).alias("l"), F.min(F.struct("thread_pos", "date")).alias("f"))
    return ends.select("chat", "root_msg_id", F.coalesce(F.nullif("l.date", F.lit("")), F.nullif("f.date", F.lit("")), F.lit("")).alias("date"))


def verdict(faithful: Column, useful: Column, atomic: Column, type_ok: Column, city_ok: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    no = lambda c: F.coalesce(~c, F.lit(False))
    return (
        F.when(no(faithful) | no(useful), "drop")
        .when(yes(faithful) & yes(useful) & yes(atomic) & yes(type_ok) & yes(city_ok), "keep")
        .when(yes(faithful) & yes(useful), "fix")
        .otherwise("error")
    )


def route(units: DataFrame, judged: DataFrame) -> DataFrame:
    """Units with judgements of the same ``pos`` (in the same thread, where the judgements name it): adds ``action`` (keep, simple_fix, atomize, reverify, drop) and adopts suggestions."""
    keys = [c for c in ("chat", "root_msg_id", "pos") if c in judged.columns and c in units.columns]
    j = judged.select(*keys, "verdict", "faithful", "atomic", "type_suggested", "city_suggested")
    rows = units.join(j, keys, "left")
    fix, unfaithful = F.col("verdict") == "fix", F.coalesce(~F.col("faithful"), F.lit(False))
    action = F.when(F.col("verdict") == "keep", "keep").when(fix & F.coalesce(F.col("atomic"), F.lit(False)), "simple_fix").when(fix, "atomize").when((F.col("verdict") == "drop") & unfaithful, "reverify").otherwise("drop")
    suggested = F.lower(strip(F.coalesce("type_suggested", F.lit(""))))
    city = city_or_null(F.col("city_suggested"))
    rows = rows.withColumn("action", action).withColumn("type", F.when(fix & suggested.isin(*KINDS), suggested).otherwise(F.col("type"))).withColumn("city", F.when(fix, city).otherwise(F.col("city")))
    return rows.drop("verdict", "faithful", "atomic", "type_suggested", "city_suggested")


def first_of(rows: DataFrame, keys: list[Column], pos: str = "pos") -> DataFrame:
    """The row with the smallest ``pos`` of each key; ``pos`` is unique within a key. Partial minima before the shuffle, and a join
    whose key holds ``pos`` too, so a hot key is no hot task."""
    named = [k.alias(f"_k{n}") for n, k in enumerate(keys)]
    kept = rows.select(*named, F.col(pos).alias("_p")).groupBy(*(f"_k{n}" for n in range(len(keys)))).agg(F.min("_p").alias("_p"))
    same = F.col(f"_r.{pos}") == F.col("_p")
    for n, k in enumerate(keys):
        same = same & F.col(f"_r._k{n}").eqNullSafe(F.col(f"_f._k{n}"))
    marked = rows.select("*", *named).alias("_r")
    return marked.join(kept.alias("_f"), same, "left_semi").drop(*(f"_k{n}" for n in range(len(keys))))


def dedup_first(units: DataFrame) -> DataFrame:
    """First of units with equal root, question and answer, but for case and blanks at the ends."""
    return first_of(units, [F.col("chat"), F.col("root_msg_id"), F.lower(strip(F.col("question"))), F.lower(strip(F.col("answer")))])


def merge_replace(old: DataFrame, fresh: DataFrame, touched: DataFrame, keys: tuple = ("chat", "root_msg_id")) -> DataFrame:
    """Old units of untouched roots, and all fresh ones."""
    return old.join(touched.select(*keys).distinct(), list(keys), "left_anti").unionByName(fresh, allowMissingColumns=True)


def resume(threads: DataFrame, done: DataFrame, keys: tuple = ("chat", "root_msg_id")) -> DataFrame:
    """Threads whose root has no unit yet."""
    return threads.join(done.select(*keys).distinct(), list(keys), "left_anti")


def empty_threads(threads: DataFrame, units: DataFrame) -> DataFrame:
    """Threads without units up to the last root that produced some, chat by chat; none where nothing was produced."""
    last = units.groupBy("chat").agg(F.max("root_msg_id").alias("_last"))
    return resume(threads, units).join(F.broadcast(last), "chat").where("root_msg_id <= _last").drop("_last")


def affected_threads(threads: DataFrame, cursor: str, overlap_days: int = 3) -> DataFrame:
    """Threads with a message after the cursor less the overlap; threads without any time count."""
    latest = threads.groupBy("chat", "root_msg_id").agg(F.max("ts").alias("latest"))
    return latest.where(F.col("latest").isNull() | (F.col("latest") >= F.expr(f"timestamp_ntz '{cursor}' - interval {int(overlap_days)} days"))).select("chat", "root_msg_id")


def assign_ids(units: DataFrame) -> DataFrame:
    """Add ``id``: chat, root and the unit's number in its root (from 0)."""
    n = F.row_number().over(Window.partitionBy("chat", "root_msg_id").orderBy("pos")) - 1
    return units.withColumn("id", F.concat_ws("_", F.col("chat"), F.col("root_msg_id").cast("string"), n.cast("string")))


def with_hash(units: DataFrame) -> DataFrame:
    link = effective_link(F.col("source_link"), F.col("root_link"))
    return units.withColumn("content_hash", content_hash(F.col("question"), F.col("answer"), F.col("type"), F.col("city"), link))


def index_diff(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """``(id, action)`` from ``(id, content_hash)`` tables: delete, upsert or unchanged. A stored null hash means upsert."""
    a, b = wanted.select("id", F.col("content_hash").alias("_w"), F.lit(True).alias("_a")), stored.select("id", F.col("content_hash").alias("_s"), F.lit(True).alias("_b"))
    action = F.when(F.col("_a").isNull(), "delete").when(F.col("_b") & (F.col("_w") == F.col("_s")), "unchanged").otherwise("upsert")
    return a.join(b, "id", "full_outer").select("id", F.coalesce(action, F.lit("upsert")).alias("action"))


def apply_diff(stored: DataFrame, wanted: DataFrame, diff: DataFrame) -> DataFrame:
    """The index after the difference: unchanged rows as stored, upserted ones as wanted."""
    keep = diff.where("action = 'unchanged'").select("id")
    new = diff.where("action = 'upsert'").select("id")
    return stored.join(keep, "id", "left_semi").unionByName(wanted.join(new, "id", "left_semi"), allowMissingColumns=True)
