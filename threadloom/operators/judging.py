"""Judges: units against their threads, empty threads, answers; what follows from their raw signals is computed here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom import providers
from threadloom.functions.text import citation_left, city_or_null, date_outside_citation, strip
from threadloom.operators import answering, metrics, refresh
from threadloom.operators import units as un

# Headings of the prompts.
THREAD_HEAD, PAIRS_HEAD = "ТРЕД:\n", "\n\nПАРЫ:\n"
QUESTION_HEAD, FRAGMENTS_HEAD, ANSWER_HEAD, NO_FRAGMENTS = "ВОПРОС: ", "\n\nФРАГМЕНТЫ:\n", "\n\nОТВЕТ АССИСТЕНТА:\n", "(пусто — ничего не нашлось)"
KEYS = ["chat", "root_msg_id"]


def derived(judged: DataFrame) -> DataFrame:
    """Adds ``type_ok``, ``city_ok`` and ``verdict`` from the unit's ``type`` and ``city`` and the judge's raw signals.

    The type is right if the suggested one is the same (none suggested: unknown); cities are compared as normalized, none equals none.
    """
    suggested = F.nullif("type_suggested", F.lit(""))
    rows = judged.withColumn("city_suggested", city_or_null(F.coalesce("city_suggested", F.lit(""))))
    rows = rows.withColumn("type_ok", suggested == F.col("type")).withColumn("city_ok", F.col("city_suggested").eqNullSafe(city_or_null(F.coalesce("city", F.lit("")))))
    return rows.withColumn("verdict", un.verdict(*(F.col(c) for c in ("faithful", "useful", "atomic", "type_ok", "city_ok"))))


def judge_units(units: DataFrame, texts: DataFrame, provider) -> DataFrame:
    """``(chat, root_msg_id, pos, faithful, ..., verdict, note)`` for each unit: one call for each thread, over its text and its units
    in order. Answers are matched by their number, the last of equal numbers wins; units without one are errors. Units whose thread
    isn't in ``texts`` are errors as well."""
    numbered = units.withColumn("_i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos")) - 1)
    blocks = answering.joined(numbered, KEYS, F.col("_i"), answering.unit_block(F.col("_i")), "_b")
    prompts = blocks.join(texts.select(*KEYS, "text"), KEYS).select(*KEYS, F.concat(F.lit(THREAD_HEAD), "text", F.lit(PAIRS_HEAD), "_b").alias("_p"))
    asked = providers.ask(prompts, provider, "judge", "_p", f"results {providers.JUDGED}").where("error is null")
    flat = asked.select(*KEYS, F.posexplode("reply.results").alias("n", "r")).groupBy(*KEYS, F.col("r.index").alias("_i")).agg(F.max_by("r", "n").alias("r"))
    rows = numbered.join(flat, [*KEYS, "_i"], "left")
    rows = rows.select(*KEYS, "pos", "type", "city", *(F.col(f"r.{c}").alias(c) for c in ("faithful", "atomic", "useful", "type_suggested", "city_suggested")), strip(F.coalesce("r.note", F.lit(""))).alias("note"))
    return derived(rows)


def judge_recall(texts: DataFrame, provider) -> DataFrame:
    """``(chat, root_msg_id, thread_size, has_knowledge, missed)`` for threads ``(chat, root_msg_id, thread_size, text)``."""
    prompts = texts.select(*KEYS, "thread_size", F.concat(F.lit(THREAD_HEAD), "text").alias("_p"))
    asked = providers.ask(prompts, provider, "recall", "_p", "has_knowledge boolean, missed string")
    return asked.select(*KEYS, "thread_size", F.col("reply.has_knowledge").alias("has_knowledge"), strip(F.coalesce("reply.missed", F.lit(""))).alias("missed"))


def recall(threads: DataFrame, texts: DataFrame, units: DataFrame, provider, sample: int = 30, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Judged sample of the threads without units up to the last one that has some, and the report ``(sampled, total_empty, missed,
    percent)``. ``threads(chat, root_msg_id, thread_size)``; the sample is by hash, so reruns repeat it."""
    empty = un.empty_threads(threads, units)
    chosen = refresh.seeded(empty.withColumn("_key", F.concat_ws("_", "chat", F.col("root_msg_id").cast("string"))), sample, "_key", seed).drop("_key")
    judged = judge_recall(chosen.join(texts.select(*KEYS, "text"), KEYS), provider)
    return judged, recall_report(judged).join(F.broadcast(empty.agg(F.count(F.lit(1)).alias("total_empty"))))  # one row each


def recall_report(judged: DataFrame) -> DataFrame:
    """``(sampled, missed, percent)``: judged threads, those that had knowledge, and their share in whole percent."""
    counted = judged.agg(F.count(F.lit(1)).alias("sampled"), F.count_if("has_knowledge").alias("missed"))
    return counted.withColumn("percent", F.expr("100 * missed div greatest(sampled, 1)"))


def judge_answers(answered: DataFrame, provider) -> DataFrame:
    """``answered(query_id, query, critical, fragments, answer)`` with signals, notes, ``fails`` and ``verdict`` (pass or fail).

    ``fragments`` is the text of the blocks that the answer was made from, null or empty if nothing was found.
    """
    found = F.coalesce(F.nullif("fragments", F.lit("")), F.lit(NO_FRAGMENTS))
    prompt = F.concat(F.lit(QUESTION_HEAD), "query", F.lit(FRAGMENTS_HEAD), found, F.lit(ANSWER_HEAD), "answer")
    asked = providers.ask(answered.withColumn("_p", prompt), provider, "judge_answer", "_p", providers.ANSWER_JUDGED)
    names = ("faithful", "relevant", "scope_ok", "honest_uncertainty")
    notes = ("faithful_note", "relevant_note", "scope_note", "honest_uncertainty_note")
    rows = asked.select(*answered.columns, *(F.col(f"reply.{c}").alias(c) for c in names), *(strip(F.coalesce(f"reply.{c}", F.lit(""))).alias(c) for c in notes))
    rows = rows.withColumn("citation_leftover", citation_left(F.col("answer"))).withColumn("date_suspect", date_outside_citation(F.col("answer")))
    rows = rows.withColumn("fails", metrics.answer_fails(F.col("critical"), F.col("citation_leftover"), F.col("date_suspect")))
    return rows.withColumn("verdict", F.when(F.size("fails") > 0, "fail").otherwise("pass"))


def answer_report(judged: DataFrame) -> DataFrame:
    """``(name, n, percent)``: answers that are faithful, relevant and in scope, those with leftovers, and verdicts."""
    rates: list[tuple[str, Column]] = [(c, F.coalesce(F.col(c), F.lit(False))) for c in ("faithful", "relevant", "scope_ok", "citation_leftover", "date_suspect")]
    rates += [(v, F.col("verdict") == v) for v in ("pass", "fail")]
    total = judged.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(n) for n, c in rates))
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n, _ in rates))
    return total.select("total", F.explode(pairs).alias("p")).select("p.name", "p.n", F.expr("100 * p.n div greatest(total, 1)").alias("percent"))
