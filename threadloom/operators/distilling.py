"""Threads to items by models: branches, distilling (resumable), merging of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom import providers
from threadloom.operators import answering, vectors
from threadloom.operators import threads as th
from threadloom.sources.tables import _exists
from threadloom.storage import written

# Headings of the prompts.
SOURCE_HEAD = "ИСХОДНЫЙ ТРЕД (источник истины — опирайся на него):\n"
DRAFT_HEAD = "\n\nЧЕРНОВОЕ РАЗДЕЛЕНИЕ НА ВЕТКИ (может содержать ошибки, это только подсказка, не факт):\n"
VERSION = "Версия "
KEYS = ["chat", "root_msg_id"]


def split_branches(texts: DataFrame, provider) -> DataFrame:
    """``(chat, root_msg_id, branches)`` of thread texts; a failed or empty reply gives none."""
    asked = providers.ask(texts.select(*KEYS, "text"), provider, "branches", "text", f"branches {providers.BRANCHES}")
    return asked.select(*KEYS, F.coalesce("reply.branches", F.expr(f"cast(array() as {providers.BRANCHES})")).alias("branches"))


def _asked(texts: DataFrame, provider, branches: DataFrame | None, threads: DataFrame | None) -> DataFrame:
    """``(chat, root_msg_id, text, reply, error)``: one call for each thread, with the draft of its branches where there are some."""
    rows = texts.select(*KEYS, "text")
    if branches is not None:
        some = branches.where(F.size("branches") > 0)
        drafts = answering.branches_text(th.branch_messages(some, threads), some).select(*KEYS, F.col("text").alias("_d"))
        prompt = F.when(F.coalesce("_d", F.lit("")) != "", F.concat(F.lit(SOURCE_HEAD), "text", F.lit(DRAFT_HEAD), "_d")).otherwise(F.col("text"))
        rows = rows.join(drafts, KEYS, "left").select(*KEYS, prompt.alias("text"))
    return providers.ask(rows, provider, "distill", "text", f"items {providers.UNIT_ITEMS}")


def _items(asked: DataFrame) -> DataFrame:
    return asked.where("error is null").select(*KEYS, F.posexplode("reply.items").alias("k", "i")).select(*KEYS, "k", "i.*")


def distill(texts: DataFrame, provider, branches: DataFrame | None = None, threads: DataFrame | None = None) -> DataFrame:
    """Thread texts ``(chat, root_msg_id, text)`` to items ``(chat, root_msg_id, k, ...)``, ``k`` their place in the reply.

    With ``branches`` (see ``split_branches``) and the ``threads`` they point into, the model gets the thread and the draft of its
    branches; threads without branches go as they are. Failed threads give no items.
    """
    return _items(_asked(texts, provider, branches, threads))


def distill_saved(texts: DataFrame, provider, path: str, steps: int = 8, branches: DataFrame | None = None, threads: DataFrame | None = None) -> DataFrame:
    """``distill`` in steps that are kept in ``path``: a run that was broken off goes on with the threads that aren't done.

    Threads without items are done too; threads whose call failed are not, and are asked again.
    """
    spark, items, done = texts.sparkSession, f"{path}/items", f"{path}/done"
    left = texts if not _exists(spark, done) else texts.join(spark.read.parquet(done), KEYS, "left_anti")
    left = written(left.withColumn("_s", F.pmod(F.xxhash64(*KEYS), F.lit(steps))), "distill-left")
    for k in range(steps):
        reply = written(_asked(left.where(F.col("_s") == k).drop("_s"), provider, branches, threads), "distill-step")
        _items(reply).write.mode("append").parquet(items)
        reply.where("error is null").select(*KEYS).write.mode("append").parquet(done)
    # a step that was broken off between its two writes is asked again; equal items of a place count once
    return spark.read.parquet(items).dropDuplicates([*KEYS, "k"])


def merge_clusters(units: DataFrame, provider) -> DataFrame:
    """One unit for each ``cluster`` of ``units(cluster, pos, question, answer, date, ...)``: the member with the latest date, with the
    question and answer that the model makes of all versions; where it gives none, its own. Units alone aren't asked about."""
    base = vectors.merge_record(units)
    sizes = units.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    numbered = units.join(sizes, "cluster").withColumn("_i", F.row_number().over(Window.partitionBy("cluster").orderBy("pos")))
    version = F.concat(F.lit(VERSION), F.col("_i").cast("string"), F.lit(f":\n{answering.QUESTION}: "), "question", F.lit(f"\n{answering.ANSWER}: "), "answer")
    asked = providers.ask(answering.joined(numbered, ["cluster"], F.col("_i"), version, "_p"), provider, "merge", "_p", "question string, answer string")
    filled = lambda c: F.coalesce(F.col(f"reply.{c}"), F.lit("")) != ""
    good = asked.where(filled("question") & filled("answer")).select("cluster", F.col("reply.question").alias("_q"), F.col("reply.answer").alias("_a"))
    rows = base.join(good, "cluster", "left").withColumn("question", F.coalesce("_q", "question")).withColumn("answer", F.coalesce("_a", "answer"))
    return rows.select(*units.columns)
