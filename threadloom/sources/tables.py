"""Scans and sinks of the stored datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.storage import fresh_path


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def scan_json(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """JSON lines of a file, folder or glob. Blank lines are skipped; broken lines give nulls. Missing path: empty, or an error."""
    if not _exists(spark, path):
        if not missing_ok:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def scan_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """A JSON object as rows ``(key, value)``; a missing or corrupt file has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def message_records(raw: DataFrame, chats: DataFrame) -> DataFrame:
    """Raw messages ``(chat_username, msg_id, date, first_name, title, sender_id, text, reply_to)`` as records; empty texts go.

    The sender is the first name, else the title; empty ones count as missing. Further columns of ``raw`` don't matter.
    """
    from threadloom.functions.text import chat_link, strip

    own = F.struct(*(F.col(c) for c in ("chat_username", "msg_id", "date", "first_name", "title", "sender_id", "reply_to"))).alias("m")
    rows = raw.select(own, strip(F.coalesce(F.col("text"), F.lit(""))).alias("text")).where(F.length("text") > 0)
    known = chats.select(F.struct("username", "chat_id", "title", "private").alias("c"))
    rows = rows.join(F.broadcast(known), F.col("m.chat_username") == F.col("c.username"), "left")  # one row a configured chat
    sender = F.coalesce(F.nullif("m.first_name", F.lit("")), F.nullif("m.title", F.lit("")))
    link = chat_link(F.coalesce("c.private", F.lit(False)), F.col("c.chat_id"), F.col("m.chat_username"), F.col("m.msg_id"))
    return rows.select("m.chat_username", F.col("c.title").alias("chat_title"), "m.msg_id", "m.date", sender.alias("sender"), "m.sender_id", "text", "m.reply_to", link.alias("link"))


def messages_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored messages of a chat in the order of their ids."""
    return scan_json(spark, path, schema).orderBy("msg_id")


def golden(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """The golden queries, of one category or all; a missing file is an error."""
    from threadloom.schemas import GOLDEN

    rows = scan_json(spark, path, GOLDEN, missing_ok=False)
    return rows if category is None else rows.where(F.col("category") == category)


def read_cursors(spark: SparkSession, path: str) -> DataFrame:
    """``(chat, processed_until)``; none where there is no state yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "chat string, processed_until timestamp_ntz")
    return spark.read.parquet(path)


def write_cursors(state: DataFrame, path: str) -> None:
    replace_table(state, path)


def bootstrap_cursors(chats: DataFrame, now: str) -> DataFrame:
    """A cursor for each chat without processing anything."""
    return chats.select("chat").distinct().withColumn("processed_until", F.lit(now).cast("timestamp_ntz"))


def in_order(parts: list[DataFrame]) -> DataFrame:
    """Tables of several chats one after the other: ``chat_order`` keeps the configured order."""
    out = None
    for n, part in enumerate(parts):
        numbered = part.withColumn("chat_order", F.lit(n))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    return out


def newest(messages: DataFrame, since_id: int = 0, floor: str | None = None, limit: int = 50_000) -> DataFrame:
    """The ``limit`` newest messages above ``since_id`` and not before ``floor`` (ISO text): the pull of one ingest."""
    rows = messages.where(F.col("msg_id") > since_id)
    return (rows if floor is None else rows.where(F.col("date") >= floor)).orderBy(F.desc("msg_id")).limit(limit)


def last_ids(messages: DataFrame) -> DataFrame:
    """High-water mark of each chat."""
    return messages.groupBy("chat_username").agg(F.max("msg_id").alias("last_msg_id"))


def append_or_overwrite(df: DataFrame, path: str, fresh: bool) -> None:
    df.write.mode("overwrite" if fresh else "append").json(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Overwrite ``path`` with ``df``, which may read from it: it is staged in the shared folder first."""
    staged = fresh_path(df.sparkSession, "staged")
    df.write.parquet(staged)
    df.sparkSession.read.parquet(staged).write.mode("overwrite").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with equal keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
