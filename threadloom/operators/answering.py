"""Questions to answers: rewriting, search, numbered blocks, generation, citations, judging.

Hits of a question are at most ``k`` rows, so lists of them are short. Questions are a stated set; units are the large side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import providers
from threadloom.functions import render, text
from threadloom.operators import vectors

# Words of the prompts, and the labels that a guest's message can get.
USER, ASSISTANT, LAST_MESSAGE = "Пользователь", "Ассистент", "Последнее сообщение пользователя: "
FRAGMENT, KIND, CITY, DATE, LINK, QUESTION, ANSWER = "Фрагмент", "тип", "город", "дата", "ссылка", "Вопрос", "Ответ"
NOTHING_FOUND = "(пусто — по этому вопросу в чатах ничего релевантного не нашлось)"
GUEST_LABELS = ("request", "thanks", "chatter", "mention")
NO_TOPIC = "(без темы)"


def joined(rows: DataFrame, keys: list[str], order: Column, block: Column, out: str, sep: str = "\n\n") -> DataFrame:
    """One text for each key: its blocks in order. For groups of bounded size."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("n"), block.alias("b"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["b"]), sep).alias(out))


def unit_block(number: Column) -> Column:
    """A unit for its judge; numbers from 0."""
    city = F.coalesce(F.nullif(F.col("city"), F.lit("")), F.lit("null"))
    return F.concat(F.lit("["), number.cast("string"), F.lit(f"] {QUESTION}: "), "question", F.lit(f"\n{ANSWER}: "), "answer", F.lit("\nТип: "), "type", F.lit("\nГород: "), city)


def candidate_block(number: Column) -> Column:
    """A hit for its judge; numbers from 0."""
    return F.concat(F.lit("["), number.cast("string"), F.lit(f"] {QUESTION}: "), "question", F.lit(f"\n{ANSWER}: "), "answer")


def fragment_block(number: Column, private: Column) -> Column:
    """A hit for the answering model; numbers from 1. Contacts are masked only where the unit's own chat is private."""
    city = F.when(F.coalesce("city", F.lit("")) != "", F.concat(F.lit(f", {CITY}: "), "city")).otherwise("")
    answer = F.when(private, text.mask_contacts(F.col("answer"))).otherwise(F.col("answer"))
    return F.concat(
        F.lit(f"[{FRAGMENT} "), number.cast("string"), F.lit(f"] {KIND}: "), "type", city, F.lit(f", {DATE}: "), F.coalesce("date", F.lit("")),
        F.lit(f"\n{LINK}: "), "link", F.lit(f"\n{QUESTION}: "), "question", F.lit(f"\n{ANSWER}: "), answer,
    )


def branches_text(branch_rows: DataFrame, branches: DataFrame) -> DataFrame:
    """Branches ``(chat, root_msg_id, branches)`` as text, from the rows of ``threads.branch_messages``: a topic, then its messages.

    Branches without known messages keep their topic line.
    """
    keys = ["chat", "root_msg_id"]
    topics = branches.select(*keys, F.posexplode("branches").alias("branch", "b"))
    topic = F.nullif(text.strip(F.coalesce("b.topic", F.lit(""))), F.lit(""))
    heads = topics.select(*keys, "branch", F.lit(-1).alias("pos"), F.concat(F.lit("### "), F.coalesce(topic, F.lit(NO_TOPIC))).alias("line"))
    sender = F.coalesce(F.nullif(F.col("sender").cast("string"), F.lit("")), F.lit(text.ANONYMOUS))
    reply = F.when(F.coalesce("reply_to", F.lit(0)) != 0, F.concat(F.lit(" ↩"), F.col("reply_to").cast("string"))).otherwise("")
    line = F.concat(F.lit("["), F.col("msg_id").cast("string"), F.lit("]"), reply, F.lit(" "), sender, F.lit(": "), F.coalesce("text", F.lit("")))
    lines = heads.union(branch_rows.select(*keys, "branch", "pos", line))
    return joined(lines, keys, F.struct("branch", "pos"), F.col("line"), "text", "\n")


def rewritten(questions: DataFrame, provider) -> DataFrame:
    """``(query_id, query, city, search)`` of ``questions(query_id, query, history array<struct<role, content>>, city)``.

    Only questions with a history are asked about; an empty or failed reply leaves the question as it is.
    """
    has = F.coalesce(F.size("history") > 0, F.lit(False))
    said = F.transform("history", lambda h: F.concat(F.when(h["role"] == "user", USER).otherwise(ASSISTANT), F.lit(": "), h["content"]))
    prompt = F.concat(F.array_join(said, "\n"), F.lit("\n" + LAST_MESSAGE), "query")
    asked = providers.ask(questions.where(has).select("query_id", "query", "city", prompt.alias("_p")), provider, "rewrite", "_p", "query string")
    search = F.coalesce(F.nullif(text.strip(F.col("reply.query")), F.lit("")), F.col("query"))
    return questions.where(~has).select("query_id", "query", "city", F.col("query").alias("search")).union(asked.select("query_id", "query", "city", search))


def guest_label(label: Column, query: Column, own: Column, replied: Column) -> Column:
    """``struct<label, query>``: unknown labels are requests; a request without a query takes the text, else what it replies to."""
    known = F.when(label.isin(*GUEST_LABELS), label).otherwise("request")
    clean = F.coalesce(text.strip(query), F.lit(""))
    fallback = F.coalesce(F.nullif(own, F.lit("")), F.nullif(replied, F.lit("")), F.lit(""))
    return F.struct(known.alias("label"), F.when((known == "request") & (clean == ""), fallback).otherwise(clean).alias("query"))


def classify_guests(messages: DataFrame, provider) -> DataFrame:
    """``messages(msg_id, text, replied_text)`` to ``(msg_id, label, query)``."""
    said = F.coalesce(F.col("text"), F.lit(""))
    prompt = F.concat(F.when(F.coalesce("replied_text", F.lit("")) != "", F.concat("replied_text", F.lit("\n\n"))).otherwise(""), said)
    asked = providers.ask(messages.select("msg_id", "text", "replied_text", prompt.alias("_p")), provider, "classify", "_p", "label string, query string")
    return asked.select("msg_id", guest_label(F.col("reply.label"), F.col("reply.query"), F.col("text"), F.col("replied_text")).alias("g")).select("msg_id", "g.*")


def answers(questions: DataFrame, units: DataFrame, chats: DataFrame, provider, k: int = 6, least: float = 0.55, cities: tuple = ()) -> DataFrame:
    """``(query_id, search, answer, sources, raw_text)`` of questions (see ``rewritten``).

    ``units(id, chat, question, answer, type, city, date, link, embedding)`` are searched with the question, to which the
    user's city is added unless it names a place; ``chats(chat, title, private)`` is a dimension of one row a chat.
    """
    known = F.array(*map(F.lit, cities)) if cities else F.expr("cast(array() as array<string>)")
    asked = rewritten(questions, provider).withColumn("_q", text.with_default_city(F.col("search"), F.col("city"), known))
    queries = providers.embed(asked, provider, "_q").withColumnRenamed("query_id", "id")
    found = vectors.top_k(units.select("id", "embedding"), queries.select("id", "embedding"), k, least)
    rows = found.join(units.drop("embedding"), "id").join(chats, "chat", "left").withColumn("private", F.coalesce("private", F.lit(False)))
    hit = F.struct("rank", F.col("link"), text.month_label(F.col("date")).alias("date"), F.coalesce("title", "chat").alias("title"), "private", fragment_block(F.col("rank"), F.col("private")).alias("block"))
    hits = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    own = asked.join(hits, "query_id", "left")
    blocks = F.array_join(F.transform("hits", lambda h: h["block"]), "\n\n")
    city = F.when(F.coalesce("city", F.lit("")) != "", F.concat(F.lit("\nГород пользователя по умолчанию: "), "city", F.lit("."))).otherwise("")
    prompt = F.concat(F.lit(f"{QUESTION}: "), "search", city, F.lit("\n\n"), F.coalesce(blocks, F.lit(NOTHING_FOUND)))
    plain = F.to_json(F.transform(F.coalesce("hits", F.expr("cast(array() as array<struct<rank:int,link:string,date:string,title:string,private:boolean,block:string>>)")), lambda h: F.struct(h["link"].alias("link"), h["date"].alias("date"), h["title"].alias("title"), h["private"].alias("private"))))
    said = providers.ask(own.select("query_id", "search", "city", plain.alias("_h"), prompt.alias("_p")), provider, "answer", "_p", "text string")
    shape = "array<struct<link:string,date:string,title:string,private:boolean>>"
    done = said.select("query_id", "search", "city", F.coalesce("reply.text", F.lit("")).alias("raw_text"), F.from_json("_h", shape).alias("_h"))
    done = done.withColumn("_c", render.inline_citations(F.col("raw_text"), F.col("_h")))
    return done.select("query_id", "search", city_note(F.col("_c.text"), F.col("city")).alias("answer"), F.col("_c.sources").alias("sources"), "raw_text")


def city_note(answer: Column, city: Column) -> Column:
    """The marker that the answer is for the user's own city becomes a note at the end."""
    marked = (F.coalesce(city, F.lit("")) != "") & F.contains(answer, F.lit(render.DEFAULT_CITY))
    bare = F.regexp_replace(F.replace(answer, F.lit(render.DEFAULT_CITY), F.lit("")), r"(?U)\s+$", "")
    return F.when(marked, F.concat(bare, F.lit("\n\n📍 Ответ для города по умолчанию — "), city, F.lit(". Сменить: /city"))).otherwise(answer)


def judge_hits(queries: DataFrame, hits: DataFrame, provider) -> DataFrame:
    """``hits(query_id, rank, question, answer)`` with ``relevant`` and ``note``: one call a query; of equal numbers the last wins."""
    blocks = joined(hits, ["query_id"], F.col("rank"), candidate_block(F.col("rank") - 1), "_b")
    prompts = queries.join(blocks, "query_id").select("query_id", F.concat(F.lit("ВОПРОС:\n"), "query", F.lit("\n\nФРАГМЕНТЫ:\n"), "_b").alias("_p"))
    asked = providers.ask(prompts, provider, "relevance", "_p", "results array<struct<index:int,relevant:boolean,note:string>>")
    flat = asked.select("query_id", F.posexplode("reply.results").alias("n", "r")).groupBy("query_id", (F.col("r.index") + 1).alias("rank")).agg(F.max_by("r", "n").alias("r"))
    return hits.join(flat, ["query_id", "rank"], "left").select(*hits.columns, F.col("r.relevant").alias("relevant"), text.strip(F.coalesce("r.note", F.lit(""))).alias("note"))
