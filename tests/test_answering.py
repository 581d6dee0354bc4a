"""Answering, repair, refresh and same-link clusters on small tables."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom import providers
from threadloom.operators import answering, refresh, vectors
from threadloom.providers import StubProvider


class Scripted(StubProvider):
    """Replies by task; ``None`` fails."""

    def __init__(self, **replies):
        super().__init__(16)
        self.replies = replies

    def chat_json(self, task, text):
        reply = self.replies[task]
        if reply is None:
            raise ValueError("down")
        return json.dumps(reply(text) if callable(reply) else reply)


@pytest.mark.parametrize("small,block", [(64, 4096), (1, 7), (1, 4096)])
def test_same_link_clusters_by_join_and_by_blocks(spark, small, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 8))
    rows = [(k, f"l{k % 2}", f"q{k // 3}" if k % 4 == 0 else f"u{k}", [float(v) for v in base[k % 6] + 0.3 * rng.normal(size=8)]) for k in range(40)] + [(99, "alone", "q", [1.0] * 8)]
    unit = {k: np.array(v) / np.linalg.norm(v) for k, _, _, v in rows}
    info = {k: (link, q) for k, link, q, _ in rows}
    near = lambda a, b: round(float(unit[a] @ unit[b]), 9) >= 0.9
    label = {k: k for k in info}
    for a in info:
        for b in info:
            if a < b and info[a][0] == info[b][0] and (near(a, b) or info[a][1] == info[b][1]) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    want = []
    for k, c in label.items():
        own = [x for x in label if label[x] == c]
        tight = all(near(a, b) for a in own for b in own if a < b)
        want.append((k, c, "keep" if len(own) == 1 else ("keep" if k == c else "drop") if tight else ("merge" if k == c else "merged")))
    df = spark.createDataFrame(rows, "pos long, link string, question string, embedding array<float>").withColumn("embedding", F.col("embedding").cast("array<double>"))
    # vectors as floats in both
    unit.update({r["pos"]: np.array(r["embedding"]) / np.linalg.norm(r["embedding"]) for r in df.collect()})
    assert sorted(map(tuple, vectors.same_link_clusters(df, 0.9, small, block).collect())) == sorted(want)
    assert vectors.same_link_clusters(df.where("false"), 0.9, small, block).count() == 0


def test_rewriting_asks_only_about_questions_with_a_history(spark):
    df = spark.createDataFrame([(1, "a?", [("user", "x"), ("assistant", "y")], None), (2, "b?", [], None), (3, "c?", None, "Z"), (4, "d?", [("user", "x")], None)], "query_id long, query string, history array<struct<role:string,content:string>>, city string")
    reply = lambda t: {"query": "" if t.endswith("d?") else " " + t.replace("\n", "|")}
    got = {x["query_id"]: x["search"] for x in answering.rewritten(df, Scripted(rewrite=reply)).collect()}
    assert got == {1: "Пользователь: x|Ассистент: y|Последнее сообщение пользователя: a?", 2: "b?", 3: "c?", 4: "d?"}
    assert {x["search"] for x in answering.rewritten(df, Scripted(rewrite=None)).collect()} == {"a?", "b?", "c?", "d?"}


def test_answers_cite_and_mask_private_contacts(spark):
    provider = Scripted(answer=lambda t: {"text": f"[CITY] see [1][7] {'MASKED' if 'XXXXXXXXX' in t else ''}{'EMPTY' if answering.NOTHING_FOUND in t else ''}"})
    units = spark.createDataFrame([("u1", "p", "fish soup", "call +995 555 123 456", "vote_based", "Batumi", "2024-05-01T00:00:00", "https://t.me/c/1/2")], "id string, chat string, question string, answer string, type string, city string, date string, link string")
    units = providers.embed(units, provider, "question")
    chats = spark.createDataFrame([("p", "Private", True)], "chat string, title string, private boolean")
    asked = spark.createDataFrame([(1, "fish soup", None), (2, "quite other words", None)], "query_id long, query string, city string").withColumn("history", F.lit(None).cast("array<struct<role:string,content:string>>"))
    asked = asked.withColumn("city", F.when(F.col("query_id") == 2, "Tbilisi"))
    got = {x["query_id"]: x for x in answering.answers(asked, units, chats, provider).collect()}
    assert got[1]["answer"] == "[CITY] see (🔒https://t.me/c/1/2, май 2024) MASKED" and [s["title"] for s in got[1]["sources"]] == ["Private"]
    assert got[2]["sources"] == [] and "EMPTY" in got[2]["answer"] and got[2]["answer"].endswith("📍 Ответ для города по умолчанию — Tbilisi. Сменить: /city") and "[CITY]" not in got[2]["answer"]


def test_judged_hits_keep_their_order_and_last_reply_wins(spark):
    queries = spark.createDataFrame([(1, "q")], "query_id long, query string")
    hits = spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "c", "d"), (1, 3, "e", "f")], "query_id long, rank int, question string, answer string")
    reply = {"results": [{"index": 0, "relevant": False}, {"index": 2, "relevant": True, "note": " n "}, {"index": 0, "relevant": True}]}
    got = [(x["rank"], x["relevant"], x["note"]) for x in answering.judge_hits(queries, hits, Scripted(relevance=reply)).orderBy("rank").collect()]
    assert got == [(1, True, ""), (2, None, ""), (3, True, "n")]


def test_fix_batch_routes_and_rescues(spark):
    units = spark.createDataFrame([("m", k % 2, k, f"q{k}", f"a{k}", "vote_based", None, k) for k in range(6)] + [("m", 9, 6, "q6", "a6", "vote_based", None, 9)], "chat string, root_msg_id long, pos long, question string, answer string, type string, city string, source_msg_id long")
    judged = spark.createDataFrame([(0, "keep", True, True), (1, "fix", True, True), (2, "fix", True, False), (3, "drop", False, True), (4, "drop", False, True), (5, "drop", True, True), (6, "drop", False, True)], "pos long, verdict string, faithful boolean, atomic boolean")
    judged = judged.withColumn("type_suggested", F.lit("date_based")).withColumn("city_suggested", F.lit("none"))
    texts = spark.createDataFrame([("m", 0, "t"), ("m", 1, "t")], "chat string, root_msg_id long, text string")
    provider = Scripted(reverify=lambda t: {"faithful": "q4" in t}, atomize={"items": [{"question": "x", "answer": "y"}, {"question": " ", "answer": "z"}, {"question": "v", "answer": "w"}]})
    out = refresh.fix_batch(units, judged, texts, provider)
    got = sorted((x["pos"], x["part"], x["question"], x["type"], x["outcome"]) for x in out.collect())
    assert got == [(0, 0, "q0", "vote_based", "kept"), (1, 0, "q1", "date_based", "fixed"), (2, 0, "x", "date_based", "fixed"), (2, 1, "v", "date_based", "fixed"), (3, 0, "q3", "vote_based", "dropped"), (4, 0, "q4", "vote_based", "rescued"), (5, 0, "q5", "vote_based", "dropped"), (6, 0, "q6", "vote_based", "dropped")]
    assert tuple(refresh.fix_summary(out).first()) == (2, 1, 3, 3)
    whole = refresh.atomize(units.where("pos = 2"), Scripted(atomize={"items": []}))
    assert [(x["question"], x["part"]) for x in whole.collect()] == [("q2", 0)]


def test_refresh_replaces_touched_threads_and_moves_the_cursor(spark):
    rows = [("c", 1, "2024-01-01 00:00:00", "old question", None), ("c", 2, "2024-01-01 00:01:00", "old answer", 1), ("c", 3, "2024-03-01 00:00:00", "new question", None), ("c", 4, "2024-03-01 00:01:00", "new answer", 3)]
    messages = spark.createDataFrame([(c, i, t, "s", x, r) for c, i, t, x, r in rows], "chat string, msg_id long, ts string, sender string, text string, reply_to long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    old = spark.createDataFrame([("c", 1, 1, "o1", "a", "vote_based", None, 1), ("c", 3, 2, "o3", "a", "vote_based", None, 3)], "chat string, root_msg_id long, pos long, question string, answer string, type string, city string, source_msg_id long")
    state = spark.createDataFrame([("c", "2024-02-20")], "chat string, p string").select("chat", F.col("p").cast("timestamp_ntz").alias("processed_until"))
    good = {"results": [{"index": 0, "faithful": True, "useful": True, "atomic": True}]}
    provider = Scripted(distill=lambda t: {"items": [{"question": t.split("\n")[0], "answer": "fresh"}]}, judge=good, atomize={"items": []}, reverify={})
    units, moved = refresh.refresh(messages, old, state, provider, "2024-03-02 00:00:00", "2024-01-01 00:00:00")
    assert sorted((x["root_msg_id"], x["question"], x["answer"]) for x in units.collect()) == [(1, "o1", "a"), (3, "[3] s: new question", "fresh")]
    assert [(x["chat"], str(x["processed_until"])) for x in moved.collect()] == [("c", "2024-03-02 00:00:00")]


def test_spam_split_and_seeded_sample(spark):
    df = spark.createDataFrame([(k, "bad" if k % 3 == 0 else "good") for k in range(30)], "id long, text string")
    clean, removed = refresh.split_spam(df, F.when(F.col("text") == "bad", "b"))
    assert clean.count() == 20 and removed.where("spam = 'b'").count() == 10
    one, two = (sorted(x["id"] for x in refresh.seeded(df.repartition(n), 7, "id", 3).collect()) for n in (1, 5))
    assert one == two and len(one) == 7
