import pytest
from pyspark.sql import functions as F

from threadloom.functions import render, text
from threadloom.operators import metrics, units, vectors


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("message, reason", [
    (None, None), ("", None), ("Лёгкие деньги без вложений", "money"), ("подскажите, где легкие деньги", None), ("КУПЛЮ МЕФ", "drugs"),
    ("приглашаю в мой канал", "ads"), ("котята ищут дом", "pets"), ("котята ищут дом, приют", None), ("штраф 50 лари в сутки", None), ("отдам кошку, доход от 5", "money"),
])
def test_spam(spark, message, reason):
    assert one(spark, text.spam_reason(F.col("t")), t=F.lit(message).cast("string") if message is None else message) == reason


def test_masks(spark):
    masked = lambda t: one(spark, text.mask_contacts(F.col("t")), t=t)
    assert masked("call 12345678 or +995 (555) 123-456!") == "call 12345678 or XXXXXXXXXXXX!"
    assert masked("ask @abc and @abcd.") == "ask @abc and @username."
    assert masked("") == ""


def test_labels(spark):
    assert one(spark, text.month_label(F.col("t")), t="2026-09-19T10:00:00+00:00") == "сентябрь 2026"
    assert one(spark, text.month_label(F.col("t")), t="soon") == ""
    assert one(spark, text.url_label(F.col("u")), u="https://a.b:8080/x") == "a.b:8080"
    assert one(spark, text.chat_link(F.lit(True), F.lit(-1001234), F.lit("n"), F.lit(5)), u=1) == "https://t.me/c/1234/5"
    assert [one(spark, text.gap_label(F.lit(m)), u=1) for m in (59.9, 60.0, 1440.0)] == ["59 мин", "1.0 ч", "1.0 дн"]
    assert one(spark, text.strip(F.col("t")), t=" \t a b \n") == "a b"


def cited(spark, answer, hits):
    df = spark.createDataFrame([(answer, hits)], "t string, hits array<struct<link:string,date:string,title:string,private:boolean>>")
    x = df.select(render.inline_citations(F.col("t"), F.col("hits")).alias("c")).first()["c"]
    return x["text"], [s["link"] for s in x["sources"]]


def test_citations(spark):
    hits = [("l1", "май 2024", "t1", False), ("l2", "", "t2", True), ("l1", "июнь 2024", "t3", False), ("l2", None, "t4", True)]
    assert cited(spark, "x [1][2] y [1, z] w [9] [?]", hits) == ("x (l1, май 2024) (🔒l2) y w (не из чата)", ["l1", "l2"])
    assert cited(spark, "[2] [1]", hits) == (" (🔒l2) (l1, май 2024)", ["l1", "l2"])
    assert cited(spark, "a[1][3][4][2] b [99999999999999999999]", hits) == ("a (l1, май 2024) (l1, июнь 2024) (🔒l2) b ", ["l1", "l2"])  # one link with two dates is one source
    assert cited(spark, "no number [x] here", hits) == ("no number [x] here", [])
    assert cited(spark, None, None) == ("", []) and cited(spark, "[1]", []) == ("", [])
    assert cited(spark, "$1 \\ [2\nmore] end", hits) == ("$1 \\ (🔒l2) end", ["l2"])


def test_html(spark):
    assert render.to_html("a<b **c** https://x.y/z).") == 'a&lt;b <b>c</b> <a href="https://x.y/z">x.y</a>).'
    assert render.to_html("(🔒https://t.me/c/1/2, май 2024)") == '(🔒<a href="https://t.me/c/1/2">май 2024</a>)'
    df = spark.createDataFrame([(1, "**x**", [1]), (2, None, None)], "id int, t string, more array<int>")
    assert [tuple(x) for x in render.with_html(df, "t").orderBy("id").collect()] == [(1, "<b>x</b>", [1]), (2, None, None)]


def test_messages_to_guests_fit_with_question_and_note(spark):
    short = render.guest_html("a<b", "line")
    assert short == "❓ <i>a&lt;b</i>\n\nline"
    long = render.guest_html("q" * 300, "some line\n" * 2000)
    assert len(long) <= 3900 and long.startswith("❓ <i>qqq") and long.endswith(render.CONTINUED) and len(long) > 2500
    assert render.guest_html("q", "x" * 210, most=100).endswith(render.CONTINUED)  # at most 200 characters are left, fit or not
    df = spark.createDataFrame([("q", "a"), ("q", None)], "q string, a string")
    assert [x[0] for x in df.select(render.guest_html_column(F.col("q"), F.col("a"))).collect()] == ["❓ <i>q</i>\n\na", None]


def test_mentions_end_at_word_bounds(spark):
    assert one(spark, text.without_mention(F.col("t"), "bot"), t="@botanist hi @Bot yo") == "@botanist hi  yo"
    assert one(spark, text.without_mention(F.col("t"), "bot"), t="@botё @bot_1 @BOT.") == "@botё @bot_1 ."


def test_floor_and_deployment(spark):
    assert str(one(spark, text.fetch_floor(F.col("t").cast("timestamp_ntz")), t="2024-03-31 00:00:00")) == "2024-03-01 00:00:00"
    assert one(spark, text.fetch_floor(F.col("t").cast("timestamp_ntz")), t=None) is None
    assert [one(spark, text.deployment(F.col("m"), {"a": "b"}), m=m) for m in ("a", "c")] == ["b", "c"]


def test_message_records(spark):
    from threadloom.sources import tables

    raw = spark.createDataFrame([("c", 1, "d", "", "T", 5, " hi ", None, 99), ("c", 2, "d", None, None, 5, "x", 1, 99), ("c", 3, "d", "N", "T", 5, "  ", 1, 99), ("z", 4, "d", "N", "T", 5, "y", 1, 99)], "chat_username string, msg_id long, date string, first_name string, title string, sender_id long, text string, reply_to long, chat_id long")
    chats = spark.createDataFrame([("c", -1001234, "Chat", True)], "username string, chat_id long, title string, private boolean")
    got = {x["msg_id"]: x for x in tables.message_records(raw, chats).collect()}
    assert set(got) == {1, 2, 4} and (got[1]["sender"], got[1]["text"], got[1]["link"], got[1]["chat_title"]) == ("T", "hi", "https://t.me/c/1234/1", "Chat")
    assert got[2]["sender"] is None and got[4]["link"] == "https://t.me/z/4" and got[4]["chat_title"] is None


def test_verdicts(spark):
    cases = [(f, u, a, k, c) for f in (True, False, None) for u in (True, False, None) for a in (True, False, None) for k in (True, None) for c in (True, False)]
    df = spark.createDataFrame([(n, *c) for n, c in enumerate(cases)], "n int, f boolean, u boolean, a boolean, k boolean, c boolean")
    for x in df.select("*", units.verdict(*(F.col(c) for c in "fuakc")).alias("v")).collect():
        want = "drop" if x["f"] is False or x["u"] is False else "keep" if all(x[c] for c in "fuakc") else "fix" if x["f"] and x["u"] else "error"
        assert x["v"] == want


def test_index_diff(spark):
    a = spark.createDataFrame([("n", "1"), ("c", "2"), ("s", "3"), ("z", "4")], "id string, content_hash string")
    b = spark.createDataFrame([("c", "x"), ("s", "3"), ("r", "5"), ("z", None)], "id string, content_hash string")
    assert {x["id"]: x["action"] for x in units.index_diff(a, b).collect()} == {"n": "upsert", "c": "upsert", "s": "unchanged", "z": "upsert", "r": "delete"}


def test_same_link_clusters(spark):
    rows = [(1, "l", "q", [1.0, 0.0]), (2, "l", "q", [0.0, 1.0]), (3, "m", "a", [1.0, 0.0]), (4, "m", "b", [1.0, 0.05]), (5, "k", "a", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "pos bigint, link string, question string, embedding array<float>")
    got = {x["pos"]: (x["cluster"], x["action"]) for x in vectors.same_link_clusters(df).collect()}
    assert got == {1: (1, "merge"), 2: (1, "merged"), 3: (3, "keep"), 4: (3, "drop"), 5: (5, "keep")}


def test_pairs_by_blocks(spark):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if (u @ u.T)[i, j] >= 0.7}
    assert {(r["a"], r["b"]) for r in vectors.similar_pairs(df, 0.7, block=16).collect()} == want


def test_grid_counts_queries_without_hits(spark):
    q = spark.createDataFrame([("a", "critical", None), ("b", "one_answer", None), ("c", "no_answer", None)], "query_id string, category string, subtype string")
    h = spark.createDataFrame([("a", 1, 0.8, True), ("a", 2, 0.4, False), ("c", 1, 0.6, False)], "query_id string, rank int, score double, relevant boolean")
    x = metrics.sweep_grid(q, h, (4,), (0.5,)).first()
    assert (x["precision"], x["recall"], x["hit_rate"], x["no_answer_leak"], x["critical_hit_rate"]) == (0.5, 1.0, 0.5, 0.0, 1.0)
    assert abs(x["avg_hits"] - 2 / 3) < 1e-12 and metrics.pick_best(metrics.sweep_grid(q, h, (4,), (0.5,))).count() == 1


def test_scores_equal_in_six_digits_are_ties(spark):
    at = lambda c: [c, (1 - c * c) ** 0.5]
    rows = [(0, [1.0, 0.0]), (1, at(0.5000001)), (2, at(0.5000003)), (3, at(0.6234564999)), (4, at(-0.2))]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = [(x["id"], x["score"]) for x in vectors.top_k(df, df.where("id = 0"), 4, exclude_self=True, digits=6).orderBy("rank").collect()]
    assert got == [(3, 0.623456), (1, 0.5), (2, 0.5), (4, -0.2)]  # rounded once, and the smaller id first
    assert [x["id"] for x in vectors.top_k(df, df.where("id = 0"), 4, exclude_self=True).orderBy("rank").collect()] == [3, 2, 1, 4]


def test_vector_queries_rank_as_their_sql_does(spark, tmp_path):
    import duckdb

    from threadloom.plans import registry

    # all cosines to vector 0 tie in six digits, the largest last; the smallest id alone has the label of vector 0
    rows = [(0, [1.0, 0.0], "x")] + [(k, [0.9 + k * 1e-8, (1 - (0.9 + k * 1e-8) ** 2) ** 0.5], "x" if k == 1 else "y") for k in range(1, 31)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("sweep_grid", "cosine_topk", "search_threshold"):
        want = con.execute(registry.oracle_sql()[name])
        names = [d[0] for d in want.description]
        values = lambda rows: sorted(repr([None if v is None else round(float(v), 9) for v in r]) for r in rows)
        assert values([[r[n] for n in names] for r in registry.queries()[name](spark, str(tmp_path)).collect()]) == values(want.fetchall()), name


def test_grid_means_do_not_depend_on_the_order_of_rows(spark):
    import random
    from fractions import Fraction

    rng = random.Random(4)
    hits = [(q, r, 0.9 if r <= rng.randint(1, 20) else 0.1, rng.random() < 0.4) for q in range(700) for r in range(1, 21)]
    asked = spark.createDataFrame([(q, "critical", None) for q in range(700)], "query_id long, category string, subtype string")
    of = {q: [h for h in hits if h[0] == q] for q in range(700)}
    counts = [(sum(h[2] >= 0.5 for h in hs), sum(h[3] for h in hs), sum(h[3] and h[2] >= 0.5 for h in hs)) for hs in of.values()]
    mean = lambda pairs: float(sum(Fraction(a, b) for a, b in pairs if b) / sum(b > 0 for _, b in pairs))
    want = (mean([(g, k) for k, _, g in counts]), mean([(g, r) for _, r, g in counts]))
    for parts in (1, 7):
        rng.shuffle(hits)
        x = metrics.sweep_grid(asked.repartition(parts), spark.createDataFrame(hits, "query_id long, rank int, score double, relevant boolean"), (20,), (0.5,)).first()
        assert (x["precision"], x["recall"]) == want
