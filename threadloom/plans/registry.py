"""All registered queries over the driver's tables, and their SQL.

Messages are the events of one chat: an event answers the one ``k`` before it (``k`` from its properties, 1 to 3). Units are
question and answer turns of conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import render, text
from threadloom.operators import answering, distilling, judging, metrics, refresh, threads, units, vectors
from threadloom.providers import StubProvider
from threadloom.sources import tables
from threadloom.storage import fresh_path, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("bigint")
    return _table(spark, sf_dir, "events").select(
        F.lit("main").alias("chat"), F.col("event_id").alias("msg_id"), "ts", F.col("user_id").alias("sender"), F.col("event_type").alias("text"), F.when(k.between(1, 3), F.col("event_id") - k).alias("reply_to")
    )


_M = """m AS (SELECT 'main' AS chat, event_id AS msg_id, ts, user_id AS sender, event_type AS text,
  CASE WHEN try_cast(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) BETWEEN 1 AND 3 THEN event_id - try_cast(regexp_extract(props, '"k": *(\\d+)', 1) AS BIGINT) END AS reply_to FROM events)"""
_B = _M + """, g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY msg_id)) > 600000000 THEN 1 ELSE 0 END AS new FROM m),
b AS (SELECT *, (sum(new) OVER (ORDER BY msg_id))::BIGINT AS burst FROM g),
c AS (SELECT *, (row_number() OVER (PARTITION BY burst ORDER BY msg_id) - 1) // 50 AS chunk FROM b),
h AS (SELECT *, min(msg_id) OVER (PARTITION BY burst, chunk) AS head FROM c)"""
_R = _B + """, e AS (SELECT r.msg_id AS a, p.msg_id AS b FROM m r JOIN m p ON r.reply_to = p.msg_id WHERE r.msg_id <> p.msg_id UNION SELECT msg_id, head FROM h WHERE msg_id <> head),
e2 AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT msg_id AS n, msg_id AS r FROM m UNION SELECT e2.a, reach.r FROM reach JOIN e2 ON e2.b = reach.n WHERE reach.r < e2.a),
comp AS (SELECT n AS msg_id, min(r) AS component FROM reach GROUP BY n)"""


_T = _R + """, sz AS (SELECT component, count(*) AS n FROM comp GROUP BY component),
big AS (SELECT m.msg_id, c.component, m.reply_to FROM m JOIN comp c USING (msg_id) JOIN sz USING (component) WHERE sz.n > 50),
be AS (SELECT a.msg_id AS a, b.msg_id AS b FROM big a JOIN big b ON a.reply_to = b.msg_id AND a.component = b.component AND a.msg_id <> b.msg_id), be2 AS (SELECT a, b FROM be UNION SELECT b, a FROM be),
isle AS (SELECT msg_id AS n, msg_id AS r FROM big UNION SELECT be2.a, isle.r FROM isle JOIN be2 ON be2.b = isle.n WHERE isle.r < be2.a),
blk AS (SELECT n AS msg_id, min(r) AS block FROM isle GROUP BY n),
bs AS (SELECT component, block, count(*) AS size, row_number() OVER (PARTITION BY component ORDER BY block) AS k FROM big JOIN blk USING (msg_id) GROUP BY component, block),
walk AS (SELECT component, block, size, k, 0::BIGINT AS bin, 0::BIGINT AS off FROM bs WHERE k = 1
  UNION ALL SELECT s.component, s.block, s.size, s.k,
    CASE WHEN w.size > 50 THEN w.bin + (w.size + 49) // 50 + CASE WHEN w.off > 0 AND w.off + s.size > 50 THEN 1 ELSE 0 END WHEN w.off + w.size > 0 AND w.off + w.size + s.size > 50 THEN w.bin + 1 ELSE w.bin END,
    CASE WHEN w.size > 50 THEN CASE WHEN w.off > 0 AND w.off + s.size > 50 THEN 0 ELSE w.off END WHEN w.off + w.size + s.size > 50 THEN 0 ELSE w.off + w.size END
  FROM walk w JOIN bs s ON s.component = w.component AND s.k = w.k + 1),
pl AS (SELECT b.msg_id, b.component, w.size, w.bin, w.off, row_number() OVER (PARTITION BY b.component, k.block ORDER BY b.msg_id) - 1 AS p FROM big b JOIN blk k USING (msg_id) JOIN walk w ON w.component = b.component AND w.block = k.block),
pk AS (SELECT msg_id, component, bin + CASE WHEN size > 50 THEN p // 50 ELSE 0 END AS bin, CASE WHEN size > 50 THEN p % 50 ELSE off + p END AS thread_pos FROM pl),
th AS (SELECT msg_id, max(CASE WHEN thread_pos = 0 THEN msg_id END) OVER (PARTITION BY component, bin) AS root_msg_id, thread_pos FROM pk
  UNION ALL SELECT msg_id, component, row_number() OVER (PARTITION BY component ORDER BY msg_id) - 1 FROM comp JOIN sz USING (component) WHERE sz.n <= 50)"""


@query("WITH " + _B + " SELECT chat, count(DISTINCT burst) AS n_bursts, count(*) AS n_messages, (SELECT max(n) FROM (SELECT count(*) AS n FROM b GROUP BY burst)) AS max_burst FROM b GROUP BY chat")
def burst_stats(spark, sf_dir):
    sizes = threads.bursts(messages(spark, sf_dir)).groupBy("chat", "burst").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("chat").agg(F.count(F.lit(1)).alias("n_bursts"), F.sum("n").alias("n_messages"), F.max("n").alias("max_burst"))


@query("WITH " + _B + " SELECT chat, msg_id, burst, chunk, head FROM h")
def burst_chunks(spark, sf_dir):
    return threads.burst_chunks(threads.bursts(messages(spark, sf_dir))).select("chat", "msg_id", "burst", "chunk", "head")


@query("WITH " + _M + " SELECT r.chat, r.msg_id, p.msg_id AS parent FROM m r JOIN m p ON r.reply_to = p.msg_id WHERE r.msg_id <> p.msg_id")
def reply_edges(spark, sf_dir):
    return threads.reply_edges(messages(spark, sf_dir))


@query("WITH RECURSIVE " + _R + " SELECT 'main' AS chat, msg_id, component FROM comp")
def thread_components(spark, sf_dir):
    return threads.thread_components(messages(spark, sf_dir)).select("chat", "msg_id", "component")


@query("WITH RECURSIVE " + _T + " SELECT 'main' AS chat, sum(n)::BIGINT AS n_messages, count(*) AS n_threads, count(*) FILTER (n > 1) AS n_multi, max(n) AS max_size FROM (SELECT root_msg_id, count(*) AS n FROM th GROUP BY root_msg_id)")
def thread_stats(spark, sf_dir):
    return threads.thread_stats(threads.build_threads(messages(spark, sf_dir)))


@query("WITH RECURSIVE " + _T + " SELECT 'main' AS chat, msg_id, root_msg_id, thread_pos FROM th")
def thread_split(spark, sf_dir):
    return threads.build_threads(messages(spark, sf_dir)).select("chat", "msg_id", "root_msg_id", "thread_pos")


@query("WITH RECURSIVE " + _T + ", s AS (SELECT 'main' AS chat, root_msg_id, count(*) AS size, max(ts) AS latest FROM th JOIN m USING (msg_id) GROUP BY root_msg_id) SELECT * FROM s WHERE size >= 2 AND latest >= TIMESTAMP '2024-01-02'")
def thread_select_recent(spark, sf_dir):
    return threads.select_threads(threads.build_threads(messages(spark, sf_dir)), 2, "2024-01-02")


_BT = _T + """, t AS (SELECT m.*, th.root_msg_id, th.thread_pos + 1 AS thread_pos FROM m JOIN th USING (msg_id))"""


def _threads(spark, sf_dir) -> DataFrame:
    """All messages in their threads, places from 1; written once, since some queries read it twice."""
    return written(threads.build_threads(messages(spark, sf_dir)).withColumn("thread_pos", F.col("thread_pos") + 1), "threads")


@query("WITH RECURSIVE " + _BT + """, p AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY root_msg_id ORDER BY thread_pos))) / 60000000 AS gap FROM t)
SELECT chat, msg_id, gap AS gap_minutes, CASE WHEN gap < 60 THEN printf('%d мин', floor(gap)::INT) WHEN gap < 1440 THEN printf('%.1f ч', gap / 60) ELSE printf('%.1f дн', gap / 1440) END AS pause FROM p WHERE gap >= 5""")
def pause_markers(spark, sf_dir):
    return threads.pause_markers(_threads(spark, sf_dir), 5).where("gap_minutes is not null").select("chat", "msg_id", "gap_minutes", "pause")


@query("WITH RECURSIVE " + _BT + """, p AS (SELECT *, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY root_msg_id ORDER BY thread_pos))) / 60000000 AS gap FROM t)
SELECT chat, root_msg_id, string_agg(CASE WHEN gap >= 30 THEN '— пауза ' || CASE WHEN gap < 60 THEN printf('%d мин', floor(gap)::INT) WHEN gap < 1440 THEN printf('%.1f ч', gap / 60) ELSE printf('%.1f дн', gap / 1440) END || ' —' || chr(10) ELSE '' END
  || '[' || msg_id || ']' || CASE WHEN coalesce(reply_to, 0) <> 0 THEN ' ↩' || reply_to ELSE '' END || ' ' || sender || ': ' || text, chr(10) ORDER BY thread_pos) AS text FROM p GROUP BY chat, root_msg_id""")
def thread_text(spark, sf_dir):
    return threads.thread_text(_threads(spark, sf_dir))


_WORDS = [("licence", ["licen[sc]e", "copyright"]), ("contact", [r"@\w+\.\w+"]), ("insult", ["idiot", "stupid", "moron"])]


@query(r"""SELECT spam, count(*) AS n FROM (SELECT CASE WHEN text = '' OR regexp_matches(text, '(?i)\?\?') THEN NULL WHEN regexp_matches(text, '(?i)licen[sc]e|copyright') THEN 'licence'
  WHEN regexp_matches(text, '(?i)@[\p{L}\p{N}_]+\.[\p{L}\p{N}_]+') THEN 'contact' WHEN regexp_matches(text, '(?i)idiot|stupid|moron') THEN 'insult' END AS spam FROM documents) WHERE spam IS NOT NULL GROUP BY spam""")
def spam_counts(spark, sf_dir):
    reason = text.spam_reason(F.col("text"), _WORDS, r"\?\?", {})
    return _table(spark, sf_dir, "documents").select(reason.alias("spam")).where("spam is not null").groupBy("spam").agg(F.count(F.lit(1)).alias("n"))


#: Texts that stand for a category of unwanted messages each, or for none.
_SAID = [
    ("легкие деньги каждому", "money"), ("Пассивный доход от 100", "money"), ("набираю команду людей", "money"), ("подскажите, где легкие деньги", None), ("закладки и мефедрон", "drugs"), ("автошоп рядом", "drugs"),
    ("подписывайся на канал", "ads"), ("бесплатный вебинар завтра", "ads"), ("котёнок в добрые руки", "pets"), ("отдам щенка в добрые руки, есть приют", None), ("обычный разговор о погоде", None), ("", None), ("ЛЕГКИЕ ДЕНЬГИ", "money"),
]


@query("SELECT doc_id, spam FROM (SELECT doc_id, [" + ", ".join("NULL" if c is None else f"'{c}'" for _, c in _SAID) + f"][doc_id % {len(_SAID)} + 1] AS spam FROM documents) WHERE spam IS NOT NULL")
def spam_reasons(spark, sf_dir):
    """The real pattern table on texts of known categories."""
    said = F.element_at(F.array(*(F.lit(t) for t, _ in _SAID)), (F.col("doc_id") % len(_SAID) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.spam_reason(said).alias("spam")).where("spam is not null")


#: Texts with contacts, and what is left of them.
_CONTACTS = [("call +995 (555) 12-34-56 now", "call XXXXXXXXXXXX now"), ("in 12345678 days", "in 12345678 days"), ("write @someone or @abc", "write @username or @abc"), ("a 123456789 b 2024-01-02", "a XXXXXXXXX b 2024-01-02"), ("nothing", "nothing")]


@query("SELECT doc_id, [" + ", ".join(f"'{m}'" for _, m in _CONTACTS) + f"][doc_id % {len(_CONTACTS)} + 1] AS masked FROM documents")
def mask_fixed(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(t) for t, _ in _CONTACTS)), (F.col("doc_id") % len(_CONTACTS) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.mask_contacts(said).alias("masked"))


#: Texts with mentions, and what is left without those of the bot.
_MENTIONS = [("@bot hi", "hi"), ("@botanist hi @BOT yo", "@botanist hi  yo"), ("no mention", "no mention"), ("x@bot.", "x.")]


@query("SELECT doc_id, [" + ", ".join(f"'{m}'" for _, m in _MENTIONS) + f"][doc_id % {len(_MENTIONS)} + 1] AS text FROM documents")
def mention_strip(spark, sf_dir):
    said = F.element_at(F.array(*(F.lit(t) for t, _ in _MENTIONS)), (F.col("doc_id") % len(_MENTIONS) + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", text.without_mention(said, "bot").alias("text"))


@query()
def mask_contacts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", text.mask_contacts(F.col("text")).alias("masked"))
    return docs.where("masked <> text").select("doc_id", "masked")


def _units(spark, sf_dir) -> DataFrame:
    """Each assistant turn answers the turn before it."""
    rows = _table(spark, sf_dir, "conversations")
    answers = rows.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    pairs = rows.where("role <> 'assistant'").select("conv_id", "turn", F.col("text").alias("question")).join(answers, ["conv_id", "turn"])
    return pairs.select(F.lit("main").alias("chat"), F.col("conv_id").alias("root_msg_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "question", "answer", F.when(F.col("turn") % 3 == 0, " Date_Based ").otherwise("other").alias("type"),
                        F.when(F.col("turn") % 4 == 0, " NULL ").otherwise(F.concat(F.lit("city"), F.col("conv_id") % 7)).alias("city"), F.col("turn").cast("string").alias("source_msg_id"))


_U = """u AS (SELECT 'main' AS chat, q.conv_id AS root_msg_id, q.conv_id * 1000 + q.turn AS pos, trim(q.text, ' ' || chr(10) || chr(9)) AS question, trim(a.text, ' ' || chr(10) || chr(9)) AS answer,
  CASE WHEN q.turn % 3 = 0 THEN 'date_based' ELSE 'vote_based' END AS type, CASE WHEN q.turn % 4 <> 0 THEN 'city' || (q.conv_id % 7) END AS city, q.turn AS source_msg_id
  FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role <> 'assistant' AND trim(q.text) <> '' AND trim(a.text) <> '')"""


@query("WITH " + _U + " SELECT * FROM u")
def unit_normalize(spark, sf_dir):
    return units.normalize(_units(spark, sf_dir)).select("chat", "root_msg_id", "pos", "question", "answer", "type", "city", "source_msg_id")


def _judged(spark, sf_dir) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = docs.select("doc_id").join(labels, "doc_id", "left")
    faithful, useful = F.col("quality") == 1, F.col("toxic") == 0
    atomic, kind_ok = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 3 != 0), F.when(F.col("doc_id") % 7 != 0, F.lit(True))
    rows = rows.select("doc_id", faithful.alias("faithful"), useful.alias("useful"), atomic.alias("atomic"), kind_ok.alias("type_ok"), F.lit(True).alias("city_ok"))
    return rows.withColumn("verdict", units.verdict(*(F.col(c) for c in ("faithful", "useful", "atomic", "type_ok", "city_ok"))))


_J = """j AS (SELECT *, CASE WHEN faithful = false OR useful = false THEN 'drop' WHEN faithful AND useful AND atomic AND type_ok AND city_ok THEN 'keep' WHEN faithful AND useful THEN 'fix' ELSE 'error' END AS verdict FROM (
  SELECT doc_id, quality = 1 AS faithful, toxic = 0 AS useful, CASE WHEN doc_id % 5 <> 0 THEN doc_id % 3 <> 0 END AS atomic, CASE WHEN doc_id % 7 <> 0 THEN true END AS type_ok, true AS city_ok FROM documents LEFT JOIN labels USING (doc_id)))"""


@query("WITH " + _J + " SELECT doc_id, verdict FROM j")
def verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "verdict")


@query("WITH " + _J + """, r AS (SELECT * FROM j WHERE verdict IN ('keep', 'fix', 'drop')), t AS (SELECT greatest(count(*), 1) AS total FROM r),
n AS (SELECT verdict AS name, count(*) AS n FROM r GROUP BY verdict UNION ALL SELECT 'faithful', count(*) FILTER (faithful) FROM r UNION ALL SELECT 'atomic', count(*) FILTER (atomic) FROM r UNION ALL SELECT 'useful', count(*) FILTER (useful) FROM r UNION ALL SELECT 'type_ok', count(*) FILTER (type_ok) FROM r UNION ALL SELECT 'city_ok', count(*) FILTER (city_ok) FROM r)
SELECT name, n, 100 * n // total AS percent FROM n, t""")
def verdict_report(spark, sf_dir):
    return metrics.verdict_report(_judged(spark, sf_dir))


@query("WITH " + _J + """ SELECT doc_id AS pos, CASE WHEN verdict = 'keep' THEN 'keep' WHEN verdict = 'fix' AND atomic THEN 'simple_fix' WHEN verdict = 'fix' THEN 'atomize' WHEN verdict = 'drop' AND faithful = false THEN 'reverify' ELSE 'drop' END AS action,
  CASE WHEN verdict = 'fix' AND doc_id % 2 = 0 THEN 'date_based' ELSE 'vote_based' END AS type, CASE WHEN verdict = 'fix' THEN CASE WHEN doc_id % 3 = 0 THEN 'B' || doc_id END ELSE 'A' END AS city FROM j""")
def fix_routing(spark, sf_dir):
    """Fixes adopt the suggested type, if it is one, and the suggested city, also where it is none."""
    judged = _judged(spark, sf_dir).withColumnRenamed("doc_id", "pos").withColumn("type_suggested", F.when(F.col("pos") % 2 == 0, " Date_Based ").otherwise("other"))
    judged = judged.withColumn("city_suggested", F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" B"), F.col("pos").cast("string"))).otherwise("None"))
    own = judged.select("pos", F.lit("vote_based").alias("type"), F.lit("A").alias("city"))
    return units.route(own, judged).select("pos", "action", "type", "city")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, lower(regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g'))")
def dedup_first(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "pos")
    return units.first_of(docs, [F.col("source"), F.lower(text.strip(F.col("text")))]).select(F.col("pos").alias("doc_id"))


@query("WITH " + _U + " SELECT pos, CASE WHEN root_msg_id % 4 = 0 THEN 'fresh' ELSE 'old' END AS origin FROM u WHERE root_msg_id % 8 <> 0")
def merge_replace(spark, sf_dir):
    all_ = units.normalize(_units(spark, sf_dir))
    touched = all_.where("root_msg_id % 4 = 0").select("chat", "root_msg_id")
    fresh = all_.where("root_msg_id % 4 = 0 and root_msg_id % 8 <> 0").withColumn("origin", F.lit("fresh"))
    return units.merge_replace(all_.withColumn("origin", F.lit("old")), fresh, touched).select("pos", "origin")


@query("WITH " + _U + " SELECT DISTINCT conv_id AS root_msg_id FROM conversations WHERE conv_id NOT IN (SELECT root_msg_id FROM u WHERE root_msg_id % 3 = 0)")
def resume_anti(spark, sf_dir):
    roots = _table(spark, sf_dir, "conversations").select(F.lit("main").alias("chat"), F.col("conv_id").alias("root_msg_id")).distinct()
    return units.resume(roots, units.normalize(_units(spark, sf_dir)).where("root_msg_id % 3 = 0")).select("root_msg_id")


@query("WITH " + _U + ", p AS (SELECT * FROM u WHERE root_msg_id % 3 = 0) SELECT DISTINCT conv_id AS root_msg_id FROM conversations WHERE conv_id <= (SELECT max(root_msg_id) FROM p) AND conv_id NOT IN (SELECT root_msg_id FROM p)")
def empty_threads(spark, sf_dir):
    roots = _table(spark, sf_dir, "conversations").select(F.lit("main").alias("chat"), F.col("conv_id").alias("root_msg_id")).distinct()
    return units.empty_threads(roots, units.normalize(_units(spark, sf_dir)).where("root_msg_id % 3 = 0")).select("root_msg_id")


@query("WITH " + _M + " SELECT chat, event_id AS root_msg_id FROM (SELECT chat, msg_id - msg_id % 10 AS event_id, max(ts) AS latest FROM m GROUP BY ALL) WHERE latest >= (SELECT max(ts) FROM m) - INTERVAL 4 DAY - INTERVAL 3 DAY AND latest >= TIMESTAMP '2024-01-05' - INTERVAL 3 DAY")
def cursor_select(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("root_msg_id", F.expr("msg_id - msg_id % 10"))
    late = rows.agg(F.max("ts").alias("t"))
    found = units.affected_threads(rows, "2024-01-05 00:00:00")
    latest = rows.groupBy("chat", "root_msg_id").agg(F.max("ts").alias("latest")).join(F.broadcast(late)).where(F.expr("latest >= t - interval 7 days"))
    return found.join(latest.select("chat", "root_msg_id"), ["chat", "root_msg_id"], "left_semi")


@query("WITH " + _U + " SELECT pos, chat || '_' || root_msg_id || '_' || (row_number() OVER (PARTITION BY root_msg_id ORDER BY pos) - 1) AS id FROM u")
def assign_ids(spark, sf_dir):
    return units.assign_ids(units.normalize(_units(spark, sf_dir))).select("pos", "id")


_H = _U + """, h AS (SELECT chat || '_' || root_msg_id || '_' || (row_number() OVER (PARTITION BY root_msg_id ORDER BY pos) - 1) AS id, root_msg_id, pos,
  left(sha256(question || chr(10) || answer || chr(10) || type || chr(10) || coalesce(city, '') || chr(10) || CASE WHEN root_msg_id % 2 = 1 THEN 'https://t.me/c/7/' WHEN root_msg_id % 3 = 0 THEN 'source/' ELSE 'https://t.me/main/' END || root_msg_id), 16) AS content_hash FROM u)"""


def _hashed(spark, sf_dir) -> DataFrame:
    """Links of a private chat for odd roots, of a public one for even ones, where a third has a source link of its own."""
    odd = F.col("root_msg_id") % 2 == 1
    link = text.chat_link(odd, F.lit(-1007), F.col("chat"), F.col("root_msg_id"))
    source = F.when(~odd & (F.col("root_msg_id") % 3 == 0), F.concat(F.lit("source/"), F.col("root_msg_id").cast("string"))).otherwise("")
    return units.with_hash(units.assign_ids(units.normalize(_units(spark, sf_dir))).withColumn("root_link", link).withColumn("source_link", source))


@query("WITH " + _H + " SELECT id, content_hash FROM h")
def content_hash(spark, sf_dir):
    return _hashed(spark, sf_dir).select("id", "content_hash")


def _diff(spark, sf_dir) -> DataFrame:
    rows = _hashed(spark, sf_dir)
    stored = rows.where("pos % 5 <> 0").withColumn("content_hash", F.when(F.col("pos") % 3 == 0, None).otherwise(F.col("content_hash")))
    return units.index_diff(rows.where("root_msg_id % 6 <> 0").select("id", "content_hash"), stored.select("id", "content_hash"))


_D = _H + """, w AS (SELECT id, content_hash FROM h WHERE root_msg_id % 6 <> 0), s AS (SELECT id, CASE WHEN pos % 3 <> 0 THEN content_hash END AS old FROM h WHERE pos % 5 <> 0),
d AS (SELECT coalesce(w.id, s.id) AS id, CASE WHEN w.id IS NULL THEN 'delete' WHEN s.old = w.content_hash THEN 'unchanged' ELSE 'upsert' END AS action FROM w FULL JOIN s ON w.id = s.id)"""


@query("WITH " + _D + " SELECT * FROM d")
def index_diff(spark, sf_dir):
    return _diff(spark, sf_dir)


@query("WITH " + _D + " SELECT action, count(*) AS n FROM d GROUP BY action")
def index_diff_summary(spark, sf_dir):
    return _diff(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_S = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(e, embedding::DOUBLE[]), 6) AS score, q.label = v.label AS relevant FROM q, embeddings v WHERE vec_id <> query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@query("WITH " + _S + " SELECT query_id, rank, score FROM k WHERE rank <= 6")
def cosine_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vectors.top_k(rows, rows.where("id % 20 = 0"), 6, exclude_self=True, digits=6).select("query_id", F.col("rank").cast("bigint").alias("rank"), "score")


@query("WITH " + _S + " SELECT query_id, rank, score FROM k WHERE rank <= 6 AND score >= 0.3")
def search_threshold(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return vectors.top_k(rows, rows.where("id % 20 = 0"), 6, 0.2999995, exclude_self=True, digits=6).select("query_id", F.col("rank").cast("bigint").alias("rank"), "score")


_P = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4)"


@query("WITH " + _P + " SELECT * FROM p")
def near_dup_pairs(spark, sf_dir):
    return vectors.similar_pairs(_vectors(spark, sf_dir), 0.4).withColumn("score", F.round("score", 6))


_C = _P + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), reach AS (SELECT vec_id AS n, vec_id AS r FROM embeddings UNION SELECT e.a, reach.r FROM reach JOIN e ON e.b = reach.n WHERE reach.r < e.a),
c AS (SELECT n AS id, min(r) AS cluster FROM reach GROUP BY n)"""


def _clusters(spark, sf_dir) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return vectors.clusters(rows, vectors.similar_pairs(rows, 0.4, spanning=True))


@query("WITH RECURSIVE " + _C + " SELECT * FROM c")
def near_dup_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir)


@query("WITH RECURSIVE " + _C + """, u AS (SELECT cluster, id AS pos, 'd' || lpad((id % 9)::VARCHAR, 2, '0') AS date, 't' || label AS type FROM c JOIN embeddings ON vec_id = id),
t AS (SELECT cluster, type, count(*) AS n, min(date || lpad(pos::VARCHAR, 12, '0')) AS first FROM u GROUP BY ALL),
m AS (SELECT cluster, type FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, first) AS k FROM t) WHERE k = 1),
r AS (SELECT cluster, pos AS representative FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY date DESC, pos DESC) AS k FROM u) WHERE k = 1)
SELECT cluster, count(*) AS support_count, min(date) AS date_start, max(date) AS date_end, any_value(r.representative) AS representative, any_value(m.type) AS type FROM u JOIN m USING (cluster) JOIN r USING (cluster) GROUP BY cluster""")
def consolidate(spark, sf_dir):
    kinds = _vectors(spark, sf_dir).select("id", F.concat(F.lit("t"), F.col("label")).alias("type"))
    rows = _clusters(spark, sf_dir).join(kinds, "id").select("cluster", F.col("id").alias("pos"), F.concat(F.lit("d"), F.lpad((F.col("id") % 9).cast("string"), 2, "0")).alias("date"), "type")
    return vectors.consolidate(rows)


def _hits(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = _vectors(spark, sf_dir)
    asked = rows.where("id % 20 = 0")
    category = F.element_at(F.array(*map(F.lit, ("one_answer", "critical", "multi_source", "no_answer"))), ((F.expr("id div 20") % 4) + 1).cast("int"))
    queries_ = asked.select(F.col("id").alias("query_id"), category.alias("category"), F.when(F.col("id") % 60 == 0, "scope_leakage").alias("subtype"), F.col("label").alias("_l"))
    found = vectors.top_k(rows, asked, 20, exclude_self=True, digits=6).join(rows.select("id", "label"), "id").join(queries_.select("query_id", "_l"), "query_id")
    return queries_.drop("_l"), found.select("query_id", "rank", "score", (F.col("label") == F.col("_l")).alias("relevant"))


_G = _S + """, qs AS (SELECT query_id, CASE (query_id // 20) % 4 WHEN 0 THEN 'one_answer' WHEN 1 THEN 'critical' WHEN 2 THEN 'multi_source' ELSE 'no_answer' END AS category, CASE WHEN query_id % 60 = 0 THEN 'scope_leakage' END AS subtype FROM q),
grid AS (SELECT unnest([4, 6, 8, 10, 15, 20]) AS k, t.threshold FROM (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7])::DOUBLE AS threshold) t),
n AS (SELECT grid.k, threshold, qs.query_id, category, subtype, count(*) FILTER (rank <= grid.k AND score >= threshold) AS kept, count(*) FILTER (rank <= grid.k AND relevant) AS rel, count(*) FILTER (rank <= grid.k AND score >= threshold AND relevant) AS good FROM grid, qs LEFT JOIN k ON k.query_id = qs.query_id AND rank <= 20 GROUP BY ALL),
a AS (SELECT k, threshold, avg(good / kept) FILTER (kept > 0) AS precision, avg(good / rel) FILTER (rel > 0) AS recall, avg((good > 0)::INT) FILTER (category <> 'no_answer') AS hit_rate, avg(kept) AS avg_hits, avg((good > 0)::INT) FILTER (category = 'no_answer') AS no_answer_leak, avg((good > 0)::INT) FILTER (category = 'critical' AND subtype IS DISTINCT FROM 'scope_leakage') AS critical_hit_rate FROM n GROUP BY k, threshold),
sw AS (SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM a)"""


@query("WITH " + _G + " SELECT * FROM sw")
def sweep_grid(spark, sf_dir):
    return metrics.sweep_grid(*_hits(spark, sf_dir))


@query("WITH " + _G.replace("CASE WHEN query_id % 60 = 0 THEN 'scope_leakage' END AS subtype FROM q)", "'scope_leakage' AS subtype FROM q WHERE (query_id // 20) % 4 <> 3)") + " SELECT * FROM sw WHERE coalesce(no_answer_leak, 0) = 0 AND (critical_hit_rate IS NULL OR critical_hit_rate = 1) ORDER BY round(coalesce(f1, 0), 12) DESC, round(avg_hits, 12), k, threshold LIMIT 1")
def pick_best(spark, sf_dir):
    """Over queries with an answer; critical ones are about scope alone, so some grid point passes."""
    asked, found = _hits(spark, sf_dir)
    return metrics.pick_best(metrics.sweep_grid(asked.where("category <> 'no_answer'").withColumn("subtype", F.lit("scope_leakage")), found))


@query("SELECT source AS city, count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src2') GROUP BY source HAVING count(*) >= 5")
def city_counts(spark, sf_dir):
    return metrics.city_options(_table(spark, sf_dir, "documents").select(F.col("source").alias("city"), F.col("doc_id").alias("pos")), 5, ("src1", "src2"))


@query("SELECT user_id, event_type AS username, count(*) AS n FROM events GROUP BY ALL")
def usage_by_user(spark, sf_dir):
    return metrics.usage_by_user(_table(spark, sf_dir, "events").withColumnRenamed("event_type", "username"))


@query("""WITH d AS (SELECT * FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-02'), u AS (SELECT user_id, arg_max(event_type, event_id) AS username, count(*) AS n, min(event_id) AS f FROM d GROUP BY user_id)
SELECT user_id, username, n, (SELECT count(*) FROM d) AS day_questions, (SELECT count(DISTINCT user_id) FROM d) AS day_users FROM u ORDER BY n DESC, f LIMIT 10""")
def daily_digest(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("ts", "user_id", F.col("event_type").alias("username"), F.col("event_id").alias("pos"))
    return metrics.daily_digest(log, "2024-01-02")


@query("SELECT event_id AS pos, user_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) <= CASE WHEN user_id % 10 = 0 THEN 100 ELSE 5 END AS allowed FROM events")
def quota_allowed(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("ts", "user_id", F.col("event_id").alias("pos"))
    return metrics.allowed_questions(log, supporters=log.where("user_id % 10 = 0").select("user_id")).select("pos", "user_id", F.col("nth").cast("bigint").alias("nth"), "allowed")


@query("SELECT user_id AS chat, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 20")
def history_tail(spark, sf_dir):
    return metrics.history_tail(_table(spark, sf_dir, "events").select(F.col("user_id").alias("chat"), F.col("event_id").alias("seq")))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Private' WHEN 1 THEN 'Open' WHEN 2 THEN 'ссылка' ELSE regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) END AS label FROM pages")
def url_label(spark, sf_dir):
    """Links into a private and an open chat, what is no link, and the pages' own addresses."""
    chats = [{"chat_id": -1001234, "username": "p", "title": "Private", "private": True}, {"chat_id": 0, "username": "open", "title": "Open"}]
    k = F.col("page_id") % 4
    said = F.when(k == 0, F.concat(F.lit("https://t.me/c/1234/"), F.col("page_id").cast("string"))).when(k == 1, F.lit("https://t.me/open/5")).when(k == 2, F.lit("no link")).otherwise(F.col("url"))
    return _table(spark, sf_dir, "pages").select("page_id", text.url_label(said, chats).alias("label"))


@query("SELECT event_id, ['январь','февраль','март','апрель','май','июнь','июль','август','сентябрь','октябрь','ноябрь','декабрь'][month(ts)] || ' ' || year(ts) AS label FROM events")
def date_label(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", text.month_label(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("label"))


_A = "CASE doc_id % 4 WHEN 0 THEN 'x [1][2] y [9]' WHEN 1 THEN 'see [2] and [2]' WHEN 2 THEN 'none [?]' ELSE '[1, x] end' END"


def _answers(spark, sf_dir) -> DataFrame:
    hit = lambda n: F.struct(F.concat(F.lit(f"https://t.me/c{n}/"), F.col("doc_id").cast("string")).alias("link"), F.lit("май 2024" if n == 1 else "").alias("date"), F.lit(f"chat {n}").alias("title"), F.lit(n == 2).alias("private"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.expr(_A).alias("answer"), F.array(hit(1), hit(2)).alias("hits"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x (https://t.me/c1/' || doc_id || ', май 2024) (🔒https://t.me/c2/' || doc_id || ') y ' WHEN 1 THEN 'see (🔒https://t.me/c2/' || doc_id || ') and ' WHEN 2 THEN 'none (не из чата)' ELSE ' (https://t.me/c1/' || doc_id || ', май 2024) end' END AS text,
CASE doc_id % 4 WHEN 0 THEN 2 WHEN 2 THEN 0 ELSE 1 END::INT AS n_sources FROM documents""")
def citation_sources(spark, sf_dir):
    done = _answers(spark, sf_dir).select("doc_id", render.inline_citations(F.col("answer"), F.col("hits")).alias("c"))
    return done.select("doc_id", "c.text", F.size("c.sources").alias("n_sources"))


@query("""SELECT doc_id, to_json(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'faithful' END, CASE WHEN doc_id % 5 = 0 THEN 'relevant' END, CASE WHEN doc_id % 2 = 0 AND doc_id % 7 = 0 THEN 'honest_uncertainty' END, CASE WHEN doc_id % 11 = 0 THEN 'citation_leftover' END], lambda x: x IS NOT NULL))::VARCHAR AS fails FROM documents""")
def answer_verdicts(spark, sf_dir):
    no = lambda n: F.col("doc_id") % n != 0
    rows = _table(spark, sf_dir, "documents").select("doc_id", no(3).alias("faithful"), no(5).alias("relevant"), F.lit(True).alias("scope_ok"), no(7).alias("honest_uncertainty"), F.when(F.col("doc_id") % 11 == 0, "left [3]").otherwise("fine").alias("answer"))
    fails = metrics.answer_fails(F.col("doc_id") % 2 == 0, text.citation_left(F.col("answer")), text.date_outside_citation(F.col("answer")))
    return rows.select("doc_id", F.to_json(fails).alias("fails"))


@query("""SELECT doc_id, '<b>' || doc_id || '</b> &lt;' || CASE doc_id % 4 WHEN 0 THEN 'x (<a href="https://t.me/c1/' || doc_id || '">май 2024</a>) (🔒<a href="https://t.me/c2/' || doc_id || '">источник</a>) y ' WHEN 1 THEN 'see (🔒<a href="https://t.me/c2/' || doc_id || '">источник</a>) and '
WHEN 2 THEN 'none (не из чата)' ELSE ' (<a href="https://t.me/c1/' || doc_id || '">май 2024</a>) end' END AS html FROM documents""")
def answer_html(spark, sf_dir):
    done = _answers(spark, sf_dir).select("doc_id", render.inline_citations(F.col("answer"), F.col("hits")).alias("c"))
    return render.with_html(done.select("doc_id", F.concat(F.lit("**"), F.col("doc_id").cast("string"), F.lit("** <"), F.col("c.text")).alias("html")), "html")


def _linked(spark, sf_dir) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("pos"), F.concat(F.lit("l"), F.col("label")).alias("link"), F.concat(F.lit(" q"), F.expr("vec_id div 2")).alias("question"), "embedding", F.concat(F.lit("d"), F.col("vec_id") % 5).alias("date"))


_L = """l AS (SELECT vec_id AS pos, 'l' || label AS link, 'q' || (vec_id // 2) AS q, 'd' || (vec_id % 5) AS date, embedding::DOUBLE[] AS v FROM embeddings),
lp AS (SELECT a.pos AS a, b.pos AS b, a.q = b.q AS same, round(list_cosine_similarity(a.v, b.v), 9) >= 0.45 AS close FROM l a JOIN l b ON a.link = b.link AND a.pos < b.pos),
e AS (SELECT a, b FROM lp WHERE same OR close UNION SELECT b, a FROM lp WHERE same OR close), reach AS (SELECT pos AS n, pos AS r FROM l UNION SELECT e.a, reach.r FROM reach JOIN e ON e.b = reach.n WHERE reach.r < e.a),
c AS (SELECT n AS pos, min(r) AS cluster FROM reach GROUP BY n),
t AS (SELECT c.cluster, bool_and(lp.close) AS tight FROM lp JOIN c ON c.pos = lp.a JOIN c d ON d.pos = lp.b WHERE c.cluster = d.cluster GROUP BY c.cluster),
act AS (SELECT pos, cluster, CASE WHEN tight IS NULL THEN 'keep' WHEN tight THEN CASE WHEN pos = cluster THEN 'keep' ELSE 'drop' END WHEN pos = cluster THEN 'merge' ELSE 'merged' END AS action FROM c LEFT JOIN t USING (cluster))"""


@query("WITH RECURSIVE " + _L + " SELECT pos, cluster, action FROM act")
def same_link_clusters(spark, sf_dir):
    return vectors.same_link_clusters(_linked(spark, sf_dir), 0.45)


@query("WITH RECURSIVE " + _L + " SELECT (SELECT count(*) FROM l) AS units, (SELECT count(*) FROM (SELECT link FROM l GROUP BY link HAVING count(*) > 1)) AS groups, count(*) FILTER (action = 'drop') AS dropped, count(*) FILTER (action = 'merge') AS merged_groups FROM act")
def dedupe_stats(spark, sf_dir):
    rows = _linked(spark, sf_dir)
    return refresh.dedupe_stats(rows, vectors.same_link_clusters(rows, 0.45))


@query("WITH RECURSIVE " + _L + " SELECT cluster, arg_max(pos, date || lpad((1000000000 - pos)::VARCHAR, 12, '0')) AS pos FROM act JOIN l USING (pos) GROUP BY cluster")
def merge_record(spark, sf_dir):
    rows = _linked(spark, sf_dir)
    members = vectors.same_link_clusters(rows, 0.45).join(rows.select("pos", "date"), "pos")
    return vectors.merge_record(members).select("cluster", "pos")


@query("WITH " + _U + """, n AS (SELECT *, row_number() OVER (PARTITION BY root_msg_id ORDER BY pos) - 1 AS i FROM u)
SELECT root_msg_id, string_agg('[' || i || '] Вопрос: ' || question || chr(10) || 'Ответ: ' || answer || chr(10) || 'Тип: ' || type || chr(10) || 'Город: ' || coalesce(city, 'null'), chr(10) || chr(10) ORDER BY i) AS block FROM n GROUP BY root_msg_id""")
def unit_blocks(spark, sf_dir):
    rows = units.normalize(_units(spark, sf_dir)).withColumn("i", F.row_number().over(Window.partitionBy("chat", "root_msg_id").orderBy("pos")) - 1)
    return answering.joined(rows, ["root_msg_id"], F.col("i"), answering.unit_block(F.col("i")), "block")


@query("WITH " + _U + """, n AS (SELECT *, row_number() OVER (PARTITION BY root_msg_id ORDER BY pos) AS i FROM u)
SELECT root_msg_id, string_agg('[Фрагмент ' || i || '] тип: ' || type || CASE WHEN city IS NULL THEN '' ELSE ', город: ' || city END || ', дата: ' || chr(10) || 'ссылка: https://t.me/main/' || root_msg_id || chr(10) || 'Вопрос: ' || question || chr(10) || 'Ответ: ' || answer, chr(10) || chr(10) ORDER BY i) AS block FROM n GROUP BY root_msg_id""")
def fragment_blocks(spark, sf_dir):
    rows = units.normalize(_units(spark, sf_dir)).withColumn("i", F.row_number().over(Window.partitionBy("chat", "root_msg_id").orderBy("pos")))
    rows = rows.withColumn("date", F.lit(None).cast("string")).withColumn("link", text.chat_link(F.lit(False), F.lit(0), F.col("chat"), F.col("root_msg_id")))
    return answering.joined(rows, ["root_msg_id"], F.col("i"), answering.fragment_block(F.col("i"), F.lit(False)), "block")


@query("WITH RECURSIVE " + _BT + """, p AS (SELECT *, thread_pos % 2 AS br FROM t), x AS (SELECT root_msg_id, br, thread_pos AS pos, '[' || msg_id || ']' || CASE WHEN coalesce(reply_to, 0) <> 0 THEN ' ↩' || reply_to ELSE '' END || ' ' || sender || ': ' || text AS line FROM p
UNION ALL SELECT DISTINCT root_msg_id, br, -1, CASE br WHEN 0 THEN '### even' ELSE '### (без темы)' END FROM (SELECT root_msg_id, unnest([0, 1]) AS br FROM t)) SELECT root_msg_id, string_agg(line, chr(10) ORDER BY br, pos) AS text FROM x GROUP BY root_msg_id""")
def branches_text(spark, sf_dir):
    own = _threads(spark, sf_dir)
    ids = lambda k: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("thread_pos", "msg_id")), lambda x: x["thread_pos"] % 2 == k)), lambda x: x["msg_id"])
    branch = lambda k, topic: F.struct(F.lit(topic).alias("topic"), ids(k).alias("message_ids"))
    branches = own.groupBy("chat", "root_msg_id").agg(F.array(branch(0, " even "), branch(1, "")).alias("branches"))
    return answering.branches_text(threads.branch_messages(branches, own), branches).select("root_msg_id", "text")


@query("SELECT user_id, CASE WHEN coalesce(n, 0) = 0 THEN '' ELSE c.city END AS city, CASE WHEN c.city = 'skip' THEN NULL WHEN coalesce(n, 0) = 0 THEN 'unknown' WHEN n < 5 THEN 'few' END AS warning FROM (SELECT DISTINCT user_id, CASE WHEN user_id % 5 = 0 THEN 'skip' ELSE 'src' || (user_id % 40) END AS city FROM events) c LEFT JOIN (SELECT source AS city, count(*) AS n FROM documents WHERE source <> '' GROUP BY source) s USING (city)")
def city_choice(spark, sf_dir):
    chosen = _table(spark, sf_dir, "events").select("user_id", F.when(F.col("user_id") % 5 == 0, " skip ").otherwise(F.concat(F.lit(" src"), F.col("user_id") % 40)).alias("city")).distinct()
    counts = metrics.city_options(_table(spark, sf_dir, "documents").select(F.col("source").alias("city"), F.col("doc_id").alias("pos")), 1)
    return refresh.city_choice(chosen, counts)


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'thanks' ELSE 'request' END AS label, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 2 = 0 THEN 'own' ELSE coalesce(lang, '') END AS query FROM documents")
def guest_labels(spark, sf_dir):
    label = F.when(F.col("doc_id") % 3 == 0, "thanks").when(F.col("doc_id") % 3 == 1, "other")
    got = answering.guest_label(label, F.lit(" "), F.when(F.col("doc_id") % 2 == 0, "own").otherwise(""), F.col("lang"))
    return _table(spark, sf_dir, "documents").select("doc_id", got.alias("g")).select("doc_id", "g.*")


@query("WITH " + _D + " SELECT id, content_hash FROM w WHERE id IN (SELECT id FROM d WHERE action = 'upsert') UNION ALL SELECT id, old FROM s WHERE id IN (SELECT id FROM d WHERE action = 'unchanged')")
def index_after(spark, sf_dir):
    rows = _hashed(spark, sf_dir)
    stored = rows.where("pos % 5 <> 0").select("id", F.when(F.col("pos") % 3 == 0, None).otherwise(F.col("content_hash")).alias("content_hash"))
    wanted = rows.where("root_msg_id % 6 <> 0").select("id", "content_hash")
    return units.apply_diff(stored, wanted, units.index_diff(wanted, stored))


@query("SELECT event_id AS msg_id FROM events WHERE event_id > 100 AND strftime(ts, '%Y-%m-%d') >= '2024-01-02' ORDER BY event_id DESC LIMIT 500")
def newest_messages(spark, sf_dir):
    rows = messages(spark, sf_dir).withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    return tables.newest(rows, 100, "2024-01-02", 500).select("msg_id")


@query("SELECT user_id AS chat_username, max(event_id) AS last_msg_id FROM events GROUP BY user_id")
def last_ids(spark, sf_dir):
    return tables.last_ids(_table(spark, sf_dir, "events").select(F.col("user_id").alias("chat_username"), F.col("event_id").alias("msg_id")))


@query("SELECT user_id, 'new' AS origin FROM events WHERE user_id % 3 = 0 GROUP BY ALL UNION ALL SELECT user_id, 'old' FROM events WHERE user_id % 3 <> 0 GROUP BY ALL")
def upsert_by_key(spark, sf_dir):
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    return tables.upsert(users.withColumn("origin", F.lit("old")), users.where("user_id % 3 = 0").withColumn("origin", F.lit("new")), ["user_id"])


@query("WITH " + _U + """, p AS (SELECT * FROM u WHERE root_msg_id % 3 = 0),
t AS (SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text FROM conversations WHERE conv_id <= (SELECT max(root_msg_id) FROM p) AND conv_id NOT IN (SELECT root_msg_id FROM p) GROUP BY conv_id),
j AS (SELECT conv_id, len(list_filter(string_split('ТРЕД:' || chr(10) || text, chr(10)), lambda x: regexp_matches(x, '\\S'))) > 3 AS has FROM t)
SELECT count(*) AS sampled, count(*) FILTER (has) AS missed, 100 * count(*) FILTER (has) // greatest(count(*), 1) AS percent, count(*) AS total_empty FROM j""")
def recall_misses(spark, sf_dir):
    """All threads without units in the processed range, judged by the offline provider."""
    turns = _table(spark, sf_dir, "conversations").select(F.lit("main").alias("chat"), F.col("conv_id").alias("root_msg_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    texts = answering.joined(turns, ["chat", "root_msg_id"], F.col("turn"), F.col("text"), "text", "\n")
    sizes = turns.groupBy("chat", "root_msg_id").agg(F.count(F.lit(1)).alias("thread_size"))
    return judging.recall(sizes, texts, units.normalize(_units(spark, sf_dir)).where("root_msg_id % 3 = 0"), StubProvider(), sample=1 << 30)[1]


@query("WITH " + _U + """, n AS (SELECT *, row_number() OVER (PARTITION BY root_msg_id ORDER BY pos) - 1 AS i FROM u),
b AS (SELECT *, length('[' || i || '] Вопрос: ' || question || chr(10) || 'Ответ: ' || answer || chr(10) || 'Тип: ' || type || chr(10) || 'Город: ' || coalesce(city, 'null')) AS l FROM n),
j AS (SELECT pos, l % 5 <> 0 AS faithful, l % 7 <> 0 AS useful, l % 3 <> 0 AS atomic, (l % 9 <> 0 OR type = 'date_based') AS type_ok FROM b)
SELECT pos, type_ok, CASE WHEN NOT faithful OR NOT useful THEN 'drop' WHEN atomic AND type_ok THEN 'keep' ELSE 'fix' END AS verdict FROM j""")
def judged_units(spark, sf_dir):
    """Units judged against their threads by the offline provider, one call a thread."""
    rows = units.normalize(_units(spark, sf_dir))
    texts = rows.select("chat", "root_msg_id", F.lit("thread").alias("text")).distinct()
    return judging.judge_units(rows, texts, StubProvider()).select("pos", "type_ok", "verdict")


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'left [3]' WHEN doc_id % 13 = 0 THEN 'в мае: май 2024' ELSE 'fine' || repeat('.', (doc_id % 6)::INT) END AS answer FROM documents),
l AS (SELECT *, length('ВОПРОС: q' || chr(10) || chr(10) || 'ФРАГМЕНТЫ:' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'block' ELSE '(пусто — ничего не нашлось)' END || chr(10) || chr(10) || 'ОТВЕТ АССИСТЕНТА:' || chr(10) || answer) AS n FROM a),
f AS (SELECT doc_id, list_filter([CASE WHEN n % 5 = 0 THEN 'faithful' END, CASE WHEN n % 7 = 0 THEN 'relevant' END, CASE WHEN doc_id % 3 = 0 AND n % 2 <> 0 THEN 'honest_uncertainty' END, CASE WHEN doc_id % 11 = 0 THEN 'citation_leftover' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 13 = 0 THEN 'date_suspect' END], lambda x: x IS NOT NULL) AS fails FROM l)
SELECT doc_id, array_to_string(fails, ',') AS fails, CASE WHEN len(fails) > 0 THEN 'fail' ELSE 'pass' END AS verdict FROM f""")
def judged_answers(spark, sf_dir):
    """Answers judged by the offline provider, with the checks that need no model."""
    said = F.when(F.col("doc_id") % 11 == 0, "left [3]").when(F.col("doc_id") % 13 == 0, "в мае: май 2024").otherwise(F.concat(F.lit("fine"), F.repeat(F.lit("."), (F.col("doc_id") % 6).cast("int"))))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.lit("q").alias("query"), (F.col("doc_id") % 3 == 0).alias("critical"), F.when(F.col("doc_id") % 2 == 0, "block").alias("fragments"), said.alias("answer"))
    return judging.judge_answers(rows, StubProvider()).select("doc_id", F.array_join("fails", ",").alias("fails"), "verdict")


@query("WITH RECURSIVE " + _L + """, g AS (SELECT cluster, count(*) AS n, arg_min(pos, pos) AS a, max(pos) AS z, arg_max(pos, date || lpad((1000000000 - pos)::VARCHAR, 12, '0')) AS base FROM act JOIN l USING (pos) GROUP BY cluster)
SELECT cluster, base AS pos, CASE WHEN n > 1 THEN 'q' || (a // 2) ELSE 'q' || (base // 2) END AS question, CASE WHEN n > 1 THEN 'a' || z ELSE 'a' || base END AS answer FROM g""")
def merged_units(spark, sf_dir):
    """Clusters of one link merged by the offline provider: the first question and the last answer."""
    rows = _linked(spark, sf_dir)
    members = vectors.same_link_clusters(rows, 0.45).join(rows.select("pos", "date", F.trim("question").alias("question"), F.concat(F.lit("a"), F.col("pos").cast("string")).alias("answer")), "pos").drop("action")
    return distilling.merge_clusters(members, StubProvider()).select("cluster", "pos", "question", "answer")


@query("SELECT conv_id AS root_msg_id, count(*) AS n_ids FROM conversations GROUP BY conv_id")
def thread_branches(spark, sf_dir):
    """Branches of conversations by the offline provider, which puts all messages in one."""
    line = F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("] x"))
    texts = answering.joined(_table(spark, sf_dir, "conversations").select(F.lit("main").alias("chat"), F.col("conv_id").alias("root_msg_id"), "turn", line.alias("l")), ["chat", "root_msg_id"], F.col("turn"), F.col("l"), "text", "\n")
    return distilling.split_branches(texts, StubProvider()).select("root_msg_id", F.size(F.get("branches", F.lit(0))["message_ids"]).cast("bigint").alias("n_ids"))


@query("SELECT item_id::VARCHAR AS id, CASE item_id % 4 WHEN 1 THEN 'critical' ELSE '' END AS category FROM benchmark WHERE item_id % 4 = 1")
def golden_queries(spark, sf_dir):
    """A golden set written as JSON lines and read back, one category of it."""
    category = F.element_at(F.array(*map(F.lit, ("one_answer", "critical", "multi_source", "no_answer"))), (F.col("item_id") % 4 + 1).cast("int"))
    path = fresh_path(spark, "golden")
    tables.append_or_overwrite(_table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"), category.alias("category")), path, True)
    return tables.golden(spark, path, "critical").select("id", "category")


@query("SELECT page_id AS msg_id, 'https://t.me/c/' || '42' || '/' || page_id AS link, CASE WHEN page_id % 2 = 0 THEN 'title' ELSE 'name' END AS sender, 'Chat' AS chat_title FROM pages WHERE trim(coalesce(html, '')) <> ''")
def message_links(spark, sf_dir):
    raw = _table(spark, sf_dir, "pages").select(F.lit("c").alias("chat_username"), F.col("page_id").alias("msg_id"), F.lit("2024").alias("date"), F.when(F.col("page_id") % 2 == 0, "").otherwise("name").alias("first_name"), F.lit("title").alias("title"), F.lit(1).alias("sender_id"), F.col("html").alias("text"), F.lit(None).cast("bigint").alias("reply_to"), F.lit(7).alias("chat_id"))
    chats = spark.createDataFrame([("c", -10042, "Chat", True)], "username string, chat_id long, title string, private boolean")
    return tables.message_records(raw, chats).select("msg_id", "link", "sender", "chat_title")


@query("SELECT count(*) AS questions, (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS users FROM events")
def usage_totals(spark, sf_dir):
    return metrics.usage_totals(_table(spark, sf_dir, "events").withColumnRenamed("event_type", "username"))


@query("WITH s AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id) SELECT count(*) FILTER (strftime(ts, '%Y-%m-%d') = '2024-01-02') AS new_supporters, count(*) AS supporters FROM s")
def supporters_of_day(spark, sf_dir):
    came = _table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("value"))
    return metrics.supporters_of_day(came, "2024-01-02")


@query("WITH RECURSIVE " + _C + """, u AS (SELECT cluster, id AS pos, 'd' || lpad((id % 9)::VARCHAR, 2, '0') AS date, 't' || label AS type FROM c JOIN embeddings ON vec_id = id)
SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY date, pos) - 1 AS n, 'l' || pos AS link, date, type FROM u""")
def fold_sources(spark, sf_dir):
    kinds = _vectors(spark, sf_dir).select("id", F.concat(F.lit("t"), F.col("label")).alias("type"))
    rows = _clusters(spark, sf_dir).join(kinds, "id").select("cluster", F.col("id").alias("pos"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("link"), F.concat(F.lit("d"), F.lpad((F.col("id") % 9).cast("string"), 2, "0")).alias("date"), "type")
    return vectors.fold_sources(rows).withColumn("n", F.col("n").cast("bigint"))


@query("WITH RECURSIVE " + _BT + ", ed AS (SELECT root_msg_id, arg_max(ts, thread_pos) AS ts FROM t GROUP BY root_msg_id) SELECT 'main' AS chat, root_msg_id, strftime(ts, '%Y-%m-%d') AS date FROM ed")
def thread_dates(spark, sf_dir):
    return units.thread_dates(_threads(spark, sf_dir).withColumn("date", F.date_format("ts", "yyyy-MM-dd")))


@query()
def sample_units(spark, sf_dir):
    return refresh.seeded(units.normalize(_units(spark, sf_dir)), 30, "pos", 7).select("pos")


@query()
def answers(spark, sf_dir):
    """The whole way from questions to cited answers, with the offline provider."""
    from threadloom import providers

    provider = StubProvider()
    rows = units.with_hash(units.assign_ids(units.normalize(_units(spark, sf_dir))).withColumn("root_link", text.chat_link(F.lit(False), F.lit(0), F.col("chat"), F.col("root_msg_id"))).withColumn("source_link", F.lit("")))
    stored = providers.embed(rows.select("id", "chat", "question", "answer", "type", "city", F.lit("2024-05-01T00:00:00").alias("date"), F.col("root_link").alias("link")), provider, "question")
    history = F.when(F.col("pos") % 2 == 0, F.array(F.struct(F.lit("user").alias("role"), F.lit("before").alias("content"))))
    asked = rows.where("pos % 20 = 0").select(F.col("id").alias("query_id"), F.col("question").alias("query"), history.alias("history"), F.lit(None).cast("string").alias("city"))
    chats = spark.createDataFrame([("main", "Main", False)], "chat string, title string, private boolean")
    return answering.answers(asked, stored, chats, provider).select("query_id", "search", "answer", F.size("sources").alias("n_sources"))


@query()
def refreshed_units(spark, sf_dir):
    """One incremental run over all messages with the offline provider, and an empty state."""
    old = units.normalize(_units(spark, sf_dir)).select("chat", "root_msg_id", "pos", "question", "answer", "type", "city", "source_msg_id")
    state = spark.createDataFrame([], "chat string, processed_until timestamp_ntz")
    return refresh.refresh(messages(spark, sf_dir), old, state, StubProvider(), "2024-02-01 00:00:00", "2024-01-04 00:00:00")[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
