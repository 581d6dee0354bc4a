"""Repair of judged units and the incremental refresh of a chat's knowledge, as compositions of the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom import providers
from threadloom.functions.text import chat_link, spam_reason, strip
from threadloom.operators import threads as th
from threadloom.operators import units as un
from threadloom.storage import written

# Fixed value: the note of a unit whose thread is gone.
NO_THREAD = "исходный тред не найден"
#: Parts that one item may be split into, for the order of units.
PARTS = 1 << 16


def split_spam(messages: DataFrame, reason: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Clean messages, and the removed ones with ``spam``, their category."""
    marked = messages.withColumn("spam", spam_reason(F.col("text")) if reason is None else reason)
    return marked.where("spam is null").drop("spam"), marked.where("spam is not null")


def seeded(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """A random sample of ``n`` rows that reruns repeat: those with the smallest hash of their key. A top-n, not a full sort."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def atomize(units: DataFrame, provider) -> DataFrame:
    """Each unit as one or more: questions and answers as the model splits them; where it gives none, the unit itself."""
    plain = F.concat(F.lit("Вопрос: "), "question", F.lit("\nОтвет: "), "answer")
    asked = providers.ask(units.withColumn("_p", plain), provider, "atomize", "_p", f"items {providers.UNIT_ITEMS}").where("error is null")
    clean = F.transform("reply.items", lambda x: F.struct(strip(F.coalesce(x["question"], F.lit(""))).alias("question"), strip(F.coalesce(x["answer"], F.lit(""))).alias("answer")))
    good = F.filter(clean, lambda x: (x["question"] != "") & (x["answer"] != ""))
    parts = F.when(F.coalesce(F.size(good), F.lit(0)) > 0, good).otherwise(F.array(F.struct("question", "answer")))
    rest = [c for c in units.columns if c not in ("question", "answer")]
    return asked.select(*rest, F.posexplode(parts).alias("part", "u")).select(*rest, "part", "u.*").select(*units.columns, "part")


def reverify(units: DataFrame, texts: DataFrame, provider) -> DataFrame:
    """Add ``confirmed``: a second judge also finds the unit unfaithful, or its thread ``(chat, root_msg_id, text)`` isn't there."""
    rows = units.join(texts.select("chat", "root_msg_id", F.col("text").alias("_t")), ["chat", "root_msg_id"], "left")
    missing = rows.where("_t is null").select(*units.columns, F.lit(True).alias("confirmed"), F.lit(NO_THREAD).alias("reverify_note"))
    prompt = F.concat("_t", F.lit("\n\nВопрос: "), "question", F.lit("\nОтвет: "), "answer")
    asked = providers.ask(rows.where("_t is not null").select(*units.columns, prompt.alias("_p")), provider, "reverify", "_p", "faithful boolean, note string").where("error is null")
    return missing.union(asked.select(*units.columns, F.coalesce(~F.col("reply.faithful"), F.lit(False)), F.coalesce("reply.note", F.lit(""))))


def fix_batch(units: DataFrame, judged: DataFrame, texts: DataFrame, provider) -> DataFrame:
    """Units after repair, with ``outcome``: kept, rescued (the second judge disagrees), fixed or dropped.

    The routing is written once, since models are asked over its parts.
    """
    routed = written(un.route(units, judged), "routed")
    part = lambda a: routed.where(F.col("action") == a).drop("action")
    again = written(reverify(part("reverify"), texts, provider), "reverified")
    names = units.columns
    as_ = lambda df, outcome: df.select(*names, F.lit(0).alias("part"), F.lit(outcome).alias("outcome"))
    out = as_(part("keep"), "kept").union(as_(part("simple_fix"), "fixed")).union(as_(part("drop"), "dropped"))
    out = out.union(atomize(part("atomize"), provider).select(*names, "part", F.lit("fixed")))
    return out.union(as_(again.where("confirmed"), "dropped")).union(as_(again.where("not confirmed"), "rescued"))


def fix_summary(outcomes: DataFrame) -> DataFrame:
    """``(kept, rescued, fixed, dropped)``: rescued units are kept ones too."""
    n = lambda *o: F.count_if(F.col("outcome").isin(*o))
    return outcomes.agg(n("kept", "rescued").alias("kept"), n("rescued").alias("rescued"), n("fixed").alias("fixed"), n("dropped").alias("dropped"))


def refresh(messages: DataFrame, old: DataFrame, state: DataFrame, provider, now: str, first: str, overlap_days: int = 3, reason: Column | None = None, chats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One incremental run: ``(units, state)`` after it.

    Threads with activity since a chat's cursor (``state(chat, processed_until)``, else ``first``) less the overlap are
    distilled, judged and repaired again, and replace the old units of their roots. All cursors move to ``now``, also of chats
    where nothing was selected or without messages. ``old(chat, root_msg_id, pos, question, answer, type, city, source_msg_id)``.

    New units have ``pos`` by their place in the reply and their part, ``date`` of their thread, and links where ``chats(chat, chat_id,
    private)`` is given.
    """
    from threadloom.operators import distilling, judging

    clean, _ = split_spam(messages, reason)
    built = written(th.build_threads(clean), "threads")
    since = F.coalesce("processed_until", F.lit(first).cast("timestamp_ntz")) - F.expr(f"interval {int(overlap_days)} days")
    found = th.select_threads(built).join(state.select("chat", "processed_until"), "chat", "left").where(F.col("latest").isNull() | (F.col("latest") >= since))
    touched = written(found.select("chat", "root_msg_id"), "touched")
    own = built.join(touched, ["chat", "root_msg_id"], "left_semi")
    texts = written(th.thread_text(own), "thread-texts")
    branches = written(distilling.split_branches(texts, provider), "branches")
    items = distilling.distill(texts, provider, branches, own).withColumn("pos", F.col("k").cast("long"))
    fresh = written(un.normalize(items.drop("k"), own), "fresh").select("chat", "root_msg_id", "pos", "question", "answer", "type", "city", "source_msg_id")
    judged = written(judging.judge_units(fresh, texts, provider), "judged")
    done = fix_batch(fresh, judged, texts, provider).where("outcome <> 'dropped'")
    done = done.withColumn("pos", F.col("pos") * PARTS + F.col("part")).drop("part", "outcome")
    dated = own if "date" in own.columns else own.withColumn("date", F.coalesce(F.col("ts").cast("string"), F.lit("")))
    done = done.join(un.thread_dates(dated), ["chat", "root_msg_id"], "left")
    if chats is not None:
        link = lambda i: chat_link(F.coalesce("private", F.lit(False)), F.col("chat_id"), F.col("chat"), F.col(i))
        done = done.join(F.broadcast(chats.select("chat", "chat_id", "private")), "chat", "left").withColumn("root_link", link("root_msg_id")).withColumn("source_link", link("source_msg_id")).drop("chat_id", "private")
    merged = un.dedup_first(un.merge_replace(old, written(done, "repaired"), touched))
    return merged, messages.select("chat").union(state.select("chat")).distinct().withColumn("processed_until", F.lit(now).cast("timestamp_ntz"))


def city_choice(choices: DataFrame, counts: DataFrame, least: int = 5) -> DataFrame:
    """``choices(user_id, city)`` to ``(user_id, city, warning)`` by ``counts(city, n)``: unknown cities and ``skip`` store
    nothing, cities with few units are stored with a warning."""
    rows = choices.withColumn("city", strip(F.coalesce("city", F.lit("")))).join(counts.select("city", "n"), "city", "left")
    n = F.coalesce("n", F.lit(0))
    none = (F.col("city").isin("", "skip")) | (n == 0)
    return rows.select("user_id", F.when(none, "").otherwise(F.col("city")).alias("city"), F.when(F.col("city").isin("", "skip"), None).when(n == 0, "unknown").when(n < least, "few").alias("warning"))


def dedupe_stats(units: DataFrame, actions: DataFrame) -> DataFrame:
    """``(units, groups, dropped, merged_groups)``: units in all, links of several units, and what the clusters' actions do."""
    groups = units.groupBy("link").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("units"), F.count_if(F.col("n") > 1).alias("groups"))
    return groups.join(F.broadcast(actions.agg(F.count_if(F.col("action") == "drop").alias("dropped"), F.count_if(F.col("action") == "merge").alias("merged_groups"))))  # one row each
