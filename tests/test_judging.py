"""Judges, distilling and the refresh against models in plain Python."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from tests.test_answering import Scripted
from tests.test_threads import T0, model
from threadloom.operators import distilling, judging, metrics, refresh, threads, units
from threadloom.providers import StubProvider

UNIT = "chat string, root_msg_id long, pos long, question string, answer string, type string, city string, source_msg_id long"


def test_judge_sees_the_thread_and_its_numbered_units(spark):
    from threadloom import providers

    rows = spark.createDataFrame([("c", 1, 7, "q2", "a2", "vote_based", "X", 1), ("c", 1, 3, "q1", "a1", "date_based", None, 1)], UNIT)
    texts = spark.createDataFrame([("c", 1, "the thread")], "chat string, root_msg_id long, text string")
    seen = {}

    class Spy(StubProvider):
        def chat_json(self, task, text):
            assert text == "ТРЕД:\nthe thread\n\nПАРЫ:\n[0] Вопрос: q1\nОтвет: a1\nТип: date_based\nГород: null\n\n[1] Вопрос: q2\nОтвет: a2\nТип: vote_based\nГород: X", text
            return json.dumps({"results": [{"index": 0, "faithful": True, "note": " n "}, {"index": 1, "faithful": False}, {"index": 1, "faithful": True}, {"index": 9}]})

    for x in judging.judge_units(rows, texts, Spy()).collect():
        seen[x["pos"]] = (x["faithful"], x["note"], x["verdict"])
    assert seen == {3: (True, "n", "error"), 7: (True, "", "error")}
    lost = judging.judge_units(rows, texts.where("false"), Spy()).collect()
    assert {x["verdict"] for x in lost} == {"error"} and len(lost) == 2
    assert providers.JUDGED.count("city_suggested") == 1


def test_type_and_city_follow_from_the_suggestions(spark):
    cases = [("vote_based", "vote_based", None, "null", True, True, "keep"), ("vote_based", "date_based", None, None, False, True, "fix"), ("vote_based", None, "X", " X ", None, True, "fix"),
             ("vote_based", "vote_based", "X", "-", True, False, "fix"), ("date_based", "date_based", " NONE ", "", True, True, "keep"), ("date_based", "", "X", "Y", None, False, "fix")]
    df = spark.createDataFrame([(k, t, ts, c, cs, True, True, True) for k, (t, ts, c, cs, *_) in enumerate(cases)], "pos int, type string, type_suggested string, city string, city_suggested string, faithful boolean, useful boolean, atomic boolean")
    got = {x["pos"]: (x["type_ok"], x["city_ok"], x["verdict"]) for x in judging.derived(df).collect()}
    assert got == {k: tuple(c[4:]) for k, c in enumerate(cases)}


def test_answers_are_judged(spark):
    rows = spark.createDataFrame([(1, "q", True, "f", "see [1]"), (2, "q", False, None, "fine")], "query_id long, query string, critical boolean, fragments string, answer string")
    reply = lambda t: {"faithful": judging.NO_FRAGMENTS not in t, "relevant": True, "scope_ok": None, "honest_uncertainty": False, "scope_note": " s "}
    got = {x["query_id"]: x for x in judging.judge_answers(rows, Scripted(judge_answer=reply)).collect()}
    assert (got[1]["fails"], got[1]["verdict"], got[1]["scope_note"]) == (["honest_uncertainty", "citation_leftover"], "fail", "s")
    assert (got[2]["fails"], got[2]["verdict"]) == (["faithful"], "fail")
    down = judging.judge_answers(rows.where("query_id = 2"), Scripted(judge_answer=None)).first()
    assert down["verdict"] == "pass" and down["faithful"] is None  # no signal, no fail
    report = {x["name"]: (x["n"], x["percent"]) for x in judging.answer_report(judging.judge_answers(rows, Scripted(judge_answer=reply))).collect()}
    assert report["faithful"] == (1, 50) and report["fail"] == (2, 100) and report["citation_leftover"] == (1, 50)


def test_recall_over_a_sample_of_empty_threads(spark):
    sizes = spark.createDataFrame([("c", k, 3) for k in range(1, 41)], "chat string, root_msg_id long, thread_size long")
    texts = sizes.withColumn("text", F.concat(F.lit("t"), F.col("root_msg_id").cast("string")))
    produced = spark.createDataFrame([("c", 30), ("c", 2)], "chat string, root_msg_id long")
    provider = Scripted(recall=lambda t: {"has_knowledge": int(re.search(r"t(\d+)", t)[1]) % 2 == 0, "missed": " m "})
    judged, report = judging.recall(sizes, texts, produced, provider, sample=10, seed=1)
    rows = judged.collect()
    assert len(rows) == 10 and all(x["root_msg_id"] < 30 and x["root_msg_id"] != 2 and x["missed"] == "m" for x in rows)
    missed = sum(x["root_msg_id"] % 2 == 0 for x in rows)
    assert tuple(report.first()) == (10, missed, missed * 10, 28)
    assert tuple(judging.recall_report(judged.where("false")).first()) == (0, 0, 0)


def test_distilling_gets_the_draft_of_branches(spark):
    rows = [("c", k, 1, k - 1, f"m{k}", "s", None) for k in (1, 2)] + [("c", 9, 9, 0, "m9", "s", None)]
    own = spark.createDataFrame(rows, "chat string, msg_id long, root_msg_id long, thread_pos long, text string, sender string, reply_to long")
    texts = spark.createDataFrame([("c", 1, "[1] s: m1\n[2] s: m2"), ("c", 9, "[9] s: m9")], "chat string, root_msg_id long, text string")
    provider = Scripted(branches=lambda t: {"branches": [{"topic": " T ", "message_ids": [2, 77]}] if "m1" in t else []}, distill=lambda t: {"items": [{"question": t, "answer": "a"}]})
    got = {x["root_msg_id"]: x["question"] for x in distilling.distill(texts, provider, distilling.split_branches(texts, provider), own).collect()}
    assert got == {1: distilling.SOURCE_HEAD + "[1] s: m1\n[2] s: m2" + distilling.DRAFT_HEAD + "### T\n[2] s: m2", 9: "[9] s: m9"}


def test_distilling_goes_on_where_it_was_broken_off(spark, tmp_path):
    texts = spark.createDataFrame([("c", k, f"t{k}") for k in range(20)], "chat string, root_msg_id long, text string")
    reply = lambda t: {"items": [{"question": t, "answer": "a"}] if t != "t3" else []}

    class Flaky(Scripted):
        def chat_json(self, task, text):
            if text in ("t5", "t6"):
                raise ValueError("down")
            return super().chat_json(task, text)

    path = str(tmp_path / "saved")
    assert distilling.distill_saved(texts.where("false"), Flaky(distill=reply), str(tmp_path / "none"), steps=2).count() == 0
    first = distilling.distill_saved(texts, Flaky(distill=reply), path, steps=3)
    assert {x["root_msg_id"] for x in first.collect()} == set(range(20)) - {3, 5, 6}
    again = distilling.distill_saved(texts, Scripted(distill=lambda t: {"items": [{"question": "new " + t, "answer": "a"}]}), path, steps=3)
    assert {x["root_msg_id"]: x["question"] for x in again.collect()} == {k: f"new t{k}" if k in (5, 6) else f"t{k}" for k in range(20) if k != 3}


def test_clusters_are_merged_with_a_fallback(spark):
    rows = [(1, 1, "q1", "a1", "2024-01-01"), (1, 2, "q2", "a2", "2024-02-01"), (3, 3, "q3", "a3", None), (4, 4, "q4", "a4", None), (4, 5, "q5", "a5", None)]
    df = spark.createDataFrame(rows, "cluster long, pos long, question string, answer string, date string")
    reply = lambda t: {"question": "Q", "answer": "A" if "q1" in t else ""}
    got = sorted(tuple(x) for x in distilling.merge_clusters(df, Scripted(merge=reply)).collect())
    assert got == [(1, 2, "Q", "A", "2024-02-01"), (3, 3, "q3", "a3", None), (4, 4, "q4", "a4", None)]
    assert sorted(x["pos"] for x in distilling.merge_clusters(df, Scripted(merge=None)).collect()) == [2, 3, 4]


def test_first_of_keeps_rows_apart_that_share_a_position(spark):
    rows = [("c", 1, 0, "Q", "a"), ("c", 1, 1, " q ", "A"), ("c", 2, 0, "q", "a"), ("c", 2, 1, "other", "a")]
    df = spark.createDataFrame(rows, "chat string, root_msg_id long, pos long, question string, answer string")
    assert sorted((x["root_msg_id"], x["pos"]) for x in units.dedup_first(df).collect()) == [(1, 0), (2, 0), (2, 1)]


def test_chunks_of_bursts_over_many_buckets(spark):
    rows = [("c", k * 3, T0 + dt.timedelta(seconds=k)) for k in range(400)] + [("d", 5, None)]
    df = spark.createDataFrame(rows, "chat string, msg_id long, ts timestamp_ntz")
    got = {(x["chat"], x["msg_id"]): (x["burst"], x["chunk"], x["head"]) for x in threads.burst_chunks(threads.bursts(df, bucket=64), 50, bucket=64).collect()}
    assert got == {("c", k * 3): (0, k // 50, k // 50 * 150) for k in range(400)} | {("d", 5): (0, 0, 5)}


def test_ids_of_any_size_keep_their_links(spark):
    far = 1 << 60
    df = spark.createDataFrame([("a", far + 1, T0, None), ("a", far + 2, T0 + dt.timedelta(days=1), far + 1), ("a", -5, T0 - dt.timedelta(days=2), None), ("b", far + 2, T0, far + 1)], "chat string, msg_id long, ts timestamp_ntz, reply_to long")
    got = {(x["chat"], x["msg_id"]): x["component"] for x in threads.thread_components(df).collect()}
    assert got == {("a", far + 1): far + 1, ("a", far + 2): far + 1, ("a", -5): -5, ("b", far + 2): far + 2}


def refreshed(messages, old, cursor, provider, overlap=3):
    """The whole run in plain Python: threads by ``model``, then the provider's replies as the operators read them."""
    said = {i: (s, r, t) for i, s, r, t in messages}
    ask = lambda task, text: json.loads(provider.chat_json(task, text))
    out, touched = [], set()
    for own in model([(i, s, r) for i, s, r, _ in messages]):
        latest = max(said[i][0] for i in own)
        if len(own) < 2 or T0 + dt.timedelta(seconds=latest) < cursor - dt.timedelta(days=overlap):
            continue
        root, lines, before = own[0], [], None
        touched.add(root)
        for i in own:
            s, r, t = said[i]
            if before is not None and (s - before) / 60 >= 30:
                gap = (s - before) / 60
                lines.append(f"— пауза {int(gap)} мин —" if gap < 60 else f"— пауза {gap / 60:.1f} ч —" if gap < 1440 else f"— пауза {gap / 1440:.1f} дн —")
            before = s
            lines.append(f"[{i}]{f' ↩{r}' if r else ''} u: {t}")
        text = "\n".join(lines)
        branches = ask("branches", text)["branches"]
        draft = "\n".join(["### " + b["topic"] + "".join(f"\n[{i}]{f' ↩{said[i][1]}' if said[i][1] else ''} u: {said[i][2]}" for i in b["message_ids"] if i in own) for b in branches])
        items = ask("distill", distilling.SOURCE_HEAD + text + distilling.DRAFT_HEAD + draft)["items"]
        found = [(k, x["question"].strip(), x["answer"].strip()) for k, x in enumerate(items) if x["question"].strip() and x["answer"].strip()]
        if not found:
            continue
        blocks = "\n\n".join(f"[{n}] Вопрос: {q}\nОтвет: {a}\nТип: vote_based\nГород: null" for n, (_, q, a) in enumerate(found))
        judged = {x["index"]: x for x in ask("judge", f"ТРЕД:\n{text}\n\nПАРЫ:\n{blocks}")["results"]}
        date = str(T0 + dt.timedelta(seconds=said[own[-1]][0]))
        keys = set()
        for n, (k, q, a) in enumerate(found):
            j, kind, parts = judged[n], "vote_based", [(q, a)]
            type_ok = j["type_suggested"] == kind
            if not j["faithful"]:  # a second judge may disagree
                if not ask("reverify", f"{text}\n\nВопрос: {q}\nОтвет: {a}")["faithful"]:
                    continue
            elif not j["useful"]:
                continue
            elif not (j["atomic"] and type_ok):
                kind = j["type_suggested"]
                if not j["atomic"]:
                    parts = [(x["question"].strip(), x["answer"].strip()) for x in ask("atomize", f"Вопрос: {q}\nОтвет: {a}")["items"]] or parts
            for part, (x, y) in enumerate(parts):
                if (x.lower(), y.lower()) not in keys:
                    keys.add((x.lower(), y.lower()))
                    out.append((root, k * refresh.PARTS + part, x, y, kind, root, date))
    return sorted(out + [u for u in old if u[0] not in touched])


def test_refresh_by_a_plain_model(spark):
    import random

    rng, rows, t = random.Random(8), [], 0
    for i in range(1, 220):
        t += rng.choice([30, 200, 900, 5000, 40_000])
        rows.append((i, t, i - rng.randint(1, 3) if i > 3 and rng.random() < 0.5 else None, " ".join(rng.choices(["so", "then", "why", "rent", "visa?"], k=rng.randint(1, 6)))))
    messages = spark.createDataFrame([("c", i, T0 + dt.timedelta(seconds=s), "u", x, r) for i, s, r, x in rows], "chat string, msg_id long, ts timestamp_ntz, sender string, text string, reply_to long")
    cursor = T0 + dt.timedelta(seconds=t // 2)
    old = [(r, 0, f"old{r}", "a", "vote_based", r, None) for r in (1, 2, 5, 100, 150, 200)]
    stored = spark.createDataFrame([("c", r, p, q, a, k, None, s) for r, p, q, a, k, s, _ in old], UNIT)
    state = spark.createDataFrame([("c", cursor), ("quiet", cursor)], "chat string, processed_until timestamp_ntz")
    got, moved = refresh.refresh(messages, stored, state, StubProvider(), "2030-01-01 00:00:00", "2000-01-01 00:00:00", reason=F.lit(None).cast("string"))
    want = refreshed(rows, old, cursor, StubProvider())
    found = sorted((x["root_msg_id"], x["pos"], x["question"], x["answer"], x["type"], x["source_msg_id"], x["date"]) for x in got.collect())
    assert [x[:6] for x in found] == [x[:6] for x in want] and len(want) > 20
    assert [str(x[6])[:19] if x[6] else None for x in found] == [x[6][:19] if x[6] else None for x in want]
    assert {x["chat"]: str(x["processed_until"]) for x in moved.collect()} == {"c": "2030-01-01 00:00:00", "quiet": "2030-01-01 00:00:00"}


def test_links_of_refreshed_units(spark):
    messages = spark.createDataFrame([("c", 1, T0, "u", "first", None), ("c", 2, T0, "u", "second", 1)], "chat string, msg_id long, ts timestamp_ntz, sender string, text string, reply_to long")
    provider = Scripted(branches={"branches": []}, distill={"items": [{"question": "q", "answer": "a", "source_msg_id": "2"}]}, judge={"results": [{"index": 0, "faithful": True, "useful": True, "atomic": True, "type_suggested": "vote_based"}]})
    chats = spark.createDataFrame([("c", -1007, True)], "chat string, chat_id long, private boolean")
    state = spark.createDataFrame([], "chat string, processed_until timestamp_ntz")
    x = refresh.refresh(messages, spark.createDataFrame([], UNIT), state, provider, "2030-01-01 00:00:00", "2000-01-01 00:00:00", chats=chats)[0].first()
    assert (x["root_link"], x["source_link"]) == ("https://t.me/c/7/1", "https://t.me/c/7/2")


def test_daily_counts_are_written_by_key(spark, tmp_path):
    from threadloom.streaming import events

    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    schema = "ts timestamp, user_id long"
    seen = []
    for batch in ([(day(1, 1), 1), (day(1, 2), 1), (day(1, 3), 2), (day(2, 1), 1)], [(day(2, 2), 1), (day(2, 3), 3)], [(day(9, 1), 2)], [(day(9, 2), 2), (day(1, 5), 1)]):  # the last row is too late
        seen.append(batch)
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        events.upsert_counts(events.read_log(spark, src, schema), out, ck).awaitTermination(120)
    got = {(str(x["day"]), x["user_id"]): x["n"] for x in spark.read.parquet(out).collect()}
    assert got == {("2024-01-01", 1): 2, ("2024-01-01", 2): 1, ("2024-01-02", 1): 2, ("2024-01-02", 3): 1, ("2024-01-09", 2): 2}


def test_cursors_golden_and_config_order(spark, tmp_path):
    from threadloom.sources import tables

    path = str(tmp_path / "cursors")
    assert tables.read_cursors(spark, path).count() == 0
    tables.write_cursors(tables.bootstrap_cursors(spark.createDataFrame([("a",), ("b",), ("a",)], "chat string"), "2024-05-01 00:00:00"), path)
    assert sorted((x["chat"], str(x["processed_until"])) for x in tables.read_cursors(spark, path).collect()) == [("a", "2024-05-01 00:00:00"), ("b", "2024-05-01 00:00:00")]
    with pytest.raises(FileNotFoundError):
        tables.golden(spark, str(tmp_path / "none"))
    (tmp_path / "golden.jsonl").write_text('{"id": "1", "query": "q", "category": "critical"}\n\n{"id": "2", "query": "r", "category": "no_answer"}\n')
    assert [x["id"] for x in tables.golden(spark, str(tmp_path / "golden.jsonl"), "critical").collect()] == ["1"]
    assert tables.golden(spark, str(tmp_path / "golden.jsonl")).count() == 2
    parts = [spark.createDataFrame([(k,)], "x int") for k in (5, 3)]
    assert [tuple(x) for x in tables.in_order(parts).orderBy("chat_order").collect()] == [(5, 0), (3, 1)]
    kept = metrics.drop_other_days(spark.createDataFrame([("1:2024-01-01", 2), ("1:2024-01-02", 3)], "key string, value int"), "2024-01-02")
    assert [x["value"] for x in kept.collect()] == [3]


def test_no_temporary_folder_on_a_cluster(spark, monkeypatch):
    from threadloom import storage

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: type("C", (), {"get": lambda self, k: None})()
        getCheckpointDir = lambda self: None

    class Session:
        conf = type("R", (), {"get": lambda self, k, d=None: d})()
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Session())


def test_written_tables_can_be_cleared(spark):
    import os

    from threadloom import storage

    path = storage.fresh_path(spark, "kept")
    spark.range(3).write.parquet(path)
    local = path.removeprefix("file://")
    before = list(storage._MADE)
    storage._MADE[:] = [path]
    assert os.path.exists(local) and storage.clear(spark) == 1 and not os.path.exists(local) and not storage._MADE
    storage._MADE[:] = [p for p in before if p != path]
