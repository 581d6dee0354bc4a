"""Queries over whole threads against brute force: every message of a long burst counts."""

import datetime as dt
import json
import random

import pytest

from tests.test_threads import T0, model
from threadloom.plans import registry

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string"


@pytest.fixture(scope="module")
def chat(spark, tmp_path_factory):
    """A folder with a burst of 170 messages, short bursts and replies over pauses; the messages; their threads by ``model``."""
    rng, rows, t = random.Random(3), [], 0
    for i in range(1, 301):
        t += 20 if i <= 170 else rng.choice([5, 400, 500, 3000, 100_000])
        rows.append((i, t, rng.choice([None, None, 1, 2, 3])))
    sf = str(tmp_path_factory.mktemp("events"))
    events = [(i, T0 + dt.timedelta(seconds=s), i % 7, f"m{i}", json.dumps({"k": k} if k else {})) for i, s, k in rows]
    spark.createDataFrame(events, EVENTS).write.parquet(f"{sf}/events.parquet")
    messages = {i: (s, k and i - k) for i, s, k in rows}
    return sf, messages, model([(i, s, r) for i, (s, r) in messages.items()])


def line(i, messages):
    reply = messages[i][1]
    return f"[{i}]{f' ↩{reply}' if reply else ''} {i % 7}: m{i}"


def label(minutes):
    return f"{int(minutes)} мин" if minutes < 60 else f"{minutes / 60:.1f} ч" if minutes < 1440 else f"{minutes / 1440:.1f} дн"


def pauses(thread, messages, least):
    gaps = {b: (messages[b][0] - messages[a][0]) / 60 for a, b in zip(thread, thread[1:])}
    return {i: g for i, g in gaps.items() if g >= least}


def test_thread_text_has_every_message(spark, chat):
    sf, messages, want = chat
    got = {x["root_msg_id"]: x["text"] for x in registry.queries()["thread_text"](spark, sf).collect()}
    texts = {}
    for t in want:
        gaps = pauses(t, messages, 30)
        texts[t[0]] = "\n".join((f"— пауза {label(gaps[i])} —\n" if i in gaps else "") + line(i, messages) for i in t)
    assert sum(map(len, want)) == 300 and got == texts


def test_pause_markers_of_all_threads(spark, chat):
    sf, messages, want = chat
    got = {x["msg_id"]: (round(x["gap_minutes"], 6), x["pause"]) for x in registry.queries()["pause_markers"](spark, sf).collect()}
    found = {i: (round(g, 6), label(g)) for t in want for i, g in pauses(t, messages, 5).items()}
    assert got == found and any(g > 60 for g, _ in found.values())


def test_branches_have_every_message(spark, chat):
    sf, messages, want = chat
    got = {x["root_msg_id"]: x["text"] for x in registry.queries()["branches_text"](spark, sf).collect()}
    assert got == {t[0]: "\n".join(["### even", *(line(i, messages) for i in t[1::2]), "### (без темы)", *(line(i, messages) for i in t[::2])]) for t in want}


def test_select_recent_loses_no_large_component(spark, chat):
    sf, messages, want = chat
    got = {(x["root_msg_id"], x["size"], x["latest"]) for x in registry.queries()["thread_select_recent"](spark, sf).collect()}
    latest = {t[0]: T0 + dt.timedelta(seconds=max(messages[i][0] for i in t)) for t in want}
    found = {(t[0], len(t), latest[t[0]]) for t in want if len(t) >= 2 and latest[t[0]] >= dt.datetime(2024, 1, 2)}
    assert got == found and found
