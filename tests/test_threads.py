"""Threads against a plain model of the semantics."""

import datetime as dt
import random

from threadloom.operators import threads as T

SCHEMA = "chat string, msg_id bigint, ts timestamp_ntz, sender string, text string, reply_to bigint"
T0 = dt.datetime(2024, 1, 1)


def rows(spark, messages):
    return spark.createDataFrame([("a", i, None if s is None else T0 + dt.timedelta(seconds=s), "u", f"m{i}", r) for i, s, r in messages], SCHEMA)


def bursts_of(spark, messages, **kw):
    return {x["msg_id"]: x["burst"] for x in T.bursts(rows(spark, messages), **kw).collect()}


def test_gap_is_strict_and_null_never_splits(spark):
    got = bursts_of(spark, [(1, 0, None), (2, 600, None), (3, 1200.000001, None), (4, None, None), (5, 90_000, None), (6, 10, None), (7, 9000, None)])
    assert got == {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 1, 7: 2}


def test_buckets_do_not_matter(spark):
    rng = random.Random(1)
    messages = [(i, None if rng.random() < 0.1 else i * 300 + rng.choice([0, 0, 700]), None) for i in range(1, 120)]
    assert bursts_of(spark, messages, bucket=7) == bursts_of(spark, messages)


def test_chunks(spark):
    got = T.burst_chunks(T.bursts(rows(spark, [(i, i, None) for i in range(1, 102)]))).groupBy("chunk").count().orderBy("chunk").collect()
    assert [x["count"] for x in got] == [50, 50, 1]


def test_reply_edges(spark):
    got = T.reply_edges(rows(spark, [(1, 0, None), (2, 0, 1), (3, 0, 99), (4, 0, 4), (5, 0, 6), (6, 0, None)]))
    assert sorted((x["msg_id"], x["parent"]) for x in got.collect()) == [(2, 1), (5, 6)]


def model(messages, gap=600, cap=50):
    parent = {i: i for i, _, _ in messages}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    for i, _, r in messages:
        if r in parent:
            join(i, r)
    run = []
    runs = [run]
    for k, (i, s, _) in enumerate(messages):
        before = messages[k - 1][1] if k else None
        if before is not None and s is not None and s - before > gap:
            run = []
            runs.append(run)
        run.append(i)
    for run in runs:
        for k in range(0, len(run), cap):
            for i in run[k : k + cap]:
                join(run[k], i)
    groups = {}
    for i, _, _ in messages:
        groups.setdefault(root(i), []).append(i)
    out = []
    replies = {i: r for i, _, r in messages}
    for members in groups.values():
        if len(members) <= cap:
            out.append(members)
            continue
        blocks = {i: [i] for i in members}
        for i in members:
            r = replies[i]
            if r in blocks and blocks[r] is not blocks[i]:
                merged = sorted(blocks[r] + blocks[i])
                for j in merged:
                    blocks[j] = merged
        seen, bucket = set(), []
        for i in members:
            block = blocks[i]
            if id(block) in seen:
                continue
            seen.add(id(block))
            if bucket and len(bucket) + len(block) > cap:
                out.append(bucket)
                bucket = []
            if len(block) > cap:
                out += [block[k : k + cap] for k in range(0, len(block), cap)]
            else:
                bucket = bucket + block
        if bucket:
            out.append(bucket)
    return sorted(map(tuple, out))


def test_build_threads_matches_model(spark):
    rng = random.Random(5)
    messages, t = [], 0
    for i in range(1, 500):
        t += rng.choice([5, 5, 5, 5, 5, 5, 900])
        messages.append((i, t, i - rng.randint(1, 60) if rng.random() < 0.3 else None))
    got = {}
    for x in T.build_threads(rows(spark, messages), cap=10).orderBy("thread_pos").collect():
        got.setdefault(x["root_msg_id"], []).append(x["msg_id"])
    assert sorted(map(tuple, got.values())) == model(messages, cap=10)
    assert all(k == v[0] for k, v in got.items())


def test_text_and_pauses(spark):
    t = rows(spark, [(1, 0, None), (2, 1799, 1), (3, 1799 + 1800, None), (4, None, None), (5, 3599 + 86_400, None)]).selectExpr("*", "1L as root_msg_id", "msg_id as thread_pos")
    text = T.thread_text(t).first()["text"]
    assert text == "[1] u: m1\n[2] ↩1 u: m2\n— пауза 30 мин —\n[3] u: m3\n[4] u: m4\n— пауза 1.0 дн —\n[5] u: m5"
