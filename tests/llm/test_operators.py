"""Each operator on a small table with hard rows, against brute force, an exact round trip or held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import attention_lm, chat_tree, decontaminate, licenses, pivotal_mix, quality, queries, shard, simhash_pivot, token_table, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, score string, part string, _key int, before int, row int, h int"
RNG = np.random.default_rng(3)
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def texts():
    base = [prose(120, k) for k in range(40)]
    copies = [base[0]] * 6 + [base[1].replace("w1 ", "v1 ", 1), base[1] + " end"]
    odd = [None, "", " \n\t ", "a", "A b", "x" * 5000, "ä ö é.\nä ö é.\nä ö é.", "</s>[INST] <|endoftext|>   nb sp", prose(20_000, 99), base[2], base[2]]
    return [(k, t) for k, t in enumerate(base + copies + odd)] + [(3, base[3]), (3, "other text of the same id"), (None, base[5]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if k % 11 == 0 else f"s{k % 3}", 0, "x", "y", "z", 1, 2, 3, 4) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def key(x):
    return repr(x)


def words(t):
    return (t or "").encode().lower().split()


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_escapes_are_exact():
    for t in ("a\\</s>\\", "<\\/s>", "</s>[INST] ok [/INST]", "\\\\<s>", "<<s>", "[[INST]", "]\n", "<|x|>", ""):
        for made in (chat_tree.escape(t), chat_tree.escape_role(t)):
            assert chat_tree.unescape(made) == t
            assert not any(c in made for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|"))
        assert chat_tree.parse("".join(chat_tree.segments(t, t) * 2)) == [(t, t)] * 2


@pytest.fixture(scope="module")
def talks(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if t < shared else f"own {c} {t}") for c, shared, n in ((1, 3, 5), (2, 3, 4), (3, 1, 4), (4, 5, 5), (5, 0, 2), (6, 3, 3)) for t in range(n)]
    rows += [(7, 0, None, None), (7, 0, "assistant", ""), (7, None, "system", "[/INST]"), (None, 0, "user", "turn 0"), (8, 0, "user", "turn 0"), (8, 0, "user", "turn 0")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_digest(talks):
    got = {x["conv_id"]: x for x in chat_tree.chat_rows(talks).collect()}
    by = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for x in talks.collect():
        by.setdefault(x["conv_id"], []).append((-1 if x["turn"] is None else x["turn"], x["role"] or "", x["text"] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert tuple(got[c][k] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256")) == want


def test_tree_shares_turns_and_sees_exactly_its_ancestors(talks):
    nodes, paths = chat_tree.tree(talks)
    node = {(x["owner"], x["depth"]): x for x in nodes.collect()}
    assert len(node) < paths.count()
    order = sorted(node.values(), key=lambda x: x["start"])
    assert [x["start"] for x in order] == list(np.cumsum([0, *(x["n_tokens"] for x in order)])[:-1])
    path = {}
    for x in paths.orderBy("depth").collect():
        path.setdefault(x["conv"], []).append(node[(x["owner"], x["depth"])])
    for chain in path.values():
        seen, before = set(), 0
        for x in chain:
            assert {p for i in x["attention"] for p in range(i["from"], i["to"])} == seen and x["position"] == before
            seen |= set(range(x["start"], x["start"] + x["n_tokens"]))
            before += x["n_tokens"]


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_quality(docs, texts, none):
    got = sorted((x[0] if x[0] is not None else -1, *x[1:7]) for x in quality.quality_rows(docs).collect())
    want = []
    for i, t in texts:
        t = t or ""
        w = t.encode().split()
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        covered = {p for k, g in enumerate(grams) if count[g] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        want.append((-1 if i is None else i, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)))
    assert got == sorted(want)
    assert quality.quality_rows(none).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_containment_search_loses_nothing(spark, docs, texts, none):
    passage = texts[7][1].split()
    items = [(1, " ".join(passage[10:40])), (2, " ".join(passage[10:39]).upper() + "!"), (3, "w1 w2"), (4, ""), (5, None), (6, prose(30, 12345)), (7, " ".join(passage[:20] + ["zz"] + passage[21:60])), (1, " ".join(passage[10:40]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def shingles(t, n=5):
        w = decontaminate.words_of(t)
        n = min(n, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    want = []
    for i, t in texts:
        for item, s in {(a, b) for a, b in items if b}:
            own = shingles(s)
            n = min(5, len(decontaminate.words_of(s)))
            w = decontaminate.words_of(t)
            held = own & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if own and len(held) >= 0.8 * len(own):
                want.append((i, item, len(held)))
    for block in (2_000_000, 40):
        got = [(x["doc_id"], x["item_id"], x["n_shared"]) for x in decontaminate.leaks(docs, bench, block_words=block).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        kept = decontaminate.without_leaks(docs, bench, block_words=block)
        bad = {t for (i, t) in texts if any(d == i for d, _, _ in want) and any((i, it) == (d, j) for d, j, _ in want for it in [j])}
        assert kept.columns == docs.columns and kept.count() >= len(texts) - len(want)
        assert not {x["text"] for x in kept.collect()} & ({texts[7][1]} if bad else set())
    assert decontaminate.leaks(none, bench).count() == 0 and decontaminate.leaks(docs, bench.where("false")).count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------------


def two_tongues(n, seed):
    """Texts of words of one of two languages, some repeated, some spelled anew from syllables."""
    rng = np.random.default_rng(seed)
    tongues = [[a + b for a in "bdfg" for b in ("an", "en", "in")], [a + b for a in "klmnr" for b in ("o", "u", "ei")]]
    out = []
    for k in range(n):
        parts = tongues[k % 2]
        usual = ["".join(parts[(7 * i + j) % len(parts)] for j in range(2)) for i in range(30)]
        words_ = [str(rng.choice(usual)) if rng.random() < 0.9 else "".join(rng.choice(parts, int(rng.integers(2, 5)))) for _ in range(int(rng.integers(30, 120)))]
        out.append(" ".join(words_))
    return out


@pytest.fixture(scope="module")
def lm(spark):
    texts = two_tongues(240, 1) + [None, "", "z" * 3000, "one", prose(2500, 7)]
    training = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    return texts, attention_lm.learn(training)


def counted(texts):
    """Brute force: words, counts of tokens, and pairs of a token's last symbol and the next one's first."""
    speller = attention_lm.Speller(attention_lm.default_tokenizer())

    def spell(w):
        if not w:
            return [speller.end]
        ids = 2 * speller.spelled([w])[0].astype(int)
        return [*ids[:-1].tolist(), int(ids[-1]) + 1]

    tokens = [[*words(t), b""] for t in texts]
    c = Counter(w for t in tokens for w in t)
    symbols = {w: spell(w) for w in c}
    pairs = Counter((a[-1], b[0]) for t in tokens for a, b in zip([symbols[b""]] + [symbols[w] for w in t], [symbols[w] for w in t]))
    return spell, c, symbols, pairs


def test_lm_counts_whole_texts(lm):
    texts, model = lm
    _, c, symbols, pairs = counted(texts)
    t = model["tables"]
    assert {x["w"].encode(): x["c"] for x in model["counts"].collect()} == dict(c)
    want = np.zeros_like(t.pairs)
    for (a, b), n in pairs.items():
        want[t.last[a], t.first[b]] += n
    assert np.array_equal(t.pairs, want) and t.pairs.sum() == sum(c.values())
    assert np.array_equal(t.class_count.sum(1), want.sum(0))
    for s in {x[0] for x in symbols.values()}:
        assert t.starts[s] == sum(n for w, n in c.items() if symbols[w][0] == s) and t.distinct[s] == sum(symbols[w][0] == s for w in c if w)


def test_lm_probabilities_sum_to_one(lm):
    texts, model = lm
    _, c, symbols, _ = counted(texts)
    t = model["tables"]
    assert np.allclose(t.by_class.sum(0), 1, atol=1e-3)  # over rows of first symbols, for each class
    totals = np.zeros(t.rows)
    np.add.at(totals, t.first[t.starts > 0], np.exp(t.first_log[t.starts > 0]))
    assert (totals <= 1 + 1e-4).all()  # symbols of a row; the rest is for those never seen
    assert np.allclose(np.exp(t.chain).sum(1), 1, atol=0.02)  # what follows inside a word
    own = [w for w in c if w and symbols[w][0] == symbols[words(texts[0])[0]][0]]
    n, v = t.starts[symbols[own[0]][0]], len(own)
    assert abs(sum(c[w] - t.discount for w in own) / n + t.discount * v / n - 1) < 1e-9


def test_attention_gradients(lm):
    texts, model = lm
    t, rng = model["tables"], np.random.default_rng(0)
    w = {k: (v + rng.normal(0, 0.1, v.shape)).astype(np.float32) for k, v in attention_lm.start_weights(t.rows).items()}
    speller = attention_lm.Speller(model["path"], model)
    s = attention_lm.Sequences(speller, pa.array(texts[:6] + ["ban ban ban ban"]), 1)
    batch = lambda: s.batch(t, *(x[:7] for x in s.windows(attention_lm.WINDOW)), True)[0]
    b = batch()
    _, g = attention_lm.gradients(w, b)
    row, last = int(b.first[1, 3]), int(b.last[2, 4])
    for k, at in {"E1": (row, 2), "E2": (last, 5), "Wq": (1, 2), "Wk": (3, 4), "Wv": (0, 1), "r": (2,), "same": (0,), "Wo": (3, attention_lm.COPY), "S": (int(b.cls[5]), attention_lm.PAIR)}.items():
        step = []
        for e in (0.02, -0.02):
            moved = {**w, k: w[k].copy()}
            moved[k][at] += e
            step.append(attention_lm.gradients(moved, batch())[0])
        assert abs((step[0] - step[1]) / 0.04 - g[k][at]) < 3e-4, k


def brute_score(model, texts, text):
    """log10 probability of one text, token by token in double precision, from counts taken here."""
    spell, c, symbols, pairs = counted(texts)
    t, w = model["tables"], {k: v.astype(float) for k, v in model["weights"].items()}
    n_first, v_first = Counter(), Counter()
    for x, n in c.items():
        n_first[symbols[x][0]] += n
        v_first[symbols[x][0]] += bool(x)
    row_pairs, cls_pairs = Counter(), Counter()
    for (a, b), n in pairs.items():
        row_pairs[int(t.last[a]), int(t.first[b])] += n
        cls_pairs[int(t.class_of[t.last[a]]), int(t.first[b])] += n
    tokens = [b"", *words(text), b""]
    spelled = [spell(x) for x in tokens]
    total = 0.0
    for g in range(1, len(tokens)):
        i = g - 1  # place of the input; its window is the first that scores it
        first = 0 if i < attention_lm.WINDOW else attention_lm.STRIDE * -(-(i - attention_lm.WINDOW + 1) // attention_lm.STRIDE)
        seen = range(first, g)
        x = np.array([w["E1"][t.first[spelled[j][0]]] + w["E2"][t.last[spelled[j][-1]]] for j in seen])
        s = (x[-1] @ w["Wq"]) @ (x @ w["Wk"]).T / math.sqrt(attention_lm.WIDTH) + w["r"][[i - j for j in seen]]
        s = s + w["same"][0] * np.array([j < i and tokens[j] == tokens[i] for j in seen])
        a = np.exp(s - s.max())
        a /= a.sum()
        last, goal = int(t.last[spelled[i][-1]]), int(t.first[spelled[g][0]])
        cls = int(t.class_of[last])
        z = (a @ (x @ w["Wv"])) @ w["Wo"] + w["S"][cls]
        gate = np.exp(z - z.max())
        gate /= gate.sum()
        by = [(cls_pairs[k, goal] + attention_lm.PRIOR * t.share[goal]) / (sum(n for (q, _), n in cls_pairs.items() if q == k) + attention_lm.PRIOR) for k in range(attention_lm.CLASSES)]
        after = {b: n for (q, b), n in row_pairs.items() if q == last}
        pair = (max(after.get(goal, 0) - attention_lm.DISCOUNT, 0) + attention_lm.DISCOUNT * len(after) * by[cls]) / sum(after.values()) if after else by[cls]
        f = spelled[g][0]
        r = t.rank[spelled[g]]
        chain = sum(float(t.chain[p, q]) + float(t.inner_log[y]) for p, q, y in zip(r[:-1], r[1:], spelled[g][1:]))
        log_chain, known = chain, n_first[f] > 0 and v_first[f] > 0
        if tokens[g]:
            counts = max(c[tokens[g]] - t.discount, 0) / n_first[f] if known else 0.0
            log_spelled = log_chain + (math.log(t.discount * v_first[f] / n_first[f]) if known else 0.0)
        else:
            counts, log_spelled = 0.0, 0.0
        log_inside = float(t.first_log[f]) + np.logaddexp(log_spelled, math.log(counts) if counts else -1e300)
        copied = sum(a[j - first] for j in seen if j < i and tokens[j + 1] == tokens[g])
        share = gate[: attention_lm.CLASSES] @ by + gate[attention_lm.PAIR] * pair + gate[attention_lm.COPY] * a[-1] * by[cls]
        total += np.logaddexp(log_inside + math.log(share), math.log(gate[attention_lm.COPY] * copied) if copied else -1e300)
    return total / math.log(10)


@pytest.mark.parametrize("common", [3e-7, 0.004])  # with the larger bound most words meet their counts in the join
def test_lm_score_by_brute_force(spark, lm, monkeypatch, common):
    texts, model = lm
    monkeypatch.setattr(attention_lm, "COMMON", common)
    if common > 1e-3:
        h, c = model["common"]
        few = (h[c >= common * model["n"]], c[c >= common * model["n"]])
        small = {k: v for k, v in model.items() if k not in ("counts", "shared", "weights", "key")} | {"common": few}
        model = model | {"common": few, "key": model["key"] + "-few", "shared": spark.sparkContext.broadcast(small)}
    tried = [texts[0], texts[1] + " unheard ofword " + texts[3], None, "", "z" * 3000 + " z", "kuku " * 90, " ".join(texts[2].split()[:31]), texts[5].upper() + "!"]
    got = {x["doc_id"]: x for x in attention_lm.score(spark.createDataFrame(list(enumerate(tried)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(tried):
        want = brute_score(model, texts, text)
        assert abs(got[k]["score"] - want) < 2e-3 * max(1, abs(want)), (k, got[k]["score"], want)
        assert got[k]["n_tokens"] == len(words(text)) + 1


def test_lm_beats_word_shares_on_held_out_rows(spark, lm):
    _, model = lm
    fresh = two_tongues(60, 99)
    got = attention_lm.score(spark.createDataFrame(list(enumerate(fresh)), "doc_id long, text string"), model).collect()
    assert np.mean([x["score"] > x["base_score"] for x in got]) > 0.9


def test_lm_base_score(docs, texts, none):
    apart = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in texts]
    c = Counter(w for a, (_, t) in zip(apart, texts) if not a for w in [*words(t), b""])
    n, v = sum(c.values()), len(c)
    want = [(i, a, len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), b""]), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), b""]), 4)) for a, (i, t) in zip(apart, texts)]
    rows = attention_lm.lm_rows(docs).collect()
    assert sorted([(*x[:5], round(x["base_score"], 4)) for x in rows], key=key) == sorted(want, key=key)
    assert all(x["score"] < 0 and np.isfinite(x["score"]) for x in rows)
    assert attention_lm.lm_rows(none).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------------


def test_licences_come_from_the_nearest_directory(spark, none):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = [(1, "/a/LICENSE", mit), (2, "/a/x.py", "code"), (3, "/a/b/c/y.py", "code\n" + gpl + "\nmore"), (4, "/a/b/COPYING", gpl), (5, "/a/b/c/z.py", None), (6, "/d/z.py", ""), (7, None, "the licence of the poet is a free thing"), (2, "/a/x.py", "code"), (8, "/ab/x.py", "code")]
    got = sorted((x["file_id"], x["own_license"], x["license"]) for x in licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string")).collect())
    assert [(a, b or "", c or "") for a, b, c in got] == [(1, "MIT", "MIT"), (2, "", "MIT"), (2, "", "MIT"), (3, "GPL-3.0", "GPL-3.0"), (4, "GPL-3.0", "GPL-3.0"), (5, "", "GPL-3.0"), (6, "", ""), (7, "", ""), (8, "", "")]
    assert licenses.license_rows(none).count() == 0


def test_wrapped_headers_and_short_forms(spark):
    gpl = "This {} is free software: you can redistribute it and/or modify\nit under the terms of the GNU {}General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0"
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal\nin the Software without restriction"
    comment = lambda x: "\n".join(f"# {y}".rstrip() for y in x.split("\n"))
    want = [("Apache-2.0", apache), ("MIT", mit), ("GPL-3.0", gpl.format("program", "")), ("LGPL-3.0", gpl.format("library", "Lesser ")), ("Proprietary", "All rights reserved."),
            ("Proprietary", "Copyright 2021 Example Corp. All rights reserved."), ("MIT", "SPDX-License-Identifier: MIT"), ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only")]
    files = [(2 * k + j, f"/f{k}.py", f(x) + "\n\ncode and more code") for k, (_, x) in enumerate(want) for j, f in enumerate((str, comment))]
    files += [(100 + k, f"/n{k}", prose(80, k)) for k in range(200)] + [(400, "/p", "the licence of the poet is a free thing")]
    got = {x["file_id"]: x["own_license"] for x in licenses.own_licences(spark.createDataFrame(files, "file_id long, path string, text string")).collect()}
    assert [(got[2 * k], got[2 * k + 1]) for k in range(len(want))] == [(name, name) for name, _ in want]
    assert not any(got[k] for k in [*range(100, 300), 400])


def brute_licence(text, path, n, df):
    """Best ``(name, cosine)`` over all passages of a file, in plain Python."""
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for _, x in licenses.TEMPLATES for t in licenses.terms(x)}
    tokens = lambda x: re.findall(r"[^\W_]+", x.lower())
    text = text or ""
    speaks = re.compile(licenses.SPEAKS)
    passages = [x for x in text.split("\n") if speaks.search(x)]
    bare = "\n".join(re.sub(r"^[ \t]*(?:[#*;%]+|//+|/\*+|--+|\*/)?[ \t]*", "", x) for x in text.split("\n"))
    passages += [x for x in re.split(r"\n\s*\n", bare) if "\n" in x and speaks.search(x)]
    passages += [text] if re.search(licenses.LICENCE_FILE, path or "") else []
    best = (0.0, None)
    for passage in passages:
        tf = Counter(tokens(passage))
        norm = math.sqrt(sum((c * idf[t]) ** 2 if t in idf else c for t, c in tf.items()))
        for k, (_, template) in enumerate(licenses.TEMPLATES):
            own = Counter(licenses.terms(template))
            size = math.sqrt(sum((c * idf[t]) ** 2 for t, c in own.items()))
            dot = sum(c * idf[t] * tf[t] * idf[t] for t, c in own.items()) / size
            if norm and dot / norm > best[0] + 1e-12:
                best = (dot / norm, k)
    return (licenses.TEMPLATES[best[1]][0], round(best[0], 6)) if best[1] is not None and best[0] >= licenses.LEAST_COSINE else (None, None)


def test_licences_by_brute_force(spark):
    files = [(x["file_id"], x["path"], x["text"]) for x in licenses.document_files(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()]
    files += [(5000 + k, f"/x/d{k % 7}/{'LICENSE' if k % 9 == 0 else 'f.py'}", f"# {t}\ncode\n\n" + prose(20, k)) for k, (_, t) in enumerate(licenses.TEMPLATES)]
    files += [(6000, "/x/d1/big.py", prose(30_000, 4) + "\n" + licenses.TEMPLATES[3][1]), (6001, None, None), (6002, "/x/d1/deep/er/y", ""), (6002, "/x/d1/deep/er/y", "")]
    vocabulary = {t for _, x in licenses.TEMPLATES for t in licenses.terms(x)}
    df = Counter(t for _, _, x in files for t in vocabulary & set(re.findall(r"[^\W_]+", (x or "").lower())))
    own = {k: brute_licence(t, p, len(files), df) for k, p, t in files}
    of_dir: dict = {}
    for k, p, _ in sorted(files, key=lambda f: f[1] or ""):
        if own[k][0] and re.search(licenses.LICENCE_FILE, p or ""):
            at = p.rsplit("/", 1)[0]
            of_dir[at] = min(of_dir.get(at, (0, "~")), (-own[k][1], p, own[k][0]))
    want = []
    for k, p, _ in files:
        at, found = (p or "").rsplit("/", 1)[0] if "/" in (p or "") else "", None
        up = at
        while found is None:
            found = up if up in of_dir else None
            if not up:
                break
            up = up.rsplit("/", 1)[0]
        want.append((k, own[k][0], own[k][1], found, own[k][0] or (of_dir[found][2] if found is not None else None)))
    got = licenses.scan(spark.createDataFrame(files, "file_id long, path string, text string").repartition(3)).collect()
    assert sorted([(x["file_id"], x["own_license"], x["own_score"], x["licensed_dir"], x["license"]) for x in got], key=key) == sorted(want, key=key)
    assert sum(w[1] is not None for w in want) > 20 and sum(w[3] is not None for w in want) > 10


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_mix(docs, texts, none):
    rows = pivotal_mix.mix_rows(docs).collect()
    assert len(rows) == len(texts) and all(0 <= x["taken"] <= 2 * x["size"] for x in rows)
    again = pivotal_mix.mix_rows(docs.repartition(3)).collect()
    assert sorted(rows, key=key) == sorted(again, key=key)
    sources = {}
    for k, (_, t) in enumerate(texts):
        s = None if k % 11 == 0 else f"s{k % 3}"
        sources[s] = sources.get(s, 0) + len(words(t))
    order = sorted((s for s in sources if s is not None)) + [None]
    weight, total = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sources.values())
    stopped, goal = set(), {}
    while True:
        left = total - sum(2 * sources[s] for s in stopped)
        free = [s for s in order if s not in stopped]
        goal = {s: 2.0 * sources[s] if s in stopped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if goal[s] > 2 * sources[s]}
        if not above:
            break
        stopped |= above
    taken = Counter()
    for x in rows:
        taken[(x["source_size"], round(x["target"], 6))] += x["taken"]
    assert {k for k in taken} == {(sources[s], round(goal[s], 6)) for s in order}
    largest = {s: max([0] + [len(words(t)) for k, (_, t) in enumerate(texts) if (None if k % 11 == 0 else f"s{k % 3}") == s]) for s in order}
    bound = {(sources[s], round(goal[s], 6)): largest[s] for s in order}
    assert all(abs(t - k[1]) <= bound[k] for k, t in taken.items())  # off by less than one document
    assert pivotal_mix.mix_rows(none).count() == 0
    assert pivotal_mix.mixed_documents(docs).columns == docs.columns


def test_rounding_is_near_target_and_unbiased(spark):
    df = spark.range(3000).selectExpr("id as key", "'s' || (id % 2) as source", "1 + id % 37 as size")
    total = 0
    for seed in range(3):
        rows = pivotal_mix.mix(df, seed=seed).collect()
        for s in ("s0", "s1"):
            own = [x for x in rows if x["source"] == s]
            assert abs(sum(x["copies"] * x["size"] for x in own) - own[0]["target"]) <= 38
            assert {x["copies"] for x in own} <= {math.floor(own[0]["target"] / own[0]["source_size"]), math.ceil(own[0]["target"] / own[0]["source_size"])}
        total += sum(x["copies"] for x in rows)
    assert abs(total / 9000 - 1.5) < 0.03


def test_many_equal_rows_share_their_copies(spark):
    df = spark.range(200).selectExpr("cast(null as long) as doc_id", "'a b c' as text", "'s' as source")
    rows = pivotal_mix.mix_rows(df).collect()
    assert len(rows) == 200 and sum(x["taken"] for x in rows) == 900 and {x["taken"] for x in rows} == {3, 6}
    assert pivotal_mix.mixed_documents(df).count() == 300
    numbered = pivotal_mix._numbered(spark.createDataFrame([("a", 7), ("b", 1), ("c", 4)], "x string, n long"), "n", "k", run=3)
    assert sorted((x["x"], x["k"]) for x in numbered.collect()) == [("a", k) for k in range(7)] + [("b", 0)] + [("c", k) for k in range(4)]


# 7 ---------------------------------------------------------------------------------------------------------------------


def test_shards(docs, texts, none):
    rows = shard.shard_rows(docs).collect()
    want = sorted((-1 if i is None else i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["size"], x["text_crc32"]) for x in rows) == want
    by = {}
    for x in rows:
        by.setdefault(x["shard"], []).append(x)
    assert all(sorted(x["slot"] for x in v) == list(range(len(v))) for v in by.values())
    ordered = sorted(rows, key=lambda x: (x["shard"], x["slot"]))
    ids = [-1 if x["doc_id"] is None else x["doc_id"] for x in ordered]
    assert ids == sorted(ids) and set(by) <= set(range(24))
    total, at = sum(x["size"] for x in rows), 0
    for x in ordered:
        assert x["shard"] == min(23, (2 * at + x["size"]) * 24 // (2 * total))
        at += x["size"]
    assert shard.shard_rows(none).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------------


def simhash(t):
    w = words(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(k) for k in range(len(fps))]


def test_simhash_components(docs, texts, none):
    fps = [simhash(t) for _, t in texts]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(texts, roots):
        least[r] = min(least.get(r, math.inf), math.inf if i is None else i)
    want = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(texts, fps, roots)]
    assert sorted(map(tuple, simhash_pivot.simhash_rows(docs).collect()), key=key) == sorted(want, key=key)
    kept = simhash_pivot.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert simhash_pivot.simhash_rows(none).count() == 0 and simhash_pivot.keep_one(none).count() == 0


@pytest.mark.parametrize("hot", [simhash_pivot.HOT, 16])
def test_links_of_large_buckets_stay_connected(spark, hot):
    rng = np.random.default_rng(0)
    center = int(rng.integers(1 << 62))
    fps = list({center ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 5), replace=False)) for _ in range(400)}) + [int(x) for x in rng.integers(0, 1 << 62, 300)]
    edges = simhash_pivot.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot).distinct().collect()
    assert all((x["a"] ^ x["b"]).bit_count() <= 3 for x in edges) and len(edges) < 20 * len(fps)
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in edges:
        parent[root(x["a"])] = root(x["b"])
    groups = lambda label: sorted(sorted(f for f in fps if label(f) == g) for g in {label(f) for f in fps})
    brute = dict(zip(fps, brute_components(fps)))
    assert groups(root) == groups(brute.get)


def test_forest_of_many_near_copies():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 19, 2000).astype(np.uint64))
    table = np.bitwise_count(x[:, None] ^ np.array(simhash_pivot._pivots(), np.int64).view(np.uint64)[None, :]).astype(np.int16)
    i, j = simhash_pivot._forest(x, table, 3, block=256)
    assert len(i) < len(x) and (np.bitwise_count(x[i] ^ x[j]) <= 3).all()
    parent = np.arange(len(x))
    for a, b in zip(i.tolist(), j.tolist()):
        parent[parent == parent[a]] = parent[b]
    near, label = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3, np.arange(len(x))
    while (new := np.where(near, label[None, :], len(x)).min(axis=1)).sum() < label.sum():
        label = new
    assert len(set(zip(parent.tolist(), label.tolist()))) == len(set(parent.tolist())) == len(set(label.tolist())) > 1


# 9 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_tokens_round_trip(spark, docs, texts, none, tmp_path, encoding):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_table.default_tokenizer())
    path = f"file://{tmp_path}/t"
    got = token_table.token_rows(docs, path, encoding=encoding).collect()
    start, ids = 0, {}
    crc = Counter()
    for i, t in texts:
        own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        crc[(i, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))] += 1
        ids.setdefault(i, []).append(own)
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_crc32"]) for x in got) == crc
    for x in sorted(got, key=lambda x: x["start"]):
        assert x["start"] == start
        start += x["n_tokens"]
    numbers = [-1 if x["doc_id"] is None else x["doc_id"] for x in sorted(got, key=lambda x: x["start"])]
    assert numbers == sorted(numbers)
    assert sorted(list(x["ids"]) for x in token_table.read_tokens(spark, path, 10, 12).collect()) == sorted(o for i in (10, 11, 12) for o in ids[i])
    assert token_table.read_metadata(spark, path).count() == len(texts)
    assert token_table.token_rows(none).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    bad, rng = ["idiot", "moron", "lowlife", "pferdschaft", "pferdlich", "pferdend", "ñuelo", "ñuelando"], np.random.default_rng(2)
    rows, labels = [], []
    for k in range(1200):
        toxic = k % 6 == 0
        t = prose(60, 1000 + k).split()
        for _ in range(3 * toxic):
            t.insert(int(rng.integers(60)), bad[int(rng.integers(len(bad)))])
        rows.append((k, " ".join(t)))
        labels.append((k, 1, int(toxic)))
    docs, labels = spark.createDataFrame([*rows, (5000, None), (5001, ""), (None, "moron")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_rows(docs, labels).collect()
    assert len(got) == 1203 and all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.5) for x in got)
    apart = [x for x in got if x["held_out"] and x["doc_id"] is not None and x["doc_id"] < 1200]
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got if x["doc_id"] is not None)
    assert np.mean([x["predicted"] == (x["doc_id"] % 6 == 0) for x in apart]) > 0.98
    assert {x["predicted"] for x in got if x["doc_id"] in (5000, 5001)} == {0}
    assert toxicity.without_toxic(docs, labels).count() == sum(x["predicted"] == 0 for x in got)
    assert {x["score"] for x in toxicity.toxicity_rows(docs, labels.where("false")).collect()} == {0.0}


def letter_terms(text):
    """Brute force: terms of a text with how often they occur."""
    found = Counter()
    for w in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        found.update([w, *(w[:n] + "*" for n in toxicity.BEGINNINGS if len(w) >= n)])
    return found


def test_terms_are_counted_and_fire_as_by_brute_force(spark):
    rng = np.random.default_rng(5)
    stems = ["straße", "Élan", "banana", "x", "international", "ab", "WORDS"]
    rows = [(" ".join(str(rng.choice(stems)) + str(rng.choice(["", "s", "ly!", "-1"])) for _ in range(int(rng.integers(0, 30)))), int(k % 3 == 0)) for k in range(80)] + [(None, 0), ("", 1), ("banana " * 30_000, 1)]
    got = {x["term"]: (x["bad"], x["n"]) for x in toxicity.term_counts(spark.createDataFrame(rows, "text string, toxic int")).collect()}
    want: dict = {}
    for t, y in rows:
        for name, n in letter_terms(t).items():
            for term in [name] + ["2 " + name] * (n > 1):
                b, m = want.get(term, (0, 0))
                want[term] = (b + y, m + 1)
    assert got == want
    terms = ["banana", "2 banana", "stra*", "2 inte*", "élan"]
    votes = toxicity.Votes(terms)
    rows_, fired, n_words, hits = votes(pa.array([t for t, _ in rows]))
    fires = {(int(r), terms[v]) for r, v in zip(rows_, fired) if v < len(terms)}
    assert fires == {(k, t) for k, (x, _) in enumerate(rows) for t in terms if letter_terms(x)[t.removeprefix("2 ")] >= (2 if t.startswith("2 ") else 1)}
    names = {t.removeprefix("2 ") for t in terms}
    for k, (x, _) in enumerate(rows):
        each = "".join(c if c.isalpha() else " " for c in (x or "").lower()).split()
        assert n_words[k] == len(each) and hits[k] == sum(bool(names & set(letter_terms(w))) for w in each)


def test_label_model_by_brute_force():
    rng = np.random.default_rng(11)
    n, share, hit, false = 6000, 0.2, (0.8, 0.7, 0.6, 0.7, 0.5, 0.75), (0.05, 0.1, 0.02, 0.08, 0.03, 0.1)
    y = rng.random(n) < share
    votes = np.column_stack([rng.random(n) < np.where(y, a, b) for a, b in zip(hit, false)]).astype(float)
    votes = np.column_stack((votes, np.where(rng.random(n) < 0.95, votes[:, 1], 1 - votes[:, 1])))  # says what voter 1 says
    model = toxicity.label_model(votes, np.where(votes[:, 0] > 0, 0.9, 0.1))
    # posteriors from the returned chances, row by row
    for k in range(0, n, 97):
        joint = []
        for c, s in ((0, 1 - model["share"]), (1, model["share"])):
            for j in range(7):
                up = model["parent"][j]
                p = model["chance"][c, int(votes[k, up]) if up >= 0 else 0, j]
                s *= p if votes[k, j] else 1 - p
            joint.append(s)
        assert abs(joint[1] / sum(joint) - model["posterior"][k]) < 0.01
    # accuracies near the truth, and the copied voter hangs on its source
    for j in range(6):
        assert abs(model["accuracy"][j] - share * hit[j] / (share * hit[j] + (1 - share) * false[j])) < 0.05
    assert model["parent"][6] == 1 or model["parent"][1] == 6
    assert model["correlation"][1, 6] > 0.6 and abs(model["correlation"][0, 2]) < 0.1
    assert np.mean((model["posterior"] > 0.5) == y) > 0.95
    alone = toxicity.label_model(np.delete(votes, 6, 1), np.where(votes[:, 0] > 0, 0.9, 0.1))
    assert np.abs(alone["posterior"] - model["posterior"]).mean() < 0.02  # a copy adds no evidence


def test_copies_of_a_toxic_text_prove_no_terms(spark):
    rng = np.random.default_rng(9)
    long = prose(200, 5000).replace("w", "word") + " rareterm rareterm"
    spelled = lambda t: "".join(chr(97 + int(c)) if c.isdigit() else c for c in t)  # noqa: E731  (words of letters)
    rows = [(spelled(prose(60, 6000 + k)) + (" slur" * (k % 6 == 0)) + " " + spelled(prose(5, k)), int(k % 6 == 0)) for k in range(600)]
    for _ in range(120):  # near copies with one word less
        w = spelled(long).split()
        del w[int(rng.integers(len(w) - 3))]
        rows.append((" ".join(w), 1))
    terms = toxicity.mine(spark.createDataFrame(rows, "text string, toxic int"))
    assert "slur" in [t.rstrip("*") for t in terms] and not any("raret" in t for t in terms[:3])
    assert toxicity._apart(120, 6) < 1 and toxicity._apart(40, 40) == 40 and toxicity._apart(0, 0) == 0


def test_neighbours_make_no_more_rows_for_more_copies(spark, monkeypatch):
    real, made = toxicity.map_arrow, []

    def counted(df, fn, schema):
        total = spark.sparkContext.accumulator(0)
        made.append(total)

        def run(batches):
            for batch in fn(batches):
                total.add(batch.num_rows)
                yield batch

        return real(df, run, schema)

    monkeypatch.setattr(toxicity, "map_arrow", counted)
    spelled = lambda t: "".join(chr(97 + int(c)) if c.isdigit() else c for c in t)
    text = spelled(prose(60, 8000)).split()
    terms = sorted({t for w in text for t in letter_terms(w)})
    others = [(spelled(prose(20, 8100 + k)), k % 2) for k in range(20)] + [(None, 0), ("", 1), (" ".join(text[:30]), 0)]
    for copies in (20, 200):
        near = [" ".join([*text[: k % 10], f"odd{chr(97 + k % 10)}", *text[k % 10 + 1 :]]) for k in range(copies)]  # one of ten places differs
        rows = [(" ".join(text), 1)] * copies + [(t, 1) for t in near] + others
        got = toxicity.neighbours(spark.createDataFrame(rows, "text string, toxic int").coalesce(1), terms)
        want: dict = {}
        for t, y in set(rows):
            words = (t or "").split()
            digest = [xxhash.xxh64_intdigest(w) for w in words]
            least: dict = {}
            for k, w in enumerate(words):
                pair = np.array([digest[k - 1] if k else 0, digest[k + 1] if k + 1 < len(words) else 0], np.uint64)
                around = int(toxicity.mix64(pair[:1] ^ toxicity.mix64(pair[1:])).view(np.int64)[0])
                for name in letter_terms(w):
                    least[name] = min(around, least.get(name, around))
            for name in least.keys() & set(terms):
                want.setdefault((name, y), set()).add(least[name])
        assert got == {k: len(v) for k, v in want.items()}
        assert made[-1].value == sum(got.values())  # one task, one batch


def test_toxicity_edges(spark):
    rows, labels = [], []
    for k in range(600):
        toxic = k % 5 == 0
        said = "".join(chr(97 + int(c)) if c.isdigit() else c for c in prose(30, k)).split()
        said[k % 25 : k % 25] = ["vermin", said[0], "filth"] * toxic
        rows.append((k, " ".join(said), 0.5, "p", {"a": 1}))
        labels.append((k, int(toxic)))
    labels += [(1, 1), (1, 0), (None, 1), (2, None), (3, 7)]  # two labels, no id, no label, no class
    rows += [(9000, "vermin filth " + "calm words " * 60_000, 0.1, "p", None), (9001, None, 0.1, "p", None), (9001, "", 0.1, "p", None), (None, "vermin filth", 0.1, "p", None), (9002, "vermin filth", 0.1, "p", None), (9002, "vermin filth", 0.1, "p", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, toxic string, hits map<string,int>")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.toxicity_rows(docs, marks).collect()
    assert len(scored) == len(rows)
    of = Counter((x["doc_id"], round(x["score"], 9), x["predicted"]) for x in scored)
    assert {p for i, _, p in of if i == 9002} == {1} and max(v for (i, _, _), v in of.items() if i == 9002) == 2  # repeated rows alike
    assert {p for i, _, p in of if i == 9001} == {0} and len([1 for i, _, _ in of if i == 9001]) == 1  # null and empty alike
    kept = toxicity.without_toxic(docs, marks)
    assert kept.columns == docs.columns and kept.count() == sum(x["predicted"] == 0 for x in scored)
    assert toxicity.toxicity_rows(docs.where("false"), marks).count() == 0 and toxicity.without_toxic(docs.where("false"), marks).count() == 0
    again = sorted((x["doc_id"] or -1, x["score"]) for x in toxicity.toxicity_rows(docs.repartition(7), marks).collect())
    assert np.allclose([s for _, s in again], [s for _, s in sorted((x["doc_id"] or -1, x["score"]) for x in scored)], atol=1e-6)
    assert {x["score"] for x in toxicity.toxicity_rows(docs, marks.where("toxic = 1")).collect()} == {0.0}


# SQL -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    plain = lambda rows: sorted(repr(tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names)) for r in rows)
    rows = [dict(zip([d[0] for d in want.description], r)) for r in want.fetchall()]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == names and plain([r.asDict() for r in got.collect()]) == plain(rows)


# all columns -----------------------------------------------------------------------------------------------------------

ODD = "doc_id long, text string, lang string, source string, n_chars long, more map<string,int>, _key int, _row string, copies int, m int"


def odd_documents(spark):
    """Rows with nulls, ties and copies, and further columns that clash with those that the operators add."""
    rows = [(k, prose(60, 300 + k), "en", f"s{k % 3}", 1, {"a": k}, k, "r", 1, 2) for k in range(30)]
    rows += [(1, prose(60, 301), "en", "s1", 1, {"a": 99}, 7, "other", 1, 2), (2, prose(60, 302), "en", "s2", 1, {"a": 2}, 2, "r", 1, 2), (None, prose(60, 300), None, None, None, None, None, None, None, None)]
    rows += [(50, None, "en", "s1", None, None, 0, None, 0, 0), (51, "", "en", None, None, {}, 0, None, 0, 0), (52, " \n", None, "s1", None, {}, 0, None, 0, 0), (53, prose(30_000, 9), "en", "s1", 1, {"z": 1}, 0, None, 0, 0)]
    return spark.createDataFrame(rows, ODD).repartition(3)


def test_mixed_documents_keep_rows_that_differ_in_any_column(spark):
    docs = odd_documents(spark)
    kept = pivotal_mix.mixed_documents(docs)
    assert kept.columns == docs.columns
    plain = lambda df: Counter(repr(x.asDict(True)) for x in df.collect())
    before, after = plain(docs), plain(kept)
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    taken = Counter()
    for x in pivotal_mix.mix_rows(docs).collect():
        taken[x["doc_id"]] += x["taken"]
    assert plain(kept) == after and abs(sum(len(words(x["text"])) for x in kept.collect()) - sum(taken.values())) <= 2 * 30_000
    assert {x["more"]["a"] for x in kept.where("doc_id = 1").collect()} <= {1, 99}


def test_one_row_of_each_group_whatever_its_columns(spark):
    docs = odd_documents(spark)
    kept = simhash_pivot.keep_one(docs).collect()
    assert Counter(x["doc_id"] for x in kept)[1] == 1 and not [x for x in kept if x["doc_id"] is None]  # the null id copies row 0
    assert sorted(x["doc_id"] for x in kept) == [*range(30), 50, 53]  # rows without words are one group
    assert [x["more"] for x in kept if x["doc_id"] == 1] == [{"a": 1}]  # of equal ids and texts the smallest other columns


def test_blocks_of_the_benchmark_give_the_same_matches(spark, docs, texts):
    items = spark.createDataFrame([(k, prose(40, k)) for k in range(12)] + [(90, "w1"), (91, None)], "item_id long, text string")
    plain = lambda n: sorted(map(tuple, decontaminate.leaks(docs, items, block_words=n).collect()), key=key)
    assert plain(60) == plain(10**6) and len(plain(60)) > 0
    clean = lambda n: sorted((repr(x) for x in decontaminate.without_leaks(docs, items, block_words=n).collect()))
    assert clean(60) == clean(10**6)


def test_signatures_lose_no_match():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 9, 17, 40, 200):
        own = [f"x{i}" for i in rng.choice(10**6, n + 4, replace=False)]
        sketch = decontaminate.Sketches([(0, " ".join(own))], 5, 0.8)
        assert sketch.least[0] >= 1
        for _ in range(30):
            held = rng.random(len(own)) < rng.choice([0.8, 0.9, 0.97, 1.0])
            text = " ".join(w if h else f"y{rng.integers(99)}" for w, h in zip(own, held))
            shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
            mine = shingles(" ".join(own))
            shared = len(mine & shingles(text))
            assert [m[1] for m in sketch.matches(text)] == ([shared] if shared >= 0.8 * len(mine) - 1e-9 else [])


# pipeline --------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == columns
        if name != "mixing":
            assert kept.subtract(docs).count() == 0
        docs = kept
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count()
    assert corpus_pipeline.run(spark, sf).select(F.sum("n_tokens")).first()[0] == last.select(F.sum("n_tokens")).first()[0]


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, ties, repeated rows, clashing columns and an empty table; decisions of each stage are those of its operator."""
    import corpus_pipeline

    sf = str(tmp_path)
    docs = odd_documents(spark)
    spark.createDataFrame([(1, prose(60, 305)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    now, empty = docs, docs.where("false")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, sf).columns == docs.columns and stage(spark, empty, sf).count() == 0
        now = attention_lm.written(stage(spark, now, sf), "odd")
        assert now.columns == docs.columns and [f.dataType for f in now.schema] == [f.dataType for f in docs.schema]
        kept.append({x["doc_id"] for x in now.collect()})
    assert kept[0] == {x["doc_id"] for x in docs.collect()}  # one class of labels: nothing is toxic
    assert kept[1] == {*range(30), 50, 53} and kept[2] == kept[1] - {5} and kept[3] <= kept[2]
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf).count() == 0
    done = corpus_pipeline.run(spark, sf)
    assert done.count() == now.count() and done.select(F.sum("n_tokens")).first()[0] == done.select(F.max(F.col("start") + F.col("n_tokens"))).first()[0]
