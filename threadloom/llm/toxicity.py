"""Toxicity by weak supervision.

1. Voters. Terms that tell toxic from other rows of the labelled sample become lexicon voters: whole words and word beginnings of
   4 to 10 letters, present at all or at least twice. A term must say more about the label than chance lets the best of all
   tried terms say (``CHANCE_TERMS``), so weak terms count where there are many rows, and strong ones where there are few. Copies of a
   text, exact or not, prove nothing anew: in each class a term's rows count in the share in which they differ in neighbours (of the
   pairs of words before and after its places in a text, the one with the least hash). Most vote for toxic, some for clean. Fixed patterns (shouting, runs of marks, insults at "you", spelled-out letters), the absence of
   any toxic term in a text of some length, and the label given by hand are further voters. A voter fires or not.
2. Label model. A generative model of two classes: each voter fires with a chance that depends on the class and on one other voter,
   its parent, so that voters that say the same count once. Parents make a forest of the strongest correlations that are left
   within the classes. Chances, correlations and the posterior of each row are fitted by expectation maximization; a voter's
   accuracy is the posterior share of its class among the rows on which it fires. The label given by hand starts the posteriors and
   is one more voter with its own estimated accuracy, so a wrong label can be outvoted.
3. Classifier. Logistic regression on the votes of terms and patterns, the number of hits and their density, trained on the
   posteriors; intercept and slope are then calibrated on the sample's labels.

The sample is the ``FIT_ROWS`` labelled rows with the smallest hash of their id (a documented bound); it takes whole texts.
Scoring reads every document once, map-side. Inputs of a score: the text alone.

Defined cases: null and empty texts fire no voter and get the score of the intercept; an id with two different labels trains as
two rows; rows without a usable label don't train; no usable label, or one class only, gives score 0 everywhere; terms that say
equally much are ordered by their spelling; texts of any length are taken whole; an empty table gives an empty result; further
columns are kept by ``without_toxic`` whatever their names and types.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_arrow, mix64, written
from .token_table import pieces

FIT_ROWS = 20_000
#: Lexicon voters at most, rows of its class that a term must mark, and how many terms may come in by chance.
MOST_TERMS, LEAST_ROWS, CHANCE_TERMS = 400, 3, 5
#: The least part of the rows of a term for toxic that are toxic, and of one that counts as a hit.
LEAST_PART, STRONG_PART = 0.5, 0.7
#: Terms whose neighbours are counted, those that say most.
MOST_TRIED = 40_000
BEGINNINGS = tuple(range(4, 11))
#: Words from which on a text without any toxic term counts as a vote for clean.
QUIET_WORDS = 20
_NO_LETTER = r"[^\p{L}\p{M}]+"
PATTERNS = {
    "marks": r"[!?]{3,}",
    "shout": r"(?:\p{Lu}{4,}\s+){2,}\p{Lu}{4,}",
    "you": r"(?i)(?:^|[^\p{L}])(?:you|du|vous|usted)\s+(?:are|bist|êtes|es)\s+(?:a|an|ein|un|une|so)(?:[^\p{L}]|$)",
    "spelled": r"(?:\p{L}[.*_-]){3,}\p{L}(?:[^\p{L}]|$)",
    "starred": r"\p{L}+\*{2,}\p{L}+",
}


def word_lists(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """Lower-case letter runs of all texts, the text of each, and the number of words of each text; null has none."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), _NO_LETTER)
    words, of = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.not_equal(words, "")
    words, of = words.filter(full), of[full.to_numpy(zero_copy_only=False)]
    return words.dictionary_encode(), of, np.bincount(of, minlength=len(texts))


def _beginnings(words: pa.Array, n: int) -> tuple[np.ndarray, pa.Array]:
    """Which words have at least ``n`` letters, and their first ``n``; 0 stands for whole words."""
    if not n:
        return np.arange(len(words)), words
    long = pc.greater_equal(pc.utf8_length(words), n)
    return np.flatnonzero(long.to_numpy(zero_copy_only=False)), pc.utf8_slice_codeunits(words.filter(long), 0, n)


class Votes:
    """Which voters fire on texts. Terms: a word, a beginning with ``*``; ``2 `` before it asks for two places."""

    def __init__(self, terms: list[str]):
        self.terms, self.n = terms, len(terms)
        self.size = self.n + len(PATTERNS)
        base = [t.removeprefix("2 ") for t in terms]
        self.least = np.array([2 if t.startswith("2 ") else 1 for t in terms], np.int64)
        self.names = names = sorted(set(base))
        self.of_name = [np.array([k for k, b in enumerate(base) if b == name], np.int64) for name in names]
        self.by_length = []
        for n in (0, *BEGINNINGS):
            own = [k for k, name in enumerate(names) if (len(name) - 1 if name.endswith("*") else 0) == n]
            if own:
                self.by_length.append((n, pa.array([names[k].removesuffix("*") for k in own], pa.large_string()), np.array(own, np.int64)))

    def places(self, words: pa.DictionaryArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of the names that words match, and the places of those words, for each length of beginnings."""
        at = words.indices.to_numpy()
        for length, known, own in self.by_length:
            which, starts = _beginnings(words.dictionary, length)
            found = pc.fill_null(pc.index_in(starts, value_set=known), -1).to_numpy(zero_copy_only=False)
            of_word = np.full(len(words.dictionary), -1, np.int64)
            of_word[which] = np.where(found >= 0, own[np.maximum(found, 0)], -1)
            name = of_word[at]
            places = np.flatnonzero(name >= 0)
            yield name[places], places

    def __call__(self, texts: pa.Array, strong: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (text, voter) that fire, and for each text its words and its places with a term (of those with ``strong``)."""
        words, of, n_words = word_lists(texts)
        n, pairs, hit = len(texts), [], np.zeros(len(words), bool)
        names = len(self.of_name)
        good = np.ones(names, bool) if strong is None else np.array([strong[k].any() for k in self.of_name], bool)
        for name, places in self.places(words):
            pairs.append(of[places].astype(np.int64) * names + name)
            hit[places[good[name]]] = True
        pair, count = np.unique(np.concatenate(pairs) if pairs else np.empty(0, np.int64), return_counts=True)
        rows, fired = [], []
        for k, own in enumerate(self.of_name) if len(pair) else ():
            mine = pair % names == k
            for v in own:
                row = pair[mine & (count >= self.least[v])] // names
                rows.append(row)
                fired.append(np.full(len(row), v))
        filled = pc.fill_null(texts.cast(pa.large_string()), "")
        for k, pattern in enumerate(PATTERNS.values()):
            row = np.flatnonzero(pc.match_substring_regex(filled, pattern).to_numpy(zero_copy_only=False))
            rows.append(row)
            fired.append(np.full(len(row), self.n + k))
        return np.concatenate(rows), np.concatenate(fired), n_words, np.bincount(of[hit], minlength=n)


def term_counts(sample: DataFrame) -> DataFrame:
    """``(term, bad, n)``: rows and toxic rows of ``sample(text, toxic)`` that hold each term. Counted in runs, then combined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 8 << 20) if whole.num_rows else ():
                toxic = batch.column("toxic").to_numpy() == 1
                words, of, _ = word_lists(batch.column("text"))
                at = words.indices.to_numpy()
                for n in (0, *BEGINNINGS):
                    which, starts = _beginnings(words.dictionary, n)
                    table = starts.dictionary_encode()
                    code = np.full(len(words.dictionary), -1, np.int64)
                    code[which] = table.indices.to_numpy()
                    key = code[at]
                    size = max(len(table.dictionary), 1)
                    pair, count = np.unique(of[key >= 0].astype(np.int64) * size + key[key >= 0], return_counts=True)
                    for least in (1, 2):
                        kept = pair[count >= least]
                        rows, bad = np.bincount(kept % size, minlength=size), np.bincount(kept % size, toxic[kept // size], size)
                        found = np.flatnonzero(rows)
                        names = table.dictionary.take(pa.array(found)).cast(pa.large_string())
                        names = pc.binary_join_element_wise(pa.scalar("2 " if least == 2 else "", pa.large_string()), names, pa.scalar("*" if n else "", pa.large_string()), pa.scalar("", pa.large_string()))
                        yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array(bad[found].astype(np.int64)), pa.array(rows[found].astype(np.int64))], ["term", "bad", "n"])

    return sample.select("text", "toxic").transform(map_arrow, run, "term string, bad bigint, n bigint").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))


def gain(bad, n, share: float):
    """How much better the term's own share of toxic rows explains its rows than the share of all does (log likelihood)."""
    bad, n = np.asarray(bad, float), np.asarray(n, float)
    part = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / np.maximum(b, 1e-300)), 0.0)
    return part(bad, n * share) + part(n - bad, n * (1 - share))


def _bounds(counts: DataFrame, share: float) -> dict[bool, float]:
    """What the best of all tried terms would gain by chance, for terms that ask for two places and for others."""
    twice = F.col("term").startswith("2 ")
    tried = {x["twice"]: x["n"] for x in counts.groupBy(twice.alias("twice")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return {k: math.log(max(tried.get(k, 0), CHANCE_TERMS) / CHANCE_TERMS) for k in (False, True)}


def neighbours(sample: DataFrame, terms: list[str]) -> dict[tuple[str, int], int]:
    """How many different pairs of words stand around each term, one pair a text, for each class: (term, toxic) to a number."""
    votes = Votes(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 8 << 20) if whole.num_rows else ():
                toxic = (batch.column("toxic").to_numpy() == 1).astype(np.int32)
                words, of, _ = word_lists(batch.column("text"))
                own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(words.dictionary))[words.indices.to_numpy()]
                same = np.concatenate(([False], of[1:] == of[:-1]))
                left = np.where(same, np.concatenate((np.zeros(1, np.uint64), own[:-1])), 0)
                right = np.where(np.concatenate((same[1:], [False]))[: len(own)], np.concatenate((own[1:], np.zeros(1, np.uint64)))[: len(own)], 0)
                around = mix64(left.astype(np.uint64) ^ mix64(right.astype(np.uint64))).view(np.int64)
                for name, places in votes.places(words):
                    order = np.lexsort((around[places], name, of[places]))  # the least pair of each text and term stands for them
                    name, places = name[order], places[order]
                    first = np.concatenate(([True], (name[1:] != name[:-1]) | (of[places][1:] != of[places][:-1])))[: len(name)]
                    name, places = name[first], places[first]
                    label, pair = toxic[of[places]], around[places]
                    order = np.lexsort((pair, label, name))  # texts of the batch that agree in a term's neighbours make one row
                    name, label, pair = name[order], label[order], pair[order]
                    first = np.concatenate(([True], (name[1:] != name[:-1]) | (label[1:] != label[:-1]) | (pair[1:] != pair[:-1])))[: len(name)]
                    yield pa.RecordBatch.from_arrays([pa.array(name[first].astype(np.int32)), pa.array(label[first]), pa.array(pair[first])], ["name", "toxic", "around"])

    found = sample.select("text", "toxic").transform(map_arrow, run, "name int, toxic int, around bigint").distinct().groupBy("name", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()
    return {(votes.names[x["name"]], x["toxic"]): x["n"] for x in found}


def _apart(rows: int, around: int) -> int:
    """Rows that count, of ``rows`` with so many different neighbours: all if there are as many, few if most are copies."""
    return round(min(rows, around) ** 2 / rows) if rows else 0


def mine(sample: DataFrame) -> list[str]:
    """Terms that say most about the label, best first; at most ``MOST_TERMS`` come back, and ``MOST_TRIED`` to the driver."""
    rows, bad = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not rows or not bad or bad == rows:
        return []
    share = bad / rows
    alone = sample.groupBy("toxic", F.xxhash64("text").alias("_h")).agg(F.min("text").alias("text"))  # exact copies of a label count once
    counts = written(term_counts(alone).where(F.col("n") >= LEAST_ROWS), "toxic-terms")
    least = _bounds(counts, share)
    b, n = F.col("bad").cast("double"), F.col("n").cast("double")
    part = lambda a, of: F.when(a > 0, a * F.log(a / of)).otherwise(0.0)
    scored = counts.withColumn("gain", part(b, n * share) + part(n - b, n * (1 - share)))
    scored = scored.where((F.col("bad") >= LEAST_ROWS) | (b < n * share)).where(F.col("gain") >= F.when(F.col("term").startswith("2 "), least[True]).otherwise(least[False]))
    tried = [(x["term"], x["bad"], x["n"]) for x in scored.orderBy(F.desc("gain"), F.desc(F.length("term")), "term").limit(MOST_TRIED).collect()]
    around = neighbours(sample, [t for t, _, _ in tried])
    found = []
    for term, bad, n in tried:
        name = term.removeprefix("2 ")
        good, bad = _apart(n - bad, around.get((name, 0), 0)), _apart(bad, around.get((name, 1), 0))
        found.append((float(gain(bad, good + bad, share)), term, bad, good + bad))
    found = [x for x in found if x[0] >= least[x[1].startswith("2 ")] and (x[2] >= max(LEAST_ROWS, LEAST_PART * x[3]) or x[2] < x[3] * share)]
    return _chosen([x[1:] for x in sorted(found, key=lambda x: (-x[0], -len(x[1]), x[1]))], share)


def _chosen(found: list[tuple[str, int, int]], share: float) -> list[str]:
    """Leave out what a better term says already: a longer one no purer than its beginning, a beginning that adds few toxic rows."""
    kept: dict[str, tuple[int, int]] = {}
    for term, bad, n in found:
        twice, body = term[:2] * term.startswith("2 "), term.removeprefix("2 ")
        start, needless = body.removesuffix("*"), False
        for other in [twice + start[:k] + "*" for k in BEGINNINGS if k <= len(start)]:
            if other != term and other in kept and kept[other][0] * n >= bad * kept[other][1]:
                needless = True  # its beginning is as pure
        if body.endswith("*") and bad >= n * share:
            below = [v for k, v in kept.items() if k.startswith(twice + start) and k.startswith("2 ") == bool(twice)]
            needless |= any(bad - b < LEAST_ROWS for b, _ in below)
        if twice and body in kept:
            b, m = kept[body]
            needless |= b * n >= bad * m
        if not needless:
            kept[term] = (bad, n)
    return list(kept)[:MOST_TERMS]


def _forest(strength: np.ndarray, least: float) -> np.ndarray:
    """Parent of each voter (-1: none) in a spanning forest of the strongest links of at least ``least``, grown one by one."""
    n = len(strength)
    parent, best, link, inside = np.full(n, -1), np.full(n, -1.0), np.full(n, -1), np.zeros(n, bool)
    for _ in range(n):
        k = int(np.where(inside, -2.0, best).argmax())
        inside[k] = True
        parent[k] = link[k] if best[k] >= least else -1
        closer = ~inside & (strength[k] > best)
        best[closer], link[closer] = strength[k][closer], k
    return parent


def label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 40, least: float = 0.1) -> dict:
    """Posteriors, chances to fire, accuracies and correlations of 0/1 ``votes`` (rows, voters).

    Class ``y`` has its share; voter ``j`` fires with chance ``chance[y, p, j]``, where ``p`` says whether its parent fires. ``start``
    are the first posteriors. The forest is built in the first rounds, once more after ten, and then stays.
    """
    votes = votes.astype(np.float32)
    n, size = votes.shape
    q = np.clip(start.astype(np.float64), 0.02, 0.98)
    parent = np.full(size, -1)
    correlation = np.zeros((size, size))
    for step in range(rounds):
        weight = np.stack((1 - q, q))
        total = weight.sum(1)
        share = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        fire = (weight @ votes + 0.1) / (total[:, None] + 0.2)
        if step < 3 or step == 10:
            within = sum((votes * w[:, None].astype(np.float32)).T @ votes - t * np.outer(f, f) for w, t, f in zip(weight, total, fire)) / n
            spread = np.sqrt(np.maximum(np.diag(within), 1e-9))
            correlation = within / np.outer(spread, spread)
            np.fill_diagonal(correlation, 0)
            parent = _forest(np.abs(correlation), least)
        up = votes[:, np.maximum(parent, 0)] * (parent >= 0)
        both, ups = weight @ (votes * up), weight @ up
        chance = np.empty((2, 2, size))  # class, parent fires, voter; drawn to the chance without the parent
        chance[:, 1] = (both + 2 * fire) / (ups + 2)
        chance[:, 0] = (weight @ votes - both + 2 * fire) / (total[:, None] - ups + 2)
        chance = np.clip(chance, 1e-5, 1 - 1e-5)
        on, off = np.log(chance), np.log(1 - chance)
        logs = [np.log(s) + off[y, 0].sum() + votes @ (on - off)[y, 0] + up @ (off[y, 1] - off[y, 0]) + (votes * up) @ ((on - off)[y, 1] - (on - off)[y, 0]) for y, s in ((0, 1 - share), (1, share))]
        new = 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -30, 30)))
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-4 and step > 10:
            break
    says = fire[1] >= fire[0]
    on_toxic = share * fire[1] / (share * fire[1] + (1 - share) * fire[0])
    return {"share": share, "fire": fire, "chance": chance, "parent": parent, "correlation": correlation, "accuracy": np.where(says, on_toxic, 1 - on_toxic), "posterior": q}


def logistic(x: np.ndarray, y: np.ndarray, weight: float = 1e-4, rounds: int = 30) -> np.ndarray:
    """Weights (intercept last) by damped Newton steps; ``y`` from 0 to 1."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    w = np.zeros(x.shape[1])
    penalty = weight * len(x) * np.eye(len(w))
    penalty[-1, -1] = 1e-9 * len(x)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None].astype(x.dtype)).T @ x + penalty, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict | None:
    """Voters and weights from the labelled rows that aren't held out."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and _id is not null")
    own = own.where(~held_out(F.col("_id"), 0)).orderBy(F.xxhash64("_id"), "_id", "toxic").limit(fit_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    sample = written(texts.join(F.broadcast(own), texts.doc_id == own._id).select("text", "toxic"), "toxic-sample")  # at most fit_rows small rows
    terms = mine(sample)
    votes = Votes(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20) if whole.num_rows else ():
                rows, fired, n_words, _ = votes(batch.column("text"))
                order = np.lexsort((fired, rows))
                ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=batch.num_rows))))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(fired[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), lists, pa.array(n_words, pa.int64()), batch.column("text")], ["toxic", "fired", "n_words", "text"])

    made = written(sample.transform(map_arrow, run, "toxic int, fired array<int>, n_words bigint, text string"), "toxic-votes")
    # sorted, so that sums come out alike whatever the order of partitions
    found = sorted((x["toxic"], list(x["fired"]), x["n_words"]) for x in made.select("toxic", "fired", "n_words").collect())
    toxic = np.array([r[0] for r in found], float)
    if not len(found) or toxic.min() == toxic.max():
        return None
    x = np.zeros((len(found), votes.size), np.float32)
    for k, r in enumerate(found):
        x[k, r[1]] = 1
    bad = toxic @ x[:, : votes.n] / np.maximum(x[:, : votes.n].sum(0), 1)
    strong = bad >= STRONG_PART
    quiet = (x[:, : votes.n][:, strong].sum(1) == 0) & (np.array([r[2] for r in found]) >= QUIET_WORDS)
    model = label_model(np.column_stack((x, quiet, toxic)), np.where(toxic == 1, 0.9, 0.1))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 4 << 20) if whole.num_rows else ():
                n = votes(batch.column("text"), strong)[3]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("toxic", "fired", "n_words")), pa.array(n, pa.int64())], ["toxic", "fired", "n_words", "hits"])

    order = made.transform(map_arrow, hits, "toxic int, fired array<int>, n_words bigint, hits bigint").collect()
    hit = np.array([r[3] for r in sorted((r["toxic"], list(r["fired"]), r["n_words"], r["hits"]) for r in order)])
    n_words = np.array([r[2] for r in found])
    full = np.hstack((x, np.log1p(hit)[:, None], np.minimum(1, 10 * hit / np.maximum(n_words, 10))[:, None])).astype(np.float32)
    w = logistic(full, model["posterior"])
    raw = full @ w[:-1] + w[-1]
    a, b = logistic(raw[:, None], toxic, 1e-6)
    if a <= 0:
        a, b = 1.0, 0.0
    return {"terms": terms, "strong": strong.tolist(), "weights": (w[:-1] * a).tolist(), "bias": float(w[-1] * a + b), "accuracy": model["accuracy"].tolist()}


def _scorer(model: dict | None):
    if model is None:
        return lambda texts: np.zeros(len(texts))
    votes, w, bias, strong = Votes(model["terms"]), np.array(model["weights"]), model["bias"], np.array(model["strong"], bool)

    def score(texts: pa.Array) -> np.ndarray:
        rows, fired, n_words, hits = votes(texts, strong)
        raw = np.bincount(rows, w[fired], len(n_words)) + bias + w[-2] * np.log1p(hits) + w[-1] * np.minimum(1, 10 * hits / np.maximum(n_words, 10))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    return score


def scores(docs: DataFrame, model: dict | None) -> DataFrame:
    """``(doc_id, score)`` for every row."""
    kind, packed = docs.schema["doc_id"].dataType.simpleString(), json.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(json.loads(packed))
        for whole in batches:
            for batch in pieces(whole) if whole.num_rows else ():
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(map_arrow, run, f"doc_id {kind}, score double")


def toxicity_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = scores(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all columns."""
    packed = json.dumps(fit(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(json.loads(packed))
        for whole in batches:
            if whole.num_rows and not pa.types.is_string(whole.column("text").type):
                yield whole.filter(pa.array(score(whole.column("text").cast(pa.string())) < limit))
                continue
            for batch in pieces(whole) if whole.num_rows else ():
                yield batch.filter(pa.array(score(batch.column("text")) < limit))

    return docs.transform(map_arrow, run, docs.schema)
