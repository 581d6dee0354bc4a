"""Language-model scores: causal self-attention over subword ids, trained in numpy.

Tokens are lower-cased words and one end for each text. A word is spelled in ids of a byte-level tokenizer; its last id is a
symbol of its own, so no word is the beginning of another and the product over its symbols is a probability of the word.

The model. Each token enters by its first and its last symbol. One head of causal self-attention over the last ``WINDOW`` tokens
(biases by distance, and one for earlier places of the same token) gathers a state, and the state sets the weights of several
distributions of the next token, which sum to one:

* ``CLASSES`` distributions of the first symbol, one for each class of a token's last symbol. The attention thus decides what kind of
  token comes next from the whole window, not from the last token alone.
* the first symbol after this very last symbol.
* a copy: the token that followed, wherever the attention looks. A weight that falls on the last token itself goes to its class.

From its first symbol a word goes on by its share of the training tokens with this first symbol, less a discount that the numbers of
words seen once and twice set; what is taken off goes by spelling: a chain over the symbols inside words, counted over the distinct words of the training texts, so that it fits
words never seen. The probabilities of all words sum to one.

Training. Counts are taken over the whole of every training text. The weights of the attention are then trained over the whole of
every training text, one pass: texts are dealt to ``ROUNDS`` rounds by hash; in each round every task starts from the common weights
and trains on its texts, and a tree of averages makes the next common weights. While training, a token's own occurrence is left
out of all counts, so that weights fit texts that weren't counted.

Scoring. One pass over all texts: overlapping windows of ``WINDOW`` tokens, ``STRIDE`` apart, each token scored once, with at least
``WINDOW - STRIDE`` tokens before it. Counts of words with at least ``COMMON`` of all tokens are sent to the executors (at most
``1 / COMMON`` of them, whatever the corpus); other words leave their probability by spelling and copying behind, and what each count
adds to it, and meet their counts in a join by 64-bit hashes.

Bounds, whatever the corpus: the ``EDGES`` most frequent first and last symbols and the ``INNER`` most frequent symbols have counts of
neighbours of their own; all others share one row of their kind and are told apart by their own frequency.

Defined cases: null, empty and blank texts are the end alone; texts of any length are scored whole; repeated rows are scored
alike; null ids count as an id that is never held out unless its empty text hashes so; no training rows give the uniform
spelling; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh_path, held_out, map_arrow, written
from .token_table import WordEncoder, kept_encoder, pieces, split_words

WINDOW, STRIDE = 24, 18
WIDTH, CLASSES = 16, 16
EDGES, INNER = 1500, 2000
ROUNDS, LEAST_STEPS, BATCH, RATE = 3, 100, 128, 0.01
DISCOUNT, PRIOR = 0.6, 20.0
COMMON = 3e-7
SEED = 42


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- words -------------------------------------------------------------------------------------------------------------


class Speller(WordEncoder):
    """Symbols of words: twice the id, plus one for the last id of a word. With a model at hand it keeps what the model asks of each
    word: rows of its first and last symbol, count (-1: not common), hash, and given the row of the first symbol the log of its probability by
    spelling and what each count adds (both also with one occurrence less)."""

    def __init__(self, path: str, model: dict | None = None, limit: int = 400_000):
        self.model = model
        super().__init__(path, limit)
        self.end, self.n_symbols = 2 * self.vocabulary + 1, 2 * self.vocabulary + 2

    def load(self, path: str) -> None:
        """``path``: a file of ranks, one base64 piece and its number a line."""
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.vocabulary = max(self.ranks.values()) + 1
        self.begins = np.zeros(self.vocabulary, bool)
        self.begins[[i for piece, i in self.ranks.items() if piece.startswith(b" ")]] = True
        self.ranks = None

    def spelled(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word with a space before it. All go in one string; pieces that begin with a space part the words."""
        text = b" " + b" ".join(words)
        ids = np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), self.dtype)
        first = np.flatnonzero(self.begins[ids])
        if len(first) == len(words) and first[0] == 0:
            return ids, np.diff(np.concatenate((first, [len(ids)])))
        found = [self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]  # rare white space inside words
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.dtype, int(sizes.sum())), sizes

    def clear(self) -> None:
        super().clear()
        self.hashes, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.first, self.last = np.empty(0, np.int32), np.empty(0, np.int32)
        self.inner, self.unit = np.empty((0, 2), np.float32), np.empty((0, 2), np.float32)

    def learned(self, words: list[bytes]) -> None:
        if self.model is None:
            return
        h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words)).view(np.int64)
        c = np.full(len(words), -1, np.int64)  # not common
        hashes, counts = self.model["common"]
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            c = np.where(hashes[at] == h, counts[at], -1)
        symbols, ends = self.spell(np.arange(len(self.starts) - len(words), len(self.starts)))
        first, last, inner, unit = self.model["tables"].words(symbols, ends, c)
        for name, more in (("hashes", h), ("counts", c), ("first", first), ("last", last), ("inner", inner), ("unit", unit)):
            setattr(self, name, np.concatenate((getattr(self, name), more)))

    def shrunk(self, keep: np.ndarray) -> None:
        if self.model is not None:
            for name in ("hashes", "counts", "first", "last", "inner", "unit"):
                setattr(self, name, getattr(self, name)[keep])

    def spell(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, one after the other, and the end of each word."""
        sizes = self.sizes[code]
        ends = np.cumsum(sizes)
        symbols = 2 * self.flat[np.repeat(self.starts[code] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].astype(np.int32)
        symbols[ends - 1] += 1
        return symbols, ends


def _speller(path: str, key: str, model: dict) -> Speller:
    return kept_encoder(lambda: Speller(path, model), (path, key))


# ---- counts ------------------------------------------------------------------------------------------------------------


#: Bytes of text whose words are counted together before the shuffle.
COUNT_BYTES = 16 << 20


def token_counts(training: DataFrame, path: str) -> DataFrame:
    """``(w, a, b, c)`` over rows ``(text)``: words with ``w`` (the empty word stands for ends), and with null ``w`` pairs of a token's last
    symbol ``a`` and the next token's first symbol ``b``, over the whole of every text. Counted in runs of rows, then combined."""

    def counted(texts: list[pa.Array], speller: Speller) -> Iterator[pa.RecordBatch]:
        split = [split_words(x, lower=True) for x in texts]
        n_words = np.concatenate([n for _, n in split])
        table = pa.concat_arrays([w for w, _ in split]).dictionary_encode()
        at, size = table.indices.to_numpy(), len(table.dictionary)
        words = pa.concat_arrays([table.dictionary.cast(pa.string()), pa.array([""])])
        counts = np.append(np.bincount(at, minlength=size), len(n_words))
        none = pa.nulls(size + 1, pa.int32())
        yield pa.RecordBatch.from_arrays([words, none, none, pa.array(counts.astype(np.int64))], ["w", "a", "b", "c"])
        code = speller.lookup(table.dictionary)
        speller.uses[code] += counts[:-1]
        begin = speller.starts[code]
        first, last = 2 * speller.flat[begin].astype(np.int64) + (speller.sizes[code] == 1), 2 * speller.flat[begin + speller.sizes[code] - 1].astype(np.int64) + 1
        ends, to = np.full(len(n_words), speller.end), np.cumsum(n_words)
        opens = np.insert(first[at], to, ends)  # goals: the words of each text, then its end
        before = np.insert(last[at], to - n_words, ends)  # inputs: an end, then the words
        pair, n = np.unique(before * speller.n_symbols + opens, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(pair), pa.string()), pa.array((pair // speller.n_symbols).astype(np.int32)), pa.array((pair % speller.n_symbols).astype(np.int32)), pa.array(n)], ["w", "a", "b", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, speller = [], 0, kept_encoder(lambda: Speller(path), (path, "counts"))
        for whole in batches:
            for batch in pieces(whole, 16 << 20) if whole.num_rows else ():
                held.append(batch.column("text"))
                size += batch.nbytes
                if size >= COUNT_BYTES:
                    yield from counted(held, speller)
                    held, size = [], 0
        if held:
            yield from counted(held, speller)

    return training.select("text").transform(map_arrow, run, "w string, a int, b int, c bigint").groupBy("w", "a", "b").agg(F.sum("c").alias("c"))


def _distinct_symbols(batches: Iterator[pa.RecordBatch], speller: Speller) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """Rows ``(w, c)`` as symbols, ends and counts of words, and the count of the empty word."""
    for whole in batches:
        for k in range(0, whole.num_rows, 50_000):
            batch = whole.slice(k, 50_000)
            words, c = as_bytes(batch.column("w")), batch.column("c").to_numpy()
            real = np.fromiter(map(len, words), np.int64, len(words)) > 0
            speller.clear()  # no word comes twice
            code = speller.lookup(pa.array([w for w in words if w], pa.large_binary()))
            yield (*speller.spell(code), c[real], int(c[~real].sum()))


def symbol_counts(counts: DataFrame, path: str) -> DataFrame:
    """``(kind, a, b, n)``: kind 0 and 1, first and last symbols ``a`` of all training tokens; 2 and 3, all and first symbols of the
    distinct words; 4, neighbours ``a`` and ``b`` inside the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(path)
        size = speller.n_symbols
        total = np.zeros((4, size))
        for symbols, ends, c, n_ends in _distinct_symbols(batches, speller):
            if len(ends):
                begin = np.concatenate(([0], ends[:-1]))
                total[0] += np.bincount(symbols[begin], c, size)
                total[1] += np.bincount(symbols[ends - 1], c, size)
                total[2] += np.bincount(symbols, minlength=size)
                total[3] += np.bincount(symbols[begin], minlength=size)
                inside = np.ones(len(symbols) - 1, bool)
                inside[ends[:-1] - 1] = False
                pair, n = np.unique((symbols[:-1].astype(np.int64) * size + symbols[1:])[inside], return_counts=True)
                yield _symbol_rows(np.full(len(pair), 4), pair // size, pair % size, n)
            total[:2, speller.end] += n_ends
        kind, symbol = np.nonzero(total)
        yield _symbol_rows(kind, symbol, np.zeros(len(kind)), total[kind, symbol])

    return counts.transform(map_arrow, run, "kind int, a int, b int, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _symbol_rows(kind: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (kind, a, b)), pa.array(n.astype(np.int64))], ["kind", "a", "b", "n"])


def by_rows(pairs: DataFrame, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """``(size, size)`` sums of ``pairs(a, b, n)`` by the rows of their symbols."""
    rows = pairs.sparkSession.createDataFrame(pa.table({"s": pa.array(np.arange(len(a)), pa.int32()), "ra": pa.array(a.astype(np.int64)), "rb": pa.array(b.astype(np.int64))}))  # one row a symbol of the vocabulary
    found = pairs.join(F.broadcast(rows.select(F.col("s").alias("a"), "ra")), "a").join(F.broadcast(rows.select(F.col("s").alias("b"), "rb")), "b")
    table = found.groupBy((F.col("ra") * size + F.col("rb")).alias("k")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size)
    out[table.column("k").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(size, size)


# ---- tables ------------------------------------------------------------------------------------------------------------


def _rows(n: np.ndarray, size: int, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each symbol, the ``size`` most frequent their own, the rest by kind; and the log share of each symbol in its row."""
    order = np.argsort(-n, kind="stable")[:size]
    row = (size + kinds).astype(np.int32)
    row[order] = np.arange(len(order))
    mass = np.bincount(row, n + 0.5, size + 4)
    return row, np.log((n + 0.5) / mass[row]).astype(np.float32)


def _discounted(pairs: np.ndarray, prior: np.ndarray, discount: float = DISCOUNT) -> np.ndarray:
    """Rows of probabilities from counts; what is taken off goes to ``prior`` (a row, or one for each row)."""
    total, kinds = pairs.sum(1, keepdims=True), (pairs > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        own = (np.maximum(pairs - discount, 0) + discount * kinds * prior) / total
    return np.where(total > 0, own, prior)


def _clusters(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    of = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        of = ((x[:, None, :] - centers[None]) ** 2).sum(-1).argmin(1)
        centers = np.array([x[of == j].mean(0) if (of == j).any() else centers[j] for j in range(len(centers))])
    return of


def classes_of(pairs: np.ndarray, k: int = CLASSES) -> np.ndarray:
    """Class of each last symbol, by the first symbols that follow. Deterministic."""
    n = pairs.sum(1)
    used = np.flatnonzero(n > 0)
    of = np.zeros(len(pairs), np.int32)
    if len(used):
        near = np.sqrt(pairs[used][:, :400] / n[used, None])
        u, s, _ = np.linalg.svd(near, full_matrices=False)
        weight = np.minimum(1, n[used] / 50)[:, None]  # rare symbols stay near the middle
        of[used] = _clusters((u[:, :12] * s[:12]) * weight, k)
    return of


class Tables:
    """Distributions from counts. Rows: first symbols, last symbols and inner symbols, each with its four rest rows."""

    def __init__(self, per: np.ndarray, kinds: np.ndarray, begins: np.ndarray, discount: float = DISCOUNT):
        self.discount = discount  # of the counts of words
        self.first, self.first_log = _rows(np.where(begins, per[0], 0), EDGES, kinds)
        self.last, _ = _rows(per[1], EDGES, kinds)
        self.rank, self.inner_log = _rows(per[2], INNER, kinds)
        self.rows, self.inner_rows = EDGES + 4, INNER + 4
        self.starts, self.distinct = per[0], per[3]
        # a first symbol may begin a word without the mark of a beginning; then its own frequency counts
        odd = ~begins & (per[0] > 0)
        if odd.any():
            self.first, self.first_log = _rows(per[0], EDGES, kinds)

    def fill(self, edges: np.ndarray, inner: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> None:
        share = np.bincount(self.first, self.starts + 0.5 * begins, self.rows)
        self.share = (share / max(share.sum(), 1e-9)).astype(np.float32)
        self.class_of = classes_of(edges)
        onto = np.zeros((CLASSES, self.rows))
        np.add.at(onto, self.class_of, edges)
        self.class_count, self.class_total = onto.T.astype(np.float32).copy(), onto.sum(1).astype(np.float32)
        self.by_class = ((self.class_count + PRIOR * self.share[:, None]) / (self.class_total + PRIOR)).astype(np.float32)
        self.pairs = edges.astype(np.float32)
        self.pair_total, self.pair_kinds = edges.sum(1).astype(np.float32), (edges > 0).sum(1).astype(np.float32)
        # what may follow inside a word: any symbol that doesn't begin one; whether it ends the word is part of the symbol
        after = np.bincount(self.rank, (np.exp(self.inner_log) * 0 + 1.0) * ~begins, self.inner_rows)
        plain = inner.sum(0) + 0.5 * (after > 0)
        self.chain = np.log(np.maximum(_discounted(inner, plain / max(plain.sum(), 1e-9)), 1e-12)).astype(np.float32)

    def words(self, symbols: np.ndarray, ends: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each word the row of its first and last symbol; and given the row of the first, the log of its probability by spelling and
        what each count above the discount adds to it. Both with all counts (column 0) and with one occurrence less (column 1)."""
        if not len(ends):
            return np.empty(0, np.int32), np.empty(0, np.int32), np.empty((0, 2), np.float32), np.empty((0, 2), np.float32)
        begin = np.concatenate(([0], ends[:-1]))
        r = self.rank[symbols]
        step = np.concatenate(([0.0], self.chain[r[:-1], r[1:]] + self.inner_log[symbols[1:]]))
        step[begin] = 0
        chain = np.add.reduceat(step, begin)
        first = symbols[begin]
        inner, unit = np.empty((len(ends), 2), np.float32), np.empty((len(ends), 2), np.float32)
        for less in (0, 1):
            n, v = self.starts[first] - less, self.distinct[first] - (less * (counts == 1))
            seen = (n > 0) & (v > 0)
            off = np.where(seen, np.log(np.where(seen, self.discount * v, 1) / np.where(seen, n, 1)), 0.0)
            inner[:, less] = self.first_log[first] + off + chain
            unit[:, less] = np.where(seen, np.exp(self.first_log[first]) / np.where(seen, n, 1), 0.0)
        return self.first[first], self.last[symbols[ends - 1]], inner, unit


# ---- model -------------------------------------------------------------------------------------------------------------

#: Columns of the weights after those of the classes.
PAIR, COPY, OUT = CLASSES, CLASSES + 1, CLASSES + 2


def start_weights(rows: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(SEED)
    own = np.zeros((CLASSES, OUT))
    own[np.arange(CLASSES), np.arange(CLASSES)] = 2.0
    own[:, PAIR:] = (2.0, -1.0)
    made = {"E1": rng.normal(0, 0.3, (rows, WIDTH)), "E2": rng.normal(0, 0.3, (rows, WIDTH))} | {k: rng.normal(0, 0.25, (WIDTH, WIDTH)) for k in ("Wq", "Wk", "Wv")}
    made |= {"r": np.concatenate((-0.05 * np.arange(WINDOW), [0])), "same": np.full(1, 2.0), "Wo": rng.normal(0, 0.05, (WIDTH, OUT)), "S": own}
    return {k: v.astype(np.float32) for k, v in made.items()}


_LAGS = np.where((_lag := np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]) >= 0, _lag, WINDOW)
_EARLIER = np.tri(WINDOW + 1, k=-1, dtype=bool)
_ONES = np.ones(WINDOW, np.float32)


def _biases(w: dict) -> np.ndarray:
    return np.where(_LAGS == WINDOW, np.float32(-1e9), w["r"][_LAGS]).astype(np.float32)


class Batch:
    """Windows of tokens: inputs (rows of first and last symbols), goals and what the distributions say of them without weights.

    ``inside``: probability of the goal given the row of its first symbol. ``skip``: the first goals that aren't asked for; ``goal``,
    ``inside`` and ``real`` have the others.
    ``name`` are numbers of tokens, equal for equal tokens, of ``WINDOW + 1`` places; all others have ``WINDOW``. Where ``real`` is
    false there's no goal. With ``less`` the goal's own occurrence is left out of the counts.
    """

    def __init__(self, t: Tables, first, last, name, goal, inside, real, less: bool, skip: int = 0):
        self.first, self.last, self.real, self.skip = first, last, real, skip
        # places where a token stands again are few: flat positions in (windows, goals, inputs), for the input's earlier places and for
        # the inputs before the goal's earlier places
        equal = name[:, :, None] == name[:, None, :]
        equal &= _EARLIER
        window, now, then = np.nonzero(equal)
        row = window * (WINDOW - skip) + now - skip
        is_input, is_goal = (now >= skip) & (now < WINDOW), (now > skip) & (then > 0)
        self.same = row[is_input] * WINDOW + then[is_input]
        self.hit_row = row[is_goal] - 1
        self.hit = self.hit_row * WINDOW + then[is_goal] - 1
        goal, last = goal.ravel(), last[:, skip:].ravel()
        cls = t.class_of[last]
        self.cls = cls
        inside = inside.ravel()
        e = np.empty((len(goal), OUT), np.float32)
        e[:, :CLASSES] = t.by_class[goal]
        at = np.arange(len(goal))
        n, total, kinds = t.pairs[last, goal], t.pair_total[last], t.pair_kinds[last]
        if less:
            n_class = np.maximum(t.class_count[goal, cls] - 1, 0)
            own = (n_class + PRIOR * t.share[goal]) / (np.maximum(t.class_total[cls] - 1, 0) + PRIOR)
            e[at, cls] = own
            kinds = kinds - (n <= 1)
            n, total = np.maximum(n - 1, 0), np.maximum(total - 1, 0)
        else:
            own = e[at, cls]
        pair = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * own) / np.maximum(total, 1), own)
        e[:, PAIR] = pair
        e[:, : PAIR + 1] *= inside[:, None]
        e[:, COPY] = 0
        self.own, self.e = own * inside, e


def _attend(w: dict, b: Batch):
    scale = np.float32(1 / math.sqrt(WIDTH))
    x = w["E1"][b.first]
    x += w["E2"][b.last]
    q, k, v = x[:, b.skip :] @ w["Wq"], x @ w["Wk"], x @ w["Wv"]
    q *= scale
    s = q @ k.transpose(0, 2, 1)
    s += _biases(w)[b.skip :]
    s.reshape(-1)[b.same] += w["same"][0]
    a = np.exp(np.minimum(s, 60, out=s), out=s)
    a /= (a @ _ONES)[..., None]
    return x, q, k, v, a, a @ v


def _copied(a: np.ndarray, b: Batch) -> np.ndarray:
    """How much the attention looks at inputs that the goal followed."""
    return np.bincount(b.hit_row, a.reshape(-1)[b.hit], len(b.e)).astype(np.float32)


def gradients(w: dict, b: Batch) -> tuple[float, dict]:
    """Mean loss and gradients."""
    x, q, k, v, a, o = _attend(w, b)
    shape = a.shape
    diagonal = np.einsum("bii->bi", a)
    z = o.reshape(-1, WIDTH) @ w["Wo"]
    z += w["S"][b.cls]
    g = np.exp(np.minimum(z, 60, out=z), out=z)
    g /= g.sum(1, keepdims=True)
    b.e[:, COPY] = _copied(a, b) + diagonal.ravel() * b.own
    h = g * b.e
    p = h.sum(1) + np.float32(1e-37)
    real = b.real.ravel()
    n = max(int(real.sum()), 1)
    loss = -np.log(p[real]).sum() / n
    back = np.where(real, np.float32(1 / n), 0).astype(np.float32)
    to_copy = -(g[:, COPY] / p * back).reshape(shape[:2])  # of the copy's probability
    h /= p[:, None]
    dz = g
    dz -= h
    dz *= back[:, None]
    grads = {"Wo": o.reshape(-1, WIDTH).T @ dz, "S": (b.cls == np.arange(CLASSES)[:, None]).astype(np.float32) @ dz}
    do = (dz @ w["Wo"].T).reshape(o.shape)
    da = do @ v.transpose(0, 2, 1)
    da.reshape(-1)[b.hit] += to_copy.ravel()[b.hit_row]
    np.einsum("bii->bi", da)[:] += to_copy * b.own.reshape(shape[:2])
    da -= np.einsum("bij,bij->bi", da, a)[..., None]
    da *= a
    grads["r"] = np.bincount(_LAGS.ravel(), da.sum(0).ravel(), WINDOW + 1).astype(np.float32)
    grads["same"] = np.array([da.reshape(-1)[b.same].sum()], np.float32)
    dq, dk, dv = da @ k, da.transpose(0, 2, 1) @ q, a.transpose(0, 2, 1) @ do
    dq *= np.float32(1 / math.sqrt(WIDTH))
    wide = x.reshape(-1, WIDTH)
    dx = np.zeros_like(wide)
    for name, d in (("Wq", dq), ("Wk", dk), ("Wv", dv)):
        d = d.reshape(-1, WIDTH)
        grads[name] = wide.T @ d
        dx += d @ w[name].T
    for name, of in (("E1", b.first), ("E2", b.last)):
        of, rows = of.ravel(), len(w["E1"])
        grads[name] = np.stack([np.bincount(of, c, rows) for c in dx.T], 1).astype(np.float32)
    return float(loss), grads


class Trainer:
    """Adam over batches of windows, from common weights."""

    def __init__(self, w: dict, rate: float):
        self.w, self.rate, self.t, self.loss, self.n = {k: v.copy() for k, v in w.items()}, rate, 0, 0.0, 0
        self.m, self.u = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))

    def __call__(self, b: Batch) -> None:
        loss, g = gradients(self.w, b)
        self.t += 1
        n = int(b.real.sum())
        self.loss, self.n = self.loss + loss * n, self.n + n
        a, c = 1 - 0.9**self.t, 1 - 0.98**self.t
        for k, d in g.items():
            m, u = self.m[k], self.u[k]
            m += np.float32(0.1) * (d - m)
            u += np.float32(0.02) * (d * d - u)
            self.w[k] -= np.float32(self.rate / a) * m / (np.sqrt(u / np.float32(c)) + np.float32(1e-7))


class Sequences:
    """Tokens of whole texts, with an end before and after each. ``less``: each with its own occurrence left out of the counts."""

    def __init__(self, speller: Speller, texts: pa.Array, less: int = 0):
        model = speller.model
        words, self.n_words = split_words(texts, lower=True)
        self.code = code = speller.numbers(words)
        at = np.cumsum(self.n_words)
        self.bounds = np.concatenate(([0], np.cumsum(self.n_words + 2)))
        self.inner_places = np.ones(int(self.bounds[-1]), bool)
        self.inner_places[self.bounds[:-1]] = self.inner_places[self.bounds[1:] - 1] = False
        framed = lambda values, end, kind: self._framed(values[code], end, kind)
        t, end = model["tables"], model["end"]
        self.first, self.last = framed(speller.first, t.first[end], np.int32), framed(speller.last, t.last[end], np.int32)
        self.inner = framed(speller.inner[:, less], t.first_log[end], np.float32)
        self.unit = framed(speller.unit[:, less], 0, np.float32)
        self.counts = framed(speller.counts, model["ends"], np.int64)
        self.name = framed(np.arange(len(speller.starts)), -1, np.int32)
        # by common counts and by spelling; a long word's spelling is too small for a float, which only training takes as it is
        self.counted = np.maximum(self.counts - less - t.discount, 0).astype(np.float32) * self.unit
        self.inside = self.counted + np.exp(np.maximum(self.inner, -57.0))

    def _framed(self, values: np.ndarray, end, kind) -> np.ndarray:
        out = np.full(len(self.inner_places), end, kind)
        out[self.inner_places] = values
        return out

    def windows(self, stride: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of windows of inputs, and where their texts' inputs end."""
        first, last = self.bounds[:-1], self.bounds[1:] - 1
        made = 1 + np.maximum(0, -(-(last - first - WINDOW) // stride))
        k = np.arange(int(made.sum())) - np.repeat(np.cumsum(made) - made, made)
        return np.repeat(first, made) + k * stride, np.repeat(last, made)

    def batch(self, t: Tables, starts: np.ndarray, ends: np.ndarray, less: bool, skip: int = 0) -> tuple[Batch, np.ndarray]:
        """Windows as a batch, and the places of their goals."""
        at = starts[:, None] + np.arange(WINDOW + 1)
        real = at[:, :-1] < ends[:, None]
        at = np.minimum(at, ends[:, None])
        name = self.name[at]
        name[:, 1:] = np.where(real, name[:, 1:], -2 - np.arange(WINDOW, dtype=np.int32))  # places after the end are like nothing
        inp, goal = at[:, :-1], at[:, skip + 1 :]
        return Batch(t, self.first[inp], self.last[inp], name, self.first[goal], self.inside[goal], real[:, skip:], less, skip), goal


def train(model: dict, w: dict, texts: Iterator[pa.Array], speller: Speller, seed: int, rate: float, least_steps: int | None = None) -> Trainer:
    """One pass over all windows of all texts; if that is few steps, the last texts again until there are ``least_steps``."""
    trainer, rng, t = Trainer(w, rate), np.random.default_rng(seed), model["tables"]
    least_steps = LEAST_STEPS if least_steps is None else least_steps
    seen: list[tuple[Sequences, np.ndarray, np.ndarray]] = []
    while True:
        run = next(texts, None)
        if run is not None:
            s = Sequences(speller, run, 1)
            seen = [(s, *s.windows(WINDOW))]
        elif trainer.t >= least_steps or not seen:
            return trainer
        for s, starts, ends in seen:
            order = rng.permutation(len(starts))
            for k in range(0, len(order), BATCH):
                rows = order[k : k + BATCH]
                trainer(s.batch(t, starts[rows], ends[rows], True)[0])


def _average(packed: list[bytes]) -> bytes:
    n, total, loss = 0, None, 0.0
    for x in packed:
        k, w, l = pickle.loads(x)
        total = {a: v * k for a, v in w.items()} if total is None else {a: total[a] + v * k for a, v in w.items()}
        n, loss = n + k, loss + l * k
    return pickle.dumps((n, {a: (v / n).astype(np.float32) for a, v in total.items()}, loss / n))


def fit(training: DataFrame, model: dict) -> dict:
    """Weights after ``ROUNDS`` rounds; each text of ``training(text)`` is in one of them, whole."""
    sc, w, path = training.sparkSession.sparkContext, start_weights(model["tables"].rows), model["path"]
    shared, key = model["shared"], model["key"]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("w").to_pylist():
                total = x if total is None else _average([total, x])
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.binary())], ["w"])

    for k in range(ROUNDS):
        now = sc.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], k=k, now=now) -> Iterator[pa.RecordBatch]:
            own = shared.value
            texts = (batch.column("text") for whole in batches if whole.num_rows for batch in pieces(whole))
            made = train(own, now.value, texts, _speller(path, key, own), SEED + k, RATE / (1 + k))
            if made.n:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((made.n, made.w, made.loss / made.n))], pa.binary())], ["w"])

        slice_ = training.where(F.expr(f"pmod(xxhash64(text, 7), {ROUNDS}) = {k}"))
        parts = slice_.select("text").transform(map_arrow, run, "w binary")
        left = parts.rdd.getNumPartitions()
        while left > 32:
            left = -(-left // 16)
            parts = parts.repartition(left).transform(map_arrow, merge, "w binary")
        got = sorted(bytes(x["w"]) for x in parts.collect())  # at most 32 sets of weights
        if got:
            _, w, loss = pickle.loads(_average(got))
            model.setdefault("losses", []).append(loss)
        now.unpersist()
    return w


class Scorer:
    """Probabilities of tokens, batched over windows of many texts."""

    def __init__(self, w: dict, model: dict, chunk: int = 64):
        self.w, self.model, self.chunk = w, model, chunk

    def __call__(self, s: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """Natural log of each token's probability by common counts, spelling and copying; and what each further count adds to the
        probability. The first place of a text has none."""
        t, size = self.model["tables"], len(s.first)
        logs, more = np.zeros(size), np.zeros(size)
        starts, ends = s.windows(STRIDE)
        opens = np.concatenate(([True], ends[1:] != ends[:-1])) if len(ends) else np.empty(0, bool)
        for kind, skip in ((opens, 0), (~opens, WINDOW - STRIDE)):  # the first goals of a further window were scored in the one before
            own = np.flatnonzero(kind)
            for c in range(0, len(own), self.chunk):
                at = own[c : c + self.chunk]
                b, goal = s.batch(t, starts[at], ends[at], False, skip)
                *_, a, o = _attend(self.w, b)
                z = o.reshape(-1, WIDTH) @ self.w["Wo"]
                z += self.w["S"][b.cls]
                g = np.exp(np.minimum(z, 60, out=z), out=z)
                g /= g.sum(1, keepdims=True)
                copied = _copied(a, b)
                b.e[:, COPY] = np.einsum("bii->bi", a[:, :, skip:]).ravel() * b.own
                spelled, copied = np.einsum("nk,nk->n", g, b.e), g[:, COPY] * copied
                new = b.real.ravel()
                place, spelled, copied = goal.ravel()[new], spelled[new], copied[new]
                first = spelled / s.inside[place]  # probability of the row of the first symbol
                logs[place] = np.log(spelled + copied)
                more[place] = first * s.unit[place]
                long = np.flatnonzero((s.inner[place] < -57.0) & (s.counted[place] == 0))  # a long word's spelling is too small for a float
                if len(long):
                    by = s.inner[place[long]] + np.log(first[long].astype(np.float64))
                    logs[place[long]] = np.logaddexp(by, np.log(np.maximum(copied[long].astype(np.float64), 1e-300)))
        return logs, more


def learn(training: DataFrame, path: str | None = None) -> dict:
    """Counts, tables and weights from rows ``(text)``."""
    path = path or default_tokenizer()
    sc = training.sparkSession.sparkContext
    tokens = written(token_counts(training, path).withColumn("h", F.xxhash64("w")), "lm-tokens")
    counts = tokens.where("w is not null").select("w", "c", "h")
    times = lambda k: F.sum((F.col("c") == k).cast("long"))
    n, v, ends, once, twice = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.col("w") == "", F.col("c"))), times(1), times(2)).first())
    discount = min(max(once / max(once + 2 * twice, 1), 0.4), 0.95)
    common = counts.where((F.col("c") >= COMMON * n) & (F.col("w") != "")).select("h", "c").toArrow()
    h, c = common.column("h").to_numpy(), common.column("c").to_numpy()
    order = np.argsort(h)
    speller = Speller(path)
    per = np.zeros((4, speller.n_symbols))
    symbols = written(symbol_counts(counts.select("w", "c"), path), "lm-symbols")
    for x in symbols.where("kind < 4").collect():  # at most four rows a symbol of the vocabulary
        per[x["kind"], x["a"]] = x["n"]
    begins = np.zeros(speller.n_symbols, bool)
    begins[: 2 * speller.vocabulary] = np.repeat(speller.begins, 2)
    begins[speller.end] = True
    kinds = 2 * begins.astype(np.int32) + np.arange(speller.n_symbols) % 2
    tables = Tables(per, kinds, begins, discount)
    inner = by_rows(symbols.where("kind = 4").select("a", "b", "n"), tables.rank, tables.rank, tables.inner_rows)
    edges = by_rows(tokens.where("w is null").select("a", "b", F.col("c").alias("n")), tables.last, tables.first, tables.rows)
    tables.fill(edges, inner, kinds, begins)
    model = {"path": path, "n": n, "v": v, "ends": ends, "end": speller.end, "common": (h[order], c[order]), "tables": tables}
    model = {**model, "counts": counts, "key": fresh_path(training.sparkSession, "model"), "shared": sc.broadcast(model)}
    return model | {"weights": fit(training, model)}


def score_texts(speller: Speller, scorer: Scorer, texts: pa.Array) -> tuple:
    """For each text: tokens, known and base score and score of the end and all common words; for its other words, where each
    text's begin in the lists that follow: hashes, log10 of the probability by spelling and copying, and what each count above the discount adds."""
    model = speller.model
    s = Sequences(speller, texts)
    n, ends, mass = len(s.n_words), model["ends"], model["n"] + 0.5 * (model["v"] + 1)
    logs, more = scorer(s)
    of_text = np.repeat(np.arange(n, dtype=np.int64), np.diff(s.bounds) - 1)
    goals = np.ones(len(s.first), bool)
    goals[s.bounds[:-1]] = False
    logs, more, count = logs[goals] / math.log(10), more[goals], s.counts[goals]
    known = count >= 0  # ends are always known
    total = lambda x: np.bincount(of_text[known], x, n)
    rare, code = ~known, s.code[speller.counts[s.code] < 0]
    first = np.concatenate(([0], np.cumsum(np.bincount(of_text[rare], minlength=n)))).astype(np.int32)
    base = total(np.log10((count[known] + 0.5) / mass))
    return s.n_words + 1, total((count[known] > 0).astype(float)).astype(np.int64), base, total(logs[known]), first, speller.hashes[code], logs[rare].astype(np.float32), more[rare].astype(np.float32)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``(doc_id, n_tokens, n_known, base_score, score)`` for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    weights, shared, path, key = spark.sparkContext.broadcast(model["weights"]), model["shared"], model["path"], model["key"]
    kind, n = docs.schema["doc_id"].dataType.simpleString(), model["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        speller, scorer = _speller(path, key, own), Scorer(weights.value, own)
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in pieces(whole) if whole.num_rows else ():
                n_tokens, n_known, base, full, first, *rare = score_texts(speller, scorer, batch.column("text"))
                texts = len(n_tokens)
                lists = [pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in rare]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(texts)), batch.column("doc_id"), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(full), *lists],
                    ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "h", "s", "g"],
                )
                row += texts

    schema = f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double, h array<bigint>, s array<float>, g array<float>"
    part = written(docs.select("doc_id", F.col("text").cast("string").alias("text")).transform(map_arrow, run, schema), "lm-scores")
    rare = part.where(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "s", "g")).alias("t")).select("row", "t.h", "t.s", "t.g")
    counts = model["counts"].where((F.col("c") < COMMON * n) & (F.col("w") != "")).select(F.col("h").alias("_h"), "c")
    met = rare.join(counts, rare.h == counts._h, "left").select("row", "s", "g", F.coalesce("c", F.lit(0)).alias("c"))
    base = F.log10((F.col("c") + 0.5) / F.lit(float(n + 0.5 * (model["v"] + 1))))
    share = F.col("g") * F.greatest(F.col("c") - float(model["tables"].discount), F.lit(0.0))
    plain = F.col("s").cast("double")
    full = F.when(share > 0, F.when(plain < -300, F.log10(share)).otherwise(F.log10(F.pow(F.lit(10.0), plain) + share))).otherwise(plain)
    added = met.groupBy("row").agg(F.sum(base).alias("b"), F.sum(full).alias("m"), F.sum((F.col("c") > 0).cast("long")).alias("k"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return part.select("row", "doc_id", "n_tokens", "n_known", "base_score", "score").join(added, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), (F.col("base_score") + zero("b")).alias("base_score"), (F.col("score") + zero("m")).alias("score")
    )


def lm_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    apart = held_out(F.col("doc_id"), 1)
    model = learn(docs.where(~apart).select(F.col("text").cast("string").alias("text")), path)
    scored = score(docs, model)
    return scored.select("doc_id", apart.alias("held_out"), "n_tokens", "n_known", F.lit(model["n"]).cast("long").alias("train_tokens"), "base_score", "score")
