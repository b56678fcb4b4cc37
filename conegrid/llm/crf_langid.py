"""Language identification by a linear-chain conditional random field over words.

Every word has hashed features: its character 2-, 3- and 4-grams with word boundaries (so affixes are
among them) and the word itself (the lexicon). Emission weights and label transitions are learned
together by gradient ascent on the chain likelihood, over whole texts and over code-switched ones that
are spliced from stretches of texts in different languages, so that the transitions learn how likely a
switch is. Forward-backward gives every word's label chances: the words' labels come out as spans, and
a text's language is the one with the greatest mean chance, its score. A text is one chain, however
long: it is worked on in stretches of `CHAIN` words at once, and the messages between stretches are
exact.

Learning takes at most `max_docs` documents (least by a hash of their id), whole, spread over shards
whose weights are averaged; the model has a fixed number of weights for each language. Texts that are
null or have no letter are `und`, score 0, without spans; so is every text if nothing was learned.
Repeated rows are labelled alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHAIN = 64
BITS = 17
#: Words that are labelled at once; a longer text is labelled alone.
AT_ONCE = 20_000


def letters(token: str) -> str:
    """A token's word: lower case without what surrounds its letters; empty if it has none."""
    if token.isalpha():
        return token.lower()
    at = [i for i, c in enumerate(token) if c.isalpha()]
    return token[at[0] : at[-1] + 1].lower() if at else ""


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word places) of all features of these words, grouped by n-gram length."""
    marked = [f"\x02{w}\x03" for w in words]
    n = np.array([len(w) for w in marked], np.int64)
    c = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word, start = np.repeat(np.arange(len(words)), n), np.cumsum(n) - n
    place = (np.arange(len(c)) - np.repeat(start, n)).astype(np.uint64)
    p, q, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(64 - BITS)
    buckets, owner, h = [], [], c * p
    for k in (2, 3, 4):
        h = (h[:-1] ^ (c[k - 1 :] * q)) * p
        inside = word[: len(h)] == word[k - 1 :]
        buckets.append(((h[inside] + np.uint64(k)) * q) >> shift)
        owner.append(word[: len(h)][inside])
    whole = np.add.reduceat((c + np.uint64(1)) * (p ** (place + np.uint64(1))), start) if len(words) else np.zeros(0, np.uint64)
    buckets.append((whole * q) >> shift)
    owner.append(np.arange(len(words)))
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owner)


def _sum_by(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, values[:, j], n) for j in range(values.shape[1])], 1)


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    b, o = word_features(words)
    return _sum_by(weights[b], o, len(words)) if len(words) else np.zeros((0, weights.shape[1]))


def chains(lengths: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, mask, turn) of the stretches that texts of these many words are worked on in; turn: a
    stretch's number in its text."""
    n = np.array(lengths, np.int64)
    count = -(-n // CHAIN)
    text = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = (np.cumsum(n) - n)[text] + turn * CHAIN
    mask = np.arange(CHAIN) < np.minimum(CHAIN, n[text] - turn * CHAIN)[:, None]
    return np.where(mask, start[:, None] + np.arange(CHAIN), 0), mask, turn


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def _messages(e: np.ndarray, mask: np.ndarray, turn: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each stretch hears from those before it, at its first word, and from those after it, at its last."""
    s, t, k = e.shape
    before, after = np.full((s, k), 1 / k), np.full((s, k), 1 / k)
    linked = np.flatnonzero(turn > 0)
    if not len(linked):
        return before, after
    long = np.union1d(linked, linked - 1)
    through = np.zeros((len(long), k, k))  # from the label of a stretch's first word to that of its last
    through[:, np.arange(k), np.arange(k)] = e[long, 0]
    for i in range(1, t):
        new = (through @ step) * e[long, i][:, None, :]
        new /= new.sum((1, 2), keepdims=True)
        through = np.where(mask[long, i][:, None, None], new, through)
    at = np.zeros(s, np.int64)
    at[long] = np.arange(len(long))
    order = linked[np.argsort(turn[linked], kind="stable")]
    rounds = np.split(order, np.flatnonzero(np.diff(turn[order])) + 1)
    for r in rounds:
        before[r] = _norm(np.einsum("sa,sab->sb", before[r - 1], through[at[r - 1]]) @ step)
    for r in reversed(rounds):
        after[r - 1] = _norm(np.einsum("sab,sb->sa", through[at[r]], after[r]) @ step.T)
    return before, after


def forward_backward(scores: np.ndarray, mask: np.ndarray, transitions: np.ndarray, turn: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label chances (stretch, place, label), and the expected label pairs summed over all chains.

    A stretch whose turn is above 0 goes on the chain of the stretch before it."""
    s, t, k = scores.shape
    turn = np.zeros(s, np.int64) if turn is None else turn
    e = np.exp(scores - scores.max(2, keepdims=True))
    step = np.exp(transitions)
    before, after = _messages(e, mask, turn, step)
    alpha, beta = np.empty((s, t, k)), np.empty((s, t, k))
    alpha[:, 0] = before * e[:, 0]
    for i in range(t):
        if i:
            alpha[:, i] = (alpha[:, i - 1] @ step) * e[:, i]
        alpha[:, i] /= alpha[:, i].sum(1, keepdims=True)
    beta[:, -1] = after
    for i in range(t - 2, -1, -1):
        beta[:, i] = np.where(mask[:, i + 1, None], _norm((e[:, i + 1] * beta[:, i + 1]) @ step.T), after)
    chance = _norm(alpha * beta)
    pairs = np.zeros((k, k))

    def expect(a: np.ndarray, b: np.ndarray) -> None:
        joint = a[:, :, None] * step * b[:, None, :]
        pairs[...] += (joint / joint.sum((1, 2), keepdims=True)).sum(0)

    for i in range(t - 1):
        live = mask[:, i + 1]
        if live.any():
            expect(alpha[live, i], e[live, i + 1] * beta[live, i + 1])
    on = np.flatnonzero(turn > 0)
    if len(on):
        expect(alpha[on - 1, -1], e[on, 0] * beta[on, 0])  # a stretch that goes on is full
    return chance * mask[:, :, None], pairs


def splice(texts: list[list[str]], labels: list[int], rng: np.random.Generator, least: int = 4, most: int = 40) -> tuple[list[list[str]], list[np.ndarray]]:
    """(words, labels of the words): every other text whole, and code-switched texts put together in
    random order from stretches of `least` to `most` words of the rest."""
    out = [(t, [x] * len(t)) for t, x in zip(texts[::2], labels[::2], strict=True)]
    pieces = []
    for t, x in zip(texts[1::2], labels[1::2], strict=True):
        lo = 0
        while lo < len(t):
            n = int(rng.integers(least, most + 1))
            pieces.append((t[lo : lo + n], x))
            lo += n
    order, size = rng.permutation(len(pieces)).tolist(), 8
    for lo in range(0, len(order), size):
        mine = [pieces[i] for i in order[lo : lo + size]]
        out.append(([w for t, _ in mine for w in t], [x for t, x in mine for _ in t]))
    return [t for t, _ in out], [np.array(x, np.int64) for _, x in out]


def learn(texts: list[list[str]], labels: list[int], k: int, rounds: int = 30, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions by full-batch AdaGrad on the mean log-likelihood."""
    ids: dict[str, int] = {}
    texts, gold = splice([t for t in texts if t], [x for t, x in zip(texts, labels, strict=True) if t], np.random.default_rng(len(texts)))
    flat = np.array([ids.setdefault(w, len(ids)) for t in texts for w in t], np.int64)
    gold = np.concatenate([np.zeros(0, np.int64), *gold])
    weights, transitions = np.zeros((1 << BITS, k)), np.zeros((k, k))
    if not len(flat):
        return weights, transitions
    b, o = word_features(list(ids))
    places, mask, turn = chains([len(t) for t in texts])
    seen = np.zeros((len(ids), k))
    np.add.at(seen, (flat, gold), 1)
    label = np.where(mask, gold[places], -1)
    true_pairs = np.zeros((k, k))
    linked = mask[:, 1:]
    np.add.at(true_pairs, (label[:, :-1][linked], label[:, 1:][linked]), 1)
    on = np.flatnonzero(turn > 0)
    np.add.at(true_pairs, (label[on - 1, -1], label[on, 0]), 1)
    gw, gt = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    used = np.unique(b)
    at = np.searchsorted(used, b)
    for _ in range(rounds):
        emit = _sum_by(weights[b], o, len(ids))
        chance, pairs = forward_backward(emit[flat][places], mask, transitions, turn)
        expected = _sum_by(chance[mask], flat[places[mask]], len(ids))
        grad = _sum_by((seen - expected)[o], at, len(used)) / len(flat) - decay * weights[used] / len(used)
        gw[used] += grad * grad
        weights[used] += rate * grad / np.sqrt(gw[used])
        grad = (true_pairs - pairs) / len(flat) - decay * transitions
        gt += grad * grad
        transitions += 0.1 * rate * grad / np.sqrt(gt)
    return weights, transitions


def fit(docs: DataFrame, may_learn: Column, max_docs: int = 2_000, shards: int = 4) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, weights, transitions) from at most `max_docs` documents with text and language."""
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    languages = sorted(r[0] for r in usable.select("lang").distinct().collect())  # one row a language
    index = {x: i for i, x in enumerate(languages)}
    k = len(languages)
    if not k:
        return [], np.zeros((1 << BITS, 0)), np.zeros((0, 0))
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(shards)))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        words = [[w for w in map(letters, t.split()) if w] for t in pdf["text"]]
        w, t = learn(words, [index[x] for x in pdf["lang"]], k)
        i = np.flatnonzero(np.abs(w).sum(1))
        return pd.DataFrame({"i": [*i.tolist(), -1], "w": [*w[i].tolist(), [*t.ravel().tolist(), 1.0]]})

    parts = rows.groupBy("shard").applyInPandas(one, "i long, w array<double>")
    summed = parts.select("i", F.posexplode("w").alias("j", "w")).groupBy("i", "j").agg(F.sum("w").alias("w")).toPandas()  # at most a row a weight
    weights, own = np.zeros((1 << BITS, k)), summed[summed["i"] < 0].sort_values("j")["w"].to_numpy()
    rest = summed[summed["i"] >= 0]
    weights[rest["i"].to_numpy(), rest["j"].to_numpy()] = rest["w"].to_numpy() / own[-1]
    return languages, weights, own[:-1].reshape(k, k) / own[-1]


def familiar_features(docs: DataFrame, may_learn: Column) -> np.ndarray:
    """Which feature buckets occur in a hundredth, and two at least, of all documents with text and language that may be learned from.

    Learned text has most of its features among these, whatever the number of languages; text of
    another script or language, or noise, has not, even where it is labelled as a learned language."""
    usable = docs.where(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, np.zeros(1 << BITS, np.int64)
        for pdf in batches:
            for t in pdf["text"]:
                words = [w for w in set(map(letters, set(t.split()))) if w]
                if words:
                    n += 1
                    seen[np.unique(word_features(words)[0])] += 1
        i = np.flatnonzero(seen)
        yield pd.DataFrame({"i": [-1, *i.tolist()], "n": [n, *seen[i].tolist()]})

    parts = usable.select("text").mapInPandas(count, "i long, n long")
    found = parts.groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # at most a row a bucket
    total, out = int(found.loc[found["i"] < 0, "n"].sum()), np.zeros(1 << BITS, bool)
    out[found.loc[(found["i"] >= 0) & (found["n"] >= min(total, max(2, total / 100))), "i"].to_numpy(np.int64)] = True
    return out


class _Emissions(dict):
    """Token to place in a table of emission scores, and of the share of familiar features if these are
    given; bounded: rare later tokens are forgotten."""

    def __init__(self, weights: np.ndarray, familiar: np.ndarray | None = None, limit: int = 50_000):
        super().__init__()
        self.weights, self.familiar, self.limit, self.words = weights, familiar, limit, {}
        self.rows = np.zeros((0, weights.shape[1] + (familiar is not None)), np.float32)

    def add(self, tokens: list[list[str]]) -> None:
        if len(self) > self.limit:
            self.clear()
            self.words.clear()
            self.rows = self.rows[:0]
        fresh, base = [], len(self.rows)
        for t in set().union(*tokens) - self.keys() if tokens else ():
            w = letters(t)
            if w and w not in self.words:
                self.words[w] = base + len(fresh)
                fresh.append(w)
            self[t] = self.words[w] if w else -1
        if fresh:
            new = emissions(fresh, self.weights).astype(np.float32)
            if self.familiar is not None:
                b, o = word_features(fresh)
                new = np.column_stack([new, (np.bincount(o, self.familiar[b]) / np.bincount(o)).astype(np.float32)])
            self.rows = np.concatenate([self.rows, new])


def stretches(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Where to cut texts, so that no stretch of several has more than `AT_ONCE` words (by half their letters) or 256 texts."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = (len(t) + 1) // 2 if isinstance(t, str) else 0
        if i > lo and (size + n > AT_ONCE or i - lo == 256):
            yield lo, i
            lo, size = i, 0
        size += n
    if len(texts):
        yield lo, len(texts)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], familiar: np.ndarray | None = None, into: str = "_language") -> DataFrame:
    """`docs` with a struct `into` of lang_pred, score, and the words' labels as spans in order
    (span_langs, and span_words: how many words with a letter); and, if familiar features are given,
    familiar: a text's mean share of them over its words."""
    languages, weights, transitions = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), transitions, familiar))
    columns = ["lang_pred", "score", "span_langs", "span_words", *["familiar"] * (familiar is not None)]
    nothing = ("und", 0.0, [], [], 0.0)[: len(columns)]

    @F.pandas_udf("lang_pred string, score double, span_langs array<string>, span_words array<int>" + ", familiar double" * (familiar is not None))
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, step, seen = shared.value
        table, k = _Emissions(w, seen), len(languages)
        for texts in batches:
            out: list[tuple] = []
            for lo, hi in stretches(texts):
                tokens = [t.split() if isinstance(t, str) else [] for t in texts.iloc[lo:hi]]
                if not languages:
                    out += [nothing] * len(tokens)
                    continue
                table.add(tokens)
                rows = [np.array([table[x] for x in t], np.int64) for t in tokens]
                rows = [r[r >= 0] for r in rows]
                n = np.array([len(r) for r in rows], np.int64)
                if not n.sum():
                    out += [nothing] * len(tokens)
                    continue
                flat, owner = table.rows[np.concatenate(rows)], np.repeat(np.arange(len(n)), n)
                places, mask, turn = chains(n.tolist())
                chance = forward_backward(flat[:, :k][places].astype(np.float64), mask, step, turn)[0] if k > 1 else mask[:, :, None].astype(float)
                chance = chance[mask]  # in the order of the words
                means = _sum_by(chance, owner, len(n)) / np.maximum(1, n)[:, None]
                share = np.bincount(owner, flat[:, k], len(n)) / np.maximum(1, n) if seen is not None else np.zeros(len(n))
                best, words = means.argmax(1), chance.argmax(1)
                cuts = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])]))
                span, size, of = [languages[i] for i in words[cuts].tolist()], np.diff([*cuts, len(words)]).tolist(), np.searchsorted(owner[cuts], np.arange(len(n) + 1)).tolist()
                for i, b in enumerate(best.tolist()):
                    at = slice(of[i], of[i + 1])
                    out.append((languages[b], float(min(1.0, means[i, b])), span[at], size[at], float(share[i]))[: len(columns)] if n[i] else nothing)
            yield pd.DataFrame(out, columns=columns)

    return docs.withColumn(into, label("text"))


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score, span_langs, span_words; learns only from documents not held out."""
    found = predict(docs.select("doc_id", "text"), fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), *[f"_language.{c}" for c in ("lang_pred", "score", "span_langs", "span_words")])
