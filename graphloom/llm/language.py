"""Language ID: a linear-chain conditional random field over the words of a text.

Each word (a run of letters with the marks that combine with them, lower-cased) has prefix, suffix, character n-gram and lexicon features; the labels of
neighbouring words are tied by learned transitions, and forward-backward gives every word's label distribution, so
code-switched text is labelled word by word. The document's language has the largest mean probability.

Fitting takes a bounded sample on the driver: about PER_LANG texts of every language; texts over LONGEST characters
are drawn as pieces of that length. Training sequences splice pieces of several texts, so that
transitions see switches. Prediction covers every word of every text. Texts of up to LONG characters are labelled in
lockstep; a longer one CHUNK words at a time: one pass forward keeps the state before each chunk, one backward reads the
chunks again. In a chunk, about sqrt(words) segments go in lockstep, once for the products of their steps, which
give each segment the states at its ends, and once for its words. So beside the text itself memory is bounded.

Defined results: null text, empty text or text without letters gives `und` with score 0; with nothing to learn
from every text is `und`. Repeated rows are labelled alike; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import mix64, slices, strings

PER_LANG, LONGEST = 300, 50_000
TABLE, LEXICON = 1 << 15, 4000
WORD, ASCII_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile("[a-z]+")
KINDS = 8  # prefixes and suffixes of 1 to 3 characters, bigrams, trigrams
CACHE = 200_000
LONG, CHUNK = 1 << 15, 1 << 16  # characters, words
SLICE, NEW = 1 << 20, 1 << 17  # characters: of texts labelled together, of words whose scores are found together
#: a filter rejects documents without letters, and those whose words are this unlikely to be of the languages found for them
LEAST = 0.4


def _pattern(lower: str):
    return ASCII_WORD if lower.isascii() else WORD


def words_of(text: str) -> list[str]:
    lower = text.lower()
    return _pattern(lower).findall(lower)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, row of the weight table) of every affix and n-gram."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    own, rows = [], []

    def add(who, kind, *parts):
        h = np.full(len(who), kind + 1, np.uint64)
        for p in parts:
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + p)
        own.append(who)
        rows.append((h % np.uint64(TABLE)).astype(np.int64))

    every = np.arange(len(words))
    for k in (1, 2, 3):
        long = every[sizes - 2 >= k]
        add(long, k - 1, *(codes[starts[long] + 1 + i] for i in range(k)))
        add(long, k + 2, *(codes[starts[long] + sizes[long] - 1 - k + i] for i in range(k)))
    for k in (2, 3):
        at = np.arange(len(codes) - k + 1)
        at = at[owner[at] == owner[at + k - 1]]
        add(owner[at], 4 + k, *(codes[at + i] for i in range(k)))
    return np.concatenate(own), np.concatenate(rows)


class Model:
    def __init__(self, langs: list[str], lexicon: list[str]):
        self.langs, self.lexicon = langs, {w: i + 1 for i, w in enumerate(lexicon)}
        n = len(langs)
        self.table = np.zeros((TABLE, n), np.float32)
        self.words = np.zeros((len(lexicon) + 1, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)
        self.first = np.zeros(n, np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        own, rows = word_features(words)
        known = np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))
        counts = np.bincount(own, minlength=len(words))
        out = self.words[known]
        for k in range(len(self.langs)):
            out[:, k] += np.bincount(own, self.table[rows, k], len(words)) / np.sqrt(counts)
        return out


def packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word goes when words are laid out by position, longest sequence first; and how many sequences reach each position."""
    rank = np.empty(len(sizes), np.int64)
    rank[np.argsort(-sizes, kind="stable")] = np.arange(len(sizes))
    active = np.bincount(sizes, minlength=sizes.max() + 1)[::-1].cumsum()[::-1][1:]
    base = np.cumsum(active) - active
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return base[inside] + np.repeat(rank, sizes), active


def forward_backward(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distribution of every word; the sum over neighbours of the pair distributions. Every size is over 0."""
    place, active = packed(sizes)
    e = np.empty_like(scores)
    e[place] = np.exp(scores - scores.max(1, keepdims=True))
    step, ahead, behind = np.exp(moves), np.empty_like(e), np.ones_like(e)
    base = np.cumsum(active) - active
    now = np.exp(first) * e[: active[0]]
    ahead[: active[0]] = now = now / now.sum(1, keepdims=True)
    for t in range(1, len(active)):
        b, n = base[t], active[t]
        now = (now[:n] @ step) * e[b : b + n]
        now /= now.sum(1, keepdims=True)
        ahead[b : b + n] = now
    pairs = np.zeros_like(step)
    for t in range(len(active) - 2, -1, -1):
        b, n, c = base[t + 1], active[t + 1], base[t]
        then = e[b : b + n] * behind[b : b + n]
        back = then @ step.T
        behind[c : c + n] = back / back.sum(1, keepdims=True)
        left = ahead[c : c + n]
        norm = ((left @ step) * then).sum(1, keepdims=True)
        pairs += (left / norm).T @ then * step
    p = ahead * behind
    p /= p.sum(1, keepdims=True)
    return p[place], pairs


def _even(x: np.ndarray) -> np.ndarray:
    return x / x.sum(-1, keepdims=True)


def chunk_products(e: np.ndarray, step: np.ndarray, opens: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words (rows of exponentiated scores) cut into segments: the scores by place and segment, where there are
    words, and of each segment the product of its steps. `opens`: no step leads to the first word.
    """
    n, k = e.shape
    size = int(np.ceil(np.sqrt(n)))
    parts = -(-n // size)
    laid = np.ones((parts * size, k))
    laid[:n] = e
    laid, there = laid.reshape(parts, size, k).swapaxes(0, 1), (np.arange(parts * size) < n).reshape(parts, size).T
    product = np.broadcast_to(np.eye(k), (parts, k, k)).copy()
    for t in range(size):
        moved = product @ step
        if opens and t == 0:
            moved[0] = product[0]
        moved *= laid[t][:, None, :]
        product[there[t]] = (moved / moved.sum((1, 2), keepdims=True))[there[t]]
    return laid, there, product


def chunk_labels(e: np.ndarray, step: np.ndarray, opens: bool, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distribution of a chunk's words between the forward state before it and the backward state behind it; and
    the backward state before it.
    """
    laid, there, product = chunk_products(e, step, opens)
    size, parts, k = laid.shape
    now, then = np.empty((parts, k)), np.empty((parts, k))
    now[0], then[-1] = before, after
    for i in range(1, parts):
        now[i] = _even(now[i - 1] @ product[i - 1])
        then[-1 - i] = _even(product[-i] @ then[-i])
    first = _even(product[0] @ then[0])
    ahead = np.empty_like(laid)
    for t in range(size):
        moved = now @ step
        if opens and t == 0:
            moved[0] = now[0]
        now = np.where(there[t][:, None], _even(moved * laid[t]), now)
        ahead[t] = now
    for t in range(size - 1, -1, -1):
        ahead[t] = _even(ahead[t] * then)
        then = np.where(there[t][:, None], _even((laid[t] * then) @ step.T), then)
    return ahead.swapaxes(0, 1).reshape(-1, k)[: len(e)], first


def fit(texts: list[str], labels: list[str], seed: int = 7, sequences: int = 4000, length: int = 40, rate: float = 0.5) -> Model | None:
    """Maximises the likelihood of the labels of spliced sequences by AdaGrad steps."""
    docs = [(w, y) for t, y in zip(texts, labels, strict=True) if (w := words_of(t))]
    if not docs:
        return None
    langs = sorted({y for _, y in docs})
    counts: dict[str, int] = {}
    for words, _ in docs:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    frequent = sorted((w for w, c in counts.items() if c >= 3), key=lambda w: (-counts[w], w))[:LEXICON]
    model, rng = Model(langs, frequent), np.random.default_rng(seed)
    by_lang = [[w for w, y in docs if y == k] for k in langs]
    grown = [np.full(x.shape, 1e-2, np.float32) for x in (model.table, model.words, model.moves, model.first)]
    for _ in range(sequences // 100):
        flat, gold, sizes = [], [], []
        for _ in range(100):
            words, ys = [], []
            while len(words) < length:
                k = int(rng.integers(len(langs)))
                piece = by_lang[k][rng.integers(len(by_lang[k]))]
                at, n = int(rng.integers(len(piece))), int(rng.integers(3, 26))
                words += piece[at : at + n]
                ys += [k] * len(piece[at : at + n])
            flat += words
            gold += ys
            sizes.append(len(words))
        sizes, gold = np.array(sizes), np.array(gold)
        distinct, which = np.unique(np.array(flat, object).astype(str), return_inverse=True)
        distinct = distinct.tolist()
        p, pairs = forward_backward(model.emissions(distinct)[which], sizes, model.moves, model.first)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        miss = -p
        miss[np.arange(len(gold)), gold] += 1
        by_word = np.zeros((len(distinct), len(langs)), np.float32)
        np.add.at(by_word, which, miss)
        own, rows = word_features(distinct)
        own_n = np.sqrt(np.bincount(own, minlength=len(distinct)))[:, None]
        grads = [np.zeros_like(x) for x in grown]
        for k in range(len(langs)):
            grads[0][:, k] = np.bincount(rows, (by_word / own_n)[own, k], TABLE)
        np.add.at(grads[1], [model.lexicon.get(w, 0) for w in distinct], by_word)
        grads[1][0] = 0
        seen = np.zeros_like(model.moves)
        inner = np.ones(len(gold), bool)
        inner[ends - 1] = False
        at = np.nonzero(inner)[0]
        np.add.at(seen, (gold[at], gold[at + 1]), 1)
        grads[2] = seen - pairs
        grads[3] = miss[starts].sum(0)
        for x, g, s in zip((model.table, model.words, model.moves, model.first), grads, grown, strict=True):
            g = g / 100
            s += g * g
            x += rate * g / np.sqrt(s)
    return model


def learn(docs: DataFrame, learnable=None) -> Model | None:
    """Fits on a bounded sample of the rows that `learnable` allows and whose lang is known."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & (learnable if learnable is not None else F.lit(True)))
    size = F.length("text")
    counts = rows.groupBy("lang").agg(F.sum(F.greatest(F.lit(1), F.ceil(size / LONGEST))).alias("n")).collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.3 * PER_LANG / r["n"]))])[F.col("lang")]
    pieces = F.transform(F.sequence(F.lit(1), size, F.lit(LONGEST)), lambda at: F.substring("text", at, F.lit(LONGEST)))
    rows = rows.where("text is not null").withColumn("text", F.explode(F.when(size <= LONGEST, F.array("text")).otherwise(pieces)))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)  # the text too: rows without an id are drawn one by one
    sample = rows.where(draw < share).select("lang", draw.alias("draw"), "text").distinct().collect()
    sample.sort(key=lambda r: (r["lang"], r["draw"], r["text"]))
    taken: dict[str, int] = {}
    kept = [r for r in sample if taken.setdefault(r["lang"], 0) < PER_LANG and not taken.update({r["lang"]: taken[r["lang"]] + 1})]
    return fit([r["text"] for r in kept], [r["lang"] for r in kept])


class Labeller:
    """A model with the scores of the words met so far, up to CACHE of them."""

    def __init__(self, model: Model | None, long: int = LONG, chunk: int = CHUNK):
        self.model, self.long, self.chunk = model, long, chunk
        self.ids: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.langs) if model else 0), np.float32)

    def _known(self, words: list[str]) -> np.ndarray:
        new = set(words) - self.ids.keys()
        if new and len(new) + len(self.ids) > CACHE:
            self.ids, self.scores, new = {}, self.scores[:0], set(words)
        if new:
            new = list(new)
            self.ids.update(zip(new, range(len(self.ids), len(self.ids) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, *(self.model.emissions(new[a:b]) for a, b in slices([len(w) + 2 for w in new], NEW))])
        return self.scores[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))]

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """Each word with its own language and that language's probability."""
        if not (words := words_of(text)) or not self.model:
            return []
        p, _ = forward_backward(self._known(words), np.array([len(words)]), self.model.moves, self.model.first)
        best = p.argmax(1)
        return [(w, self.model.langs[k], float(p[i, k])) for i, (w, k) in enumerate(zip(words, best, strict=True))]

    def _scores(self, words: list[str]) -> np.ndarray:
        e = self._known(words).astype(np.float64)
        return np.exp(e - e.max(1, keepdims=True))

    def long_sums(self, text: str) -> tuple[int, np.ndarray, float]:
        """Number of words, the sums of their distributions and of their best probabilities, a chunk at a time."""
        lower = text.lower()
        pattern, step, k = _pattern(lower), np.exp(self.model.moves.astype(np.float64)), len(self.model.langs)

        def words_from(at):
            found = [(m.group(), m.end()) for m in islice(pattern.finditer(lower, at), self.chunk)]
            return [w for w, _ in found], found[-1][1] if found else at

        begun, at, state = [], 0, _even(np.exp(self.model.first.astype(np.float64)))
        while (some := words_from(at))[0]:
            begun.append((at, state))
            for product in chunk_products(self._scores(some[0]), step, not at)[2]:
                state = _even(state @ product)
            at = some[1]
        n, sums, sure, state = 0, np.zeros(k), 0.0, np.full(k, 1 / k)
        for at, before in reversed(begun):
            p, state = chunk_labels(self._scores(words_from(at)[0]), step, not at, before, state)
            n, sums, sure = n + len(p), sums + p.sum(0), sure + float(p.max(1).sum())
        return n, sums, sure

    def documents(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language of each text and its mean probability."""
        return [(lang, score) for lang, score, _ in self.judged(texts)]

    def judged(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """As documents(), and the mean over the words of the probability of each word's own best language."""
        out = [("und", 0.0, 0.0)] * len(texts)
        if not self.model:
            return out
        short = []
        for i, text in enumerate(texts):
            if len(text) <= self.long:
                short.append(i)
            else:
                n, sums, sure = self.long_sums(text)
                if n:
                    k = int(sums.argmax())
                    out[i] = (self.model.langs[k], min(1.0, float(sums[k] / n)), min(1.0, sure / n))
        order = sorted(short, key=lambda i: len(texts[i]))  # texts that take about as many steps go together
        for a, b in slices([len(texts[i]) for i in order], SLICE):
            words, sizes, which = [], [], []
            for i in order[a:b]:
                if found := words_of(texts[i]):
                    words += found
                    sizes.append(len(found))
                    which.append(i)
            if not words:
                continue
            sizes = np.array(sizes)
            p, _ = forward_backward(self._known(words), sizes, self.model.moves, self.model.first)
            starts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(p, starts, dtype=np.float64) / sizes[:, None]
            sure = np.add.reduceat(p.max(1), starts, dtype=np.float64) / sizes
            best = mean.argmax(1)
            for i, k, m, s in zip(which, best, mean, sure, strict=True):
                out[i] = (self.model.langs[k], min(1.0, float(m[k])), min(1.0, float(s)))
        return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score of every row; only the text decides. No shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by TABLE, LEXICON and the number of languages

    def each(batches):
        labeller = Labeller(sent.value)
        for batch in batches:
            got = labeller.documents(strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model | None, least: float = LEAST) -> DataFrame:
    """The rows, with all their columns, whose words are of some language each with a mean probability of at least `least`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        labeller = Labeller(sent.value)
        for batch in batches:
            got = labeller.judged(strings(batch.column("text")))
            yield batch.filter(pa.array([x != "und" and p >= least for x, _, p in got], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
