"""BPE encoding and decoding: speculate and verify.

The pre-tokenizer's words are split greedily into the longest vocabulary entries. Such a split is the true encoding
if every entry encodes to itself and every adjacent pair of entries, taken as one string, encodes to just that
pair. All pairs of a batch are checked at once against a sorted table of pair verdicts; a pair that is new is
judged once by exact merging. Only words with a failing pair are merged exactly.

The vocabulary file's path is a parameter and is read where the work is done. Words met so far are kept, up to a
bound. Defined results: null counts as empty and has no tokens. Texts of any length are encoded whole. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .common import slices, strings

#: Fixed value: the pre-tokenizer's pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for text without other characters, for the faster library.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""
CACHE, LONG, SHORT = 300_000, 200, 48
NEVER = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own byte; the other bytes follow from code point 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_alphabet()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.token = [b""] * self.size
        for t, i in self.ids.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.merge: dict[int, int] = {}  # a pair's rank * size + what it becomes
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merge[vocab[a] * self.size + vocab[b]] = rank * self.size + vocab[a + b]
        self.prefix = {t[:n] for t in self.ids for n in range(1, len(t) + 1)}
        self.own = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.words, self.ascii_words = regex.compile(PATTERN), re.compile(ASCII_PATTERN)
        self.known: dict[str, bytes] = {}
        self.pairs, self.verdicts = np.zeros(0, np.int64), np.zeros(0, bool)

    def exact(self, word: bytes) -> list[int]:
        """Merges the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        ids = [self.single[b] for b in word]
        return self._exact_short(ids) if len(ids) <= SHORT else self._exact_long(ids)

    def _exact_short(self, ids: list[int]) -> list[int]:
        """Looks through all pairs for each merge, which takes less time than a queue in a word of few pairs."""
        size, found = self.size, self.merge.get
        pairs = [found(a * size + b, NEVER) for a, b in zip(ids, ids[1:])]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            ids[i] = best % size
            del ids[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = found(ids[i] * size + ids[i + 1], NEVER)
            if i:
                pairs[i - 1] = found(ids[i - 1] * size + ids[i], NEVER)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        n, size, merge = len(ids), self.size, self.merge
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merge.get(ids[i] * size + ids[i + 1]):
                queue.append((found, i, ids[i], ids[i + 1]))
        heapq.heapify(queue)
        while queue:
            best, i, a, b = heapq.heappop(queue)
            j, new = after[i], best % size
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := merge.get(new * size + ids[k]):
                    heapq.heappush(queue, (found, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (found := merge.get(ids[h] * size + new)):
                heapq.heappush(queue, (found, h, ids[h], new))
        return [i for i in ids if i >= 0]

    def speculate(self, word: bytes) -> list[int]:
        ids, prefix, out, at, n = self.ids, self.prefix, [], 0, len(word)
        while at < n:
            end, best, stop = at + 1, None, at + 1
            while end <= n and (piece := word[at:end]) in prefix:
                if (found := ids.get(piece)) is not None:
                    best, stop = found, end
                end += 1
            out.append(best)
            at = stop
        return out

    def compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (first * size + second) encodes to itself."""
        new = np.setdiff1d(pairs, self.pairs)
        if len(new):
            verdicts = []
            for p in new.tolist():
                a, b = divmod(p, self.size)
                verdicts.append(self.exact(self.token[a] + self.token[b]) == [a, b])
            every = np.concatenate([self.pairs, new])
            order = np.argsort(every, kind="stable")
            self.pairs, self.verdicts = every[order], np.concatenate([self.verdicts, np.array(verdicts, bool)])[order]
            if len(self.pairs) > 2_000_000:  # bounded; verdicts can be found again
                out = self.verdicts[np.searchsorted(self.pairs, pairs)]
                self.pairs, self.verdicts = self.pairs[:0], self.verdicts[:0]
                return out
        return self.verdicts[np.searchsorted(self.pairs, pairs)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The identifiers of each word as little-endian 32-bit integers."""
        raw = [w.encode() for w in words]
        split = [self.speculate(w) for w in raw]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter((i for s in split for i in s), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(split)), sizes)
        at = np.nonzero(owner[1:] == owner[:-1])[0]
        bad = np.zeros(len(split), bool)
        bad[owner[at[~self.compatible(flat[at] * self.size + flat[at + 1])]]] = True
        lone = np.nonzero(sizes == 1)[0]
        starts = np.cumsum(sizes) - sizes
        for i in np.nonzero(bad)[0].tolist():
            split[i] = self.exact(raw[i])
        for i in lone.tolist():  # a whole word in the vocabulary must also be what its own merges give
            if not self._whole(int(flat[starts[i]])):
                split[i] = self.exact(raw[i])
        return [np.array(s, "<u4").tobytes() for s in split]

    def _whole(self, token: int) -> bool:
        if not hasattr(self, "checked"):
            self.checked: dict[int, bool] = {}
        if token not in self.checked:
            self.checked[token] = self.exact(self.token[token]) == [token]
        return self.checked[token]

    def encode(self, texts: list[str], special: bool = True) -> list[bytes]:
        """special: strings of special tokens become those tokens, else they are ordinary text."""
        cut = []
        for text in texts:
            words = self.ascii_words.findall if text.isascii() else self.words.findall
            if special and self.own and any(s in text for s in self.special):
                parts = self.own.split(text)
                cut.append([w for i, p in enumerate(parts) for w in ([(p,)] if i % 2 else words(p))])
            else:
                cut.append(words(text))
        known = self.known
        seen = set().union(*cut)
        seen.difference_update([(t,) for t in self.special])
        new = list(seen.difference(known))
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(seen)
        known.update(zip(new, self.encode_words(new), strict=True))
        for t, i in self.special.items():
            known[(t,)] = np.array([i], "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, some)) for some in cut]
        for w in new:
            if len(w) > LONG:
                del known[w]
        return out

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The process's own codec for a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, 32-bit little-endian) of every text. No shuffle."""

    def each(batches):
        own = codec(path)
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in slices([len(t) for t in texts], 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(own.encode(texts[a:b]), pa.binary())], names=["doc_id", "ids"])

    return _rows(docs).mapInArrow(each, "doc_id long, ids binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text; returns the number of tokens and digests of the ids and of the decoded text."""

    def each(batches):
        own, sha = codec(path), hashlib.sha256
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in slices([len(t) for t in texts], 1 << 20):
                ids = own.encode(texts[a:b])
                columns = [
                    batch.column("doc_id")[a:b],
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([sha(i).hexdigest() for i in ids], pa.string()),
                    pa.array([sha(own.decode(i).encode()).hexdigest() for i in ids], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
