"""Interpolated modified Kneser-Ney over word trigrams, trained and scored by count joins of packed n-grams.

A word is a run of word characters or of punctuation of the lower-cased text; Chinese and Japanese characters are
words of their own. A document is led by two start words and closed by an end word. Words are 64-bit hashes and an
n-gram is the xor of its rotated words, so no vocabulary is kept anywhere. What is gathered grows with the corpus.

The ln p of a text is a sum over its n-grams of all orders: an n-gram's value is what it adds to its back-off
(ln p - ln of the shorter one's p - ln of the context's back-off mass), plus the ln of its own back-off mass as a
context; what was never seen adds nothing, and each word starts from the ln p of an unseen one.

A trigram goes to the part of its last two words, which knows that pair too (its count and its mass as a context),
so a trigram is asked for once for both; a single word's value is added where the text is read, or asked for at the
word's own part if it is rare. The HEAVY most frequent pairs are known where the text is read, and their trigrams are
dealt by all three words, so no pair of every document lands in one task.

What moves is a row for each slice of text and part, its words by their rank among the CODES most frequent ones (rank
and frequency are of a sample of about SAMPLE stored bytes; a rarer word is its hash, so nothing hangs on the sample),
byte planes packed. The model is dealt in TURNS of parts and asked in BATCHES of texts, and a step's shuffle files go
when its rows are written, so the disk holds the model and one batch. A part's model and its questions are in one task; parts follow the input.
"""

from __future__ import annotations

import itertools
import re
from contextlib import contextmanager
from functools import cached_property
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, mix64, new_folder, opened, parts as parts_of, remove, size_hint, slices, strings

ORDER, HEAVY, STEP = 3, 1 << 16, 1 << 21
CODES, SAMPLE, PART, TURNS, BATCHES, SMALL = (1 << 16) - 1, 8 << 20, 12 << 20, 4, 5, 32 << 20
START, END = 0x5BD1E995A7C3F021, 0x27D4EB2F165667C5
SALT, TURN = (0, 0x1B873593CC9E2D51, 0x38B34AE5A1E38B93, 0x52DCE729D2A98B26), 21
_WORD = re.compile("[぀-ヿ㐀-鿿]|[^\\W぀-ヿ㐀-鿿]+|[^\\w\\s]+")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SCHEMA = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("slice", pa.int64()), ("size", pa.int64()), ("codes", pa.binary()), ("rare", pa.binary()), ("more", pa.binary())]
    + [(n, pa.int64()) for n in ("key", "types", "total", "c1", "c2", "c3", "c4")]
)
_ROWS = "kind string, part int, slice long, size long, codes binary, rare binary, more binary, key long, types long, total long, c1 long, c2 long, c3 long, c4 long"
_SUMMED = ["types", "total", "c1", "c2", "c3"]
_BLOBS = ["kind", "part", "size", "codes", "rare", "more"]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all words with the start and end words, the text each is of, and its place there."""
    own = [words(t) for t in texts]
    sizes = np.fromiter(map(len, own), np.int64, len(own)) + ORDER
    codes, found = pd.factorize(np.array(list(chain.from_iterable(own)), object))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in found), np.uint64, len(found))
    owner = np.repeat(np.arange(len(own)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seq = np.full(len(owner), START, np.uint64)
    seq[np.cumsum(sizes) - 1] = END
    inner = place >= ORDER - 1
    inner[np.cumsum(sizes) - 1] = False
    seq[inner] = hashes[codes]
    return seq, owner, place


def discounts(n: list[int]) -> np.ndarray:
    """The three discounts, from the numbers of n-grams seen once to four times; half a count where those say nothing."""
    if not all(n):
        return np.array([0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 0.95) for k in range(3)])


def gram(*some: np.ndarray) -> np.ndarray:
    """The n-grams of arrays of words, the last word in the last array."""
    out = some[-1] ^ np.uint64(SALT[len(some)])
    for k, w in enumerate(some[-2::-1], 1):
        out ^= (w << np.uint64(TURN * k)) | (w >> np.uint64(64 - TURN * k))
    return out


def _squeezed(x: np.ndarray) -> bytes:
    """Byte planes, as equal high bytes then take no room."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _restored(blob: bytes, kind) -> np.ndarray:
    raw, wide = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8), np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(wide, -1).T).reshape(-1).view(kind)


def _few(x: np.ndarray) -> bytes:
    """Numbers of which few are different: these, then which one each is."""
    at, own = pd.factorize(x)
    head = _squeezed(own)
    return len(head).to_bytes(8, "little") + head + _squeezed(at.astype(np.uint32))


def _few_restored(blob: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(blob[:8], "little")
    return _restored(blob[8:end], float)[_restored(blob[end:], np.uint32)]


def _rows(n: int, **known) -> pa.RecordBatch:
    own = [pa.array([known[f.name]] * n if isinstance(known[f.name], str | int) else known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in _SCHEMA]
    return pa.RecordBatch.from_arrays(own, schema=_SCHEMA)


class Weights(NamedTuple):
    one: np.ndarray  # the discounts of words
    two: np.ndarray  # and of pairs
    total: float
    base: float  # p of a word that was never seen


class Coding:
    """How n-grams are spelled and dealt: the frequent words by rank (0 is none), the frequent pairs, the number of parts."""

    def __init__(self, ranked: np.ndarray, pairs: np.ndarray, parts: int):
        self.ranked, self.pairs, self.parts = ranked, pairs, parts

    @cached_property
    def _ranks(self) -> pd.Index:
        return pd.Index(self.ranked)

    @cached_property
    def _spots(self) -> pd.Index:
        return pd.Index(gram(*self.pairs))

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranked", "pairs", "parts")}

    def codes(self, some: np.ndarray) -> np.ndarray:
        rank = self._ranks.get_indexer(some)
        return np.where(rank < 0, CODES, rank).astype(np.uint16)

    def spot(self, pair: np.ndarray) -> np.ndarray:
        """The number of a frequent pair, -1 for others."""
        return self._spots.get_indexer(pair)

    def part(self, key: np.ndarray) -> np.ndarray:
        return (mix64(key) % np.uint64(self.parts)).astype(np.int32)

    def keyed(self, pair: np.ndarray, some: np.ndarray, spot: np.ndarray) -> np.ndarray:
        return self.part(np.where(spot >= 0, gram(*some), pair))

    def blobs(self, part: np.ndarray, some: np.ndarray, more: np.ndarray, codes: np.ndarray | None = None, steps: bool = False, **known) -> pa.RecordBatch:
        """A row for each part: its trigrams' words and what belongs to each of them."""
        part = part.astype(np.min_scalar_type(self.parts))
        codes = self.codes(some.ravel()).reshape(some.shape) if codes is None else codes
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        at = np.nonzero(np.diff(edges))[0]
        own = [order[edges[p] : edges[p + 1]] for p in at]
        spelled = [codes[:, o] for o in own]
        rare = [_squeezed(some[:, o][c == CODES]) for o, c in zip(own, spelled, strict=True)]
        pack = _few if more.dtype == float else _squeezed
        rest = [pack(np.diff(more[o], prepend=more.dtype.type(0)) if steps else more[o]) for o in own]
        return _rows(len(at), kind="grams", part=at, size=[len(o) for o in own], codes=[_squeezed(c.ravel()) for c in spelled], rare=rare, more=rest, **known)

    def read(self, rows: list[dict], kind) -> tuple[np.ndarray, np.ndarray]:
        found = []
        for r in rows:
            codes = _restored(r["codes"], np.uint16)
            known = codes != CODES
            some = np.empty(len(codes), np.uint64)
            some[known] = self.ranked[codes[known]]
            some[~known] = _restored(r["rare"], np.uint64)
            found.append(some.reshape(ORDER, -1))
        if not found:
            return np.empty((ORDER, 0), np.uint64), np.empty(0, kind)
        return np.concatenate(found, axis=1), np.concatenate([_few_restored(r["more"]) if kind is float else _restored(r["more"], kind) for r in rows])

    def words(self, source: int, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """What a source's pairs with their counts say of their words, a row for each part of words."""
        own, at = np.unique(np.concatenate([one, two]), return_inverse=True)
        one, two = at[: len(one)], at[len(one) :]
        sums = np.stack([np.bincount(two, minlength=len(own)), *(np.bincount(one, x, len(own)) for x in (n, n == 1, n == 2, n > 2))]).astype(np.uint64)
        order, edges = self.dealt(own)
        at = np.nonzero(np.diff(edges))[0]
        each = [order[edges[p] : edges[p + 1]] for p in at]
        rare, rest = [_squeezed(own[o]) for o in each], [_squeezed(sums[:, o].ravel()) for o in each]
        return _rows(len(at), kind="words", part=at, slice=source, size=[len(o) for o in each], rare=rare, more=rest)

    def dealt(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted words by part, and where each part's begin."""
        part = self.part(own)
        order = np.argsort(part, kind="stable")
        return order, np.searchsorted(part[order], np.arange(self.parts + 1))


class Model(NamedTuple):
    coding: Coding
    folder: str
    weights: Weights
    ones: np.ndarray  # what each frequent word adds
    twos: np.ndarray  # what each frequent pair adds
    below: np.ndarray  # p of each frequent pair's last word after its first


@contextmanager
def _tidy(spark: SparkSession):
    """Shuffle files go as soon as the rows that they were for are written."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def _written(rows: DataFrame, path: str) -> DataFrame:
    """The rows, in a folder for each kind and part."""
    rows.write.mode("append").partitionBy("kind", "part").option("parquet.block.size", 16 << 20).parquet(path)
    return rows.sparkSession.read.schema(_ROWS).parquet(path)


def _sampled(batches):
    for batch in batches:
        texts = strings(batch.column("text"))
        for a, b in slices([len(t) for t in texts], STEP):
            seq, _, place = sequences(texts[a:b])
            at = np.nonzero(place)[0]
            _, first, n = np.unique(gram(seq[at - 1], seq[at]), return_index=True, return_counts=True)
            pair = at[first]
            word, m = np.unique(seq, return_counts=True)
            one, two = np.concatenate([np.zeros(len(word), np.uint64), seq[pair - 1]]), np.concatenate([word, seq[pair]])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (one, two, np.concatenate([m, n]))], names=["w1", "w2", "n"])


def coded(docs: DataFrame, folder: str) -> Coding:
    """The words and pairs that are frequent in a sample of about SAMPLE bytes (rows by hash)."""
    size = size_hint(docs)
    share = min(1 << 20, -(-(SAMPLE << 20) // size)) if size else 1 << 20
    text = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 20)) < share)
    found = text.mapInArrow(_sampled, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("n"))
    found.write.parquet(f"{folder}/sample")
    found = docs.sparkSession.read.parquet(f"{folder}/sample")
    top = lambda some, n: found.where(some).orderBy(F.desc("n"), "w1", "w2").limit(n).toPandas()
    word, pair = top("w1 = 0", CODES - 1)["w2"], top("w1 <> 0", HEAVY)
    remove(docs.sparkSession, f"{folder}/sample")
    unsigned = lambda x: x.to_numpy(np.int64).view(np.uint64)
    return Coding(np.concatenate([np.zeros(1, np.uint64), unsigned(word)]), np.stack([unsigned(pair["w1"]), unsigned(pair["w2"])]), parts_of(docs, PART))


def _counted(coding: Coding):
    """Trigrams with their counts in a slice, by their first two words."""

    def each(batches):
        for batch in batches:
            texts = strings(batch.column("text"))
            for a, b in slices([len(t) for t in texts], STEP):
                seq, _, place = sequences(texts[a:b])
                at = np.nonzero(place >= ORDER - 1)[0]
                _, first, n = np.unique(gram(seq[at - 2], seq[at - 1], seq[at]), return_index=True, return_counts=True)
                at = at[first]
                some = np.stack([seq[at - 2], seq[at - 1], seq[at]])
                pair = gram(*some[:2])
                yield coding.blobs(coding.keyed(pair, some, coding.spot(pair)), some, n.astype(np.uint64))

    return each


def _sizes(n: np.ndarray) -> pa.RecordBatch:
    return _rows(1, kind="sizes", part=0, **{f"c{k}": [int((n == k).sum())] for k in (1, 2, 3, 4)})


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and the run that each value is in."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _part_rows(folder: str, kind: str, part: int) -> list[dict]:
    store, path = opened(f"{folder}/kind={kind}/part={part}")
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".parquet"))
    return [r for f in files for r in pq.read_table(f, filesystem=store, partitioning=None).to_pylist()]


def _summed(coding: Coding):
    """A part's trigrams with their counts, by their first two words; what those that begin with a frequent pair say of it."""

    def each(key, table):
        some, n = coding.read(table.to_pylist(), np.uint64)
        _, first, at = np.unique(gram(*some), return_index=True, return_inverse=True)
        some, n = some[:, first], np.bincount(at, n).astype(np.uint64)
        pair = gram(*some[:2])
        order = np.argsort(pair, kind="stable")
        some, n, spot = some[:, order], n[order], coding.spot(pair[order])
        m, spot = n[spot >= 0], spot[spot >= 0]
        own, at = np.unique(spot, return_inverse=True)
        sums = {k: np.bincount(at, v, len(own)).astype(np.int64) for k, v in {"total": m, "c1": m == 1, "c2": m == 2, "c3": m > 2}.items()}
        part = np.full(len(n), key[0].as_py(), np.int32)
        return pa.Table.from_batches([coding.blobs(part, some, n), _rows(len(own), kind="pairs", part=0, key=own, **sums), _sizes(n)])

    return each


def _contexts(coding: Coding, rows: list[dict], d: np.ndarray, spare: np.ndarray):
    """Trigrams that are sorted by their first two words, with their counts less the discount over the context's spare mass;
    where contexts begin that are not frequent pairs, and the ln of their back-off mass.
    """
    some, n = coding.read(rows, np.uint64)
    pair, n = gram(*some[:2]), n.astype(float)
    first, at = _runs(pair)
    off, spot = d[np.minimum(n, 3).astype(int) - 1], coding.spot(pair[first])
    mass, total = np.bincount(at, off, len(first)), np.bincount(at, n, len(first))
    mass[spot >= 0] = spare[spot[spot >= 0]]
    return some, (n - off) / mass[at], pair, first[spot < 0], np.log(mass / total)[spot < 0]


def _ratios(coding: Coding, d: np.ndarray, spare: np.ndarray, turn: int):
    """This turn's trigrams by their last two words, each with its ratio; an empty row for each part, as it may have contexts only."""

    def each(batches):
        for batch in batches:
            for r in batch.to_pylist():
                some, ratio, *_ = _contexts(coding, [r], d, spare)
                pair = gram(*some[1:])
                part = coding.keyed(pair, some, coding.spot(pair))
                take = part % TURNS == turn
                yield coding.blobs(part[take], some[:, take], ratio[take])
                if r["part"] % TURNS == turn:
                    yield _rows(1, kind="grams", part=r["part"], size=[0], codes=[_squeezed(np.empty(0, np.uint16))], rare=[_squeezed(np.empty(0, np.uint64))], more=[_few(np.empty(0))])

    return each


def _placed(coding: Coding, folder: str, d: np.ndarray, spare: np.ndarray):
    """A part's trigrams by their last two words (none before a pair that is only a context; frequent pairs at the end),
    the back-off mass of each pair, and what pairs say of their words.
    """

    def each(key, table):
        part = key[0].as_py()
        some, ratio = coding.read(table.to_pylist(), float)
        before, _, pair, start, mass = _contexts(coding, _part_rows(folder, "grams", part), d, spare)
        end = gram(*some[1:])
        lone = start[~pd.Index(pair[start]).isin(end)]
        some = np.concatenate([some, np.stack([np.zeros(len(lone), np.uint64), *before[:2, lone]])], axis=1)
        ratio, end = np.append(ratio, np.zeros(len(lone))), np.append(end, pair[lone])
        spot = coding.spot(end)
        order = np.lexsort((end, spot >= 0))
        some, ratio, end, spot = some[:, order], ratio[order], end[order], spot[order]
        cold, real = int((spot < 0).sum()), some[0] != 0
        first, at = _runs(end[:cold])
        back = np.zeros(len(first))
        back[np.searchsorted(end[first], pair[start])] = mass
        n = np.bincount(at, real[:cold], len(first)).astype(np.int64)
        first, n = first[n > 0], n[n > 0]
        own, m = np.unique(spot[cold:], return_counts=True)
        out = [coding.blobs(np.full(len(ratio), part, np.int32), some, ratio), _rows(1, kind="backs", part=part, size=[len(back)], more=[_squeezed(back)])]
        return pa.Table.from_batches([*out, _rows(len(own), kind="pairs", part=0, key=own, total=m), _sizes(n), coding.words(part, some[1, first], some[2, first], n)])

    return each


def _word_sums(coding: Coding, frequent: np.ndarray):
    """The sums over all sources of a part's words: for each source in its own order, of rare words by themselves, of frequent ones as rows."""

    def each(key, table):
        part, rows = key[0].as_py(), table.to_pylist()
        some = [_restored(r["rare"], np.uint64) for r in rows]
        own, at = np.unique(np.concatenate(some), return_inverse=True)
        counts = np.concatenate([_restored(r["more"], np.uint64).reshape(5, -1) for r in rows], axis=1)
        sums = np.stack([np.bincount(at, c, len(own)) for c in counts]).astype(np.uint64)
        edges = np.cumsum([0, *map(len, some)])
        back = [(r["slice"], _squeezed(sums[:, at[a:b]].ravel())) for r, a, b in zip(rows, edges, edges[1:], strict=False) if r["slice"] >= 0]
        rare, top = coding.codes(own) == CODES, np.isin(own, frequent)
        t = sums[0].astype(np.int64)
        return pa.Table.from_batches(
            [
                _rows(len(back), kind="replies", part=[s for s, _ in back], slice=part, more=[b for _, b in back]),
                _rows(1, kind="lone", part=part, size=[int(rare.sum())], rare=[_squeezed(own[rare])], more=[_squeezed(sums[:, rare].ravel())]),
                _rows(1, kind="sizes", part=0, total=[int(t.sum())], types=[int((t > 0).sum())], **{f"c{k}": [int((t == k).sum())] for k in (1, 2, 3, 4)}),
                _rows(int(top.sum()), kind="frequent", part=0, key=own[top].view(np.int64), **dict(zip(_SUMMED, sums[:, top].astype(np.int64), strict=True))),
            ]
        )

    return each


def _totals(rows: DataFrame, kind: str, *columns: str) -> pd.DataFrame:
    return rows.where(F.col("kind") == kind).groupBy("key").agg(*[F.sum(c).alias(c) for c in columns]).toPandas()


def _dense(found: pd.DataFrame, column: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    out[found["key"].to_numpy(np.int64)] = found[column]
    return out


def build(trusted: DataFrame, coding: Coding, folder: str) -> Model | None:
    """The model of the texts; None if there is none."""
    spark, heavy, four = trusted.sparkSession, coding.pairs.shape[1], ["c1", "c2", "c3", "c4"]
    rows = trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(coding), _ROWS)
    counts = _written(rows.select(*_BLOBS).groupBy("part").applyInArrow(_summed(coding), _ROWS), f"{folder}/counts")
    sizes = _totals(counts, "sizes", *four)
    if not len(sizes):
        return None
    d, ends = discounts(sizes.iloc[0][four].astype(int).tolist()), _totals(counts, "pairs", "total", "c1", "c2", "c3")
    spare, total = sum(_dense(ends, f"c{k + 1}", heavy) * d[k] for k in range(3)), _dense(ends, "total", heavy)
    backs = np.log(np.divide(spare, total, out=np.ones(heavy), where=total > 0))
    for turn in range(TURNS):
        rows = counts.where("kind = 'grams'").select(*_BLOBS).mapInArrow(_ratios(coding, d, spare, turn), _ROWS)
        placed = _written(rows.select(*_BLOBS).groupBy("part").applyInArrow(_placed(coding, f"{folder}/counts", d, spare), _ROWS), f"{folder}/grams")
    remove(spark, f"{folder}/counts")

    n = _dense(_totals(placed, "pairs", "total"), "total", heavy)
    two = discounts([int(x + (n == k + 1).sum()) for k, x in enumerate(_totals(placed, "sizes", *four).iloc[0][four])])
    seen = np.nonzero(n)[0]
    ours = pa.Table.from_batches([coding.words(-1, *coding.pairs[:, seen], n[seen].astype(np.int64))]).select(["part", "slice", "rare", "more"])
    some = placed.where("kind = 'words'").select("part", "slice", "rare", "more").unionByName(spark.createDataFrame(ours, "part int, slice long, rare binary, more binary"))
    frequent = np.unique(np.concatenate([coding.ranked, coding.pairs.ravel()]))
    found = _written(some.groupBy("part").applyInArrow(_word_sums(coding, frequent), _ROWS), f"{folder}/words")
    remove(spark, f"{folder}/grams/kind=words")
    r = _totals(found, "sizes", "total", "types", *four).drop(columns="key").iloc[0].astype(int)
    one = discounts(r[four].tolist())
    base = float(one @ [r["c1"], r["c2"], r["types"] - r["c1"] - r["c2"]]) / r["total"] / (r["types"] + 1)
    weights, top = Weights(one, two, float(r["total"]), base), _totals(found, "frequent", *_SUMMED)
    word = _Words(top["key"].to_numpy(np.int64).view(np.uint64), top[_SUMMED].to_numpy(float).T, weights)
    value, below = word.pairs(*coding.pairs, n)
    return Model(coding, folder, weights, word.ones(coding.ranked), backs + value, below)


class _Words:
    """What is known of some words: p after any other, spare mass and total as a context."""

    def __init__(self, own: np.ndarray, sums: np.ndarray, weights: Weights):
        types, total, *c = (np.append(x, 0.0) for x in sums)
        p = (types - weights.one[np.clip(types, 1, 3).astype(int) - 1]) / weights.total + weights.base
        self.own, self.p, self.weights = pd.Index(own), np.where(types > 0, p, 0), weights
        self.spare, self.total = sum(x * d for x, d in zip(c, weights.two, strict=True)), total

    def ones(self, some: np.ndarray) -> np.ndarray:
        at = self.own.get_indexer(some)
        p, spare, total = self.p[at], self.spare[at], self.total[at]
        p = np.where(p > 0, np.log(np.where(p > 0, p, 1)) - np.log(self.weights.base), 0)
        return p + np.where(total > 0, np.log(np.where(total > 0, spare, 1) / np.where(total > 0, total, 1)), 0)

    def pairs(self, one: np.ndarray, two: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What pairs with these counts add, and p of their last words; 0 and 1 for those that were not seen."""
        value, below, seen = np.zeros(len(n)), np.ones(len(n)), n > 0
        a, b, m = self.own.get_indexer(one[seen]), self.own.get_indexer(two[seen]), n[seen]
        more, back = m - self.weights.two[np.minimum(m, 3).astype(int) - 1], self.spare[a] * self.p[b]
        value[seen], below[seen] = np.log1p(more / back), (more + back) / self.total[a]
        return value, below


def _asked(coding: Coding, ones: np.ndarray, twos: np.ndarray):
    """What a slice's texts ask of each part; their keys, numbers of words and what their frequent words and pairs add."""

    def each(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        for batch in batches:
            texts, keys = strings(batch.column("text")), batch.column("key").to_numpy()
            for a, b in slices([len(t) for t in texts], STEP):
                number = next(numbers)
                seq, owner, place = sequences(texts[a:b])
                code = coding.codes(seq)
                at = np.nonzero(place)[0]
                own, whole, frequent = owner[at], place[at] > 1, code[at] != CODES
                known = np.bincount(own[frequent], ones[code[at][frequent]], b - a)
                pair = gram(seq[at - 1], seq[at])
                spot = coding.spot(pair)
                known += np.bincount(own[spot >= 0], twos[spot[spot >= 0]], b - a)
                some = np.stack([np.where(whole, seq[at - 2], np.uint64(0)), seq[at - 1], seq[at]])
                codes = np.stack([np.where(whole, code[at - 2], np.uint16(0)), code[at - 1], code[at]])
                part, rare, ask = coding.keyed(pair, some, spot), np.nonzero(~frequent)[0], (spot < 0) | whole
                lone = lambda x: np.concatenate([x[:, ask], np.stack([x[2, rare] * x.dtype.type(k == 2) for k in range(ORDER)])], axis=1)  # noqa: B023, E731
                part = np.concatenate([part[ask], coding.part(some[2, rare])])
                doc = np.concatenate([own[ask], own[rare]]).astype(np.uint32)
                yield coding.blobs(part, lone(some), doc, lone(codes), steps=True, slice=number)
                size = np.bincount(owner, minlength=b - a) - (ORDER - 1)
                yield _rows(1, kind="texts", part=[coding.parts + number % coding.parts], slice=[number], size=[b - a], rare=[_squeezed(keys[a:b])], more=[_squeezed(np.concatenate([size, known]))])

    return each


class _Part:
    """A part's pairs and trigrams with what they add."""

    def __init__(self, model: Model, part: int):
        coding, listed = model.coding, lambda kind, folder: _part_rows(f"{model.folder}/{folder}", kind, part)
        some, ratio = coding.read(listed("grams", "grams"), float)
        pair, real = gram(*some[1:]), some[0] != 0
        spot = coding.spot(pair)
        cold = int((spot < 0).sum())
        first, at = _runs(pair[:cold])
        n = np.bincount(at, real[:cold], len(first))
        own = np.unique(some[1:, first[n > 0]])
        sums = [_restored(r["more"], np.uint64).reshape(5, -1) for r in sorted(listed("replies", "words"), key=lambda r: r["slice"])]
        words = _Words(own[coding.dealt(own)[0]], np.concatenate([np.empty((5, 0)), *sums], axis=1), model.weights)
        value, below = words.pairs(*some[1:, first], n)
        backs = [_restored(r["more"], float) for r in listed("backs", "grams")]
        self.twos = np.append(value + np.concatenate([np.empty(0), *backs]), 0.0)
        p = np.concatenate([below[at], model.below[spot[cold:]]])
        self.pairs, self.grams, self.threes = pd.Index(pair[first]), pd.Index(gram(*some[:, real])), np.append(np.log1p(ratio[real] / p[real]), 0.0)
        lone = [(_restored(r["rare"], np.uint64), _restored(r["more"], np.uint64).reshape(5, -1)) for r in listed("lone", "words")]
        self.lone = _Words(np.concatenate([np.empty(0, np.uint64), *(x for x, _ in lone)]), np.concatenate([np.empty((5, 0)), *(x for _, x in lone)], axis=1), model.weights)

    def adds(self, some: np.ndarray) -> np.ndarray:
        out = self.twos[self.pairs.get_indexer(gram(*some[1:]))] + self.threes[self.grams.get_indexer(gram(*some))]
        lone = some[1] == 0
        out[lone] = self.lone.ones(some[2, lone])
        return out


_SUMS = "slice long, size long, rare binary, more binary"


def _answered(model: Model):
    """What a part's n-grams add to the texts that ask for them."""

    def each(key, table):
        part, out = None, {n: [] for n in ("slice", "size", "rare", "more")}
        for r in table.to_pylist():
            if r["kind"] == "grams":
                part = part or _Part(model, key[0].as_py())
                some, doc = _restored_steps(model.coding, r)
                sums = np.bincount(doc, part.adds(some))
                own = np.nonzero(sums)[0]
                r |= {"size": None, "rare": _squeezed(np.diff(own, prepend=0)), "more": _squeezed(sums[own])}
            for n, column in out.items():
                column.append(r[n])
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)], names=list(out))

    return each


def _restored_steps(coding: Coding, row: dict) -> tuple[np.ndarray, np.ndarray]:
    some, steps = coding.read([row], np.uint32)
    return some, np.cumsum(steps, dtype=np.uint32).astype(np.int64)


def _added(table):
    """The keys, sums and numbers of words of a slice's texts."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["size"] is not None)
    size, add = _restored(head["more"], float).reshape(2, -1).copy()
    for r in rows:
        if r["size"] is None:
            add[np.cumsum(_restored(r["rare"], np.int64))] += _restored(r["more"], float)
    return pa.table({"key": _restored(head["rare"], np.int64), "size": size.astype(np.int64), "add": add})


def scored(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang, chars and perplexity of every row, under a model of the trusted texts."""
    spark, text = docs.sparkSession, F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text.alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    heads = rows.select("doc_id", "lang", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), "key")
    folder = new_folder(spark, "wordgrams")
    try:
        with _tidy(spark):
            model = build(trusted, coded(docs, folder), folder)
            if model is None:
                return cut(heads.select("doc_id", "lang", "chars", F.lit(None).cast("double").alias("perplexity")))
            batches = 1 if 0 < size_hint(docs) < SMALL else BATCHES
            for k in range(batches):
                asked = rows.where(F.pmod("key", F.lit(batches)) == k).select("key", "text").mapInArrow(_asked(model.coding, model.ones, model.twos), _ROWS)
                found = asked.select("slice", *_BLOBS).groupBy("part").applyInArrow(_answered(model), _SUMS)
                found.groupBy("slice").applyInArrow(_added, "key long, size long, add double").write.parquet(f"{folder}/sums/batch={k}")
        # rows that are the same in all three columns share a key; words and sums both count each of them
        sums = spark.read.parquet(f"{folder}/sums").groupBy("key").agg(F.sum("add").alias("add"), F.sum("size").alias("size"))
        unseen = float(np.log(model.weights.base))
        return cut(heads.join(sums, "key").select("doc_id", "lang", "chars", F.exp(-(F.col("add") / F.col("size") + unseen)).alias("perplexity")))
    finally:
        remove(spark, folder)
