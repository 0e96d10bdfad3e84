"""Phrase collocation mining by vertical positional inverted lists.

Texts are cut into pieces and words; what is counted lies within one piece and one language. A shard is about SHARD
consecutive words that one task read. In a shard every frequent phrase has its list of positions, in ascending order, and
so has every word. A list is extended by merge-joining its positions with the postings of the words that stand right behind;
what meets is the list of a phrase that is one word longer, and the lists' lengths, added up over all shards, are
its exact frequency. A phrase can only be frequent if its first and its last words are, so each round extends frequent
phrases by words that end a frequent phrase of the same length:

1. Texts are read once; each shard is written as a stream of local word numbers (0 between pieces) and its dictionary.
2. Dictionaries are added up to global frequencies; frequent words get numbers, which go back to the shards that have them.
3. In round k a shard gets the numbers of its frequent phrases of k words, keeps their lists, and counts each pair (phrase,
   next word) that it holds. Only these counts are shuffled by phrase; lists stay with their shard.
4. Frequent phrases are few (at most words / least); their parts' frequencies are joined to them by (language, words).

Words and pairs are dealt to parts by their hash. What a shard has for a part is one row of packed columns, so a task that adds
up a part meets each shard once and knows which shards get the numbers back: each count moves once.

Nothing whole is broadcast or collected. A language or word that holds a third of all occurrences has one row in each shard, and parts
are cut by hash alone. Products are decimals, so scores are exact.

Defined results: a null text is empty, a null language `und`. Every row is a document, also where rows repeat; words
are compared by their UTF-8 bytes. A text of more than SHARD words is a shard of its own. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, mix64, new_folder, parts as parts_of, strings

LEAST, LONGEST, TOP, ABSORBED = 100, 5, 2000, 100
SHARD, SALTS = 1 << 22, 64
_MARKS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz.........")


def _packed(values, kind=np.int64, steps: bool = False) -> bytes:
    """Numbers, or the steps between them, compressed."""
    values = np.asarray(values, np.int64)
    return zstandard.ZstdCompressor(level=1).compress((np.diff(values, prepend=0) if steps else values).astype(kind).tobytes())


def _unpacked(raw: bytes, kind=np.int64, steps: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind).astype(np.int64)
    return np.cumsum(values) if steps else values


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kinds = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))


def tokens(text: str) -> list[bytes]:
    """The words, with a full stop (never part of a word) at each end of a piece."""
    return text.encode().translate(_MARKS).replace(b".", b" . ").split()


_TOKENS = "shard long, part int, lang string, words binary, lids binary, n binary, total long, stream binary"
_WORDS = "shard long, lang string, words binary, lids binary, ids binary, a binary"


class _Shard:
    def __init__(self, number: int):
        self.number, self.size, self.streams = number, 0, []
        count = itertools.count(1)
        self.words: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(count.__next__, {b".": 0}))

    def add(self, lang: str, text: str) -> None:
        own = tokens(text)
        self.streams += [np.fromiter(map(self.words[lang].__getitem__, own), np.int32, len(own)), np.zeros(1, np.int32)]
        self.size += len(own) + 1

    def rows(self, parts: int):
        """The dictionary by part and language, then the stream."""
        stream = np.concatenate(self.streams)
        n = np.bincount(stream, minlength=1)
        for lang, known in self.words.items():
            words = list(known)[1:]  # without the full stop
            lids = np.fromiter(known.values(), np.int64, len(known))[1:]
            part = np.fromiter((xxhash.xxh64_intdigest(w) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            edges = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.nonzero(np.diff(edges))[0].tolist():
                own = order[edges[p] : edges[p + 1]]
                blob = zstandard.ZstdCompressor(level=1).compress(b" ".join([words[i] for i in own.tolist()]))
                yield _rows(_TOKENS, [(self.number, p, lang, blob, _packed(lids[own], steps=True), _packed(n[lids[own]]), int(n[lids[own]].sum()), None)])
        yield _rows(_TOKENS, [(self.number, None, None, None, None, None, None, _packed(stream, np.int32))])


def _shards(size: int, parts: int):
    def each(batches):
        numbers = itertools.count(TaskContext.get().partitionId() << 32)
        shard = _Shard(next(numbers))
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), strings(batch.column("text")), strict=True):
                if shard.size and shard.size + len(text) // 8 > size:
                    yield from shard.rows(parts)
                    shard = _Shard(next(numbers))
                shard.add(lang, text)
        if shard.size:
            yield from shard.rows(parts)

    return each


def _frequent_words(least: int, parts: int):
    """A part's frequent words with their numbers (shard -1), and for each shard the numbers of those that it has."""

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        count = itertools.count()
        index: dict[str, dict[bytes, int]] = defaultdict(lambda: defaultdict(count.__next__))
        total, held = np.zeros(1024, np.int64), []
        for row in table.select(["shard", "lang", "words", "lids", "n"]).to_pylist():
            words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b" ")
            at = np.fromiter(map(index[row["lang"]].__getitem__, words), np.int64, len(words))
            if at.max() >= len(total):
                total = np.concatenate([total, np.zeros(max(len(total), int(at.max()) + 1 - len(total)), np.int64)])
            total[at] += _unpacked(row["n"])  # a row has a word once
            held.append((row["shard"], at, row["lids"]))
        often = total >= least
        ids = (np.cumsum(often) - 1) * parts + part
        out = []
        for lang, known in index.items():
            at = np.fromiter(known.values(), np.int64, len(known))
            words = [w for w, yes in zip(known, often[at].tolist(), strict=True) if yes]
            at = at[often[at]]
            if words:
                out.append((-1, lang, zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), None, _packed(ids[at]), _packed(total[at])))
        for shard, at, lids in held:
            yes = often[at]
            if yes.any():
                out.append((shard, None, None, _packed(_unpacked(lids, steps=True)[yes], steps=True), _packed(ids[at[yes]]), None))
        return pa.Table.from_batches([_rows(_WORDS, out)])

    return each


_PAIRS = "shard long, pids binary, wids binary, ids binary, a binary"


def _frequent_pairs(least: int, parts: int):
    """The same for pairs (phrase, next word)."""

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.select(["shard", "pids", "wids", "n"]).to_pylist()
        pid = np.concatenate([_unpacked(r["pids"], steps=True) for r in rows])
        wid, n = (np.concatenate([_unpacked(r[c]) for r in rows]) for c in ("wids", "n"))
        owner = np.repeat(np.arange(len(rows)), [len(_unpacked(r["n"])) for r in rows])
        order = np.lexsort((wid, pid))
        pid, wid, n, owner = pid[order], wid[order], n[order], owner[order]
        new = np.ones(len(pid), bool)
        new[1:] = (pid[1:] != pid[:-1]) | (wid[1:] != wid[:-1])
        first = np.nonzero(new)[0]
        total = np.add.reduceat(n, first)
        often = total >= least
        ids = (np.cumsum(often) - 1) * parts + key[0].as_py()
        out = []
        if often.any():
            at = first[often]
            out.append((-1, _packed(pid[at], steps=True), _packed(wid[at]), _packed(ids[often]), _packed(total[often])))
            group = np.cumsum(new) - 1
            kept = np.nonzero(often[group])[0]
            kept = kept[np.argsort(owner[kept], kind="stable")]
            edges = np.searchsorted(owner[kept], np.arange(len(rows) + 1))
            for i in np.nonzero(np.diff(edges))[0].tolist():
                own = kept[edges[i] : edges[i + 1]]
                out.append((rows[i]["shard"], _packed(pid[own], steps=True), _packed(wid[own]), _packed(ids[group[own]]), None))
        return pa.Table.from_batches([_rows(_PAIRS, out)])

    return each


def _listed(batches):
    """The rows of shard -1, one by one."""
    for batch in batches:
        for row in batch.to_pylist():
            if "words" in row:
                words = zstandard.ZstdDecompressor().decompress(row["words"]).decode().split(" ")
                first = {"lang": pa.array([row["lang"]] * len(words)), "phrase": pa.array(words)}
            else:
                first = {"pid": pa.array(_unpacked(row["pids"], steps=True)), "wid": pa.array(_unpacked(row["wids"]))}
            yield pa.RecordBatch.from_pydict(first | {"id": pa.array(_unpacked(row["ids"])), "a": pa.array(_unpacked(row["a"]))})


class _Lists:
    """The lists of a shard's phrases of k words, one behind another, each in ascending order; and the postings of the words
    that can follow, in order of position."""

    def __init__(self, k: int, ids, sizes, pos, word_ids, word_pos, word_at):
        self.k, self.ids, self.sizes, self.pos = k, ids, sizes, pos
        self.word_ids, self.word_pos, self.word_at = word_ids, word_pos, word_at

    @classmethod
    def of_words(cls, ids: np.ndarray, pos: np.ndarray, at: np.ndarray) -> _Lists:
        """From the global ids, and the positions and places in `ids` of all occurrences, in order of position."""
        return cls(1, ids, np.bincount(at, minlength=len(ids)), pos[np.argsort(at, kind="stable")], ids, pos, at)

    def extended(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs, sizes, positions): for each phrase with a word behind it, as phrase's place * words + word's place, the list of both."""
        owner = np.repeat(np.arange(len(self.ids)), self.sizes)
        at = np.searchsorted(self.word_pos, self.pos + self.k)
        met = np.nonzero(at < len(self.word_pos))[0]
        met = met[self.word_pos[at[met]] == self.pos[met] + self.k]
        pair = owner[met] * len(self.word_ids) + self.word_at[at[met]]
        order = np.argsort(pair, kind="stable")
        pair, pos = pair[order], self.pos[met][order]
        first = np.nonzero(np.diff(pair, prepend=-1))[0]
        return pair[first], np.diff(first, append=len(pair)), pos

    def chosen(self, pids: np.ndarray, wids: np.ndarray, ids: np.ndarray) -> _Lists:
        """The lists of the frequent phrases (phrase, word) alone, which get new ids."""
        pair, sizes, pos = self.extended()
        by_p, by_w = np.argsort(self.ids), np.argsort(self.word_ids)
        wanted = by_p[np.searchsorted(self.ids, pids, sorter=by_p)] * len(self.word_ids) + by_w[np.searchsorted(self.word_ids, wids, sorter=by_w)]
        order = np.argsort(wanted)
        wanted, ids = wanted[order], ids[order]
        kept = np.isin(pair, wanted, assume_unique=True)
        pos = pos[np.repeat(kept, sizes)]
        ends = np.zeros(len(self.word_pos), bool)
        ends[np.searchsorted(self.word_pos, pos + self.k)] = True
        return _Lists(self.k + 1, ids[np.searchsorted(wanted, pair[kept])], sizes[kept], pos, self.word_ids, self.word_pos[ends], self.word_at[ends])

    def counted(self, parts: int):
        """(part, phrases, next words, counts) of all pairs."""
        pair, sizes, _ = self.extended()
        pid, wid = self.ids[pair // len(self.word_ids)], self.word_ids[pair % len(self.word_ids)]
        part = (mix64(mix64(pid.astype(np.uint64)) + wid.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((wid, pid, part))
        edges = np.searchsorted(part[order], np.arange(parts + 1))
        for p in np.nonzero(np.diff(edges))[0].tolist():
            own = order[edges[p] : edges[p + 1]]
            yield p, pid[own], wid[own], sizes[own]

    COLUMNS = {"ids": (np.int64, True), "sizes": (np.int32, False), "pos": (np.int32, True), "word_ids": (np.int64, True), "word_pos": (np.int32, True), "word_at": (np.int32, False)}

    def packed(self) -> list[bytes]:
        """Of words alone the postings are the lists in another order, so they are left out."""
        return [b"" if self.k == 1 and n.startswith("word") else _packed(getattr(self, n), *how) for n, how in self.COLUMNS.items()]

    @classmethod
    def unpacked(cls, k: int, row: dict) -> _Lists:
        got = {n: _unpacked(row[n], *how) for n, how in cls.COLUMNS.items() if row[n]}
        if k == 1:
            order = np.argsort(got["pos"], kind="stable")
            got |= {"word_ids": got["ids"], "word_pos": got["pos"][order], "word_at": np.repeat(np.arange(len(got["ids"])), got["sizes"])[order]}
        return cls(k, **got)


_ROUND = "shard long, part int, pids binary, wids binary, n binary, " + ", ".join(f"{n} binary" for n in _Lists.COLUMNS)


def _round(k: int, last: bool, parts: int):
    """Round k of a shard: the lists of its frequent phrases of k words, and the counts of what they can be extended to."""

    def each(key: tuple[pa.Scalar, ...], before: pa.Table, named: pa.Table) -> pa.Table:
        shard, out, without = key[0].as_py(), [], (None,) * len(_Lists.COLUMNS)
        if before.num_rows and named.num_rows:
            ids = np.concatenate([_unpacked(x) for x in named.column("ids").to_pylist()])
            if k == 1:
                stream = _unpacked(before.column("stream")[0].as_py(), np.int32)
                lids = np.concatenate([_unpacked(x, steps=True) for x in named.column("lids").to_pylist()])
                at = np.full(int(stream.max()) + 1, -1, np.int64)
                order = np.argsort(ids)
                at[lids[order]] = np.arange(len(lids))
                at = at[stream]
                pos = np.nonzero(at >= 0)[0]
                lists = _Lists.of_words(ids[order], pos, at[pos])
            else:
                pids = np.concatenate([_unpacked(x, steps=True) for x in named.column("pids").to_pylist()])
                wids = np.concatenate([_unpacked(x) for x in named.column("wids").to_pylist()])
                lists = _Lists.unpacked(k - 1, {n: before.column(n)[0].as_py() for n in _Lists.COLUMNS}).chosen(pids, wids, ids)
            out = [(shard, part, _packed(p, steps=True), _packed(w), _packed(n), *without) for part, p, w, n in lists.counted(parts)]
            if not last:
                out.append((shard, None, None, None, None, *lists.packed()))
        return pa.Table.from_batches([_rows(_ROUND, out)])

    return each


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """Rows with large values: small row groups, so a reader holds a few of them at a time."""
    rows.write.option("parquet.block.size", 16 << 20).parquet(folder)
    return again(rows.sparkSession, folder)


def again(spark: SparkSession, folder: str) -> DataFrame:
    """A table read for the second time has columns of its own, which a cogroup with the first needs."""
    return spark.read.parquet(folder)


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, a) of every phrase of 1 to `longest` words that occurs at least `least` times in its language; (lang, n)."""
    spark = docs.sparkSession
    folder, parts = new_folder(spark, "collocations"), parts_of(docs, 16 << 20)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    read = _written(texts.mapInArrow(_shards(shard, parts), _TOKENS), f"{folder}/0")
    dictionary = read.where("part is not null")
    totals = dictionary.groupBy("lang").agg(F.sum("total").alias("n"))
    back = dictionary.select("part", "shard", "lang", "words", "lids", "n").groupBy("part").applyInArrow(_frequent_words(least, parts), _WORDS)
    back = _written(back, f"{folder}/words")
    single = back.where("shard < 0").select("lang", "words", "ids", "a").mapInArrow(_listed, "lang string, phrase string, id long, a long")
    single = named = cut(single)
    found, before = [named.select("lang", F.lit(1).alias("k"), "phrase", "a")], again(spark, f"{folder}/0").where("stream is not null").select("shard", "stream")
    for k in range(1, longest):
        known = back.where("shard >= 0").select("shard", *(["lids", "ids"] if k == 1 else ["pids", "wids", "ids"]))
        rows = before.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_round(k, k == longest - 1, parts), _ROUND)
        rows = _written(rows, f"{folder}/{k}")
        counts = rows.where("part is not null").select("part", "shard", "pids", "wids", "n")
        back = _written(counts.groupBy("part").applyInArrow(_frequent_pairs(least, parts), _PAIRS), f"{folder}/pairs{k}")
        often = back.where("shard < 0").select("pids", "wids", "ids", "a").mapInArrow(_listed, "pid long, wid long, id long, a long")
        last = single.select(F.col("id").alias("wid"), F.col("phrase").alias("word"))
        longer = often.join(named.select(F.col("id").alias("pid"), "lang", "phrase"), "pid").join(last, "wid")
        named = cut(longer.select("id", "lang", F.concat_ws(" ", "phrase", "word").alias("phrase"), "a"))
        found.append(named.select("lang", F.lit(k + 1).alias("k"), "phrase", "a"))
        before = again(spark, f"{folder}/{k}").where("pos is not null").select("shard", *_Lists.COLUMNS)
    every = found[0]
    for some in found[1:]:
        every = every.unionByName(some)
    return every, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED, shard: int = SHARD) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A candidate that stands inside a longer one which is at least `absorbed` per cent as frequent is dropped.
    """
    every, totals = phrases(docs, least, longest, shard)
    f = cut(every)
    candidates = f.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = candidates.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("lang", "phrase", "a", "at", part(F.lit(1), F.col("at")).alias("head"), part(F.col("at") + 1, F.col("k") - F.col("at")).alias("rest"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = "(CAST(a AS DECIMAL(16, 0)) * 1000 * CAST(n AS DECIMAL(16, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    lowest = cuts.withColumn("score", F.expr(exact)).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "at", "l", "r")).alias("cut"))
    inner = candidates.where("k > 2").select("lang", "k", "a", "w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start"))
    inner = inner.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(absorbed)} * a")
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    # a language's first ones are among the first ones of each of SALTS shares of it, so the last task has a bounded number of rows
    kept = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    order = Window.partitionBy("lang").orderBy(*order)
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
