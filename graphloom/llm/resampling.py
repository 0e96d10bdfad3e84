"""Target-distribution importance resampling.

Features of a text (runs of up to `longest` consecutive words) are hashed into buckets. A bucket's gain says how much more
often the target texts have it than the documents do; a document's weight is the sum of the gains of its features, looked
up in one array. Gumbel noise that depends only on the document's id turns weights into scores whose highest
ones are a draw without replacement, in proportion to exp(weight / 1000).

1. One pass counts buckets: a task adds up its own texts and sends a row for each bucket it met.
2. A second pass scores the texts. Each task sorts what it has, eligible rows first, the best score on top, and writes it as
   a run: a sorted file of the shared folder. `at` names a row by run and position, so a run is in order by `at`.
3. The eligible rows' order is cut into ranges of about ROWS rows (quantiles of score, then of id and of position where one
   value fills several ranges), counted exactly. Only ranges up to the one that holds the last row to be drawn are read.
4. A range's task gets the slices of all runs, each still in order, and merges them by a tournament tree; it knows how
   many rows lie before it, so its winners' places are ranks, and the merge stops at the exact draw count.

No task sees more than a range, and the driver has a number for each range and bucket.

Defined results: a null text has no words. Rows are documents, also where rows repeat. A null id is hashed as the empty
text and comes after every other id; among rows of one score and id the order is that of their positions in the runs. With
no features at all on one side its counts are 0. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, free_name, new_folder, range_number, sortable, sortable_text, strings

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
ROWS = 1 << 18  # of a range
_LAST = 2**63 - 1
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
_WORDS = bytes(c if c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


class _Buckets(dict):
    """The bucket of a word, remembered."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = found = zlib.crc32(word) % self.n
        return found


def features(own: list[bytes], known: _Buckets, longest: int) -> np.ndarray:
    """The buckets of all runs of 1 to `longest` words; a longer run's checksum goes on from the shorter one's."""
    out = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
    if longest == 1:
        return out
    every, sums = [out], [zlib.crc32(w) for w in own]
    for k in range(1, longest):
        sums = [zlib.crc32(w, zlib.crc32(b" ", s)) for s, w in zip(sums, own[k:])]
        every.append(np.array(sums, np.int64) % known.n)
    return np.concatenate(every)


def counts(texts: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features of these texts each bucket has."""

    def each(batches):
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in strings(batch.column("text")):
                total += np.bincount(features(words(text), known, longest), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths of a nat, rounded down; one is added to every bucket's count."""
    n, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_source + n) / ((s + 1) * (all_target + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, least: int, seed: int, names: list[str]) -> DataFrame:
    """The documents with n_features, weight, score and whether they may be drawn, under the given names."""
    kept, buckets = docs.columns, len(gain)
    id_, text, *own = [free_name(n, kept) for n in ("own_id", "own_text")] + names

    def each(batches):
        known = _Buckets(buckets)
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column(id_).to_pylist(), strings(batch.column(text)), strict=True):
                w = words(t)
                found = features(w, known, longest)
                weight = int(gain[found].sum())
                rows.append((len(found), weight, weight + noise(doc_id, seed), len(w) >= least))
            columns = zip(*rows, strict=True) if rows else [()] * 4
            made = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.bool_()], strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(kept))], *made], names=[*kept, *own])

    rows = docs.select("*", F.col("doc_id").cast("string").alias(id_), F.col("text").cast("string").alias(text))
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.BooleanType())
    return rows.mapInArrow(each, T.StructType(docs.schema.fields + [T.StructField(n, k) for n, k in zip(own, kinds, strict=True)]))


class Tournament:
    """A tree over sorted runs: every inner node holds the run whose head won below it, so the next winner costs one match
    for each level."""

    def __init__(self, runs):
        self.runs = [iter(r) for r in runs]
        self.width = 1 << max(0, len(self.runs) - 1).bit_length()
        self.heads = [next(r, None) for r in self.runs] + [None] * (self.width - len(self.runs))
        self.tree = [0] * self.width + list(range(self.width))
        for node in range(self.width - 1, 0, -1):
            self.tree[node] = self._won(self.tree[2 * node], self.tree[2 * node + 1])

    def _won(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or x is not None and x <= y else b

    def __iter__(self):
        while True:
            best = self.tree[1]
            if self.heads[best] is None:
                return
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            node = (best + self.width) >> 1
            while node:
                self.tree[node] = self._won(self.tree[2 * node], self.tree[2 * node + 1])
                node >>= 1


def _bounds(rows: DataFrame, keys: list[str], n: int) -> list[str]:
    """Bounds of about n ranges by the keys together: quantiles of the first; where a value is several of them, its rows' quantiles
    of the next key."""
    done, open_ = [], {(): n}
    for depth, key in enumerate(keys):
        if not open_:
            break
        lead = keys[:depth]
        some = rows
        for i, name in enumerate(lead):
            some = some.where(F.col(name).isin(sorted({p[i] for p in open_})))
        most = max(open_.values())
        found = some.groupBy(*lead).agg(F.percentile_approx(key, [(i + 1) / most for i in range(most - 1)] or [0.5], 20 * most).alias("q")).collect()
        further = {}
        for row in found:
            lead_values = tuple(row[:depth])
            if lead_values not in open_:
                continue
            times: dict[int, int] = {}
            for x in (row["q"] or [])[:: max(1, most // open_[lead_values])]:
                times[x] = times.get(x, 0) + 1
            for x, m in times.items():
                done.append(lead_values + (x,) + (_LAST,) * (len(keys) - depth - 1))
                if m > 1:
                    further[lead_values + (x,)] = m
        open_ = further
    return sorted({sortable_text(*b) for b in done})


def ranks(runs: DataFrame, wanted: int, eligible: int, rows: int = ROWS) -> DataFrame:
    """(at, rank) of the `wanted` best of the eligible rows: neg, id and at, ascending. A task's rows of one run are in order by at."""
    keys = ["neg", "id", "at"]
    spark = runs.sparkSession
    bounds = _bounds(runs, keys, -(-eligible // rows)) if eligible > rows else []
    placed = runs.withColumn("place", range_number(sortable(*map(F.col, keys)), bounds).cast("int"))
    sizes = sorted((r["place"], r["count"]) for r in placed.groupBy("place").count().collect())
    before, offsets = 0, {}
    for place, n in sizes:
        if before < wanted:
            offsets[place] = before
        before += n

    def merged(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        place = key[0].as_py()
        at, neg, id_ = (table.column(c).to_numpy() for c in ("at", "neg", "id"))
        order = np.argsort(at)  # runs side by side, each in its own order
        at, neg, id_ = at[order], neg[order], id_[order]
        edges = [*np.nonzero(np.diff(at >> 33, prepend=-1))[0].tolist(), len(at)]
        slices = [zip(neg[a:b].tolist(), id_[a:b].tolist(), at[a:b].tolist()) for a, b in zip(edges, edges[1:])]
        first = offsets[place]
        out = [x[2] for x, _ in zip(Tournament(slices), range(wanted - first))]
        return pa.table({"at": pa.array(out, pa.int64()), "rank": pa.array(np.arange(first + 1, first + 1 + len(out)))})

    if not offsets:
        return spark.createDataFrame([], "at long, rank long")
    drawn = placed.where(F.col("place") <= max(offsets)).select("place", *keys)
    return drawn.groupBy("place").applyInArrow(merged, "at long, rank long")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, columns=(), rows: int = ROWS) -> DataFrame:
    """doc_id, the columns asked for, n_features, weight, score and rank of every document; rank is null for those not drawn.
    Give columns=["text"] and keep the rows with a rank to have the drawn texts.
    """
    spark = docs.sparkSession
    gain = gains(counts(docs, longest, buckets), counts(target, longest, buckets))
    extra = [c for c in columns if c.lower() not in ("doc_id", "text")]
    own = [free_name(n, ["doc_id", "text", *extra]) for n in ("n_features", "weight", "score", "eligible")]
    wide = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`") for c in extra]), gain, longest, least, seed, own)
    if "text" not in [c.lower() for c in columns]:
        wide = wide.drop("text")
    taken = [*wide.columns]
    neg, id_, at, rank = (free_name(n, taken) for n in ("neg", "id", "at", "rank"))
    placed = wide.withColumns({neg: -F.col(own[2]), id_: F.coalesce(F.col("doc_id"), F.lit(_LAST))})
    folder = new_folder(spark, "resampling-runs")
    placed.sortWithinPartitions(F.desc(own[3]), neg, id_).withColumn(at, F.monotonically_increasing_id()).write.parquet(folder)
    runs = spark.read.parquet(folder)
    may = runs.where(own[3]).select(F.col(neg).alias("neg"), F.col(id_).alias("id"), F.col(at).alias("at"))
    eligible = may.count()
    ranked = cut(ranks(may, percent * eligible // 100, eligible, rows)).select(F.col("at").alias(at), F.col("rank").alias(rank))
    return runs.join(ranked, at, "left").select(*[F.col(f"`{c}`") for c in taken if c != own[3]], F.col(f"`{rank}`").cast("long").alias(rank))
