"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fixed fraction of the hash range, 1/FRACTION for every document, so sketches
of documents of any length can be merged and compared, a short one with what a very long one contains. Shingles are
windows of SHINGLE bytes of the UTF-8 text; a shorter text is one shingle. Hashes have BITS bits. A text none of
whose hashes is below the fraction keeps its smallest one, so only an empty text has an empty sketch; in a merge this
hash goes as soon as there is one below the fraction, and else the smaller one stays.

Error: an estimate from n hashes of the union has a standard deviation of sqrt(J (1 - J) / n); n is about an eighth of
the bytes. Repetitive texts have few distinct shingles and are compared by the few hashes that they have.

Defined results: a null text counts as empty; an empty text has an empty sketch ("8:"), whose likeness is 1 to another
empty one and 0 to any other. Rows without an id come first, and rows that share an id follow in the order of the
XXH64 hashes of their texts. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWEST, mix64, order_key, parts, range_number, slices, sortable, sortable_text, strings

SHINGLE, BITS, FRACTION = 16, 48, 8
LIMIT = np.uint64(2**BITS // FRACTION)
STEP = 1 << 20
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, within_edited double, within_next double"
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for every window of SHINGLE bytes, by doubling its width four times."""
    h, width = _BYTES[data], 1
    while width < SHINGLE:
        h = mix64(h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:])
        width *= 2
    return h >> np.uint64(64 - BITS)


def _smallest(text: np.ndarray) -> np.ndarray:
    return min(window_hashes(text[at : at + STEP + SHINGLE - 1]).min() for at in range(0, len(text) - SHINGLE + 1, STEP)).reshape(1)


def sketch_all(texts: list[bytes]) -> list[np.ndarray]:
    """The ascending hashes that each text's sketch keeps. The texts are hashed as one string, STEP bytes at a time."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owners, kept = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for at in range(0, max(0, len(data) - SHINGLE + 1), STEP):
        h = window_hashes(data[at : at + STEP + SHINGLE - 1])
        pos = np.nonzero(h < LIMIT)[0]
        owner = np.searchsorted(ends, pos + at, "right")
        whole = pos + at + SHINGLE <= ends[owner]
        owners.append(owner[whole])
        kept.append(h[pos[whole]])
    owner, hashes = np.concatenate(owners), np.concatenate(kept)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for i, text in enumerate(texts):
        own = hashes[cuts[i] : cuts[i + 1]]
        if not len(own) and text:
            if len(text) < SHINGLE:
                own = np.frombuffer(hashlib.sha256(text).digest()[:8], ">u8").astype(np.uint64) >> np.uint64(64 - BITS)
            else:
                own = _smallest(np.frombuffer(text, np.uint8))
        out.append(own)
    return out


def written(sketch: np.ndarray) -> str:
    """FRACTION in decimal, a colon, and the ascending hashes, six bytes each and the highest first, in Base64."""
    return f"{FRACTION}:{base64.b64encode(sketch.astype('>u8').view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()}"


def parsed(text: str) -> np.ndarray:
    scale, _, body = text.partition(":")
    if int(scale) != FRACTION:
        raise ValueError(f"a sketch of another fraction: 1/{scale}")
    raw = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, 6)
    return np.pad(raw, ((0, 0), (2, 0))).reshape(-1).view(">u8").astype(np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents taken as one set of shingles."""
    both = np.union1d(a, b)
    below = int(np.searchsorted(both, LIMIT))
    return both[: below or 1]


def compared(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """(likeness, share of the first that the second contains)."""
    if not len(a) or not len(b):
        same = float(len(a) == len(b))
        return same, same
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both), both / len(a)


def _row(doc_id, text: str, edited: bytes, own: np.ndarray, changed: np.ndarray, following: np.ndarray) -> tuple:
    near_edited, within_edited = compared(own, changed)
    near_next, within_next = compared(own, following)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), written(own), written(changed), near_edited, near_next, within_edited, within_next


def _answer(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 9
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _with_next(batches):
    """Rows of a range arrive in order, the copy of the next range's first row after them."""
    held = None  # the last row, which waits for the one after it
    for batch in batches:
        table = batch.to_pydict()
        rows = list(zip(table["place"], table["doc_id"], table["copy"], (t or "" for t in table["text"]), strict=True))
        for a, b in slices([len(r[3]) for r in rows], 2 << 20):
            some = ([held] if held else []) + rows[a:b]
            held = some[-1]
            pairs = [(i, x, some[i + 1]) for i, x in enumerate(some[:-1]) if not x[2] and x[0] == some[i + 1][0]]
            own = sketch_all([r[3].encode() for r in some])
            edits = []
            for _, x, y in pairs:
                n = len(x[3])
                edits.append((x[3][: n - n // 2] + y[3][: n // 2]).encode())
            yield _answer([_row(x[1], x[3], e, own[i], c, own[i + 1]) for (i, x, _), e, c in zip(pairs, edits, sketch_all(edits), strict=True)])


def _bounds(rows: DataFrame, n: int) -> list[str]:
    """Bounds of about n ranges by (id, text hash): n approximate quantiles of the ids; an id that is several of them, so has
    the rows of several ranges, is cut by text hash.
    """
    found = rows.agg(F.percentile_approx("at", [(i + 1) / n for i in range(n - 1)] or [0.5], 20 * n)).first()[0] if n > 1 else []
    times: dict[int, int] = {}
    for x in found or []:
        times[x] = times.get(x, 0) + 1
    return [sortable_text(x, LOWEST + (j << 64) // m - 1) for x, m in sorted(times.items()) for j in range(1, m + 1)]


def fingerprint_with_next(docs: DataFrame) -> DataFrame:
    """Sketches of each document, of its edited text, and their likeness to it and to the next document.

    One shuffle moves each text once: rows are cut into contiguous ranges (the driver has as many bounds as there are
    ranges), and each range also gets a copy of the row that follows it. The table of these rows' keys is broadcast; it has
    one row for each range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("at", order_key()).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    bounds = _bounds(rows, parts(docs))
    rows = rows.withColumn("place", range_number(sortable(F.col("at"), F.col("h")), bounds).cast("int"))
    firsts = rows.groupBy("place").agg(F.min(F.struct("at", "h")).alias("first")).orderBy("place").select("place", "first.*").collect()
    to = [(r["at"], r["h"], firsts[i - 1]["place"]) for i, r in enumerate(firsts)]
    keys = spark.createDataFrame(to, "at long, h long, before int")
    copies = rows.drop("place").join(F.broadcast(keys), ["at", "h"]).withColumnRenamed("before", "place")
    every = rows.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)))
    dealt = every.repartitionById(len(bounds) + 1, F.col("place")).sortWithinPartitions("place", "copy", "at", "h", "text")
    return dealt.select("place", "doc_id", "copy", "text").mapInArrow(_with_next, SCHEMA)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and sketch of every document, without any shuffle."""

    def each(batches):
        for batch in batches:
            texts = [t.encode() for t in strings(batch.column("text"))]
            for a, b in slices([len(t) for t in texts], 4 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(map(written, sketch_all(texts[a:b])), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, fingerprint string")
