"""SimHash near-dedup with pigeonring filtering.

A fingerprint has 64 bits; the SEGMENTS segments of a ring of 13, 13, 13, 13 and 12 bits share a budget of LIMIT
differing bits. If two fingerprints differ in at most LIMIT bits, some segment starts a chain whose first l
segments differ in at most l * LIMIT / SEGMENTS bits for every l: 0, 1, 2, 3, 4. So fingerprints are put into
buckets by a segment and the next one with one bit masked out (64 keys of about 25 bits each), which holds the
first two links of the chain; the longer links prune the pairs of a bucket before the full Hamming check.

A bucket never sends out all its pairs: it sends each fingerprint linked to the smallest one of its own group. A
bucket of more than BLOCK fingerprints is taken apart into blocks of that many, and each pair of blocks meets in a task of
its own, so that no bucket must fit into one task; the same filter judges every pair. Groups are then closed over all
buckets by large-star/small-star rounds. Exact copies are folded first, so a hot group counts once. The tables that
rows are joined with are written before, so that Spark's skew join can split a hot key.

Defined results: null, empty or blank text has fingerprint 0 and is linked like any other. Rows without an id
take part, but a component's id is the smallest id that is not null (null if no row of it has one). Other columns are
ignored, and pass through representatives().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import cut, free_name, strings

LIMIT, SEGMENTS, WORDS, SEED = 4, 5, 4, 42
OFFSETS, WIDTHS = (0, 13, 26, 39, 52), (13, 13, 13, 13, 12)
BUDGETS = [step * LIMIT // SEGMENTS for step in range(1, SEGMENTS + 1)]
SMALL, BLOCK = 48, 1 << 14
BROADCAST = 100_000  # rows of 16 bytes
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str) -> int:
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= WORDS:
        hashes = digest(joined, SEED)
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - WORDS].tolist(), ends[WORDS - 1 :].tolist(), strict=True)])
    rows = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 16):
        ones += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, the columns `also` (longs) and fp (the 64 bits as a signed long) of every row. No shuffle."""
    names = ["doc_id", *also]

    def each(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in strings(batch.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(found.view(np.int64))], names=[*names, "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *also, F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, ", ".join(f"{n} long" for n in [*names, "fp"]))


def _keys() -> F.Column:
    """The bucket keys of a fingerprint: number of the masked bit, segment, next segment without that bit."""
    segment = [F.shiftrightunsigned("fp", o).bitwiseAND((1 << w) - 1) for o, w in zip(OFFSETS, WIDTHS, strict=True)]
    keys, tag = [], 0
    for i in range(SEGMENTS):
        then = (i + 1) % SEGMENTS
        for bit in range(WIDTHS[then]):
            rest = segment[then].bitwiseAND(((1 << WIDTHS[then]) - 1) ^ (1 << bit))
            keys.append(F.lit((tag << 32)).cast("long") + F.shiftleft(segment[i], 13) + rest)
            tag += 1
    return F.array(*keys)


_STARTS = np.repeat(np.arange(SEGMENTS), [WIDTHS[(i + 1) % SEGMENTS] for i in range(SEGMENTS)])


def chained(differing: np.ndarray, start: int) -> np.ndarray:
    """Where the chain from `start` keeps every budget: each link is looked at only where the links before it held."""
    at, total = np.arange(len(differing)), np.zeros(len(differing), np.uint8)
    for step, budget in enumerate(BUDGETS):
        k = (start + step) % SEGMENTS
        total = total + np.bitwise_count(differing & np.uint64(((1 << WIDTHS[k]) - 1) << OFFSETS[k]))
        some = total <= budget
        at, total, differing = at[some], total[some], differing[some]
    return at


def _near(differing: np.ndarray, start: int) -> np.ndarray:
    """Where a chain holds and the full Hamming check agrees."""
    at = chained(differing, start)
    return at[np.bitwise_count(differing[at]) <= LIMIT]


def _joined(label: np.ndarray, i: int, near: np.ndarray) -> None:
    own = np.unique(label[near])
    label[i] = own[0]
    if len(own) > 1:
        label[:i][np.isin(label[:i], own)] = own[0]


def groups(fps: np.ndarray, start: int) -> np.ndarray:
    """For each of the sorted distinct fingerprints of a bucket, the index of the first one of its group."""
    n = len(fps)
    label = np.arange(n)
    if n <= SMALL:  # all pairs at once
        b, a = np.tril_indices(n, -1)
        near = _near(fps[a] ^ fps[b], start)
        own = b[near]
        for i in np.unique(own).tolist():
            _joined(label, i, a[near[own == i]])
    else:
        for i in range(1, n):
            near = _near(fps[:i] ^ fps[i], start)
            if len(near):
                _joined(label, i, near)
    return label


def _sent(u, v, key=0, block=-1):
    n = len(u)
    columns = [u, v, np.full(n, key, np.int64), np.full(n, block, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c).view(np.int64)) for c in columns], names=["u", "v", "key", "block"])


def _runs(keys: np.ndarray, fps: np.ndarray):
    """The links of whole buckets."""
    edge = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))[0]
    sizes = np.diff(edge)
    at = edge[:-1][sizes == 2]
    x, start = fps[at] ^ fps[at + 1], _STARTS[keys[at] >> 32]
    out = []
    for s in range(SEGMENTS):
        own = at[start == s]
        own = own[_near(x[start == s], s)]
        out.append((fps[own + 1], fps[own]))
    for i in np.nonzero(sizes > 2)[0]:
        some = fps[edge[i] : edge[i + 1]]
        first = groups(some, int(_STARTS[keys[edge[i]] >> 32]))
        moved = first != np.arange(len(some))
        out.append((some[moved], some[first[moved]]))
    return _sent(*(np.concatenate(c) for c in zip(*out, strict=True)))


def _columns(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _links(most: int):
    """Rows come sorted by key and fingerprint; a run is a bucket. Links have block -1; the blocks of a bucket of more than
    `most` are sent with their fingerprints as u. What is held is one block and a batch.
    """

    def each(batches):
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        apart, block = None, 0  # the key of the bucket that is being taken apart, its next block
        for batch in batches:
            k, f = _columns(batch, "key", "fp")
            keys, fps = np.concatenate([held_k, k]), np.concatenate([held_f, f.view(np.uint64)])
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if last and apart == keys[0]:
                first = int(np.searchsorted(keys, keys[0], "right"))
                yield _sent(fps[:first], fps[:first], apart, block)
                keys, fps, last, apart = keys[first:], fps[first:], last - first, None
            if last:
                yield _runs(keys[:last], fps[:last])
            held_k, held_f = keys[last:], fps[last:]
            while len(held_f) > most:
                if apart != held_k[0]:
                    apart, block = int(held_k[0]), 0
                yield _sent(held_f[:most], held_f[:most], apart, block)
                block, held_k, held_f = block + 1, held_k[most:], held_f[most:]
        if len(held_k):
            yield _sent(held_f, held_f, apart, block) if apart == held_k[0] else _runs(held_k, held_f)

    return each


def _block_links(batches):
    """Rows come sorted by key, the two blocks i and j, and fingerprint; at most 2 * BLOCK fingerprints share these."""
    held: list[np.ndarray] = []

    def met(some):
        keys, i, j, fps = (np.concatenate(c) for c in zip(*some, strict=True))
        edge = np.nonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))[0].tolist()
        return keys, fps.view(np.uint64), [*edge, len(keys)], some

    def linked(keys, fps, edges):
        for a, b in zip(edges, edges[1:]):
            first = groups(fps[a:b], int(_STARTS[keys[a] >> 32]))
            moved = first != np.arange(b - a)
            yield _sent(fps[a:b][moved], fps[a:b][first[moved]])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(_columns(batch, "key", "i", "j", "fp"))
        keys, fps, edges, some = met(held)
        yield from linked(keys, fps, edges[:-1])
        held = [[np.concatenate(c)[edges[-2] :] for c in zip(*some, strict=True)]]
    if held:
        keys, fps, edges, _ = met(held)
        yield from linked(keys, fps, edges)


_LINKS = "u long, v long, key long, block long"


def links(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints in one group of a bucket; their closure joins all within LIMIT bits."""
    # 64 keys of 16 bytes for each fingerprint: about 128 MB in a task
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), classes.count() >> 17)
    keyed = classes.select("fp", F.explode(_keys()).alias("key")).repartition(n, "key").sortWithinPartitions("key", "fp")
    found = cut(keyed.select("key", "fp").mapInArrow(_links(block), _LINKS))
    pairs, apart = found.where("block < 0").select("u", "v"), found.where("block >= 0").select("key", "block", F.col("u").alias("fp"))
    if apart.take(1):
        sizes = cut(apart.groupBy("key").agg((F.max("block") + 1).alias("n")))
        met = apart.join(sizes, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        met = met.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
        dealt = met.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
        pairs = pairs.unionByName(dealt.mapInArrow(_block_links, _LINKS).select("u", "v"))
    return pairs.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every end u of an edge but the roots: large-star and small-star rounds until nothing moves."""
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select("u", F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())


def _placed(fps: DataFrame, best) -> DataFrame:
    """(fp, root, best, copies) of every fingerprint: the least value of `best` and the number of rows of its whole component."""
    classes = cut(fps.groupBy("fp").agg(F.min(best).alias("best"), F.count("*").alias("copies")))
    roots = components(links(classes))
    placed = cut(classes.join(roots, classes["fp"] == roots["u"], "left").select("fp", "best", "copies", F.coalesce("root", "fp").alias("root")))
    least = cut(placed.groupBy("root").agg(F.min("best").alias("best"), F.sum("copies").alias("copies")))
    return placed.select("fp", "root").join(least, "root").select("fp", "root", "best", "copies")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    fps = cut(fingerprints(docs))
    named = cut(_placed(fps, F.col("doc_id")))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row, with all its columns, of each component: that of the smallest id that is not null, of equal ids that of the
    smallest hash of the whole row. Where no row of a component has an id, the hash alone decides. Of rows that are
    equal in all columns (columns of maps aside) one stays.

    Rows are named by a 128-bit hash of their columns. Only the names of those that go are joined with the texts, by
    broadcast where they are at most BROADCAST; so texts move only where more than that go.
    """
    names = [f.name for f in docs.schema.fields if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    k1, k2 = (free_name(k, docs.columns) for k in ("k1", "k2"))
    columns = [F.col(f"`{n}`") for n in names]
    rows = docs.withColumns({k1: F.xxhash64(*columns), k2: F.xxhash64(F.lit(1), *columns)})
    fps = cut(fingerprints(rows, k1, k2))
    named = _placed(fps, F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", F.col(k1).alias("x"), F.col(k2).alias("y")))
    several = cut(named.where("copies > 1").select("fp", "best.x", "best.y"))
    met = cut(fps.join(several, "fp").select(k1, k2, ((F.col(k1) == F.col("x")) & (F.col(k2) == F.col("y"))).alias("best")))
    again = cut(met.where("best").groupBy(k1, k2).agg(F.count("*").alias("n")).where("n > 1").select(k1, k2))
    gone = cut(met.where("not best").select(k1, k2).distinct().unionByName(again))
    out = rows.join(_small(gone), [k1, k2], "left_anti")
    if again.take(1):
        out = out.unionByName(rows.join(_small(again), [k1, k2], "left_semi").dropDuplicates([k1, k2]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(BROADCAST + 1).count() <= BROADCAST else keys
