"""Similarity self-joins.

Cosine: vectors are packed into blocks of BLOCK, and blocks into about SIDE sides, which grow with the table as far as MOST_BYTES allows. Each
pair of sides is one group (a tile), in which every pair of blocks is one matrix product that is reduced (pairs, best, count, the k lowest
scores, links enough for the same components) before anything leaves the worker. So the shuffle has about SIDE copies of a vector, whatever
the table's size, and a worker holds two sides. Joins with a least cosine put vectors into blocks by where they lie and leave out pairs of
blocks that are too far apart for it, up to MOST_BLOCKS blocks; vectors without any structure still all meet. Vectors of another dimension,
with NaN or infinite values or without a norm take no part.

Jaccard: equal word sets are folded into one class first; then prefix filtering over words ordered from rare to
frequent with length and position filters, then the exact test.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import word_set
from ..functions.vector import cosine, sound
from ..schema import Graph, live
from ..shared import cut
from .ordered import exact_quantiles, numbered
from .vector_index import assigned, clustered

BLOCK, ROWS, MOST_BLOCKS = 4096, 512, 2048
SIDE, MOST_BYTES, MOST_LINKS = 8, 1 << 26, 1 << 22
FREQUENT, LOOKED_UP, NARROW, WIDE = 1 << 18, 200_000, 8, 32
PAIRS = "a string, b string, sim double"


def _kind(rows: DataFrame) -> str:
    """The type that vectors move as: floats, if none loses anything by it."""
    return "double" if rows.where(F.exists("vector", lambda x: x.cast("double") != x.cast("float").cast("double"))).take(1) else "float"


def _packed(emb: DataFrame, name: str, n: int, labels: tuple[str, ...] = (), kind: str = "double") -> DataFrame:
    placed = emb.select("node_id", F.col("vector").cast(f"array<{kind}>").alias("vector"), *labels).withColumn(name, F.pmod(F.xxhash64("node_id"), F.lit(n)))
    return placed.groupBy(name).agg(F.collect_list("node_id").alias("ids"), F.flatten(F.collect_list("vector")).alias("flat"), *[F.collect_list(c).alias(c) for c in labels])


def _kept(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    """A row's list as an array of its own, which doesn't hold the batch."""
    part = _part(batch, name, row)
    return part.take(pa.array(np.arange(len(part))))


def _part(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    """A row's list as an array, without a copy."""
    column = batch.column(name)
    return column.values.slice(column.offsets[row].as_py(), column.offsets[row + 1].as_py() - column.offsets[row].as_py())


def _unit(batch: pa.RecordBatch, name: str, row: int, n: int) -> np.ndarray:
    m = _part(batch, name, row).to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Block(NamedTuple):
    """A block's vectors, normed; `near`: the blocks that it can have pairs with, None for all."""

    k: int
    left: bool
    ids: pa.Array
    unit: np.ndarray
    labels: dict[str, pa.Array]
    near: frozenset | None


def _read(batches: Iterator[pa.RecordBatch], labels: tuple[str, ...] = ()) -> list[Block]:
    """The blocks of a tile, by number."""
    out = []
    for batch in batches:
        for r in range(batch.num_rows):
            ids = _kept(batch, "ids", r)
            near = batch.column("near")[r].as_py()
            own = {c: _kept(batch, c, r) for c in labels}
            out.append(Block(batch.column("k")[r].as_py(), batch.column("left")[r].as_py(), ids, _unit(batch, "flat", r, len(ids)), own, None if near is None else frozenset(near)))
    return sorted(out, key=lambda b: b.k)


def _strips(a: Block, b: Block) -> Iterator[tuple[int, np.ndarray]]:
    """The products of some rows of one block with all of the other: a strip has as many cells as ROWS rows of a whole block."""
    rows = max(1, ROWS * BLOCK // max(BLOCK, len(b.ids)))
    return ((at, a.unit[at : at + rows] @ b.unit.T) for at in range(0, len(a.ids), rows))


def _upper(sims: np.ndarray, at: int, same: bool) -> np.ndarray | bool:
    """Which cells stand for a pair: of a block with itself those above the diagonal."""
    return np.arange(sims.shape[1])[None, :] > np.arange(at, at + len(sims))[:, None] if same else True


def _couples(blocks: list[Block], same: bool) -> Iterator[tuple[Block, Block]]:
    """The pairs of blocks that a tile stands for: of one side all, a block with itself too, else those across."""
    for x, a in enumerate(blocks):
        for b in blocks[x:]:
            if (same or a.left != b.left) and (a.near is None or b.k in a.near):
                yield a, b


def _each(f: Callable[[Block, Block], Iterator[pa.RecordBatch]], labels: tuple[str, ...] = ()):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _couples(_read(batches, labels), key[0].as_py() == key[1].as_py()):
            yield from f(a, b)

    return run


def _across(f: Callable[[Block, Block], Iterator[pa.RecordBatch]]):
    """Each block of the left table with all that the tile has of the right one, ids of which come in descending order."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _read(batches)
        rights = [b for b in blocks if not b.left]
        blocks = [b for b in blocks if b.left]
        if blocks and rights:
            ids, unit = pa.concat_arrays([b.ids for b in rights]), np.concatenate([b.unit for b in rights])
            rights.clear()
            place = pc.array_sort_indices(ids, order="descending").to_numpy().astype(np.int64)
            other = Block(0, False, ids.take(pa.array(place)), unit[place], {}, None)
            del unit
            for a in blocks:
                yield from f(a, other)

    return run


def _without_own(a: Block, b: Block) -> Callable[[int, np.ndarray], None]:
    """Takes a row's own id out of the cosines of a strip."""
    both = pa.concat_arrays([a.ids, b.ids]).dictionary_encode().indices.to_numpy()
    mine, others = both[: len(a.ids)], both[len(a.ids) :]
    order = np.argsort(others, kind="stable")
    first, end = (np.searchsorted(others[order], mine, side) for side in ("left", "right"))

    def clear(at: int, sims: np.ndarray) -> None:
        low, high = first[at : at + len(sims)], end[at : at + len(sims)]
        while (some := np.nonzero(low < high)[0]).size:
            sims[some, order[low[some]]] = -2.0
            low = low + 1

    return clear


def _ordered(x: pa.Array, y: pa.Array, sim: np.ndarray) -> pa.RecordBatch:
    first = pc.less(x, y)
    return pa.RecordBatch.from_arrays([pc.if_else(first, x, y).cast(pa.string()), pc.if_else(first, y, x).cast(pa.string()), pa.array(sim)], names=["a", "b", "sim"])


def _codes(a: Block, b: Block, label: str) -> tuple[np.ndarray, np.ndarray, list]:
    """The values of a label in both blocks as numbers, and what these stand for."""
    both = pa.concat_arrays([a.labels[label], b.labels[label]]).dictionary_encode()
    codes = both.indices.to_numpy()
    return codes[: len(a.ids)], codes[len(a.ids) :], both.dictionary.to_pylist()


def _pairs(least: float, below: float, apart: str | None):
    def one(a, b):
        if apart:
            x, y, names = _codes(a, b, apart)
            named = np.array([n != "" for n in names])
        for at, sims in _strips(a, b):
            i, j = np.nonzero((sims >= least) & (sims < below) & _upper(sims, at, a is b))
            if apart:
                some = (x[at + i] != y[j]) | ~named[x[at + i]]
                i, j = i[some], j[some]
            if len(i):
                yield _ordered(a.ids.take(pa.array(at + i)), b.ids.take(pa.array(j)), sims[i, j])

    return _each(one, (apart,) if apart else ())


def _number(least: float):
    """How many pairs of two blocks are over `least`."""

    def one(a, b):
        n = sum(int(((sims > least) & _upper(sims, at, a is b)).sum()) for at, sims in _strips(a, b))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return _each(one)


def _united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The labels (each row's smallest known one of its group) after the groups of linked rows have become one."""
    while True:
        x, y = label[i], label[j]
        some = x != y
        if not some.any():
            return label
        i, j, x, y = i[some], j[some], x[some], y[some]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def _forest(least: float):
    """Of each group that a tile's links make, a link of every row to the first."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _read(batches)
        ids = pa.concat_arrays([b.ids for b in blocks])
        starts = np.cumsum([0, *[len(b.ids) for b in blocks]])
        place = {(b.k, b.left): int(s) for b, s in zip(blocks, starts)}
        label = np.arange(len(ids))
        for a, b in _couples(blocks, key[0].as_py() == key[1].as_py()):
            for at, sims in _strips(a, b):
                i, j = np.nonzero((sims >= least) & _upper(sims, at, a is b))
                label = _united(label, place[a.k, a.left] + at + i, place[b.k, b.left] + j)
        rows = np.nonzero(label != np.arange(len(label)))[0]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(label[rows])).cast(pa.string()), ids.take(pa.array(rows)).cast(pa.string())], names=["a", "b"])

    return run


def _neighbours(least: float):
    """(v, ws): of each row of a tile, whose ids are numbers, the rows that it is linked with there, in lists of bounded size."""

    def made(ends):
        v, w = np.concatenate(ends), np.concatenate([ends[i ^ 1] for i in range(len(ends))])
        order = np.argsort(v, kind="stable")
        v, at = np.unique(v[order], return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(w)).astype(np.int32)), pa.array(w[order]))
        return pa.RecordBatch.from_arrays([pa.array(v), lists], names=["v", "ws"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _read(batches)
        numbers = {(b.k, b.left): b.ids.cast(pa.int32()).to_numpy() for b in blocks}
        ends, n = [], 0
        for a, b in _couples(blocks, key[0].as_py() == key[1].as_py()):
            for at, sims in _strips(a, b):
                i, j = np.nonzero((sims >= least) & _upper(sims, at, a is b))
                ends += [numbers[a.k, a.left][at + i], numbers[b.k, b.left][j]]
                n += len(i)
                if n > MOST_LINKS:
                    yield made(ends)
                    ends, n = [], 0
        if n:
            yield made(ends)

    return run


def _best(least: float, others: bool):
    """Of each row of the left block the largest cosine, if it is at least `least`; of equal ones the last id. `others`: not its own."""

    def one(a, b):
        clear = _without_own(a, b) if others else None
        for at, sims in _strips(a, b):
            if clear:
                clear(at, sims)
            k = sims.argmax(1)
            sim = sims[np.arange(len(k)), k]
            some = np.nonzero(sim >= least)[0]
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(at + some)).cast(pa.string()), b.ids.take(pa.array(k[some])).cast(pa.string()), pa.array(sim[some])], names=["a", "b", "sim"])

    return _across(one)


def _lowest(low: float, high: float, k: int, bonus: float):
    """The pairs with the k lowest scores in the band, and those that equal the last of them."""

    def one(a, b):
        codes = [_codes(a, b, label)[:2] for label in ("kind", "domain")]
        for at, sims in _strips(a, b):
            score = -np.abs(sims - 0.5)
            for x, y in codes:
                score = score + bonus * (x[at : at + len(sims), None] != y[None, :])
            score[~((sims >= low) & (sims <= high) & _upper(sims, at, a is b))] = np.inf
            found = np.isfinite(score).sum()
            if found:
                last = np.partition(score, min(k, found) - 1, axis=None)[min(k, found) - 1]
                i, j = np.nonzero(score <= last + 1e-6)
                pairs = _ordered(a.ids.take(pa.array(at + i)), b.ids.take(pa.array(j)), sims[i, j])
                yield pa.RecordBatch.from_arrays([*pairs.columns, pa.array(score[i, j])], names=["a", "b", "sim", "score"])

    return _each(one, ("kind", "domain"))


def _size(rows: DataFrame, block: int) -> tuple[int, int]:
    """How many blocks a table makes, and how many vectors of its dimension fit in MOST_BYTES."""
    r = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    return max(1, math.ceil(r["n"] / block)), max(1, MOST_BYTES // (8 * max(1, r["dim"] or 1) * block))


def _side(n: int, most: int) -> int:
    """How many of n blocks one side of a tile has."""
    return max(1, min(math.ceil(n / SIDE), most))


def _met(left: DataFrame, right: DataFrame, block: int, reduce, schema: str) -> DataFrame:
    """Every block of one side with every block of the other."""
    (n, most), (m, _) = _size(left, block), _size(right, block)
    p, q = _side(n, most), _side(m, most)
    sides = lambda n, p: F.sequence(F.lit(0).cast("long"), F.lit(-(-n // p) - 1).cast("long"))
    near = F.lit(None).cast("array<long>").alias("near")
    one = _packed(left, "k", n).select(F.floor(F.col("k") / p).alias("i"), F.explode(sides(m, q)).alias("j"), "k", F.lit(True).alias("left"), "ids", "flat", near)
    two = _packed(right, "k", m).select(F.explode(sides(n, p)).alias("i"), F.floor(F.col("k") / q).alias("j"), "k", F.lit(False).alias("left"), "ids", "flat", near)
    return one.unionByName(two).groupBy("i", "j").applyInArrow(reduce, schema)


def _met_once(rows: DataFrame, block: int, reduce, schema: str, labels: tuple[str, ...] = (), least: float = -2.0, narrow: bool = False) -> DataFrame:
    """Every unordered pair of blocks of a table, a block with itself too, but those that can have no cosine of at least `least`. `narrow`: vectors move as floats where
    these are exact."""
    rows = cut(rows)
    kind = _kind(rows) if narrow else "double"
    n, most = _size(rows, block)
    if n == 1 or n > MOST_BLOCKS or least <= -1:
        side = _side(n, most)
        packed = _packed(rows, "k", n, labels, kind).withColumn("near", F.lit(None).cast("array<long>"))
        others = F.sequence(F.lit(0).cast("long"), F.lit(-(-n // side) - 1).cast("long"))
    else:
        packed, balls = near_blocks(rows, n, block, labels, kind)
        met = may_meet(balls, least)
        side = _side(len(balls), most)
        partners = [(k, row, sorted({j // side for j in row})) for k, row in met.items()]
        packed = packed.join(F.broadcast(packed.sparkSession.createDataFrame(partners, "k long, near array<long>, others array<long>")), "k")
        others = F.col("others")
    tiles = packed.withColumn("own", F.floor(F.col("k") / side)).withColumn("other", F.explode(others))
    tiles = tiles.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "k", (F.col("own") <= F.col("other")).alias("left"), "ids", "flat", "near", *labels)
    return tiles.groupBy("i", "j").applyInArrow(reduce, schema)


def near_blocks(rows: DataFrame, n: int, block: int, labels: tuple[str, ...] = (), kind: str = "double") -> tuple[DataFrame, dict[int, tuple[np.ndarray, float]]]:
    """Blocks of vectors that lie near each other, and for each the unit vector of its middle and the largest angle to it.

    About n cells around centres of a bounded sample; a cell of more than `block` vectors is several blocks. The driver has one
    row for each block.
    """
    draw = F.pmod(F.xxhash64("node_id", F.lit(3)), F.lit(n * block))
    vectors = rows.select("node_id", F.col("vector").cast("array<double>").alias("vector"))
    some = vectors.where(draw < 32 * n).select("vector").limit(min(64 * n, 1 << 15)).toArrow()
    some = some if some.num_rows else vectors.select("vector").limit(1).toArrow()
    sample = some.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
    centres = clustered(sample / np.linalg.norm(sample, axis=1, keepdims=True), min(n, len(sample)))
    placed = assigned(rows, centres)
    if labels:  # they are joined again; an id that is there twice may lie in either cell
        placed = rows.join(placed.groupBy("node_id").agg(F.min("cell").alias("cell")), "node_id")
    placed = cut(placed)
    first, plan = 0, []
    for r in sorted(placed.groupBy("cell").count().collect()):
        m = -(-r["count"] // block)
        plan.append((r["cell"], first, m))
        first += m
    sizes = F.broadcast(rows.sparkSession.createDataFrame(plan, "cell int, first long, m long"))
    placed = placed.join(sizes, "cell").withColumn("k", F.col("first") + F.pmod(F.xxhash64("node_id"), F.col("m")))
    lists = [F.collect_list("node_id").alias("ids"), F.flatten(F.collect_list("vector")).alias("flat"), *[F.collect_list(c).alias(c) for c in labels]]
    packed = cut(placed.select("k", "node_id", F.col("vector").cast(f"array<{kind}>").alias("vector"), *labels).groupBy("k").agg(*lists))

    def ball(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                m = _unit(batch, "flat", r, len(_part(batch, "ids", r)))
                middle = m.mean(0)
                middle = middle / max(float(np.linalg.norm(middle)), 1e-300)
                angle = float(np.arccos(np.clip(m @ middle, -1, 1)).max())
                yield pa.RecordBatch.from_arrays([batch.column("k").slice(r, 1), pa.array([middle.tolist()]), pa.array([angle])], names=["k", "middle", "angle"])

    found = packed.select("k", "ids", "flat").mapInArrow(ball, "k long, middle array<double>, angle double").collect()
    return packed, {r["k"]: (np.array(r["middle"]), r["angle"]) for r in found}


def may_meet(balls: dict[int, tuple[np.ndarray, float]], least: float) -> dict[int, list[int]]:
    """For each block those that can have a pair of that cosine: by the triangle inequality of angles, two vectors are no nearer than their
    middles less both radii."""
    names = sorted(balls)
    middles, radii = np.array([balls[k][0] for k in names]), np.array([balls[k][1] for k in names])
    apart = np.arccos(np.clip(middles @ middles.T, -1, 1)) - radii[:, None] - radii[None, :]
    near = apart <= math.acos(min(1.0, least)) + 1e-6
    np.fill_diagonal(near, True)
    return {k: [names[j] for j in np.nonzero(near[i])[0].tolist()] for i, k in enumerate(names)}


def best_at_least(left: DataFrame, right: DataFrame, least: float, dim: int | None = None, others: bool = False, block: int = BLOCK) -> DataFrame:
    """(a, b, sim): each left row's best row of the right side, of equal ones the last id, if its cosine is at least `least`."""
    near = _met(sound(left, dim), sound(right, dim), block, _best(least, others), PAIRS)
    return near.groupBy("a").agg(F.max(F.struct("sim", "b")).alias("m")).select("a", "m.b", "m.sim")


def _top(least: float, k: int):
    """Of each row of the left block the k largest cosines of at least `least` to rows with another id; of equal ones all."""

    def one(a, b):
        clear = _without_own(a, b)
        for at, sims in _strips(a, b):
            clear(at, sims)
            m = min(k, sims.shape[1])
            last = np.partition(sims, -m, axis=1)[:, -m]
            i, j = np.nonzero((sims >= last[:, None] - 1e-12) & (sims >= least))
            yield pa.RecordBatch.from_arrays([a.ids.take(pa.array(at + i)).cast(pa.string()), b.ids.take(pa.array(j)).cast(pa.string()), pa.array(sims[i, j])], names=["a", "b", "sim"])

    return _across(one)


def top_each(left: DataFrame, right: DataFrame, k: int, least: float, dim: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b, sim): each left row's k best other rows of the right side with at least that cosine, of equal ones the smaller ids."""
    near = _met(sound(left, dim), sound(right, dim), block, _top(least, k), PAIRS)
    return near.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("r") <= k).drop("r")


def cosine_pairs(emb: DataFrame, least: float, below: float = 2.0, dim: int | None = None, block: int = BLOCK, apart: str | None = None) -> DataFrame:
    """Each unordered pair (a < b) with least <= cosine < below. `apart` names a column of strings: two rows with the same one, if it is not
    empty, make no pair."""
    columns = ["node_id", "vector", *([F.coalesce(apart, F.lit("")).alias(apart)] if apart else [])]
    return _met_once(sound(emb, dim).select(*columns), block, _pairs(least, below, apart), PAIRS, (apart,) if apart else (), least)


def link_forest(emb: DataFrame, least: float, dim: int | None = None, block: int = BLOCK) -> DataFrame:
    """(a, b): links with the same components as all pairs of at least that cosine, for each row no more than it is in tiles."""
    return _met_once(sound(emb, dim).select("node_id", "vector"), block, _forest(least), "a string, b string", least=least)


def link_lists(emb: DataFrame, least: float, dim: int | None = None, block: int = BLOCK) -> DataFrame:
    """(v, ws): for rows whose node_id is a number (as a string), the numbers of those that have at least that cosine, for each row a list or more a tile."""
    return _met_once(sound(emb, dim).select("node_id", "vector"), block, _neighbours(least), "v int, ws array<int>", least=least, narrow=True)


def pair_count(emb: DataFrame, least: float, dim: int | None = None, block: int = BLOCK) -> DataFrame:
    """(n): the number of pairs with a cosine over `least`."""
    return _met_once(sound(emb, dim).select("node_id", "vector"), block, _number(least), "n long", least=least).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def banded(pairs: DataFrame, cross_link: float, dedup: float) -> DataFrame:
    """Pairs with what is to be done with them: link or merge."""
    return pairs.withColumn("action", F.when(F.col("sim") >= dedup, "merge").when(F.col("sim") >= cross_link, "link")).where("action is not null")


def live_vectors(graph: Graph) -> DataFrame:
    return graph.emb.join(live(graph.nodes), F.col("node_id") == F.col("id"), "left_semi").select("node_id", "vector")


def tension_pairs(graph: Graph, low: float = 0.30, high: float = 0.70, k: int = 10, block: int = BLOCK) -> DataFrame:
    """Pairs of moderate similarity, lowest score first; another type or domain adds to the score."""
    n = live(graph.nodes).select("id", F.col("node_type").alias("kind"), F.coalesce(F.get_json_object("metadata", "$.domain"), F.lit("unknown")).alias("domain"))
    rows = sound(graph.emb).join(n, F.col("node_id") == F.col("id")).select("node_id", "vector", F.coalesce("kind", F.lit("")).alias("kind"), "domain")
    found = _met_once(rows, block, _lowest(low, high, k, 0.05), f"{PAIRS}, score double", ("kind", "domain"), low)
    return found.select("a", "b", F.round("sim", 6).alias("sim"), F.round("score", 6).alias("score")).orderBy("score", "a", "b").limit(k)


def _looked_up(ids: DataFrame) -> DataFrame:
    """Ids that are broadcast if they are few."""
    return F.broadcast(ids) if ids.count() <= LOOKED_UP else ids


def _word_sets(docs: DataFrame) -> DataFrame:
    """(id, words, k1, k2): the words as ascending hashes, and what names the set; rows without words are left out."""
    words = F.sort_array(F.transform(word_set("content"), lambda w: F.xxhash64(w)))
    sets = cut(docs.select("id", words.alias("words")))  # written once: a filter on the words would find them twice
    return sets.where(F.size("words") > 0).withColumns({"k1": F.xxhash64("words"), "k2": F.xxhash64(F.lit(1), "words")})


def word_classes(docs: DataFrame) -> DataFrame:
    """(id, class): rows with equal word sets are in one class, named by its smallest id; rows without words are in none."""
    named = _word_sets(docs).select("id", "k1", "k2")
    least = cut(named.groupBy("k1", "k2").agg(F.min("id").alias("class")))
    return named.join(least, ["k1", "k2"]).select("id", "class")


def _signed(least: float, order: Broadcast):
    """(id, n, prefix, short, long) of (id, words): the rarest words, of which two sets that are that alike share one, and signatures of 512 and 2,048 bits.

    Words are ordered by their place among the frequent ones, all others come before, by hash. A bit of a signature is 1 if an odd number
    of words falls on it, so two sets differ in at least as many words as their signatures in bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = order.value
        for batch in batches:
            lists = batch.column("words")
            ends = lists.offsets.to_numpy()
            flat, n = lists.values.to_numpy()[ends[0] : ends[-1]], np.diff(ends)
            row = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                rank = np.where(known[at] == flat, place[at] + 1, 0)
            by = np.lexsort((flat, rank, row))
            first = np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], n)
            size = n - np.ceil(n * least - 1e-9).astype(np.int64) + 1
            prefix = flat[by][first < np.repeat(size, n)]
            bits = np.zeros((len(n), 64 * WIDE), np.uint8)
            np.bitwise_xor.at(bits, (row, (flat.view(np.uint64) >> np.uint64(64 - 11)).astype(np.int64)), 1)
            folded = np.bitwise_xor.reduce(bits.reshape(len(n), 64 * NARROW, -1), axis=2)
            starts = pa.array(np.concatenate([[0], np.cumsum(np.minimum(size, n))]).astype(np.int32))
            signs = [pa.FixedSizeListArray.from_arrays(pa.array(np.packbits(x, axis=1).view(np.int64).reshape(-1)), w).cast(pa.list_(pa.int64())) for x, w in ((folded, NARROW), (bits, WIDE))]
            columns = [batch.column("id"), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(starts, pa.array(prefix)), *signs]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "prefix", "short", "long"])

    return run


def jaccard_pairs(docs: DataFrame, least: float) -> DataFrame:
    """(a, b, sim) for a < b, of (id, content): the classes of word_classes() whose word sets are that alike. Exact.

    A class is its smallest id; its copies are not expanded. Words are 64-bit hashes. Any order of words will do for the prefixes, so that only of the
    FREQUENT most frequent words is known to the tasks. Two sets that meet at a word are dropped there if their sizes or signatures
    differ by too much, then if longer signatures do; the few that are left are compared. A word of very many prefixes makes a hot key of a plain join of two scans, which Spark's
    skew join splits.
    """
    spark = docs.sparkSession
    sets = _word_sets(docs)
    reps = cut(sets.groupBy("k1", "k2").agg(F.min("id").alias("id")).select("id"))
    sets = cut(sets.select("id", "words").join(_looked_up(reps), "id", "left_semi"))
    often = sets.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df")).where("df > 1")
    often = often.orderBy(F.desc("df"), "word").limit(FREQUENT).select("word").toArrow().column("word").to_numpy()
    by = np.argsort(often)
    order = spark.sparkContext.broadcast((often[by], (len(often) - by).astype(np.int64)))
    signed = cut(sets.mapInArrow(_signed(least, order), f"id {docs.schema['id'].dataType.simpleString()}, n int, prefix array<long>, short array<long>, long array<long>"))
    parts = [f"s{i}" for i in range(NARROW)]
    keys = signed.select("id", "n", F.explode("prefix").alias("word"), *[F.col("short")[i].alias(c) for i, c in enumerate(parts)])
    a, b = (keys.select("word", *[F.col(c).alias(f"{c}{side}") for c in ("id", "n", *parts)]) for side in "ab")
    size = F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9
    differ = lambda x, y: sum((F.bit_count(p.bitwiseXOR(q)) for p, q in zip(x[1:], y[1:], strict=True)), F.bit_count(x[0].bitwiseXOR(y[0])))
    most = (F.col("na") + F.col("nb")) * ((1 - least) / (1 + least)) + 1e-9  # words that are in one alone, of two sets that are that alike
    found = a.join(b, "word").where((F.col("ida") < F.col("idb")) & size & (differ([F.col(f"{c}a") for c in parts], [F.col(f"{c}b") for c in parts]) <= most))
    found = cut(found.select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct())
    for end in ("a", "b"):
        found = found.join(signed.select(F.col("id").alias(end), F.col("n").alias(f"n{end}"), F.col("long").alias(f"l{end}")), end)
    found = cut(found.where(differ([F.col("la")[i] for i in range(WIDE)], [F.col("lb")[i] for i in range(WIDE)]) <= most).select("a", "b"))
    wanted = cut(found.select(F.col("a").alias("id")).union(found.select("b")).distinct())
    full = cut(sets.join(_looked_up(wanted), "id", "left_semi"))
    both = found.join(full.toDF("a", "wa"), "a").join(full.toDF("b", "wb"), "b")
    common = F.size(F.array_intersect("wa", "wb"))
    return both.select("a", "b", (common / (F.size("wa") + F.size("wb") - common)).alias("sim")).where(F.col("sim") >= least)


def drawn_pairs(numbered_rows: DataFrame, n: int, pairs: int, seed: str) -> DataFrame:
    """(sim) of pairs of two different rows (k from 1 to n, vector): both ends are drawn from all rows by a hash of the pair's number."""
    end = lambda side: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{side}:"), F.col("id").cast("string"))), 1, 15), 16, 10).cast("long") % n
    some = numbered_rows.sparkSession.range(pairs).select("id", (end("a") + 1).alias("a"), (end("b") + 1).alias("b"))
    some = some.withColumn("b", F.when(F.col("a") == F.col("b"), F.col("b") % n + 1).otherwise(F.col("b")))
    one, two = (numbered_rows.select(F.col("k").alias(c), F.col("vector").alias(f"v{c}")) for c in "ab")
    return some.join(one, "a").join(two, "b").select(cosine("va", "vb").alias("sim"))


def calibration(emb: DataFrame, pairs: int | None = 40_000, queries: int | None = None, seed: str = "0", dim: int | None = None) -> DataFrame:
    """One row: exact quantiles of the cosines of `pairs` pairs drawn from all nodes (of all pairs if there are no more, or with None) and of the largest cosine of
    each node to another (of the first `queries` nodes by a seeded hash, if that is given); and the thresholds that follow.
    Without two sound vectors the quantiles are null.
    """
    order = [F.md5(F.concat(F.lit(seed), "node_id")), F.col("node_id")]
    rows = cut(numbered(sound(emb, dim).select("node_id", "vector"), *order))
    n = rows.count()
    asked = rows if queries is None else rows.where(F.col("k") <= queries)
    if n < 2:
        unrelated = rows.select(F.lit(None).cast("double").alias("sim")).limit(0)
    else:
        unrelated = cosine_pairs(rows, -2.0, dim=dim).select("sim") if pairs is None or n * (n - 1) // 2 <= pairs else drawn_pairs(rows, n, pairs, seed)
    unrelated = cut(unrelated)
    nearest = cut(best_at_least(asked, rows, -1.5, dim, True).select("sim"))
    about = unrelated.agg(F.count("*").alias("pairs"), F.round(F.avg("sim"), 3).alias("mean"))
    told = dict(zip(("p50", "p95", "p99"), exact_quantiles(unrelated, "sim", [0.5, 0.95, 0.99]), strict=True))
    told |= dict(zip(("nn_p25", "nn_p50", "nn_p90", "nn_p99"), exact_quantiles(nearest, "sim", [0.25, 0.5, 0.9, 0.99]), strict=True))
    row = about.select("pairs", "mean", *[F.round(F.lit(x).cast("double"), 3).alias(c) for c, x in told.items()])
    cross = F.greatest(F.round(F.col("p99") + 0.03, 2), F.round(F.col("p95") + 0.05, 2))
    row = row.withColumn("cross_link", cross).withColumn("dedup", F.round(F.col("cross_link") + 0.04, 2))
    return row.withColumn("novelty", F.round(F.greatest(F.col("dedup") + 0.01, F.col("nn_p50") + 0.03), 2))
