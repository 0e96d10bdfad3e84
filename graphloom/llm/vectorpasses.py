"""Near-dedup of embeddings by sorted projection passes.

A pass orders the vectors of a group (equal label, equal dimension) lexicographically by concatenated random hashes; a hash
is the random direction, out of DIRECTIONS and their opposites, that a vector is closest to. Vectors close to each other
choose the same directions, so they come to stand side by side. The order is cut into windows of about WINDOW neighbours, all
pairs of a window are verified by their exact cosine (one matrix product in doubles), and the links of all passes are united.

1. Exact copies are folded into classes (hash of label and vector), which carry their number of copies.
2. One task pass gives every class its keys for all passes. Cells (pass, group, key) are counted; running sums over the sorted
   cells cut the order into windows. A cell is never cut: one of more than WINDOW classes is a window of its own, taken
   apart into blocks of which every two meet, so a dense group is compared as a whole, however large.
3. Two classes are candidates of a pass if they share its window. Every class carries its windows of all passes, so a pair
   that an earlier pass already had is seen on the spot and counted once: no pair leaves a task. A task sends, for each
   of its classes with links, the copies it is linked with and the smallest class of its own group.
4. Groups are closed over all passes by large-star/small-star rounds.

Recall: groups of up to WINDOW classes are compared whole. Beyond, `plan` takes as many hashes as make a cell smaller than a
window, and as many passes as find a pair of exactly the limit's cosine with a chance of RECALL by equal keys alone; closer
pairs and pairs that share a window without sharing a key come on top. So passes grow with the logarithm of the table.

Defined results: a vector that is null, empty, zero or has null or non-finite components, and one without a label, has no
links and is its own component. Vectors of another dimension are another group. Repeated rows are vectors of their own that
are linked with each other. A row without an id counts as a link of others but is no component's id; it is kept where its whole
component has no id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, new_folder
from .simhash import components

LIMIT, WINDOW, DIRECTIONS, RECALL, SEED = 0.93, 2048, 16, 0.95, 13
BROADCAST = 200_000  # rows of 40 bytes and a label


def directions(dim: int, passes: int, hashes: int) -> np.ndarray:
    """Random directions, passes x hashes x DIRECTIONS x dim; the same for every task."""
    return np.random.default_rng([SEED, dim]).standard_normal((passes, hashes, DIRECTIONS, dim))


def keys(unit: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """For each row and pass the chosen directions, five bits each, the first hash highest."""
    out = np.zeros((len(unit), len(planes)), np.int64)
    for p, hashes in enumerate(planes):
        for own in hashes:
            near = unit @ own.T
            best = np.abs(near).argmax(1)
            out[:, p] = (out[:, p] << 5) | (best << 1) | (near[np.arange(len(unit)), best] > 0)
    return out


def chance(limit: float, dim: int, trials: int = 4000) -> float:
    """How often two vectors of exactly the limit's cosine choose one direction, counted over random pairs."""
    rng = np.random.default_rng([SEED, dim, 1])
    a, b = rng.standard_normal((2, trials, max(2, dim)))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    planes = rng.standard_normal((1, 1, DIRECTIONS, max(2, dim)))
    return float((keys(a, planes) == keys(limit * a + math.sqrt(1 - limit * limit) * b, planes)).mean())


def plan(largest: int, limit: float, dim: int, window: int = WINDOW) -> tuple[int, int]:
    """(passes, hashes) for groups of up to `largest` classes."""
    if largest <= window:
        return 1, 1
    hashes = min(12, math.ceil(math.log(largest / window, 2 * DIRECTIONS)))
    missed = 1 - chance(limit, dim) ** hashes
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(missed))), hashes


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row's (vec_id, h1, h2), null hashes where it can have no link; and the distinct (g, dim, h1, h2, v, best, copies)."""
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    width = np.dtype(np.float32 if kind == "float" else np.float64)

    def each(batches):
        for batch in batches:
            label = batch.column("label").to_pylist()
            out = []
            for name, v in zip(label, batch.column("embedding"), strict=True):
                own = v.values.to_numpy(zero_copy_only=False).astype(width) + 0 if name is not None and v.is_valid and not v.values.null_count else None
                if own is None or not np.isfinite(own).all() or not own.any():
                    out.append((None,) * 5)
                    continue
                raw = own.tobytes()
                digest = xxhash.xxh3_128_digest(name.encode() + b"\0" + raw)
                out.append((name, len(own), *np.frombuffer(digest, ">i8").tolist(), raw))
            made = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *made], names=["vec_id", "label", "dim", "h1", "h2", "v"])

    some = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = some.mapInArrow(each, "vec_id long, label string, dim int, h1 long, h2 long, v binary")
    folded = rows.where("h1 is not null").groupBy("h1", "h2", "label", "dim")
    folded = folded.agg(F.min("vec_id").alias("best"), F.count("*").alias("copies"), F.first("v").alias("v"))
    return rows.select("vec_id", "h1", "h2"), folded.withColumn("c", F.monotonically_increasing_id())


def _keyed(classes: DataFrame, passes: int, hashes: int, width: np.dtype) -> DataFrame:
    """(c, label, dim, keys)."""

    def each(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            found = np.zeros((len(dims), passes), np.int64)
            values = batch.column("v").to_pylist()
            for dim in np.unique(dims).tolist():
                at = np.nonzero(dims == dim)[0]
                unit = np.frombuffer(b"".join(values[i] for i in at.tolist()), width).reshape(len(at), dim).astype(np.float64)
                if dim not in planes:
                    planes[dim] = directions(dim, passes, hashes)
                found[at] = keys(unit / np.abs(unit).max(1, keepdims=True), planes[dim])
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * passes), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("label"), batch.column("dim"), flat], names=["c", "label", "dim", "keys"])

    return classes.select("c", "label", "dim", "v").mapInArrow(each, "c long, label string, dim int, keys array<long>")


def _windows(keyed: DataFrame, window: int) -> DataFrame:
    """(c, windows, blocks): for each pass the class's window and in how many blocks that is compared.

    The running sum goes over cells, not classes: a group has at most about 2 * DIRECTIONS cells for each window it fills.
    """
    long = keyed.select("c", "label", "dim", F.posexplode("keys").alias("pass", "key"))
    cells = cut(long.groupBy("pass", "label", "dim", "key").agg(F.count("*").alias("n")))
    upto = Window.partitionBy("pass", "label", "dim").orderBy("key")
    start = F.sum("n").over(upto) - F.col("n")
    own = F.when(F.col("n") > window, -1 - start).otherwise(F.floor(start / window))
    cells = cells.select("pass", "label", "dim", "key", own.cast("long").alias("w"), F.ceil(F.col("n") / window).cast("int").alias("m"))
    cells = cut(cells)
    if cells.count() <= BROADCAST:
        cells = F.broadcast(cells)
    found = long.join(cells, ["pass", "label", "dim", "key"]).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pass", "w", "m"))).alias("all"))
    return found.select("c", F.col("all.w").alias("windows"), F.col("all.m").alias("blocks"))


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the smallest index of its own connected group."""
    n = len(linked)
    label = np.arange(n)
    while True:
        low = np.minimum(label, np.where(linked, label, n).min(1))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verified(limit: float, width: np.dtype):
    """The links of a window, or of two blocks of one."""

    def each(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        this, i, j = key[0].as_py(), key[4].as_py(), key[5].as_py()
        table = table.sort_by("c")
        c, copies, block = (table.column(x).to_numpy() for x in ("c", "copies", "b"))
        unit = np.frombuffer(b"".join(table.column("v").to_pylist()), width).reshape(len(c), -1).astype(np.float64)
        unit /= np.abs(unit).max(1, keepdims=True)
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        linked = unit @ unit.T >= limit
        np.fill_diagonal(linked, False)
        if i != j:  # pairs within one block belong to the block's own task
            linked &= block[:, None] != block[None, :]
        some = np.nonzero(linked.any(1))[0]
        linked, c, copies = linked[np.ix_(some, some)], c[some], copies[some]
        roots = c[_roots(linked)] if len(c) else c
        windows = table.column("windows").combine_chunks().flatten().to_numpy().reshape(len(unit), -1)[some]
        for before in range(this):
            linked &= windows[:, before][:, None] != windows[:, before][None, :]
        return pa.table({"c": c, "root": roots, "n": linked @ copies if len(c) else copies})

    return each


def near_duplicates(vectors: DataFrame, limit: float = LIMIT, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    width = np.dtype(np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64)
    rows, classes = classes_of(vectors)
    folder = new_folder(spark, "vector-classes")
    classes.write.parquet(folder)
    classes = spark.read.parquet(folder)
    largest = classes.groupBy("label", "dim").count().orderBy(F.desc("count")).first()
    passes, hashes = plan(largest["count"], limit, largest["dim"], window) if largest else (1, 1)
    placed = _windows(_keyed(classes, passes, hashes, width), window)
    every = classes.select("c", "label", "dim", "copies", "v").join(placed, "c")
    one = every.select("*", F.posexplode(F.arrays_zip("windows", "blocks")).alias("pass", "at"))
    own = F.pmod(F.xxhash64("c"), F.col("at.blocks")).cast("int")
    one = one.select("pass", "label", "dim", F.col("at.windows").alias("w"), "c", "copies", "v", "windows", own.alias("b"), F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)).alias("o"))
    one = one.withColumns({"i": F.least("b", "o"), "j": F.greatest("b", "o")}).drop("o")
    found = one.groupBy("pass", "label", "dim", "w", "i", "j").applyInArrow(_verified(limit, width), "c long, root long, n long")
    found = cut(found)
    roots = components(found.select(F.col("c").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("c").agg(F.sum("n").alias("n"))
    known = classes.select("c", "h1", "h2", "best", "copies")
    known = known.join(links, "c", "left").join(roots.withColumnRenamed("u", "c"), "c", "left")
    known = cut(known.select("h1", "h2", "best", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "c").alias("root")))
    least = known.groupBy("root").agg(F.min("best").alias("component_id"))
    named = known.join(least, "root").select("h1", "h2", "n_links", "component_id")
    out = rows.join(cut(named), ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
