"""An inverted-file index over embeddings: vectors lie in cells by their nearest centre, a search looks into a few cells and ranks
what is there by the exact cosine.

Centres are fitted by spherical k-means on a bounded sample (at most SAMPLE vectors and VALUES numbers, those of the smallest id hashes); every
sound vector is indexed, partitioned by cell, so a search reads only the folders of the cells that it probes. How many
that are is measured: `fit` takes the fewest that find RECALL of the true neighbours within its own sample. Probing all
cells is the exact search.

A batch of queries is dealt to (cell, block of its queries, block of its vectors); each is one matrix product that
sends the k best of every query, so no task holds a whole cell and no pair leaves a task but those.

Defined results: vectors that are null, of another dimension, not finite or zero are not indexed and find nothing; a query with the id
of an indexed vector does not find that vector. An index of no vectors has no cells and finds nothing.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.vector import cosine, literal, sound, usual_dim
from ..schema import Graph, live
from ..shared import cut, file_system, written_text

SAMPLE, VALUES, RECALL, ROUNDS, ASKED, BLOCK = 1 << 16, 1 << 22, 0.95, 8, 256, 4096
STRIP = 1 << 22  # cosines that are held at once while fitting
ROWS = "node_id string, vector array<double>, cell int"


@dataclass(frozen=True)
class Index:
    folder: str
    dim: int
    probes: int
    centres: np.ndarray  # cells x dim, of norm 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(ROWS).parquet(f"{self.folder}/rows")


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _nearest_centres(unit: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the nearest centre, cosine to it) of each row, strip by strip."""
    own, near = np.zeros(len(unit), np.int64), np.zeros(len(unit))
    step = max(1, STRIP // len(centres))
    for at in range(0, len(unit), step):
        sims = unit[at : at + step] @ centres.T
        own[at : at + step], near[at : at + step] = sims.argmax(1), sims.max(1)
    return own, near


def clustered(unit: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 0) -> np.ndarray:
    """Centres of norm 1 by spherical k-means; an empty cell takes the vector that is farthest from its own centre."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), cells, replace=False)]
    for _ in range(rounds):
        own, near = _nearest_centres(unit, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        empty = np.nonzero(np.bincount(own, minlength=cells) == 0)[0]
        if len(empty):
            sums[empty] = unit[near.argsort()[: len(empty)]]
        centres = _unit(sums)
    return centres


def fewest_probes(unit: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells that hold this share of the k nearest of about ASKED of the vectors."""
    k = min(k, len(unit) - 1)
    if k < 1:
        return 1
    cell, _ = _nearest_centres(unit, centres)
    asked = np.arange(0, len(unit), max(1, len(unit) // ASKED))
    needed, step = [], max(1, STRIP // len(unit))
    for at in range(0, len(asked), step):
        some = asked[at : at + step]
        near = unit[some] @ unit.T
        near[np.arange(len(some)), some] = -2.0
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        place = (-(unit[some] @ centres.T)).argsort(1).argsort(1)  # of each cell in the query's order
        needed.append(np.take_along_axis(place, cell[best], 1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def fit(emb: DataFrame, cells: int | None = None, k: int = 10, recall: float = RECALL, most: int = SAMPLE, dim: int | None = None) -> tuple[np.ndarray, int, int]:
    """(centres, dim, probes) from at most `most` vectors; about sqrt(n) cells, each with 16 of the sample at least."""
    dim = usual_dim(emb) if dim is None else dim
    rows = sound(emb, dim).select("node_id", "vector")
    n, most = rows.count(), min(most, max(1, VALUES // max(dim, 1)))
    share = min(1.0, 1.05 * most / max(n, 1))
    draw = F.pmod(F.xxhash64("node_id"), F.lit(1 << 30))
    some = rows.where(draw < int(share * (1 << 30))).select(draw.alias("draw"), "node_id", F.col("vector").cast("array<double>").alias("vector")).orderBy("draw", "node_id").limit(most)
    some = some.select("vector").toArrow()
    if not some.num_rows:
        return np.zeros((0, dim)), dim, 0
    unit = _matrix(some.column("vector"), dim)
    cells = max(1, min(cells or math.isqrt(n), max(1, len(unit) // 16)))
    centres = clustered(unit, cells)
    return centres, unit.shape[1], fewest_probes(unit, centres, k, recall)


def assigned(emb: DataFrame, centres: np.ndarray) -> DataFrame:
    """(node_id, vector, cell) of the sound vectors, in one pass."""
    dim = centres.shape[1]

    def each(batches):
        for batch in batches:
            cell = (_matrix(batch.column("vector"), dim) @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("node_id"), batch.column("vector"), pa.array(cell.astype(np.int32))], names=["node_id", "vector", "cell"])

    return sound(emb, dim).select("node_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(each, ROWS)


def _placed(rows: DataFrame):
    """A cell's rows come together in files of bounded size: a large cell is several of them."""
    return rows.hint("rebalance", "cell").write.partitionBy("cell")


def build(emb: DataFrame, folder: str, **how) -> Index:
    """Fits and writes an index in a new folder."""
    centres, dim, probes = fit(emb, **how)
    if len(centres):
        _placed(assigned(emb, centres)).mode("errorifexists").parquet(f"{folder}/rows")
    written_text(emb.sparkSession, f"{folder}/index.json", json.dumps({"dim": dim, "probes": probes, "centres": centres.tolist()}))
    return Index(folder, dim, probes, centres)


def opened(spark: SparkSession, folder: str) -> Index:
    told = json.loads(spark.read.text(f"{folder}/index.json", wholetext=True).first()[0])
    return Index(folder, told["dim"], told["probes"], np.array(told["centres"]).reshape(-1, told["dim"]) if told["dim"] else np.zeros((0, 0)))


def backfill(index: Index, emb: DataFrame) -> int:
    """Adds what is not indexed yet and moves what has another vector now; how many rows that were.

    Only the folders of the cells that are touched are written: new rows are appended, cells that lose a row are replaced.
    """
    spark = emb.sparkSession
    if not len(index.centres):
        return 0
    old = index.rows(spark).select("node_id", F.xxhash64("vector").alias("was"), F.col("cell").alias("from"))
    now = sound(emb, index.dim).select("node_id", F.col("vector").cast("array<double>").alias("vector"))
    fresh = now.join(old, "node_id", "left").where(F.col("was").isNull() | (F.col("was") != F.xxhash64("vector")))
    fresh = cut(assigned(fresh, index.centres).join(old.select("node_id", "from"), "node_id", "left"))
    n = fresh.count()
    if not n:
        return 0
    cells = [r[0] for r in fresh.where("`from` is not null").select("from").distinct().collect()]  # at most as many as there are cells
    if cells:
        kept = index.rows(spark).where(F.col("cell").isin(cells)).join(fresh.select("node_id"), "node_id", "left_anti")
        kept = cut(kept.select("node_id", "vector", "cell"))
        gone = set(cells) - {r[0] for r in kept.select("cell").distinct().collect()}
        _placed(kept).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{index.folder}/rows")
        for cell in gone:  # nothing is left in it
            path, store = file_system(spark, f"{index.folder}/rows/cell={cell}")
            store.delete(path, True)
    _placed(fresh.select("node_id", "vector", "cell")).mode("append").parquet(f"{index.folder}/rows")
    return n


def cells_of(index: Index, query: list[float], probes: int | None = None) -> list[int]:
    """The cells whose centres are nearest to a query; all of them with probes=0."""
    order = (-(index.centres @ np.array(query, np.float64))).argsort(kind="stable")
    return order[: (index.probes if probes is None else probes) or None].tolist()


def top_k(index: Index, graph: Graph, query: list[float], k: int, probes: int | None = None, include_decayed: bool = False) -> DataFrame:
    """(node_id, sim): the live nodes nearest to a query, from the folders of a few cells; the cosine is exact."""
    rows = index.rows(graph.nodes.sparkSession)
    if len(index.centres) and len(query) == index.dim:
        rows = rows.where(F.col("cell").isin(cells_of(index, query, probes)))
    else:
        rows = rows.limit(0)
    if not include_decayed:
        rows = rows.join(live(graph.nodes), F.col("node_id") == F.col("id"), "left_semi")
    return rows.select("node_id", cosine(F.col("vector"), literal(query)).alias("sim")).orderBy(F.desc("sim"), "node_id").limit(k)


def _probed(index: Index, probes: int):
    def each(batches):
        for batch in batches:
            near = _matrix(batch.column("vector"), index.dim) @ index.centres.T
            m = min(probes or near.shape[1], near.shape[1])
            best = (-near).argsort(axis=1, kind="stable")[:, :m].astype(np.int32)
            which = pa.array(np.repeat(np.arange(len(near)), m))
            yield pa.RecordBatch.from_arrays([batch.column("node_id").take(which), batch.column("vector").take(which), pa.array(best.reshape(-1))], names=["node_id", "vector", "cell"])

    return each


def _nearest(k: int, dim: int):
    """The k best of each query among a block's vectors; of equal ones those of the smaller ids."""

    def each(key: tuple[pa.Scalar, ...], asked: pa.Table, rows: pa.Table) -> pa.Table:
        if not asked.num_rows or not rows.num_rows:
            return pa.table({"q": pa.array([], pa.string()), "node_id": pa.array([], pa.string()), "sim": pa.array([], pa.float64())})
        rows = rows.sort_by("node_id")
        q, ids = asked.column("q").to_pylist(), rows.column("node_id").to_pylist()
        sims = _matrix(asked.column("vector"), dim) @ _matrix(rows.column("vector"), dim).T
        at = {x: i for i, x in enumerate(ids)}
        for i, x in enumerate(q):
            if x in at:
                sims[i, at[x]] = -2.0
        best = (-sims).argsort(axis=1, kind="stable")[:, :k]
        sim = np.take_along_axis(sims, best, 1)
        i, j = np.nonzero(sim > -1.5)
        return pa.table({"q": pa.array([q[x] for x in i.tolist()], pa.string()), "node_id": pa.array([ids[x] for x in best[i, j].tolist()], pa.string()), "sim": pa.array(sim[i, j])})

    return each


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None, block: int = BLOCK) -> DataFrame:
    """(q, node_id, sim): the k nearest indexed vectors of each query (node_id, vector), by exact cosine; probes=0 looks into all cells."""
    spark = queries.sparkSession
    if not len(index.centres):
        return spark.createDataFrame([], "q string, node_id string, sim double")
    asked = sound(queries, index.dim).select("node_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = cut(asked.mapInArrow(_probed(index, index.probes if probes is None else probes), ROWS).withColumnRenamed("node_id", "q"))
    rows = index.rows(spark)
    size = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    sizes = F.broadcast(cut(size(asked, "nq").join(size(rows, "nv"), "cell")))  # a row for each cell
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    one = asked.join(sizes, "cell").select("cell", own("q", "nq").alias("i"), blocks("nv").alias("j"), "q", "vector")
    two = rows.join(sizes, "cell").select("cell", blocks("nq").alias("i"), own("node_id", "nv").alias("j"), "node_id", "vector")
    keys = ["cell", "i", "j"]
    found = one.groupBy(*keys).cogroup(two.groupBy(*keys)).applyInArrow(_nearest(k, index.dim), "q string, node_id string, sim double")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "node_id")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true (q, node_id) that was found."""
    row = true.select("q", "node_id").join(found.select("q", "node_id", F.lit(1).alias("hit")), ["q", "node_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0
