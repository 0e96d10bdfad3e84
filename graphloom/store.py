"""A graph kept in a folder as a log: a base, and deltas of changed rows and tombstones that a reader merges over it.

What a commit writes is as large as what it changes: a folder of delta rows for each table, then one numbered entry of `log/`
that names the base and all deltas that count. An entry is put in place by a rename that never replaces anything, so of two
writers of one number one fails. The one that fails looks at what the others changed: it raises Conflict if they
touched a row that it changes too, else it puts its deltas on top of theirs. The greatest entry is the state; a crash before its
rename leaves the old state and a folder that nobody names, which vacuum() removes.

A reader takes the newest version of each row that a delta has, and from the base what no delta has: the base is not
shuffled where deltas are small. After MOST deltas save() writes a new base.

Rows are named by their keys (KEYS). Of rows with one key one is kept, rows with a null in their key are not kept. Tables of an
older schema get the columns that they lack. A folder of an earlier format (whole versions and current.json) is read as a base.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators.embed import encoded
from .schema import EDGE_COLUMNS, NODE_COLUMNS, Graph, normalize_nodes, normalized
from .shared import cut, file_system, written_text

EMB_COLUMNS = {"node_id": "string", "vector": "array<double>", "model": "string", "updated_at": "timestamp"}
METRIC_COLUMNS = {"id": "long", "metric_type": "string", "ts": "timestamp", "duration_ms": "double", "metadata": "string"}
TABLES = {"nodes": NODE_COLUMNS, "edges": EDGE_COLUMNS, "emb": EMB_COLUMNS, "metrics": METRIC_COLUMNS}
KEYS = {"nodes": ["id"], "edges": ["parent_id", "child_id"], "emb": ["node_id"], "metrics": ["id"]}
MOST = 16


class Conflict(RuntimeError):
    """Another writer has changed the same rows since they were read."""


@dataclass(frozen=True)
class Entry:
    """A state: the base's folders and the deltas over it, oldest first, each (number, {table: folder})."""

    number: int
    base: dict[str, str] = field(default_factory=dict)
    deltas: list = field(default_factory=list)

    def folders(self) -> set[str]:
        return set(self.base.values()) | {f for _, d in self.deltas for f in d.values()}


def empty(spark: SparkSession) -> Graph:
    made = {name: spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columns.items())) for name, columns in TABLES.items()}
    return Graph(**made)


def _names(spark: SparkSession, path: str) -> list[str]:
    made, store = file_system(spark, path)
    return [x.getPath().getName() for x in store.listStatus(made)] if store.exists(made) else []


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """The entries that there are, the newest first."""
    return sorted((int(n[:-5]) for n in _names(spark, f"{folder}/log") if re.fullmatch(r"\d{20}\.json", n)), reverse=True)


def entry(spark: SparkSession, folder: str, number: int | None = None) -> Entry:
    """The newest entry, or that of a number."""
    found = numbers(spark, folder) if number is None else [number]
    if found and found[0]:
        told = json.loads(spark.read.text(f"{folder}/log/{found[0]:020}.json", wholetext=True).first()[0])
        return Entry(told["number"], told["base"], [(n, d) for n, d in told["deltas"]])
    made, store = file_system(spark, f"{folder}/current.json")
    if store.exists(made):
        name = json.loads(spark.read.text(f"{folder}/current.json", wholetext=True).first()[0])["current"]
        return Entry(0, {t: f"{name}/{t}" for t in _names(spark, f"{folder}/{name}") if t in TABLES})
    return Entry(0)


def put(spark: SparkSession, folder: str, new: Entry) -> bool:
    """Puts an entry in place; False if there is one of its number."""
    draft, final = f"{folder}/log/_draft-{uuid.uuid4().hex}", f"{folder}/log/{new.number:020}.json"
    written_text(spark, draft, json.dumps({"number": new.number, "base": new.base, "deltas": new.deltas}))
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(folder).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_replace = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(context.makeQualified(path(draft)), context.makeQualified(path(final)), never_replace)
    except Exception as failed:
        made, store = file_system(spark, draft)
        store.delete(made, False)
        if number_exists(spark, folder, new.number):
            return False
        raise failed
    return True


def number_exists(spark: SparkSession, folder: str, number: int) -> bool:
    made, store = file_system(spark, f"{folder}/log/{number:020}.json")
    return store.exists(made)


def _delta(spark: SparkSession, folder: str, deltas: list, table: str) -> DataFrame | None:
    """The newest of each key's delta rows, with `_op` (1: gone)."""
    rows = None
    for number, folders in deltas:
        if table in folders:
            some = spark.read.parquet(f"{folder}/{folders[table]}")
            some = normalized(some, TABLES[table] | {"_op": "int"}).withColumn("_seq", F.lit(number))
            rows = some if rows is None else rows.unionByName(some)
    if rows is None:
        return None
    keys = KEYS[table]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "_seq").alias("r"))
    return newest.select(*keys, "r.*").drop("_seq")


def table(spark: SparkSession, folder: str, of: Entry, name: str) -> DataFrame:
    """A table of a state: the base without what deltas have, and what deltas have."""
    columns = TABLES[name]
    base = None
    if name in of.base:
        read = spark.read.parquet(f"{folder}/{of.base[name]}")
        base = normalize_nodes(read) if name == "nodes" else normalized(read, columns)
    over = _delta(spark, folder, of.deltas, name)
    if over is None:
        return base if base is not None else getattr(empty(spark), name)
    fresh = over.where("_op = 0").select(*columns)
    return fresh if base is None else base.join(over.select(*KEYS[name]), KEYS[name], "left_anti").select(*columns).unionByName(fresh)


def load(spark: SparkSession, folder: str, number: int | None = None) -> Graph:
    """The newest state, or that of an entry."""
    of = entry(spark, folder, number)
    return Graph(**{name: table(spark, folder, of, name) for name in TABLES})


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the newest state and the one before."""
    return numbers(spark, folder)[:2]


def commit(spark: SparkSession, folder: str, read: int, changed: dict[str, DataFrame], removed: dict[str, DataFrame] | None = None) -> int:
    """Adds changed rows and takes away keys, on top of the entry that was read; the number of the new state.

    Each table's rows are written once. Raises Conflict if another writer has changed one of these rows since entry `read`.
    """
    name, folders = uuid.uuid4().hex, {}
    for t in TABLES:
        parts = []
        if t in changed:
            parts.append(normalized(changed[t], TABLES[t]).withColumn("_op", F.lit(0)))
        if removed and t in removed:
            parts.append(normalized(removed[t].select(*KEYS[t]), TABLES[t]).withColumn("_op", F.lit(1)))
        if parts:
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            rows = rows.dropna(subset=KEYS[t]).dropDuplicates(KEYS[t])
            folders[t] = f"delta-{name}/{t}"
            rows.write.parquet(f"{folder}/{folders[t]}")
    while True:
        last = entry(spark, folder)
        later = since(spark, folder, read, last)
        for t in folders:
            theirs = _delta(spark, folder, later, t)
            if theirs is not None and theirs.join(spark.read.parquet(f"{folder}/{folders[t]}").select(*KEYS[t]), KEYS[t], "left_semi").take(1):
                raise Conflict(f"{t}: rows were changed since entry {read}")
        if put(spark, folder, Entry(last.number + 1, last.base, [*last.deltas, (last.number + 1, folders)])):
            return last.number + 1


def since(spark: SparkSession, folder: str, read: int, last: Entry) -> list:
    """The deltas of all entries after `read`, those too that a newer base has taken up."""
    if last.number == read:
        return []
    every = numbers(spark, folder)
    if read and read not in every:
        raise Conflict(f"entry {read} is no longer there, so what changed since is not known")
    return sorted({n: d for number in every if number > read for n, d in entry(spark, folder, number).deltas if n > read}.items())


def compact(spark: SparkSession, folder: str) -> int:
    """Folds the deltas into a new base; commits that come meanwhile stay deltas over it."""
    of, name = entry(spark, folder), uuid.uuid4().hex
    base = {}
    for t in TABLES:
        base[t] = f"base-{name}/{t}"
        table(spark, folder, of, t).write.parquet(f"{folder}/{base[t]}")
    folded = {n for n, _ in of.deltas}
    while True:
        last = entry(spark, folder)
        if put(spark, folder, Entry(last.number + 1, base, [(n, d) for n, d in last.deltas if n not in folded])):
            return last.number + 1


def vacuum(spark: SparkSession, folder: str, keep: int = 2, hours: float = 24.0) -> list[str]:
    """Removes what no entry but the newest `keep` names and is older than `hours` (younger folders may belong to a commit under way)."""
    every = numbers(spark, folder)
    used = {f.split("/")[0] for n in every[:keep] or [0] for f in entry(spark, folder, n).folders()}
    before, gone = time.time() * 1000 - hours * 3_600_000, []
    made, store = file_system(spark, folder)
    for x in store.listStatus(made) if store.exists(made) else []:
        name = x.getPath().getName()
        if re.match("(base|delta|v)-", name) and name not in used and x.getModificationTime() <= before:
            store.delete(x.getPath(), True)
            gone.append(name)
    for n in every[keep:]:
        path, _ = file_system(spark, f"{folder}/log/{n:020}.json")
        if store.getFileStatus(path).getModificationTime() <= before:
            store.delete(path, False)
    return gone


def changes(before: DataFrame, after: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows of the second state that are new or different, keys of the first one that are gone): keys and hashes are compared, so
    only what differs is moved with its columns."""
    keys, columns = KEYS[name], list(TABLES[name])
    after = normalized(after, TABLES[name]).dropna(subset=keys).dropDuplicates(keys)
    hashed = lambda df, h: df.select(*keys, F.struct(F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)).alias(h))
    both = hashed(before, "was").join(hashed(after, "now"), keys, "full").where("was IS NULL OR now IS NULL OR was <> now")
    both = cut(both.select(*keys, F.col("now").isNull().alias("gone")))
    return after.join(both.where("not gone").select(*keys), keys, "left_semi"), both.where("gone").select(*keys)


def save(graph: Graph, folder: str, read: int | None = None) -> int:
    """Makes a state the newest one by writing what differs from the entry that was read (the newest one unless given); returns its number."""
    spark = graph.nodes.sparkSession
    of = entry(spark, folder, read)
    given = {t: getattr(graph, t) for t in TABLES if getattr(graph, t) is not None}
    if not of.base and not of.deltas:
        name, base = uuid.uuid4().hex, {}
        for t, rows in given.items():
            base[t] = f"base-{name}/{t}"
            normalized(rows, TABLES[t]).dropna(subset=KEYS[t]).dropDuplicates(KEYS[t]).write.parquet(f"{folder}/{base[t]}")
        if put(spark, folder, Entry(of.number + 1, base)):
            return of.number + 1
        raise Conflict("another writer has made the first state")
    changed, removed = {}, {}
    for t, rows in given.items():
        new, gone = changes(table(spark, folder, of, t), rows, t)
        if new.take(1):
            changed[t] = new
        if gone.take(1):
            removed[t] = gone
    if not changed and not removed:
        return of.number
    number = commit(spark, folder, of.number, changed, removed)
    if len(entry(spark, folder).deltas) >= MOST:
        number = compact(spark, folder)
        vacuum(spark, folder)
    return number


def node(graph: Graph, node_id: str, columns: list[str] | None = None) -> dict | None:
    """One node by its id."""
    rows = graph.nodes.where(F.col("id") == node_id).limit(1)
    row = (rows.select(*columns) if columns else rows).first()
    return row.asDict() if row else None


def tables(graph: Graph) -> dict[str, list[str]]:
    """The tables that there are and their columns."""
    return {t: getattr(graph, t).columns for t in TABLES if getattr(graph, t) is not None}


def sql(graph: Graph, statement: str, **values) -> DataFrame:
    """A statement over the views nodes, edges, emb and metrics, with named values (:name)."""
    spark = graph.nodes.sparkSession
    for t in tables(graph):
        getattr(graph, t).createOrReplaceTempView(t)
    return spark.sql(statement, args=values or None)


def dimensions(graph: Graph) -> DataFrame:
    """(model, dim, n) of the vectors."""
    return graph.emb.where("vector is not null").groupBy("model", F.size("vector").alias("dim")).agg(F.count("*").alias("n"))


def dimension_mismatch(graph: Graph, dim: int) -> dict[int, int]:
    """How many vectors there are of each other number of dimensions; empty if all fit."""
    return {r["dim"]: r["n"] for r in dimensions(graph).where(F.col("dim") != dim).groupBy("dim").agg(F.sum("n").alias("n")).collect()}


def re_encoded(graph: Graph, encoder, model: str, confirm: bool = False) -> Graph:
    """All vectors by another model, once that is confirmed."""
    if not confirm:
        raise ValueError("all vectors would be replaced")
    return graph.with_(emb=encoded(graph.nodes.where("coalesce(decayed, 0) = 0 and trim(content) <> ''"), encoder, model))
