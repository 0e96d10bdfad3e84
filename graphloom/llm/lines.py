"""Line dedup with levelled sorted runs of line hashes.

A run is a table bucketed and sorted by a 128-bit line hash. Batches of documents arrive from the largest ids to the
smallest. A batch's distinct line hashes are dealt and sorted once and merge-anti-joined with the runs, whose scans
are planned with their own order, so a run is neither shuffled nor sorted again: a hash that no run has gets its owner,
the largest id in the batch; a known one only adds its count. The batch's own run goes to level 0, and FANOUT runs of a
level are compacted into one of the next, by merging two at a time (the writer sorts each bucket's merged rows, which
come in order). After the last batch one compaction gives, for each hash, in how many documents it is and who owns it.

The levels are listed in a manifest in the runs' folder, so LineRuns.reopened() can add later batches.

A line's key is the line without blanks at either end and with A-Z lower-cased. Keys of LEAST_CHARS or more code
points in LEAST_DOCS or more documents lose all lines but those of their owner; other lines stay, in order.

Hot lines: counts are added up before each shuffle; the join of all lines with the frequent ones is a plain join of two
scans, which Spark's skew join splits. Documents are named by id and text hash, so rows without an id are no group.

Defined results: null or empty text is one empty line. A row is a document, also where rows repeat; rows without an
id are taken as smaller than any id; rows that share the largest id all keep the line. Texts of any length are
taken whole. The caller's other columns pass through.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import cut, free_name, new_folder, order_key, parts, range_number, read_text, remove, shared_dir, size_hint, sortable, sortable_text, write_text

LEAST_CHARS, LEAST_DOCS, FANOUT, BATCHES = 40, 5, 2, 4
BATCH_BYTES = 256 << 30
_BLANK = " \t\n\x0b\x0c\r"
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_hash(line: str) -> bytes | None:
    """16 bytes for a key that is long enough, else None."""
    key = line.strip(_BLANK)
    if len(key) < LEAST_CHARS:
        return None
    raw = key.encode().translate(_LOWER)
    return xxhash.xxh3_128_digest(raw)


def _long_lines(batches):
    """at, t, h1, h2: the distinct line hashes of each row."""
    for batch in batches:
        ids, found = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = {h for line in (text or "").split("\n") if len(line) >= LEAST_CHARS and (h := line_hash(line))}
            ids += [i] * len(own)
            found += own
        halves = np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2)
        which = pa.array(ids, pa.int64())
        columns = [batch.column("at").take(which), batch.column("t").take(which), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "t", "h1", "h2"])


_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def in_order(spark):
    """Within, scans of sorted buckets of one file each are planned as sorted."""
    before = spark.conf.get(_ORDER)
    spark.conf.set(_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDER, before)


class LineRuns:
    """The levels. `add` takes (h1, h2, n, owner), unique by hash."""

    def __init__(self, spark, buckets: int | None = None, folder: str | None = None):
        self.spark, self.levels = spark, [[]]
        self.buckets = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.folder = folder or new_folder(spark, "line-runs")

    @classmethod
    def reopened(cls, spark, folder: str) -> LineRuns:
        """The runs that an earlier session left in a folder."""
        kept = json.loads(read_text(spark, f"{folder}/manifest.json"))
        self = cls(spark, kept["buckets"], folder)
        self.levels = kept["levels"]
        for name in self.runs():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, n BIGINT, owner BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{folder}/{name}'"
            )
        return self

    def _settle(self) -> None:
        write_text(self.spark, f"{self.folder}/manifest.json", json.dumps({"buckets": self.buckets, "levels": self.levels}))

    def _write(self, dealt: DataFrame) -> str:
        """A run of rows that are dealt by hash, a bucket for each task."""
        name = f"line_run_{uuid.uuid4().hex}"
        rows = dealt.select("h1", "h2", "n", "owner").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        rows.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _hashes(self, name: str) -> DataFrame:
        return self.spark.table(name).select("h1", "h2").hint("merge")

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose hash is in no run."""
        for name in self.runs():
            rows = rows.join(self._hashes(name), ["h1", "h2"], "left_anti")
        return rows

    def marked(self, rows: DataFrame) -> DataFrame:
        """The rows dealt by hash, with an owner only where no run has the hash: the merge-anti-join, which keeps the others too."""
        both, flags = rows.select("h1", "h2", "n", "owner").repartition(self.buckets, "h1", "h2"), []
        for k, name in enumerate(self.runs()):
            flags.append(f"in_{k}")
            both = both.join(self._hashes(name).withColumn(flags[-1], F.lit(True)), ["h1", "h2"], "left")
        owner = F.when(F.coalesce(*flags).isNull(), F.col("owner")) if flags else F.col("owner")
        return both.select("h1", "h2", "n", owner.alias("owner"))

    def add(self, rows: DataFrame) -> None:
        with in_order(self.spark):
            self.levels[0].append(self._write(self.marked(rows)))
        level, done = 0, []
        while len(self.levels[level]) >= FANOUT:
            if level + 1 == len(self.levels):
                self.levels.append([])
            done += self.levels[level]
            self.levels[level + 1].append(self._compact(self.levels[level]))
            self.levels[level] = []
            level += 1
        self._settle()
        for name in done:
            self._drop(name)

    def merged(self, a: str, b: str) -> DataFrame:
        """Two runs as one: counts add up, and at most one of them knows the owner."""
        more = self.spark.table(b).select("h1", "h2", F.col("n").alias("more_n"), F.col("owner").alias("more_owner"))
        n = F.coalesce("n", F.lit(0)) + F.coalesce("more_n", F.lit(0))
        both = self.spark.table(a).join(more.hint("merge"), ["h1", "h2"], "full")
        return both.select("h1", "h2", n.cast("long").alias("n"), F.coalesce("owner", "more_owner").alias("owner"))

    def _compact(self, names: list[str]) -> str:
        """One run from several, merged two at a time."""
        made = names[0]
        with in_order(self.spark):
            for name in names[1:]:
                before, made = made, self._write(self.merged(made, name))
                if before not in names:
                    self._drop(before)
        return made

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.folder}/{name}")

    def compacted(self) -> DataFrame:
        """All hashes with their counts and owners, from one run."""
        names = self.runs()
        if len(names) > 1:
            self.levels = [*([[]] * (len(self.levels) - 1)), [self._compact(names)]]
            self._settle()
            for name in names:
                self._drop(name)
        return self.spark.read.schema("h1 long, h2 long, n long, owner long").parquet(f"{self.folder}/{self.runs()[0]}")

    def close(self, keep: bool = False) -> None:
        """Forgets the tables; without `keep` the runs go too."""
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if not keep:
            remove(self.spark, self.folder)


def _named(docs: DataFrame, at: str, t: str) -> DataFrame:
    """The rows with what names a document: its id (null as the smallest long) and the hash of its text."""
    return docs.withColumns({at: order_key(), t: F.xxhash64(F.col("text").cast("string"))})


def doomed(docs: DataFrame, runs: LineRuns | None = None) -> DataFrame:
    """at, t (what names a document) and the hashes of the lines that it loses. With the runs of earlier documents, their
    lines count and their owners stay.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    rows = _named(docs.select("doc_id", "text"), "at", "t").select("at", "t", F.col("text").cast("string").alias("text"))
    count = max(BATCHES, min(1024, -(-size_hint(docs) // BATCH_BYTES)))
    bounds = docs.agg(F.percentile_approx(order_key(), [i / count for i in range(1, count)], 1000)).first()[0] or []
    bounds = sorted(set(bounds))
    number = range_number(sortable(F.col("at")), [sortable_text(b) for b in bounds])
    folder, own_runs = new_folder(spark, "long-lines"), runs is None
    runs = runs or LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(docs, 64 << 20, largest=2 << 30)))
    try:
        rows.mapInArrow(_long_lines, "at long, t long, h1 long, h2 long").withColumn("batch", number).write.partitionBy("batch").parquet(folder)
        kept = spark.read.schema("at long, t long, h1 long, h2 long, batch int").parquet(folder)
        for batch in range(len(bounds), -1, -1):
            own = kept.where(F.col("batch") == batch)
            runs.add(own.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("at").alias("owner")))
        frequent = runs.compacted().where(F.col("n") >= LEAST_DOCS).select("h1", "h2", "owner")
        return cut(kept.join(frequent, ["h1", "h2"]).where("at <> owner").groupBy("at", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("lost")))
    finally:
        if own_runs:
            runs.close()
        remove(spark, folder)


def _without(lost_name: str, helpers: set[str], counts: tuple[str, str]):
    def each(batches):
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, lost in zip(batch.column("text").to_pylist(), batch.column(lost_name).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if lost:
                    gone = {np.array([x["h1"], x["h2"]], ">i8").tobytes() for x in lost}
                    lines = [line for line in lines if line_hash(line) not in gone]
                    text = "\n".join(lines)
                texts.append(text)
                n_dropped.append(n_lines[-1] - len(lines))
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, "text", pa.array(texts, batch.schema.field(at).type))
            kept = [i for i, n in enumerate(batch.schema.names) if n not in helpers]
            columns = [batch.column(i) for i in kept] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in kept), *counts])

    return each


def counts_of(docs: DataFrame) -> tuple[str, str]:
    """The names that drop_repeated_lines() gives its two counts: n_lines and n_dropped, with underscores behind them where
    the caller has such a column.
    """
    return free_name("n_lines", docs.columns), free_name("n_dropped", docs.columns)


def drop_repeated_lines(docs: DataFrame, runs: LineRuns | None = None) -> DataFrame:
    """The rows with their text without the lines to drop, and the number of lines before and of those dropped."""
    n_lines, n_dropped = counts_of(docs)
    at, t, lost = (free_name(n, docs.columns) for n in ("at", "t", "lost"))
    found = doomed(docs, runs).toDF(at, t, lost)
    both = _named(docs, at, t).join(found, [at, t], "left").select(*[F.col(f"`{c}`") for c in docs.columns], at, t, lost)
    schema = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return both.mapInArrow(_without(lost, {at, t, lost}, (n_lines, n_dropped)), schema)
