"""What the operators of this folder share: the shared folder, lineage cuts, batches and slices."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOWEST = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where that is unset, a local session (tests) gets a temporary one and a cluster an error:
    a folder on one machine would lose what executors elsewhere write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, kept in the shared folder and without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder through Hadoop's file system, so any store will do."""
    path, store = _file_system(spark, folder)
    store.delete(path, True)


def _file_system(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a short text into a file, in place of what was there."""
    made, store = _file_system(spark, path)
    out = store.create(made, True)
    try:
        out.write(text.encode())
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def make_folder(spark: SparkSession, path: str) -> str:
    made, store = _file_system(spark, path)
    store.mkdirs(made)
    return path


def files_of(spark: SparkSession, folder: str, ending: str) -> DataFrame:
    """(path, bytes) of a folder's files with an ending. Spark's own reader lists them; their contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ending}").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; Hadoop's names for S3 mean the same store as s3."""
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def dealt_evenly(rows: DataFrame, total_bytes: int, target: int = 64 << 20) -> DataFrame:
    """Rows that each stand for bytes to be read, one by one over tasks of about `target` bytes; never fewer than the shuffle partitions."""
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // target)))


def size_hint(df: DataFrame) -> int:
    """Bytes that the optimizer expects, from file sizes; no job runs. 0 where it knows nothing."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 0


def parts(df: DataFrame, target: int = 8 << 20, many: int = 8192, largest: int = 512 << 20) -> int:
    """Partitions of about `target` stored bytes; never fewer than half the shuffle partitions.
    Past `many` of them partitions grow, but to no more than `largest` bytes.
    """
    least, size = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2), size_hint(df)
    return int(max(least, min(-(-size // target), max(many, -(-size // largest)))))


def free_name(wanted: str, taken) -> str:
    """The name, with underscores behind it as long as a column has it (in any case)."""
    own = {t.lower() for t in taken}
    while wanted.lower() in own:
        wanted += "_"
    return wanted


def sortable(*columns) -> Column:
    """Longs as one string of fixed width that sorts as they do."""
    return F.concat(*[F.lpad(F.hex(c.bitwiseXOR(F.lit(LOWEST))), 16, "0") for c in columns])


def sortable_text(*values: int) -> str:
    return "".join(f"{v - LOWEST:016X}" for v in values)


def range_number(key: Column, bounds: list[str]) -> Column:
    """How many of the ascending bounds lie below the key: found in two steps, each over about sqrt(len(bounds)) of them."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    listed = lambda some: F.split(F.lit(",".join(some)), ",")
    below = lambda some: F.size(F.filter(some, lambda b: b < key))
    if len(bounds) <= step:
        return below(listed(bounds))
    coarse = below(listed(bounds[step - 1 :: step]))
    return coarse * step + below(F.slice(listed(bounds), coarse * step + 1, F.lit(step)))


def strings(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def slices(sizes, most: int):
    """Consecutive index ranges whose sizes add up to about `most`; a longer item is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (its two multipliers are fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def order_key(column: str = "doc_id"):
    """An id as a sort key; null comes first."""
    return F.coalesce(F.col(column).cast("long"), F.lit(LOWEST))
