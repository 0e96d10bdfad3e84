"""Sharding by extendible hashing, with DataFrame operations only.

A row's address is a string of bits: 60 bits of the MD5 of its id, then 60 bits of the MD5 of its row number, which
part rows that share an id. The directory starts as one bucket; only a bucket over the byte limit is split on its
next bit. ROUND bits are settled at a time: one partly aggregated sum for each address prefix of that length, then
the sums of all shorter prefixes from those, and each prefix takes the shortest one that fits. Only rows below
prefixes that still do not fit go to the next round. The directory stays a table.

Defined results: null text has 0 bytes, a null id is hashed as "null"; a row that is larger than the limit by itself
gets a shard of its own; repeated rows are separate rows; an empty table has no shards. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .common import cut, free_name

LIMIT, ROUND, BITS = 16 << 20, 8, 60
ROW = "shard_row_number"


def _bits(column) -> F.Column:
    return F.lpad(F.conv(F.substring(F.md5(column.cast("string")), 1, BITS // 4), 16, 2), BITS, "0")


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, shard (the address bits of its bucket), depth, shard_docs, shard_bytes."""
    return _assigned(docs.withColumn(ROW, F.monotonically_increasing_id()), ROW, limit).drop("row")


def _assigned(docs: DataFrame, row: str, limit: int) -> DataFrame:
    """What assign() gives, and each row's number."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"), F.col(row).alias("row"))
    left = cut(rows.select("row", "doc_id", "n_bytes", F.concat(_bits(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), _bits(F.col("row"))).alias("bits")))
    done = []
    for base in range(0, 2 * BITS, ROUND):
        end = min(base + ROUND, 2 * BITS)
        keyed = left.withColumn("cell", F.substring("bits", 1, end))
        cells = cut(keyed.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")))
        every = cells.select("cell", "bytes", "docs", F.explode(F.sequence(F.lit(base), F.lit(end))).alias("depth"))
        every = every.withColumn("shard", F.col("cell").substr(F.lit(1), F.col("depth")))
        fits = every.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
        fits = fits.where((F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1) | (F.col("depth") == 2 * BITS))
        leaf = every.join(fits, ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes", "shard_docs")).alias("leaf"))
        leaf = cut(leaf)
        done.append(keyed.join(leaf, "cell").select("row", "doc_id", "n_bytes", "leaf.shard", "leaf.depth", "leaf.shard_docs", "leaf.shard_bytes"))
        over = cells.join(leaf, "cell", "left_anti").select("cell")
        if not over.take(1):
            break
        left = cut(keyed.join(over, "cell", "left_semi").drop("cell"))
    return reduce(DataFrame.unionByName, done)


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> DataFrame:
    """Writes every row with all its columns below `folder`, one directory for each shard, and returns the assignment.

    The rows are numbered and written once to the shared folder, so that both the assignment and the copy see the same
    numbers; rows without an id and rows that share one are told apart by them. The directories are named shard=b...,
    with underscores behind `shard` where the caller has such a column.
    """
    row, shard = free_name(ROW, docs.columns), free_name("shard", docs.columns)
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    placed = cut(_assigned(numbered, row, limit))
    names = placed.select(F.col("row").alias(row), F.concat(F.lit("b"), "shard").alias(shard))
    numbered.join(names, row).drop(row).repartition(shard).write.partitionBy(shard).parquet(folder)
    return placed.drop("row")
