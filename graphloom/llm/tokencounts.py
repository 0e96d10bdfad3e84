"""Token counts of flat token files by a separator scan.

A file is nothing but token identifiers (little-endian, of 16 bits if the vocabulary has no larger one, else of 32); a document
ends with the end-of-document identifier, the vocabulary's own. Files are read in blocks of BLOCK bytes, each its own row for the executors, made from the files' sizes there. In a block, one vectorised
comparison finds all separators; documents between two of them are counted at once. What a block has before its
first and after its last separator is stitched by a prefix scan over the blocks of a file: separators before a
block give its documents their numbers, and the tokens since the last separator are added to the first one.

Defined results: an empty text is a document of 0 tokens; an empty file has no documents; tokens after the last
separator of a file are a last document that has not ended. Null texts are written as empty; other columns are
ignored; repeated rows are documents of their own. A document that the scan does not find is an error, not a lost row.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .bpe import codec
from .common import cut, dealt_evenly, files_of, make_folder, new_folder, opened, remove, slices, strings

EOD, BLOCK = 50256, 4 << 20  # the end of the vocabulary that the tests use
#: Names of end-of-document tokens.
ENDS = ("<|endoftext|>", "<|end_of_text|>", "</s>", "<eos>", "[SEP]")


def separator(tokenizer: str) -> tuple[int, int]:
    """The end-of-document identifier of a tokenizer file, and how many bytes its identifiers need: 2 or 4. An error if it names no end."""
    with open(tokenizer, encoding="utf-8") as f:
        told = json.load(f)
    vocab = told["model"]["vocab"]
    ids = dict(vocab) if isinstance(vocab, dict) else {x[0]: i for i, x in enumerate(vocab)}
    ids |= {t["content"]: t["id"] for t in told.get("added_tokens", [])}
    ends = [ids[name] for name in ENDS if name in ids]
    if not ends:
        raise ValueError(f"{tokenizer} names no end-of-document token")
    largest = max(ids.values())
    if largest >= 1 << 32:
        raise ValueError(f"identifiers up to {largest} don't fit 32 bits")
    return ends[0], 2 if largest < 1 << 16 else 4


def settle(store: fs.FileSystem, draft: str, final: str) -> None:
    """Gives a whole file its name, unless another attempt of the same task was first."""
    if store.get_file_info(final).type == fs.FileType.NotFound:
        store.move(draft, final)
    else:
        store.delete_file(draft)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, eod: int | None = None, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Each task writes one flat file. Returns (file, ordinal, doc_id) of every document and (file, path, bytes) of every file.

    A file gets its name only when it is whole, and a task that runs again writes the same bytes to the same name. An identifier that
    the width can't hold is an error.
    """
    own_end, own_width = separator(tokenizer)
    eod, width = own_end if eod is None else eod, own_width if width is None else width

    def each(batches):
        own, task = codec(tokenizer), TaskContext.get()
        store, path = opened(folder)
        store.create_dir(path)
        part = task.partitionId()
        final, draft = f"{path}/part-{part:06d}.tok", f"{path}/_draft-{part}-{task.taskAttemptId()}-{os.getpid()}"
        n, end, size = 0, np.array([eod], "<u4").tobytes(), 0

        def told(ordinals, ids, sizes):
            k = len(ordinals)
            columns = [pa.array(np.full(k, part, np.int64)), pa.array(ordinals, pa.int64()), ids, sizes]
            return pa.RecordBatch.from_arrays(columns, names=["file", "ordinal", "doc_id", "bytes"])

        with store.open_output_stream(draft) as out:
            for batch in batches:
                texts = strings(batch.column("text"))
                for a, b in slices([len(t) for t in texts], 1 << 20):
                    ids = own.encode(texts[a:b], special=False)
                    whole = np.frombuffer(end.join([*ids, b""]), "<u4")
                    if width == 2 and len(whole) and whole.max() >= 1 << 16:
                        raise ValueError(f"identifier {whole.max()} doesn't fit 16 bits")
                    data = whole.astype(f"<u{width}").tobytes()
                    out.write(data)
                    size += len(data)
                    yield told(np.arange(n, n + b - a), batch.column("doc_id")[a:b], pa.nulls(b - a, pa.int64()))
                    n += b - a
        settle(store, draft, final)
        yield told([None], pa.nulls(1, pa.int64()), pa.array([size], pa.int64()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = cut(rows.mapInArrow(each, "file long, ordinal long, doc_id long, bytes long"))
    files = found.where("bytes is not null").select("file", F.concat(F.lit(f"{folder}/part-"), F.lpad(F.col("file").cast("string"), 6, "0"), F.lit(".tok")).alias("path"), "bytes")
    return found.where("bytes is null").select("file", "ordinal", "doc_id"), files


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, path, bytes) of a folder's token files; a file's number is in its name."""
    return files_of(spark, folder, ".tok").select(F.regexp_extract("path", r"(\d+)\.tok$", 1).cast("long").alias("file"), "path", "bytes")


def blocks(files: DataFrame, size: int = BLOCK) -> DataFrame:
    """(path, file, block, at, bytes) for every block of every file, made and dealt out where the rows are."""
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    last = F.floor((F.col("bytes") - 1) / size).cast("long")
    each = files.where("bytes > 0").select("path", "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    at = F.col("block") * size
    return dealt_evenly(each.select("path", "file", "block", at.alias("at"), F.least(F.lit(size).cast("long"), F.col("bytes") - at).alias("bytes")), total)


def _scan(eod: int, width: int):
    """kind 0: document inside a block; 1: first to end in a block; 2: the block's separators (k) and last tokens (n)."""

    def each(batches):
        for batch in batches:
            for r in batch.to_pylist():
                store, path = opened(r["path"])
                with store.open_input_file(path) as f:
                    f.seek(r["at"])
                    tokens = np.frombuffer(f.read(r["bytes"]), f"<u{width}")
                ends = np.nonzero(tokens == eod)[0]
                sizes = np.diff(ends, prepend=-1) - 1
                tail = len(tokens) - (int(ends[-1]) + 1 if len(ends) else 0)
                n = len(ends)
                kind = np.zeros(n + 1, np.int32)
                kind[0] = 1
                kind[n] = 2
                columns = [np.full(n + 1, r["file"]), np.full(n + 1, r["block"]), kind, np.arange(n + 1), np.append(sizes, tail)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "block", "kind", "k", "n"])

    return each


def count_tokens(files: DataFrame, eod: int = EOD, size: int = BLOCK, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, ended) of every document of token files (file, path, bytes) with identifiers of `width` bytes."""
    found = blocks(files, max(width, size - size % width)).mapInArrow(_scan(eod, width), "file long, block long, kind int, k long, n long")
    found = cut(found)
    line = Window.partitionBy("file").orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    sums = found.where("kind = 2").withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0))).withColumn("total", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.withColumn("reset", F.coalesce(F.max(F.when(F.col("k") > 0, F.col("total"))).over(before), F.lit(0)))
    sums = sums.withColumn("open", F.col("total") - F.col("reset")).withColumn("last", F.lead("block").over(line).isNull())
    stitched = sums.select("file", "block", "base", "open")
    docs = found.where("kind < 2").join(stitched, ["file", "block"])
    docs = docs.select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("n") + F.when(F.col("kind") == 1, F.col("open")).otherwise(0)).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = F.col("n") + F.when(F.col("k") == 0, F.col("open")).otherwise(0)
    unended = sums.where(F.col("last") & (rest > 0)).select("file", (F.col("base") + F.col("k")).alias("ordinal"), rest.alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.unionByName(unended)


def documents_token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the texts as flat token files, scans those and gives each document its count."""
    spark = docs.sparkSession
    folder = make_folder(spark, new_folder(spark, "tokens"))
    try:
        eod, width = separator(tokenizer)
        names, files = write_tokens(docs, folder, tokenizer, eod, width)
        counts = cut(count_tokens(files, eod, width=width))
    finally:
        remove(spark, folder)
    lost = F.raise_error(F.concat(F.lit("no tokens found of document "), F.col("ordinal"), F.lit(" of file "), F.col("file"))).cast("long")
    return names.join(counts, ["file", "ordinal"], "left").select("doc_id", F.coalesce("n_tokens", lost).alias("n_tokens"))
