"""Benchmark decontamination with one Aho-Corasick automaton.

Words are the runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters. Each of the benchmark's own words
has a number, written with BASE digits of one alphabet for each place, so no match can begin inside a word and no node has
more than BASE edges; all other words are one symbol. The automaton holds every distinct window of WINDOW consecutive words
of an item (an item with fewer words is one window). A text is written in these symbols and scanned once; the places found
are mapped to word ranges, and these to offsets of the original text.

A word of an item takes about 2 KB of automaton, so an automaton is built from at most BLOCK words and BLOCK_BYTES bytes.
The benchmark's size is looked at first: up to that bound, which real test sets of any usual size keep, its items come to
the driver and are broadcast, a worker process builds the automaton once, and no shuffle precedes. A larger benchmark is cut into pieces that overlap by WINDOW - 1
words, of which equal ones are one, and dealt over blocks by running size; each block is a scan of its own over all texts, builds its automaton once in a
process and writes what it hits, by text hash; the hits are joined with the texts at the end. Both ways find the same.

Defined results: null has no words; a text without words has no hits; an item without words has no window; items
that share an id count once, an item without an id has the id "null". Texts of any length are scanned whole. Columns that
are added get underscores behind their names where the caller has such columns.
"""

from __future__ import annotations

import uuid
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.ordered import running_total
from .common import cut, free_name, new_folder, strings

WINDOW, SHARE = 13, 20
BLOCK, BLOCK_BYTES, PIECE = 1 << 17, 8 << 20, 2048
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BASE, OTHER = 64, "\x01"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def pieces_of(words: list[bytes], size: int = PIECE) -> list[list[bytes]]:
    """Parts of an item that have all its windows between them, each of them in one."""
    return [words[at : at + size + WINDOW - 1] for at in range(0, max(1, len(words) - WINDOW + 1), size)] if words else []


class Machine:
    """The automaton of (item, words joined by spaces) rows."""

    def __init__(self, pieces: list[tuple[str, bytes]]):
        cut_up = [(item, piece.split()) for item, piece in sorted(set(pieces))]  # by item
        known = sorted({w for _, words in cut_up for w in words})
        self.width = 1
        while BASE**self.width < len(known):
            self.width += 1
        self.symbols = {w: self._symbol(n) for n, w in enumerate(known)}
        self.sizes: list[int] = []
        self.items: list[tuple[str, ...]] = []
        numbers: dict[str, int] = {}
        for item, words in cut_up:
            text = "".join(map(self.symbols.__getitem__, words))
            for i in range(max(1, len(words) - WINDOW + 1)):
                window = text[i * self.width : (i + WINDOW) * self.width]
                n = numbers.setdefault(window, len(numbers))
                if n == len(self.items):
                    self.items.append((item,))
                    self.sizes.append(len(window) // self.width)
                elif self.items[n][-1] != item:
                    self.items[n] += (item,)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for window, n in numbers.items():
            self.automaton.add_word(window, n)
        if numbers:
            self.automaton.make_automaton()

    def _symbol(self, n: int) -> str:
        """The digits of n, the one of the highest place from the first alphabet, which begins at BASE."""
        return "".join(chr(BASE * (k + 1) + n // BASE ** (self.width - 1 - k) % BASE) for k in range(self.width))

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words; (first word, one past the last) of every merged range of hit words; items found."""
        words = words_of(text)
        spans, items = [], set()
        if words and self.sizes:
            symbols = "".join(map(self.symbols.get, words, repeat(OTHER)))
            hits = list(self.automaton.iter(symbols))
            if hits:
                codes = np.frombuffer(symbols.encode("utf-32-le"), np.uint32)
                word = np.cumsum((codes < 2 * BASE)) - 1  # a word begins with a digit of the first alphabet or is OTHER
                for at, n in hits:
                    last = int(word[at])
                    spans.append((last + 1 - self.sizes[n], last + 1))
                    items.update(self.items[n])
        return len(words), merged_spans(spans), items


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def word_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends in the original text, in code points."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(_WORDS), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return points[np.nonzero(edge == 1)[0]], points[np.nonzero(edge == -1)[0]]


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point ranges of the original text that the word ranges cover."""
    starts, ends = word_offsets(text)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


_kept: dict[str, Machine] = {}


def _machine(sent) -> Machine:
    """The process keeps the automaton that it used last."""
    name, pieces = sent
    if name not in _kept:
        _kept.clear()
        _kept[name] = Machine(pieces)
    return _kept[name]


def _cut_up(batches):
    for batch in batches:
        found = [(i, b" ".join(p), len(p)) for i, text in zip(batch.column("item").to_pylist(), strings(batch.column("text")), strict=True) for p in pieces_of(words_of(text))]
        columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.binary(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "piece", "n"])


SPAN = "array<struct<start:bigint,stop:bigint>>"
_NUMBERS = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
_ADDED = (("n_words", "bigint"), ("n_hit", "bigint"), ("hit_chars", "bigint"), ("items", "array<string>"), ("spans", SPAN))


def _findings(text: str, n_words: int, spans: list[tuple[int, int]], items) -> tuple:
    """A row of _ADDED: hit_chars and spans are in code points of the original text."""
    if not spans:
        return n_words, 0, 0, [], []
    starts, ends = word_offsets(text)
    hit = sum(b - a for a, b in spans)
    chars = sum(int((ends[a:b] - starts[a:b]).sum()) for a, b in spans)
    return n_words, hit, chars, sorted(items), [{"start": int(starts[a]), "stop": int(ends[b - 1])} for a, b in spans]


def _appended(batch, rows: list[tuple], names: list[str], keep: int):
    columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_NUMBERS)]
    return pa.RecordBatch.from_arrays([*batch.columns[:keep], *columns], names=[*batch.schema.names[:keep], *names])


def _scanned(sent, names: list[str]):
    def each(batches):
        machine = _machine(sent.value)
        for batch in batches:
            rows = [_findings(t, *machine.scan(t)) for t in strings(batch.column("text"))]
            yield _appended(batch, rows, names, batch.num_columns)

    return each


def _hits(sent):
    """k1, k2, spans (word ranges, flat) and items of the texts that a block hits."""

    def each(batches):
        machine = _machine(sent.value)
        for batch in batches:
            found = [(i, s, w) for i, (_, s, w) in enumerate(map(machine.scan, strings(batch.column("text")))) if s]
            at = pa.array([f[0] for f in found], pa.int64())
            spans = pa.array([[x for s in f[1] for x in s] for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("k1").take(at), batch.column("k2").take(at), spans, pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))], names=["k1", "k2", "spans", "items"])

    return each


def _joined(names: list[str], keep: int, spans: str, items: str):
    def each(batches):
        for batch in batches:
            rows = []
            for text, flat, who in zip(strings(batch.column("text")), batch.column(spans).to_pylist(), batch.column(items).to_pylist(), strict=True):
                found = merged_spans(list(zip((flat or [])[::2], (flat or [])[1::2], strict=True)))
                rows.append(_findings(text, len(words_of(text)), found, set(who or ())))
            yield _appended(batch, rows, names, keep)

    return each


def judged(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """The rows with n_words, n_hit, hit_chars (of the hit words), items (sorted as strings), spans (hit ranges of the
    original text in code points) and contaminated; and the names that these columns have got.
    """
    spark = docs.sparkSession
    names = {n: free_name(n, docs.columns) for n, _ in _ADDED} | {"contaminated": free_name("contaminated", docs.columns)}
    added = [names[n] for n, _ in _ADDED]
    made = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in _ADDED)).schema
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[f.name], f.dataType) for f in made.fields)])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    pieces = cut(items.mapInArrow(_cut_up, "item string, piece binary, n long"))
    size = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0))).first()
    blocks = max(-(-size[0] // block), -(-size[1] // block_bytes), 1)

    def sent(rows: DataFrame):
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], bytes(r["piece"])) for r in rows.select("item", "piece").collect()]))

    if blocks == 1:
        out = docs.mapInArrow(_scanned(sent(pieces), added), schema)
    else:
        out = _by_blocks(docs, pieces, block, block_bytes, sent).mapInArrow(_joined(added, len(docs.columns), *_spare(docs)[2:]), schema)
    hit, words = F.col(names["n_hit"]), F.col(names["n_words"])
    return out.withColumn(names["contaminated"], (hit > 0) & (SHARE * hit >= words)), names


def _spare(docs: DataFrame) -> list[str]:
    return [free_name(n, docs.columns) for n in ("text_key", "text_key_2", "found_spans", "found_items")]


def _by_blocks(docs: DataFrame, pieces: DataFrame, block: int, block_bytes: int, sent) -> DataFrame:
    """The rows with the word ranges and items that all blocks found.

    Equal pieces of any number of items are one class, which is sent once; the items come back by a join. Blocks are filled in the order of the
    classes' hashes by their running size, so each has at most its words and bytes, and one piece more.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = F.xxhash64(text), F.xxhash64(F.lit(1), text)
    named = pieces.withColumn("class", F.sha2("piece", 256))
    members = cut(named.select("class", "item").distinct())
    share = F.ceil((F.col("n") / block + F.octet_length("piece") / block_bytes) * 1_000_000).cast("long")
    classes = named.groupBy("class").agg(F.first("piece").alias("piece"), F.first("n").alias("n"))
    dealt = running_total(classes.withColumn("share", share), "share", "class")
    dealt = cut(dealt.select(F.col("class").alias("item"), "piece", F.floor((F.col("total") - F.col("share")) / 1_000_000).cast("long").alias("block")))
    folder = new_folder(spark, "benchmark-hits")
    for k in range(dealt.agg(F.max("block")).first()[0] + 1):
        some = sent(dealt.where(F.col("block") == k))
        rows = docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text"))
        rows.mapInArrow(_hits(some), "k1 long, k2 long, spans array<long>, items array<string>").dropDuplicates(["k1", "k2"]).write.mode("append").parquet(folder)
        some.destroy()
    found = spark.read.parquet(folder)
    spans_of = found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("s"))
    items_of = found.select("k1", "k2", F.explode("items").alias("class")).join(members, "class").groupBy("k1", "k2").agg(F.collect_set("item").alias("i"))
    every = spans_of.join(items_of, ["k1", "k2"]).select("k1", "k2", "s", "i")
    a, b, spans, items = _spare(docs)
    return docs.withColumns({a: k1, b: k2}).join(cut(every).toDF(a, b, spans, items), [a, b], "left").select(*[F.col(f"`{c}`") for c in docs.columns], spans, items)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows, _ = judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
        "hit_chars",
    )


def passages(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, start, stop and passage (as the original text has it) of every range of hit words."""
    rows, _ = judged(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark)
    each = rows.select("doc_id", "text", F.explode("spans").alias("s"))
    return each.select("doc_id", "s.start", "s.stop", F.col("text").substr(F.col("s.start").cast("int") + 1, (F.col("s.stop") - F.col("s.start")).cast("int")).alias("passage"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with their own columns, that are not contaminated."""
    rows, names = judged(docs, benchmark)
    return rows.where(~F.col(names["contaminated"])).select(*[F.col(f"`{c}`") for c in docs.columns])
