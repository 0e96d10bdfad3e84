"""What is equal, wide or many: equal benchmark pieces, identifiers over 16 bits."""

import hashlib
import json

import numpy as np
import public_tokenizers
import pytest

from graphloom.llm import decontaminate, tokencounts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_equal_items_are_one_piece_of_a_block(spark):
    passage = " ".join(f"word{i}" for i in range(40))
    other = [" ".join(f"x{k}y{i}" for i in range(30)) for k in range(20)]
    bench = spark.createDataFrame([(i, passage) for i in range(400)] + [(1000 + k, t) for k, t in enumerate(other)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "nothing at all"), (3, f"{other[3]} {passage}"), (4, None)], "doc_id long, text string")
    rows, _ = decontaminate.judged(docs, bench, 200)
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in rows.collect()}
    everyone = sorted(map(str, range(400)))
    assert got == {1: (40, everyone), 2: (0, []), 3: (70, sorted([*everyone, "1003"])), 4: (0, [])}
    pieces = bench.select(bench["item_id"].cast("string").alias("item"), "text").mapInArrow(decontaminate._cut_up, "item string, piece binary, n long")
    sent = []

    class Held:
        def __init__(self, rows):
            self.value = (hashlib.sha256(repr(sorted(rows)).encode()).hexdigest(), rows)

        def destroy(self):
            pass

    def remember(rows):
        some = [(r["item"], bytes(r["piece"])) for r in rows.select("item", "piece").collect()]
        sent.append(some)
        return Held(some)

    decontaminate._by_blocks(docs, pieces, 200, 1 << 30, remember)
    words = [sum(len(decontaminate.words_of(p.decode())) for _, p in some) for some in sent]
    assert sum(words) == 40 + 20 * 30 and max(words) <= 200 + 40 and len(sent) >= 3


@pytest.mark.parametrize("width", [2, 4])
def test_identifiers_have_the_width_that_the_vocabulary_needs(spark, tmp_path, width):
    texts = ["some words here", "", None, "and others " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    names, files = tokencounts.write_tokens(docs, str(tmp_path), VOCABULARY, width=width)
    counts = tokencounts.count_tokens(files, tokencounts.separator(VOCABULARY)[0], size=1002, width=width)
    got = {r["doc_id"]: r["n_tokens"] for r in names.join(counts, ["file", "ordinal"]).collect()}
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    assert got == {i: len(own.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_large_vocabularies_take_four_bytes_and_an_end_is_needed(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"model": {"vocab": {"a": 0, "b": 70_000}}, "added_tokens": [{"id": 70_001, "content": "</s>"}]}))
    assert tokencounts.separator(str(path)) == (70_001, 4)
    path.write_text(json.dumps({"model": {"vocab": {"a": 0}}}))
    with pytest.raises(ValueError):
        tokencounts.separator(str(path))
    assert np.array([70_000], "<u4").astype("<u2")[0] == 4464  # what a narrow file would have made of it
