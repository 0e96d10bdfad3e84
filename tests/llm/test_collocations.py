"""Collocations against plain Python, with shards of a few words."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.llm import collocations

SOME = "New York city of the big apple l'été NAÏVE x-ray 漢字   \x1c".split(" ")


def plain(docs, least, longest, top, absorbed):
    n, f = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    longer = defaultdict(int)
    for (lang, w), a in kept.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    found = defaultdict(list)
    for (lang, w), a in kept.items():
        if 100 * longer[lang, w] >= absorbed * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, some in found.items() for i, (s, a, p, l, r) in enumerate(sorted(some)[:top]))


@pytest.mark.parametrize(("least", "longest", "top", "absorbed", "shard"), [(3, 5, 2000, 100, 40), (2, 3, 7, 60, 1 << 20), (5, 2, 50, 100, 500), (1, 6, 40, 80, 300)])
def test_phrases_are_those_of_plain_python(spark, least, longest, top, absorbed, shard):
    rng = random.Random(least)
    mark = lambda: rng.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "! ", "\r\n"])
    docs = [("".join(rng.choice(SOME) + mark() for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "fr", "", None])) for _ in range(120)]
    docs += [(None, "en"), ("", None), (" \t .,; ", "de"), ("The big apple of New York, the big apple. " * 40, "en"), ("same words\n" * 9, None), ("same words\n" * 9, None)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(3).withColumns({c: F.lit("mine") for c in ("shard", "n", "word", "phrase", "k")})
    got = collocations.collocations(frame, least, longest, top, absorbed, shard)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, least, longest, top, absorbed)


def test_empty_and_wordless_tables_give_nothing(spark):
    docs = spark.createDataFrame([(None, "en"), ("...", None)], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
    assert collocations.collocations(docs.limit(0), least=1).count() == 0


def test_products_may_pass_64_bits(spark):
    big = 3 * 10**15
    row = spark.createDataFrame([(big, big + 1, big, 7)], "a long, n long, l long, r long")
    exact = "(CAST(a AS DECIMAL(16, 0)) * 1000 * CAST(n AS DECIMAL(16, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    assert row.select(F.expr(exact)).first()[0] == 1000 * big * (big + 1) // (big * 7)
