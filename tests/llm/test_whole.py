"""What a review found to be less than the whole job."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import language, perplexity, simhash, wordgrams


def plain_word_model(texts):
    """Perplexity by the textbook's formulas, over tuples of words."""
    lead = lambda t: ["<s>", "<s>", *wordgrams.words(t), "</s>"]
    counts = [Counter() for _ in range(4)]
    for t in texts:
        s = lead(t)
        counts[3].update(zip(s, s[1:], s[2:]))
    for k in (2, 1):
        counts[k].update(g[1:] for g in counts[k + 1])
    models = []
    for k in (1, 2, 3):
        n = [sum(c == j for c in counts[k].values()) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        d = [min(max(j + 1 - (j + 2) * y * n[j + 1] / n[j], 0.05), j + 0.95) for j in range(3)] if all(n) else [0.5] * 3
        total, spare = defaultdict(float), defaultdict(float)
        for g, c in counts[k].items():
            total[g[:-1]] += c
            spare[g[:-1]] += d[min(c, 3) - 1]
        models.append((d, total, spare))

    def p(gram):
        if not gram:
            return 1 / (len(counts[1]) + 1)
        d, total, spare = models[len(gram) - 1]
        if gram[:-1] not in total:
            return p(gram[1:])
        c = counts[len(gram)].get(gram, 0)
        return (c - (d[min(c, 3) - 1] if c else 0) + spare[gram[:-1]] * p(gram[1:])) / total[gram[:-1]]

    def perplexity_of(t):
        s = lead(t)
        return float(np.exp(-np.mean([np.log(p(g)) for g in zip(s, s[1:], s[2:])])))

    return perplexity_of


@pytest.mark.parametrize("heavy", [3, 1 << 16])
def test_quality_is_judged_by_words(spark, monkeypatch, heavy):
    monkeypatch.setattr(wordgrams, "HEAVY", heavy)
    some = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").collect()]
    some += [(100, None), (101, "Never seen 漢字 &&& words"), (101, "Never seen 漢字 &&& words"), (None, ""), (102, "the the the and the")]
    frame = spark.createDataFrame([(i, t, "en") for i, t in some], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    folds = {r[0]: r[1] for r in labels.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {perplexity.CALIBRATE})").collect()}
    plain = plain_word_model([t for i, t in some if folds.get(i, 0) != 0])
    found = sorted((repr(r["doc_id"]), r["perplexity"]) for r in perplexity.classify(frame, labels).collect())
    want = sorted((repr(i), plain(t or "")) for i, t in some)
    assert [i for i, _ in found] == [i for i, _ in want]
    assert [x for _, x in found] == pytest.approx([x for _, x in want], rel=1e-9)


def test_every_language_is_learned(spark):
    rows = [(100 * k + i, f"l{k:02d}", " ".join(chr(97 + k % 26) + chr(97 + k // 26) + w for w in ("one", "two", "three") * 4)) for k in range(40) for i in range(2 if k else 1)]
    rows.append((9000, "long", "quaxz quuxz " * (language.LONGEST // 6)))
    model = language.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == sorted({r[1] for r in rows})


def test_a_text_in_three_languages_is_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learn(docs)
    by = {k: " ".join(r["text"] for r in docs.where(f"lang = '{k}' and n_chars > 800").orderBy("doc_id").limit(12).collect()).split() for k in ("de", "es", "fr")}
    mixed = [" ".join(w for n in range(3) for k in by for w in by[k][300 * i + 50 * n : 300 * i + 50 * n + 50]) for i in range(5)]
    assert min(s for _, s in language.Labeller(model).documents(mixed)) < language.LEAST
    frame = spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string")
    assert language.recognised(frame, model).count() == len(mixed)


def test_every_group_keeps_a_row_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in ("apple", "berry", "cherry"))
    some = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c)]
    kept = simhash.representatives(spark.createDataFrame(some, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect())) == [(1, a), (1, b), (4, c)]


def test_thresholds_of_small_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = perplexity.classify(docs, docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).collect()
    folds = {r[0] for r in docs.where(f"pmod(xxhash64(doc_id), {perplexity.CALIBRATE}) = 0").select("doc_id").collect()}
    held = [r for r in found if r["doc_id"] in folds]
    general = max(r["perplexity"] for r in held)
    for k in {r["lang"] for r in held}:
        own = [r["perplexity"] for r in held if r["lang"] == k]
        assert len(own) < perplexity.FEW
        want = np.exp((len(own) * np.log(max(own)) + perplexity.FEW * np.log(general)) / (len(own) + perplexity.FEW))
        assert all(r["threshold"] == pytest.approx(want) for r in found if r["lang"] == k)
