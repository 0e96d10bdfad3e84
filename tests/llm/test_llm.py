"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on odd rows."""

import hashlib
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontaminate, fingerprints, language, lines, perplexity, sharding, simhash, tokencounts, warc
from graphloom.llm.queries import QUERIES, fold

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = "fp at shard bucket gram file _at _lost n_lines n_dropped _items _spans _n_words _n_hit k1 k2 place copy row bits".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
LINE = "this very common line has more than forty characters in it"
ODD = [
    (5, None),
    (None, "a row without an id\nand two lines"),
    (7, ""),
    (9, "word " * 40_000),
    (9, "word " * 40_000),
    (11, "  \t\n \x0b\x0c\r  "),
    (12, "é" * 50 + "\n漢字かな交じり文 without spaces " + "x" * 3000),
    *[(20 + i, f"  {LINE.upper()} \nown line number {i} of this document with some more words\n\n{LINE}") for i in range(6)],
    (40, "Don't stop <|endoftext|> 12345     tabs\tand \x1c\x85 odd spaces 🙂🙂 end "),
    (41, "one"),
]


def rows(spark, some):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", None, *["mine"] * len(CLASHING)) for i, t in some], SCHEMA)


def got(df, *keys):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: repr([r[k] for k in keys]))


@pytest.fixture(scope="module")
def odd(spark):
    return rows(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return rows(spark, []).limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def plain_mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


def plain_window(w):
    if len(w) == 1:
        return plain_mix((w[0] + 1) * 0x9E3779B97F4A7C15 % 2**64)
    half = len(w) // 2
    return plain_mix((plain_window(w[:half]) * 0xD6E8FEB86659FD93 + plain_window(w[half:])) % 2**64)


def plain_sketch(text):
    """The hashes of a text's 16-byte windows below an eighth of the range, else the smallest, one window at a time."""
    if len(text) < 16:
        hashes = {int.from_bytes(hashlib.sha256(text).digest()[:6], "big")} if text else set()
    else:
        hashes = {plain_window(w) >> 16 for w in {text[i : i + 16] for i in range(len(text) - 15)}}
    return {h for h in hashes if h < 2**45} or set(sorted(hashes)[:1])


def plain_likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def written_set(s):
    import base64

    return "8:" + base64.b64encode(b"".join(h.to_bytes(6, "big") for h in sorted(s))).decode()


def next_of(some):
    order = sorted(some, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) + 2**63 & 2**64 - 1))
    return [(a, b) for a, b in zip(order, order[1:] + order[:1])]


@pytest.mark.parametrize("which", ["odd", "docs", "hot"])
def test_fingerprint_rows(spark, monkeypatch, which, odd, docs):
    """Every column against sketches made window by window; `hot`: some rows share an id, most lack one, in 16 ranges."""
    if which == "hot":
        monkeypatch.setattr(fingerprints, "parts", lambda _: 16)
    hot = [(None if i % 3 else 7, f"{i} text of its own") for i in range(60)] + [(i, "x" * i) for i in range(20)]
    some = {"odd": ODD, "hot": hot}.get(which) or [(r["doc_id"], r["text"]) for r in docs.where("doc_id < 40").collect()]
    frame = {"odd": odd, "hot": rows(spark, hot)}.get(which) or docs.where("doc_id < 40")
    found = fingerprints.fingerprint_with_next(frame).collect()
    made, want = {}, []
    sketch = lambda b: made.setdefault(b, plain_sketch(b))
    for (i, t), (_, u) in next_of(some):
        t, u = t or "", u or ""
        edited = (t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()
        a, b, c = sketch(t.encode()), sketch(edited), sketch(u.encode())
        want.append((i, len(t), hashlib.sha256(edited).hexdigest(), written_set(a), written_set(b), plain_likeness(a, b), plain_likeness(a, c)))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in found)


def test_fingerprints_of_an_empty_table(empty, odd):
    assert fingerprints.fingerprint_with_next(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0
    assert {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(odd).collect()}[7] == "8:"


def test_sketch_errors():
    """Estimates of likeness and containment lie about the true values of the shingle sets, with the error the docstring states."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    grams = lambda x: {x[i : i + 16] for i in range(len(x) - 15)}
    scores = []
    for size in (60, 60, 60, 400, 400, 3000):
        long = " ".join(word() for _ in range(size * 8)).encode()
        short = long[: size * 3] + " ".join(word() for _ in range(size // 2)).encode()
        a, b = fingerprints.sketch_all([short, long])
        likeness, within = fingerprints.compared(a, b)
        x, y = grams(short), grams(long)
        for got_, true, n in ((likeness, len(x & y) / len(x | y), len(x | y) / 8), (within, len(x & y) / len(x), len(x) / 8)):
            scores.append((got_ - true) / (true * (1 - true) / n) ** 0.5)
        assert fingerprints.parsed(fingerprints.written(b)).tolist() == b.tolist()
        assert fingerprints.merged(a, b).tolist() == sorted(set(a.tolist()) | set(b.tolist()))
    assert max(map(abs, scores)) < 4 and np.sqrt(np.mean(np.square(scores))) < 1.6


def test_sketches_of_repetitive_texts():
    texts = [*((w + " ").encode() * 40_000 for w in ("word", "Der", "The", "is")), b"x" * 5000, b"y" * 5000, b"tiny", b""]
    found = fingerprints.sketch_all(texts)
    for t, own in zip(texts, found):
        assert set(own.tolist()) == plain_sketch(t[:400] if len(t) > 4000 else t) and bool(t) == bool(len(own))
    for i, a in enumerate(found):
        for j, b in enumerate(found):
            assert (fingerprints.compared(a, b)[0] == 1) == (i == j)
    alone = [np.array([x], np.uint64) for x in (2**46, 2**47, 5)]
    assert fingerprints.merged(*alone[:2]).tolist() == [2**46] and fingerprints.merged(*alone[1:]).tolist() == [5]


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i, r in found.items() if r["held_out"]]
    assert len(held) > 100 and {i for i in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([found[i]["lang_pred"] == truth[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_switches(spark, docs):
    model = language.learn(docs, fold() != 2)
    by = {k: next(r["text"] for r in docs.where(f"lang = '{k}' and n_chars > 500").collect()) for k in ("en", "de")}
    mixed = " ".join(by["en"].split()[:30] + by["de"].split()[:30])
    labels = [k for _, k, _ in language.Labeller(model).words(mixed)]
    assert np.mean([k == "en" for k in labels[:30]]) > 0.8 and np.mean([k == "de" for k in labels[-30:]]) > 0.8


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    scores, moves, first, sizes = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), np.array([4, 1, 4])
    p, pairs = language.forward_backward(scores, sizes, moves, first)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in sizes:
        total, want = 0.0, np.zeros((n, 3))
        own = np.zeros((3, 3))
        for path in np.ndindex(*[3] * n):
            w = np.exp(first[path[0]] + sum(scores[at + i, k] for i, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            for i, k in enumerate(path):
                want[i, k] += w
            for a, b in zip(path, path[1:]):
                own[a, b] += w
        assert np.allclose(p[at : at + n], want / total)
        want_pairs += own / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_long_texts_are_labelled_alike(docs):
    """By chunks of any number of words, a text gets what one pass over all its words gives."""
    model = language.learn(docs)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(12).collect()]
    texts += [" ".join(texts), "\n".join(reversed(texts)), "one", "2 3", "", "½ ² Ⅷ"]
    want = language.Labeller(model, long=1 << 40).judged(texts)
    for chunk in (1, 2, 7, 100, 1000, 1 << 16):
        found = language.Labeller(model, long=-1, chunk=chunk).judged(texts)
        assert [x[0] for x in found] == [x[0] for x in want]
        assert np.allclose([x[1:] for x in found], [x[1:] for x in want], atol=1e-5)
    assert want[-3:] == [("und", 0.0, 0.0)] * 3


def test_words_are_letters_with_their_marks():
    assert language.words_of("Don't हिन्दी ½x² Ⅷ Éa1b_c İx") == ["don", "t", "हिन्दी", "x", "éa", "b", "c", "i̇x"]
    assert language.words_of("Ab 1c_D") == ["ab", "c", "d"]


def test_language_odd(odd, empty):
    model = language.fit(["the cat and the dog " * 30, "der hund und die katze " * 30], ["en", "de"])
    found = [(r["doc_id"], r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()]
    assert len(found) == len(ODD) and (5, "und", 0.0) in found and (7, "und", 0.0) in found and (11, "und", 0.0) in found
    assert language.learn(empty) is None and language.predict(odd, None).where("lang_pred <> 'und'").count() == 0
    assert language.recognised(odd, model).columns == odd.columns and language.predict(empty, model).count() == 0


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    low = {}
    for i, k in enumerate(ids):
        if k is not None:
            low[root(i)] = min(k, low.get(root(i), k))
    return [low.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_simhash(which, odd, docs):
    some = ODD if which == "odd" else [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [plain_fingerprint(t) for _, t in some]
    want = zip([i for i, _ in some], [f"{f:016x}" for f in fps], plain_components([i for i, _ in some], fps))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in simhash.near_duplicates(odd if which == "odd" else docs).collect())


@pytest.mark.parametrize("size", [12, 900])
def test_simhash_groups_of_any_size(size):
    """Within a bucket (equal in the chain's first segment) the groups are those of all pairs that keep the chain and the limit."""
    rng = np.random.default_rng(5)
    for start in range(5):
        mask = ((1 << simhash.WIDTHS[start]) - 1) << simhash.OFFSETS[start]
        fps = set()
        heads = [int(x) & ~mask | 5 << simhash.OFFSETS[start] for x in rng.integers(0, 2**63, size // 20 + 1, dtype=np.uint64)]
        while len(fps) < size:
            x = heads[int(rng.integers(len(heads)))]
            for b in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= (1 << int(b)) & ~mask
            fps.add(x)
        fps = sorted(fps)

        def holds(x):
            total, ok = 0, True
            for step, budget in enumerate([0, 1, 2, 3, 4]):
                k = (start + step) % 5
                total += (x >> simhash.OFFSETS[k] & (1 << simhash.WIDTHS[k]) - 1).bit_count()
                ok &= total <= budget
            return ok

        near = [[j for j in range(i) if holds(fps[i] ^ fps[j])] for i in range(size)]
        parent = list(range(size))

        def root(a):
            while parent[a] != a:
                a = parent[a]
            return a

        for i, some in enumerate(near):
            for j in some:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        assert simhash.groups(np.array(fps, np.uint64), start).tolist() == [root(i) for i in range(size)]


@pytest.mark.parametrize("block", [1 << 14, 7, 1])
def test_simhash_links_lose_nothing(spark, block):
    """Also where buckets are taken apart into blocks of 7 fingerprints, or of one."""
    rng = np.random.default_rng(6)
    fps = []
    for x in rng.integers(0, 2**63, 300, dtype=np.uint64).tolist():
        fps.append(x)
        if len(fps) == 1:  # one large group, whose buckets are the largest
            fps += [x ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(90)]
        for n in (1, 4, 4, 5):
            fps.append(x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["u"]: r["root"] for r in simhash.components(simhash.links(frame, block)).collect()}
    names = [roots.get(f, f) for f in signed]
    want = plain_components(list(range(len(fps))), fps)
    pairs = set(zip(names, want))
    assert len(pairs) == len(set(want)) == len(set(names))


def plain_representatives(some):
    """One (id, text) of each component: of the smallest id, by brute force; of ids that are equal or missing any."""
    comps = {}
    fps = [plain_fingerprint(t) for _, t in some]
    for i, label in enumerate(plain_components(list(range(len(some))), fps)):
        comps.setdefault(label, []).append(some[i])
    return [min((i for i, _ in own if i is not None), default=None) for own in comps.values()], list(comps.values())


def test_representatives(spark, odd, empty):
    a, b, c = (" ".join(f"{x}{i}" for i in range(200)) for x in ("apple", "berry", "cherry"))
    shared = [(5, a), (5, b), (None, a), (None, a), (None, c), (None, c), (6, b), (6, b)]
    for some, frame in ((ODD, odd), (shared, rows(spark, shared))):
        kept = simhash.representatives(frame)
        found = [(r["doc_id"], r["text"]) for r in kept.collect()]
        ids, comps = plain_representatives(some)
        assert kept.columns == frame.columns and len(found) == len(comps)
        for want, own in zip(ids, comps):
            (one,) = [r for r in found if r in own]
            assert one[0] == want
    assert simhash.representatives(empty).count() == 0


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_bpe_equals_the_library(which, odd, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.no_padding(), library.no_truncation()
    want = []
    for i, t in ODD if which == "odd" else [(r["doc_id"], r["text"]) for r in docs.collect()]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in bpe.round_trip(odd if which == "odd" else docs, VOCABULARY).collect())


def test_bpe_words():
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(VOCABULARY), bpe.Codec(VOCABULARY), np.random.default_rng(2)
    texts = ["".join(rng.choice(list("aeionrst lmd'hcu.,1290\nÄéßжщ漢🙂"), int(n))) for n in rng.integers(1, 400, 400)]
    texts += ["".join(map(chr, range(a, a + 512))) for a in range(0, 0xD800, 512)] + ["a" * 5000, "ab" * 3000, "<|endoftext|>x<|endoftext|>"]
    for t, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:50]
        assert own.decode(ids) == library.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def plain_lines(some):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for n, (i, t) in enumerate(some):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add((-1 if i is None else i, n))
    gone = {k: max(h)[0] for k, h in holders.items() if len(h) >= 5}
    out = []
    for i, t in some:
        own = (t or "").split("\n")
        kept = [x for x in own if not (key(x) in gone and (-1 if i is None else i) < gone[key(x)])]
        out.append((i, len(own), len(own) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_lines(which, odd, docs):
    some = ODD if which == "odd" else [(r["doc_id"], r["text"]) for r in docs.collect()]
    frame = odd if which == "odd" else docs
    found = lines.drop_repeated_lines(frame)
    a, b = lines.counts_of(frame)
    assert found.columns == [*frame.columns, a, b]
    found = found.collect()
    assert sorted(map(repr, plain_lines(some))) == sorted(repr((r["doc_id"], r[a], r[b], r["text"] or "")) for r in found)
    if which == "odd":
        assert {(r["n_lines"], r["_at"], r["_lost"]) for r in found} == {("mine",) * 3}


def test_lines_of_rows_without_an_id(spark):
    """Rows that have no id lose their own frequent lines only, each by its own text."""
    some = [(None, f"{LINE}\nand row {i} has a line of its own {'x' * 30}") for i in range(12)] + [(3, LINE)]
    found = lines.drop_repeated_lines(rows(spark, some)).collect()
    assert sorted(map(repr, plain_lines(some))) == sorted(repr((r["doc_id"], r["n_lines_"], r["n_dropped_"], r["text"] or "")) for r in found)


def test_line_runs(spark, empty):
    assert lines.drop_repeated_lines(empty).count() == 0
    runs = lines.LineRuns(spark)
    hashes = "h1 long, h2 long, n long, owner long"
    for batch in ([(1, 1, 3, 90), (2, 2, 1, 80)], [(1, 1, 2, 70), (3, 3, 1, 60)], [(3, 3, 9, 50), (4, 4, 1, 40)]):
        runs.add(spark.createDataFrame(batch, hashes))
    assert [len(level) for level in runs.levels] == [1, 1]
    asked = spark.createDataFrame([(1, 1), (5, 5)], "h1 long, h2 long")
    assert sorted(map(tuple, runs.unseen(asked).collect())) == [(5, 5)]
    runs.close(keep=True)
    again = lines.LineRuns.reopened(spark, runs.folder)
    again.add(spark.createDataFrame([(4, 4, 2, 30), (6, 6, 1, 20)], hashes))
    assert sorted(map(tuple, again.unseen(asked.union(spark.createDataFrame([(6, 6)], "h1 long, h2 long"))).collect())) == [(5, 5)]
    assert sorted(map(tuple, again.compacted().collect())) == [(1, 1, 5, 90), (2, 2, 1, 80), (3, 3, 10, 60), (4, 4, 3, 40), (6, 6, 1, 20)]
    again.close()


def test_runs_are_merged_in_order(spark):
    """Neither the anti-join with runs nor the merge of two runs shuffles or sorts a run."""
    runs = lines.LineRuns(spark)
    for k in range(3):
        runs.add(spark.createDataFrame([(i * 7919 % 1009, i, 1, k) for i in range(100 * k, 100 * k + 150)], "h1 long, h2 long, n long, owner long"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    with lines.in_order(spark):
        a, b = runs.runs()
        two = plan(runs.merged(a, b))
        one = plan(runs.unseen(spark.range(10).selectExpr("id AS h1", "id AS h2").repartition(runs.buckets, "h1", "h2")))
    assert two.count("SortMergeJoin") == 1 and two.count("Sort [") == two.count("Exchange") == 0
    assert one.count("SortMergeJoin") == 2 and one.count("Sort [") == one.count("Exchange hash") == 1
    runs.close()


ITEMS = [(1, " ".join(f"Alpha{i}" for i in range(20))), (1, "repeated id " * 10), (2, "short item"), (3, None), (4, "..."), (None, "no id here")]


def plain_windows(items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[at : at + 13]), set()).add("null" if i is None else str(i))
    return words, windows


def plain_contamination(some, items):
    """(id, n_words, n_hit, n_items, items' hash, contaminated, hit_chars) of each text, window by window."""
    words, windows = plain_windows(items)
    want = []
    for i, t in some:
        w, hit, found = words(t), set(), set()
        for k, who in windows.items():
            for at in range(len(w) - len(k) + 1):
                if tuple(w[at : at + len(k)]) == k:
                    hit |= set(range(at, at + len(k)))
                    found |= who
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), sum(len(w[k]) for k in hit)))
    return want


@pytest.mark.parametrize("block", [1 << 18, 30, 5])
def test_decontamination(spark, monkeypatch, block):
    """With one automaton, and with the items dealt over several blocks."""
    long = " ".join(f"alpha{i}" for i in range(3, 18))
    some = [*ODD, (60, f"x, y; {long}-end"), (60, f"x, y; {long}-end"), (61, "A short--ITEM and Short Item"), (62, "shorty items"), (63, "filler " * 900 + "no id here"), (64, "é short item é"), (None, "short item")]
    judged = decontaminate.judged
    monkeypatch.setattr(decontaminate, "judged", lambda docs, bench: judged(docs, bench, block))
    bench = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, _items string")
    found = decontaminate.report(rows(spark, some), bench)
    assert sorted(map(repr, plain_contamination(some, ITEMS))) == sorted(repr(tuple(r)) for r in found.collect())
    kept = decontaminate.clean(rows(spark, some), bench)
    want = [repr((i, t, "mine", "mine")) for (i, t), w in zip(some, plain_contamination(some, ITEMS)) if not w[5]]
    assert kept.columns == rows(spark, some).columns and sorted(want) == sorted(repr(tuple(r)) for r in kept.select("doc_id", "text", "_items", "_n_hit").collect())
    if block > 30:
        where = {(r["doc_id"], r["passage"]) for r in decontaminate.passages(rows(spark, some), bench).collect()}
        assert {(60, long), (61, "short--ITEM"), (61, "Short Item"), (64, "short item"), (63, "no id here")} <= where
        assert decontaminate.report(rows(spark, some), bench.limit(0)).where("n_hit > 0").count() == 0


def test_pieces_have_all_windows():
    w = [str(i).encode() for i in range(40)]
    for n in (1, 12, 13, 14, 25, 40):
        some = decontaminate.pieces_of(w[:n], 5)
        assert sorted(tuple(p[i : i + 13]) for p in some for i in range(max(1, len(p) - 12))) == sorted(tuple(w[i : min(n, i + 13)]) for i in range(max(1, n - 12)))
    assert decontaminate.pieces_of([]) == []


def test_decontamination_offsets():
    text = "Ä said: one-Two THREE."
    assert [text[a:b] for a, b in decontaminate.original_offsets(text, [(2, 4), (0, 1)])] == ["one-Two", "Ä"]


@pytest.mark.parametrize("n", [1, 64, 65, 5000, 60_000])
def test_symbols_are_distinct(n):
    machine = decontaminate.Machine([("a", " ".join(map(str, range(n))).encode())])
    assert len(set(machine.symbols.values())) == n and {len(x) for x in machine.symbols.values()} == {machine.width}
    text = "x " + " ".join(str(i) for i in range(max(0, n - 20), n))
    assert machine.scan(text)[:2] == (min(n, 20) + 1, [(1, min(n, 20) + 1)])


@pytest.mark.parametrize("limit", [40, 2000, 1 << 20])
def test_sharding(odd, docs, limit):
    for frame in (odd, docs):
        found = sharding.assign(frame, limit).collect()
        shards = {}
        for r in found:
            shards.setdefault(r["shard"], []).append(r)
        assert len(found) == frame.count()
        for name, own in shards.items():
            assert len(name) == own[0]["depth"] and sum(r["n_bytes"] for r in own) == own[0]["shard_bytes"] and len(own) == own[0]["shard_docs"]
            assert own[0]["shard_bytes"] <= limit or len(own) == 1
            assert not any(name != other and other.startswith(name) for other in shards)
            if name:
                sibling = [r for r in found if r["shard"].startswith(name[:-1])]
                assert sum(r["n_bytes"] for r in sibling) > limit


def test_write_shards(spark, docs, odd, empty, tmp_path):
    """Every row is written once, also those without an id and those that share one, with the caller's own `shard`."""
    for name, frame, limit in (("docs", docs, 50_000), ("odd", odd, 300), ("empty", empty, 300)):
        placed = sharding.write_shards(frame, str(tmp_path / name), limit)
        assert placed.columns == sharding.assign(frame, limit).columns
        if name == "empty":
            assert placed.count() == 0
            continue
        back = spark.read.parquet(str(tmp_path / name))
        of = {"docs": "shard", "odd": "shard_"}[name]
        assert sorted(map(repr, (tuple(r) for r in back.select(frame.columns).collect()))) == sorted(map(repr, map(tuple, frame.collect())))
        sizes = {r[of][1:]: (r["n"], r["b"]) for r in back.groupBy(of).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("b")).collect()}
        assert sizes == {r["shard"]: (r["shard_docs"], r["shard_bytes"]) for r in placed.collect()}
        assert all(b <= limit or n == 1 for n, b in sizes.values())


@pytest.mark.parametrize("size", [2, 6, 64, 4 << 20])
def test_separator_scan(spark, tmp_path, size):
    rng, want = np.random.default_rng(size), []
    for part in range(3):
        tokens = rng.choice([1, 2, 3, 50256], 200, p=[0.3, 0.3, 0.3, 0.1] if part else [0.33, 0.33, 0.33, 0.01]).astype("<u2")
        (tmp_path / f"part-{part:06d}.tok").write_bytes(tokens.tobytes())
        at = np.nonzero(tokens == 50256)[0]
        want += [(part, k, int(n), True) for k, n in enumerate(np.diff(at, prepend=-1) - 1)]
        if (rest := len(tokens) - 1 - (at[-1] if len(at) else -1)) > 0:
            want.append((part, len(at), int(rest), False))
    (tmp_path / "part-000009.tok").write_bytes(b"")
    found = [tuple(r) for r in tokencounts.count_tokens(tokencounts.token_files(spark, str(tmp_path)), size=size).collect()]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("which", ["odd", "docs"])
def test_token_counts(which, odd, docs, empty):
    """Counts of the library, which is told to take the strings of special tokens for ordinary text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    library.no_padding(), library.no_truncation()
    library.encode_special_tokens = True
    some = ODD if which == "odd" else [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [(i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in some]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in tokencounts.documents_token_counts(odd if which == "odd" else docs, VOCABULARY).collect())
    assert tokencounts.documents_token_counts(empty, VOCABULARY).count() == 0


def test_warc(spark):
    big = "<html>" + "x" * 200
    some = [(3, "http://a/é?x y", big), (1, None, big), (1, "u", big), (None, "u", big), (2, "u", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 100), (7, "u", big), (8, "u", "long " * 300_000)]
    frame = spark.createDataFrame([(*r, "x") for r in some], "page_id long, url string, html string, digest string")
    want = []
    for i, _, h in some:
        raw = (h or "").encode()
        again = h == big and i != 1
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in warc.through_archives(frame).collect())
    assert warc.through_archives(frame.limit(0)).count() == 0


def test_zip_directories(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(66_000):  # more than a plain directory can count
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"")
        with z.open(zipfile.ZipInfo("wide"), "w", force_zip64=True) as f:
            f.write(b"stored")
        z.writestr("packed", b"deflated", zipfile.ZIP_DEFLATED)
    with open(path, "rb") as f:
        found = warc.stored_members(f, path.stat().st_size)
        at, n = found["wide"]
        f.seek(at)
        assert len(found) == 66_001 and f.read(n) == b"stored" and "packed" not in found


def test_quality_thresholds(spark):
    """Fold, quantile, drawing towards the general limit and verdict, from the perplexities by plain Python."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    marks = {}
    for r in labels.collect():
        marks.setdefault(r["doc_id"], []).append((r["quality"], r["toxic"] or 0))
    good = {i for i, m in marks.items() if min(q for q, _ in m) == 1 and max(t for _, t in m) == 0}
    fold = lambda i: (xxhash.xxh64_intdigest(int(i).to_bytes(8, "little", signed=True), 42) + 2**63) % 2**64 - 2**63
    found = {r["doc_id"]: r for r in perplexity.classify(docs, labels).collect()}
    held = [r for i, r in found.items() if i in good and fold(i) % perplexity.CALIBRATE == 0]
    quantile = lambda x: sorted(x)[max(0, int(np.ceil(perplexity.QUANTILE * len(x))) - 1)]
    general = quantile([r["perplexity"] for r in held])
    assert len(found) == docs.count() and len(held) > 3
    for r in docs.collect():
        own = [h["perplexity"] for h in held if h["lang"] == r["lang"]]
        want = np.exp((len(own) * np.log(quantile(own)) + perplexity.FEW * np.log(general)) / (len(own) + perplexity.FEW)) if own else general
        got_ = found[r["doc_id"]]
        assert got_["threshold"] == pytest.approx(want) and got_["keep"] == (bool(r["text"]) and got_["perplexity"] <= got_["threshold"])


def test_quality_on_documents_that_did_not_train(spark):
    """Of the labelled documents, trained on none of these: bad ones mostly go, good ones stay."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = perplexity.classify(docs, labels).join(labels, "doc_id").where("toxic = 0").withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(perplexity.CALIBRATE))).collect()
    bad, good = [r["keep"] for r in found if not r["quality"]], [r["keep"] for r in found if r["quality"] and r["fold"] == 0]
    assert len(bad) > 30 and len(good) > 30 and np.mean(bad) < 0.4 and np.mean(good) > 0.95


def test_quality_odd(spark, odd, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20, 26)] + [(20, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = perplexity.classify(odd, labels).collect()
    assert len(found) == len(ODD) and not any(r["keep"] for r in found if r["doc_id"] in (5, 7))
    assert perplexity.classify(odd, labels.limit(0)).where("perplexity is not null").count() == 0
    assert perplexity.classify(empty, labels).count() == 0


def test_pipeline(spark, odd, tmp_path):
    """run() against plain versions of its stages, one after the other: only the language model itself is the pipeline's."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    own = language.Labeller(language.learn(docs))
    some = []
    for i, t in sorted(texts.items()):
        p = [best for _, _, best in own.words(t)]
        if p and np.mean(p) >= language.LEAST:
            some.append((i, t))
    some = [(i, t) for i, _, _, t in plain_lines(some)]
    comps = plain_components([i for i, _ in some], [plain_fingerprint(t) for _, t in some])
    some = [(i, t) for (i, t), c in zip(some, comps) if i == c]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    judged = plain_contamination(some, [(r["item_id"], r["text"]) for r in bench.collect()])
    library, want = Tokenizer.from_file(VOCABULARY), []
    library.no_padding(), library.no_truncation()
    for (i, t), verdict in zip(some, judged):
        if not verdict[5]:
            ids = library.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert 0 < len(want) < len(texts) and sorted(want) == sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (odd, odd.limit(0)):
        now = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == frame.columns and now.where("_items <> 'mine' or n_lines <> 'mine'").count() == 0
        assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()


def test_near_duplicates_are_all_linked(spark):
    """Whatever lies within 4 bits is linked: counted against all pairs of the test documents' fingerprints."""
    rows_ = simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    fps = np.array([int(r["fingerprint"], 16) for r in rows_], np.uint64)
    comp = np.array([r["component_id"] for r in rows_])
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    i, j = np.nonzero(np.triu(near, 1))
    assert len(i) > 20 and (comp[i] == comp[j]).all() and (comp <= np.array([r["doc_id"] for r in rows_])).all()


def test_bpe_paths_agree():
    own, r = bpe.Codec(VOCABULARY), random.Random(3)
    some = [chr(i) for i in range(128)] + list("  \n\t'strevmld") * 4
    for _ in range(3000):
        text = "".join(r.choices(some, k=r.randint(0, 60)))
        assert own.words.findall(text) == own.ascii_words.findall(text)
        ids = [own.single[b] for b in text.encode()]
        assert own._exact_short(list(ids)) == own._exact_long(list(ids))
