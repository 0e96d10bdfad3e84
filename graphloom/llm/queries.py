"""The queries op1 to op13: each operator over its whole table, and the digests that their contracts name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, collocations, decontaminate, fingerprints, language, lines, perplexity, resampling, sharding, simhash, tokencounts, vectorpasses, warc
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_with_next(table(spark, sf_dir, "documents"))


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.learn(docs, fold() != 2)
    return language.predict(docs, model).select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.documents_token_counts(table(spark, sf_dir, "documents"), vocabulary())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorpasses.near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_language, op3_simhash, op4_bpe, op5_lines, op6_decontaminate, op7_shards, op8_token_counts, op9_warc, op10_quality, op11_resampling, op12_collocations, op13_embedding_dedup)}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = f"translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op5_lines": f"""
WITH l AS (
  SELECT doc_id, pos, line, {_KEY} AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
often AS (SELECT k, max(doc_id) AS owner FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, l.pos, l.line, coalesce(l.doc_id < o.owner, false) AS gone FROM l LEFT JOIN often o USING (k))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op6_decontaminate": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT d.doc_id, d.i, d.n, w.item_id FROM dwin d JOIN win w ON d.s = w.s AND d.n = w.n),
hp AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits),
hw AS (SELECT doc_id, count(*) AS n_hit, CAST(sum(length(w[p])) AS BIGINT) AS hit_chars FROM hp JOIN dw USING (doc_id) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
       sha256(coalesce(hi.items, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(dw.w) AS contaminated,
       coalesce(hw.hit_chars, 0) AS hit_chars
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op7_shards": f"""
WITH r AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
         lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits FROM documents),
d AS (SELECT doc_id, n_bytes, depth, substr(bits, 1, depth) AS shard FROM r, (SELECT unnest(generate_series(0, 60)) AS depth)),
s AS (SELECT depth, shard, count(*) AS shard_docs, sum(n_bytes) AS shard_bytes FROM d GROUP BY depth, shard)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, shard, CAST(depth AS INTEGER) AS depth, shard_docs, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM d JOIN s USING (depth, shard) WHERE shard_bytes <= {sharding.LIMIT} OR shard_docs = 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1""",
    "op9_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.h AS payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h AND p.n >= 100""",
    "op11_resampling": r"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT k, unnest(w) AS f FROM dw),
b AS (SELECT unnest(w) AS f FROM bw),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
bytes AS (SELECT f, list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS own FROM (SELECT f FROM d UNION SELECT f FROM b)),
bucket AS (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295, own), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8))) % 10000 AS n FROM bytes, crc),
s AS (SELECT n, count(*) AS s FROM d JOIN bucket USING (f) GROUP BY n),
t AS (SELECT n, count(*) AS t FROM b JOIN bucket USING (f) GROUP BY n),
gain AS (
  SELECT n, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM d) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (n)),
sums AS (SELECT k, CAST(count(*) AS BIGINT) AS n_features, CAST(sum(g) AS BIGINT) AS weight FROM d JOIN bucket USING (f) JOIN gain USING (n) GROUP BY k),
scored AS (
  SELECT k, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM dw LEFT JOIN sums USING (k)),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM ranked) * 10 // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (k)""",
    "op12_collocations": r"""
WITH p AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, k, a, w, unnest(generate_series(1, k - 1)) AS j FROM c),
scored AS (
  SELECT cut.lang, cut.phrase, cut.a, j, l.a AS l, r.a AS r, n, CAST((1000::HUGEINT * cut.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cut JOIN n USING (lang) JOIN f l ON l.lang = cut.lang AND l.phrase = array_to_string(cut.w[1 : cut.j], ' ')
           JOIN f r ON r.lang = cut.lang AND r.phrase = array_to_string(cut.w[cut.j + 1 : cut.k], ' ')),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
size AS (SELECT lang, k, a, w, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2),
start AS (SELECT lang, a, w, m, unnest(generate_series(1, k - m + 1)) AS i FROM size),
longer AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS b FROM start GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM low LEFT JOIN longer USING (lang, phrase) WHERE b IS NULL OR 100 * b < 100 * a
QUALIFY rank <= 2000""",
    "op13_embedding_dedup": f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (
  SELECT a.k AS x, b.k AS y FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k <> b.k
  WHERE list_cosine_similarity(a.e, b.e) >= {vectorpasses.LIMIT}),
reach AS (SELECT k AS x, k AS y FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
component AS (SELECT r.x AS k, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.k = r.y GROUP BY r.x),
n AS (SELECT x AS k, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN component USING (k) LEFT JOIN n USING (k)""",
}
