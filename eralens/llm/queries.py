"""The registered queries of this package: each applies one operator, with production
parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eralens.llm import decontam, embed_join, minhash, ngram_lm, packing, paragraphs, pii, prefix_trie, secret_scan, spelling, suffix_dedup, token_records, toxicity
from eralens.llm.common import table


def fold(parts: int) -> Column:
    """crc32 of the id's digits, modulo ``parts``; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    out = toxicity.apply(docs, model, spans=True)
    return out.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.col("tox_segments").alias("segments"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ngram_lm.score(table(spark, sf_dir, "documents"), fold(7) != 2)
    return scored.withColumn("held_out", F.coalesce(fold(7) == 2, F.lit(False)))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_join.near(table(spark, sf_dir, "embeddings"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicate(table(spark, sf_dir, "documents"))


def op8_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeats(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"), repo_col="doc_id", owner_col="source")


def op11_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.export(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_tree(table(spark, sf_dir, "conversations"), shared=(20, 4))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_toxicity, op3_decontamination, op4_lm_score, op5_embedding_dedup, op6_suffix_dedup, op7_minhash, op8_paragraph_dedup, op9_pii, op10_secrets,
    op11_token_records, op12_spelling, op13_prefix_trie, pipeline)}

ORACLES = {
    "op5_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
  e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id""",
    "op6_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, c, h[400 * c + 1:400 * c + 498] AS p FROM (SELECT doc_id, h, unnest(range(length(h) // 400 + 1)) AS c FROM d)),
w AS (SELECT doc_id, 200 * c + i AS i, p[2 * i + 1:2 * i + 100] AS g FROM (SELECT *, unnest(range(least(200, length(p) // 2 - 49))) AS i FROM p)),
low AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
hit AS (SELECT doc_id, i FROM w JOIN low USING (g) WHERE low < doc_id),
new AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM new) GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
cut AS (
  SELECT d.doc_id, any_value(h) AS h, coalesce(sum(b - a), 0)::BIGINT AS n_removed, count(a) AS n_spans, coalesce(string_agg(h[2 * before + 1:2 * a], '' ORDER BY a), '') AS head, coalesce(max(b), 0) AS last
  FROM d LEFT JOIN gap ON gap.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(head || h[2 * last + 1:])) AS kept_sha256 FROM cut""",
    "op7_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(low.b, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(low.b, s.doc_id)) AS kept
FROM s LEFT JOIN low ON low.a = s.doc_id""",
    "op12_spelling": r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), i::BIGINT)) AS t),
runs AS (
  SELECT id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (
  SELECT w, n, xor(4294967295, list_reduce(flatten(list_transform(string_split(id || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS h
  FROM runs, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN w[1:(h % length(w))] || w[(h % length(w)) + 2:] ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS (SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS k FROM words)),
near AS (
  SELECT DISTINCT * FROM (
    SELECT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT a.word, b.word, b.n FROM gone a JOIN words b ON a.rest = b.word
    UNION ALL SELECT b.word, a.word, a.n FROM gone a JOIN words b ON a.rest = b.word)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, {'n': -n, 'word': other}) AS other, max(n) AS top FROM near GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.top >= 5 * w.n THEN b.other END AS form, CASE WHEN b.top >= 5 * w.n THEN b.top END::BIGINT AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS at, form AS next FROM formed UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL""",
    "op13_prefix_trie": r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT c, c - c % 20 AS base, xor(4294967295, list_reduce(list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda a, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(a, b)), 4294967295::BIGINT)) % 4 AS h
  FROM (SELECT DISTINCT c FROM t)),
held AS (SELECT c AS base, count(*) AS n FROM t GROUP BY c),
r AS (
  SELECT i.c, t.pos, role, text FROM ids i JOIN t ON t.c = i.base AND t.pos < i.h
  UNION ALL
  SELECT i.c, t.pos - i.h + least(i.h, coalesce(held.n, 0)), role, text FROM ids i JOIN t ON t.c = i.c AND t.pos >= i.h LEFT JOIN held ON held.base = i.base),
s AS (SELECT ids.c, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS turns FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
p AS (SELECT c, turns, unnest(range(len(turns) + 1)) AS d FROM s),
nodes AS (
  SELECT turns[1:d] AS k, d, min(c) AS conv_id, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(any_value(turns[d].text), '[^\x20\x09-\x0D]+')) END AS words,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(turns) = d), '')) AS ends_sha256
  FROM p GROUP BY turns[1:d], d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
whole AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM nodes n LEFT JOIN kids ON kids.k = n.k),
sub AS (
  SELECT a.k, sum((b.n - 1) * b.words)::BIGINT AS saved, count(*) FILTER (b.n_children = 0) AS leaves
  FROM whole a JOIN whole b ON b.d >= a.d AND b.k[1:a.d] = a.k GROUP BY a.k)
SELECT a.conv_id, a.d AS depth, up.conv_id AS parent_conv_id, a.n AS n_convs, a.n_children, sub.leaves AS n_leaves, sub.saved AS saved_tokens, a.ends_sha256
FROM whole a JOIN sub ON sub.k = a.k LEFT JOIN nodes up ON a.d > 0 AND up.d = a.d - 1 AND up.k = a.k[1:a.d - 1]""",
}
