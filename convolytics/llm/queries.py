"""The operators as named queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from convolytics.llm import (
    ann, collocations, decontamination, dedup, jaccard, langid, packing, quality, sharding, token_counts, toxicity, warc, whitening,
)
from convolytics.llm.common import crc_mod, read_table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), TOKENIZER, max_len=4096, end_id=1)


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    queries = vectors.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"))
    return ann.search(ann.build_index(vectors), queries, k=20)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, labels, allowed=~held_out)
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.fit(docs, allowed=~held_out)
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"), num=90, den=100, words=3)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    scored = toxicity.score(docs, labels, allowed=~held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "evidence"
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    placed = sharding.uniform_shards(rows, shards=16)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), scale=256, components=4, weights="one")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_nn_descent": op2_nn_descent,
    "op3_quality": op3_quality,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_toxicity": op9_toxicity,
    "op10_sharding": op10_sharding,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_collocations": op12_collocations,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    # exact neighbours: at this scale a leaf of the index holds every vector
    "op2_nn_descent": """
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id,
      list_reduce(list_prepend(0.0::DOUBLE, list_transform(generate_series(1, len(q.embedding)),
        lambda i: q.embedding[i]::DOUBLE * c.embedding[i]::DOUBLE)), lambda a, b: a + b) AS score
    FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id AND len(c.embedding) = len(q.embedding)
    WHERE q.vec_id % 20 = 0
  )
) WHERE rank <= 20""",
    # the join of all shingles; component_id by following links to the end
    "op8_ngram_jaccard": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS both_n, count(*) AS common
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id
), links AS (SELECT a, b FROM shared WHERE 100 * common >= 90 * (both_n - common)),
reached AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION
  SELECT l.b, r.root FROM reached r JOIN links l ON l.a = r.doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM sets s JOIN reached r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.s""",
    "op7_warc": """
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < latest THEN latest END AS refers_to
FROM (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS latest
  FROM pages
)""",
    "op12_collocations": """
WITH RECURSIVE pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
phrases AS (
  SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM (
    SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: w[i : i + k - 1])) AS g
    FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k
  ) GROUP BY ALL HAVING count(*) >= 100
), longer AS (
  SELECT p.lang, unnest([array_to_string(p.g[1 : p.k - 1], ' '), array_to_string(p.g[2 : p.k], ' ')]) AS phrase, p.f FROM phrases p WHERE p.k > 2
), candidates AS (
  SELECT * FROM phrases p WHERE k >= 2 AND NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = p.lang AND x.phrase = p.phrase AND x.f >= p.f)
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, t.n,
    (1000 * CAST(c.f AS HUGEINT) * CAST(t.n AS HUGEINT)) // (CAST(l.f AS HUGEINT) * CAST(r.f AS HUGEINT)) AS score
  FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM candidates) c
  JOIN totals t ON t.lang = c.lang
  JOIN phrases l ON l.lang = c.lang AND l.phrase = array_to_string(c.g[1 : c.j], ' ')
  JOIN phrases r ON r.lang = c.lang AND r.phrase = array_to_string(c.g[c.j + 1 : c.k], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000""",
    "op13_exact_dedup": """
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
) WINDOW same AS (PARTITION BY text_sha256)""",
}
