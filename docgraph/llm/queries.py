"""The registered queries of this package and their SQL, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .class_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_windows

    return repeated_windows(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cnn_quality import score_documents, train

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import near_components

    return near_components(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import format_conversations, read_back

    role = F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int"))
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(rows))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, with_crc, write_tokens

    path = scratch(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return with_crc(read_tokens(spark, path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_class_lm": op2_class_lm,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_chat_format": op8_chat_format,
    "op9_nearest": op9_nearest,
    "op10_token_files": op10_token_files,
}

ORACLE: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, row_number() OVER () AS r FROM documents),
s AS (SELECT r, doc_id, unnest(range(1, len(words) - 18)) AS p, words FROM d WHERE len(words) >= 20),
w AS (SELECT r, p, row_number() OVER (PARTITION BY array_to_string(list_slice(words, p, p + 19), ' ') ORDER BY doc_id NULLS FIRST, p) > 1 AS again FROM s),
g AS (SELECT r, list(p) AS starts FROM w WHERE again GROUP BY r),
c AS (SELECT r, list_distinct(flatten(list_transform(starts, lambda x: range(x, x + 20)))) AS gone FROM g),
k AS (SELECT d.doc_id, d.words, coalesce(c.gone, []) AS gone FROM d LEFT JOIN c USING (r))
SELECT doc_id, len(words)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(CASE WHEN len(gone) = 0 THEN array_to_string(words, ' ') ELSE array_to_string(list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM k""",
    "op7_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, list_distinct(CASE WHEN len(w) < 5 THEN (CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE [array_to_string(w, ' ')] END)
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END) AS shingles FROM d),
k AS (SELECT r, doc_id, len(shingles) AS n, sha256(array_to_string(list_sort(shingles), chr(10))) AS name, shingles FROM g),
u AS (SELECT name, any_value(n) AS n, any_value(shingles) AS shingles FROM k WHERE n > 0 GROUP BY name),
x AS (SELECT name, n, unnest(shingles) AS shingle FROM u),
p AS (SELECT a.name AS one, b.name AS two FROM x a JOIN x b ON a.shingle = b.shingle AND a.name <> b.name AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.name, b.name HAVING 7 * count(*) >= 3 * (any_value(a.n) + any_value(b.n))),
l AS (SELECT name AS one, name AS two FROM u UNION SELECT l.one, p.two FROM l JOIN p ON l.two = p.one),
c AS (SELECT l.one AS name, min(k.doc_id) AS least FROM l JOIN k ON k.name = l.two GROUP BY l.one)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, CASE WHEN k.n = 0 THEN k.doc_id ELSE coalesce(c.least, k.doc_id) END AS component_id FROM k LEFT JOIN c ON c.name = k.name AND k.n > 0""",
    "op4_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
    "op8_chat_format": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(text, '(?m)^(\\*(?:###|</turn>))', '\\\1', 'g') AS escaped FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### Role: ' || role || chr(10) || escaped || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_nearest": r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, level LIMIT 1) * weight, cap)) AS target FROM r),
m AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM m)
SELECT doc_id, size, source_size, target, copies, size * copies AS taken FROM c""",
}
