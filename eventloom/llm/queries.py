"""The registered queries of the operators of this folder, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import (
    byte_bpe,
    collocations,
    conversation_repair,
    deleted_interpolation,
    language_id,
    near_duplicates,
    neighbours,
    packing,
    private_data,
    quality_rules,
    secret_scan,
    substring_dedup,
    token_counts,
)
from eventloom.llm.common import id_remainder, table

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_50k.tiktoken"


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    lm, rest = deleted_interpolation, id_remainder("doc_id", 10)
    part = F.when(rest == 0, lm.HELD_OUT).when(rest == 1, lm.DELETED).otherwise(lm.MAIN)
    out = lm.score(table(spark, sf_dir, "documents"), part)
    return out.select("doc_id", (F.col("part") == lm.HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), 4096, budgets=(4096,), keep=1 << 18)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", F.col("cuts")[0].alias("cut_4096"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = id_remainder("doc_id", 4) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(~held))
    found = language_id.predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).select("doc_id", "text", "held_out"), model)
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "rejected")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


def op8_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.find(table(spark, sf_dir, "documents"), private_data.default_field())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, space_starts=True)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


_ALL = (
    op1_deleted_interpolation,
    op2_best_fit_packing,
    op3_neighbours,
    op4_token_counts,
    op5_language_id,
    op6_near_duplicates,
    op7_quality_rules,
    op8_private_data,
    op9_substring_dedup,
    op10_byte_bpe,
    op11_conversation_repair,
    op12_secret_scan,
    op13_collocations,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


#: Windows by hash, those that start twice, the words under them, what is left.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 33, 1))) AS i FROM d),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS k FROM w),
r AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h SEMI JOIN r USING (k)),
x AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(list_filter(ws, lambda v, p: NOT list_contains(coalesce(gone, []), p)), ' ')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""


#: All phrases of five words or fewer counted, cut and compared by joins.
OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, 'und') AS lang,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM w GROUP BY lang),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS m FROM s),
f AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, m, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
e AS (SELECT k.lang, k.phrase, k.m, k.a, k.k, l.f AS l, r.f AS r, n.n, 1000 * k.a * n.n // (l.f * r.f) AS score FROM k
    JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1 : k.k], ' ')
    JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1 :], ' ')
    JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
x AS (SELECT lang, ws, m, a, unnest(range(1, m)) AS i FROM c WHERE m > 2),
y AS (SELECT lang, ws, m, a, i, unnest(range(i + 1, m + 1)) AS j FROM x),
z AS (SELECT lang, array_to_string(ws[i : j], ' ') AS phrase, max(a) AS longer FROM y WHERE j - i + 1 < m GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN z USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM o)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
    CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM q WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_substring_dedup": OP9_SQL, "op13_collocations": OP13_SQL}
