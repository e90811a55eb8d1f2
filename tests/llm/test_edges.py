"""Nulls, clashing names, ties, repeated rows and long words, for the operators and queries."""

import collections
import re
import zlib

import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe, deleted_interpolation, language_id, neighbours, private_data, quality_rules, queries, substring_dedup, token_counts
from eventloom.llm.common import id_remainder

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
NAMES = ("block", "bucket", "keys", "n_tokens", "mark", "kept", "row", "score", "spans", "part", "ids", "unit", "key", "lang_pred")


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, repeated rows, an empty text and words and runs of 60,000 characters."""
    long = "a" * 60000
    rows = [(None, "the end of it", "en"), (None, "the end of it", "en"), (1, None, "en"), (2, "", "de"), (3, "the end of it all", None), (3, "the end of it all", None), (4, f"{long} 1{long}@x.de {'7' * 60000}", "en"), (5, "ab" * 30000 + "\n" * 60000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in NAMES:
        df = df.withColumn(name, F.lit("x"))
    return df


RUNS = {
    "op1": lambda d: deleted_interpolation.score(d, F.when(id_remainder("doc_id", 10) == 0, deleted_interpolation.HELD_OUT).otherwise(deleted_interpolation.MAIN)),
    "op4": lambda d: token_counts.token_counts(d, PIECES, budgets=(4,)),
    "op4 table": lambda d: token_counts.prefix_table(d, PIECES),
    "op5": lambda d: language_id.predict(d, language_id.fit(d)).select("row.doc_id", "lang_pred", "score"),
    "op7": lambda d: quality_rules.judge(d),
    "op8": lambda d: private_data.find(d, private_data.default_field()),
    "op9": lambda d: substring_dedup.removals(d),
    "op10": lambda d: byte_bpe.round_trip(d, RANKS, public_tokenizers.PATTERN, space_starts=True),
}


@pytest.mark.parametrize("name", RUNS)
def test_every_row_has_its_result(odd, name):
    out = [r.asDict() for r in RUNS[name](odd).collect()]
    assert collections.Counter(r["doc_id"] for r in out) == collections.Counter(r.doc_id for r in odd.collect())
    for i in (None, 3):  # repeats have equal results, but for the one whose copy is kept
        same = [{k: v for k, v in r.items() if k != "kept"} for r in out if r["doc_id"] == i]
        assert same[0] == same[1]


@pytest.mark.parametrize("name", RUNS)
def test_extra_columns_change_nothing(odd, docs, clashing, name):
    key = lambda df: sorted(map(str, df.collect()))
    if name != "op1":
        assert key(RUNS[name](odd)) == key(RUNS[name](odd.select("doc_id", "text", "lang")))
    assert RUNS[name](clashing).count() == docs.count()


def test_long_words_are_found_and_encoded_whole(odd):
    out = {r.doc_id: r for r in private_data.find(odd, private_data.default_field()).collect()}
    assert out[4].n_email == 1 and "email:60001:120007" in out[4].spans
    text = {r.doc_id: r.text for r in odd.collect()}[5]
    bpe = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert bpe.decode(bpe.encode(text)) == text


def test_neighbours_with_clashing_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    other = df
    for name in (*NAMES, "vector", "v", "asks", "query_id", "group", "form", "rank"):
        other = other.withColumn(name, F.lit("x"))
    found = lambda d: sorted(map(str, neighbours.nearest(d, F.col("vec_id") % 20 == 0).collect()))
    assert found(df) == found(other)


def test_functions_grow_with_the_table():
    assert [neighbours.functions_for(n) for n in (0, 1, 2000, 8192, 10256, 51282, 8 * 51282)] == [8, 8, 8, 8, 8, 9, 10]


def test_folds_are_those_of_crc32(spark):
    ids = [*range(200), -1, 10**12, None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for n in (4, 10):
        assert {r.doc_id: r.r for r in df.select("doc_id", id_remainder("doc_id", n).alias("r")).collect()} == {i: zlib.crc32(("" if i is None else str(i)).encode()) % n for i in ids}


def test_language_is_that_of_the_smallest_sum_of_blocks(docs, texts):
    model = language_id.fit(docs)
    plain = {}
    for language, content in model.dictionaries.items():
        how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=3, target_length=16, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        plain[language] = zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    for r in language_id.predict(docs, model).collect():
        text = r.row.text
        if text and re.search(r"[^\W\d_]", text):
            data = re.sub(r"[\W\d_]+", " ", text.lower()).encode()
            size = {k: sum(len(c.compress(data[i : i + model.block])) for i in range(0, len(data), model.block)) for k, c in plain.items()}
            assert size[r.lang_pred] == min(size.values())


def test_ties_of_language_go_to_the_one_with_more_rows(spark):
    rows = [(i, "same words in both of them", "b" if i % 3 else "a") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    twin = language_id.LanguageModel({"b": model.dictionaries["b"], "a": model.dictionaries["b"]})
    assert list(model.dictionaries) == ["b", "a"]
    assert {(r.lang_pred, r.score <= 0.5, r.rejected) for r in language_id.predict(df, twin).collect()} == {("b", True, True)}


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    df = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 3"):
        language_id.fit(df)


def test_contracts_of_columns(spark):
    want = {
        "op1_deleted_interpolation": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
        "op3_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
        "op4_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
        "op5_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op8_private_data": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op9_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op10_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(queries.queries()[name](spark, "/root/testdata/sf0.001").dtypes).items()
