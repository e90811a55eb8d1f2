"""The pipeline against plain versions of its stages."""

import collections
import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_operators import plain_classes, plain_removals, words  # noqa: F401

from eventloom.llm import language_id, packing, private_data
from eventloom.llm.byte_bpe import read_ranks


def test_stages_keep_columns_and_match_plain_versions(spark, docs, tmp_path):
    docs = docs.dropDuplicates(["doc_id"])
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "substring_dedup", "pii", "packing"]
    steps = dict(corpus_pipeline.STAGES)

    first = spark.createDataFrame(steps["language_id"](spark, docs, "").collect(), docs.schema)
    assert first.columns == docs.columns
    rejected = {r.row.doc_id for r in language_id.predict(docs, language_id.fit(docs)).where("rejected").collect()}
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == {r.doc_id for r in docs.collect()} - rejected
    assert all(r.lang for r in rows.values())

    second = spark.createDataFrame(steps["near_dedup"](spark, first, "").collect(), docs.schema)
    kept = {r.doc_id: r.text for r in second.collect()}
    assert set(kept) == set(plain_classes({i: r.text for i, r in rows.items()}).values())

    third = spark.createDataFrame(steps["substring_dedup"](spark, second, "").collect(), docs.schema)
    items = list(kept.items())
    want = {i: n - gone for (i, _), (n, gone, _) in zip(items, plain_removals([t for _, t in items], 35), strict=True)}
    assert {r.doc_id: len(words(r.text)) for r in third.collect()} == want
    assert all(r.n_chars == len(r.text) for r in third.collect())

    fourth = spark.createDataFrame(steps["pii"](spark, third, "").collect(), docs.schema)
    assert fourth.columns == docs.columns
    for r in fourth.collect():
        assert private_data.pattern_spans(r.text) == [] and r.n_chars == len(r.text)

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    parts = collections.defaultdict(list)
    for b in steps["packing"](spark, fourth, "").collect():
        assert b.bin_capacity in packing.CAPACITIES and len(b.ids) == b.n_tokens <= b.bin_capacity
        for i, at, first, last in zip(b.doc_ids, b.token_starts, b.starts, [*b.starts[1:], b.n_tokens], strict=True):
            parts[i].append((at, b.ids[first:last]))
    got = {i: [t for _, ids in sorted(p) for t in ids] for i, p in parts.items()}
    assert got == {r.doc_id: ids for r in fourth.collect() if (ids := lib.encode_ordinary(r.text))}


def test_run_reads_the_table(spark, docs, tmp_path):
    docs.dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["bin_id", "bin_capacity", "n_tokens", "doc_ids", "token_starts", "starts", "ids"]
    assert out.count() > 0


def test_operators_swallow_no_import_errors():
    for name in ("corpus_pipeline.py",):
        with open(corpus_pipeline.__file__.replace("corpus_pipeline.py", name)) as f:
            assert not re.search(r"except (ImportError|ModuleNotFoundError)", f.read())
