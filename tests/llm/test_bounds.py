"""What must stay bounded or whole whatever the ids, sizes and scripts of texts are."""

import collections
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe, collocations, language_id, near_duplicates, neighbours, packing, token_counts
from eventloom.llm.common import LONGEST_KEPT, Memo, n_blocks, written

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("one_id", [5, None, 9])
def test_no_language_is_lost_or_collected_whole(spark, one_id):
    """20,000 rows of one id (or none) beside 3,000 of another language."""
    english = spark.range(3000).select("id", F.concat(F.lit("the word number "), F.col("id").cast("string"), F.lit(" of it all")).alias("text"), F.lit("en").alias("lang"))
    french = spark.range(20000).select(F.lit(one_id).cast("long").alias("id"), F.concat(F.lit("le mot numéro "), F.col("id").cast("string"), F.lit(" de cela")).alias("text"), F.lit("fr").alias("lang"))
    rows = english.union(french).withColumnRenamed("id", "doc_id")
    model = language_id.fit(rows, slices=50)
    assert list(model.dictionaries) == ["fr", "en"]
    words = {k: v.count("mot".encode() if k == "fr" else b"word") for k, v in model.dictionaries.items()}
    assert words == {"fr": 50, "en": 50}
    found = language_id.predict(rows, model).groupBy("row.lang", "lang_pred").count().collect()
    assert {(r.lang, r.lang_pred) for r in found} == {("en", "en"), ("fr", "fr")}


def test_one_text_repeated_is_drawn_once_a_row(spark):
    rows = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"), F.lit("xx").alias("lang"))
    assert language_id.fit(rows, slices=20).dictionaries["xx"].count(b"same") == 20


def test_blocks_go_by_text_and_not_by_stored_bytes(spark):
    """20,000 rows of one text of 21 kB, which Parquet stores in a few kB, make many blocks."""
    text = "some words of a text that is there again and again, " * 400
    rows = written(spark.range(20000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text")))
    n = n_blocks(rows)
    assert n > 55 and n * (7 << 20) >= 20000 * len(text)
    assert n_blocks(rows.limit(0)) == 2
    assert n_blocks(spark.createDataFrame([(None,)] * 5, "text string")) == 2


def test_tables_of_words_are_bounded_in_bytes():
    memo = Memo(len, 4, LONGEST_KEPT)
    assert [memo["a" * n] for n in (3, 64, 65, 10000)] == [3, 64, 65, 10000] and max(map(len, memo)) == 64
    sp, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(2)
    lines = ["".join(chr(r.randint(0x4E00, 0x9FA5)) for _ in range(1000)) for _ in range(20)]
    c = token_counts.PrefixCounter(PIECES, 1 << 10)
    for text in (*lines, "\n".join(lines), "x" * 5000 + " " + lines[0]):
        assert c.count(text) == len(sp.encode(text))
        assert len(sp.encode(text[: c.cut(text, 50)])) <= 50
    assert max(len(k) for m in (c.stored, c.by_segment, c.by_word) for k in (*m, "")) <= LONGEST_KEPT + 1
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, True, 1 << 10)
    for text in lines:
        assert bpe.decode(bpe.encode(text)) == text
    assert max((len(k) for k in (*bpe.matched, "")), default=0) <= LONGEST_KEPT


def test_new_words_are_counted_side_by_side(monkeypatch):
    """Words that no table holds don't cost a pass each, and counts stay the library's."""
    sp, r = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(4)
    word = lambda: "".join(r.choice(("an", "Th", "ore", "é", "ß", "x", ".", "9", "(", "qu")) for _ in range(r.randint(1, 9)))
    texts = [" ".join(word() + "\n" * (r.random() < 0.1) + word() for _ in range(40)) for _ in range(60)]
    odd = [None, "", " ", "\n", "\n\n a", " two  spaces ", "a\u2581b", "\U0001f642 \u4e00x\U0001f642", "y" * 200, "y" * 63 + " " + "z" * 64 + "\n" + "w" * 65, "a\r\n\tb \x00"]
    c, calls = token_counts.PrefixCounter(PIECES), []
    plain = c.prefixes
    monkeypatch.setattr(c, "prefixes", lambda s: calls.append(s) or plain(s))
    assert c.counts(texts) == [len(sp.encode(t)) for t in texts] and not calls
    assert c.counts(odd) == [len(sp.encode(t or "")) for t in odd]
    few = token_counts.PrefixCounter(PIECES, 1 << 6)  # tables and slots that forget
    few.abreast = token_counts.Abreast(few.names, few.pairs.__getitem__, 4)
    assert few.counts(texts) == [len(sp.encode(t)) for t in texts]
    parts = sorted({w for t in texts for w in t.split()} - {""})
    assert c.abreast.counts(parts) == [c.prefixes(w)[-1] for w in parts]


@pytest.mark.parametrize("n", [3, 1000, 1 << 20, 1 << 31, 1 << 40])
def test_suffixes_are_sorted_by_ties_alone(n, monkeypatch):
    """Only rows that the first key leaves tied are sorted again."""
    r = np.random.default_rng(1)
    columns = r.integers(0, min(n, 9), (5, 2000)) * (n // min(n, 9))
    columns[:, 1000:] = r.integers(0, n, (5, 1000))
    again = []
    plain = np.lexsort
    monkeypatch.setattr(collocations.np, "lexsort", lambda keys: again.append(len(keys[0])) or plain(keys))
    rows = columns[:, collocations._order(columns, n)].T.tolist()
    assert rows == sorted(columns.T.tolist()) and sum(again) <= 1100 + 1000 * (n < 9)
    assert collocations._order(columns[:, :0], n).tolist() == []


@pytest.mark.parametrize("n_words", [40, 100_000])
def test_packed_suffixes_come_back(n_words):
    words = np.array([b"\n", b"", *(b"w%d" % i for i in range(n_words - 2))], object)
    columns = np.random.default_rng(2).integers(2, 30, (5, 50)).astype(np.int32)
    columns[3:, ::3] = 0
    columns[0, 0] = n_words - 1
    for some in (columns, columns[:3, 1:2]):
        names, at, counts = collocations._unpacked(collocations._packed(words, some, np.arange(some.shape[1])))
        assert [[([b"\n", *names])[i] for i in c] for c in at.tolist()] == [[words[i] for i in c] for c in some.tolist()]
        assert counts.tolist() == list(range(some.shape[1])) and len(set(names)) == len(names) == len(set(some[some > 0].tolist()))


def test_a_word_and_its_end_mark_are_looked_up_as_two_matches(monkeypatch):
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, True)
    plain = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text in ("a Wordx. wordy, \u00e9t\u00e9! b.. c' d's. e\u0301. \u01c5?", "x \u00aa. \u2160. 9. \u0e01\u0e33. q\u200d. don't.", "a b .", "a . b", "a b.\u00a0 c", "z .: y:"):
        assert bpe.encode(text) == plain.encode(text)
    calls, split = [], bpe.split
    monkeypatch.setattr(bpe, "split", lambda s: calls.append(s) or split(s))
    assert bpe.encode("Some wordsq. thatq, endq!") == plain.encode("Some wordsq. thatq, endq!") and calls == ["Some"]


def test_chunks_are_refused_for_other_patterns(spark):
    assert public_tokenizers.PATTERN in byte_bpe.SPACE_STARTS
    other = r"\S+\s?|\s+"  # the space belongs to the word before
    with pytest.raises(ValueError, match="SPACE_STARTS"):
        byte_bpe.ByteBpe(RANKS, other, True)
    docs = spark.createDataFrame([(1, "one two  three"), (2, "four")], "doc_id long, text string")
    want = byte_bpe.ByteBpe(RANKS, other)
    rows = packing.pack_sequences(docs, RANKS, other, (8, 64)).collect()
    ids = {d: r.ids[s:e] for r in rows for d, s, e in zip(r.doc_ids, r.starts, [*r.starts[1:], len(r.ids)], strict=True)}
    assert ids == {1: want.encode("one two  three"), 2: want.encode("four")}


def test_pieces_of_equal_length_are_packed_by_id_and_piece(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (3, 1, 2)], "doc_id long, text string")
    assert [r.doc_ids for r in packing.pack_sequences(docs, RANKS, public_tokenizers.PATTERN, (64,)).collect()] == [[1, 2, 3]]


def test_a_group_of_sequences_is_held_once_without_what_cut_it(monkeypatch):
    """Beside its packed ids a group takes a fraction of them, and the tables of words are gone."""
    monkeypatch.setattr(packing, "_LIBRARY", {(RANKS, ""): None})
    r = np.random.default_rng(6)
    lengths = r.integers(1, 8193, 1600)
    ids = [r.integers(0, 50000, n).astype("<u2") for n in lengths]

    def batches():
        for at in range(0, 1600, 400):
            part = slice(at, at + 400)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + 400)), pa.array(np.zeros(400, np.int64)), pa.array(lengths[part]), pa.array([x.tobytes() for x in ids[part]])], names=["doc_id", "piece", "n_tokens", "ids"])

    group = lambda: packing._sequences(7 << 32, batches(), packing.CAPACITIES, packing.OVERHEAD, packing.QUADRATIC, 1 << 16)
    seen = {}
    for row in (row for b in group() for row in b.to_pylist()):
        assert row["bin_id"] == (7 << 32) + len(seen) and len(row["ids"]) == row["n_tokens"] <= row["bin_capacity"]
        seen[row["bin_id"]] = [(d, row["ids"][s:e]) for d, s, e in zip(row["doc_ids"], row["starts"], [*row["starts"][1:], row["n_tokens"]], strict=True)]
    assert {d: x for found in seen.values() for d, x in found} == {i: x.tolist() for i, x in enumerate(ids)}
    packed, most, floor = 2 * int(lengths.sum()), 0, pa.total_allocated_bytes()
    tracemalloc.start()
    for b in group():
        assert len(b.column("ids").flatten()) <= (1 << 16) + 8192 and not packing._LIBRARY
        most = max(most, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes() - floor)
    tracemalloc.stop()
    assert most < 2 * packed


def test_near_duplicates_with_clashing_names(docs, clashing):
    key = lambda d: collections.Counter(map(str, near_duplicates.near_duplicates(d).select("doc_id", "class_id", "n_copies").collect()))
    assert key(docs) == key(clashing)


@pytest.mark.parametrize("members", [200, 1000])
def test_links_of_a_large_group_are_about_one_a_member(spark, members):
    """Each of a group's members is alike to twelve hubs, each of which is alike to others of them."""
    name = lambda i: i.to_bytes(16, "big")
    pairs = [(i, h) for i in range(12, members) for h in range(12) if (i + h) % 3] + [(h, h - 1) for h in range(5, 12)]
    pairs += [(5000 + i, 5001 + i) for i in range(6)] + [(6001, 6000), (6001, 6002), (6003, 6002)]
    edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "node binary, hub binary")
    fewer = [(int.from_bytes(r.node), int.from_bytes(r.hub)) for r in near_duplicates._fewer(edges).collect()]
    assert len(fewer) <= members + 12 * 12 + 9 and len(pairs) > 7 * (members - 12)
    group = lambda found: {frozenset(c) for c in components(found)}
    assert group(fewer) == group(pairs)
    names = edges.select("node").union(edges.select("hub")).distinct().select("node", F.col("node").alias("name"))
    got = collections.defaultdict(set)
    for r in near_duplicates.classes(edges, names).collect():
        got[r.label.name].add(int.from_bytes(r.node))
    assert {frozenset(c) for c in got.values()} == group(pairs)


def components(pairs):
    top = {v: v for p in pairs for v in p}

    def find(v):
        while top[v] != v:
            v = top[v]
        return v

    for a, b in pairs:
        top[find(a)] = find(b)
    found = collections.defaultdict(set)
    for v in top:
        found[find(v)].add(v)
    return found.values()


def test_probes_grow_with_functions():
    assert [neighbours.functions_for(n) for n in (2000, 23_000, 23_400, 186_000, 1_500_000)] == [8, 8, 9, 10, 11]
    assert [neighbours.probes_for(f) for f in (7, 8, 9, 10, 11)] == [100, 100, 180, 324, 583]


@pytest.mark.parametrize(("n", "functions"), [(6000, 8), (6000, 9)])
def test_recall_behind_the_first_switch(spark, n, functions):
    """Vectors without structure, with the functions and probes of this size and the next."""
    x = np.random.default_rng(3).standard_normal((n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 150 == 0, functions=functions).collect():
        found[r.query_id].add(r.vec_id)
    hits = 0
    for q, got in found.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got & set(np.argsort(d)[:10].tolist()))
    assert len(found) == n // 150 and hits >= 0.92 * 10 * len(found)
