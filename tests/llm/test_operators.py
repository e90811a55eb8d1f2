"""The ten operators against plain versions of what they compute."""

import collections
import hashlib
import json
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from eventloom.llm import byte_bpe, deleted_interpolation, language_id, near_duplicates, neighbours, packing, private_data, quality_rules, substring_dedup, token_counts

PIECES, RANKS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# ---- token counts ---------------------------------------------------------------------


def test_token_counts_equal_the_library(docs, texts, nothing, clashing):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = token_counts.token_counts(docs, PIECES, 50)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == docs.count()
    found = by_id(out)
    for i, t in enumerate(texts):
        n = len(sp.encode(t or ""))
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), n, n > 50)
    assert token_counts.token_counts(nothing, PIECES).count() == 0
    assert token_counts.token_counts(clashing, PIECES).count() == docs.count()


def test_prefix_counts_are_exact_at_every_cut():
    sp, c = sentencepiece.SentencePieceProcessor(model_file=PIECES), token_counts.counter(PIECES)
    r = random.Random(1)
    for _ in range(60):
        s = "".join(r.choice("ab eéß▁\n  \t你🙂 the.1") for _ in range(r.randrange(40)))
        counts = c.prefix_counts(s)
        assert counts.tolist() == [len(sp.encode(s[:i])) for i in range(len(s) + 1)]
        cut = token_counts.longest_prefix(counts, 5)
        assert [c.cut(s, n) for n in (0, 2, 5, 99)] == [token_counts.longest_prefix(counts, n) for n in (0, 2, 5, 99)]
        assert len(sp.encode(s[:cut])) <= 5 and all(len(sp.encode(s[:i])) > 5 for i in range(cut + 1, len(s) + 1))


def test_prefix_table_answers_cuts_and_budgets(docs, texts):
    out = token_counts.prefix_table(docs, PIECES).select("doc_id", "counts", token_counts.count_of(F.col("counts"), 7).alias("of_7"), token_counts.cut_within(F.col("counts"), 8).alias("in_8"))
    c = token_counts.counter(PIECES)
    for i, r in by_id(out).items():
        t = texts[i] or ""
        assert r.counts == c.prefix_counts(t).tolist() and r.of_7 == r.counts[min(7, len(t))] and r.in_8 == c.cut(t, 8)


def test_models_that_normalise_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PIECES, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="as it is"):
        token_counts.PrefixCounter(str(tmp_path / "m.model"))


def test_line_ends_of_a_model_without_bytes(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PIECES, "rb") as f:
        spec = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    for p in spec.pieces:
        if p.type == 6:  # bytes become ordinary pieces
            p.type = 1
    spec.trainer_spec.byte_fallback = False
    (tmp_path / "m.model").write_bytes(spec.SerializeToString())
    c, sp = token_counts.PrefixCounter(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    for t in ("a\n\nb", "the\nend", "\n", "x \ny"):
        assert c.count(t) == len(sp.encode(t))


def test_cuts_column(docs, texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for i, row in by_id(token_counts.token_counts(docs.where("doc_id < 6"), PIECES, budgets=(8,))).items():
        assert len(sp.encode((texts[i] or "")[: row.cuts[0]])) <= 8


# ---- byte-level encoding --------------------------------------------------------------


def test_encoding_equals_the_library_and_goes_back(docs, texts, nothing):
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank, special_tokens={})
    ids = {r.doc_id: r.ids for r in byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    trip = by_id(byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        want = lib.encode_ordinary(t or "")
        assert ids[i] == want and bpe.decode(want) == (t or "")
        assert trip[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert (trip[i].n_tokens, trip[i].decoded_sha256) == (len(want), hashlib.sha256((t or "").encode()).hexdigest())
    back = {r.doc_id: r.text for r in byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_streams():
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    few = byte_bpe.Transducer(bpe.rank, most_states=20)  # forgets its states in the middle of a run
    r = random.Random(2)
    for _ in range(200):
        s = "".join(r.choice("thearing é你🙂xz1") for _ in range(r.randrange(1, 30)))
        data = s.encode()
        assert list(bpe.fst.stream(data)) == bpe.fst.encode(data) or data in bpe.rank
        assert few.encode(data) == bpe.fst.encode(data)
        raw = bytes(r.randrange(256) for _ in range(9))
        machine = byte_bpe.Utf8Stream()
        assert "".join(machine.feed(raw[i : i + 1]) for i in range(9)) + machine.close() == raw.decode("utf-8", "replace")


def test_tokens_come_after_bounded_lookahead():
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    longest = max(map(len, bpe.rank))
    read, given = 0, 0

    def bytes_of(data):
        nonlocal read
        for byte in data:
            read += 1
            yield byte

    for i in bpe.fst.stream(bytes_of(b"thequickbrownfoxjumpsoverthelazydog" * 40)):
        assert read - given <= 2 * longest
        given += len(bpe.token[i])


def test_chunks_give_what_whole_texts_give(texts):
    bpe, chunks = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN, True, keep=500)
    r = random.Random(8)
    made = ["".join(r.choice(["a", "the", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "é", "你", "1", "'s", ".", "\r\n"]) for _ in range(r.randrange(14))) for _ in range(3000)]
    for t in [*made, *texts]:
        assert chunks.encode(t) == bpe.encode(t)


def test_decoding_any_ids_gives_replacements_as_bytes_do():
    bpe = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    r = random.Random(3)
    for _ in range(500):
        ids = [r.choice((r.randrange(256), r.randrange(50000))) for _ in range(6)]
        raw = b"".join(bpe.token[i] for i in ids)
        assert bpe.decode(ids) == "".join(bpe.decode_stream(ids)) == raw.decode("utf-8", "replace")


# ---- language -------------------------------------------------------------------------


def test_language_is_found_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    out = language_id.predict(docs, language_id.fit(docs.where(~held))).where(F.pmod(F.crc32(F.col("row.doc_id").cast("string").cast("binary")), F.lit(4)) == 2)
    rows = out.select("row.lang", "lang_pred", "score", "rejected").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) / len(rows) < 0.03


def test_language_edges(docs, nothing, clashing):
    model = language_id.fit(docs)
    out = {r.row.doc_id: r for r in language_id.predict(clashing, model).collect()}
    for i, r in out.items():
        text = r.row.text
        if text is None or not re.search(r"[^\W\d_]", text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
    assert language_id.predict(nothing, model).count() == 0
    none = language_id.fit(nothing)
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}


# ---- near duplicates ------------------------------------------------------------------


def grams(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def plain_classes(items):
    """Least id of each connected component of pairs of similarity 0.8 or more."""
    sets, top = {i: grams(t) for i, t in items.items()}, {i: i for i in items}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(items)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_equal_all_pairs(spark, docs, texts, nothing):
    r = random.Random(9)
    base = [f"w{r.randrange(900)}" for _ in range(200)]
    items = dict(enumerate(texts))
    for k in range(30):  # copies each with some words changed
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(200)] = f"n{r.randrange(10**6)}"
        items[1000 + k] = " ".join(w)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in items.items()], docs.schema)
    out = by_id(near_duplicates.near_duplicates(df))
    want = plain_classes(items)
    assert {i: r.class_id for i, r in out.items()} == want
    assert {i for i, r in out.items() if r.kept} == set(want.values())
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_one_of_each_keeps_one_row(docs, clashing):
    out = near_duplicates.one_of_each(clashing)
    assert out.columns == clashing.columns
    kept = [r.doc_id for r in out.collect()]
    assert len(kept) == len(set(kept))
    assert set(kept) == set(plain_classes({r.doc_id: r.text for r in docs.collect()}).values())


def test_repeated_rows_keep_one_and_other_texts_of_an_id_stay(spark):
    a, b = "a b c d e f g h i", "q r s t u v w x y z"
    df = spark.createDataFrame([(5, a), (5, a), (5, b), (5, b), (8, a + " ")], "doc_id long, text string")
    out = near_duplicates.near_duplicates(df).collect()
    assert collections.Counter((r.class_id, r.class_mark) for r in out if r.kept) == {(5, m): 1 for m in {r.class_mark for r in out}}
    assert sorted((r.doc_id, r.text) for r in near_duplicates.one_of_each(df).collect()) == [(5, a), (5, b)]


def test_chains_behind_hubs_lose_no_link(spark):
    # in each group a hub with 40 copies, b near the hub, and a near b alone
    items, groups = {}, 60
    for g in range(groups):
        hub = [f"{g}w{i}" for i in range(604)]
        for k in range(41):
            items[g * 100 + k] = " ".join([*hub[: 14 * k], *([f"{g}c{k}"] if k else []), *hub[14 * k + bool(k) :]])
        near = [*hub[:591], *(f"{g}b{i}" for i in range(13))]
        items[g * 100 + 41] = " ".join(near)
        items[g * 100 + 42] = " ".join([*(f"{g}a{i}" for i in range(58)), *near[58:]])
    like = lambda i, j: near_duplicates.similarity(items[i].encode(), items[j].encode())
    assert like(0, 41) > 0.95 and 0.81 < like(41, 42) < 0.83 and like(0, 42) < 0.8
    df = spark.createDataFrame(list(items.items()), "doc_id long, text string")
    out = near_duplicates.near_duplicates(df).collect()
    assert {r.doc_id: r.class_id for r in out} == {i: i - i % 100 for i in items}


def test_recall_by_similarity(spark):
    # pairs of each likeness that only each other could find
    items, wanted = {}, {}
    for g in range(300):
        n = 104 + g % 5 * 100
        base = [f"{g}w{i}" for i in range(n)]
        for step, changed in enumerate((2, 5, 8, 11)):
            cut = changed * (n - 4) // 100
            i = 2 * (4 * g + step)
            items[i] = " ".join(f"{step}{x}" for x in base)
            items[i + 1] = " ".join([*(f"x{i}_{k}" for k in range(cut)), *(f"{step}{x}" for x in base[cut:])])
            wanted[i] = near_duplicates.similarity(items[i].encode(), items[i + 1].encode())
    assert all(s >= 0.8 for s in wanted.values()) and min(wanted.values()) < 0.81
    out = by_id(near_duplicates.near_duplicates(spark.createDataFrame(list(items.items()), "doc_id long, text string")))
    assert sum(out[i + 1].class_id == i for i in wanted) == len(wanted)


def test_rows_without_id_stay(spark, docs):
    rows = [(None, "a b c d e f", None, None, None)] * 3 + [(1, "a b c d e f", None, None, None), (2, "a b c d e f", None, None, None)]
    out = near_duplicates.one_of_each(spark.createDataFrame(rows, docs.schema))
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, None, None, None]


def test_darts_estimate_weighted_similarity():
    r = np.random.default_rng(3)
    element = np.arange(400, dtype=np.uint64)
    a, b = r.random(400) * 3 + 0.1, r.random(400) * 3 + 0.1
    doc = np.repeat([0, 1], 400)
    s = near_duplicates.dart_signatures(doc, np.tile(element, 2), np.concatenate([a, b]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_crowded_bands_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PART", 8)
    r = random.Random(1)
    sketches = [bytes(r.randrange(256) for _ in range(640)) for _ in range(20)]
    rows = [(1, b"%02d%d" % (i, side), s) for i, s in enumerate(sketches) for side in (0, 1)]
    found = near_duplicates._closest(spark.createDataFrame(rows, "band long, node binary, sketch binary"), 0.8).collect()
    assert {(bytes(x.node), bytes(x.hub)) for x in found} == {(b"%02d0" % i, b"%02d1" % i) for i in range(20)}


def test_shingles_are_the_same_in_slices_of_any_size(texts):
    some = [t.encode() for t in texts if t and len(words(t)) > 20]
    one = near_duplicates.shingles(some[:1])
    for n in (2, 4, len(some)):
        d, h, w = near_duplicates.shingles((some * 256)[: 256 if n == len(some) else n])
        assert np.array_equal(h[d == 0], one[1]) and np.array_equal(w[d == 0], one[2])


def altered(base, start=0, end=0, name=""):
    """base with its first `start` and last `end` words replaced."""
    cut = len(base) - end
    return " ".join([f"{name}s{i}" for i in range(start)] + base[start:cut] + [f"{name}e{i}" for i in range(end)])


def test_families_that_are_alike_are_joined_in_a_block(spark, monkeypatch):
    base = [f"w{i}" for i in range(1004)]
    left = [altered(base, end=26, name=f"a{k}") for k in range(5)]
    right = [altered([*(f"b{i}" for i in range(73)), *base[73:]], end=26, name=f"b{k}") for k in range(5)]
    far = [altered([*(f"c{i}" for i in range(100)), *base[100:]], end=26, name=f"c{k}") for k in range(5)]
    like = lambda a, b: near_duplicates.similarity(a.encode(), b.encode())
    assert like(left[0], left[1]) > 0.94 and 0.8 < like(left[0], right[0]) < 0.83 and like(left[0], far[0]) < 0.8
    texts = dict(enumerate([*left, *right, *far]))
    table = spark.createDataFrame([(b"%02d" % i, t) for i, t in texts.items()], "node binary, text string")
    rows = near_duplicates._finer(table, 5).join(table, "node").select(F.lit(1).cast("long").alias("band"), "node", "sketch", "text")
    want = plain_classes(texts)
    for part in (1024, 4):
        monkeypatch.setattr(near_duplicates, "PART", part)
        links = [(int(x.node), int(x.hub)) for x in near_duplicates._closest(rows, 0.8).collect()]
        assert all(like(texts[a], texts[b]) >= 0.8 for a, b in links)
        top = {i: i for i in texts}
        for _ in texts:
            for a, b in links:
                top[a] = top[b] = min(top[a], top[b])
        assert top == want


def test_rows_alike_to_a_hub_are_compared_with_those_that_are_not(spark, docs):
    # in all bands where the last two meet, some of the first twelve are hubs, at 0.775 from the last
    base = [f"6w{i}" for i in range(1004)]
    core = [[*base[: 200 + 30 * k], *(f"6k{k}_{i}" for i in range(6)), *base[206 + 30 * k :]] for k in range(12)]
    near = [*base[:992], *(f"6u{i}" for i in range(12))]
    items = {i: " ".join(w) for i, w in enumerate([*core, near, [*(f"6t{i}" for i in range(105)), *near[105:]]])}
    like = [near_duplicates.similarity(items[i].encode(), items[13].encode()) for i in range(13)]
    assert max(like[:12]) < 0.8 < like[12]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in items.items()], docs.schema).coalesce(1)
    assert {r.class_id for r in near_duplicates.near_duplicates(df).collect()} == {0}


def test_fine_bands_miss_no_more_than_the_first():
    miss = lambda bands, rows: (1 - near_duplicates.SIMILARITY**rows) ** bands
    assert miss(near_duplicates.FINE_BANDS, near_duplicates.FINE_ROWS) <= miss(near_duplicates.BANDS, near_duplicates.ROWS)


# ---- repeated substrings --------------------------------------------------------------


def plain_removals(items, width):
    seen = collections.Counter()
    for t in items:
        w = words(t)
        seen.update(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    out = []
    for t in items:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [35, 12])
def test_removals_equal_a_count_of_all_windows(docs, nothing, width):
    rows = docs.collect()
    want = collections.Counter((r.doc_id, *x) for r, x in zip(rows, plain_removals([r.text for r in rows], width), strict=True))
    assert collections.Counter(tuple(r) for r in substring_dedup.removals(docs, width).collect()) == want
    assert substring_dedup.removals(nothing, width).count() == 0


def test_equal_windows_have_equal_representatives():
    r = random.Random(4)
    passage = [f"p{r.randrange(50)}" for _ in range(80)]
    sequences = [" ".join([*(f"q{r.randrange(9)}" for _ in range(r.randrange(30))), *passage, *("z" for _ in range(r.randrange(6)))]).encode() for _ in range(20)]
    b = substring_dedup.Block(sequences)
    reps, keys = b.representatives(), b.keys()
    one = {}
    for k, rep in zip(keys.tolist(), reps.tolist(), strict=True):
        assert one.setdefault(k, rep) == rep


def test_texts_lose_what_repeats_and_nothing_else(docs, clashing):
    out = substring_dedup.without_repeats(clashing)
    assert out.columns == clashing.columns
    rows = docs.collect()
    want = collections.Counter((r.doc_id, x[2]) for r, x in zip(rows, plain_removals([r.text for r in rows], 35), strict=True))
    got = collections.Counter((r.doc_id, hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in out.collect())
    assert got == want
    same = {r.doc_id: r.text for r in rows}
    assert all(r.text == same[r.doc_id] for r in out.collect() if len(words(r.text)) == len(words(same[r.doc_id])))


# ---- personal data --------------------------------------------------------------------

PLAIN = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (14 <= len(digits) <= 19 and private_data.luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_equal_plain_ones():
    r = random.Random(6)
    for alphabet in ("12..@a-+ (9%é\n", "1234567890- ", "+12 (3)-.", "ab@.-1"):
        for _ in range(2000):
            t = "".join(r.choice(alphabet) for _ in range(r.randrange(40)))
            assert private_data.pattern_spans(t) == plain_spans(t)
    assert private_data.pattern_spans("1" * 100_000 + "a" * 100_000) == []


def test_field_learns_its_table_and_keeps_patterns(docs, texts, nothing):
    field = private_data.default_field()
    rows = private_data.labelled_table(200, seed=99)
    found = field.decode([w for w, _ in rows])
    right = [private_data.LABELS[x] == y for (_, labels), f in zip(rows, found, strict=True) for x, y in zip(f, labels, strict=True)]
    assert sum(right) / len(right) > 0.98
    out = by_id(private_data.find(docs, field))
    for i, t in enumerate(texts):
        base = [(s, private_data.KINDS[k], e) for s, k, e in plain_spans(t or "")]
        assert out[i].base_sha256 == hashlib.sha256(private_data.digest(base).encode()).hexdigest()
        assert set(private_data.digest(base).split(",")) <= set(out[i].spans.split(",")) or not base
    assert private_data.find(nothing, field).count() == 0


def test_field_finds_what_patterns_do_not():
    field = private_data.default_field()
    for text, kind, found in (
        ("from 2001:0db8:85a3:1:2:8a2e:0370:7334 on", "ip", "2001:0db8:85a3:1:2:8a2e:0370:7334"),
        ("card 4222222222222 ok", "card", "4222222222222"),
        ("pay 4111.1111.1111.1111 now", "card", "4111.1111.1111.1111"),
        ("call (555) 123-4567 ok", "phone", "(555) 123-4567"),
        ("set password=e1c093f22d3955eaac in", "secret", "e1c093f22d3955eaac"),
    ):
        (base, spans), word = private_data.all_spans([text], field)[0], "x" * 120000
        assert not base and [(k, text[s:e]) for s, k, e in spans] == [(kind, found)]
        assert [k for _, k, _ in private_data.all_spans([f"{word} 1{word}\n{text}"], field)[0][1]] == [kind]
    clean = "a::b c++ std::vec 1::2 at 12:30:45, 4111111111111112 and 3.14 of 2024-01-12"
    assert private_data.all_spans([clean], field) == [([], [])]


def test_skipping_inert_lines_changes_nothing():
    field = private_data.default_field()
    assert field.skip_inert
    lines = ["\n".join([" ".join(w) for w, _ in private_data.labelled_table(40, seed=s)] + ["ab Cd EF - xyz"]) for s in range(5)]
    fast = field.spans(lines)
    slow = private_data.Crf(field.index, field.weights, field.moves)
    slow.skip_inert = False
    assert slow.spans(lines) == fast


def test_viterbi_is_the_best_of_all_paths():
    import itertools

    field = private_data.default_field()
    words_ = ["call", "+1", "(555)", "123-4567"]
    grid = field.emissions(words_)
    best = max(itertools.product(range(len(private_data.LABELS)), repeat=4), key=lambda p: sum(grid[t, p[t]] for t in range(4)) + sum(field.moves[p[t - 1], p[t]] for t in range(1, 4)))
    assert field.decode([words_])[0].tolist() == list(best)


def test_redaction(clashing):
    out = {r.doc_id: r.text for r in private_data.redacted(clashing, private_data.default_field()).collect()}
    assert "[PHONE] ok" in out.values() and "mail [EMAIL], [IP]!" in out.values()
    assert private_data.redact("abc", [(0, "ip", 2), (1, "card", 2)]) == "[IP]c"


# ---- quality rules --------------------------------------------------------------------


def test_features_equal_plain_counts(docs, texts, nothing):
    out = by_id(quality_rules.features(docs))
    for i, t in enumerate(texts):
        w, t = words(t), t or ""
        lines = [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
    assert quality_rules.features(nothing).count() == 0


def test_estimation_equals_a_plain_one(spark):
    r = random.Random(8)
    rows = []
    for _ in range(400):
        good = r.random() < 0.8
        rows.append(([(1 if good else -1) * (1 if r.random() < a else -1) if r.random() < 0.7 else 0 for a in (0.9, 0.8, 0.95)],))
    prior, odds = quality_rules.estimate(spark.createDataFrame(rows, "ballot array<int>"), 3, 10)
    counts = collections.Counter(tuple(b) for (b,) in rows)
    p = {b: 0.1 if -1 in b else 0.9 for b in counts}
    for step in range(11):
        good, total = sum(n * p[b] for b, n in counts.items()), sum(counts.values())
        pi = (good + 1) / (total + 2)
        w = [{v: math.log((0.5 + sum(n * p[b] for b, n in counts.items() if b[j] == v)) / (good + 1.5)) - math.log((0.5 + sum(n * (1 - p[b]) for b, n in counts.items() if b[j] == v)) / (total - good + 1.5)) for v in (-1, 1)} for j in range(3)]
        w = [{-1: min(x[-1], 0.0), 0: 0.0, 1: max(x[1], 0.0)} for x in w]
        if step < 10:
            p = {b: 1 / (1 + math.exp(-(math.log(pi / (1 - pi)) + sum(w[j][v] for j, v in enumerate(b))))) for b in counts}
    assert abs(prior - pi) < 1e-9 and np.allclose(odds, [[x[-1], x[0], x[1]] for x in w])


def test_quality_rules_agree_with_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("NOT base_failed").collect() if r.doc_id in labels]
    assert sum(r.kept == bool(labels[r.doc_id]) for r in rows) / len(rows) > 0.97


def test_judging_nothing_and_clashing_names(nothing, clashing):
    assert quality_rules.judge(nothing).count() == 0
    assert quality_rules.judge(clashing).count() == clashing.count()


# ---- language model -------------------------------------------------------------------


def test_scores_equal_a_plain_model(docs, texts, nothing):
    lm = deleted_interpolation
    part = F.when(F.col("doc_id") % 10 == 0, lm.HELD_OUT).when(F.col("doc_id") % 10 == 1, lm.DELETED).otherwise(lm.MAIN)
    rows = docs.collect()
    of = {r.doc_id: (lm.HELD_OUT if r.doc_id % 10 == 0 else lm.DELETED if r.doc_id % 10 == 1 else lm.MAIN) for r in rows}

    def tokens(t):
        return [w.encode().lower() for w in words(t)] + [None]

    def model(parts):
        uni, two = collections.Counter(), collections.Counter()
        for r in rows:
            if of[r.doc_id] in parts:
                w = tokens(r.text)
                uni.update(w)
                two.update(zip(["begin", *w[:-1]], w, strict=True))
        return uni, two

    def estimates(w, uni, two):
        n, v = sum(uni.values()), len(uni)
        out = []
        for h, x in zip(["begin", *w[:-1]], w, strict=True):
            seen = uni[None] if h == "begin" else uni[h]
            out.append((1 / (v + 1), uni[x] / n, two[h, x] / seen if seen else 0.0, int(math.log2(seen + 1))))
        return np.array(out)

    main, whole = model({lm.MAIN}), model({lm.MAIN, lm.DELETED})
    held = np.concatenate([estimates(tokens(r.text), *main) for r in rows if of[r.doc_id] == lm.DELETED])

    def em(f, start):
        w = start
        for _ in range(100):
            s = w * f
            s /= s.sum(1, keepdims=True)
            w = (s.sum(0) + start) / (len(f) + 1)
        return w

    last = overall = em(held[:, :3], np.full(3, 1 / 3))
    weights = []
    for b in range(lm.BUCKETS):
        f = held[held[:, 3] == b][:, :3]
        last = em(f, overall) if len(f) else last
        weights.append(last)
    n, v = sum(whole[0].values()), len(whole[0])
    for r in lm.score(docs, part).collect():
        w = tokens(texts[r.doc_id])
        e = estimates(w, *whole)
        assert (r.part, r.n_tokens, r.n_known, r.train_tokens) == (of[r.doc_id], len(w), sum(whole[0][x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((whole[0][x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert abs(r.score - sum(math.log10((weights[int(x[3])] * x[:3]).sum()) for x in e)) < 0.02 * len(w)
    assert lm.score(nothing, part).count() == 0
    assert lm.score(docs.where("doc_id = 10"), F.lit(lm.HELD_OUT)).count() == 1


def test_variety_does_not_depend_on_length(spark):
    vocabulary = [f"w{i}" for i in range(2000)]
    for few in (20, 2000):
        rows = [(n, " ".join((vocabulary[:few] * (n // few + 1))[:n])) for n in (1990, 19990, 20010, 60000)]
        out = quality_rules.features(spark.createDataFrame(rows, "doc_id long, text string")).select(quality_rules.votes()["variety"].alias("v")).collect()
        assert {r.v for r in out} == {-1 if few == 20 else 1}


def test_estimation_of_documents_equals_a_plain_one(docs):
    table = quality_rules.features(docs)
    rules = quality_rules.votes()
    ballots = table.select(F.array(*rules.values()).alias("ballot"))
    prior, odds = quality_rules.estimate(ballots, len(rules))
    x = np.array([r.ballot for r in ballots.collect()])
    p = np.where((x == -1).any(1), 0.1, 0.9)

    def model(p):
        seen = lambda j, v, w: 0.5 + w[x[:, j] == v].sum()
        weight = lambda j, v: math.log(seen(j, v, p) / (p.sum() + 1.5)) - math.log(seen(j, v, 1 - p) / ((1 - p).sum() + 1.5))
        return (p.sum() + 1) / (len(p) + 2), [[min(weight(j, -1), 0.0), 0.0, max(weight(j, 1), 0.0)] for j in range(len(rules))]

    for _ in range(quality_rules.ITERATIONS):
        q, o = model(p)
        s = np.array([math.log(q / (1 - q)) + sum(o[j][v + 1] for j, v in enumerate(row)) for row in x])
        p = 1 / (1 + np.exp(-s))
    q, o = model(p)
    assert math.isclose(prior, q, rel_tol=1e-9) and np.allclose(odds, o)


# ---- packing --------------------------------------------------------------------------


def test_packing_is_whole_and_tight(spark):
    r = random.Random(3)
    rows = [(i, r.choice([0, 1, 5, 300, r.randrange(1, 9000), 20000])) for i in range(800)] + [(9000, None), (None, 7), (5, 300)]
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    bins = collections.defaultdict(list)
    for p in out:
        bins[p.bin_id].append(p)
    for pieces in bins.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.bin_start):
            assert p.bin_start == at
            at += p.n_tokens
        smallest = min(c for c in packing.CAPACITIES if c >= at)
        assert {p.bin_capacity for p in pieces} == {smallest}
    got = collections.Counter()
    for p in out:
        got[p.doc_id] += p.n_tokens
    want = collections.Counter()
    for i, n in rows:
        want[i] += n or 0
    assert got == +want
    assert sum(p.n_tokens for p in out) / sum(b[0].bin_capacity for b in bins.values()) > 0.97
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_packing_is_near_the_optimum_of_all_partitions():
    def least(lengths):
        """The cheapest partition into bins, by trying every one."""
        best = [math.inf]

        def place(k, held):
            if k == len(lengths):
                best[0] = min(best[0], sum(packing.cost(min(c for c in packing.CAPACITIES if c >= h)) for h in held))
                return
            for b in range(len(held)):
                if held[b] + lengths[k] <= max(packing.CAPACITIES):
                    place(k + 1, [*held[:b], held[b] + lengths[k], *held[b + 1 :]])
            place(k + 1, [*held, lengths[k]])

        place(0, [])
        return best[0]

    r, ratios = random.Random(12), []
    for _ in range(60):
        lengths = sorted((r.choice((r.randrange(1, 600), r.randrange(1, 3000), r.randrange(1, 8193))) for _ in range(7)), reverse=True)
        where, final = packing.pack(lengths)
        held = np.bincount(where, weights=lengths)
        assert (held <= final).all()
        ratios.append(sum(map(packing.cost, final)) / least(lengths))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.25 and np.mean(ratios) < 1.03


def test_sequences_hold_all_tokens_with_their_bounds(spark, docs, texts, nothing, clashing):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})
    for df, rows in ((clashing, 14), (docs, packing.GROUP_ROWS)):
        parts = collections.defaultdict(list)
        for b in packing.pack_sequences(df, RANKS, public_tokenizers.PATTERN, capacities=(64, 256, 1024), group_rows=rows).collect():
            assert len(b.ids) == b.n_tokens <= b.bin_capacity == min(c for c in (64, 256, 1024) if c >= b.n_tokens)
            for i, at, first, last in zip(b.doc_ids, b.token_starts, b.starts, [*b.starts[1:], b.n_tokens], strict=True):
                parts[i].append((at, b.ids[first:last]))
        for i, t in enumerate(texts):
            ids = lib.encode_ordinary(t or "")
            want = [(at, ids[at : at + 1024]) for at in range(0, len(ids), 1024)]
            assert sorted(parts[i]) == sorted(want * (2 if i == 1 else 1))
    assert packing.pack_sequences(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing_beats_single_sizes():
    r = random.Random(4)
    lengths = sorted((r.choice([100, 700, 1500, 3000, 5000]) for _ in range(300)), reverse=True)
    total = lambda final: sum(packing.cost(c) for c in final)
    best = total(packing.pack(lengths)[1])
    assert best <= min(total(packing.pack(lengths, (c,))[1]) for c in (8192,)) and best <= total(packing.pack(lengths, (5000, 8192))[1]) * 1.2


# ---- neighbours -----------------------------------------------------------------------


def exact(rows, query, k):
    return sorted((float(np.sqrt(((np.array(v) - query[1]) ** 2).sum())), i) for i, v in rows if i != query[0])[:k]


def test_neighbours_recall_and_scores(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in e.collect()]
    out = collections.defaultdict(dict)
    for r in neighbours.nearest(e, F.col("vec_id") % 50 == 0).collect():
        out[r.query_id][r["rank"]] = (r.score, r.vec_id)
    hits = total = 0
    for i, v in rows:
        if i % 50 == 0:
            want = exact(rows, (i, np.array(v)), 10)
            got = [out[i][k] for k in range(1, 11)]
            assert got == sorted(got)
            where = dict(rows)
            assert all(math.isclose(s, math.dist(where[j], v), rel_tol=1e-12) for s, j in got)
            hits += len({j for _, j in got} & {j for _, j in want})
            total += 10
    assert hits / total >= 0.9


def test_neighbours_edges(spark):
    r = random.Random(1)
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(40)] + [(100 + i, [r.random() for _ in range(3)]) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 1.0, 1.0]), (205, [1.0, 2.0]), (None, same), (7, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = neighbours.nearest(df, F.col("vec_id").isin(0, 7, 200, 203), 10, part=8)
    got = collections.defaultdict(list)
    for x in out.orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.vec_id, x.score))
    assert got[0] == [(i, 0.0) for i in range(1, 11)]
    assert got[7] == [(i, 0.0) for i in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10)]
    assert set(got) == {0, 7}
    assert neighbours.nearest(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_outliers_and_of_few_vectors(spark):
    r = np.random.default_rng(4)
    many = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((60, 16)))] + [(100 + i, (v * 60).tolist()) for i, v in enumerate(r.standard_normal((2, 16)))]
    few = [(i, (v * 10.0**i).tolist()) for i, v in enumerate(r.standard_normal((6, 16)))]
    for rows, queries in ((many, [100, 101]), (few, range(6))):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = collections.defaultdict(list)
        for x in neighbours.nearest(df, F.col("vec_id").isin(*queries)).orderBy("query_id", "rank").collect():
            got[x.query_id].append(x.vec_id)
        assert got == {q: [i for _, i in exact(rows, (q, np.array(dict(rows)[q])), 10)] for q in queries}


def test_perturbations_come_in_order_of_cost():
    import itertools

    above = [0.3, 0.6, 0.45]
    cost = lambda moves: sum((above[m] if s < 0 else 1 - above[m]) ** 2 for m, s in moves)
    want = sorted(cost([(m, s) for m, s in enumerate(x) if s]) for x in itertools.product((-1, 0, 1), repeat=3))
    assert np.allclose([cost(p) for p in neighbours.perturbations(above, 27)], want)


def test_queries_are_registered():
    from eventloom.llm import queries

    names = list(queries.queries())
    assert [re.match(r"op(\d+)_", n)[1] for n in names] == [str(i) for i in range(1, 14)]
    assert json.dumps(queries.oracle_sql()) is not None
