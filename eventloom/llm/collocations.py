"""Phrase collocations by suffix sorting (suffix-sigma), for each language.

A suffix is what follows a word inside its piece of text, cut after five words. Suffixes are
shuffled by language and first word, sorted in reverse lexicographic order, and one stack
counts all their prefixes: a prefix is pushed where a suffix shares less than it with the one
before, and popped, with its count, where the next does so again. A stack's pushes and pops
depend on these shared lengths alone, so a whole bucket of suffixes is stacked at once.
Counts of the parts of a phrase are joined afterwards.

A first pass counts words. Words with more than a quarter of a bucket's share of all words
are hot, and there are at most four a bucket, so their list is of known size. The key of a
suffix goes on after hot words, to the first word that isn't hot, and no key has much more
than a bucket's share. A phrase with a word that isn't hot, or of full length, is then
counted whole in one bucket; one of hot words alone is counted in parts, one a bucket at
most, which are summed. Equal suffixes of a task's texts are sent once, with their number.

Edge cases: null and empty texts have no words, and are counted nowhere; a null lang is
"und", together with documents whose lang is that; repeated rows count each time; pieces and
words of any length are whole; ties are broken as stated at `collocations`; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.expressions import bounded
from eventloom.llm.common import ensure_importable, mix, mix2, written

#: Words of the longest phrase.
LENGTH = 5
#: Text that a task sorts at once, words that a bucket should hold.
FLUSH_BYTES, BUCKET_WORDS = 16 << 20, 1 << 21

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Capitals made small, ends of pieces made line ends, tabs made spaces.
_TABLE = bytes.maketrans(_UPPER + b".,;:!?\x0b\x0c\r\t", _LOWER + b"\n" * 9 + b" ")
_END, _NONE = 0, 1


class _Numbers(dict):
    """Numbers of words in the order they come; the end of a piece is 0, an empty string 1."""

    def __init__(self):
        super().__init__({b"\n": _END, b"": _NONE})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, texts: list[bytes]) -> np.ndarray:
        """The words of all texts, with an end after each piece."""
        found = b"\n".join([*texts, b""]).translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        ids = np.fromiter(map(self.__getitem__, found), np.int32, len(found))
        return ids[ids != _NONE]


def _flushes(batches):
    """The texts of each language, in lots of bounded size (or of one text)."""
    lot, size = {}, 0
    for b in batches:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if text:
                    lot.setdefault(lang, []).append(text)
                    size += len(text)
                if size >= FLUSH_BYTES:
                    yield lot
                    lot, size = {}, 0
    if lot:
        yield lot


def _word_counts(batches):
    for lot in _flushes(batches):
        for lang, texts in lot.items():
            numbers = _Numbers()
            counts = np.bincount(numbers.of(texts), minlength=len(numbers))[2:]
            words = list(numbers)[2:]
            for i in range(0, len(words), 1 << 16):
                some = words[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array(counts[i : i + (1 << 16)], pa.int64())], names=["lang", "word", "n"])


def _hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def suffixes(ids: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A row for each word: it and those after it in its piece, `length` in all, then zeros."""
    out = np.zeros((length, len(ids)), np.int32)
    out[0] = ids
    for j in range(1, length):
        out[j, :-j or None] = ids[j:]
        out[j, out[j - 1] == _END] = _END
    return out[:, ids != _END]


def _order(columns: np.ndarray, n: int) -> np.ndarray:
    """Rows sorted by all columns, whose values are below n.

    As many columns as 63 bits hold make a key; only rows that are tied by the first key are
    sorted by the others."""
    each = 63 // max(1, int(n - 1).bit_length())
    keys = []
    for j in range(0, len(columns), each):
        key = columns[j].astype(np.int64)
        for c in columns[j + 1 : j + each]:
            key = key * n + c
        keys.append(key)
    order = np.argsort(keys[0])
    if len(keys) > 1 and len(order):
        first = keys[0][order]
        same = first[1:] == first[:-1]
        tied = np.flatnonzero(np.append(same, False) | np.append(False, same))
        rows = order[tied]
        order[tied] = rows[np.lexsort([k[rows] for k in keys[::-1]])]
    return order


def _shared(columns: np.ndarray) -> np.ndarray:
    """How many leading words each sorted suffix shares with the one before it."""
    shared, same = np.zeros(columns.shape[1], np.int64), np.ones(columns.shape[1], bool)
    same[:1] = False
    for c in columns:
        same[1:] &= (c[1:] == c[:-1]) & (c[1:] > 0)
        shared += same
    return shared


def buckets_of(columns: np.ndarray, hashes: np.ndarray, hot: np.ndarray, lang: str, n: int) -> np.ndarray:
    """The bucket of each suffix, by language and words up to the first that isn't hot."""
    key = mix2(np.full(columns.shape[1], _hash([lang.encode()])[0]), hashes[columns[0]], 3)
    on = hot[columns[0]]
    for c in columns[1:]:
        on = on & (c > 0)
        key[on] = mix2(key[on], hashes[c[on]], 5)
        on = on & hot[c]
    return ((mix(key, 9) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _packed(words: np.ndarray, columns: np.ndarray, counts: np.ndarray) -> bytes:
    """Words that occur, and suffixes in numbers of these."""
    if columns.size * 8 < len(words):
        used, at = np.unique(np.append(_END, columns), return_inverse=True)
        at = at[1:].reshape(columns.shape)
    else:  # marks of words cost less than a sort
        there = np.zeros(len(words), bool)
        there[columns] = there[_END] = True
        used = np.flatnonzero(there)
        at = (np.cumsum(there) - 1)[columns]
    names = b"\n".join(words[used[1:]].tolist())
    head = np.array([len(names), columns.shape[1], len(columns)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + names + at.astype(np.uint32).tobytes() + counts.astype(np.int64).tobytes())


def _unpacked(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    size, n, length = np.frombuffer(data, np.int64, 3).tolist()
    at = 24 + size
    columns = np.frombuffer(data, np.uint32, n * length, at).reshape(length, n)
    return data[24:at].split(b"\n"), columns, np.frombuffer(data, np.int64, n, at + 4 * n * length)


def _sender(hot: dict[str, set[bytes]], n_buckets: int, length: int):
    def run(batches):
        for lot in _flushes(batches):
            for lang, texts in lot.items():
                numbers = _Numbers()
                ids = numbers.of(texts)
                words, few = list(numbers), hot.get(lang, ())
                if len(words) == 2:
                    continue
                columns = suffixes(ids, length)
                columns = columns[:, _order(columns, len(words))]
                size = np.count_nonzero(columns, 0)
                first = np.flatnonzero((_shared(columns) < size) | (size != np.r_[-1, size[:-1]]))
                counts = np.diff(np.r_[first, columns.shape[1]])
                columns = columns[:, first]
                bucket = buckets_of(columns, _hash(words), np.array([w in few for w in words]), lang, n_buckets)
                by = np.argsort(bucket.astype(np.uint16) if n_buckets <= 1 << 16 else bucket, kind="stable")
                names = np.array(words, object)
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket[by])) + 1, len(by)]
                for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    at = by[i:j]
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([int(bucket[at[0]])], pa.int64()), pa.array([_packed(names, columns[:, at], counts[at])], pa.binary())], names=["lang", "bucket", "suffixes"])

    return run


def stacked(columns: np.ndarray, counts: np.ndarray):
    """(length, first suffix with it, count) of all prefixes of suffixes in reverse order: for
    each length the places where the stack pushes one, and its count when it is popped."""
    shared, total = _shared(columns), np.r_[0, np.cumsum(counts)]
    for d in range(1, len(columns) + 1):
        push = np.flatnonzero(shared < d)
        count = total[np.r_[push[1:], columns.shape[1]]] - total[push]
        there = columns[d - 1, push] > 0
        yield d, push[there], count[there]


def _counter(hot: dict[str, set[bytes]], least: int):
    def run(key, table):
        lang = key[0].as_py()
        rows = [_unpacked(x) for x in table.column("suffixes").to_pylist()]
        words = sorted(set().union(*(w for w, _, _ in rows)))
        number = {w: i for i, w in enumerate(words, 1)}
        columns = np.concatenate([np.fromiter((0, *map(number.__getitem__, w)), np.int32, len(w) + 1)[c] for w, c, _ in rows], 1)
        counts = np.concatenate([x for _, _, x in rows])
        by = _order(columns, len(words) + 1)[::-1]
        columns, counts = columns[:, by], counts[by]
        few = hot.get(lang, ())
        is_hot = np.array([False, *(w in few for w in words)])
        phrases, sizes, found = [], [], []
        for d, at, count in stacked(columns, counts):
            partial = is_hot[columns[:d, at]].all(0) & (d < len(columns))
            keep = partial | (count >= least)
            for row in columns[:d, at[keep]].T.tolist():
                phrases.append(b" ".join([words[i - 1] for i in row]))
            sizes += [d] * int(keep.sum())
            found.append(count[keep])
        return pa.table([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(found), pa.int64())], names=["lang", "phrase", "n_words", "f"])

    return run


def phrase_counts(docs: DataFrame, least: int = 100, length: int = LENGTH, bucket_words: int = BUCKET_WORDS) -> tuple[DataFrame, DataFrame]:
    """(phrases, languages): lang, phrase, n_words, f of all phrases of 1 to `length` words that
    occur `least` times or more, and lang, n: the words of each language. Both are written
    tables."""
    ensure_importable(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = written(rows.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = written(words.groupBy("lang").agg(F.sum("n").alias("n")))
    total = languages.agg(F.sum("n")).first()[0] or 0
    n_buckets = max(4, math.ceil(total / bucket_words))
    hot: dict[str, set[bytes]] = {}
    for r in bounded(words.where(F.col("n") * (4 * n_buckets) > total), 4 * n_buckets, "hot words"):
        hot.setdefault(r.lang, set()).add(r.word.encode())
    sent = rows.mapInArrow(_sender(hot, n_buckets, length), "lang string, bucket long, suffixes binary")
    counted = sent.groupBy("lang", "bucket").applyInArrow(_counter(hot, least), "lang string, phrase string, n_words int, f long")
    return written(counted.groupBy("lang", "phrase", "n_words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)), languages


def scored(phrases: DataFrame, languages: DataFrame) -> DataFrame:
    """Each phrase of two or more words with the counts of its parts at its lowest-scoring cut:
    lang, phrase, n_words, a, l, r, n, score. A cut after k words scores 1000 a n / (l r),
    rounded down; of equal scores the smallest k counts. Arithmetic is that of decimals."""
    cut = phrases.where("n_words > 1").selectExpr("lang", "phrase", "n_words", "f AS a", "explode(sequence(1, n_words - 1)) AS k")
    cut = cut.selectExpr("*", "substring_index(phrase, ' ', k) AS left_part", "substring_index(phrase, ' ', k - n_words) AS right_part")
    left = phrases.selectExpr("lang", "phrase AS left_part", "f AS l")
    right = phrases.selectExpr("lang", "phrase AS right_part", "f AS r")
    both = cut.join(left, ["lang", "left_part"]).join(right, ["lang", "right_part"]).join(languages, "lang")
    both = both.withColumn("score", F.expr("CAST(CAST(a AS DECIMAL(19, 0)) * n * 1000 AS DECIMAL(38, 0)) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    best = both.groupBy("lang", "phrase", "n_words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "n_words", "a", "best.l", "best.r", "n", "best.score")


def outermost(found: DataFrame, phrases: DataFrame, percent: int = 100) -> DataFrame:
    """found without the phrases that lie inside a longer one with `percent` of their count or more."""
    inside = phrases.where("n_words > 2").selectExpr("lang", "f", "n_words AS m", "split(phrase, ' ') AS words", "explode(sequence(2, n_words - 1)) AS size")
    inside = inside.selectExpr("lang", "f", "words", "size", "explode(sequence(1, m - size + 1)) AS at")
    inside = inside.selectExpr("lang", "array_join(slice(words, at, size), ' ') AS phrase", "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    return found.join(inside, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {percent} * a").drop("longer")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, length: int = LENGTH, percent: int = 100, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: for each language its first `top` phrases of 2 to
    `length` words that occur `least` times or more and lie in no longer one that occurs
    (nearly) as often; by score, count, then phrase in order of its bytes."""
    phrases, languages = phrase_counts(docs, least, length, bucket_words)
    out = outermost(scored(phrases, languages), phrases, percent)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
