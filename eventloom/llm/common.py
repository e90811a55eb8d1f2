"""Shared pieces: reading, blocks of documents, packed key exchange.

Every operator selects the columns it needs first, so columns of other names, whatever
they are called, never clash with the ones it makes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.session import ensure_importable  # noqa: F401
from eventloom.session import read_table as table  # noqa: F401
from eventloom.storage import forget, forget_all, shared_dir, written  # noqa: F401

#: ASCII white space as Spark and Java patterns take it; a word is a run of other characters.
SPACES = " \t\n\x0b\f\r"
#: Bytes of text that one block of documents should hold.
BLOCK_BYTES = 7 << 20


def few_files(docs: DataFrame, file_bytes: int = 8 << 20) -> int:
    """In how many files tables that are small beside docs should be written: one for each
    so many stored bytes of docs, so that a file's share doesn't grow with the corpus, but
    two for each of the cluster's cores at least."""
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(size_in_bytes(docs) / file_bytes))


def size_in_bytes(df: DataFrame) -> int:
    """The stored bytes that df is made from: Catalyst's figures for the leaves of its plan,
    which for files are their sizes and need no job. 0 if some leaf's size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(sizes) if all(x < 1 << 60 for x in sizes) else 0


def id_remainder(doc_id: str, n: int):
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def n_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES, row_bytes: int = 64) -> int:
    """How many blocks docs should be dealt into, so that a block fits a task: by the bytes of
    its texts, and some for each row. Stored bytes wouldn't do, as repeated texts take next to
    none of these; so this reads the texts once."""
    size = docs.select(F.octet_length(F.col("text").cast("string")).alias("size")).agg(F.sum("size").alias("text"), F.count(F.lit(1)).alias("rows")).first()
    return max(2, math.ceil(((size.text or 0) + row_bytes * size.rows) / block_bytes))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def mix2(x: np.ndarray, y: np.ndarray, salt: int = 0) -> np.ndarray:
    return mix(mix(x, salt) + (y << np.uint64(1)) + np.uint64(1), salt + 1)


#: Characters of a word or segment that is worth keeping: with these, a kept one takes some
#: hundred bytes, in whatever language.
LONGEST_KEPT = 64


class Memo(dict):
    """What make(key) gives, kept for up to two generations of `limit` keys: a bounded
    stand-in for a least-recently-used table, whose hits cost one dict look-up.

    longest: keys of more characters are not kept, so that the table is bounded in bytes."""

    def __init__(self, make, limit: int = 1 << 18, longest: int | None = None):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        if self.longest is not None and len(key) > self.longest:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


def hash_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after another, and each text's count.

    The hash function costs less than a look-up in a table of words would."""
    parts = []
    for t in texts:
        words = t.split() if t else ()
        parts.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


#: An odd multiplier for rolling sums modulo 2**64, and its inverse.
ROLL = 0x9E3779B97F4A7C15 | 1
UNROLL = pow(ROLL, -1, 1 << 64)


class Rolling:
    """Fingerprints of any span of a sequence of hashes, from two prefix sums."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        up, down = np.full(n + 1, ROLL, np.uint64), np.full(n + 1, UNROLL, np.uint64)
        up[0] = down[0] = 1
        np.multiply.accumulate(up, out=up)
        np.multiply.accumulate(down, out=down)
        self.down = down
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes, 7) * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start], 11)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each key by its high bits, so sorted keys have sorted buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def binary(rows: list) -> pa.Array:
    return pa.array(rows, pa.binary())
