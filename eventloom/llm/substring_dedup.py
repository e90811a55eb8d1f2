"""Exact substring deduplication by recompression.

Words become 64-bit names. Rounds then replace runs of a name, and pairs of a name from
the left class and one from the right class, by new names. Names and classes are hashes
of what they stand for, so every task gives the same symbol to the same words without
asking any other: the naming is global, and a round is a narrow step over a block.

Whether a symbol forms depends on its own words and, at most, on some beside it. Each
symbol carries that span, its *reach*. Wherever a sequence of words holds a symbol's
whole reach, the symbol is there: equal sequences have equal interior symbols. Each
window of `width` words is represented by the leftmost symbol, of the highest round that
has one, whose reach lies inside it (a single word always does). Neighbouring windows
share representatives, so a text has far fewer of them than windows.

Three passes over blocks of documents, two exchanges of packed keys between:
1. the keys of representatives go to buckets by key, which answer each block with those
   that other blocks have as well;
2. windows whose representative is shared, and they alone, are compared whole, by a
   fingerprint of all their words, in the same way (128 bits counting the check);
3. each block marks the words under repeated windows and writes what is left.
What a block holds twice it sees by itself; it sends each key once however often it has
it, so a passage that a third of all documents share costs each block one key. All is one lazy
plan; a lost task is made again from the input.

Edge cases: a null text has no words; texts shorter than `width` words lose nothing;
repeated rows are occurrences of each other; order and ties can't matter, as a window is
removed if its words start anywhere else at all; an empty table gives no rows; a null doc_id
stays null. Which block a row goes to follows its place in docs: docs should be a table, which
is read alike each time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Rolling, binary, bucket_of, ensure_importable, hash_words, mix, mix2, n_blocks

WIDTH, ROUNDS = 35, 7
#: Bytes of text in a block: its words take some twenty-five times that in arrays.
BLOCK_BYTES = 7 << 19
#: Blocks of documents for each bucket of keys: the rows between blocks and buckets stay few.
BLOCKS_A_BUCKET = 8
FAR = 1 << 40


class Symbols:
    """One round's sequence: names, reach [low, high) in words, and text of each symbol."""

    def __init__(self, name, low, high, doc):
        self.name, self.low, self.high, self.doc = name, low, high, doc

    def _beside(self):
        """Reach of the symbols before and after; beyond a text's ends nothing is known."""
        same = self.doc[1:] == self.doc[:-1]
        before, after = np.full(len(self.name), -FAR), np.full(len(self.name), FAR)
        before[1:][same] = self.low[:-1][same]
        after[:-1][same] = self.high[1:][same]
        return same, before, after

    def runs(self, salt: int) -> Symbols:
        """Maximal runs of a name as one symbol; all depend on the symbols at both sides."""
        same, before, after = self._beside()
        first = np.ones(len(self.name), bool)
        first[1:] = ~(same & (self.name[1:] == self.name[:-1]))
        at = np.flatnonzero(first)
        last = np.append(at[1:], len(self.name)) - 1
        size = (last - at + 1).astype(np.uint64)
        name = np.where(size > 1, mix2(self.name[at], size, salt), self.name[at])
        return Symbols(name, np.minimum(before[at], self.low[at]), np.maximum(after[last], self.high[last]), self.doc[at])

    def pairs(self, salt: int) -> Symbols:
        """Left-class names join right-class names after them. A joined pair depends on
        itself alone; a left one alone on what follows, a right one alone on what precedes."""
        same, before, after = self._beside()
        right = (mix(self.name, salt) & np.uint64(1)).astype(bool)
        joins = np.zeros(len(self.name), bool)
        joins[:-1] = same & ~right[:-1] & right[1:]
        joined = np.zeros(len(self.name), bool)
        joined[1:] = joins[:-1]
        at = np.flatnonzero(~joined)
        two = joins[at]
        other = np.minimum(at + 1, len(self.name) - 1)
        name = np.where(two, mix2(self.name[at], self.name[other], salt), self.name[at])
        low = np.where(two | ~right[at], self.low[at], before[at])
        high = np.where(two, self.high[other], np.where(right[at], self.high[at], after[at]))
        return Symbols(name, low, high, self.doc[at])


class Block:
    """The windows of the texts of one block."""

    def __init__(self, texts: list[bytes | None], width: int = WIDTH):
        self.width = width
        self.words, self.counts = hash_words(texts)
        ends = np.cumsum(self.counts)
        doc = np.repeat(np.arange(len(texts)), self.counts)
        n = len(self.words)
        self.doc = doc
        place = np.arange(n)
        self.starts = place[place + width <= ends[doc]] if n else place
        self.rolling = Rolling(self.words)

    def keys(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Fingerprints of windows, all or some."""
        return self.rolling.spans(self.starts[at], self.starts[at] + self.width)

    def representatives(self, rounds: int = ROUNDS) -> np.ndarray:
        """A key for each window: the name and the words in reach of its symbol."""
        n = len(self.words)
        level = Symbols(mix(self.words, 3), np.arange(n), np.arange(1, n + 1), self.doc)
        levels = [level]
        if n:
            level = level.runs(100)
            levels.append(level)
            for k in range(rounds):
                level = level.pairs(200 + k)
                levels.append(level)
        found = np.zeros(len(self.starts), np.uint64)
        left = np.arange(len(self.starts))
        for depth in range(len(levels) - 1, -1, -1):
            s = levels[depth]
            fits = np.flatnonzero((s.low >= 0) & (s.high - s.low <= self.width))
            if not len(fits) or not len(left):
                continue
            at = np.searchsorted(s.low[fits], self.starts[left])
            has = at < len(fits)
            pick = fits[np.minimum(at, len(fits) - 1)]
            has &= s.high[pick] <= self.starts[left] + self.width
            pick = pick[has]
            found[left[has]] = mix2(s.name[pick], self.rolling.spans(s.low[pick], s.high[pick]), 300)
            left = left[~has]
        return found

    def checks(self, at: np.ndarray) -> np.ndarray:
        """A second fingerprint of windows, of other sums."""
        other = Rolling(mix(self.words, 900))
        return other.spans(self.starts[at], self.starts[at] + self.width)


def _texts(batch: pa.Table) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def _rows(block: int, keys: np.ndarray, n: int, checks: np.ndarray | None = None) -> pa.Table:
    """One row for each bucket that gets some of the sorted keys: bucket, block, keys, checks."""
    bucket = bucket_of(keys, n)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(keys))
    pieces = [(int(bucket[a]), keys[a:b].tobytes(), b"" if checks is None else checks[a:b].tobytes()) for a, b in zip(cuts, ends, strict=True)] if len(keys) else []
    cols = list(zip(*pieces, strict=True)) if pieces else [(), (), ()]
    return pa.table({"bucket": pa.array(cols[0], pa.int64()), "block": pa.array([block] * len(pieces), pa.int64()), "keys": binary(cols[1]), "checks": binary(cols[2])})


KEYS_SCHEMA = "bucket long, block long, keys binary, checks binary"
REPLY_SCHEMA = "bucket long, block long, keys binary"


def _answer(key, table):
    """For each block those of its keys in a bucket that another block has as well."""
    blocks = table.column("block").to_pylist()
    parts = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    checks = [np.frombuffer(c, np.uint64) if c else np.zeros(len(p), np.uint64) for c, p in zip(table.column("checks").to_pylist(), parts, strict=True)]
    keys, check = np.concatenate(parts), np.concatenate(checks)
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    order = np.lexsort((check, keys))
    k, c = keys[order], check[order]
    same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    shared = np.zeros(len(k), bool)
    shared[1:] |= same
    shared[:-1] |= same
    told = np.sort(order[shared])  # back in the order of blocks and, in each, of keys
    cuts = np.searchsorted(owner[told], np.arange(len(parts) + 1))
    out = [(blocks[i], keys[told[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pa.table({"bucket": pa.array([key[0].as_py()] * len(out), pa.int64()), "block": pa.array([b for b, _ in out], pa.int64()), "keys": binary([x for _, x in out])})


def _replies(table: pa.Table) -> np.ndarray:
    """All keys a block has been told, sorted: buckets are ranges of keys."""
    rows = sorted(zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist(), strict=True))
    return np.frombuffer(b"".join(k for _, k in rows), np.uint64)


def _in(keys: np.ndarray, told: np.ndarray) -> np.ndarray:
    if not len(told):
        return np.zeros(len(keys), bool)
    return told[np.minimum(np.searchsorted(told, keys), len(told) - 1)] == keys


def blocks_of(docs: DataFrame, n: int, kept: Column) -> DataFrame:
    """kept, text and block: rows dealt into n blocks. The row's number keeps rows of
    one id and text, however many, from meeting in one block."""
    ensure_importable(docs.sparkSession)
    text = F.col("text").cast("string")
    block = F.pmod(F.xxhash64(F.col("doc_id"), text, F.monotonically_increasing_id()), F.lit(n)).cast("long")
    return docs.select(kept.alias("kept"), text.alias("text"), block.alias("block")).repartition(n, "block")


def repeated(blocks: DataFrame, n: int, width: int, rounds: int) -> DataFrame:
    """bucket, block, keys: the windows of each block that start in another block as well."""
    buckets = -(-n // BLOCKS_A_BUCKET)

    def first(key, table):
        return _rows(key[0].as_py(), np.unique(Block(_texts(table), width).representatives(rounds)), buckets)

    def second(key, table, told):
        if not told.num_rows:
            return _rows(0, np.empty(0, np.uint64), buckets)
        b = Block(_texts(table), width)
        at = np.flatnonzero(_in(b.representatives(rounds), _replies(told)))
        found, where = np.unique(b.keys(at), return_index=True)
        return _rows(key[0].as_py(), found, buckets, b.checks(at[where]))

    grouped = blocks.groupBy("block")
    asked = grouped.applyInArrow(first, KEYS_SCHEMA)
    answers = asked.groupBy("bucket").applyInArrow(_answer, REPLY_SCHEMA)
    windows = grouped.cogroup(answers.groupBy("block")).applyInArrow(second, KEYS_SCHEMA)
    return windows.groupBy("bucket").applyInArrow(_answer, REPLY_SCHEMA)


def covered(b: Block, told: np.ndarray) -> np.ndarray:
    """Whether each word of the block lies under a window that also starts elsewhere."""
    keys = b.keys()
    own, counts = np.unique(keys, return_counts=True)
    hit = b.starts[_in(keys, own[counts > 1]) | _in(keys, told)]
    edge = np.zeros(len(b.words) + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + b.width, -1)
    return np.cumsum(edge[:-1]) > 0


def removals(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def last(key, table, told):
        texts = _texts(table)
        b = Block(texts, width)
        gone = covered(b, _replies(told))
        at, rows = 0, []
        for text, n in zip(texts, b.counts.tolist(), strict=True):
            part = gone[at : at + n]
            at += n
            words = text.split() if text else []
            kept = [words[i] for i in np.flatnonzero(~part)] if part.any() else words
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
        return pa.table({"doc_id": table.column("kept"), "n_words": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "kept_sha256": pa.array(cols[2], pa.string())})

    n = n_blocks(docs, BLOCK_BYTES)
    blocks = blocks_of(docs, n, F.col("doc_id").cast("long"))
    told = repeated(blocks, n, width, rounds)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(last, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = WIDTH, rounds: int = ROUNDS) -> DataFrame:
    """docs with the covered words of each `text` cut out, its other characters as they
    are. Rows that lose nothing stay the same; all columns of any names are kept."""
    place = [c.lower() for c in docs.columns].index("text")

    def last(key, table, told):
        texts = _texts(table)
        b = Block(texts, width)
        gone = covered(b, _replies(told))
        at, new = 0, []
        for text, n in zip(texts, b.counts.tolist(), strict=True):
            part = gone[at : at + n]
            at += n
            new.append(cut(text, part) if part.any() else text)
        row = table.column("kept").combine_chunks()
        fields = [row.type.field(i) for i in range(row.type.num_fields)]
        columns = row.flatten()
        columns[place] = pa.array([None if t is None else t.decode() for t in new], fields[place].type)
        return pa.Table.from_arrays(columns, names=[f.name for f in fields])

    n = n_blocks(docs, BLOCK_BYTES)
    blocks = blocks_of(docs, n, F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    told = repeated(blocks, n, width, rounds)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(last, docs.schema)


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """text without the words marked; the space after each goes with it."""
    out, keep_from = [], 0
    spans = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    marks = gone.tolist()
    i = 0
    while i < len(spans):
        if marks[i]:
            j = i
            while j < len(spans) and marks[j]:
                j += 1
            out.append(text[keep_from : spans[i][0]])
            keep_from = spans[j][0] if j < len(spans) else spans[-1][1]
            i = j
        else:
            i += 1
    out.append(text[keep_from:])
    return b"".join(out)
