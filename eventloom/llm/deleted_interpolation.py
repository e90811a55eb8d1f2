"""Language-model scoring by deleted interpolation.

P(w | h) mixes the maximum-likelihood estimates of orders 1 to `order` and the uniform
one over the known words and "unknown". The weights depend on how often the longest
context was seen (buckets by powers of two) and are learned by expectation-maximisation
on documents deleted from the counts; the final estimates then use all training documents.

Words are in number what the corpus makes them, so neither counts nor vocabulary are ever
in one place. Documents are dealt into blocks. A block names its distinct n-grams, with
how often its training documents hold them, to buckets by hash; a bucket sums and answers
each block with the totals, in the order asked. Keys are 48 bits beside the bucket's own,
counts mostly a byte. A block then has all it needs to score its texts. For
the weights, deleted documents have blocks of their own; what expectation-maximisation
needs of a token is put in a cell of a grid (bucket, and half octaves of each order's
estimate) that keeps sums, so its size doesn't grow with the corpus.
All of it is one lazy plan over one exchange of texts.

Edge cases: null and empty texts are one end token; a null doc_id counts as the empty
text where it decides the part; with no training documents every estimate is uniform;
contexts never seen leave the orders below; repeated rows count each time. Which block a
row goes to follows its place in docs: docs should be a table, which is read alike each time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import binary, bucket_of, ensure_importable, hash_words, mix, mix2, n_blocks

ORDER, GRID, BUCKETS = 2, 64, 32
#: Blocks of documents for each bucket of keys: a bucket holds what a task can, so that the
#: rows between blocks and buckets, and not only their bytes, stay few.
BLOCKS_A_BUCKET = 4
END, BEGIN = np.uint64(0x0E2D), np.uint64(0xBE61)
HELD_OUT, MAIN, DELETED = 0, 1, 2


class Tokens:
    """Tokens of a block's texts and the keys of their n-grams, for each order."""

    def __init__(self, texts: list[bytes | None], order: int):
        words, counts = hash_words([t.lower() if t else t for t in texts])
        ends = np.cumsum(counts + 1) - 1
        self.token = np.empty(len(words) + len(texts), np.uint64)
        inner = np.ones(len(self.token), bool)
        inner[ends] = False
        self.token[inner] = mix(words, 77)
        self.token[~inner] = END
        self.ends, self.sizes = ends, counts + 1
        self.first = np.zeros(len(self.token), bool)
        self.first[ends - counts] = True
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first] = BEGIN
        self.keys = [mix(self.token, 1)]
        context = before
        for k in range(2, order + 1):
            self.keys.append(mix2(context, self.token, 10 * k))
            if k < order:  # the context of the next order: one word more to the left
                longer = np.empty_like(context)
                longer[1:] = context[:-1]
                longer[self.first] = BEGIN
                context = mix2(longer, before, 5)
        self.end_key = mix(np.array([END]), 1)[0]


def _pack_counts(counts: np.ndarray) -> bytes:
    """A byte each; larger ones are 255 there and follow in full."""
    big = counts[counts >= 255].astype("<u8")
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + big.tobytes()


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack_keys(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


ASKED = "bucket long, block long, level int, keys binary, counts binary"
TOLD = "block long, bucket long, level int, main binary, total binary, stats array<double>"


def _asked(block: int, texts: list, train: np.ndarray, order: int, buckets: int) -> pa.Table:
    t = Tokens(texts, order)
    counted = np.repeat(train, t.sizes)
    rows: list[tuple] = []
    for level, keys in enumerate(t.keys, 1):
        found, place = np.unique(keys, return_inverse=True)
        counts = np.bincount(place[counted], minlength=len(found))
        bucket = bucket_of(found, buckets)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        rows += [(int(bucket[a]), block, level, _pack_keys(found[a:b]), _pack_counts(counts[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(found)), strict=True)]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), binary(cols[3]), binary(cols[4])], names=["bucket", "block", "level", "keys", "counts"])


def _told(bucket: int, table: pa.Table, n: int) -> pa.Table:
    """Totals for each block that asked, in the order of its keys; for blocks of deleted
    documents (n and above) those of the rest as well; and the bucket's types and tokens."""
    rows = table.select(["level", "block", "keys", "counts"]).to_pylist()
    out = []
    for level in sorted({r["level"] for r in rows}):
        own = [r for r in rows if r["level"] == level]
        keys = [_unpack_keys(r["keys"]) for r in own]
        counts = [_unpack_counts(r["counts"], len(k)) for r, k in zip(own, keys, strict=True)]
        found, place = np.unique(np.concatenate(keys), return_inverse=True)
        flat = np.concatenate(counts)
        of_main = np.repeat([r["block"] < n for r in own], [len(k) for k in keys])
        main = np.bincount(place[of_main], weights=flat[of_main], minlength=len(found)).astype(np.int64)
        total = np.bincount(place, weights=flat, minlength=len(found)).astype(np.int64)
        at = 0
        for i, (r, k) in enumerate(zip(own, keys, strict=True)):
            mine = place[at : at + len(k)]
            at += len(k)
            stats = [float((main > 0).sum()), float(main.sum()), float((total > 0).sum()), float(total.sum())] if i == 0 and level == 1 else None
            out.append((r["block"], bucket, level, _pack_counts(main[mine]) if r["block"] >= n else None, _pack_counts(total[mine]), stats))
    cols = list(zip(*out, strict=True)) if out else [()] * 6
    return _told_table(cols)


def _told_table(cols: list) -> pa.Table:
    return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), binary(cols[3]), binary(cols[4]), pa.array(cols[5], pa.list_(pa.float64()))], names=["block", "bucket", "level", "main", "total", "stats"])


def _totals(t: Tokens, told: list[dict], column: str, buckets: int) -> list[np.ndarray]:
    """For each order the total of every token's n-gram, from the answers to this block."""
    out = []
    for level, keys in enumerate(t.keys, 1):
        found, place = np.unique(keys, return_inverse=True)
        bucket = bucket_of(found, buckets)
        sizes = np.bincount(bucket, minlength=buckets)
        rows = sorted((r for r in told if r["level"] == level), key=lambda r: r["bucket"])
        counts = [_unpack_counts(r[column], int(sizes[r["bucket"]])) for r in rows]
        out.append((np.concatenate(counts) if counts else np.zeros(0, np.int64))[place])
    return out


def _estimates(t: Tokens, counts: list[np.ndarray], types: float, tokens: float) -> tuple[np.ndarray, np.ndarray]:
    """Tokens x orders from 0 of estimates, and the bucket of the longest context's count."""
    documents = counts[0][t.ends[0]] if len(t.ends) else 0
    out = np.zeros((len(t.token), len(counts) + 1))
    out[:, 0] = 1.0 / (types + 1.0)
    seen = np.full(len(t.token), tokens)
    for k, count in enumerate(counts):
        if k:  # the context of order k + 1 at a token is the order-k gram that ends before it
            seen = np.empty(len(t.token))
            seen[1:] = counts[k - 1][:-1]
            seen[t.first] = documents
        out[:, k + 1] = np.where(seen > 0, count / np.maximum(seen, 1), 0.0)
    return out, np.minimum(np.log2(seen + 1).astype(np.int64), BUCKETS - 1)


def _cells(estimates: np.ndarray, bucket: np.ndarray) -> pa.Table:
    """Counts and sums of estimates of the cells that the tokens fall in."""
    code = bucket.copy()
    for k in range(1, estimates.shape[1]):
        ratio = estimates[:, k] / estimates[:, 0]
        q = np.where(ratio > 0, np.clip(np.rint(2 * np.log2(np.maximum(ratio, 1e-9))) + 20, 1, GRID - 1), 0).astype(np.int64)
        code = code * GRID + q
    found, place = np.unique(code, return_inverse=True)
    sums = [np.bincount(place, weights=estimates[:, k], minlength=len(found)).astype(float) for k in range(estimates.shape[1])]
    return pa.table([pa.array(found), pa.array(np.bincount(place, minlength=len(found)).astype(float)), *map(pa.array, sums)], names=["cell", "n", *[f"s{k}" for k in range(len(sums))]])


def learn_weights(cell: np.ndarray, n: np.ndarray, means: np.ndarray, steps: int = 100) -> np.ndarray:
    """BUCKETS x orders of mixture weights, by expectation-maximisation in each bucket.

    A bucket starts from, and is held by one token's worth to, the weights of all."""
    orders = means.shape[1]
    bucket = cell // GRID ** (orders - 1)

    def em(start, rows):
        w = start
        for _ in range(steps):
            share = w * means[rows]
            share *= (n[rows] / share.sum(1))[:, None]
            w = (share.sum(0) + start) / (n[rows].sum() + 1)
        return w

    start = np.full(orders, 1.0 / orders)
    overall = em(start, np.arange(len(n))) if len(n) else start
    out = np.tile(overall, (BUCKETS, 1))
    last = overall
    for b in range(BUCKETS):
        rows = np.flatnonzero(bucket == b)
        last = out[b] = em(overall, rows) if len(rows) else last
    return out


def score(docs: DataFrame, part: Column, order: int = ORDER) -> DataFrame:
    """doc_id, part, n_tokens, n_known, train_tokens, base_score, score of every row.

    part: HELD_OUT rows are scored alone, MAIN ones counted, DELETED ones counted in the
    end and used before that for the weights."""
    ensure_importable(docs.sparkSession)
    n = n_blocks(docs)
    more = max(1, n // 8)  # for deleted documents: about a tenth as many
    buckets = -(-n // BLOCKS_A_BUCKET)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), part.cast("int").alias("part"))
    # the row's number keeps rows of one id and text, however many, from meeting in one block
    dealt = F.xxhash64("doc_id", "text", F.monotonically_increasing_id())
    blocks = rows.withColumn("block", F.when(F.col("part") == DELETED, n + F.pmod(dealt, F.lit(more))).otherwise(F.pmod(dealt, F.lit(n))).cast("long")).repartition(n + more, "block")

    def texts(table):
        return table.column("text").cast(pa.binary()).to_pylist()

    def ask(key, table):
        return _asked(key[0].as_py(), texts(table), table.column("part").to_numpy() != HELD_OUT, order, buckets)

    def tell(key, table):
        return _told(key[0].as_py(), table, n)

    answers = blocks.groupBy("block").applyInArrow(ask, ASKED).groupBy("bucket").applyInArrow(tell, TOLD)
    sums = answers.select(*[F.coalesce(F.col("stats")[k], F.lit(0.0)).alias(f"x{k}") for k in range(4)]).agg(*[F.sum(f"x{k}").alias(f"x{k}") for k in range(4)])

    def for_blocks(one: DataFrame, stats: Column, first: int, last: int) -> DataFrame:
        empty = F.lit(None).cast("binary")
        return one.select(F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("block"), F.lit(-1).cast("long").alias("bucket"), F.lit(0).alias("level"), empty.alias("main"), empty.alias("total"), stats.alias("stats"))

    stats = F.array(*[F.coalesce(f"x{k}", F.lit(0.0)) for k in range(4)])

    def split(table):
        told = table.select(["bucket", "level", "main", "total", "stats"]).to_pylist()
        return [r for r in told if r["level"]], next((r["stats"] for r in told if not r["level"]), None)

    cell_names = ["n", *[f"s{k}" for k in range(order + 1)]]
    cell_schema = "cell long, " + ", ".join(f"{c} double" for c in cell_names)

    def held(key, table, about):
        told, numbers = split(about)
        if not table.num_rows:
            return _cells(np.zeros((0, order + 1)), np.zeros(0, np.int64))
        t = Tokens(texts(table), order)
        return _cells(*_estimates(t, _totals(t, told, "main", buckets), numbers[0], numbers[1]))

    deleted = blocks.where(F.col("block") >= n)
    asked_by_deleted = answers.where(F.col("block") >= n).unionByName(for_blocks(sums, stats, n, n + more - 1))
    cells = deleted.groupBy("block").cogroup(asked_by_deleted.groupBy("block")).applyInArrow(held, cell_schema)
    cells = cells.groupBy("cell").agg(*[F.sum(c).alias(c) for c in cell_names])
    # one row for the statistics in front, so that there is a group even without cells
    grid = cells.unionByName(sums.select(F.lit(-1).cast("long").alias("cell"), *[F.coalesce(f"x{k}", F.lit(0.0)).alias(c) if k < 4 else F.lit(0.0).alias(c) for k, c in enumerate(cell_names)]))

    def learn(table):
        cell, values = table.column("cell").to_numpy(), np.column_stack([table.column(c).to_numpy() for c in cell_names])
        about, rows = values[cell < 0][0], cell >= 0
        w = learn_weights(cell[rows], values[rows, 0], values[rows, 1:] / values[rows, :1])
        return pa.table({"stats": pa.array([[*about[2:4].tolist(), *w.reshape(-1).tolist()]], pa.list_(pa.float64()))})

    # the grid is bounded (see _cells), so one task can hold it
    learned = grid.groupBy(F.lit(0).alias("all")).applyInArrow(learn, "stats array<double>")
    asked = answers.unionByName(for_blocks(learned, F.col("stats"), 0, n + more - 1))

    def final(key, table, about):
        told, numbers = split(about)
        if not table.num_rows:
            return _scores_table(table, [()] * 4, 0)
        types, tokens, w = numbers[0], numbers[1], np.array(numbers[2:]).reshape(BUCKETS, order + 1)
        t = Tokens(texts(table), order)
        counts = _totals(t, told, "total", buckets)
        estimates, bucket = _estimates(t, counts, types, tokens)
        logs = np.log10((estimates * w[bucket]).sum(1))
        base = np.log10((counts[0] + 0.1) / (tokens + 0.1 * (types + 1)))
        at = t.ends - t.sizes + 1
        return _scores_table(table, [t.sizes, np.add.reduceat((counts[0] > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(logs, at)], int(tokens))

    return blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(final, "doc_id long, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _scores_table(table: pa.Table, cols: list, tokens: int) -> pa.Table:
    n = table.num_rows
    return pa.table([table.column("doc_id"), table.column("part"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array([tokens] * n, pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["doc_id", "part", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
