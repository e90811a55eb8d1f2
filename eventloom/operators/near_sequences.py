"""Sequences within an edit distance of each other, without comparing all pairs.

Edit distance is a metric, so two texts whose distances from a pivot differ by more than k
are not within k of each other. Each text's distances from a few pivots are taken once; the
empty text is one of them, whose distance is a text's length, the others are far from each
other in a bounded sample. Cut into steps of k + 1 these distances are a key; a text meets
those whose steps differ by one at most, and of these only the pairs that no pivot tells
apart are compared, many at a time, along the band of the matrix that k allows. Any pivots
give the same pairs; good ones leave fewer to compare.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.functions.joins import MOST
from eventloom.session import ensure_importable
from eventloom.storage import written

PIVOTS, SAMPLE, BATCH = 2, 400, 2048
#: Cells of a table of letters; pairs whose words of bits go side by side.
TABLE, WORDS = 1 << 22, 1 << 15


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as a matrix, shorter texts filled up with -1, and lengths."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), int(lengths.max(initial=0))), -1, np.int32)
    for i, t in enumerate(texts):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.int32)
    return out, lengths


def edit_distances(a: list[str], b: list[str], k: int | None = None) -> np.ndarray:
    """Levenshtein distances of pairs, side by side; with k those above it are k + 1. Only the
    cells of the matrix that lie within k of its diagonal are looked at."""
    x, n = _codes(a)
    y, m = _codes(b)
    reach = max(x.shape[1], y.shape[1]) if k is None else k
    far = reach + 1
    width = 2 * reach + 1
    band = np.full((len(a), width), far, np.int64)  # column d: j = i + d - reach
    band[:, reach:] = np.minimum(np.arange(reach + 1), far)
    out = np.full(len(a), far, np.int64)
    end = m - n + reach
    inside = (end >= 0) & (end < width)
    rows = np.arange(len(a))
    done = inside & (n == 0)
    out[done] = band[rows[done], end[done]]
    padded = np.full((len(b), y.shape[1] + 2 * width + x.shape[1]), -2, np.int32)
    padded[:, width : width + y.shape[1]] = y
    for i in range(1, x.shape[1] + 1):
        j = i + np.arange(width) - reach
        unlike = padded[:, width + j[0] - 1 : width + j[0] - 1 + width] != x[:, i - 1 : i]
        new = np.minimum(band + unlike, far)
        new[:, :-1] = np.minimum(new[:, :-1], band[:, 1:] + 1)
        new[:, j == 0] = i
        new[:, j < 0] = far
        for d in range(1, width):
            new[:, d] = np.minimum(new[:, d], new[:, d - 1] + 1)
        band = np.minimum(new, far)
        done = inside & (n == i)
        out[done] = band[rows[done], end[done]]
    return out


def choose_pivots(texts: DataFrame, pivots: int = PIVOTS) -> list[str]:
    """The empty text, then texts of a sample, each farthest from those before."""
    some = sorted(r.text for r in texts.select("text").orderBy(F.xxhash64("text"), "text").limit(SAMPLE).collect())
    chosen = [""]
    near = np.fromiter(map(len, some), np.int64, len(some))
    for _ in range(min(pivots, len(some))):
        # of the texts of middling distance: those at the end differ by length alone
        i = int(np.argmax(near)) if len(chosen) > 1 else int(np.argsort(near, kind="stable")[len(near) // 2])
        chosen.append(some[i])
        near = np.minimum(near, edit_distances([some[i]] * len(some), some))
    return chosen


def _near(left: np.ndarray, right: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of distances from pivots that differ by k at most everywhere."""
    close = np.ones((len(left), len(right)), bool)
    for a, b in zip(left.T, right.T, strict=True):
        close &= np.abs(a[:, None] - b[None, :]) <= k
    return np.nonzero(np.triu(close, 1) if same else close)


def pair_distances(texts: list[str], i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Edit distances of pairs of texts by their places, k + 1 for those above k: a column of the
    matrix is one word of bits, of the shorter text, and pairs go side by side."""
    codes, n = _codes(texts)
    letters, at = np.unique(codes, return_inverse=True)
    at = at.reshape(codes.shape)
    p, t = np.where(n[i] <= n[j], i, j), np.where(n[i] <= n[j], j, i)
    out = np.zeros(len(i), np.int64)
    long = n[p] > 64 if len(letters) * len(texts) <= TABLE else np.ones(len(i), bool)
    for cut in (np.flatnonzero(long)[s : s + BATCH] for s in range(0, int(long.sum()), BATCH)):
        out[cut] = edit_distances([texts[x] for x in p[cut]], [texts[x] for x in t[cut]], k)
    short = np.flatnonzero(~long)
    if not len(short):
        return np.minimum(out, k + 1)
    masks = np.zeros((len(texts), len(letters)), np.uint64)
    for c in range(min(64, codes.shape[1])):
        has = np.flatnonzero(n > c)
        masks[has, at[has, c]] |= np.uint64(1) << np.uint64(c)
    short = short[np.argsort(-n[t[short]], kind="stable")]
    one = np.uint64(1)
    for first in range(0, len(short), WORDS):
        rows = short[first : first + WORDS]
        a, b = p[rows], t[rows]
        score, top, lengths = n[a].copy(), np.maximum(n[a] - 1, 0).astype(np.uint64), n[b]
        up, down = np.full(len(rows), ~np.uint64(0)), np.zeros(len(rows), np.uint64)
        for c in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -c, "left"))  # longer than c: they come first
            eq, u, d = masks[a[:live], at[b[:live], c]], up[:live], down[:live]
            xv = eq | d
            xh = (((eq & u) + u) ^ u) | eq
            ph, mh = d | ~(xh | u), u & xh
            score[:live] += ((ph >> top[:live]) & one).astype(np.int64) - ((mh >> top[:live]) & one).astype(np.int64)
            ph, mh = (ph << one) | one, mh << one
            up[:live] = mh | ~(xv | ph)
            down[:live] = ph & xv
        out[rows] = np.where(n[a] > 0, score, lengths)
    return np.minimum(out, k + 1)


def _cells(texts: DataFrame, k: int, pivots: list[str] | None) -> DataFrame:
    """a, b (arrays of text and its distances far from pivots), same: what meets in a task, each
    pair of texts that no pivot tells apart once. Cells of many texts are cut into parts."""
    ensure_importable(texts.sparkSession)
    texts = written(texts.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct())
    chosen = choose_pivots(texts) if pivots is None else pivots

    def measure(batches):
        for b in batches:
            for part in (b.slice(i, BATCH) for i in range(0, b.num_rows, BATCH)):
                t = part.column(0).to_pylist()
                d = np.column_stack([np.fromiter(map(len, t), np.int64, len(t)) if p == "" else edit_distances([p] * len(t), t) for p in chosen])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(d.astype(np.int32)), pa.list_(pa.int32()))], names=["text", "far"])

    at = written(texts.mapInArrow(measure, "text string, far array<int>"))
    own = at.withColumn("key", F.transform("far", lambda d: F.floor(d / (k + 1)).cast("int")))
    heavy = own.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("_parts")).where("_parts > 1")
    own = own.join(heavy, "key", "left").withColumn("_p", F.pmod(F.xxhash64("text"), F.coalesce("_parts", F.lit(1))).cast("int"))
    cells = written(own.groupBy("key", "_p").agg(F.collect_list("text").alias("text"), F.collect_list("far").alias("far")))
    # of two cells the later one looks the earlier one up; a cell's parts do so among themselves
    ahead = [m for m in itertools.product((-1, 0, 1), repeat=len(chosen)) if m >= (0,) * len(chosen)]
    moves = F.array(*[F.array(*map(F.lit, m)) for m in ahead])
    a = cells.select(F.col("text").alias("a"), F.col("far").alias("fa"), F.col("_p").alias("_pa"), "key", F.explode(moves).alias("move"))
    a = a.select("a", "fa", "_pa", F.zip_with("key", "move", lambda x, y: x + y).alias("key"), F.forall("move", lambda m: m == 0).alias("_own"))
    b = cells.select(F.col("text").alias("b"), F.col("far").alias("fb"), F.col("_p").alias("_pb"), "key")
    met = a.join(b, "key").where("NOT _own OR _pa <= _pb").select("a", "fa", "b", "fb", (F.col("_own") & (F.col("_pa") == F.col("_pb"))).alias("same"))
    # few bytes, much work: spread by number
    return met.repartition(8 * texts.sparkSession.sparkContext.defaultParallelism)


def _met(batches, k: int):
    """The texts of each row of cells, and the pairs of them that no pivot tells apart."""
    for batch in batches:
        for row in batch.to_pylist():
            i, j = _near(np.array(row["fa"]), np.array(row["fb"]), k, row["same"])
            yield row["a"] + row["b"], i, j + len(row["a"])


def near_pairs(texts: DataFrame, k: int, pivots: list[str] | None = None) -> DataFrame:
    """a < b, d: all pairs of distinct texts whose edit distance d is k at most."""

    def compare(batches):
        for t, i, j in _met(batches, k):
            for cut in (slice(s, s + (1 << 20)) for s in range(0, len(i), 1 << 20)):
                d = pair_distances(t, i[cut], j[cut], k)
                x, y, d = i[cut][d <= k], j[cut][d <= k], d[d <= k]
                names = pa.array(t)
                rank = np.empty(len(t), np.int64)
                rank[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(t))
                turn = rank[x] > rank[y]
                x, y = np.where(turn, y, x), np.where(turn, x, y)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y)), pa.array(d.astype(np.int32))], names=["a", "b", "d"])

    return _cells(texts, k, pivots).mapInArrow(compare, "a string, b string, d int")


def share_compared(texts: DataFrame, k: int, pivots: list[str] | None = None) -> DataFrame:
    """texts, pairs, compared, share: how many pairs there are and how many are compared."""

    def count(batches):
        for _, i, _ in _met(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array([len(i)], pa.int64())], names=["n"])

    texts = written(texts.select("text").distinct())
    found = _cells(texts, k, pivots).mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("compared"))
    n = texts.where("text IS NOT NULL").agg(F.countDistinct("text").alias("texts"))
    one = F.lit(1).alias("_one")
    both = n.select("*", one).join(found.select("*", one), "_one").drop("_one")
    pairs = F.col("texts") * (F.col("texts") - 1) / 2
    return both.select("texts", pairs.cast("long").alias("pairs"), "compared", F.when(pairs > 0, F.col("compared") / pairs).alias("share"))
