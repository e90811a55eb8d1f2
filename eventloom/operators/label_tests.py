"""Permutation test of k-grams: do groups of sequences differ in how often a path occurs?

A replicate gives the sequences their groups' labels in another order. Sequences are dealt
into blocks of bounded size; how many of each label a block gets in every replicate is drawn
by halving the blocks again and again, each half from a generator of its own, so a task finds
its block's labels in as many steps as halvings, totals are exact, and no task sees all
sequences. Inside a block a sequence's labels in all replicates are one bit vector a group.
A pattern's counts in all replicates are sums of its sequences' vectors, taken a slice of
replicates at a time: one pass over the patterns' occurrences, however many replicates. Sums
of blocks are added up in two steps, so that a pattern of all sequences is no task's alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.expressions import benjamini_hochberg, bounded
from eventloom.operators.higher_order import grams, sequence_compare
from eventloom.operators.margins import _hypergeometric
from eventloom.session import ensure_importable
from eventloom.storage import written

#: Sequences in a block, patterns that one task sums, replicates in a slice, groups.
BLOCK, PATTERNS, SLICE, MOST_GROUPS = 4096, 2000, 64, 100


def block_totals(seed: int, bounds: np.ndarray, totals: np.ndarray, n_perm: int, block: int) -> np.ndarray:
    """How many sequences of each label a block has in each replicate (n_perm x labels). bounds:
    the sequences before each block, and all of them."""
    low, high = 0, len(bounds) - 1
    here = np.tile(totals.astype(np.int64), (n_perm, 1))
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng((seed, low, high))
        need, rest = np.full(n_perm, bounds[middle] - bounds[low], np.int64), here.sum(1)
        left = np.zeros_like(here)
        for g in range(len(totals)):
            rest = rest - here[:, g]
            left[:, g] = _hypergeometric(rng, here[:, g], rest, need)
            need = need - left[:, g]
        here, low, high = (left, low, middle) if block < middle else (here - left, middle, high)
    return here


def block_labels(seed: int, bounds: np.ndarray, totals: np.ndarray, n_perm: int, block: int) -> np.ndarray:
    """The label (its number) of each sequence of a block in each replicate: n_perm x sequences."""
    ends = np.cumsum(block_totals(seed, bounds, totals, n_perm, block), 1)
    places = np.arange(bounds[block + 1] - bounds[block])
    codes = (places[None, :, None] >= ends[:, None, :-1]).sum(2).astype(np.uint8)
    return np.random.default_rng((seed, block)).permuted(codes, axis=1)


def bit_sums(bits: np.ndarray, places: np.ndarray, times: np.ndarray, starts: np.ndarray, n_perm: int) -> np.ndarray:
    """Sums (patterns x n_perm) of the sequences' bit vectors (n_perm / 8 x sequences) over each
    pattern's occurrences, `times` each: occurrences lie pattern by pattern from `starts` on."""
    out = np.zeros((len(starts), n_perm), np.int32)
    for k in range(0, n_perm, SLICE):
        some = np.unpackbits(bits[k // 8 : (k + SLICE) // 8], axis=0)[: n_perm - k, places]
        out[:, k : k + SLICE] = np.add.reduceat(some * times[None, :], starts, axis=1).T
    return out


def _added(df: DataFrame, keys: list[str]) -> DataFrame:
    """Arrays of int64 in the column sums, added up by keys."""

    def run(key, table):
        total = 0
        for raw in table.column("sums").to_pylist():
            total = total + np.frombuffer(raw, np.int64)
        return pa.table([*(pa.array([k.as_py()], t) for k, t in zip(key, types, strict=True)), pa.array([total.tobytes()], pa.binary())], names=[*keys, "sums"])

    types = [{"int": pa.int32(), "string": pa.string(), "bigint": pa.int64()}[df.schema[k].dataType.simpleString()] for k in keys]
    return df.select(*keys, "sums").groupBy(*keys).applyInArrow(run, df.select(*keys, "sums").schema)


def replicate_counts(rows: DataFrame, seq: Sequence[str], group: str, kept: DataFrame, sizes: Sequence[int], n_perm: int, seed: int, block: int = BLOCK) -> tuple[DataFrame, list, np.ndarray]:
    """(length, pattern, sums; labels; how many sequences have each): sums hold, for each label
    and replicate, how often the pattern occurs in sequences that have it. kept: length, pattern."""
    ensure_importable(rows.sparkSession)
    labels = bounded(rows.groupBy(F.col(group).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy("label"), MOST_GROUPS, "groups")
    totals = np.array([r.n for r in labels], np.int64)
    n_blocks = max(1, math.ceil(int(totals.sum()) / block))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*seq), F.lit(n_blocks)).cast("int"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(F.xxhash64(*seq), *seq)) - 1
    dealt = written(dealt.select("_block", place.alias("_place"), "states"))
    counts = {r[0]: r[1] for r in dealt.groupBy("_block").count().collect()}  # one number a block
    bounds = np.concatenate([[0], np.cumsum([counts.get(b, 0) for b in range(n_blocks)])])
    buckets = max(1, math.ceil(kept.count() / PATTERNS))
    found = None
    for k in sizes:
        part = grams(dealt, k, ["_block", "_place"]).select("_block", "_place", F.lit(k).alias("length"), F.array_join("gram", " -> ").alias("pattern"))
        found = part if found is None else found.unionByName(part)
    found = found.join(kept.select("length", "pattern"), ["length", "pattern"], "left_semi")
    found = found.groupBy("_block", "_place", "length", "pattern").agg(F.count(F.lit(1)).alias("times"))
    found = found.withColumn("_bucket", F.pmod(F.xxhash64("length", "pattern"), F.lit(buckets)).cast("int"))

    def run(key, table):
        b = key[0].as_py()
        codes = block_labels(seed, bounds, totals, n_perm, b)
        names = list(zip(table.column("length").to_pylist(), table.column("pattern").to_pylist(), strict=True))
        number = {x: i for i, x in enumerate(sorted(set(names)))}
        which = np.fromiter((number[x] for x in names), np.int64, len(names))
        order = np.argsort(which, kind="stable")
        starts = np.flatnonzero(np.diff(which[order], prepend=-1))
        places, times = table.column("_place").to_numpy()[order], table.column("times").to_numpy()[order].astype(np.int32)
        sums = np.stack([bit_sums(np.packbits(codes == g, axis=0), places, times, starts, n_perm) for g in range(len(totals))], 1)
        raw = [x.astype(np.int64).tobytes() for x in sums]
        return pa.table([pa.array([x[0] for x in number], pa.int32()), pa.array([x[1] for x in number], pa.string()), pa.array([b % 64] * len(number), pa.int32()), pa.array(raw, pa.binary())], names=["length", "pattern", "part", "sums"])

    parts = found.groupBy("_block", "_bucket").applyInArrow(run, "length int, pattern string, part int, sums binary")
    return _added(_added(parts, ["length", "pattern", "part"]), ["length", "pattern"]), [r.label for r in labels], totals


def kgram_test(rows: DataFrame, seq: Sequence[str], group: str, sizes: Sequence[int] = (3, 4, 5), min_freq: int = 5, n_perm: int = 1000, seed: int = 1, adjust: str = "BH") -> DataFrame:
    """length, pattern, statistic, effect, p_value, adjusted: for the patterns that occur min_freq
    times or more in every group, how far their counts are from what totals allow (the root of
    summed squares over groups), that in deviations of its mean over relabellings, and the share
    of these that are as far. rows: seq, group, states. adjust: BH or none."""
    seen = written(sequence_compare(rows, group, sizes, min_freq).select("length", "pattern", "group", "count"))
    kept = seen.select("length", "pattern").distinct()
    sums, labels, _ = replicate_counts(rows, seq, group, kept, sizes, n_perm, seed)
    sums = written(sums)
    n = len(labels)
    place = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(i))])
    own = seen.groupBy("length", "pattern").agg(F.array_sort(F.collect_list(F.struct(place[F.col("group")].alias("g"), F.col("count").alias("c")))).alias("own"))
    # totals of groups over the patterns kept, as they were and in each replicate: numbers of a bounded list
    whole = {(r.length, r.group): r.c for r in seen.groupBy("length", "group").agg(F.sum("count").alias("c")).collect()}
    in_all = {r.length: np.frombuffer(r.sums, np.int64).reshape(n, n_perm) for r in _added(sums.withColumn("part", F.pmod(F.xxhash64("pattern"), F.lit(64)).cast("int")), ["length", "part"]).transform(lambda d: _added(d, ["length"])).collect()}

    def run(batches):
        for b in batches:
            out = []
            for length, pattern, raw, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(raw, np.int64).reshape(n, n_perm).astype(float)
                total, columns = x[:, :1].sum(), in_all[length].astype(float)
                null = np.sqrt(((x - total * columns / columns.sum(0)) ** 2).sum(0))
                seen_here = np.zeros(n)
                for c in cells:
                    seen_here[c["g"]] = c["c"]
                column = np.array([whole.get((length, v), 0) for v in labels], float)
                stat = math.sqrt(((seen_here - total * column / column.sum()) ** 2).sum())
                sd = null.std(ddof=1) if n_perm > 1 else 0.0
                out.append((length, pattern, stat, (stat - null.mean()) / (sd or 1.0), (1 + int((null >= stat - 1e-9).sum())) / (n_perm + 1)))
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()), strict=True)], names=["length", "pattern", "statistic", "effect", "p_value"])

    tested = sums.join(own, ["length", "pattern"]).select("length", "pattern", "sums", "own").mapInArrow(run, "length int, pattern string, statistic double, effect double, p_value double")
    if adjust == "none":
        return tested.withColumn("adjusted", F.col("p_value"))
    tested = written(tested)
    return tested.join(benjamini_hochberg(tested, "p_value"), "p_value").select("length", "pattern", "statistic", "effect", "p_value", "adjusted")
