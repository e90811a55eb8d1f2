"""Approximate nearest neighbours by multiprobe p-stable hashing.

`tables` hash tables each cut `functions` Gaussian projections of a vector into steps of
a width set from the data's spread. A query visits, in each table, its own bucket and then
perturbed ones, a step up or down in some functions, in order of their estimated chance:
the sum of squared distances to the borders crossed. What the buckets hold is merged and
ranked by exact distance in double precision.

A query's vector goes once to each group of buckets that it visits there; its probes are
pairs of numbers. Equal vectors are indexed once, with the `k + 1` smallest ids that have them, which is all
that a result can show. A bucket of more than `part` vectors is split into parts, each a
task's work, and its probes go to all parts. Tasks return the k nearest for each query, so
what is exchanged after the search grows with queries, not with bucket sizes.

The spread comes from a sample of at most SAMPLE vectors; every vector is indexed.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do those of another length than most; repeated rows count once; an id with
several vectors is as near as its nearest; ties go to the smaller id; a query whose buckets
hold fewer than k others is compared with all vectors, in blocks, so fewer than k come back
only where there are no more; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import binary, ensure_importable, few_files, mix2, written

TABLES, FUNCTIONS, WIDTH, PROBES, PART, SAMPLE = 10, 8, 2.0, 100, 4096, 2000
#: Growth of probes with each function more.
MORE = 1.8
#: Bytes of vectors, at four for each component, in a group of buckets: indexed they take some twenty times that.
GROUP_BYTES = 1 << 19


def functions_for(vectors: int) -> int:
    """Hash functions of a table: FUNCTIONS, and one more for each eightfold of vectors beyond
    8192. Among more vectors the nearest are nearer, and finer buckets still hold them, if more
    of these are visited: see probes_for."""
    return FUNCTIONS + max(0, round(math.log(max(1, vectors) / 8192, 8)))


def probes_for(functions: int) -> int:
    """Buckets visited in a table: PROBES, and MORE times as many for each function beyond
    FUNCTIONS. Each function cuts buckets in two or more, of which this visits nearly all that
    matter: recall holds, and the share of vectors visited falls by a sixth."""
    return round(PROBES * MORE ** max(0, functions - FUNCTIONS))


class Hashes:
    def __init__(self, dims: int, spread: float, tables: int = TABLES, functions: int = FUNCTIONS, width: float = WIDTH, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.width = width * max(spread, 1e-30)
        self.directions = rng.standard_normal((tables, dims, functions))
        self.shifts = rng.random((tables, functions)) * self.width

    def places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Steps and, in them, how far above the lower border, for all tables: (tables, rows, functions)."""
        p = (np.einsum("nd,tdm->tnm", x, self.directions) + self.shifts[:, None]) / self.width
        steps = np.floor(p)
        return steps.astype(np.int64), p - steps

    @staticmethod
    def keys(steps: np.ndarray) -> np.ndarray:
        """One 64-bit key for each table and row."""
        key = np.broadcast_to(np.arange(len(steps), dtype=np.uint64).reshape(-1, *[1] * (steps.ndim - 2)), steps.shape[:-1])
        for m in range(steps.shape[-1]):
            key = mix2(key, steps[..., m].astype(np.uint64), 71)
        return key.view(np.int64)


def perturbations(above: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The first `probes` sets of (function, step) by the sum of squared border distances.

    Sets are indices into the 2m single steps in order of distance; from each set two more
    follow, its last index moved on by one or the next index added, so a heap gives all in order."""
    single = sorted([(a * a, m, -1) for m, a in enumerate(above)] + [((1 - a) ** 2, m, 1) for m, a in enumerate(above)])
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(single[0][0], (0,))]
    while heap and len(out) < probes:
        cost, chosen = heapq.heappop(heap)
        moves = [single[i][1:] for i in chosen]
        if len({m for m, _ in moves}) == len(moves):
            out.append(moves)
        last = chosen[-1]
        if last + 1 < len(single):
            heapq.heappush(heap, (cost + single[last + 1][0], (*chosen, last + 1)))
            heapq.heappush(heap, (cost - single[last][0] + single[last + 1][0], (*chosen[:-1], last + 1)))
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1) if raw else np.zeros((0, 1))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, functions: int | None = None, width: float = WIDTH, probes: int | None = None, part: int = PART) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query; score is the distance.

    vectors: vec_id and embedding (array of numbers); is_query: which rows are queries."""
    ensure_importable(vectors.sparkSession)
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & v.isNotNull() & good)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims, functions = lengths.n, functions or functions_for(lengths["count"])
    probes = probes or probes_for(functions)
    rows = rows.where(F.size("v") == dims)
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(SAMPLE).select("v").collect()])
    spread = float(np.sqrt(((sample - sample.mean(0)) ** 2).sum(1).mean())) or float(np.sqrt((sample**2).sum(1).mean()))
    n = max(2, math.ceil(lengths["count"] * dims * 4 / GROUP_BYTES))

    def packed(batch):
        flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
        return [r.tobytes() for r in flat.reshape(-1, dims)]

    def index(batches):
        h = Hashes(dims, spread, tables, functions, width)
        for b in batches:
            if b.num_rows:
                raw = packed(b)
                key = h.keys(h.places(_matrix(binary(raw)))[0])
                ids = b.column("ids").take(pa.array(np.tile(np.arange(len(raw)), tables)))
                yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), binary(raw * tables), ids], names=["key", "vector", "ids"])

    def ask(batches):
        h = Hashes(dims, spread, tables, functions, width)
        for b in batches:
            raw = packed(b)
            for q, form, one in zip(b.column("query_id").to_pylist(), b.column("form").to_pylist(), raw, strict=True):
                steps, above = h.places(np.frombuffer(one, "<f8")[None])
                moved = np.repeat(steps, probes, axis=1)
                count = np.zeros(tables, int)
                for t in range(tables):
                    sets = perturbations(above[t, 0].tolist(), probes)
                    count[t] = len(sets)
                    for i, moves in enumerate(sets):
                        for m, step in moves:
                            moved[t, i, m] += step
                key = h.keys(moved)
                keys = np.concatenate([key[t, : count[t]] for t in range(tables)])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([q] * len(keys), pa.int64()), pa.array([form] * len(keys), pa.int64())], names=["key", "query_id", "form"])

    same = Window.partitionBy("v").orderBy("vec_id")
    distinct = rows.select("vec_id", "v").distinct()
    first = distinct.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1)
    entries = first.groupBy("v").agg(F.collect_list("vec_id").alias("ids"))
    indexed = entries.mapInArrow(index, "key long, vector binary, ids array<long>")
    # an id may ask with several vectors: form tells them apart
    askers = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("form"), "v").distinct()
    asked = askers.mapInArrow(ask, "key long, query_id long, form long")
    parts = indexed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > part).select("key", F.ceil(F.col("size") / part).alias("parts"))
    split = indexed.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("vector"), F.coalesce("parts", F.lit(1))))
    spread_out = asked.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)))
    unit, group = F.xxhash64("key", "part").alias("unit"), F.pmod(F.xxhash64("key", "part"), F.lit(n)).alias("group")

    def search(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        units, x, ids = left.column("unit").to_numpy(), _matrix(left.column("vector")), left.column("ids").to_pylist()
        order = np.argsort(units, kind="stable")
        units, x, ids = units[order], x[order], [ids[i] for i in order]
        told = pc.is_valid(right.column("vector"))
        y, right = right.filter(told), right.filter(pc.invert(told))
        at = {pair: i for i, pair in enumerate(zip(y.column("query_id").to_pylist(), y.column("form").to_pylist(), strict=True))}
        y, asked_units, q = _matrix(y.column("vector")), right.column("unit").to_numpy(), right.column("query_id").to_numpy()
        at = [at[pair] for pair in zip(q.tolist(), right.column("form").to_pylist(), strict=True)]
        best: dict[int, dict[int, float]] = {}
        places = np.argsort(asked_units, kind="stable")
        cuts = np.flatnonzero(np.diff(asked_units[places], prepend=asked_units[places[0]] - 1))
        for a, b in zip(cuts, np.append(cuts[1:], len(places)), strict=True):
            u = asked_units[places[a]]
            low, high = np.searchsorted(units, u), np.searchsorted(units, u, "right")
            if low == high:
                continue
            block = x[low:high]
            for p in places[a:b]:
                d = np.sqrt(((block - y[at[p]]) ** 2).sum(1))
                # every entry as near as the (k+1)-th has to come along, for ties by id
                limit = np.partition(d, k)[k] if len(d) > k + 1 else np.inf
                mine = best.setdefault(int(q[p]), {})
                for i in np.flatnonzero(d <= limit):
                    for v_id in ids[low + i]:
                        if v_id != q[p] and d[i] < mine.get(v_id, np.inf):
                            mine[v_id] = float(d[i])
        out = [(a, v_id, d) for a, mine in best.items() for v_id, d in heapq.nsmallest(k, mine.items(), key=lambda e: (e[1], e[0]))]
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([binary(packed(b)), *[b.column(c) for c in b.schema.names if c != "v"]], names=["vector", *[c for c in b.schema.names if c != "v"]])

    queries = askers.mapInArrow(pack, "vector binary, query_id long, form long")

    def with_vectors(probes):
        """Rows group, unit, query_id, form, and once a group and query its vector."""
        once = probes.select("group", "query_id", "form").distinct().join(queries, ["query_id", "form"])
        none = F.lit(None)
        return probes.select("group", "unit", "query_id", "form", none.cast("binary").alias("vector")).unionByName(once.select("group", none.cast("long").alias("unit"), "query_id", "form", "vector"))

    probes = with_vectors(spread_out.select(group, unit, "query_id", "form"))
    found = split.select(group, unit, "vector", "ids").groupBy("group").cogroup(probes.groupBy("group")).applyInArrow(search, "query_id long, vec_id long, score double")
    found = written(found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    # queries with fewer than k so far: exactly, against every block of vectors
    enough = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)

    short = askers.join(enough, "query_id", "left_anti").select("query_id", "form").distinct()
    short = written(short, few_files(vectors))
    if not short.isEmpty():
        block = F.pmod(F.xxhash64("vector"), F.lit(n)).alias("unit")
        held = entries.mapInArrow(pack, "vector binary, ids array<long>").select(block, "vector", "ids").withColumn("group", F.col("unit"))
        everywhere = with_vectors(short.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("group", F.col("unit")))
        more = held.groupBy("group").cogroup(everywhere.groupBy("group")).applyInArrow(search, "query_id long, vec_id long, score double")
        found = found.union(more).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
