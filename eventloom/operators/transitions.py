"""Networks of states from sequences: counts of pairs of positions, in several senses.

Inputs are long sequences (seq columns, pos, state); outputs are edges (from, to, weight),
only those that occur. A pair with a missing state on either side is no pair.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.session import ensure_importable
from eventloom.storage import written


def pairs(df: DataFrame, seq: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Adjacent pairs: seq, pos, from, to. One exchange by sequence, no join."""
    by = Window.partitionBy(*seq).orderBy("pos")
    rows = df.select(*seq, *keep, "pos", F.col("state").alias("from"), F.lead("state").over(by).alias("to"), F.lead("pos").over(by).alias("next"))
    return rows.where("from IS NOT NULL AND to IS NOT NULL AND next = pos + 1").drop("next")


def frequency(df: DataFrame, seq: Sequence[str], group: Sequence[str] = (), weighted: bool = False) -> DataFrame:
    """Counts of adjacent pairs; weighted counts each as 1 / observed length of its sequence."""
    found = pairs(df, seq, group)
    if weighted:
        lengths = F.count("state").over(Window.partitionBy(*seq))
        found = pairs(df.withColumn("_len", lengths), seq, [*group, "_len"])
        return found.groupBy(*group, "from", "to").agg(F.sum(1 / F.col("_len")).alias("weight"))
    return found.groupBy(*group, "from", "to").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def normalise_rows(edges: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Weights as shares of what leaves their node. Edges are few: the window is over them."""
    total = F.sum("weight").over(Window.partitionBy(*group, "from"))
    return edges.withColumn("weight", F.when(total != 0, F.col("weight") / total).otherwise(0.0))


def relative(df: DataFrame, seq: Sequence[str], group: Sequence[str] = (), weighted: bool = False) -> DataFrame:
    return normalise_rows(frequency(df, seq, group, weighted), group)


def initial(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    """state, probability: how sequences start, by their first observed state."""
    at = F.when(F.col("state").isNotNull(), F.col("pos"))
    first = df.groupBy(*seq).agg(F.min_by("state", at).alias("state")).where("state IS NOT NULL")
    counts = first.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("state", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("probability"))


def windowed(df: DataFrame, seq: Sequence[str], size: int, span: int = 1) -> DataFrame:
    """Each position of a window of size * span positions with each of the next window.

    Windows meet as counts of states, so a window pair costs states, not positions, squared."""
    width = size * span
    counts = df.where("state IS NOT NULL").groupBy(*seq, F.floor((F.col("pos") - 1) / width).alias("window"), "state").agg(F.count(F.lit(1)).alias("n"))
    a = counts.select(*seq, "window", F.col("state").alias("from"), F.col("n").alias("na"))
    b = counts.select(*seq, (F.col("window") - 1).alias("window"), F.col("state").alias("to"), F.col("n").alias("nb"))
    return a.join(b, [*seq, "window"]).groupBy("from", "to").agg(F.sum(F.col("na") * F.col("nb")).cast("double").alias("weight"))


def co_occurrence(df: DataFrame, seq: Sequence[str], group: Sequence[str] = (), weighted: bool = False) -> DataFrame:
    """Pairs of positions of a sequence, both ways round, the diagonal once: symmetric.

    A sequence enters as counts n of its states: n_a n_b pairs of two states, n (n - 1) / 2
    of one, which is what enumerating its positions would count."""
    counts = df.where("state IS NOT NULL").groupBy(*seq, *group, "state").agg(F.count(F.lit(1)).alias("n"))
    if weighted:
        counts = counts.withColumn("share", 1 / F.sum("n").over(Window.partitionBy(*seq)))
    else:
        counts = counts.withColumn("share", F.lit(1.0))
    a = counts.select(*seq, *group, F.col("state").alias("from"), F.col("n").alias("na"), "share")
    b = counts.select(*seq, F.col("state").alias("to"), F.col("n").alias("nb"))
    both = a.join(b, list(seq))
    n = F.when(F.col("from") == F.col("to"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    return both.groupBy(*group, "from", "to").agg(F.sum(n * F.col("share")).alias("weight")).where("weight > 0")


def attention(df: DataFrame, seq: Sequence[str], scale: float = 1.0, direction: str = "forward", time: str | None = None, decay: Callable[[Column], Column] | None = None) -> DataFrame:
    """All pairs of positions of a sequence, weighted by a decay of their distance.

    The default, exp(-distance / scale) of positions or of a time column, is a sum that is
    carried along a sequence (see _decayed): linear in the sequence. A decay of one's own takes
    a join by sequence, whose size is the sum of squared lengths; so do sequences whose time
    falls along their positions, as their distances don't add up."""
    rows = df.where("state IS NOT NULL")
    at = F.col(time or "pos").cast("double")
    rows = rows.select(*seq, "pos", at.alias("t"), "state")
    if decay is not None:
        return _all_pairs(rows, seq, direction, decay)
    falling = None
    if time is not None:
        rows = rows.where("t IS NOT NULL")
        before = F.lag("t").over(Window.partitionBy(*seq).orderBy("pos"))
        falling = rows.select(*seq, (F.col("t") < before).alias("_falls")).where("_falls").select(*seq).distinct()
        odd, rows = rows.join(falling, list(seq), "left_semi"), rows.join(falling, list(seq), "left_anti")
    ahead = _decayed(rows, seq, scale)
    back = ahead.select(F.col("to").alias("from"), F.col("from").alias("to"), "weight")
    out = {"forward": ahead, "backward": back}.get(direction)
    out = ahead.union(back) if out is None else out
    if falling is not None:
        out = out.union(_all_pairs(odd, seq, direction, lambda gap: F.exp(-gap / scale)))
    return out.groupBy("from", "to").agg(F.sum("weight").alias("weight")).where("weight > 0")


def _all_pairs(rows: DataFrame, seq: Sequence[str], direction: str, decay: Callable[[Column], Column]) -> DataFrame:
    a = rows.select(*seq, F.col("pos").alias("pa"), F.col("t").alias("ta"), F.col("state").alias("from"))
    b = rows.select(*seq, F.col("pos").alias("pb"), F.col("t").alias("tb"), F.col("state").alias("to"))
    side = {"forward": F.col("pa") < F.col("pb"), "backward": F.col("pa") > F.col("pb"), "both": F.col("pa") != F.col("pb")}[direction]
    return a.join(b, list(seq)).where(side).groupBy("from", "to").agg(F.sum(decay(F.abs(F.col("ta") - F.col("tb")))).alias("weight"))


def _scan(v: np.ndarray, t: np.ndarray, start: np.ndarray, scale: float) -> np.ndarray:
    """Each row's own vector plus those of earlier rows of its sequence, decayed to its time:
    sums over the last 1, 2, 4, ... rows, each made of two of the one before. start: the first
    row of a row's sequence."""
    n, d, at = len(v), 1, np.arange(len(v))
    longest = int((at - start).max(initial=0))
    while d <= longest:
        from_ = at - d >= start
        i = at[from_]
        add = v[i - d] * np.exp(-(t[i] - t[i - d]) / scale)[:, None]
        v = v.copy()
        v[i] += add
        d *= 2
    return v[:n]


def _same(column: pa.Array) -> np.ndarray:
    """Whether each value is that of the row before (nulls are alike)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    equal = pc.fill_null(pc.equal(a, b), False)
    return pc.or_(equal, pc.and_(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def _decayed(rows: DataFrame, seq: Sequence[str], scale: float) -> DataFrame:
    """from, to, weight: the sum of exp(-(b - a) / scale) over rows a before b of a sequence.

    Rows are sorted by ranges of sequence and position, so a sequence of any length is spread
    over tasks. A task scans its rows in batches, carrying a
    vector of decayed sums, one a state, from batch to batch. Of its first and last sequence,
    which may go on in other tasks, it also tells what it leaves at the end, and how what comes
    from before would count; the parts of a sequence, at most one a task, then hand that on to
    each other."""
    ensure_importable(rows.sparkSession)
    kinds = {c: rows.schema[c].dataType.simpleString() for c in seq}
    n = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select(*seq, "pos", "t", "state").repartitionByRange(n, *seq, "pos").sortWithinPartitions(*seq, "pos")
    sums = pa.map_(pa.string(), pa.float64())
    about = {"_from": pa.string(), "_to": pa.string(), "_weight": pa.float64(), "_pos": pa.int64(), "_first": pa.float64(), "_last": pa.float64(), "_ins": sums, "_outs": sums}

    def run(batches):
        names: dict[str, int] = {}
        edges: dict[tuple[int, int], float] = {}
        carry, head, parts, types = None, None, [], None

        def close():
            ins, outs = ([(s, float(x[i])) for s, i in names.items() if i < len(x) and x[i] > 0] for x in (carry["ins"], carry["v"]))
            parts.append((*head, carry["pos"], carry["first"], carry["t"], ins, outs))

        for whole in batches:
            types = types or [whole.schema.field(c).type for c in seq]
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                keys = [b.column(c) for c in range(len(seq))]
                pos, t = b.column(len(seq)).to_pylist(), b.column(len(seq) + 1).to_numpy()
                code = np.fromiter((names.setdefault(s, len(names)) for s in b.column(len(seq) + 2).to_pylist()), np.int64, b.num_rows)
                new = np.ones(b.num_rows, bool)
                new[1:] = ~np.logical_and.reduce([_same(k) for k in keys])
                first = tuple(k[0].as_py() for k in keys)
                goes_on = head is not None and head == first
                v = np.zeros((b.num_rows, len(names)))
                v[np.arange(b.num_rows), code] = 1.0
                start = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), 0))
                scanned = _scan(v, t, start, scale)
                mine = start == 0  # rows of the sequence that may have begun before
                if goes_on:
                    old = np.zeros(len(names))
                    old[: len(carry["v"])] = carry["v"]
                    scanned[mine] += old * np.exp(-(t[mine] - carry["t"]) / scale)[:, None]
                earlier = np.zeros_like(scanned)  # not scanned - v: next to 1 small sums would be lost
                inner = np.flatnonzero(~new)
                earlier[inner] = scanned[inner - 1] * np.exp(-(t[inner] - t[inner - 1]) / scale)[:, None]
                if goes_on:
                    earlier[0] = old * np.exp(-(t[0] - carry["t"]) / scale)
                for to in np.unique(code).tolist():
                    total = earlier[code == to].sum(0)
                    for i in np.flatnonzero(total).tolist():
                        edges[i, to] = edges.get((i, to), 0.0) + float(total[i])
                if not goes_on and head is not None and not parts:
                    close()  # a task's first sequence has ended
                cut = np.flatnonzero(new)
                if not goes_on:
                    carry = {"pos": pos[0], "first": float(t[0]), "ins": np.zeros(0)}
                ins = np.zeros(len(names))
                ins[: len(carry["ins"])] = carry["ins"]
                carry["ins"] = ins + np.bincount(code[mine], np.exp(-(t[mine] - carry["first"]) / scale), len(names))
                head = first
                if len(cut) > 1:
                    if not parts:
                        end = int(cut[1]) - 1
                        carry |= {"v": scanned[end], "t": float(t[end])}
                        close()
                    at = int(cut[-1])
                    head, last = tuple(k[at].as_py() for k in keys), start == at
                    carry = {"pos": pos[at], "first": float(t[at]), "ins": np.bincount(code[last], np.exp(-(t[last] - t[at]) / scale), len(names))}
                carry |= {"v": scanned[-1], "t": float(t[-1])}
        if head is not None:
            close()
        names_of = list(names)
        rows_out = [(*p[: len(seq)], None, None, None, *p[len(seq) :]) for p in parts]
        rows_out += [(*[None] * len(seq), names_of[i], names_of[j], x, None, None, None, None, None) for (i, j), x in edges.items()]
        if rows_out:
            fields = dict(zip(seq, types, strict=True)) | about
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows_out, strict=True), fields.values(), strict=True)], names=list(fields))

    def hand_on(pdf: pd.DataFrame) -> pd.DataFrame:
        """Parts of one sequence, in order: what each leaves counts in all behind it."""
        state: dict[str, float] = {}
        time, out = 0.0, {}
        for r in pdf.sort_values("_pos").to_dict("records"):
            fade = math.exp(-(r["_first"] - time) / scale) if state else 0.0
            for a, x in state.items():
                for b, y in dict(r["_ins"]).items():
                    out[a, b] = out.get((a, b), 0.0) + x * fade * y
            fade = math.exp(-(r["_last"] - time) / scale) if state else 0.0
            state = {a: x * fade for a, x in state.items()}
            for a, x in dict(r["_outs"]).items():
                state[a] = state.get(a, 0.0) + x
            time = r["_last"]
        return pd.DataFrame([(a, b, x) for (a, b), x in out.items()], columns=["from", "to", "weight"])

    schema = ", ".join([*(f"{c} {k}" for c, k in kinds.items()), "_from string, _to string, _weight double, _pos long, _first double, _last double, _ins map<string,double>, _outs map<string,double>"])
    found = written(ordered.mapInArrow(run, schema))
    inside = found.where("_weight IS NOT NULL").select(F.col("_from").alias("from"), F.col("_to").alias("to"), F.col("_weight").alias("weight"))
    across = found.where("_weight IS NULL").groupBy(*seq).applyInPandas(hand_on, "from string, to string, weight double")
    return inside.union(across).groupBy("from", "to").agg(F.sum("weight").alias("weight")).where("weight > 0")


def _long_codes(df: DataFrame, keys: Sequence[str], codes: Sequence[str], at: str) -> DataFrame:
    packed = F.filter(F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).cast("double").alias("x")) for c in codes]), lambda e: e["x"] != 0)
    return df.select(*keys, F.col(at).alias("window"), F.explode(packed).alias("e")).select(*keys, "window", "e.code", "e.x")


def one_hot_windows(df: DataFrame, keys: Sequence[str], codes: Sequence[str], order: Sequence[str], size: int = 1, sliding: bool = False, kind: str = "transition") -> DataFrame:
    """Window networks of 0/1 columns: codes of a window with those of the next (transition),
    or with each other (cooccurrence, diagonal included). Size 1 takes rows as they are."""
    from eventloom.operators.sequences import windowed_one_hot

    windows = windowed_one_hot(df, keys, codes, order, size, sliding and size > 1)
    rows = _long_codes(windows, keys, codes, "window")
    a = rows.select(*keys, "window", F.col("code").alias("from"), F.col("x").alias("xa"))
    step = 1 if kind == "transition" else 0
    b = rows.select(*keys, (F.col("window") - step).alias("window"), F.col("code").alias("to"), F.col("x").alias("xb"))
    return a.join(b, [*keys, "window"]).groupBy("from", "to").agg(F.sum(F.col("xa") * F.col("xb")).alias("weight"))


def resolve_codes(columns: Sequence[str], codes: Sequence[str] | str | tuple[int, int] | None = None, without: Sequence[str] = ()) -> list[str]:
    """Names of 0/1 columns: as they are; "a:b", all from a to b; (i, j), places from 1; or,
    with none, all columns but `without`."""
    if codes is None:
        return [c for c in columns if c not in without]
    if isinstance(codes, str):
        first, _, last = codes.partition(":")
        codes = list(columns)[list(columns).index(first) : list(columns).index(last or first) + 1]
    elif codes and all(isinstance(c, int) for c in codes):
        codes = list(columns)[codes[0] - 1 : codes[-1]]
    missing = [c for c in codes if c not in columns]
    if missing:
        raise ValueError(f"no columns {', '.join(missing)}")
    return list(codes)


def window_network(df: DataFrame, keys: Sequence[str], codes: Sequence[str] | str | tuple[int, int] | None, order: Sequence[str], size: int = 1, sliding: bool = False, kind: str = "transition", relative: bool = False) -> DataFrame:
    """The window network of 0/1 columns, as counts or as shares of what leaves a code; kind
    "both" gives the two networks in one, told apart by the column `network`."""
    names = resolve_codes(df.columns, codes, [*keys, *order])
    if kind == "both":
        parts = [window_network(df, keys, names, order, size, sliding, k, relative).withColumn("network", F.lit(k)) for k in ("transition", "cooccurrence")]
        return parts[0].unionByName(parts[1])
    edges = one_hot_windows(df, keys, names, order, size, sliding, kind)
    return normalise_rows(edges) if relative else edges


def one_hot_initial(df: DataFrame, keys: Sequence[str], codes: Sequence[str], order: Sequence[str]) -> DataFrame:
    """state, probability: in each actor's first row with any code, 1/k for each of its k."""
    active = sum((F.col(c).cast("int") for c in codes), F.lit(0))
    rows = df.withColumn("_k", active).where("_k > 0")
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1")
    parts = first.select(F.explode(F.array(*[F.struct(F.lit(c).alias("state"), (F.col(c) / F.col("_k")).alias("p")) for c in codes])).alias("e")).select("e.*")
    sums = parts.groupBy("state").agg(F.sum("p").alias("p"))
    return sums.where("p > 0").select("state", (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("probability"))
