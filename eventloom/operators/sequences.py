"""From event logs to ordered state sequences, and between the shapes sequences come in.

The canonical shape is long: one row for each position, with the columns that identify a
sequence, `pos` (from 1, without holes) and `state` (null where nothing was observed).
Every ordering takes a tiebreak column, so results don't depend on how rows are stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.expressions import bounded

#: Texts that stand for a missing state.
VOID = ("%", "*", "", "NA", "NaN")


def clean(state: Column) -> Column:
    return F.when(~state.isin(*VOID), state)


def time_formats() -> list[str]:
    """Candidate formats for text times: dates that start with the year, then with the day,
    then with the month, then with names of months, each with any clock; last, digits alone."""
    years = ["yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd"]
    days = ["dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy"]
    months = ["MM/dd/yyyy", "MM-dd-yyyy", "MM.dd.yyyy"]
    names = ["d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy"]
    clocks = ["'T'HH:mm:ss.SSSX", "'T'HH:mm:ssX", "'T'HH:mm:ss", "'T'HH:mm", " HH:mm:ss.SSS", " HH:mm:ss", " HH:mm", ""]
    return [date + clock for date in years + days + months + names for clock in clocks] + ["yyyyMMddHHmmss", "yyyyMMddHHmm"]


def parse_time(df: DataFrame, column: str, formats: Sequence[str] | None = None, unix_unit: str | None = None) -> DataFrame:
    """df with `column` as a timestamp. Numbers count units since 1970; for texts, the first
    format that any value has is taken for all values, others become null."""
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp"):
        return df.withColumn(column, F.col(column).cast("timestamp"))
    if unix_unit or kind in ("integer", "long", "double", "float", "short", "decimal"):
        scale = {"seconds": 1_000_000, "milliseconds": 1_000, "microseconds": 1}[unix_unit or "seconds"]
        return df.withColumn(column, F.timestamp_micros((F.col(column).cast("double") * scale).cast("long")))
    formats = list(formats or time_formats())
    parsed = [F.try_to_timestamp(F.trim(column), F.lit(f)) for f in formats]
    found = df.agg(*[F.count(p).alias(f"c{i}") for i, p in enumerate(parsed)]).first()
    best = next((i for i in range(len(formats)) if found[i]), None)
    if best is None:
        raise ValueError(f"no known time format fits {column}")
    return df.withColumn(column, parsed[best])


def sessions(df: DataFrame, actor: Sequence[str], time: str, order: Sequence[str], gap_seconds: float | None = 900) -> DataFrame:
    """df with `session` (from 1 in each actor) and `pos` (from 1 in each session).

    A session ends where the gap to the next event is larger than gap_seconds, or unknown;
    with None an actor is one session. All windows share one partitioning and one order, so
    there is one exchange and one sort: the position in a session is the actor's row number
    less the one where the session began."""
    by = Window.partitionBy(*actor).orderBy(time, *order)
    number = F.row_number().over(by)
    if gap_seconds is None:
        return df.withColumn("session", F.lit(1).cast("long")).withColumn("pos", number)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    gap = (micros - F.lag(micros).over(by)) / 1e6
    starts = F.when(gap.isNull() | (gap > gap_seconds), 1).otherwise(0)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_starts", starts).withColumn("_number", number)
    began = F.max(F.when(F.col("_starts") == 1, F.col("_number"))).over(so_far)
    return out.select("*", F.sum("_starts").over(so_far).alias("session"), (F.col("_number") - began + 1).alias("pos")).drop("_starts", "_number")


def session_metadata(df: DataFrame, seq: Sequence[str], numbers: Sequence[str] = (), labels: Sequence[str] = ()) -> DataFrame:
    """One row for each sequence: means of numbers; the most frequent of labels, the one
    that comes first among equals. df has `pos`."""
    out = df.groupBy(*seq).agg(F.count(F.lit(1)).alias("n_events"), *[F.avg(c).alias(c) for c in numbers])
    for c in labels:
        counts = df.where(F.col(c).isNotNull()).groupBy(*seq, c).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
        top = counts.groupBy(*seq).agg(F.max_by(c, F.struct("n", -F.col("first"))).alias(c))
        out = out.join(top, list(seq), "left")
    return out


def wide_to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], drop_missing: bool = True) -> DataFrame:
    """One row for each of `columns`: ids, pos, state."""
    out = df.select(*ids, F.posexplode(F.array(*[clean(F.col(c).cast("string")) for c in columns])).alias("at", "state")).select(*ids, (F.col("at") + 1).alias("pos"), "state")
    return out.where("state IS NOT NULL") if drop_missing else out


def long_to_wide(df: DataFrame, seq: Sequence[str], length: int, prefix: str = "V") -> DataFrame:
    """One row for each sequence with columns prefix1 to prefix<length>, null past its end."""
    return df.where(F.col("pos") <= length).groupBy(*seq).pivot("pos", list(range(1, length + 1))).agg(F.first("state")).select(*seq, *[F.col(str(i)).alias(f"{prefix}{i}") for i in range(1, length + 1)])


def states_of(df: DataFrame, state: str = "state") -> list[str]:
    """The alphabet in binary order. It is small by nature: states label a model's nodes."""
    return sorted(r[0] for r in bounded(df.select(clean(F.col(state)).alias("s")).where("s IS NOT NULL").distinct(), 10_000, "states"))


def one_hot(df: DataFrame, state: str, states: Sequence[str], prefix: str = "") -> DataFrame:
    """df with a 0/1 column for each state; null where the state is null."""
    return df.select("*", *[(F.col(state) == s).cast("int").alias(prefix + s) for s in states])


def windowed_one_hot(df: DataFrame, by: Sequence[str], codes: Sequence[str], order: Sequence[str], size: int, sliding: bool = False, interval: int | None = None) -> DataFrame:
    """Windows of `size` rows as sequences of sets: by, window, and for each code how many of
    the window's rows have it. Tumbling windows keep a shorter last one; sliding ones move
    by a row and are complete. interval cuts each run of rows into parts of that length."""
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    rows = df.withColumn("_rn", rn)
    keys = list(by)
    if interval:
        rows = rows.withColumn("part", F.floor(F.col("_rn") / interval)).withColumn("_rn", F.col("_rn") % interval)
        keys.append("part")
    if not sliding:
        return rows.groupBy(*keys, F.floor(F.col("_rn") / size).alias("window")).agg(*[F.sum(c).alias(c) for c in codes])
    frame = Window.partitionBy(*keys).orderBy("_rn").rowsBetween(0, size - 1)
    out = rows.select(*keys, F.col("_rn").alias("window"), *[F.sum(c).over(frame).alias(c) for c in codes], F.count(F.lit(1)).over(frame).alias("_n"))
    return out.where(F.col("_n") == size).drop("_n")


def sequence_counts(df: DataFrame, seq: Sequence[str], states: Sequence[str]) -> DataFrame:
    """One row for each sequence with the count of each state."""
    return df.where("state IS NOT NULL").groupBy(*seq).pivot("state", list(states)).count().na.fill(0)


def sequence_presence(df: DataFrame, seq: Sequence[str], states: Sequence[str]) -> DataFrame:
    counts = sequence_counts(df, seq, states)
    return counts.select(*seq, *[(F.col(f"`{s}`") > 0).cast("int").alias(s) for s in states])


def edge_list(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Consecutive states, gaps closed: seq, pos (of the first), from, to."""
    by = Window.partitionBy(*seq).orderBy("pos")
    return df.where("state IS NOT NULL").select(*seq, "pos", F.col("state").alias("from"), F.lead("state").over(by).alias("to")).where("to IS NOT NULL")


def follows(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    """Each state with the one before it."""
    by = Window.partitionBy(*seq).orderBy("pos")
    return df.where("state IS NOT NULL").select(*seq, "pos", F.col("state").alias("act"), F.lag("state").over(by).alias("follows")).where("follows IS NOT NULL")


def endpoints(df: DataFrame, seq: Sequence[str], length: int | None = None) -> DataFrame:
    """First and last observed state and step, how many are observed, and dropped_out: something
    was observed, but not at the last step (`length`, or the longest sequence's)."""
    last = F.lit(length) if length else F.max("n").over(Window.partitionBy())
    seen = F.col("state").isNotNull()
    at = F.when(seen, F.col("pos"))
    ends = df.groupBy(*seq).agg(F.min_by("state", at).alias("first_state"), F.min(at).alias("first_step"), F.max_by("state", at).alias("last_state"), F.max(at).alias("last_step"), F.count("state").alias("n_observed"), F.max("pos").alias("n"))
    if length is None:
        longest = df.agg(F.max("pos")).first()[0]
        last = F.lit(longest)
    return ends.withColumn("dropped_out", (F.col("n_observed") > 0) & (F.col("last_step") < last)).drop("n")


def _unique_label(label: str, states: Sequence[str]) -> str:
    while label in states:
        label += "."
    return label


def mark_ends(df: DataFrame, seq: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Missing states before the first observed one become `start`, those after the last `end`."""
    by = Window.partitionBy(*seq)
    at = F.when(F.col("state").isNotNull(), F.col("pos"))
    first, last = F.min(at).over(by), F.max(at).over(by)
    known = states_of(df) if start or end else []
    state = F.col("state")
    if start:
        state = F.when(F.col("pos") < first, F.lit(_unique_label(start, known))).otherwise(state)
    if end:
        state = F.when(F.col("pos") > last, F.lit(_unique_label(end, known))).otherwise(state)
    return df.withColumn("state", state)


def with_markers(df: DataFrame, seq: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Sequences with an extra first and last position: seq, pos, state. The end marker comes
    right after the last observed state; sequences without any state get none."""
    out = df.select(*seq, "pos", "state")
    ends = df.where("state IS NOT NULL").groupBy(*seq).agg(F.max("pos").alias("last"))
    if start:
        out = out.unionByName(ends.select(*seq, F.lit(0).alias("pos"), F.lit(start).alias("state")))
    if end:
        kept = out.join(ends, list(seq)).where(F.col("pos") <= F.col("last")).drop("last")
        out = kept.unionByName(ends.select(*seq, (F.col("last") + 1).alias("pos"), F.lit(end).alias("state")))
    return out


def bipartite_groups(df: DataFrame, player: str, group: str, weight: str | None = None) -> DataFrame:
    """Incidence player, group, weight: 1, or the summed weight; groups without weight go."""
    rows = df.where(F.col(player).isNotNull() & F.col(group).isNotNull())
    value = F.sum(weight) if weight else F.lit(1.0)
    rows = rows.where(F.col(weight).isNotNull()) if weight else rows
    out = rows.groupBy(F.col(player).alias("node"), F.col(group).alias("hyperedge")).agg((value if weight else F.max(value)).cast("double").alias("weight"))
    return out.where("weight > 0")
