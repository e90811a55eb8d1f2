"""Conversation structure repair by composition of weighted finite-state machines.

A conversation is an acceptor, a chain of its rows. An edit transducer maps it to what it
could have been: a row is kept, given another role or deleted, and empty rows are inserted.
An acceptor of roles knows what a conversation may be. Their composition is explored lazily,
from its start and no further than states that are reached, and its shortest path over
weights (cost, labels), compared in that order, is the repair and its audit.

Weights. The semiring's labels are strings. From a state two arcs of one label never lead to
different states, as the role that an insertion or a new role has to be follows from the
state; so among paths of equal cost the first label decides, and going through the states in
reverse topological order one label a state has to be kept, not a string. Three insertions in
a row would return to a state of the roles and cost more for nothing; the transducer's states
count them up to two, so the composition has no cycle and a topological order: by row, then
by insertions.

Scale. Equal rows become one row with a number. Rows are then sorted by ranges of
(conversation, turn, role, text), so a conversation of any size is spread over tasks, and cut
into pieces of bounded size. To the others a piece is a machine of four states (of the roles):
16 costs from state to state, and the order of the labels behind them. A conversation of
several pieces composes these, which tells each piece at which state the best path enters it
and what the rest costs behind it; the pieces then find their parts of the path in parallel.
What is left to one task is to join the audit, which is one value, and the hash of the
repaired text, which can only be made in order: it streams, piece by piece.

Edge cases: nulls in role, text and the key of the damage are one space; a null conv_id is a
conversation of its own; null turns come first, ties are ordered by role, then by the MD5 of
the text; a conversation whose rows are all dropped has zeros and an empty audit; a role
without characters has no initial, so its rows are never kept as they are; an empty table
gives no rows; other columns are not looked at; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import Memo, ensure_importable, written

KEEP, REROLE, DELETE, INSERT = 0, 1, 2, 5
TRUNCATED = 5
OK, CUT, GONE = 0, 1, 2
_FAR = 1 << 40

# ---- the machines --------------------------------------------------------------------

#: Acceptor of roles `(s?(ua)+)?`: state -> initial -> state.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
N = len(GRAMMAR)


class Edits:
    """The edit transducer: its states count insertions since the last row, at most two."""

    LAST = 2

    def arcs(self, state: int, symbol: int | None):
        """(label, cost, initial written or "" for none, whether a row is read, next state).
        symbol: the row next to be read, None at the end."""
        if state < self.LAST:
            for x in ROLES:
                yield "I", INSERT, x, False, state + 1
        if symbol is not None:
            initial, fault = symbol_parts(symbol)
            yield "D", DELETE, "", True, 0
            if fault != GONE:
                more = TRUNCATED * (fault == CUT)
                if initial:
                    yield "K", KEEP + more, initial, True, 0
                for x in ROLES:
                    yield "R", REROLE + more, x, True, 0


EDITS = Edits()


def symbol_of(initial: str, fault: int) -> int:
    """A row as the chain's symbol: its initial (s, u, a or another) and fault."""
    return 3 * ("sua".index(initial) if initial and initial in "sua" else 3) + fault


def symbol_parts(symbol: int) -> tuple[str, int]:
    return ("s", "u", "a", "")[symbol // 3], symbol % 3


#: Arcs of a layer by symbol, made when a symbol is first met: (state, label, cost, initial, reads, next).
_LAYERS: dict[int | None, list[list[tuple]]] = {}


def _layer(symbol: int | None) -> list[list[tuple]]:
    """The composition of transducer and roles at one symbol, by state N * insertions + role."""
    if symbol not in _LAYERS:
        _LAYERS[symbol] = [
            sorted((label, cost, x, reads, N * e2 + (GRAMMAR[g][x] if x else g)) for label, cost, x, reads, e2 in EDITS.arcs(e, symbol) if not x or x in GRAMMAR[g])
            for e in range(Edits.LAST + 1)
            for g in range(N)
        ]
    return _LAYERS[symbol]


def shortest(symbols: bytes, start: int, after: tuple[int, ...], ends: bool) -> tuple[int, list[tuple[str, str, bool]], int]:
    """(cost, steps, end) of the best path through a chain of rows that enters in the role state
    start; to leave in role state g costs after[g] more. A step is (label, initial, reads). With
    ends, rows may be inserted behind the last one; without, that is left to the next piece.
    Memory is a byte for each state that a row has."""
    n, width = len(symbols), N * (Edits.LAST + 1)
    reached, now = [], 1 << start  # the lazy part: which states are met from the start
    for i in range(n + ends):
        layer = _layer(symbols[i] if i < n else None)
        ahead, s = 0, 0
        while now >> s:
            if now >> s & 1:
                for _, _, _, reads, to in layer[s]:
                    if reads:
                        ahead |= 1 << to
                    else:
                        now |= 1 << to  # one insertion more: a state further on
            s += 1
        reached.append(now)
        now = ahead
    rest, choice = [after[s % N] for s in range(width)], bytearray(width * (n + ends))
    for i in range(n + ends - 1, -1, -1):
        layer = _layer(symbols[i] if i < n else None)
        here = list(rest) if i == n else [_FAR] * width
        for s in range(width - 1, -1, -1):  # most insertions first: reverse topological order
            if reached[i] >> s & 1:
                for k, (_, cost, _, reads, to) in enumerate(layer[s], 1):
                    total = cost + (rest if reads else here)[to]
                    if total < here[s]:  # arcs come by label: of equal costs the least one stays
                        here[s], choice[width * i + s] = total, k
        rest = here
    cost, steps, i, s = rest[start], [], 0, start
    while cost < _FAR and i < n + ends and choice[width * i + s]:
        label, _, x, reads, to = _layer(symbols[i] if i < n else None)[s][choice[width * i + s] - 1]
        steps.append((label, x, reads))
        i, s = i + reads, to
    return min(cost, _FAR), steps, s % N


#: What it costs to end a conversation in each state of the roles.
WHOLE = tuple(0 if g in FINAL else _FAR for g in range(N))
_KNOWN = Memo(lambda key: shortest(*key), 1 << 12)


def path(symbols: bytes, start: int = 0, after: tuple[int, ...] = WHOLE, ends: bool = True):
    """shortest(), remembered for short chains."""
    return _KNOWN[symbols, start, after, ends] if len(symbols) <= 64 else shortest(symbols, start, after, ends)


def summary(symbols: bytes) -> list[int]:
    """A piece as a machine of role states: costs from each to each (by rows), which place the
    best labels to each have in order, and costs from each to the end of the conversation."""
    table, order, ends = [], [], []
    for g in range(N):
        ways = [path(symbols, g, tuple(0 if h == x else _FAR for x in range(N)), False) for h in range(N)]
        labels = ["".join(step[0] for step in w[1]) for w in ways]
        table += [w[0] for w in ways]
        order += [sorted(labels).index(x) for x in labels]
        ends.append(path(symbols, g)[0])
    return table + order + ends


def entries(pieces: list[list[int]]) -> list[tuple[int, tuple[int, ...]]]:
    """For each piece of a conversation, from their summaries: the role state in which the best
    path enters it, and what the rest costs for each in which it leaves."""
    after = [WHOLE]
    for k in range(len(pieces) - 1, 0, -1):
        x = pieces[k]
        after.append(tuple(x[2 * N * N :]) if k == len(pieces) - 1 else tuple(min(_FAR, *(x[N * g + h] + after[-1][h] for h in range(N))) for g in range(N)))
    after.reverse()
    out, g = [], 0
    for x, rest in zip(pieces, after, strict=True):
        out.append((g, rest))
        g = min(range(N), key=lambda h: (x[N * g + h] + rest[h], x[N * N + N * g + h]))  # noqa: B023
    return out


# ---- rows, pieces, conversations -----------------------------------------------------

PIECE_ROWS, PIECE_CHARACTERS = 4096, 4 << 20
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n of the rows after the damage that crc32(conv_id:turn) % 20
    decides: 0 drops a row, 1 empties its text, 2 takes its marks of ends, 3 repeats it, 4 makes
    its role user. A dropped row has n = 0."""
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("damage") == 0, 0).when(F.col("damage") == 3, 2).otherwise(1).alias("n"))


def _rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number and faults. rows: conv_id, turn, role, text, n; rows of
    n = 0 only tell that a conversation is there."""
    there, none = F.col("n") > 0, F.lit(None)
    rows = rows.select("conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, F.col("text")).otherwise(none).alias("text"), "n")
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").cast("long").alias("n"))
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))
    end = F.rtrim("text", F.lit(SPACES))
    first = F.row_number().over(seen) == 1
    fault = F.when(end == "", "blank").when(~first, "duplicate").when(~F.substring(end, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.select("conv_id", "turn", "role", F.md5("text").alias("mark"), "text", "n", fault.alias("fault"))


class _Piece:
    def __init__(self, *head):
        self.head = head  # conv_id, turn, role, mark, no
        self.symbols, self.roles, self.texts, self.size = bytearray(), [], [], 0
        self.faults, self.turns, self.illegal = {"blank": 0, "duplicate": 0, "truncated": 0}, [], 0
        self.first = self.last = None  # initials

    def add(self, turn, role, text, fault):
        if self.last is None:
            self.first = role[:1]
        elif self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        if fault:
            self.faults[fault] += 1
        kind = GONE if fault in ("blank", "duplicate") else CUT if fault else OK
        self.symbols.append(symbol_of(role[:1], kind))
        self.roles.append(role if kind != GONE else None)
        self.texts.append(text if kind != GONE else None)
        self.size += len(text) if kind != GONE else 0

    def full(self, rows: int) -> bool:
        return len(self.symbols) >= rows or self.size >= PIECE_CHARACTERS


#: Initials of adjacent roles that fit together.
LEGAL = frozenset(("su", "ua", "au"))
#: What a piece carries, after conv_id. `turns`: the first and last that are there.
_HEAD = {"turn": "long", "role": "string", "mark": "string", "no": "long", "id": "string", "several": "boolean"}
_FACTS = {"turns": "array<long>", "n_turns": "long", "illegal": "long", "blank": "long", "duplicate": "long", "truncated": "long", "initials": "array<string>"}
_ROWS = {"machine": "array<long>", "symbols": "binary", "roles": "array<string>", "texts": "array<string>"}
_SOLVED = {"cost": "long", "audit": "string", "roles": "array<string>", "texts": "array<string>"}
_RESULT = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}


def _batch(rows: list[dict], conv_id: pa.DataType, kinds: dict[str, str]) -> pa.RecordBatch:
    plain = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    fields = {"conv_id": conv_id, **{k: plain[v] for k, v in kinds.items()}}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields.items()], names=list(fields))


def _ddl(conv_id: str, kinds: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in {"conv_id": conv_id, **kinds}.items())


def _to_pieces(piece_rows: int, batches):
    """Sorted rows to pieces. The pieces of a conversation that may go on in another task (a
    task's first and last one), or that has several here, get their machines."""
    part, number, piece, several, kind = TaskContext.get().partitionId(), 0, None, True, None

    def done(several):
        symbols = bytes(piece.symbols)
        facts = {"turns": [piece.turns[0], piece.turns[-1]] if piece.turns else [], "n_turns": len(piece.turns), "illegal": piece.illegal, **piece.faults, "initials": [piece.first, piece.last] if symbols else []}
        rows = {"machine": summary(symbols) if several else None, "symbols": symbols, "roles": piece.roles, "texts": piece.texts}
        head = dict(zip(("conv_id", "turn", "role", "mark", "no"), piece.head, strict=True))
        return _batch([head | facts | rows | {"id": f"{part}-{number}", "several": several}], kind, _HEAD | _FACTS | _ROWS)

    for b in batches:
        kind = b.column(0).type
        for k in range(0, b.num_rows, 512):
            for conv_id, turn, role, mark, text, n, fault in zip(*(c.to_pylist() for c in b.slice(k, 512).columns), strict=True):
                if piece is None or piece.head[0] != conv_id:
                    if piece is not None:
                        yield done(several)
                        several = False
                    piece, number = _Piece(conv_id, turn, role, mark, 0), number + 1
                for copy in range(n):
                    if piece.full(piece_rows):
                        several = True
                        yield done(several)
                        piece, number = _Piece(conv_id, turn, role, mark, copy), number + 1
                    piece.add(turn, role, text, fault if not copy or fault == "blank" else "duplicate")
    if piece is not None:
        yield done(True)


def _solve(batches):
    """Pieces, and where the path enters and what it costs behind them, to its part in them."""
    for b in batches:
        for k in range(0, b.num_rows, 64):
            rows = b.slice(k, 64).to_pylist()
            for r in rows:
                after = tuple(r["after"] or WHOLE)
                cost, steps, end = path(r["symbols"], r["start"] or 0, after, r["after"] is None)
                roles, texts, i = [], [], 0
                for label, x, reads in steps:
                    if label != "D":
                        roles.append(r["roles"][i] if label == "K" else ROLES[x])
                        texts.append("" if label == "I" else r["texts"][i])
                    i += reads
                r |= {"cost": cost - after[end], "audit": "".join(step[0] for step in steps), "roles": roles, "texts": texts}
            yield _batch(rows, b.column(b.schema.get_field_index("conv_id")).type, _HEAD | _FACTS | _SOLVED)


class _Conversation:
    """A conversation's pieces, one after another: what is kept of them is small."""

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.audit, self.sha, self.lines = conv_id, dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), [], hashlib.sha256(), 0
        self.turns, self.low, self.high, self.initial = 0, None, None, None

    def add(self, r):
        for k in self.counts:
            self.counts[k] += r[k]
        if r["initials"]:
            self.counts["illegal"] += self.initial is not None and self.initial + r["initials"][0] not in LEGAL
            self.initial = r["initials"][1]
        if r["turns"]:
            self.turns += r["n_turns"] - (self.high == r["turns"][0])
            self.low, self.high = r["turns"][0] if self.low is None else self.low, r["turns"][1]
        self.audit.append(r["audit"])
        for role, text in zip(r["roles"], r["texts"], strict=True):
            self.sha.update(("\n" * (self.lines > 0) + f"{role}:{text}").encode())
            self.lines += 1

    def result(self):
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _combine(batches):
    """Solved pieces, those of a conversation in order, to a row for each conversation."""
    now, kind = None, None
    for b in batches:
        kind, out = b.column(0).type, []
        for k in range(0, b.num_rows, 64):
            for r in b.slice(k, 64).to_pylist():
                if now is None or now.conv_id != r["conv_id"]:
                    out += [now.result()] if now else []
                    now = _Conversation(r["conv_id"])
                now.add(r)
        if out:
            yield _batch(out, kind, _RESULT)
    if now:
        yield _batch([now.result()], kind, _RESULT)


def solved_pieces(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> tuple[DataFrame, DataFrame]:
    """(whole conversations, pieces of larger ones), solved: conv_id, what orders the pieces of
    one (turn, role, mark, no), their facts, cost, audit, and roles and texts of the repaired rows."""
    spark = ensure_importable(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "mark"]
    sorted_rows = _rows(rows).repartitionByRange(n, *order).sortWithinPartitions(*order)
    pieces = written(sorted_rows.mapInArrow(partial(_to_pieces, piece_rows), _ddl(kind, _HEAD | _FACTS | _ROWS)))
    solved = _ddl(kind, _HEAD | _FACTS | _SOLVED)

    def enter(table):
        # nulls first, as Spark sorts
        heads = sorted(table.to_pylist(), key=lambda r: [(r[c] is not None, r[c] if r[c] is not None else 0) for c in ("turn", "role", "mark", "no")])
        found = entries([r["machine"] for r in heads])
        behind = [*(list(after) for _, after in found[:-1]), None]
        return pa.table([pa.array([r["id"] for r in heads], pa.string()), pa.array([g for g, _ in found], pa.int64()), pa.array(behind, pa.list_(pa.int64()))], names=["id", "start", "after"])

    machines = pieces.where("several").select("conv_id", "turn", "role", "mark", "no", "id", "machine")
    known = machines.groupBy("conv_id").applyInArrow(enter, "id string, start long, after array<long>")
    many = pieces.where("several").join(known, "id").select("conv_id", *_HEAD, *_FACTS, "symbols", "roles", "texts", "start", "after")
    nothing = {"start": F.lit(None).cast("long"), "after": F.lit(None).cast("array<long>")}
    one = pieces.where("NOT several").drop("machine").withColumns(nothing)
    return one.mapInArrow(_solve, solved), many.mapInArrow(_solve, solved)


def repair(rows: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each
    conversation. rows: conv_id, turn, role, text and, if there is one, n: how often the row is
    there (0: not, but its conversation is)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    one, many = solved_pieces(_counted(rows), piece_rows)
    result = _ddl(kind, _RESULT)
    ordered = many.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "mark", "no")
    return one.mapInArrow(_combine, result).unionByName(ordered.mapInArrow(_combine, result))


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, piece (what orders a conversation's pieces), place
    (in the piece, from 0), role, text."""
    one, many = solved_pieces(_counted(rows))
    both = one.unionByName(many).select("conv_id", F.struct("turn", "role", "mark", "no").alias("piece"), F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "row"))
    return both.select("conv_id", "piece", "place", F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))


def _counted(rows: DataFrame) -> DataFrame:
    clean = [F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))]
    return rows.select("conv_id", *clean, F.col("n") if "n" in rows.columns else F.lit(1).alias("n"))
