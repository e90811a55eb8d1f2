"""Best-fit packing of documents' tokens into sequences of several permitted lengths.

A document longer than the largest capacity is cut into pieces of it and a rest. Pieces
are dealt into groups by a hash; each group, a task's work, is packed by itself: pieces
in falling order of length go where they fit best. When none of the open bins has room,
a bin is opened whose size costs least for what is still to come: a bin of capacity c
costs `overhead + c + c * c / quadratic`, for the fixed, linear and attention shares of a
training step, and its price is that over the tokens it can be expected to hold. Several
such openings are tried on the group (each permitted size as the least to open) and the
cheapest packing, after every bin has been downsized to the smallest capacity that
holds its contents, is kept.

Bins are found by the room they have left: a bit for each amount of room, so a piece
costs one shift. Groups hold about `group_rows` pieces however many documents there are;
a group's last bins are all that is lost against packing everything at once.

pack_documents plans from lengths; pack_sequences makes the sequences themselves, with the
bounds of the documents in them. Its groups are bounded by the bytes of text as well.

Edge cases: documents of no tokens take no room and have no row; null lengths and null
texts count as none; a null doc_id stays null; repeated rows are packed each; ties in length
go by id and piece; a text of any length is cut into pieces of the largest capacity.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.byte_bpe import SPACE_STARTS, Chunks, read_ranks
from eventloom.llm.common import LONGEST_KEPT, Memo, ensure_importable

CAPACITIES, OVERHEAD, QUADRATIC, GROUP_ROWS = (512, 1024, 2048, 4096, 8192), 16, 65536, 20000
#: Bytes of text in a group of pack_sequences, about: its tokens are one task's work.
GROUP_BYTES = 32 << 20
#: Tokens of the sequences that a group hands on at a time, about.
HANDED_TOKENS = 1 << 19


def cost(capacity: int, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + capacity + capacity * capacity / quadratic


def _fill(lengths: list[int], sizes: list[int], price: dict[int, float]) -> tuple[list[int], list[int]]:
    """Bin of each length (in falling order) and what each bin holds, opening only `sizes`
    or, for a longer piece, the least size that takes it."""
    room_bits, open_bins, held, room, where = 0, {}, [], [], []
    left, largest = sum(lengths), max(price)
    for n in lengths:
        found = room_bits >> n
        if found:
            r = n + (found & -found).bit_length() - 1
            stack = open_bins[r]
            b = stack.pop()
            if not stack:
                room_bits &= ~(1 << r)
        else:
            fits = [c for c in sizes if c >= n] or [min(c for c in price if c >= n)]
            # what a bin can still hold is bounded by what is left; the least cost for a token is opened
            r = min(fits, key=lambda c: (price[c] / min(c, max(left, n)), c))
            b = len(held)
            held.append(0)
            room.append(r)
        r = room[b] - n
        room[b] = r
        held[b] += n
        left -= n
        where.append(b)
        if 0 < r <= largest:
            open_bins.setdefault(r, []).append(b)
            room_bits |= 1 << r
    return where, held


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> tuple[list[int], list[int]]:
    """Bin of each length, lengths in falling order, and each bin's capacity after downsizing."""
    sizes = sorted(capacities)
    price = {c: cost(c, overhead, quadratic) for c in sizes}
    best = None
    for i in range(len(sizes)):
        for allowed in ([sizes[i]], sizes[i:]):
            where, held = _fill(lengths, allowed, price)
            final = [next(c for c in sizes if c >= h) for h in held]
            total = sum(price[c] for c in final)
            if best is None or total < best[0]:
                best = total, where, final
    return best[1], best[2]


def pack_documents(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row for each piece of the rows of docs (doc_id, n_tokens): doc_id, piece,
    token_start, n_tokens, bin_id, bin_capacity, bin_start (the piece's place in its bin).

    The number of rows sets the number of groups, which costs a count of docs."""
    largest = max(capacities)
    n = F.col("n_tokens")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(n.cast("long"), F.lit(0)).alias("n_tokens")).where(n > 0)
    pieces = rows.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / largest))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * largest).alias("token_start"), F.least(F.lit(largest), n - F.col("piece") * largest).cast("long").alias("n_tokens"))
    many = rows.agg(F.sum(F.floor((n - 1) / largest) + 1)).first()[0] or 0
    groups = max(1, -(-many // group_rows))
    # the row's number keeps rows of one id, or of none, from meeting in one group
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def run(key, table):
        table, bins, final, starts = _packed(table, capacities, overhead, quadratic)
        first = key[0].as_py() << 32
        return pa.table([*(table.column(c) for c in ("doc_id", "piece", "token_start", "n_tokens")), pa.array([first + b for b in bins], pa.int64()), pa.array([final[b] for b in bins], pa.int32()), pa.array(starts, pa.int64())], names=["doc_id", "piece", "token_start", "n_tokens", "bin_id", "bin_capacity", "bin_start"])

    return dealt.groupBy("group").applyInArrow(run, "doc_id long, piece long, token_start long, n_tokens long, bin_id long, bin_capacity int, bin_start long")


def _packed(table: pa.Table, capacities: tuple[int, ...], overhead: float, quadratic: float) -> tuple[pa.Table, list[int], list[int], list[int]]:
    """A group's pieces in falling order, the bin and the place in it of each, and the bins' sizes."""
    table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    bins, final = pack(table.column("n_tokens").to_pylist(), capacities, overhead, quadratic)
    at, starts = [0] * len(final), []
    for b, size in zip(bins, table.column("n_tokens").to_pylist(), strict=True):
        starts.append(at[b])
        at[b] += size
    return table, bins, final, starts


_LIBRARY: dict[tuple[str, str], tuple[Callable[[str], bytes], np.dtype]] = {}


def _library(rank_file: str, pattern: str) -> tuple[Callable[[str], bytes], np.dtype]:
    """One library encoder a worker process, and the type that its ids fit."""
    if (rank_file, pattern) not in _LIBRARY:
        ranks = read_ranks(rank_file)
        lib = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        encode = lambda s: array(kind.char, lib.encode_ordinary(s)).tobytes()
        look_up = Chunks(encode, Memo(encode, 1 << 18, LONGEST_KEPT).__getitem__, 1 << 18).packed
        _LIBRARY[rank_file, pattern] = look_up if pattern in SPACE_STARTS else encode, kind
    return _LIBRARY[rank_file, pattern]


def _sequences(first: int, batches: Iterable[pa.RecordBatch], capacities: tuple[int, ...], overhead: float, quadratic: float, handed: int = HANDED_TOKENS) -> Iterator[pa.RecordBatch]:
    """A group's sequences, about `handed` tokens of them at a time; bins count from first.

    Its tokens are held once, as they came, and widened only as they are handed on. Workers are
    used again: what one needed to cut texts is not kept beside the groups that follow."""
    _LIBRARY.clear()
    pa.default_memory_pool().release_unused()
    largest, ids, rest = max(capacities), [], []
    for b in batches:
        ids += b.column("ids").to_pylist()
        # taken, that is copied: a slice would keep the whole batch
        rest.append(b.select(["doc_id", "piece", "n_tokens"]).take(pa.array(np.arange(b.num_rows))))
        del b
    table = pa.Table.from_batches(rest).append_column("row", pa.array(np.arange(len(ids))))
    kind = np.dtype(f"<u{len(ids[0]) // table.column('n_tokens')[0].as_py()}")
    table, bins, final, starts = _packed(table, capacities, overhead, quadratic)
    order = np.argsort(bins, kind="stable")  # pieces of a bin keep their order
    ends = np.cumsum([0, *np.bincount(bins, minlength=len(final))]).astype(np.int32)
    table = table.take(pa.array(order)).combine_chunks()
    held = np.cumsum([0, *table.column("n_tokens").to_pylist()])[ends]
    rows = table.column("row").to_pylist()
    values = [pa.concat_arrays(table.column("doc_id").chunks), pa.array(np.asarray(table.column("piece")) * largest), pa.array(np.array(starts, np.int32)[order])]
    cuts = [*np.unique(np.searchsorted(held, np.arange(0, held[-1], handed))).tolist(), len(final)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i == j:
            continue
        at, to = ends[i], ends[j]
        tokens = np.frombuffer(b"".join([ids[r] for r in rows[at:to]]), kind).astype(np.int32)
        bounds = pa.array(ends[i : j + 1] - at)
        cols = [pa.array(first + np.arange(i, j)), pa.array(final[i:j], pa.int32()), pa.array(np.diff(held[i : j + 1]), pa.int64())]
        cols += [pa.ListArray.from_arrays(bounds, v.slice(at, to - at)) for v in values]
        cols.append(pa.ListArray.from_arrays(pa.array((held[i : j + 1] - held[i]).astype(np.int32)), pa.array(tokens)))
        yield pa.RecordBatch.from_arrays(cols, names=["bin_id", "bin_capacity", "n_tokens", "doc_ids", "token_starts", "starts", "ids"])


def pack_sequences(docs: DataFrame, rank_file: str, pattern: str, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each sequence: bin_id, bin_capacity, n_tokens; for the pieces in it, in
    order, doc_ids, token_starts (where a piece begins in its document) and starts (where in
    the sequence); and ids, the tokens. docs: doc_id, text.

    Tokens are the library's, looked up in chunks where byte_bpe.Chunks is for the pattern. Rows and
    bytes of docs set the number of groups, which costs a scan of docs; tokens are exchanged once."""
    ensure_importable(docs.sparkSession)
    largest = max(capacities)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    groups = max(1, -(-size.n // group_rows), -(-(size.bytes or 0) // group_bytes))

    def cut(batches):
        packed, kind = _library(rank_file, pattern)
        for b in (batch.slice(i, 256) for batch in batches for i in range(0, batch.num_rows, 256)):
            owner, piece, ids, sizes = [], [], [], []
            for row, text in enumerate(b.column(1).to_pylist()):
                raw = packed(text) if text else b""
                for k, at in enumerate(range(0, len(raw), largest * kind.itemsize)):
                    part = raw[at : at + largest * kind.itemsize]
                    owner.append(row)
                    piece.append(k)
                    sizes.append(len(part) // kind.itemsize)
                    ids.append(part)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int32())), pa.array(piece, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "n_tokens", "ids"])

    pieces = rows.mapInArrow(cut, "doc_id long, piece long, n_tokens long, ids binary")
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sequences(key[0].as_py() << 32, batches, capacities, overhead, quadratic)

    return dealt.groupBy("group").applyInArrow(run, "bin_id long, bin_capacity int, n_tokens long, doc_ids array<long>, token_starts array<long>, starts array<int>, ids array<int>")
