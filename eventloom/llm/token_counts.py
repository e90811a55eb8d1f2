"""Token counts by prefix dynamic programming over a sentencepiece byte-pair model.

The pieces of a text's encoding have this property: every two neighbours are what their
own joined characters encode to, and only one sequence of pieces over a text has it. So
the last piece of each prefix is the one that ends there, is compatible with the last
piece before it, and gives ``count[i] = count[i - len(piece)] + 1``. One pass holds the
exact count of every prefix, which answers "how many tokens has this cut" and "what is
the longest cut within a budget" without encoding anything again.

No piece holds the space mark after another character, so a text falls apart before each
run of space marks into segments that encode by themselves. The counts at every prefix of a
segment are stored in a bounded table; a text's count is the sum of its segments' last ones,
and a cut within a budget is found in the one segment where the sum passes it. Words of a
batch that are not in the table go through the same programme side by side, one place of all
of them at a time. Memory a worker needs is bounded by that table and one batch.

Models are those that take text as it is: no normalisation, a space mark in front, white
space kept. Others are refused, as are those with a piece that has the mark inside.

Edge cases: a null or empty text has no tokens, and its cut is 0; a null doc_id stays null; unknown characters count as their UTF-8
bytes (byte fallback) or, in a model without it, a run of them as one; a very long word
costs time in proportion to its length; repeated rows are counted each on its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from eventloom.llm.common import LONGEST_KEPT, Memo, ensure_importable

MARK = "▁"
INF = float("inf")
#: Bits of a piece's number in the key of a pair.
SHIFT = 20
#: Texts whose words are looked up together, words that are counted side by side.
LOT, ABREAST = 512, 1 << 15


class MergeRules:
    """Pairwise compatibility of tokens under merges in order of rank.

    rank: token -> rank, tokens being str or bytes. A token's two spines are the parts
    at its left and right edge in the order they come about; two tokens are compatible
    if at no time a part at the right edge of the first merges with one at the left edge
    of the second before either is taken into a larger part of its own token.
    """

    def __init__(self, rank: dict):
        self.rank = rank
        self.spines = Memo(self._trace, 1 << 15)
        self.pairs = Memo(self._pair, 1 << 17)

    def merge(self, token) -> list[tuple]:
        """(part, time, left spine, right spine) of the parts that token's units merge to."""
        rank = self.rank
        parts = [(u := token[i : i + 1], -1, [(u, -1)], [(u, -1)]) for i in range(len(token))]
        time = -1
        while len(parts) > 1:
            at, best = -1, INF
            for i in range(len(parts) - 1):
                r = rank.get(parts[i][0] + parts[i + 1][0], INF)
                if r < best:
                    at, best = i, r
            if at < 0:
                break
            time = max(time, best)
            a, b = parts[at], parts[at + 1]
            whole = a[0] + b[0]
            parts[at : at + 2] = [(whole, time, [*a[2], (whole, time)], [*b[3], (whole, time)])]
        return parts

    def _trace(self, token) -> tuple:
        """The left and right spine; empty if merges never make the token."""
        parts = self.merge(token)
        return (parts[0][2], parts[0][3]) if len(parts) == 1 else ()

    def reachable(self, token) -> bool:
        return bool(self.spines[token])

    def _pair(self, pair: tuple) -> bool:
        right, left = self.spines[pair[0]][1], self.spines[pair[1]][0]
        a = b = 0
        while True:
            next_a = right[a + 1][1] if a + 1 < len(right) else INF
            next_b = left[b + 1][1] if b + 1 < len(left) else INF
            across = self.rank.get(right[a][0] + left[b][0], INF)
            if across < next_a and across <= next_b and across < INF:
                return False
            if next_a == next_b == INF:
                return True
            if next_a <= next_b:
                a += 1
            else:
                b += 1

    def compatible(self, first, second) -> bool:
        return self.pairs[first, second]


class Table:
    """Whole numbers for 64-bit keys; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.iinfo(np.int64).max), np.append(values[order], -1)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where(self.keys[at] == keys, self.values[at], -1)


class Abreast:
    """The dynamic programme for many segments side by side: at each place the pieces that end
    there are tried for all of them from the shortest on, by steps in a trie of pieces read
    backwards. Whether a pair fits is kept in a slot for it; a pair whose slot another has
    taken is asked for anew."""

    def __init__(self, names: list[str], fits: Callable[[int], bool], slot_bits: int = 21):
        self.fits, self.shift = fits, np.uint64(64 - slot_bits)
        self.slots = np.full(1 << slot_bits, -1, np.int64)
        chars = sorted(set("".join(names)))
        self.known = np.array(list(map(ord, chars)), np.int64)
        number = {c: i for i, c in enumerate(chars)}
        self.n = len(chars)
        steps: dict[int, int] = {}
        piece_at = [-1]
        for i, name in enumerate(names):
            node = 0
            for c in reversed(name):
                key = node * self.n + number[c]
                if key not in steps:
                    steps[key] = len(piece_at)
                    piece_at.append(-1)
                node = steps[key]
            piece_at[node] = i
        self.steps = Table(np.fromiter(steps.keys(), np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps)))
        self.piece_at = np.array(piece_at)

    def _compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        keys = first << SHIFT | second
        slot = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        found = self.slots[slot]
        if len(other := np.flatnonzero(found >> 1 != keys)):
            new, back = np.unique(keys[other], return_inverse=True)
            told = new << 1 | np.fromiter(map(self.fits, new.tolist()), np.int64, len(new))
            found[other] = self.slots[slot[other]] = told[back]
        return (found & 1).astype(bool)

    def counts(self, segments: list[str]) -> list[int]:
        """The tokens of each segment; -1 for one with an unknown character."""
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        char = np.minimum(np.searchsorted(self.known, code), self.n - 1)
        start = np.cumsum(size) - size
        strange = np.zeros(len(segments), bool)
        strange[np.repeat(np.arange(len(segments)), size)[self.known[char] != code]] = True
        out = np.where(strange, -1, 0)
        rows = np.flatnonzero(~strange)
        rows = rows[np.argsort(-size[rows], kind="stable")]
        start, size = start[rows], size[rows]
        count, last = np.zeros((2, int(size.max(initial=0)) + 1, len(rows)), np.int64)
        for end in range(1, len(count)):
            row = np.arange(np.count_nonzero(size >= end))
            node = np.zeros(len(row), np.int64)
            for at in range(end - 1, -1, -1):
                node = self.steps[node * self.n + char[start[row] + at]]
                row, node = row[node >= 0], node[node >= 0]
                piece = self.piece_at[node]
                fits = piece >= 0
                if at and fits.any():
                    fits[fits] = self._compatible(last[at, row[fits]], piece[fits])
                last[end, row[fits]] = piece[fits]
                count[end, row[fits]] = count[at, row[fits]] + 1
                row, node = row[~fits], node[~fits]
                if not len(row):
                    break
        out[rows] = count[size, np.arange(len(rows))]
        return out.tolist()


class PrefixCounter:
    """Counts of a sentencepiece BPE model, for whole texts and for every prefix."""

    def __init__(self, model_file: str, keep: int = 1 << 17):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        spec = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
        norm, kind = spec.normalizer_spec, spec.trainer_spec.model_type
        if kind != 2 or norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models that take text as it is, with a space mark in front, are counted")
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.fallback = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the space mark after another character: segments would not be independent")
        self.rules = MergeRules(pieces)
        self.known = set("".join(pieces))
        # numbers for all that can be a token: pieces that merges make, and single characters
        self.names = sorted({p for p in pieces if self.rules.reachable(p)} | self.known)
        self.number = {p: i for i, p in enumerate(self.names)}
        if len(self.names) >> SHIFT:
            raise ValueError("the model has too many pieces")
        self.pairs = Memo(lambda key: self.rules._pair((self.names[key >> SHIFT], self.names[key & (1 << SHIFT) - 1])), 1 << 18)
        self.longest = max(map(len, pieces))
        # a line end that is a byte token stands between segments: nothing joins it
        self.lines = self.fallback and "\n" not in self.known
        #: The counts at every prefix of a segment, as the dynamic programme gave them.
        self.stored = Memo(lambda s: array("I", self.prefixes(s)), max(1, keep >> 2), LONGEST_KEPT)
        self.by_segment = Memo(lambda s: self.stored[s][-1], keep, LONGEST_KEPT)
        self.by_word = Memo(lambda w: self.stored[MARK + w][-1], keep, LONGEST_KEPT)
        self.abreast = Abreast(self.names, self.pairs.__getitem__)

    _segment = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def prefixes(self, segment: str) -> list[int]:
        """Tokens of segment[:0], segment[:1], ...: the dynamic programme."""
        number, pairs, longest = self.number.get, self.pairs, self.longest
        count, last = [0], [-1]
        for end in range(1, len(segment) + 1):
            c = segment[end - 1]
            if c not in self.known:
                run = not self.fallback and end > 1 and segment[end - 2] not in self.known
                count.append(count[-1] + (len(c.encode()) if self.fallback else 1 - run))
                last.append(-1)
                continue
            for start in range(end - 1, max(end - longest, 0) - 1, -1):
                piece = number(segment[start:end])
                if piece is not None and ((before := last[start]) < 0 or pairs[before << SHIFT | piece]):
                    count.append(count[start] + 1)
                    last.append(piece)
                    break
        return count

    def count(self, text: str | None) -> int:
        """Tokens of a whole text, as the library's encode gives them."""
        if not text:
            return 0
        if not self._plain(text):
            return sum(map(self.by_segment.__getitem__, self.segments(text)))
        total = 0
        for k, line in enumerate(text.split("\n")):
            if k:
                total += 1
            words = line.split(" ")
            if k and words[0]:
                total += self.by_segment[words[0]]
                del words[0]
            elif k:
                del words[0]
            total += sum(map(self.by_word.__getitem__, words))
        return total

    def _plain(self, text: str) -> bool:
        """Whether the text's segments are its words, with a mark in front, in lines."""
        return self.lines and text[0] != " " and "  " not in text and MARK not in text

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of whole texts: unknown words of a lot are counted side by side before."""
        out: list[int] = []
        for i in range(0, len(texts), LOT):
            lot = texts[i : i + LOT]
            lines = [t.split("\n") for t in lot if t and self._plain(t)]
            self._learn(self.by_word, MARK, {w for some in lines for t in some for w in t.split(" ")})
            self._learn(self.by_segment, "", {t.split(" ", 1)[0] for some in lines for t in some[1:]} - {""})
            out += map(self.count, lot)
        return out

    def _learn(self, table: Memo, before: str, words: set[str]) -> None:
        """Put the words' counts where count looks for them; long ones and such with unknown
        characters are left to it."""
        new = [w for w in words.difference(table) if len(w) < LONGEST_KEPT and w not in table.old]
        for i in range(0, len(new), ABREAST):
            some = new[i : i + ABREAST]
            for w, n in zip(some, self.abreast.counts([before + w for w in some]), strict=True):
                if n >= 0:
                    table.put(w, n)

    def cut(self, text: str | None, budget: int) -> int:
        """The most characters of text whose tokens keep within budget, from stored counts.

        Segments are walked up to the one whose end is beyond the budget; its own prefixes,
        or else its beginning, hold the answer. Later ones only have more tokens."""
        base, end = 0, -1  # segments have a mark in front of the text
        for m in self._segment.finditer((MARK + (text or "")).replace(" ", MARK)) if text else ():
            counts = self.stored[m[0]]
            if base + counts[-1] > budget:
                inside = [i for i, n in enumerate(counts) if i and base + n <= budget]
                return max(0, end + max(inside, default=0))
            base += counts[-1]
            end += len(m[0])
        return max(0, end)

    def segments(self, text: str) -> list[str]:
        return self._segment.findall((MARK + text).replace(" ", MARK))

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """int32 counts of text[:0], text[:1], ... text[:n]."""
        if not text:
            return np.zeros(1, np.int32)
        out, base = [], 0
        for s in self.segments(text):
            counts = self.prefixes(s)
            out.append(np.asarray(counts[1:], np.int32) + base)
            base += counts[-1]
        whole = np.concatenate(out)
        whole[0] = 0  # the mark that stands before a text comes with its first character
        return whole


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """The most characters of a text whose tokens, by its prefix counts, keep within budget."""
    return int(np.flatnonzero(counts <= budget)[-1])


_COUNTERS: dict[tuple[str, int], PrefixCounter] = {}


def counter(model_file: str, keep: int = 1 << 17) -> PrefixCounter:
    """One counter a worker process, that keeps the counts of so many words."""
    if (model_file, keep) not in _COUNTERS:
        _COUNTERS[model_file, keep] = PrefixCounter(model_file, keep)
    return _COUNTERS[model_file, keep]


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, budgets: tuple[int, ...] = (), keep: int = 1 << 17) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, and with budgets the array
    `cuts`: for each the characters of the longest prefix within it.

    Narrow: no shuffle. model_file is a path that every executor has.
    """
    ensure_importable(docs.sparkSession)

    def run(batches):
        c = counter(model_file, keep)
        for b in batches:
            texts = b.column(2).to_pylist()
            counts = c.counts(texts)
            out = [b.column(0), b.column(1), pa.array(counts, pa.int64())]
            if budgets:
                # a text that is within a budget as a whole is its own longest prefix
                out.append(pa.array([[len(t or "") if n <= m else c.cut(t, m) for m in budgets] for t, n in zip(texts, counts, strict=True)], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_bytes", "n_tokens", "cuts"][: len(out)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long" + ", cuts array<long>" * bool(budgets))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def prefix_table(docs: DataFrame, model_file: str, keep: int = 1 << 17) -> DataFrame:
    """doc_id and `counts`: the exact tokens of text[:0], text[:1], ... of every row. Written
    once, it answers count_of and cut_within in DataFrame functions, without encoding."""
    ensure_importable(docs.sparkSession)

    def run(batches):
        c = counter(model_file, keep)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                counts = [c.prefix_counts(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts), pa.int32()))], names=["doc_id", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, counts array<int>")


def count_of(counts: Column, chars: Column | int) -> Column:
    """The tokens of the first `chars` characters, or of all where there are fewer."""
    return F.get(counts, F.least(F.lit(chars) if isinstance(chars, int) else chars, F.size(counts) - 1))


def cut_within(counts: Column, budget: Column | int) -> Column:
    """The most characters whose tokens keep within budget."""
    within = F.transform(counts, lambda n, i: F.when(n <= budget, i))
    return F.array_max(within)
