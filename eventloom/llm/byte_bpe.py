"""Byte-level BPE by a lazily determinised finite-state transducer, and a streaming decoder.

Encoding. The merges are compiled to a relation on bytes: from a token boundary whose
last token is t, any token that is compatible with t (the two encode to themselves) may
follow. Reading bytes, the transducer keeps every boundary from which some token still
fits, each with its place in the trie of tokens and the tokens that lead to it and are not
given out yet: a tree of hypotheses. That tree is one deterministic state, and a move from
it by a byte gives out the tokens that all living hypotheses share from then on, which is
after at most the longest token's bytes. States and moves are made when first needed and
kept in a bounded table, however long a pretoken is. The end of a pretoken gives out what
leads to its last boundary.

Decoding. A machine over UTF-8, whose state is the bytes of a character begun, is stepped
from token to token; its moves by tokens are made from those by bytes when first needed.
Its state carries over token ends, so any prefix of a stream decodes at once.

Edge cases: null and empty texts have no ids; ids outside the vocabulary raise KeyError;
ill-formed bytes become U+FFFD, one for each maximal ill-formed part; a null doc_id stays
null; repeated rows are encoded each on its own; a long run without a match's end costs
time in proportion to its length.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import LONGEST_KEPT, Memo, ensure_importable
from eventloom.llm.token_counts import MergeRules


class Transducer:
    """rank: token bytes -> id; ids are ranks of merges. State 0 is the start."""

    def __init__(self, rank: dict[bytes, int], most_states: int = 1 << 19):
        self.rank, self.rules, self.most = rank, MergeRules(rank), most_states
        self.trie: dict[int, int] = {}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.token_at: list[bytes | None] = [None]
        for token in rank:
            if len(token) > 1 and not self._made(token):
                continue
            node = 0
            for b in token:
                key = node << 8 | b
                node = self.trie.get(key, -1)
                if node < 0:
                    node = self.trie[key] = len(self.token_at)
                    self.token_at.append(None)
            self.token_at[node] = token
        self._restart()

    def _made(self, token: bytes) -> bool:
        """Whether some two tokens of lower rank join to it; the rest no merge can make."""
        r = self.rank[token]
        return any(self.rank.get(token[:i], r) < r and self.rank.get(token[i:], r) < r for i in range(1, len(token)))

    def _restart(self) -> None:
        """Forget all states but the first: no hypothesis but the text's own beginning."""
        #: A state: the last token given out, if that matters, and the living boundaries, oldest
        #: first, each with the tokens that lead to it and its node of the trie.
        first = (None, (((), 0),))
        self.states, self.number = [first], {first: 0}
        self.moves.clear()

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The next state, and the ids that are certain from then on."""
        trie, token_at, pairs = self.trie, self.token_at, self.rules.pairs
        base, living = self.states[state]
        tree, new = [], None
        for path, node in living:
            node = trie.get(node << 8 | byte, 0)
            if node:
                tree.append((path, node))
                if new is None and (t := token_at[node]) is not None:
                    before = path[-1] if path else base
                    if before is None or pairs[before, t]:
                        new = (*path, t)
        same = len(new)
        for path, _ in tree:
            while same and path[:same] != new[:same]:
                same -= 1
        tree.append((new, 0))
        given = new[:same]
        if given:
            base = given[-1]
        if all([len(path) > same for path, _ in tree]):
            base = b""  # no boundary follows what has been given out directly
        kept = base, tuple([(path[same:], node) for path, node in tree]) if same else tuple(tree)
        ids = tuple([self.rank[t] for t in given])
        to = self.number.get(kept)
        if to is None:
            if len(self.states) >= self.most:
                self._restart()
                state = -1  # its number has gone
            to = self.number[kept] = len(self.states)
            self.states.append(kept)
        if state >= 0:
            self.moves[state << 8 | byte] = to, ids
        return to, ids

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Ids of one pretoken's bytes, each as soon as all living boundaries share it."""
        state = 0
        for byte in data:
            state, ids = self.moves.get(state << 8 | byte) or self._move(state, byte)
            yield from ids
        yield from map(self.rank.__getitem__, self.states[state][1][-1][0])

    def encode(self, data: bytes) -> list[int]:
        """All ids of one pretoken: the stream at once."""
        if (whole := self.rank.get(data)) is not None:
            return [whole]
        state, get, move, out = 0, self.moves.get, self._move, []
        for byte in data:
            state, ids = get(state << 8 | byte) or move(state, byte)
            if ids:
                out += ids
        out += map(self.rank.__getitem__, self.states[state][1][-1][0])
        return out


def _utf8_moves() -> list[list[int]]:
    """State x byte -> state. 0: between characters; 1, 2, 3: so many trailing bytes to
    come; 4 to 7: after E0, ED, F0, F4, whose next byte has a narrower range; -1: ill-formed."""
    table = [[-1] * 256 for _ in range(8)]

    def put(state, first, last, to):
        for b in range(first, last + 1):
            table[state][b] = to

    for first, last, to in ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE1, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7)):
        put(0, first, last, to)
    for state, first, last, to in ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2)):
        put(state, first, last, to)
    return table


UTF8 = _utf8_moves()


class Utf8Stream:
    """Bytes in, text out; what is cut in the middle of a character waits."""

    def __init__(self):
        self.state, self.part = 0, bytearray()

    def feed(self, data: bytes) -> str:
        if not self.state and data.isascii():
            return data.decode("ascii")
        out, state, part = [], self.state, self.part
        for byte in data:
            to = UTF8[state][byte]
            if to < 0 and state:  # what has come so far is one ill-formed part; the byte starts anew
                out.append("�")
                part.clear()
                to = UTF8[0][byte]
            if to < 0:
                out.append("�")
                part.clear()
                state = 0
                continue
            part.append(byte)
            state = to
            if not state:
                out.append(part.decode("utf-8"))
                part.clear()
        self.state = state
        return "".join(out)

    def close(self) -> str:
        rest = "�" if self.part else ""
        self.state, self.part = 0, bytearray()
        return rest


def read_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(token): int(i) for token, i in map(bytes.split, f)}


class TokenDecoder:
    """The machine over UTF-8 stepped by tokens: from a state (the bytes of a character that
    has begun) and an id to the text that is complete then, and the next state."""

    def __init__(self, token: dict[int, bytes]):
        self.token, self.at = token, {}
        self.start = self._state(b"")

    def _state(self, part: bytes) -> Memo:
        """The moves from a state: at most three bytes can be waiting, so there are few."""
        if part not in self.at:
            self.at[part] = Memo(lambda i: self._move(part, i), 1 << 18)
        return self.at[part]

    def _move(self, part: bytes, i: int) -> tuple[str, Memo]:
        machine = Utf8Stream()
        text = machine.feed(part) + machine.feed(self.token[i])
        return text, self._state(bytes(machine.part))

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text that each id completes, then what is left at the end."""
        state = self.start
        for i in ids:
            text, state = state[i]
            yield text
        yield "\ufffd" if state is not self.start else ""

    def decode(self, ids: Iterable[int]) -> str:
        state, out = self.start, []
        for i in ids:
            text, state = state[i]
            out.append(text)
        return "".join(out) + ("\ufffd" if state is not self.start else "")


#: A fixed value, the public pattern that texts are split by before the merges of the rank
#: files: the one for which Chunks has been shown to be right.
SPACE_STARTS = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",)

#: Spaces that part chunks if the pattern begins a match at each space between other characters.
_BETWEEN = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")


class Chunks:
    """Packed ids of texts by look-up in chunks that end before spaces, for patterns that
    begin a match at every single space between two characters that are no white space,
    nowhere include such a space later in a match, and take a space and the letters after it
    as one match. encode packs any text's ids, match those of a text that is one match."""

    def __init__(self, encode: Callable[[str], bytes], match: Callable[[str], bytes], keep: int):
        self.encode, self.match = encode, match
        self.mixed = Memo(self._mixed, keep, LONGEST_KEPT)

    def _mixed(self, s: str) -> bytes | None:
        """The ids of a space and what is not letters alone; None where the space stands beside
        other white space."""
        if not s or s[0].isspace() or s[-1].isspace():
            return None
        if s[-1] in ".,;:!?" and s[:-1].isalpha():  # two matches
            return self.match(" " + s[:-1]) + self.match(s[-1])
        return self.encode(" " + s)

    def packed(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        if head and not head[-1].isspace():
            match, mixed = self.match, self.mixed
            found = [match(" " + s) if s.isalpha() else mixed[s] for s in rest]
            if None not in found:
                return self.encode(head) + b"".join(found)
        head, *rest = _BETWEEN.split(text)  # white space of several characters
        return b"".join([self.encode(head), *(self.encode(" " + s) for s in rest)])


class ByteBpe:
    """Encoder and decoder of a rank file; each match of the pattern is encoded by itself.

    space_starts: look texts up in chunks, which is refused for patterns that Chunks isn't for.
    A match that is a token is given out as that token, as the library does, before the
    transducer sees it."""

    def __init__(self, rank_file: str, pattern: str, space_starts: bool = False, keep: int = 1 << 19):
        if space_starts and pattern not in SPACE_STARTS:
            raise ValueError("chunks are only for patterns in SPACE_STARTS")
        self.rank = read_ranks(rank_file)
        self.token = {i: t for t, i in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.fst, self.decoder = Transducer(self.rank), TokenDecoder(self.token)
        self.matched = Memo(lambda s: array("I", self.fst.encode(s.encode())).tobytes(), keep, LONGEST_KEPT)
        self.packed = Chunks(self._matches, self.matched.__getitem__, keep >> 1).packed if space_starts else self._matches

    def _matches(self, text: str) -> bytes:
        return b"".join(map(self.matched.__getitem__, self.split(text)))

    def encode_packed(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.packed(text) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        return self.decoder.stream(ids)

    def decode(self, ids: Iterable[int]) -> str:
        return self.decoder.decode(ids)


_CODECS: dict[tuple, ByteBpe] = {}


def codec(rank_file: str, pattern: str, space_starts: bool = False) -> ByteBpe:
    key = rank_file, pattern, space_starts
    if key not in _CODECS:
        _CODECS[key] = ByteBpe(*key)
    return _CODECS[key]


def encode(docs: DataFrame, rank_file: str, pattern: str, space_starts: bool = False) -> DataFrame:
    """doc_id and `ids` (array of int) of every row; a null text gives an empty array."""
    ensure_importable(docs.sparkSession)

    def run(batches):
        bpe = codec(rank_file, pattern, space_starts)
        for b in batches:
            ids = [np.frombuffer(bpe.encode_packed(t), "<i4") for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and `text` of rows with doc_id and ids; a null array gives an empty text."""
    ensure_importable(tokens.sparkSession)

    def run(batches):
        bpe = codec(rank_file, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or ()) for i in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, space_starts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: the text encoded, then
    its ids decoded, and both hashed where they are, so nothing large leaves a task."""
    ensure_importable(docs.sparkSession)

    def run(batches):
        bpe = codec(rank_file, pattern, space_starts)
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                packed = bpe.encode_packed(text)
                back = bpe.decode(np.frombuffer(packed, "<u4").tolist()).encode()
                rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, ids, raw = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
