"""Secrets: fixed patterns, and a test of token efficiency beside them.

The patterns find values assigned to names of secrets, access keys and long hexadecimal runs.
Whatever they miss still looks random to a vocabulary of tokens: merges learned from text and
code pack words, names and paths into two to five characters a token, while a random string
falls apart into pieces of one or two. A run of at least `SHORTEST` letters, digits and
`+/_-` that mixes digits with letters, or changes its case again and again, is encoded with
a tiktoken vocabulary, and is a secret if it has fewer than `RATIO` characters a token. Of
made random strings of 20 characters and more, 99 in 100 have fewer than 1.9; of names,
paths and made words with digits, 99 in 100 have more.

Known digests and identifiers are random too, but no secrets. They are left out before:
hexadecimal runs of the lengths of digests (in either case), and what follows the name of
a digest; UUIDs; dates and times; account numbers whose check sum (of IBAN) is right; codes
in groups of three signs at most; paths of one case whose parts are short; data that a text embeds as base64. Patterns' spans stay,
whatever this test says, and it adds no span that overlaps one of theirs.

Edge cases: null and empty texts have no spans; spans are in code points, end exclusive;
overlapping kinds of pattern are all kept, and sorted by start, then by kind; runs and
texts of any length are read whole, runs being encoded in stretches of 256 characters, so
that time is in proportion to length; a null doc_id stays null; repeated rows are each
searched; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.byte_bpe import read_ranks
from eventloom.llm.common import ensure_importable

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
#: Characters of the shortest run tested, characters a token of a random one, and those encoded at once.
SHORTEST, RATIO, STRETCH = 20, 1.9, 256

# ---- fixed patterns ------------------------------------------------------------------

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
#: As all characters of a run before would begin the match, and a shorter run fails as a whole.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the patterns' matches, sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


# ---- what is no secret, though random ------------------------------------------------

#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)
_ALL_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NAMED = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))\W{0,3}\Z", re.I | re.A)
_NAMED_INSIDE = re.compile(r"(?:md5|sha(?:1|224|256|384|512))[-_]", re.I | re.A)
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I | re.A)
_TIME = re.compile(r"[0-9]{4}-?[0-9]{2}-?[0-9]{2}(?:[T_-]?[0-9]{2,})?(?:[-_][A-Za-z]{1,12})?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_EMBEDDED = re.compile(r";base64,\Z")


def _account(run: str) -> bool:
    """Whether the check sum of an international account number is right."""
    return bool(_IBAN.fullmatch(run)) and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1


def known(run: str, before: str = "") -> bool:
    """Whether a run is a digest or an identifier. before: the characters ahead of it."""
    core = run.rstrip("=")
    if _ALL_HEX.fullmatch(core) and len(core) in DIGESTS or _NAMED.search(before) or _NAMED_INSIDE.match(core):
        return True
    if _UUID.fullmatch(core) or _TIME.fullmatch(core) or _account(core) or _EMBEDDED.search(before):
        return True
    if "/" in core and (core == core.lower() or core == core.upper()) and max(map(len, core.split("/"))) < SHORTEST:
        return True
    return max(map(len, re.split(r"[-_/+]", core))) <= 3


# ---- the test ------------------------------------------------------------------------

_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % SHORTEST)
_TURNS = re.compile(r"[a-z][A-Z]|[A-Z]{2}[a-z]")


def mixed(run: str) -> bool:
    """Whether digits and letters meet in the run, or its case changes once in eight characters."""
    letters = re.search(r"[A-Za-z]", run)
    return bool(letters and re.search(r"[0-9]", run)) or 8 * len(_TURNS.findall(run)) >= len(run)


class TokenEfficiency:
    """The test under the vocabulary of a rank file."""

    def __init__(self, rank_file: str, pattern: str, ratio: float = RATIO):
        self.encoding = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=read_ranks(rank_file), special_tokens={})
        self.ratio = ratio

    def characters_a_token(self, run: str) -> float:
        return len(run) / sum(len(self.encoding.encode_ordinary(run[i : i + STRETCH])) for i in range(0, len(run), STRETCH))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        out = []
        for m in _RUN.finditer(text):
            run = m[0]
            if mixed(run) and not known(run, text[max(0, m.start() - 16) : m.start()]) and self.characters_a_token(run) < self.ratio:
                out.append((m.start(), 3, m.end()))
        return out

    def all_spans(self, text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        """The patterns' spans, and those with what the test adds, in order."""
        base, extra, at, ends = pattern_spans(text or ""), [], 0, 0
        for span in self.spans(text or ""):
            while at < len(base) and base[at][0] < span[2]:
                ends = max(ends, base[at][2])
                at += 1
            if ends <= span[0]:
                extra.append(span)
        return base, sorted(base + extra)


_TESTS: dict[tuple, TokenEfficiency] = {}


def tester(rank_file: str, pattern: str, ratio: float = RATIO) -> TokenEfficiency:
    key = rank_file, pattern, ratio
    if key not in _TESTS:
        _TESTS[key] = TokenEfficiency(*key)
    return _TESTS[key]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, rank_file: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (the patterns'), base_sha256, spans (all) and n_random
    of every row. Narrow: no shuffle; a task holds the vocabulary and some hundred texts."""
    ensure_importable(docs.sparkSession)

    def run(batches):
        test = tester(rank_file, pattern, ratio)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                found = [test.all_spans(t) for t in part.column(1).to_pylist()]
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in range(3)]
                hashes = pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, hashes, pa.array([digest(x) for _, x in found], pa.string()), pa.array([len(x) - len(base) for base, x in found], pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redacted(docs: DataFrame, rank_file: str, pattern: str, ratio: float = RATIO) -> DataFrame:
    """docs, all rows and columns, with every span in `text` replaced by [SECRET], overlapping
    ones as one; a null text stays null."""
    ensure_importable(docs.sparkSession)
    at = [c.lower() for c in docs.columns].index("text")

    def clean(test: TokenEfficiency, text: str | None) -> str | None:
        out, end = [], 0
        for s, _, e in test.all_spans(text)[1]:
            if s >= end:
                out += [text[end:s], "[SECRET]"]
            end = max(end, e)
        return "".join([*out, text[end:]]) if out else text

    def run(batches):
        test = tester(rank_file, pattern, ratio)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                new = pa.array([clean(test, t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), new)

    return docs.mapInArrow(run, docs.schema)
