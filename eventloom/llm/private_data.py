"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The patterns find e-mail and IP addresses, card and phone numbers. The field labels words
(runs of non-space characters of a line) as one of those kinds, as a secret (a key, token
or password) or as nothing, from features of a word's shape and those of its neighbours'.
It is trained from a small labelled table by gradient ascent on the conditional
likelihood and decoded by Viterbi in numpy, all lines of a batch side by side. What it
finds beside the patterns' spans is added; theirs stay.

Most lines hold no digit and no sign that any feature of note needs. If for every such
word the gain of each label over "nothing", with the best transitions on both sides, is
below zero - checked when the field is fitted - such lines decode to nothing, and they
are passed over without decoding: the same result, for less.

Edge cases: null and empty texts have no spans; spans are in code points, end exclusive;
overlapping kinds of pattern are all kept; a span of the field that overlaps one of a
pattern, or lacks what its kind demands (a card number's check sum, say), is left out;
very long words and lines are read whole, in time in proportion to their length; a null
doc_id stays null; repeated rows are each searched.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import Memo, ensure_importable

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")

# ---- fixed patterns ------------------------------------------------------------------

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    """Leftmost matches, found from each @ outwards: the name part is the run before it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the patterns' matches, sorted."""
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        # a match can't begin inside a run of digits: the run's first digit would begin it too
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(found)


# ---- features ------------------------------------------------------------------------

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Words with none of these are inert: one feature for their case, none for their letters.
_ACTIVE = re.compile(r"[0-9@=_]")
_HEX = re.compile(r"[0-9a-f]{12,}|[0-9A-F]{12,}")
_KEY = re.compile(r"[A-Z0-9]{14,}")
_TRIM = ".,;:!?\"'()[]{}<>#*&|"


def _lines(text: str, active: bool):
    """Start and end of each line; with active of those alone that have an active sign."""
    at = 0
    while at < len(text):
        if active:
            m = _ACTIVE.search(text, at)
            if not m:
                return
            at = text.rfind("\n", at, m.start()) + 1 or at
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        yield at, end
        at = end + 1


def _shape(word: str) -> str:
    """The word with runs of capitals, other letters and digits as A, a and 9, runs of these
    as "mix", and what is longer than any kind's shape as "long"."""
    word = re.sub(r"[0-9]+", "9", word)
    word = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() else "a", word)
    word = re.sub(r"(?:[aA9]){4,}", "mix", word)
    return word if len(word) <= 16 else "long"


def features(word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """What a word says of its own label, and what of a neighbour's."""
    core = word.strip(_TRIM)
    if not _ACTIVE.search(word):
        kind = "upper" if core.isupper() else "title" if core[:1].isupper() else "lower" if core else "sign"
        return (f"inert:{kind}",), (f"inert:{kind}",)
    digits, letters = sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    shape, value = _shape(core), core.rpartition("=")[2].strip(_TRIM)
    own = [f"shape:{shape}", f"digits:{min(digits, 20)}", f"letters:{min(letters, 6)}", f"dots:{min(core.count('.'), 4)}", f"colons:{min(core.count(':'), 4)}", f"lead:{core[:1] if not core[:1].isalnum() else ''}"]
    if "@" in core:
        own.append("at")
    if "=" in core and value:
        own.append("assigned")
    if _HEX.fullmatch(value) and _DIGIT.search(value):
        own.append("hex")
    if _KEY.fullmatch(value) and letters and digits:
        own.append("key")
    if digits and not letters:
        own.append("numeric")
    if core.count(".") == 3 and not letters:
        own.append("quad")
    return tuple(own), (f"shape:{shape}", f"numeric:{bool(digits and not letters)}", f"plus:{core[:1] == '+' or word[:1] == '+'}", f"sign:{core == '' and word}")


# ---- the field -----------------------------------------------------------------------


@dataclass
class Crf:
    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    skip_inert: bool = False

    def __post_init__(self):
        zero = np.zeros(len(LABELS))
        self.edge = zero

        def score(word):
            own, near = features(word)
            pick = lambda names, side: sum((self.weights[i] for f in names if (i := self.index.get(f"{side}|{f}")) is not None), zero)
            return pick(own, "own"), pick(near, "before"), pick(near, "after")

        self.scores = Memo(score, 1 << 15)
        self.skip_inert = self._inert_is_nothing()

    def _inert_is_nothing(self) -> bool:
        """Whether words without digits and signs can't gain from any label, among their like."""
        some = [self.scores[w] for w in ("Ab", "ab", "AB", "-")]
        bonus = max(0.0, float((self.moves - self.moves[0, 0]).max()))
        gain = lambda rows: max(float((r - r[0])[1:].max()) for r in rows)
        near = [max(0.0, gain([s[k] for s in some])) for k in (1, 2)]
        return gain([s[0] for s in some]) + sum(near) + 2 * bonus < 0

    def emissions(self, words: list[str]) -> np.ndarray:
        own, before, after = (np.array(x) for x in zip(*map(self.scores.__getitem__, words), strict=True))
        own[1:] += before[:-1]
        own[:-1] += after[1:]
        return own

    def decode(self, lines: list[list[str]]) -> list[np.ndarray]:
        """The best labels of each line; lines of like length go through together."""
        out: list = [None] * len(lines)
        order = sorted(range(len(lines)), key=lambda i: len(lines[i]))
        k = 0
        while k < len(order):
            chunk, longest = [], 0
            while k < len(order) and (not chunk or len(lines[order[k]]) * (len(chunk) + 1) <= 1 << 16):
                longest = len(lines[order[k]])
                chunk.append(order[k])
                k += 1
            grid = np.zeros((longest, len(chunk), len(LABELS)))
            for j, i in enumerate(chunk):
                if lines[i]:
                    grid[: len(lines[i]), j] = self.emissions(lines[i])
            lengths = np.array([len(lines[i]) for i in chunk])
            best, back = grid[0] if longest else np.zeros((len(chunk), len(LABELS))), np.zeros((max(longest, 1), len(chunk), len(LABELS)), np.int8)
            for t in range(1, longest):
                reach = best[:, :, None] + self.moves[None]
                back[t] = reach.argmax(1)
                best = np.where((t < lengths)[:, None], reach.max(1) + grid[t], best)
            labels = np.zeros((max(longest, 1), len(chunk)), np.int8)
            now, rows = best.argmax(1).astype(np.int8), np.arange(len(chunk))
            for t in range(longest - 1, -1, -1):
                labels[t] = now
                now = np.where((t < lengths) & (t > 0), back[t, rows, now], now)
            for j, i in enumerate(chunk):
                out[i] = labels[: len(lines[i]), j]
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, str, int]]]:
        """(start, kind, end) in each text."""
        lines, where = [], []
        for d, text in enumerate(texts):
            for first, last in _lines(text, self.skip_inert):
                found = [(w.start(), w[0]) for w in _WORD.finditer(text, first, last)]
                if found:
                    lines.append([w for _, w in found])
                    where.append((d, found))
        out: list[list] = [[] for _ in texts]
        for (d, found), labels in zip(where, self.decode(lines), strict=True):
            t = 0
            while t < len(found):
                label, first = labels[t], t
                while t < len(found) and labels[t] == label:
                    t += 1
                if label:
                    start, end = found[first][0], found[t - 1][0] + len(found[t - 1][1])
                    raw = texts[d][start:end]
                    if LABELS[label] == "secret":
                        start += len(raw) - len(raw[raw.rfind("=") + 1 :].lstrip(" " + _TRIM))
                    else:
                        start += len(raw) - len(raw.lstrip(",;:!?\"'[]{}<>"))
                    end -= len(raw) - len(raw.rstrip(_TRIM))
                    if start < end and _plausible(LABELS[label], texts[d][start:end]):
                        out[d].append((start, LABELS[label], end))
        return out


_IPV6 = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}")


def _plausible(kind: str, value: str) -> bool:
    """What a kind itself demands. The field may find what the patterns don't look for: IP
    addresses in full colon form, card numbers of 13 digits or with other marks between, phone
    numbers without a plus sign, and secrets; numbers still need their check sum."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "ip":
        quad = re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", value) and all(int(p) <= 255 for p in value.split("."))
        return bool(quad or _IPV6.fullmatch(value))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return kind != "email" or "@" in value


def fit(rows: list[tuple[list[str], list[str]]], steps: int = 120, rate: float = 0.15, ridge: float = 0.002) -> Crf:
    """rows: words and labels of a line each. Bounded: a labelled table is small."""
    index: dict[str, int] = {}
    uses: list[list[list[int]]] = []
    for words, _ in rows:
        sides = [features(w) for w in words]
        line = []
        for t in range(len(words)):
            names = [f"own|{f}" for f in sides[t][0]]
            names += [f"before|{f}" for f in sides[t - 1][1]] if t else []
            names += [f"after|{f}" for f in sides[t + 1][1]] if t + 1 < len(words) else []
            line.append([index.setdefault(n, len(index)) for n in names])
        uses.append(line)
    n, m, k = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    at = np.array([(t, i, f) for i, line in enumerate(uses) for t, names in enumerate(line) for f in names])
    gold = np.zeros((m, n), int)
    for i, (_, labels) in enumerate(rows):
        gold[: len(labels), i] = [LABELS.index(x) for x in labels]
    lengths = np.array([len(w) for w, _ in rows])
    live = np.arange(m)[:, None] < lengths
    weights, moves = np.zeros((len(index), k)), np.zeros((k, k))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (weights, moves)]
    true = np.eye(k)[gold] * live[:, :, None]
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (gold[:-1][live[1:]], gold[1:][live[1:]]), 1)
    for step in range(1, steps + 1):
        grid = np.zeros((m, n, k))
        np.add.at(grid, (at[:, 0], at[:, 1]), weights[at[:, 2]])
        ahead, behind = grid.copy(), np.zeros((m, n, k))
        for t in range(1, m):
            x = ahead[t - 1][:, :, None] + moves
            top = x.max(1)
            ahead[t] = np.where(live[t][:, None], grid[t] + top + np.log(np.exp(x - top[:, None]).sum(1)), ahead[t - 1])
        for t in range(m - 2, -1, -1):
            x = moves[None] + (grid[t + 1] + behind[t + 1])[:, None, :]
            top = x.max(2)
            behind[t] = np.where(live[t + 1][:, None], top + np.log(np.exp(x - top[:, :, None]).sum(2)), 0)
        top = ahead[-1].max(1)
        z = top + np.log(np.exp(ahead[-1] - top[:, None]).sum(1))
        belief = np.exp(ahead + behind - z[None, :, None]) * live[:, :, None]
        gap = (true - belief)[at[:, 0], at[:, 1]]
        up = np.zeros_like(weights)
        np.add.at(up, at[:, 2], gap)
        expected = np.zeros((k, k))
        for t in range(1, m):
            x = ahead[t - 1][:, :, None] + moves + (grid[t] + behind[t])[:, None, :] - z[:, None, None]
            expected += (np.exp(x) * live[t][:, None, None]).sum(0)
        for p, g, (a, b) in zip((weights, moves), (up / n - ridge * weights, (true_moves - expected) / n - ridge * moves), state, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p += rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Crf(index, weights, moves)


def labelled_table(lines: int = 480, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: made lines of made words with made data in some of them."""
    r = random.Random(seed)
    syllables = ("ka", "lo", "mi", "ter", "an", "sche", "tion", "que", "do", "ré", "ün", "es", "in", "va", "the", "of")
    low, up = "abcdef0123456789", "ABCDEFGHJKLMNPQRSTUVWXYZ234567"
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    digits = lambda n: pick("0123456789", n)

    def plain():
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        w = w.title() if r.random() < 0.15 else w.upper() if r.random() < 0.05 else w
        return w + (r.choice(".,;:!?") if r.random() < 0.15 else "")

    def hexes(n):
        return r.choice("0123456789") + pick(low, n - 1)

    def key():
        return r.choice(("AKIA", "ASIA", "GHP", "SK")) + pick(up, 13) + digits(1) + pick(up, 3)

    def rare(n):  # few digits among capitals
        at = r.randrange(n)
        return r.choice(("AKIA", "ASIA", "GHP", "SK")) + "".join(r.choice("234567") if i == at else r.choice(up[:24]) for i in range(n))

    makers = {
        "email": [lambda: [f"{plain().strip('.,;:!?')}.{digits(2)}@{r.choice(syllables)}{r.choice(('', '8'))}.{r.choice(('example.com', 'mail.org', 'net.de'))}"], lambda: [f"{r.choice(syllables)}_{digits(2)}@{r.choice(syllables)}.com"]],
        "ip": [lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))], lambda: [":".join(pick(low, r.randint(1, 4)) for _ in range(8))]],
        "card": [lambda: [digits(16)], lambda: [digits(13)], lambda: [".".join(digits(4) for _ in range(4))], lambda: [digits(4) for _ in range(4)], lambda: ["-".join(digits(4) for _ in range(4))]],
        "phone": [lambda: [f"+{r.randint(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], lambda: [f"+{r.randint(1, 99)}", digits(3), digits(3), digits(4)], lambda: [f"({digits(3)})", f"{digits(3)}-{digits(4)}"]],
        "secret": [lambda: [key()], lambda: [rare(16)], lambda: [f"{r.choice(('password', 'pwd', 'secret', 'api_key'))}={hexes(r.randint(14, 24))}"], lambda: [f'"{hexes(r.choice((32, 40)))}"'], lambda: [hexes(40)]],
    }
    others = [lambda: [digits(r.randint(1, 4)) + r.choice(("", ".", ",", "%"))], lambda: [f"{digits(1)}.{digits(1)}" + r.choice(("", "."))], lambda: [f"{digits(1)}.{digits(1)}.{digits(1)}"], lambda: [f"20{digits(2)}-0{digits(1)}-1{digits(1)}"], lambda: [f"{digits(2)}:{digits(2)}"], lambda: [f"{digits(2)}:{digits(2)}:{digits(2)}"], lambda: [f"{digits(1)}:{digits(1)}"], lambda: [f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}"], lambda: [f"${digits(3)}"], lambda: ["=", plain()], lambda: [f"{plain()}{digits(1)}"], lambda: [f"{digits(1)}{plain()}"], lambda: [f"x={digits(2)}"], lambda: ["CC", "BY-NC", "4.0."], lambda: ["Version", "2.0."], lambda: [f"({digits(1)})"], lambda: ["a_b_c"], lambda: [f"{digits(3)},{digits(3)}"], lambda: [f"{plain()}=={digits(1)}"], lambda: [f"@{plain()}"], lambda: [digits(r.randint(5, 8))]]
    out = []
    for i in range(lines):
        words, labels = [], []
        for _ in range(r.randint(1, 4)):
            n = r.randint(1, 5)
            words += [plain() for _ in range(n)]
            labels += ["none"] * n
            if i % 3 < 2:
                label = r.choice(list(makers)) if i % 3 else "none"
                found = r.choice(makers.get(label, others))()
                if label == "secret" and found[0].startswith('"'):
                    words += ["token", "="]
                    labels += ["none"] * 2
                if r.random() < 0.2:
                    found[-1] += r.choice(".,;")
                words += found
                labels += [label] * len(found)
        out.append((words, labels))
    return out


_FIELDS: list[Crf] = []


def default_field() -> Crf:
    if not _FIELDS:
        _FIELDS.append(fit(labelled_table()))
    return _FIELDS[0]


def all_spans(texts: list[str | None], field: Crf) -> list[tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]]:
    """For each text the patterns' spans, and those with what the field adds, in order."""
    place = {k: i for i, k in enumerate(LABELS[1:])}
    texts = [t or "" for t in texts]
    base = [[(s, KINDS[k], e) for s, k, e in pattern_spans(t)] for t in texts]
    out = []
    for found, more in zip(base, field.spans(texts), strict=True):
        extra = [x for x in more if not any(x[0] < e and s < x[2] for s, _, e in found)]
        out.append((found, sorted(found + extra, key=lambda x: (x[0], place[x[1]]))))
    return out


def digest(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, field: Crf) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (the patterns'), base_sha256, spans and n_spans
    (all) of every row. Narrow: no shuffle; the field is a few thousand numbers."""
    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((field.index, field.weights, field.moves))

    def run(batches):
        crf = Crf(*shared.value)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                found = all_spans(part.column(1).to_pylist(), crf)
                counts = [pa.array([sum(k == kind for _, k, _ in base) for base, _ in found], pa.int64()) for kind in KINDS]
                hashes = pa.array([hashlib.sha256(digest(base).encode()).hexdigest() for base, _ in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, hashes, pa.array([digest(x) for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def redacted(docs: DataFrame, field: Crf) -> DataFrame:
    """docs, all rows and columns, with every span in `text` replaced; a null text stays null."""
    ensure_importable(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((field.index, field.weights, field.moves))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        crf = Crf(*shared.value)
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                texts = part.column(at).to_pylist()
                new = [None if t is None else redact(t, x) for t, (_, x) in zip(texts, all_spans(texts, crf), strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
