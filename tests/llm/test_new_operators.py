"""Repair of conversations, secrets and collocations against plain versions."""

import collections
import functools
import hashlib
import random
import re
import string
import zlib

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from eventloom.llm import collocations, queries, secret_scan
from eventloom.llm import conversation_repair as repair

RANKS, SF = public_tokenizers.path("byte_bpe_50k.tiktoken"), "/root/testdata/sf0.01"

# ---- conversations -------------------------------------------------------------------


def best_edits(rows):
    """rows: (initial, fault). (cost, labels, written initials) of the best edits, by trying all."""

    @functools.cache
    def rest(i, state, inserted):
        out = [(0, "", "")] if i == len(rows) and state in "^a" else []
        fits = {"^": "su", "s": "u", "u": "a", "a": "u"}[state]
        add = lambda label, cost, x, to: (to and [(to[0] + cost, label + to[1], x + to[2])]) or []
        for x in fits.replace("s", "") if inserted < 3 else "":
            out += add("I", 5, x, rest(i, x, inserted + 1))
        if i < len(rows):
            initial, fault = rows[i]
            out += add("D", 2, "", rest(i + 1, state, 0))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                out += add("K", more, initial, rest(i + 1, initial, 0)) if initial and initial in fits else []
                for x in fits.replace("s", ""):
                    out += add("R", 1 + more, x, rest(i + 1, x, 0))
        return min(out, default=None)

    return rest(0, "^", 0)


def plain_repair(rows):
    talks = collections.defaultdict(list)
    for c, t, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (c, t))
        damage = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if damage == 1 else re.sub("[.!?]", "", text) if damage == 2 else text
        talks[c] += [(t, "user" if damage == 4 else role, text)] * {0: 0, 3: 2}.get(damage, 1)
    for c, found in talks.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in found:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit, initials = best_edits(tuple((r[1][:1], f) for r, f in zip(found, faults, strict=True)))
        lines, i, left = [], 0, iter(initials)
        for label in audit:
            if label != "D":
                x = next(left)
                role = found[i][1] if label == "K" else {"u": "user", "a": "assistant"}[x]
                lines.append(f"{role}:{'' if label == 'I' else found[i][2]}")
            i += label != "I"
        turns = [t for t, _, _ in found if t is not None]
        yield c, (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:], strict=False)),
            cost,
            audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
TALK = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks():
    """Nulls, ties, repeated rows, roles of all kinds, a conversation of 120 rows."""
    r = random.Random(4)
    rows = [
        (c, r.choice((None, *range(9), 12, -3)), r.choice(("user", "assistant", "user", "assistant", "system", None, "tool", "", "Sam", "sam")), r.choice(("a.", "b?", "", " \t", None, "open end", "x!", "y.\n", "z ", "é…", "w. ")))
        for c in (*range(60), None, 10**12)
        for _ in range(r.randrange(1, 12))
    ]
    return rows + rows[:40] + [(777, i, ("user", "assistant")[i % 2], f"said {i}" + "." * (i % 5 > 0)) for i in range(120)]


@pytest.mark.parametrize("piece_rows", [4096, 3])
def test_repair_equals_trying_all_edits(spark, talks, piece_rows):
    rows = repair.damaged(spark.createDataFrame(talks, TALK))
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in repair.repair(rows, piece_rows).collect()}
    want = dict(plain_repair(talks))
    assert got == want and None in got


def test_paths_of_pieces_are_those_of_the_whole():
    r = random.Random(2)
    for _ in range(400):
        chain = bytes(r.randrange(12) for _ in range(r.randrange(8)))
        names = {repair.OK: None, repair.CUT: "truncated", repair.GONE: "blank"}
        want = best_edits(tuple((repair.symbol_parts(x)[0], names[repair.symbol_parts(x)[1]]) for x in chain))[:2]
        cuts = sorted(r.randrange(len(chain) + 1) for _ in range(r.randrange(4)))
        parts = [chain[a:b] for a, b in zip([0, *cuts], [*cuts, len(chain)], strict=True)]
        cost, audit = 0, ""
        for k, (part, (start, after)) in enumerate(zip(parts, repair.entries([repair.summary(p) for p in parts]), strict=True)):
            c, steps, end = repair.path(part, start, after, k == len(parts) - 1)
            cost, audit = cost + c - after[end], audit + "".join(s[0] for s in steps)
        assert (cost, audit) == want


def test_one_conversation_of_many_equal_and_unlike_rows(spark):
    rows = [(1, 5, "user", "same.")] * 3000 + [(1, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(10, 3010)]
    df = spark.createDataFrame(rows, TALK)
    out = repair.repair(df, 100).collect()
    assert len(out) == 1 and out[0].duplicate == 2999
    # either the first of the equal rows or t10 may go: D comes before K
    assert out[0].audit == "D" * 3000 + "K" * 3000 and out[0].cost == 6000
    texts = repair.repaired_rows(df).orderBy("piece", "place").collect()
    assert [r.role[0] for r in texts] == ["u", "a"] * 1500
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in texts).encode()).hexdigest() == out[0].repaired_sha256


def test_repair_of_nothing_and_clashing_names(spark, talks):
    df = spark.createDataFrame(talks, TALK)
    assert repair.repair(repair.damaged(df.limit(0))).collect() == []
    other = df.withColumns({c: F.lit("x") for c in ("piece", "mark", "id", "no", "symbols", "fault", "damage", "n", "several", "start", "roles")})
    key = lambda d: sorted(map(str, repair.repair(repair.damaged(d)).collect()))
    assert key(df) == key(other)


# ---- secrets -------------------------------------------------------------------------


def plain_spans(text):
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def test_patterns_of_secrets_equal_plain_ones():
    r = random.Random(1)
    parts = ("token", "ſecret", "Secret", "TOKEN", "api_key", "apiKey", "toKen", "password", " ", ":", "=", '"', "'", "AKIA", "AKIA7", "0123456789abcdef" * 2, "abcdef", "ABCDEF", "x", "é", "\n", "==", "a.b-c", "QWERTYUIOP12", "\U0001f642")
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert secret_scan.pattern_spans(text) == plain_spans(text)


def test_secrets_of_documents(spark, docs, texts, nothing, clashing):
    out = secret_scan.find(docs, RANKS, public_tokenizers.PATTERN)
    found = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        base = secret_scan.digest(plain_spans(t or ""))
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and (found[i].spans == base or found[i].n_random)
    assert out.count() == docs.count() and secret_scan.find(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, secret_scan.find(clashing, RANKS, public_tokenizers.PATTERN).collect()))


def _made(kind, r):
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    words = ("get", "user", "name", "request", "handler", "server", "config", "parse", "time", "index", "table", "column", "buffer", "stream", "worker", "client", "error", "result", "window")
    n, w = r.randint(24, 64), lambda k: r.sample(words, k)
    return {
        "alphanumeric": lambda: pick(low + up + dig, n),
        "base64": lambda: pick(low + up + dig + "+/", n) + "=",
        "prefixed": lambda: f"{r.choice(('ghp', 'xoxb', 'glpat', 'sk'))}_{pick(low + up + dig, 36)}",
        "upper": lambda: pick(up + dig, n),
        "camel": lambda: "".join(x.title() for x in w(5)) + pick(dig, 1),
        "snake": lambda: "_".join(w(5)) + "_" + pick(dig, 2),
        "path": lambda: "/" + "/".join(w(5)) + "/" + pick(dig, 3),
        "uuid": lambda: "-".join(pick("abcdef" + dig, k) for k in (8, 4, 4, 4, 12)),
        "md5": lambda: pick("ABCDEF" + dig, 32),
        "integrity": lambda: "sha256-" + pick(low + up + dig, 43) + "=",
        "named": lambda: "SHA-512: " + pick(low + up + dig, 60),
        "time": lambda: f"2024-1{r.randint(0, 2)}-1{pick(dig, 1)}T10:{pick('012345', 1)}1:11Z",
        "codes": lambda: "-".join(pick(up, 1) + pick(dig, 1) for _ in range(9)),
        "data": lambda: "data:image/png;base64," + pick(low + up + dig + "+/", 300),
        "number": lambda: pick(dig, n),
        "heading": lambda: "".join(w(5)).upper(),
    }[kind]()


RANDOM = ("alphanumeric", "base64", "prefixed", "upper")
PLAIN = ("camel", "snake", "path", "uuid", "md5", "integrity", "named", "time", "codes", "data", "number", "heading")


@pytest.mark.parametrize("kind", RANDOM + PLAIN)
def test_random_strings_and_nothing_else(kind):
    r, test = random.Random(9), secret_scan.tester(RANKS, public_tokenizers.PATTERN)
    hits = sum(any(k == 3 for _, k, _ in test.all_spans(f"before {_made(kind, r)} after")[1]) for _ in range(300))
    assert hits >= 297 if kind in RANDOM else hits <= 3


def test_secret_spans_are_whole_and_redacted(spark):
    key = "wJalrXUtnFEMI7MDENGbPxRfiCYzEXAMPLEKEY9q"
    text = f"é {key}, token = '{key}' \U0001f642 {key}"
    test = secret_scan.tester(RANKS, public_tokenizers.PATTERN)
    assert secret_scan.digest(test.all_spans(text)[1]) == f"random:2:{2 + len(key)},assign:{4 + len(key)}:{13 + 2 * len(key)},random:{17 + 2 * len(key)}:{17 + 3 * len(key)}"
    long = "".join(random.Random(3).choices(string.ascii_letters + string.digits, k=200_000))
    assert test.all_spans(long)[1] == [(0, 3, len(long))]
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "", "z")], "doc_id long, TEXT string, row string")
    assert [tuple(r) for r in secret_scan.redacted(df, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()] == [(1, "é [SECRET], [SECRET]' \U0001f642 [SECRET]", "x"), (2, None, "y"), (3, "", "z")]


# ---- collocations --------------------------------------------------------------------


def plain_collocations(rows, least, top, length=5):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for i in range(len(words)):
                for j in range(i + 1, min(i + length, len(words)) + 1):
                    f[lang][tuple(words[i:j])] += 1
    for lang, counts in f.items():
        chosen = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = collections.Counter()
        for p, a in chosen.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        inside[p[i:j]] = max(inside[p[i:j]], a)
        out = []
        for p, a in chosen.items():
            if not 0 < inside[p] >= a:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                out.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(out)[:top], 1):
            yield lang, rank, p.decode(), -a, l, r, n[lang], -score


@pytest.mark.parametrize("bucket_words", [1 << 21, 300])
def test_collocations_equal_plain_counts(spark, bucket_words):
    r = random.Random(1)
    rows = [(r.choice(("a", None, "und", "b")), "".join(r.choice(("x", "y", "Z", "the", "q.", "w,", "é", "É", "\t", "", "a\x0bb", " ")) + " " * r.randint(1, 2) for _ in range(r.randint(0, 60)))) for _ in range(300)]
    rows += [("a", None), ("a", ""), ("c", "  "), *[("b", "one very common pair of words")] * 200]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [tuple(x) for x in collocations.collocations(df, 3, 150, bucket_words=bucket_words).collect()]
    assert sorted(got) == sorted(plain_collocations(rows, 3, 150))


def test_collocations_equal_their_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.OP13_SQL).fetchall()
    got = queries.op13_collocations(spark, SF)
    assert got.columns == [c[0] for c in con.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and want


def test_collocations_with_other_columns_and_nothing(spark, docs, clashing, nothing):
    key = lambda d: sorted(map(str, collocations.collocations(d, 2).collect()))
    assert key(docs) == key(clashing)
    assert collocations.collocations(nothing).collect() == []


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("a", "x y", 2, 3 * 10**12), ("a", "x", 1, 4 * 10**12), ("a", "y", 1, 5 * 10**12)], "lang string, phrase string, n_words int, f long")
    languages = spark.createDataFrame([("a", 7 * 10**14)], "lang string, n long")
    assert [tuple(r) for r in collocations.scored(phrases, languages).collect()] == [("a", "x y", 2, 3 * 10**12, 4 * 10**12, 5 * 10**12, 7 * 10**14, 1000 * 3 * 10**12 * 7 * 10**14 // (4 * 5 * 10**24))]


def test_columns_of_new_queries(spark):
    want = {
        "op11_conversation_repair": {"conv_id": "bigint", **dict.fromkeys(COLUMNS[:6], "bigint"), "audit": "string", "repaired_sha256": "string"},
        "op12_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op13_collocations": {"lang": "string", "phrase": "string", **dict.fromkeys(("rank", "a", "l", "r", "n", "score"), "bigint")},
    }
    for name, columns in want.items():
        assert columns.items() <= dict(queries.queries()[name](spark, "/root/testdata/sf0.001").dtypes).items()
