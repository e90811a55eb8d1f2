import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    parts = ("ka", "lo", "mi", "ter", "an", "sche", "ré", "que", "do", "ün")
    return ["".join(r.choice(parts) for _ in range(r.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty and white ones, copies, near copies, shared passages, a long one."""
    r = random.Random(5)
    base = [" ".join(words(r, r.randint(1, 160))) for _ in range(40)]
    passage = " ".join(words(r, 60))
    base += [" ".join(words(r, 30)) + "\n" + passage + "\n" + " ".join(words(r, 20)) for _ in range(4)]
    near = base[3].split()
    long = words(r, 9000)
    out = [*base, base[0], base[0], "", None, "  \n\t ", " ".join([*long, *long[:50]]), "a " * 200, "x", "+1 (555) 123-4567 ok", "mail a.b@c.de, 10.0.0.1!", "1 2 　 é\U0001f642"]
    for k in range(3):
        w = list(near)
        if w:
            w[min(k, len(w) - 1)] = f"new{k}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ("en", "de", "fr", None)[i % 4], None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[1])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Extra columns under the names that operators use inside."""
    from pyspark.sql import functions as F

    out = docs
    for name in ("block", "bucket", "keys", "words", "n_tokens", "node", "mark", "kept", "row", "score", "spans", "part"):
        out = out.withColumn(name, F.lit("x"))
    return out
