r"""Weak supervision of quality rules, in DataFrame functions alone.

Each rule votes good (1) or bad (-1) on a document, or abstains (0). How often a rule
casts each vote on good and on bad documents is not known; expectation-maximisation
estimates it, and the share of good documents, from how the votes of all documents agree.
The posterior probability of "good" given a document's votes then decides.

Documents enter the estimation as counts of vote patterns, at most 3 to the number of
rules, so any corpus gives a table of bounded size; the iterations are one fold over that
table inside a single row. The features of a row are made inside the row: windows found
twice come from sorting the row's own window hashes, with no shuffle of words.

Edge cases: a null text counts as empty: no words, base_failed, not kept; with no rows at
all nothing is estimated; words are runs of characters other than the six ASCII spaces;
five-word windows are told apart by 64-bit hashes; repeated rows each count as a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import SPACES, written

SYMBOLS, WINDOW = "#*$%&|<>", 5
#: Words in each stretch whose distinct words are counted: what a text repeats doesn't then depend on its length.
STRETCH = 500
ITERATIONS = 25


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read, for every row; n_distinct is the sum of
    the distinct words of stretches of STRETCH words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    chars = F.length("text")
    rows = rows.select(
        "doc_id",
        F.array_remove(F.split(F.translate("text", SPACES[1:], " " * 5), " "), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(f"[^{SPACES}]")).alias("lines"),
        F.length(_without(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        (chars - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (chars - F.length(_without(F.col("text"), "!?"))).cast("long").alias("n_exclaims"),
        (chars - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    )
    n = F.size("words")
    rows = rows.select(
        "doc_id", "word_chars", "n_symbols", "n_exclaims", "n_upper",
        n.cast("long").alias("n_words"),
        F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(STRETCH)), F.lit(0), lambda a, i: a + F.size(F.array_distinct(F.slice("words", i + 1, STRETCH)))).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(n > WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.col("words")[i + k] for k in range(WINDOW)]))).alias("windows"),
    )
    rest = ["doc_id", "word_chars", "n_symbols", "n_exclaims", "n_upper", "n_words", "n_distinct", "n_lines", "n_dup_lines"]
    rows = rows.select(*rest, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"))
    s, last = F.col("sorted"), F.size("sorted") - 1
    twice = F.filter(s, lambda e, k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == e["h"])) | ((k < last) & (s[F.least(k + 1, last)]["h"] == e["h"])))
    rows = rows.select(*rest, F.array_sort(F.transform(twice, lambda e: e["i"])).alias("at"))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    return rows.select(*rest, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def _vote(bad: Column, good: Column | None = None) -> Column:
    vote = F.when(bad, -1)
    return (vote if good is None else vote.when(good, 1)).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules over columns of features(). Most look for one defect and abstain where
    they don't see it: that a text lacks one defect says little of the others."""
    c = F.col
    return {
        "length": _vote(c("n_words") < 10),
        "word_length": _vote((c("n_words") >= 20) & ((c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 7 * c("n_words"))), c("word_chars").between(4.3 * c("n_words"), 6.5 * c("n_words"))),
        "symbols": _vote(10 * c("n_symbols") > c("n_words")),
        "exclaims": _vote(4 * c("n_exclaims") > c("n_words")),
        "capitals": _vote(10 * c("n_upper") > 3 * c("word_chars")),
        "lines": _vote(2 * c("n_dup_lines") > c("n_lines")),
        "repeats": _vote(10 * c("n_repeat_words") > 3 * c("n_words")),
        "variety": _vote(100 * c("n_distinct") < 15 * c("n_words"), (10 * c("n_distinct") > 5 * c("n_words")) & (c("n_words") >= 30)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _posterior(model: Column, ballot: Column) -> Column:
    """P(good | votes); model: prior, and the log-odds of each rule's votes -1, 0, 1."""
    odds = F.aggregate(F.zip_with(ballot, model["odds"], lambda v, o: o[v + 1]), F.log(model["prior"] / (1 - model["prior"])), lambda a, x: a + x)
    return 1 / (1 + F.exp(-odds))


def estimate(ballots: DataFrame, rules: int, iterations: int = ITERATIONS) -> tuple[float, list[list[float]]]:
    """The prior and the log-odds of each rule's votes, from `ballot` (array of votes).

    Starts from "bad if any rule says so"; each count has half a document added. An
    abstention says nothing, and no rule's vote may come to mean its contrary."""
    patterns = ballots.groupBy("ballot").agg(F.count(F.lit(1)).cast("double").alias("n"))
    first = F.when(F.array_contains("ballot", -1), 0.1).otherwise(0.9)
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("ballot", "n", first.alias("p")))).alias("all"))

    def model(rows: Column) -> Column:
        total = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["n"])
        good = F.aggregate(rows, F.lit(0.0), lambda a, x: a + x["n"] * x["p"])

        def seen(j, v, of_good):
            return F.aggregate(rows, F.lit(0.5), lambda a, x: a + F.when(x["ballot"][j] == v, x["n"] * (x["p"] if of_good else 1 - x["p"])).otherwise(0.0))

        def weight(j, v):
            return F.log(seen(j, v, True) / (good + 1.5)) - F.log(seen(j, v, False) / (total - good + 1.5))

        odds = F.array(*[F.array(F.least(weight(j, -1), F.lit(0.0)), F.lit(0.0), F.greatest(weight(j, 1), F.lit(0.0))) for j in range(rules)])
        return F.struct(((good + 1) / (total + 2)).alias("prior"), odds.alias("odds"))

    def step(rows: Column, _) -> Column:
        # the model is bound by a one-element array, so that it is made once and not for each pattern
        return F.transform(F.array(model(rows)), lambda m: F.transform(rows, lambda x: F.struct(x["ballot"].alias("ballot"), x["n"].alias("n"), _posterior(m, x["ballot"]).alias("p"))))[0]

    fitted = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), F.col("all"), step).alias("all"))
    found = fitted.select(model(F.col("all")).alias("m")).select("m.prior", "m.odds").first()
    return found.prior, found.odds


def judge(docs: DataFrame, iterations: int = ITERATIONS, threshold: float = 0.5) -> DataFrame:
    """doc_id, the features, the rules' votes, base_failed, the posterior `quality` and kept."""
    rules = votes()
    table = written(features(docs))
    ballot = F.array(*rules.values())
    prior, odds = estimate(table.select(ballot.alias("ballot")), len(rules), iterations)
    model = F.struct(F.lit(prior).alias("prior"), F.array(*[F.array(*map(F.lit, o)) for o in odds]).alias("odds"))
    out = table.withColumn("ballot", ballot).withColumn("quality", _posterior(model, F.col("ballot"))).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
