"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of slices of its training
texts. A text, lower-cased and with all that is no letter taken as space, is cut into blocks of a fixed size, each block is compressed with every
dictionary, and the language whose blocks take the fewest bytes in sum wins: the shortest
description under a fixed set of models. Blocks keep a long text from becoming its own
dictionary, which would level the differences; every byte of a text counts. A text whose
two best languages differ by less than `margin` bytes for each kilobyte is rejected.

Fitting takes a bounded sample of labelled rows: at most `slices` slices of `slice_chars`
characters for each language, one from a row. Rows are drawn by a hash of their id, text and
place in the table, so that rows of one id (or of none) are drawn one by one, and no language
is lost; about twice as many as needed are drawn, and each task keeps `slices` a language of
these. All else covers all rows.

Edge cases: a null text, or one without a letter, is `und` with score 0 and rejected; with
no labelled row at all every text is `und`; equal sizes go to the language with more
training rows and have score 0.5 or less; repeated rows get equal answers; a null doc_id stays null and
counts as the empty text where its remainder is asked for.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import ensure_importable

SLICES, SLICE_CHARS, BLOCK, MARGIN = 320, 300, 2048, 0.5
#: More languages than this are refused: each has a dictionary that every task holds.
LANGUAGES = 1000
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return _OTHER.sub(" ", text.lower()).encode()


@dataclass(frozen=True)
class LanguageModel:
    """Plain data, so that it travels with a task: language -> dictionary bytes, the
    languages with more training rows first."""

    dictionaries: dict[str, bytes]
    block: int = BLOCK
    margin: float = MARGIN


def fit(train: DataFrame, slices: int = SLICES, slice_chars: int = SLICE_CHARS, **params) -> LanguageModel:
    """train: doc_id, text, lang; rows that lack a text or a lang are left out."""
    rows = train.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    if not counts:
        return LanguageModel({}, **params)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * slices / n)))])
    spot = F.xxhash64(F.col("doc_id"), F.col("text"), F.monotonically_increasing_id(), F.lit("language sample"))
    rows = rows.withColumn("spot", spot)
    uniform = F.pmod("spot", F.lit(1 << 30)) / F.lit(float(1 << 30))
    room = F.greatest(F.lit(1), F.length("text") - slice_chars + 1)
    drawn = rows.where(uniform < share[F.col("lang")]).select("lang", "spot", F.substring("text", F.pmod("spot", room).cast("int") + 1, F.lit(slice_chars)).alias("slice"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("spot"))).where(F.col("nth") <= slices).collect()
    by: dict[str, list] = {}
    for r in sorted(drawn, key=lambda r: (r.spot, r.slice)):
        by.setdefault(r.lang, []).append(letters(r.slice))
    return LanguageModel({k: b" ".join(by[k]) for k in sorted(by, key=lambda k: (-counts[k], k))}, **params)


class Classifier:
    def __init__(self, model: LanguageModel):
        self.model, self.coders = model, []
        for k, (language, content) in enumerate(model.dictionaries.items()):
            how = zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=3, target_length=16, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.coders.append((k, language, zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress))

    def sizes(self, data: bytes) -> list[tuple[int, int, str]]:
        step = self.model.block
        blocks = [data[i : i + step] for i in range(0, len(data), step)]
        return sorted((sum(len(pack(b)) for b in blocks), k, language) for k, language, pack in self.coders)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow."""
        data = letters(text)
        found = self.sizes(data)
        if not found:
            return "und", 0.0, True
        best, _, language = found[0]
        # a byte of difference halves the odds, as the code lengths of a mixture would
        score = 1.0 / sum(0.5 ** min(size - best, 60) for size, _, _ in found)
        gap = 1000.0 * (found[1][0] - best) / max(1, len(data)) if len(found) > 1 else float("inf")
        return language, score, gap < self.model.margin


_CLASSIFIERS: dict[int, tuple[LanguageModel, Classifier]] = {}


def _classifier(model: LanguageModel) -> Classifier:
    if id(model) not in _CLASSIFIERS:
        _CLASSIFIERS.clear()
        _CLASSIFIERS[id(model)] = model, Classifier(model)
    return _CLASSIFIERS[id(model)][1]


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """lang_pred, score, rejected and `row`, a struct of all columns of docs, so that none
    of their names can clash. A prediction reads text alone. Narrow: no shuffle."""

    ensure_importable(docs.sparkSession)
    place = [c.lower() for c in docs.columns].index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most slices * slice_chars characters a language

    def run(batches):
        classify = _classifier(shared.value).predict
        for b in batches:
            texts = b.column("row").field(place).cast(pa.string())
            found = [classify(t) if ok else ("und", 0.0, True) for i in range(0, b.num_rows, 512) for t, ok in zip(texts.slice(i, 512).to_pylist(), b.column("has_letter").slice(i, 512).to_pylist(), strict=True)]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            out = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_()), b.column("row")]
            yield pa.RecordBatch.from_arrays(out, names=["lang_pred", "score", "rejected", "row"])

    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(letter.alias("has_letter"), row.alias("row"))
    schema = docs.select(F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("rejected"), row.alias("row")).schema
    return rows.mapInArrow(run, schema)
