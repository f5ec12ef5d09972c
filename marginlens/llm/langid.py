"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of a language, most frequent first; a document is profiled in the same way,
and its distance to a language is the sum over its n-grams of how far out of place each stands, where an n-gram that the
language's profile lacks counts as the full length of a profile. The language at the least distance is predicted.

N-grams are runs of one to three lower-cased letters, words being set off by a single mark. They are counted as packed
integers, in which a mark that ends an n-gram is not told from its absence. The profiles are fitted on at most ``TRAIN_DOCS`` whole documents of each language, those of the smallest hash;
everything is predicted on whole texts.
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlens.llm.common import Batches, batch, crc_bucket, map_batches

ORDERS = 3
PROFILE = 400
#: The bound of the fitted sample: documents of one language.
TRAIN_DOCS = 4000
FOLDS = 5
UNDETERMINED = "und"
#: A document is rejected below this score; texts in a learned language lie well above it.
MIN_SCORE = 0.1
_CODE_BITS = 21

_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])
_FOUND = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as packed integers, repeats included; none for a text without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64)
    marked = np.concatenate(([0], np.where(letter, codes, 0), [0])).astype(np.int64)
    keep = np.ones(len(marked), bool)
    keep[1:] = (marked[1:] != 0) | (marked[:-1] != 0)
    marked = marked[keep]
    found, packed = [marked[marked != 0]], marked
    for order in range(2, ORDERS + 1):
        packed = packed[:-1] | (marked[order - 1 :] << (_CODE_BITS * (order - 1)))
        found.append(packed)
    return np.concatenate(found)


def ranked(counted: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The PROFILE most frequent n-grams, ties by the packed n-gram."""
    if len(counts) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        counted, counts = counted[counts >= least], counts[counts >= least]
    return counted[np.lexsort((counted, -counts))][:PROFILE]


def _count_batches(batches: Batches) -> Batches:
    for rows in batches:
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text"), strict=True):
            by_lang.setdefault(lang, []).append(grams(text.as_py()))
        for lang, found in by_lang.items():
            counted, n = np.unique(np.concatenate(found), return_counts=True)
            yield batch(_COUNTS, [lang] * len(n), counted, n)


def held_out(folds: int = FOLDS) -> Column:
    """Whether a document is kept from training; a null doc_id is neither held out nor learned from."""
    return F.coalesce(crc_bucket("doc_id", folds) == 0, F.lit(False))


def profiles(docs: DataFrame, sample: int = TRAIN_DOCS) -> DataFrame:
    """(lang, gram, place): the profile of every language of the training documents."""
    train = docs.filter((crc_bucket("doc_id", FOLDS) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    draw = F.xxhash64(F.lit("language sample"), F.col("doc_id").cast("bigint"))
    in_lang = Window.partitionBy("lang").orderBy("draw")
    drawn = train.select("lang", draw.alias("draw")).withColumn("n", F.row_number().over(in_lang)).filter(F.col("n") <= sample)
    cut = drawn.groupBy("lang").agg(F.max("draw").alias("cut")).withColumnRenamed("lang", "of")
    picked = train.select("lang", "text", draw.alias("draw")).join(F.broadcast(cut), F.col("lang") == F.col("of"))
    picked = picked.filter(F.col("draw") <= F.col("cut")).select("lang", "text")
    counts = map_batches(picked, _count_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= PROFILE).select("lang", "gram", "place")


class Profiles:
    """The profiles of all languages as one sorted list of n-grams and their places per language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.known = np.unique(np.array([r[1] for r in rows], np.int64))
        self.places = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)  # the last row is for unknown n-grams
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.known, gram), self.langs.index(lang)] = place - 1

    def classify(self, text: str | None) -> tuple[str, float]:
        """Predicted language and 1 - distance / largest distance, from 0 to 1; ``und`` and 0 without letters or profiles."""
        found = grams(text) if text else np.empty(0, np.int64)
        if not len(found) or not self.langs:
            return UNDETERMINED, 0.0
        document = ranked(*np.unique(found, return_counts=True))
        at = np.searchsorted(self.known, document)
        at[at == len(self.known)] = 0
        places = self.places[np.where(self.known[at] == document, at, len(self.known))]
        own = np.arange(len(document))[:, None]
        distance = np.where(places < 0, PROFILE, np.abs(places - own)).sum(axis=0)
        best = int(np.argmin(distance))
        return self.langs[best], float(1 - distance[best] / (PROFILE * len(document)))


def _classify_batches(batches: Batches, model: Profiles) -> Batches:
    for rows in batches:
        found = [model.classify(t.as_py()) for t in rows.column("text")]
        yield batch(_FOUND, rows.column("doc_id"), rows.column("held_out"), [f[0] for f in found], [f[1] for f in found])


def fit(docs: DataFrame) -> Profiles:
    """Profiles of all languages: PROFILE rows per language come to the driver."""
    return Profiles([tuple(r) for r in profiles(docs.select("doc_id", "lang", "text")).collect()])


def identify(docs: DataFrame, model: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``docs`` (columns doc_id, text; others are not read).

    ``lang_pred`` is ``und`` with score 0 for a null text, a text without a letter, or a model without languages; ties go to
    the language that sorts first. Repeated rows come out as often as they go in; no rows in, no rows out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    schema = "doc_id bigint, held_out boolean, lang_pred string, score double"
    return map_batches(rows, partial(_classify_batches, model=model), schema)


def _accepted_batches(batches: Batches, model: Profiles) -> Batches:
    for rows in batches:
        found = (model.classify(t.as_py()) for t in rows.column("text"))
        yield rows.filter(pa.array([lang != UNDETERMINED and score >= MIN_SCORE for lang, score in found], pa.bool_()))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told: not ``und``, with a score of at least MIN_SCORE. Columns stay.

    Every row is judged by its own text, with or without doc_id and whatever other rows of its doc_id hold.
    """
    return map_batches(docs, partial(_accepted_batches, model=fit(docs)), docs.schema)
