"""Quality rules with risk-controlled thresholds.

A rule rejects documents whose measure exceeds a cutoff. The cutoffs of all rules form one ladder of ``STEPS`` steps, from lax
to strict: a step rejects what any rule rejects at its cutoff of that step. Steps are tested in order on all labelled
documents of good quality, stratum by stratum: a step is certified if the exact binomial test rejects that it falsely rejects
more than ``RISK`` of the stratum's good documents. The first failure ends the ladder, so a ladder costs one test, and the
level is divided by the number of strata. With probability ``1 - LEVEL``, then, no stratum loses more than RISK of its good
documents to the rules. Of the certified steps that one is taken which serves best. Where labels are too few to certify
anything (four strata need some 150 good documents each), nothing is rejected.

Counts over documents and labels are Spark aggregations; what is tested is one row per stratum and step.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm.common import BLANKS, Batches, batch, map_batches, ship

RISK, LEVEL = 0.03, 0.05
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
STEPS = 24
#: Rule: numerator, denominator, and the cutoffs of their quotient, one a step.
SHARES = tuple(round(0.50 - 0.02 * k, 2) for k in range(STEPS))
RULES = {
    "symbols": ("n_symbols", "word_chars", SHARES),
    "duplicate lines": ("n_dup_lines", "n_lines", SHARES),
    "repeated words": ("n_repeat_words", "n_words", SHARES),
    "capitals": ("n_capitals", "word_chars", SHARES),
    "exclamations": ("n_exclamations", "n_words", SHARES),
    "long words": ("word_chars", "n_words", tuple(20.0 - 0.5 * k for k in range(STEPS))),
}
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_exclamations")
_FEATURES = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), *((c, pa.int64()) for c in COUNTS)])


def features(text: str) -> tuple[int, ...]:
    """COUNTS of a text. n_lines counts the lines with a word, n_capitals A to Z."""
    octets = text.encode()
    words = octets.split()  # at ASCII blanks only
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in octets.split(b"\n") if line.strip()]
    duplicate = len(lines) - len(set(lines))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        seen, reach = Counter(windows), 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                repeated += at + 3 - max(at, reach)
                reach = at + 3
    capitals = len(octets) - len(octets.translate(None, _CAPITALS))
    return n, chars, symbols, duplicate, repeated, len(lines), capitals, text.count("!")


def _feature_batches(batches: Batches) -> Batches:
    for rows in batches:
        found = [features(t.as_py() or "") for t in rows.column("text")]
        columns = zip(*found, strict=True) if found else [[] for _ in COUNTS]
        yield batch(_FEATURES, rows.column("doc_id"), rows.column("lang"), *columns)


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang and COUNTS), one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint"), "lang", "text")
    return map_batches(rows, _feature_batches, "doc_id bigint, lang string, " + ", ".join(f"{c} bigint" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _rejecting_steps() -> Column:
    """How many steps reject a document: the last ones, since whatever a lax step rejects, all stricter ones reject as well."""

    def of(rule: str) -> Column:
        above, below, cutoffs = RULES[rule]
        value = F.col(above) / F.nullif(F.col(below), F.lit(0))
        rejecting = [F.when(value > cutoff, 1).otherwise(0) for cutoff in cutoffs]
        return sum(rejecting[1:], rejecting[0])

    return F.greatest(*map(of, RULES))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for n draws of probability p, summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    steps = np.log((n - i[:-1]) / (i[:-1] + 1.0)) + math.log(p) - math.log1p(-p)
    logs = n * math.log1p(-p) + np.concatenate(([0.0], np.cumsum(steps)))
    top = logs.max()
    return float(math.exp(top) * np.exp(logs - top).sum())


def certified(good: int, rejected: list[int], strata: int) -> int:
    """How many steps of a stratum's ladder are certified; ``rejected`` holds the good documents that each rejects."""
    for passed, k in enumerate(rejected):
        if good == 0 or k > RISK * good or binomial_tail(k, good, RISK) > LEVEL / strata:
            return passed
    return len(rejected)


def _select(group: pd.DataFrame) -> pd.DataFrame:
    """One stratum: rows (steps, good, bad) of its documents by the number of steps that reject them, and the number of strata."""
    good, bad = ([int(group.loc[group["steps"] >= STEPS - k, n].sum()) for k in range(STEPS)] for n in ("good", "bad"))
    passed = certified(int(group["good"].sum()), good, int(group["strata"].iloc[0]))
    gain = [b - g for g, b in zip(good[:passed], bad[:passed], strict=True)]
    taken = gain.index(max(gain)) + 1 if gain and max(gain) > 0 else 0
    row = (group["stratum"].iloc[0], int(group["good"].sum()), passed, taken)
    return pd.DataFrame([row], columns=["stratum", "good", "passed", "taken"])


def thresholds(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(stratum, good, passed, taken): labelled good documents, certified steps and the step taken, counted from the lax end.

    Of the certified steps the one is taken that rejects most bad documents less good ones, the laxest of equals, and none
    (0) if none rejects more bad than good: any choice among certified steps keeps the guarantee. A stratum is a language;
    documents without language are one too. Good are documents with a label of quality 1 and none of quality 0 that pass the
    base rules. A doc_id that occurs several times in a stratum counts once, by its worst text. Labels without doc_id, or of
    unknown documents, count for nothing.
    """
    ship(counts.sparkSession)
    labelled = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("labelled"))
    labelled = labelled.agg(F.min("quality").alias("quality"))
    held = counts.filter(~base_failed()).join(labelled, F.col("doc_id") == F.col("labelled"))
    once = held.groupBy(F.coalesce("lang", F.lit("")).alias("stratum"), "doc_id", "quality").agg(F.max(_rejecting_steps()).alias("steps"))
    bins = once.groupBy("stratum", "steps").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") != 1).alias("bad"))
    bins = stage(bins, "quality-bins")
    strata = bins.agg(F.count_distinct("stratum")).first()[0]
    return bins.withColumn("strata", F.lit(strata)).groupBy("stratum").applyInPandas(_select, "stratum string, good long, passed int, taken int")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per row of ``docs``.

    Reads doc_id, text and lang of ``docs`` and doc_id and quality of ``labels``. A null text has no words and fails the base
    rules; documents of a stratum without labels are judged by the base rules alone; a measure without denominator rejects
    nothing. Repeated rows come out as often as they go in; no rows in, no rows out.
    """
    counts = stage(measured(docs), "quality-counts")
    cut = stage(thresholds(counts, labels), "quality-thresholds").select(F.col("stratum").alias("of"), "taken")
    placed = counts.join(cut, F.coalesce("lang", F.lit("")) == F.col("of"), "left")
    taken = F.coalesce("taken", F.lit(0))
    bad = (taken > 0) & (F.coalesce(_rejecting_steps(), F.lit(0)) > STEPS - taken)
    return placed.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         base_failed().alias("base_failed"), (~base_failed() & ~bad).alias("kept"))
