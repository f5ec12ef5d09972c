"""Rank-order profiles against counting and comparing one n-gram at a time."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from marginlens.llm import langid
from marginlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_grams(text):
    """n-grams of one to three letters with words set off by a mark, as tuples of code points, last letter first.

    A mark that ends an n-gram is not told from its absence.
    """
    marked = [0]
    for c in text.lower():
        code = ord(c) if c.isalpha() else 0
        if code or marked[-1]:
            marked.append(code)
    if marked[-1]:
        marked.append(0)
    if len(marked) == 1:
        return []
    found = [(c,) for c in marked if c]
    for n in (2, 3):
        found += [tuple(reversed(marked[i : i + n])) for i in range(len(marked) - n + 1)]
    return [g[1:] if g[0] == 0 else g for g in found]


def plain_profile(counts, length):
    """Most frequent first; of equals the one that sorts first from its last letter on."""
    padded = {g: tuple([0] * (3 - len(g)) + list(g)) for g in counts}
    return sorted(counts, key=lambda g: (-counts[g], padded[g]))[:length]


def plain_classify(text, profiles, length):
    document = plain_profile(Counter(plain_grams(text or "")), length)
    if not document or not profiles:
        return "und", 0.0
    distance = {lang: sum(abs(i - places[g]) if g in places else length for i, g in enumerate(document)) for lang, places in profiles.items()}
    best = min(sorted(distance), key=distance.get)
    return best, 1 - distance[best] / (length * len(document))


@pytest.mark.parametrize("length", [400, 25])
def test_predictions_equal_plain_rank_order(spark, monkeypatch, length):
    monkeypatch.setattr(langid, "PROFILE", length)
    rows = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SMALL}/documents.parquet'").fetchall()
    counts = defaultdict(Counter)
    for d, text, lang in rows:
        if zlib.crc32(str(d).encode()) % 5 and lang is not None and text is not None:
            counts[lang].update(plain_grams(text))
    profiles = {lang: {g: i for i, g in enumerate(plain_profile(c, length))} for lang, c in counts.items()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.fit(docs)
    odd = ["", None, "123 !?", "é", "Ünïcode ÜBER straße", "a" * 5000, "mixed le the der el"]
    for text in [*odd, *(t for _, t, _ in rows)]:
        lang, score = model.classify(text)
        expected, its_score = plain_classify(text, profiles, length)
        assert lang == expected and score == pytest.approx(its_score, abs=1e-12)
    if length == 400:
        found = {r.doc_id: (r.lang_pred, r.score) for r in QUERIES["op8_language_id"](spark, SMALL).collect()}
        assert found == {d: model.classify(t) for d, t, _ in rows}
