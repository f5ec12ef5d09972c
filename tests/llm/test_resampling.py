from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from marginlens.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest, buckets):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, longest, buckets, draw):
    found = [(i, *plain_features(t, longest, buckets)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in plain_features(x, longest, buckets)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f)
        h = None if i is None else int(hashlib.sha256(f"{draw.seed}:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= draw.min_words and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for rank, r in enumerate(able[: draw.pct * len(able) // 100], 1):
        r[5] = rank
    return Counter(map(tuple, rows))


TEXTS = ["The quick, brown FOX; don't stop", None, "", "  ...  ", "é Ü naïve 東京 x9", "a " * 5000, "B-b_b\x7fb\x00b", "one " * 25 + "two"]


@pytest.mark.parametrize("longest, buckets, block", [(1, 10_000, 1 << 22), (2, 97, 64), (3, 1000, 11)])
def test_resampling_equals_plain_counting(spark, docs_frame, monkeypatch, longest, buckets, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = np.random.default_rng(8)
    texts = TEXTS + [" ".join(rng.choice([f"w{k}" for k in range(50)], rng.integers(0, 60))) for _ in range(80)]
    docs = [*enumerate(texts), (3, "again " * 30), (9, texts[9]), (9, texts[9]), (None, "w1 w2 " * 20)]
    target = ["w1 w2 w3", None, "W4, w5", "東京 x9"]
    draw = resampling.Draw(pct=30, min_words=5, seed=7)
    benchmark = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    found = resampling.resample(docs_frame(*docs), benchmark, longest, buckets, draw)
    assert Counter(map(tuple, found.collect())) == plain_resample(docs, target, longest, buckets, draw)


def test_empty_tables(spark, docs_frame):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = [(1, "a b " * 20), (2, None)]
    assert resampling.resample(docs_frame(*docs).limit(0), none).count() == 0
    draw = resampling.Draw(pct=100)
    assert Counter(map(tuple, resampling.resample(docs_frame(*docs), none, draw=draw).collect())) == plain_resample(docs, [], 1, 10_000, draw)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, 30, 30, 5, 100 if i % 2 else 90) for i in range(400)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    found = {r.doc_id: r.rank for r in resampling._drawn(scored, resampling.Draw(pct=60)).collect()}
    expected = [i for i in range(400) if i % 2] + [i for i in range(400) if i % 2 == 0]
    assert found == {i: (rank if rank <= 240 else None) for rank, i in enumerate(expected, 1)}


def test_crcs_of_concatenations_follow_from_the_parts():
    rng = np.random.default_rng(9)
    parts = [(rng.bytes(int(a)), rng.bytes(int(b))) for a, b in rng.integers(0, 400, (50, 2))]
    first, second = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    found = resampling.combined(first, second, np.array([len(b) for _, b in parts]))
    assert found.tolist() == [zlib.crc32(a + b) for a, b in parts]


def test_payloads_are_those_of_the_words(monkeypatch):
    text = resampling.folded("The the THE then he, a aa aaa " + "longword" * 20 + " é")
    for block in (8, 30, 1 << 20):
        monkeypatch.setattr(resampling, "BLOCK", block)
        assert resampling.payloads(text).tolist() == [zlib.crc32(w) | len(w) << 32 for w in text.split()]
    assert resampling.payloads(b"").tolist() == []
