from __future__ import annotations

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from marginlens.llm import toxicity
from marginlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def plain_subwords(word):
    """Buckets of a word's n-grams and of the word as a whole, one at a time."""
    codes = [2, *map(ord, word), 3]

    def rolled(run):
        h = 0
        for c in run:
            h = (h * 0x100000001B3 + c + 1) % 2**64
        return h

    found = [rolled(codes[i : i + n]) + n for n in range(toxicity.SHORTEST, toxicity.LONGEST + 1) for i in range(len(codes) - n + 1)]
    found.append(sum((c + 1) * pow(0x100000001B3, i, 2**64) for i, c in enumerate(codes)))
    return [(h % 2**64 * 0x9E3779B97F4A7C15 % 2**64) >> (64 - toxicity.BUCKET_BITS) for h in found]


@pytest.mark.parametrize("vocabulary", [["a"], ["ab", "a", "abcdefgh", "é", "naïve😀", "x" * 300], ["the", "then"] * 3])
def test_subwords_equal_those_of_single_words(vocabulary):
    buckets, owners = toxicity.hashed(vocabulary)
    found = [sorted(buckets[owners == i].tolist()) for i in range(len(vocabulary))]
    assert found == [sorted(plain_subwords(w)) for w in vocabulary]


def test_scores_equal_a_softmax_over_averaged_vectors():
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(0, 1, (toxicity.BUCKETS, toxicity.DIMENSION)), rng.normal(0, 1, (toxicity.DIMENSION, 2)), np.array([0.3, -0.2]))
    adds, bias = model.log_odds()
    texts = ["The cat, the CAT", "", None, "é " * 30 + "x", " \n"]
    for text, score in zip(texts, toxicity._Scorer(adds, bias).scores(texts), strict=True):
        words = toxicity.words(text)
        vectors = [model.vectors[plain_subwords(w)].mean(0) for w in words]
        logits = (np.mean(vectors, axis=0) if words else np.zeros(toxicity.DIMENSION)) @ model.weights + model.bias
        assert score == pytest.approx(np.exp(logits[1]) / np.exp(logits).sum())


def test_misspelt_words_share_what_was_learned():
    rng = np.random.default_rng(4)
    plain = ["river", "stone", "window", "garden", "letter", "winter", "music", "paper", "table", "number"]
    bad = ["horrible", "worthless", "pathetic"]

    def text(extra):
        return " ".join([*rng.choice(plain, 30), *extra])

    texts = [text(rng.choice(bad, 3)) for _ in range(60)] + [text([]) for _ in range(120)]
    model = toxicity.train(texts, [1] * 60 + [0] * 120)
    scorer = toxicity._Scorer(*model.log_odds())
    seen, misspelt, clean = scorer.scores([text(["horrible", "pathetic"]), text(["horribble", "worthlesss", "pathetick"]), text(["whistle"])])
    assert seen > 0.7 and misspelt > 0.7 and clean < 0.5
    again = toxicity.train(texts, [1] * 60 + [0] * 120)
    assert np.array_equal(again.vectors, model.vectors)  # the same sample gives the same model


def test_nothing_to_learn_from_gives_a_neutral_model(spark, docs_frame):
    docs = docs_frame((1, "a b"), (2, None), (3, ""))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        scored = toxicity.score(docs, toxicity.fit(docs, some))
        assert [r.score for r in scored.collect()] == [0.5] * 3
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_edges(spark, docs_frame):
    long = "word " * 100_000
    docs = docs_frame((1, "a b"), (1, "a b"), (2, None), (None, "horrid"), (5, long), (6, "x" * 200_000), (9, "  \n"))
    model = toxicity.train(["bad horrid bad", "bad horrid", "good day", "good day day"], [1, 1, 0, 0])
    rows = Counter((r.doc_id, r.held_out) for r in toxicity.score(docs, model).collect())
    held = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in (1, 2, 5, 6, 9)}
    assert rows == Counter({(1, held[1]): 2, **{(i, held[i]): 1 for i in (2, 5, 6, 9)}, (None, False): 1})
    assert toxicity.score(docs, model).columns == ["doc_id", "held_out", "score", "predicted"]


def test_the_sample_is_bounded_and_leaves_held_out_documents_alone(spark, docs_frame, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", {0: 20, 1: 10})
    docs = docs_frame(*[(i, f"text {i}") for i in range(400)], *[(7, f"again {i}") for i in range(50)], (None, "nobody"))
    labels = spark.createDataFrame(
        [(i, 1, int(i % 4 == 0)) for i in range(400)] + [(3, 1, 1), (3, 0, 0), (8, 1, None), (999, 1, 1), (None, 1, 1)],
        "doc_id long, quality int, toxic int")
    rows = [(r.text, r.toxic) for r in toxicity.sample(docs, labels).collect()]
    assert Counter(t for _, t in rows) == {0: 20, 1: 10}
    ids = [int(text.split()[1]) for text, _ in rows if text.startswith("text")]
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)
    assert sorted(rows) == sorted((r.text, r.toxic) for r in toxicity.sample(docs, labels).collect())


def test_held_out_documents(spark):
    labels = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '/root/testdata/sf0.1/labels.parquet'").fetchall())
    found = {r.doc_id: r for r in QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    held = [(found[d].score, y) for d, y in labels.items() if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for d, r in found.items())
    caught = np.mean([s >= 0.7 for s, y in held if y == 1])
    flagged = np.mean([s >= 0.7 for s, y in held if y == 0])
    scores, y = np.array([s for s, _ in held]), np.array([y for _, y in held])
    area = np.mean(scores[y == 1][:, None] > scores[y == 0][None])
    assert caught > 0.6 and flagged < 0.04 and area > 0.9
