"""Toxicity by bags of subwords: the vectors of a text's words are averaged and a linear softmax reads the average.

A word's vector is the mean of the vectors of its character n-grams (its edges are marked by the characters 2 and 3) and of the
word as a whole, so a misspelt or invented word that was never seen in training stands near the words that it shares n-grams
with. N-grams are hashed to ``BUCKETS`` rows; a row that no training text touches is zero and says nothing. The vectors and the
softmax are trained together, in numpy, on a sample of labelled documents of bounded number and size; scoring reads whole texts
of all rows.

At scoring time the softmax is linear in the average, so every bucket is reduced to one number (its share of the log-odds)
and a text's log-odds are the mean over its words. Tasks receive that table alone: BUCKETS numbers, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import Batches, batch, crc_bucket, map_batches

FOLDS = 3
HELD_OUT_FOLD = 1
THRESHOLD = 0.7
#: The bound of the fitted sample: documents of each label, and the longest text among them in characters.
TRAIN_DOCS = {0: 2000, 1: 1000}
TRAIN_CHARS = 100_000
#: Character n-grams of a word with its edges marked, shortest and longest; the whole word is one more.
SHORTEST, LONGEST = 3, 5
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
DIMENSION = 8
STEPS = 300
RATE, MOMENTUM, DECAY = 2.0, 0.9, 1e-6
#: A bucket gets a vector if this share of the training documents holds one of its n-grams; at most so many buckets do.
LEAST_SHARE, FEATURES = 0.03, 1 << 14
#: Characters of words that are hashed at once.
CHUNK = 1 << 20

_BASE, _SPREAD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_MODEL = pa.schema([(name, pa.binary()) for name in ("used", "vectors", "weights", "bias")])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def words(text: str | None) -> list[str]:
    """The words of a text with A-Z in lower case; none for null."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").lower().split()]


def distinct(found: list[str]) -> tuple[list[str], np.ndarray]:
    """The distinct words and how often each occurs."""
    counts: dict[str, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    return list(counts), np.fromiter(counts.values(), np.int64, len(counts))


def hashed(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place of the word in ``vocabulary``) of every subword of the words, in no order."""
    codes = np.frombuffer("".join(f"\2{w}\3" for w in vocabulary).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes += np.uint64(1)
    lengths = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary)) + 2
    ends = np.cumsum(lengths)
    starts, word = ends - lengths, np.repeat(np.arange(len(vocabulary)), lengths)
    position = np.arange(len(codes))
    to_end = ends[word] - position
    hashes, owners, rolling = [], [], np.zeros(len(codes), np.uint64)
    for order in range(1, LONGEST + 1):
        rolling = rolling[: len(codes) - order + 1] * _BASE + codes[order - 1 :]
        if order >= SHORTEST:
            inside = to_end[: len(rolling)] >= order
            hashes.append(rolling[inside] + np.uint64(order))
            owners.append(word[: len(rolling)][inside])
    powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(int(lengths.max()) - 1, _BASE))))
    hashes.append(np.add.reduceat(codes * powers[position - starts[word]], starts))
    owners.append(np.arange(len(vocabulary)))
    buckets = (np.concatenate(hashes) * _SPREAD) >> np.uint64(64 - BUCKET_BITS)
    return buckets.astype(np.int64), np.concatenate(owners)


@dataclass
class Model:
    """Subword vectors, and the weights and bias of the softmax over (clean, toxic)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def log_odds(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the log-odds of toxic, and the bias."""
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0]), float(self.bias[1] - self.bias[0])


def empty_model() -> Model:
    return Model(np.zeros((BUCKETS, DIMENSION), np.float32), np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32))


def _averages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(used buckets, documents x used): the weight of each subword in the average of a document's words.

    Used are the buckets that LEAST_SHARE of the documents hold, the FEATURES most frequent of them at most.
    """
    rows, documents = [], np.zeros(BUCKETS, np.int64)
    for text in texts:
        vocabulary, counts = distinct(words(text))
        if vocabulary:
            buckets, owners = hashed(vocabulary)
            each = (counts / np.bincount(owners) / counts.sum())[owners]
            held, inverse = np.unique(buckets, return_inverse=True)
            rows.append((held.astype(np.int32), np.bincount(inverse, each).astype(np.float32)))
            documents[held] += 1
        else:
            rows.append((np.empty(0, np.int32), np.empty(0, np.float32)))
    enough = np.flatnonzero(documents >= max(2, LEAST_SHARE * len(texts)))
    used = np.sort(enough[np.lexsort((enough, -documents[enough]))][:FEATURES])
    place = np.full(BUCKETS, -1, np.int64)
    place[used] = np.arange(len(used))
    dense = np.zeros((len(texts), len(used)), np.float32)
    for d, (held, share) in enumerate(rows):
        inside = place[held] >= 0
        dense[d, place[held[inside]]] = share[inside]
    return used, dense


def train(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """Vectors and softmax, trained jointly by gradient descent with momentum; both labels weigh the same.

    A subword's step is scaled by the root of its usual share of a text, so that frequent subwords don't drown the rare ones
    that tell most. Without both labels, or without a subword that several texts share: a model of zeros.
    """
    y = np.array(labels, np.int64)
    if not (y == 0).any() or not (y == 1).any():
        return empty_model()
    used, shares = _averages(texts)
    if not len(used):
        return empty_model()
    scale = (np.einsum("ij,ij->j", shares, shares) / len(shares)) ** -0.25
    shares *= scale
    size = np.sqrt(np.einsum("ij,ij->", shares, shares) / len(shares))
    shares /= size
    rng = np.random.default_rng(11)
    vectors = np.zeros((len(used), DIMENSION), np.float32)
    weights = rng.normal(0, DIMENSION**-0.5, (DIMENSION, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    moving = [np.zeros_like(v) for v in (vectors, weights, bias)]
    target = np.eye(2, dtype=np.float32)[y]
    share_of_label = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)[:, None]
    for _ in range(steps):
        average = shares @ vectors
        logits = average @ weights + bias
        chance = np.exp(logits - logits.max(1, keepdims=True))
        error = (chance / chance.sum(1, keepdims=True) - target) * share_of_label
        gradients = shares.T @ (error @ weights.T) + DECAY * vectors, average.T @ error + DECAY * weights, error.sum(0)
        for value, move, gradient in zip((vectors, weights, bias), moving, gradients, strict=True):
            move *= MOMENTUM
            move += gradient
            value -= RATE * move
    model = empty_model()
    model.vectors[used], model.weights, model.bias = vectors * (scale / size)[:, None], weights, bias
    return model


def train_share(key: str = "doc_id") -> Column:
    """Whether labels of this row may be learned; a null doc_id is neither learned from nor held out."""
    return F.coalesce(crc_bucket(key, FOLDS) != HELD_OUT_FOLD, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): at most TRAIN_DOCS documents of each label outside the held-out fold, those of the smallest hash.

    The draw is over (doc_id, label) alone; at most some thousand ids are joined to the documents, by a broadcast. A document
    with several labels is toxic if one says so; texts over TRAIN_CHARS characters are not learned from.
    """
    marked = labels.select(F.col("doc_id").cast("bigint").alias("labelled"), "toxic").filter(F.col("toxic").isin(0, 1) & train_share("labelled"))
    one = marked.groupBy("labelled").agg(F.max("toxic").cast("int").alias("toxic"))
    drawn = one.withColumn("draw", F.xxhash64(F.lit("toxicity sample"), "labelled"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("labelled"), "text").filter(F.length("text") <= TRAIN_CHARS)
    parts = []
    for label, most in TRAIN_DOCS.items():
        first = drawn.filter(F.col("toxic") == label).orderBy("draw", "labelled").limit(most)
        found = texts.join(F.broadcast(first), "labelled").select("toxic", "draw", "text")
        parts.append(found.orderBy("draw", F.xxhash64("text")).limit(most))  # repeated ids don't widen the bound
    return parts[0].unionByName(parts[1])


def _train_batches(batches: Batches) -> Batches:
    texts, labels = [], []
    for rows in batches:
        texts += rows.column("text").to_pylist()
        labels += rows.column("toxic").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: (labels[i], texts[i]))  # the sums then don't depend on the order of arrival
    model = train([texts[i] for i in order], [labels[i] for i in order])
    used = np.flatnonzero(model.vectors.any(1)).astype("<i4")
    parts = used, model.vectors[used].astype("<f4"), model.weights.astype("<f4"), model.bias.astype("<f4")
    yield batch(_MODEL, *([p.tobytes()] for p in parts))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the sample, trained in one task; what comes to the driver are at most FEATURES vectors."""
    found = map_batches(sample(docs, labels).repartition(1), _train_batches, "used binary, vectors binary, weights binary, bias binary")
    model = empty_model()
    for row in found.collect():
        model.vectors[np.frombuffer(row.used, "<i4")] = np.frombuffer(row.vectors, "<f4").reshape(-1, DIMENSION)
        model.weights = np.frombuffer(row.weights, "<f4").reshape(DIMENSION, 2)
        model.bias = np.frombuffer(row.bias, "<f4")
    return model


class _Scorer:
    def __init__(self, adds: np.ndarray, bias: float):
        self.adds, self.bias = adds, bias

    def _word_values(self, vocabulary: list[str]) -> np.ndarray:
        """Mean share of the log-odds of each word's subwords, some characters of words at once."""
        values, low, held = np.empty(len(vocabulary)), 0, 0
        for at, word in enumerate(vocabulary, 1):
            held += len(word)
            if held >= CHUNK or at == len(vocabulary):
                buckets, owners = hashed(vocabulary[low:at])
                values[low:at] = np.bincount(owners, self.adds[buckets]) / np.bincount(owners)
                low, held = at, 0
        return values

    def scores(self, texts: list[str | None]) -> np.ndarray:
        at: dict[str, int] = {}
        bags = [np.array([at.setdefault(w, len(at)) for w in words(t)], np.int64) for t in texts]
        values = self._word_values(list(at))
        odds = np.array([values[b].mean() if len(b) else 0.0 for b in bags]) + self.bias
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _score_batches(batches: Batches, scorer: _Scorer) -> Batches:
    for rows in batches:
        texts, low, held = rows.column("text"), 0, 0
        for at in range(1, len(texts) + 1):
            held += texts[at - 1].as_buffer().size if texts[at - 1].is_valid else 0
            if held >= CHUNK or at == len(texts):
                score = scorer.scores(texts[low:at].to_pylist())
                kept = rows.slice(low, at - low)
                yield batch(_SCORED, kept.column("doc_id"), kept.column("held_out"), score, (score >= THRESHOLD).astype(np.int32))
                low, held = at, 0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``docs`` (columns doc_id, text; others are not read).

    ``score`` is the softmax's share of toxic for the whole text. A null, empty or blank text has no words and gets what the
    bias alone says; a model without vectors gives 0.5. Repeated rows come out as often as they go in; a null doc_id is scored
    and not held out; no rows in, no rows out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), "text")
    adds, bias = model.log_odds()
    scorer = _Scorer(adds.astype(np.float64), bias)
    return map_batches(rows, partial(_score_batches, scorer=scorer), "doc_id bigint, held_out boolean, score double, predicted int")
