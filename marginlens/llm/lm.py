"""Interpolated modified Kneser-Ney bigram model, counted in Spark and memory-mapped by the workers that score.

The vocabulary is a sorted array of 64-bit word hashes, cut into shards by range; a word's number is its place in it. The
bigrams are a sorted array of (context number * vocabulary + word number), cut into shards at quantiles of the unigram
counts, so that a context that owns a third of all tokens is spread over a third of the shards. Tasks count blocks of text,
hand sorted and compressed blocks to the shards, and every shard is merged by one task that writes its arrays to the shared
folder. Scoring maps the arrays and looks up the distinct words and bigrams of a block at a time; nothing of the model
passes through the driver but totals and one row per shard.

The shared folder must be a path that workers can map (a mounted file system); files are written under a name of their own
and renamed, so that a repeated task replaces a shard by the same bytes.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import shared_dir, stage
from marginlens.llm.common import BLANKS, Batches, crc_bucket, map_batches, ship, text_bytes

FOLDS, HELD_OUT = 7, 2
#: Bytes of text in a shard, and in a block that is counted at a time.
SHARD_BYTES, BLOCK_BYTES = 32 << 20, 4 << 20
END = np.uint64(0x5D)  # hash of the mark that ends a text
_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.isin(np.arange(256), list(BLANKS.encode()))
_BLOBS = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_STATS = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        factors = np.full(n, base, np.uint64)
        factors[:1] = 1
        return np.cumprod(factors, dtype=np.uint64)


class Hasher:
    """Hashes all words of a run of texts at once, by differences of running polynomial sums."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token hashes of all texts, each text followed by END, and the number of tokens of each."""
        octets = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        if len(self.up) <= len(octets):
            self.up, self.down = _powers(len(octets) + 1, _BASE), _powers(len(octets) + 1, pow(_BASE, -1, 1 << 64))
        blank = _BLANK[octets]
        edges = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate(([np.uint64(0)], np.cumsum((_LOWER[octets].astype(np.uint64) + np.uint64(1)) * self.up[: len(octets)])))
            words = (sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                words = (words ^ (words >> np.uint64(shift))) * np.uint64(factor)
            words ^= words >> np.uint64(31)
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        per_text = np.diff(np.concatenate(([0], np.searchsorted(starts, text_ends)))) + 1
        tokens = np.full(len(words) + len(texts), END, np.uint64)
        is_word = np.ones(len(tokens), bool)
        is_word[np.cumsum(per_text) - 1] = False
        tokens[is_word] = words
        return tokens, per_text


def _blocks(batches: Batches):
    """(rows, texts) of at most BLOCK_BYTES, or one longer text."""
    for rows in batches:
        texts, at, size = rows.column("text"), 0, 0
        lengths = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
        for i, n in enumerate(lengths):
            if size and size + n > BLOCK_BYTES:
                yield rows.slice(at, i - at), [t.as_py() for t in texts.slice(at, i - at)]
                at, size = i, 0
            size += n
        if at < rows.num_rows:
            yield rows.slice(at), [t.as_py() for t in texts.slice(at)]


def _pack(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def _unpack(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted integers as differences, their bytes grouped by significance so that the high ones compress away."""
    steps = np.diff(keys.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _write(folder: str, name: str, values: np.ndarray) -> None:
    own = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    values.tofile(own)
    os.replace(own, os.path.join(folder, name))


def _cut(values: np.ndarray, bounds: np.ndarray) -> list[tuple[int, slice]]:
    """(shard, slice) of sorted values; ``bounds`` are the first values of the shards but the first one."""
    places = np.concatenate(([0], np.searchsorted(values, bounds), [len(values)]))
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)) if b > a]


def _hash_bounds(shards: int) -> np.ndarray:
    return np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)


def _word_batches(batches: Batches, shards: int) -> Batches:
    hasher, bounds = Hasher(), _hash_bounds(shards)
    for _, texts in _blocks(batches):
        words, counts = np.unique(hasher(texts)[0], return_counts=True)
        parts = _cut(words, bounds)
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in parts], pa.int32()), pa.array([_pack(words[s]) for _, s in parts], pa.binary()),
            pa.array([_pack(counts[s].astype(np.uint32)) for _, s in parts], pa.binary())], schema=_BLOBS)


def _write_words(group: pa.Table, folder: str) -> pa.Table:
    shard = group.column("shard")[0].as_py()
    words, counts = _merge([_unpack(b.as_py(), np.uint64) for b in group.column("keys")],
                           [_unpack(b.as_py(), np.uint32) for b in group.column("counts")])
    _write(folder, f"words-{shard}", words)
    _write(folder, f"counts-{shard}", counts)
    return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(words)], "tokens": [int(counts.sum())]})


@dataclass
class Model:
    """Where the arrays are, and the totals. ``sizes`` and ``tokens`` are per vocabulary shard."""

    folder: str
    sizes: list[int]
    tokens: list[int]
    bigram_shards: int
    discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    lower_discounts: tuple[float, ...] = (0.0, 0.0, 0.0)
    bigrams: int = 0
    lower_spare: float = 1.0

    @property
    def vocabulary(self) -> int:
        return sum(self.sizes)

    @cached_property
    def offsets(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)

    @cached_property
    def maps(self) -> dict[tuple[str, int], np.ndarray]:
        return {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("maps", "offsets")}

    def array(self, name: str, shard: int, kind) -> np.ndarray:
        """A mapped array; of an absent or empty shard an empty one."""
        if (name, shard) not in self.maps:
            path = os.path.join(self.folder, f"{name}-{shard}")
            there = os.path.exists(path) and os.path.getsize(path)
            self.maps[name, shard] = np.memmap(path, kind, "r") if there else np.empty(0, kind)
        return self.maps[name, shard]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers of sorted word hashes, -1 for words that are not in the vocabulary."""
        found = np.full(len(words), -1, np.int64)
        for k, s in _cut(words, _hash_bounds(len(self.sizes))):
            own = self.array("words", k, np.uint64)
            if len(own):
                at = np.minimum(np.searchsorted(own, words[s]), len(own) - 1)
                found[s] = np.where(own[at] == words[s], at + self.offsets[k], -1)
        return found

    def of_words(self, name: str, numbers: np.ndarray, kind) -> np.ndarray:
        """Values of sorted word numbers."""
        out = np.zeros(len(numbers), kind)
        for k, s in _cut(numbers, self.offsets[1:-1]):
            out[s] = self.array(name, k, kind)[numbers[s] - self.offsets[k]]
        return out

    @cached_property
    def bigram_bounds(self) -> np.ndarray:
        """First keys of the bigram shards, at quantiles of the contexts and, inside a frequent context, of its words."""
        before = np.concatenate(([0], np.cumsum(self.tokens)))
        total, bounds = int(before[-1]), []

        def at(rank: float) -> tuple[int, float]:
            k = min(int(np.searchsorted(before, rank, "right")) - 1, len(self.sizes) - 1)
            sums = np.cumsum(self.array("counts", k, np.int64))
            i = min(int(np.searchsorted(sums, rank - before[k], "right")), len(sums) - 1)
            return int(self.offsets[k]) + i, (rank - before[k] - (sums[i - 1] if i else 0)) / (sums[i] - (sums[i - 1] if i else 0))

        for q in range(1, self.bigram_shards):
            context, share = at(total * q / self.bigram_shards)
            bounds.append(context * self.vocabulary + at(min(max(share, 0.0), 1 - 1e-12) * total)[0])
        return np.array(bounds, np.int64)

    def pairs(self, numbers: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The context of every token: the number of the token before it, the vocabulary's size at a text's start."""
        contexts = np.concatenate(([self.vocabulary], numbers[:-1]))
        contexts[np.concatenate(([0], np.cumsum(per_text)[:-1]))] = self.vocabulary
        return contexts


def _numbered(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, inverse = np.unique(tokens, return_inverse=True)
    numbers = model.numbers(words)
    return words, numbers, inverse


def _bigram_batches(batches: Batches, model: Model) -> Batches:
    hasher = Hasher()
    for _, texts in _blocks(batches):
        tokens, per_text = hasher(texts)
        _, numbers, inverse = _numbered(model, tokens)
        own = numbers[inverse]
        keys, counts = np.unique(model.pairs(own, per_text) * model.vocabulary + own, return_counts=True)
        parts = _cut(keys, model.bigram_bounds)
        yield pa.RecordBatch.from_arrays([
            pa.array([k for k, _ in parts], pa.int32()), pa.array([_pack_sorted(keys[s]) for _, s in parts], pa.binary()),
            pa.array([_pack(counts[s].astype(np.uint32)) for _, s in parts], pa.binary())], schema=_BLOBS)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == n).sum() for n in (1, 2, 3, 4)] + [len(counts)], np.int64)


def _write_bigrams(group: pa.Table, model: Model) -> pa.Table:
    """Writes a shard; gives its counts of counts, and per vocabulary shard how its words follow and are followed."""
    shard = group.column("shard")[0].as_py()
    keys, counts = _merge([_unpack_sorted(b.as_py()) for b in group.column("keys")],
                          [_unpack(b.as_py(), np.uint32) for b in group.column("counts")])
    keys = keys.astype(np.int64)
    _write(model.folder, f"bigrams-{shard}", keys)
    _write(model.folder, f"times-{shard}", counts.astype(np.uint32))
    contexts, followed = keys // model.vocabulary, np.minimum(counts, 3)
    rows = [("totals", shard, _pack(_counts_of_counts(counts)), b"")]
    heads, classes = np.unique(contexts * 4 + followed, return_counts=True)
    for kind, own, n, by in (("context", heads, classes, 4), ("word", *np.unique(keys % model.vocabulary, return_counts=True), 1)):
        for k, s in _cut(own // by, model.offsets[1:-1]):
            rows.append((kind, k, _pack_sorted(own[s]), _pack(n[s].astype(np.uint32))))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _STATS, strict=True)], schema=_STATS)


def _write_stats(group: pa.Table, model: Model) -> pa.Table:
    """Writes what a vocabulary shard's words keep for others as contexts, and how many contexts they follow."""
    shard = group.column("shard")[0].as_py()
    kinds, low, n = group.column("kind").to_pylist(), int(model.offsets[shard]), model.sizes[shard]

    def merged(kind: str) -> tuple[np.ndarray, np.ndarray]:
        own = [(a.as_py(), b.as_py()) for k, a, b in zip(kinds, group.column("a"), group.column("b"), strict=True) if k == kind]
        keys, counts = _merge([_unpack_sorted(a) for a, _ in own] or [np.empty(0, np.uint64)],
                              [_unpack(b, np.uint32) for _, b in own] or [np.empty(0, np.uint32)])
        return keys.astype(np.int64), counts

    heads, classes = merged("context")
    mass = np.zeros(n + 1)
    np.add.at(mass, heads // 4 - low, np.array((0.0, *model.discounts))[heads % 4] * classes)
    counts = model.array("counts", shard, np.int64)
    _write(model.folder, f"spare-{shard}", (mass[:n] / np.maximum(counts, 1)).astype(np.float32))
    if shard == len(model.sizes) - 1:  # the start of a text is the context after the last word
        _write(model.folder, "start", mass[n:])
    words, follows = merged("word")
    contexts = np.zeros(n, np.uint32)
    contexts[words - low] = follows
    _write(model.folder, f"contexts-{shard}", contexts)
    return pa.table({"shard": pa.array([shard], pa.int32()), "n": [_counts_of_counts(follows).tolist()]})


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more; 0.5 where counts of counts are missing or out of range."""
    if not n1 + 2 * n2:
        return 0.5, 0.5, 0.5
    y, n = n1 / (n1 + 2 * n2), (n1, n2, n3, n4)
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.5 for k in (1, 2, 3)]
    return tuple(d if 0 < d < k else 0.5 for k, d in zip((1, 2, 3), found, strict=True))


def _mapped_folder(docs: DataFrame) -> str:
    shared = shared_dir(docs.sparkSession)
    path = shared.removeprefix("file://")
    if "://" in path or path.startswith("hdfs:"):
        raise ValueError(f"the model is mapped by workers: {shared} must be a mounted folder")
    folder = os.path.join(path, "marginlens", docs.sparkSession.sparkContext.applicationId, f"bigram-model-{uuid.uuid4().hex}")
    os.makedirs(folder)
    return folder


def _per_shard(rows: DataFrame, shards: int, function, schema: str, **kept) -> DataFrame:
    """``function`` on the rows of each shard. There are as many tasks as shards ask for, whatever the session's setting is:
    what a task reads stays at a few shards of SHARD_BYTES however large the corpus.
    """

    def merge(group: pa.Table) -> pa.Table:
        return function(group, **kept)

    return rows.repartition(2 * shards, "shard").groupBy("shard").applyInArrow(merge, schema)


def held_out() -> Column:
    """Documents kept from training; a null doc_id is neither held out nor learned from."""
    return F.coalesce(crc_bucket("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """The model of the documents (doc_id, text) that are not held out."""
    ship(docs.sparkSession)
    train = docs.filter(crc_bucket("doc_id", FOLDS) != HELD_OUT).select(text_bytes().alias("text"))
    octets = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 1 + octets // SHARD_BYTES
    folder = _mapped_folder(docs)
    counted = map_batches(train, partial(_word_batches, shards=shards), "shard int, keys binary, counts binary")
    written = _per_shard(counted, shards, _write_words, "shard int, words bigint, tokens bigint", folder=folder)
    found = {r["shard"]: r for r in written.collect()}
    sizes, tokens = ([found[k][c] if k in found else 0 for k in range(shards)] for c in ("words", "tokens"))
    model = Model(folder, sizes, tokens, shards)
    if not model.vocabulary:
        return model

    pairs = map_batches(train, partial(_bigram_batches, model=model), "shard int, keys binary, counts binary")
    stats = stage(_per_shard(pairs, shards, _write_bigrams, "kind string, shard int, a binary, b binary", model=model), "bigram-stats")
    totals = sum(_unpack(r["a"], np.int64) for r in stats.filter("kind = 'totals'").select("a").collect())
    model.discounts, model.bigrams = discounts(*totals[:4].tolist()), int(totals[4])
    # every shard has a row, so that every shard's arrays are written
    shard_rows = docs.sparkSession.range(shards).select(
        F.lit("none").alias("kind"), F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b"))
    of_words = stats.filter("kind != 'totals'").unionByName(shard_rows)
    done = _per_shard(of_words, shards, _write_stats, "shard int, n array<bigint>", model=model).collect()
    lower = np.sum([r["n"] for r in done], axis=0)
    model.lower_discounts = discounts(*lower[:4].tolist())
    one, two = int(lower[0]), int(lower[1])
    kept = np.dot(model.lower_discounts, [one, two, int(lower[4]) - one - two])
    model.lower_spare = float(kept) / model.bigrams
    return model


def _score_block(model: Model, tokens: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known tokens, base score and score of each text."""
    total, size = sum(model.tokens), model.vocabulary
    starts = np.concatenate(([0], np.cumsum(per_text)[:-1]))
    _, numbers, inverse = _numbered(model, tokens)
    known = numbers >= 0
    in_order = np.argsort(numbers[known], kind="stable")
    sorted_numbers = numbers[known][in_order]

    def of_words(name: str, kind) -> np.ndarray:
        out = np.zeros(len(numbers), np.float64)
        out[np.flatnonzero(known)[in_order]] = model.of_words(name, sorted_numbers, kind)
        return out

    counts, contexts = of_words("counts", np.int64), of_words("contexts", np.uint32)
    base = np.log10((counts + 1) / (total + 1 * (size + 1)))
    lower = np.array((0.0, *model.lower_discounts))[np.minimum(contexts, 3).astype(int)]
    lower = (contexts - lower) / max(model.bigrams, 1) + model.lower_spare / (size + 1)
    spare = np.where(known, of_words("spare", np.float32), 1.0)

    own, at_start = numbers[inverse], np.zeros(len(tokens), bool)
    at_start[starts] = True
    context = model.pairs(own, per_text)
    before = np.concatenate(([0], inverse[:-1]))
    n_texts, start_mass = _start(model)
    of_context = np.where(at_start, n_texts, counts[before])
    left = np.where(at_start, start_mass / n_texts if n_texts else 1.0, spare[before])

    keys, of_pair = np.unique(np.where((own >= 0) & (context >= 0), context * size + own, -1), return_inverse=True)
    times = np.zeros(len(keys))
    for k, s in _cut(keys, model.bigram_bounds) if size else ():
        there = model.array("bigrams", k, np.int64)
        if len(there):
            at = np.minimum(np.searchsorted(there, keys[s]), len(there) - 1)
            times[s] = np.where(there[at] == keys[s], model.array("times", k, np.uint32)[at], 0)
    times = times[of_pair]
    higher = times - np.array((0.0, *model.discounts))[np.minimum(times, 3).astype(int)]
    chance = higher / np.maximum(of_context, 1) + left * lower[inverse]
    sums = [np.add.reduceat(x, starts) for x in (known[inverse].astype(np.int64), base[inverse], np.log10(chance))]
    return sums[0], sums[1], sums[2]


def _start(model: Model) -> tuple[int, float]:
    """Training texts (as many as END has been counted) and what the start of a text keeps for words not seen there."""
    number = model.numbers(np.array([END]))
    if number[0] < 0:
        return 0, 0.0
    mass = np.fromfile(os.path.join(model.folder, "start"), np.float64)
    return int(model.of_words("counts", number, np.int64)[0]), float(mass[0])


def _score_batches(batches: Batches, model: Model) -> Batches:
    hasher = Hasher()
    for rows, texts in _blocks(batches):
        tokens, per_text = hasher(texts)
        known, base, score = _score_block(model, tokens, per_text)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(per_text, pa.int64()),
                                          pa.array(known, pa.int64()), pa.array(base), pa.array(score)], schema=_SCORES)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs`` (doc_id, text).

    A null, empty or blank text is the end mark alone. Words outside the vocabulary share one part of the uniform base;
    after a word outside the vocabulary the lower order is taken as it is. ``score`` is the log10 probability of the text,
    perplexity is 10 ** (-score / n_tokens). Repeated rows come out as often as they go in; no rows in, no rows out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), text_bytes().alias("text"))
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    scored = map_batches(rows, partial(_score_batches, model=model), schema)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(sum(model.tokens)).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
