"""Importance resampling towards a target: documents whose hashed word runs look like the target's are drawn more often.

Words are found by an automaton. The distinct words of a block of text, each between two delimiters, are its dictionary; every
word carries its CRC-32 and its length, and one scan emits these payloads in the order of the text. The CRC-32 of a run of
words follows from the payloads of its neighbours alone (the CRC of a concatenation is the first CRC moved on by the second's
length, combined with the second CRC), so no run is ever put together as text. A dictionary over the whole corpus would have
no bound; one block has ``BLOCK`` bytes at most, a longer text being cut between words and its payloads joined again.

Buckets of every document are written once. They are counted for corpus and target, the gains of the buckets (a table of fixed
size) go back to the documents, and the highest of the noisy scores are drawn by ranges of scores, not in one sorted task.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass
from functools import cache, partial
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm.common import Batches, batch, map_batches

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
DRAWN_PCT = 10
SEED = 2024
#: Bytes of text under one automaton.
BLOCK = 4 << 20

_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _WORD_BYTES else 32 for b in range(256))
_FEATURES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.list_(pa.int32()))])
_COUNTS = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def folded(text: str | None) -> bytes:
    """A-Z in lower case, and one space between words; other ASCII than letters and digits ends a word."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


@cache
def _moved_by(length: int) -> np.ndarray:
    """What each bit of a CRC becomes when ``length`` zero bytes follow."""
    if length == 0:
        return np.uint32(1) << np.arange(32, dtype=np.uint32)
    if length == 1:  # the inversions of CRC-32 cancel in the difference to the zero CRC
        return np.array([zlib.crc32(b"\0", 1 << bit) ^ zlib.crc32(b"\0") for bit in range(32)], np.uint32)
    half = _moved_by(length // 2)
    twice = _apply(half, half)
    return _apply(_moved_by(1), twice) if length % 2 else twice


def _apply(moved: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(crcs), np.uint32)
    for bit in range(32):
        out ^= np.where(crcs >> np.uint32(bit) & np.uint32(1), moved[bit], np.uint32(0))
    return out


def combined(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """CRC-32 of concatenations, from the CRCs of both parts and the length of the second."""
    out = np.empty(len(first), np.uint32)
    for length in np.unique(second_length).tolist():
        of_length = second_length == length
        out[of_length] = _apply(_moved_by(length), first[of_length])
    return out ^ second


def _scan(block: bytes) -> np.ndarray:
    """The payload of every word of a folded block, in order: CRC-32, and the length above it."""
    automaton = ahocorasick.Automaton()
    for word in set(block.split(b" ")):
        automaton.add_word(f" {word.decode('utf-8', 'surrogatepass')} ", zlib.crc32(word) | len(word) << 32)
    automaton.make_automaton()
    # words share their delimiters, and none holds one, so exactly one word ends at every delimiter but the first
    return np.fromiter(map(itemgetter(1), automaton.iter(f" {block.decode('utf-8', 'surrogatepass')} ")), np.int64)


def payloads(block: bytes) -> np.ndarray:
    """As ``_scan``, over blocks of at most BLOCK bytes cut between words; a single longer word is a block."""
    parts, low = [], 0
    while low < len(block):
        high = len(block)
        if high - low > BLOCK:
            cut = block.rfind(b" ", low, low + BLOCK)
            high = cut if cut > low else block.find(b" ", low + BLOCK)
            high = len(block) if high < 0 else high
        parts.append(_scan(block[low:high]))
        low = high + 1
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def run_crcs(words: np.ndarray, doc: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32, document) of every run of 1 to ``longest`` words within a document."""
    crcs, lengths = (words & 0xFFFFFFFF).astype(np.uint32), words >> 32
    found, owners = [crcs], [doc]
    if longest > 1 and len(words):
        spaced = combined(np.full(len(words), zlib.crc32(b" "), np.uint32), crcs, lengths)
        runs = crcs
        for order in range(2, longest + 1):
            runs = combined(runs[:-1], spaced[order - 1 :], lengths[order - 1 :] + 1)
            inside = doc[: len(runs)] == doc[order - 1 :]
            found.append(runs[inside])
            owners.append(doc[: len(runs)][inside])
    return np.concatenate(found), np.concatenate(owners)


def _bags(texts: list[str | None], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, features) of each text, and the buckets of all features, text by text."""
    blocks = [folded(t) for t in texts]
    n_words = np.array([b.count(b" ") + 1 if b else 0 for b in blocks], np.int64)
    doc = np.repeat(np.arange(len(texts)), n_words)
    crcs, owners = run_crcs(payloads(b" ".join(b for b in blocks if b)), doc, longest)
    order = np.argsort(owners, kind="stable")
    return n_words, np.bincount(owners, minlength=len(texts)), (crcs[order] % buckets).astype(np.int32)


def _feature_batches(batches: Batches, longest: int, buckets: int) -> Batches:
    for rows in batches:
        texts, low, held = rows.column("text"), 0, 0
        for at in range(1, len(texts) + 1):
            held += texts[at - 1].as_buffer().size if texts[at - 1].is_valid else 0
            if held >= BLOCK or at == len(texts):
                n_words, n_features, found = _bags(texts[low:at].to_pylist(), longest, buckets)
                starts = np.concatenate(([0], np.cumsum(n_features))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(found))
                yield batch(_FEATURES, rows.column("doc_id").slice(low, at - low), n_words, n_features, lists)
                low, held = at, 0


def features(texts: DataFrame, longest: int = MAX_RUN, buckets: int = BUCKETS, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the bucket of every run of 1 to ``longest`` words of a text, repeats included."""
    rows = texts.select(F.col(key).cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, n_words bigint, n_features bigint, buckets array<int>"
    return map_batches(rows, partial(_feature_batches, longest=longest, buckets=buckets), schema)


def _values(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _count_batches(batches: Batches, buckets: int) -> Batches:
    total = np.zeros(buckets, np.int64)
    for rows in batches:
        total += np.bincount(_values(rows.column("buckets")), minlength=buckets)
    held = np.flatnonzero(total)
    yield batch(_COUNTS, held.astype(np.int32), total[held])


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in every bucket: ``buckets`` numbers, summed per task first."""
    counts = map_batches(found.select("buckets"), partial(_count_batches, buckets=buckets), "bucket int, n bigint")
    total = np.zeros(buckets, np.int64)
    for bucket, n in counts.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of how much likelier a bucket is in the target, each bucket counting once more; rounded down."""
    all_corpus, all_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([
        math.floor(1000 * math.log((t + 1) * all_corpus / ((s + 1) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ], np.int64)


def _weigh_batches(batches: Batches, gain: np.ndarray) -> Batches:
    for rows in batches:
        n_features = rows.column("n_features").to_numpy()
        total = np.concatenate(([0], np.cumsum(gain[_values(rows.column("buckets"))])))
        ends = np.cumsum(n_features)
        yield batch(_WEIGHED, *(rows.column(c) for c in ("doc_id", "n_words", "n_features")), total[ends] - total[ends - n_features])


@dataclass
class Draw:
    """How documents are drawn: the share, the least number of words, and the seed of the noise."""

    pct: int = DRAWN_PCT
    min_words: int = MIN_WORDS
    seed: int = SEED


def noise(seed: int) -> Column:
    """Gumbel noise of a document in thousandths, from the hash of seed and doc_id; null without doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string"))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _drawn(scored: DataFrame, draw: Draw) -> DataFrame:
    """Adds ``rank`` to the drawn rows. Ranges of scores are ranked by themselves and moved on by the rows before them."""
    able = (F.col("n_words") >= draw.min_words) & F.col("score").isNotNull()
    order = [F.col("score").desc(), F.col("doc_id"), F.col("n_features"), F.col("weight")]
    in_ranges = scored.filter(able).repartitionByRange(*order).withColumn("in_range", F.spark_partition_id())
    placed = stage(in_ranges, "resampling-ranges")  # a task that is repeated must find the same ranges
    sizes = sorted(tuple(r) for r in placed.groupBy("in_range").agg(F.count("*")).collect())  # one row per range
    most = draw.pct * sum(n for _, n in sizes) // 100
    ranges = np.zeros(1 + max((r for r, _ in sizes), default=0), np.int64)
    for in_range, n in sizes:
        ranges[in_range] = n
    before = (np.cumsum(ranges) - ranges).tolist()
    last = max((r for r, _ in sizes if before[r] < most), default=-1)
    own = Window.partitionBy("in_range").orderBy(*order)
    offset = F.element_at(F.lit(before).cast("array<bigint>"), F.col("in_range") + 1)
    inside = placed.filter(F.col("in_range") <= last)
    rank = offset + F.row_number().over(own)
    ranked = inside.withColumn("rank", F.when(rank <= most, rank)).drop("in_range")
    left = placed.filter(F.col("in_range") > last).drop("in_range")
    rest = scored.filter(~F.coalesce(able, F.lit(False)))
    none = F.lit(None).cast("bigint").alias("rank")
    return ranked.unionByName(left.select("*", none)).unionByName(rest.select("*", none))


def resample(docs: DataFrame, target: DataFrame, longest: int = MAX_RUN, buckets: int = BUCKETS, draw: Draw | None = None) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank), one row per row of ``docs`` (doc_id, text); ``target`` has text.

    A null, empty or wordless text has no features and weight 0. Of the N rows with enough words and a doc_id, floor(pct N /
    100) are drawn, highest score first, ties to the smaller doc_id; their ranks start at 1, all others have none. A row
    without doc_id counts in the corpus but has no noise, so its score is null and it is never drawn. Repeated rows count and
    compete as often as they occur. An empty target makes gains of the corpus' counts alone; no documents, no rows.
    """
    found = stage(features(docs, longest, buckets), "resampling-buckets")
    aim = bucket_counts(features(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), longest, buckets), buckets)
    gain = gains(bucket_counts(found, buckets), aim)
    weighed = map_batches(found, partial(_weigh_batches, gain=gain), "doc_id bigint, n_words bigint, n_features bigint, weight bigint")
    scored = weighed.withColumn("score", F.col("weight") + noise((draw or Draw()).seed))
    return _drawn(stage(scored, "resampling-scores"), draw or Draw())
