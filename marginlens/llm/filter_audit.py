"""What filters remove, by themselves and in every order, from a sparse document-term matrix.

Documents are encoded in blocks: a shard is a CSR matrix of its documents over the words that it holds, and each column carries
the word's id in one dictionary for the whole corpus. The id is a 64-bit hash, which every task finds without a join; the
dictionary groups the ids of all shards and tells the words that share one, and those few get the hash of another seed. So
only distinct words per task are shuffled, and neither matrix nor texts are. Row sums are the words of a document and
nonzero counts its distinct words; they decide filters A and B. The other flags are attached, copies are found by a digest
of the text, and everything else is counted on rows of (part, set of failed filters).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlens.functions.staged import WIDE_ROWS, stage
from marginlens.llm.common import Batches, batch, map_batches

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PCT = 50
MAX_UPPER_PCT = 3
SYMBOLS = rb"[#$%&*|]"
#: Bytes of text in one shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: The most words that may need another id before the dictionary asks for another hash. 64 bits make a few of 10^10 words.
MOST_MOVED = 10_000

_UPPER = bytes(range(65, 91))
_ROW = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("digest", pa.binary()), ("flags", pa.int32())])
_SHARD = pa.schema([
    ("shard", pa.int64()), ("words", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())),
    ("columns", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("rows", pa.list_(_ROW)),
])
_SHARD_SQL = (
    "shard bigint, words array<string>, ids array<bigint>, starts array<bigint>, columns array<int>, counts array<int>, "
    "rows array<struct<doc_id: bigint, part: string, digest: binary, flags: int>>"
)
_FLAGGED = pa.schema([*_ROW])


def word_ids(words: Iterable[bytes], n: int, seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, n).view(np.int64)


def _text_flags(text: str, raw: bytes) -> int:
    """Bits of filters C and D, which read characters and not words."""
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (1 << 2 if 100 * upper > MAX_UPPER_PCT * len(text) else 0) | (1 << 3 if re.search(SYMBOLS, raw) else 0)


class _Shard:
    """Documents encoded one after another against the words met so far."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.columns, self.counts, self.rows, self.bytes = [], [], [], 0

    def add(self, doc_id: int | None, text: str | None, part: str | None) -> None:
        text = text or ""
        raw, at = text.encode("utf-8", "surrogatepass"), self.at
        found, counts = np.unique(np.array([at.setdefault(w, len(at)) for w in raw.split()], np.int32), return_counts=True)
        self.columns.append(found)
        self.counts.append(counts.astype(np.int32))
        self.rows.append({"doc_id": doc_id, "part": part or "", "digest": hashlib.sha256(raw).digest(), "flags": _text_flags(text, raw)})
        self.bytes += len(raw)

    def record(self, shard: int) -> pa.RecordBatch:
        words = [w.decode("utf-8", "surrogatepass") for w in self.at]
        starts = np.concatenate(([0], np.cumsum([len(c) for c in self.columns])))
        return batch(_SHARD, [shard], [words], [word_ids(self.at, len(words))], [starts], [np.concatenate(self.columns)],
                     [np.concatenate(self.counts)], [self.rows])


def _encode_batches(batches: Batches) -> Batches:
    number, shard = TaskContext.get().partitionId() << 32, _Shard()
    for rows in batches:
        for doc_id, text, part in zip(*(rows.column(c) for c in ("doc_id", "text", "part")), strict=True):
            shard.add(doc_id.as_py(), text.as_py(), part.as_py())
            if shard.bytes >= SHARD_BYTES:
                yield shard.record(number)
                number, shard = number + 1, _Shard()
    if shard.rows:
        yield shard.record(number)


def matrix(docs: DataFrame, part: str = "lang") -> DataFrame:
    """CSR shards of the document-term matrix, one row each.

    ``rows`` are the documents; those of row i are columns[starts[i]:starts[i+1]] and counts[...]; column j is the word words[j],
    ids[j] in the dictionary. Write it down before it is read twice: shards are numbered by task.
    """
    picked = docs.select(F.col("doc_id").cast("bigint"), "text", F.col(part).cast("string").alias("part"))
    return map_batches(picked, _encode_batches, _SHARD_SQL)


def dictionary(shards: DataFrame) -> DataFrame:
    """(id, word, last): every id of the shards with the least and the last word that has it; nearly always they are one."""
    pairs = shards.select(F.explode(F.arrays_zip("ids", "words")).alias("p")).select("p.ids", "p.words")
    return pairs.groupBy(F.col("ids").alias("id")).agg(F.min("words").alias("word"), F.max("words").alias("last"))


def moved_ids(shards: DataFrame) -> dict[str, int]:
    """Words that share an id with a lesser word, and the ids that they get instead."""
    shared = dictionary(shards).filter("word != last").select("id")
    pairs = shards.select(F.explode(F.arrays_zip("ids", "words")).alias("p")).select(F.col("p.ids").alias("id"), F.col("p.words").alias("word"))
    first = shared.limit(MOST_MOVED + 1).collect()
    if not first:
        return {}
    words = pairs.join(F.broadcast(shared.limit(MOST_MOVED + 1)), "id").distinct().limit(MOST_MOVED + 1).collect()
    if len(first) > MOST_MOVED or len(words) > MOST_MOVED:
        raise RuntimeError("too many words share an id for a hash of 64 bits")
    least: dict[int, str] = {}
    for id_, word in words:
        least[id_] = min(word, least.get(id_, word))
    moved = [word for id_, word in words if word != least[id_]]
    return dict(zip(moved, word_ids((w.encode("utf-8", "surrogatepass") for w in moved), len(moved), 1).tolist(), strict=True))


@dataclass
class Csr:
    """One shard over the ids of the whole corpus' dictionary."""

    starts: np.ndarray
    ids: np.ndarray
    counts: np.ndarray

    def row_sums(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.counts, dtype=np.int64)))
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def nonzero(self) -> np.ndarray:
        return np.diff(self.starts)


def _csr(rows: pa.RecordBatch, i: int, moved: dict[str, int]) -> Csr:
    of_column = rows.column("ids")[i].values.to_numpy()
    if moved:
        of_column = np.array([moved.get(w, d) for w, d in zip(rows.column("words")[i].as_py(), of_column.tolist(), strict=True)], np.int64)
    columns = rows.column("columns")[i].values.to_numpy()
    return Csr(rows.column("starts")[i].values.to_numpy(), of_column[columns], rows.column("counts")[i].values.to_numpy())


def _flag_batches(batches: Batches, moved: dict[str, int]) -> Batches:
    for rows in batches:
        for i in range(rows.num_rows):
            csr = _csr(rows, i, moved)
            words, distinct = csr.row_sums(), csr.nonzero()
            documents = pa.RecordBatch.from_struct_array(rows.column("rows")[i].values)
            failed = (words < MIN_WORDS) * 1 | (100 * distinct < MIN_DISTINCT_PCT * words) * 2 | documents.column("flags").to_numpy()
            yield batch(_FLAGGED, *(documents.column(c) for c in ("doc_id", "part", "digest")), failed.astype(np.int32))


def flags(docs: DataFrame, part: str = "lang") -> DataFrame:
    """(doc_id, part, digest, flags) per row of ``docs``: which of filters A to D fail, as bits, and a digest of the text."""
    shards = stage(matrix(docs, part), "audit-shards", WIDE_ROWS)
    moved = moved_ids(shards)
    read = shards if moved else shards.select("ids", "starts", "columns", "counts", "rows")
    return map_batches(read, partial(_flag_batches, moved=moved), "doc_id bigint, part string, digest binary, flags int")


def _failed_sets(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, failed, n, good, toxic): documents by the set of filters that they fail, E included."""
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("labelled")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    # rows of one id and text first: copies without doc_id are one row from here on
    by_id = flagged.groupBy("doc_id", "digest", "part", "flags").agg(F.count("*").alias("c"))
    labelled = by_id.join(marked, F.col("doc_id") == F.col("labelled"), "left")
    good, toxic = (F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic"))
    known = F.col("doc_id").isNotNull()
    groups = labelled.groupBy("digest", "part", "flags", good, toxic).agg(
        F.sum("c").alias("n"), F.min(F.when(known, F.struct("doc_id", "c"))).alias("first"), F.sum(F.when(known, 0).otherwise(F.col("c"))).alias("unnamed")
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a text has a row for each part and label at most
    fresh = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.c")).otherwise(0)
    split = groups.withColumn("least", least).select(
        "part", "good", "toxic",
        F.explode(F.array(F.struct(F.col("flags").alias("failed"), fresh.alias("n")),
                          F.struct(F.col("flags").bitwiseOR(1 << 4).alias("failed"), (F.col("n") - fresh).alias("n")))).alias("s"),
    )
    n = F.col("s.n")
    return split.groupBy("part", F.col("s.failed").alias("failed")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


def _steps_sql() -> str:
    """A generator of the orders of the filters and their steps: the order, the step, its filter's bit and the bits before it."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        for step, f in enumerate(order):
            rows.append(f"('{name}', {step + 1}, {1 << f}, {sum(1 << g for g in order[:step])})")
    return f"inline(array({', '.join(rows)})) AS (filter_order, step, bit, before)"


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per part, order of the five filters and step, zeros included. A null text is empty and a null part the empty
    string. Copies (E) are rows whose text stands at a smaller doc_id; rows of one doc_id aren't copies of each other, and a
    row without doc_id neither is one nor makes one. A document with several labels is good or toxic if one says so. No
    documents, no rows; no labels, nothing good or toxic is lost. Other columns of ``docs`` are not read.
    """
    sets = _failed_sets(flags(docs, part), labels)
    orders = sets.select("*", F.expr(_steps_sql()))
    bit, before, failed = F.col("bit"), F.col("before"), F.col("failed")
    fails, early = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(before) != 0
    here = fails & ~early

    def total(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("bigint")

    # a document that fails k filters is removed by each of them in 120 / k of the orders
    share = F.when(fails, F.col("n") * 120 / F.bit_count("failed")).otherwise(0).cast("bigint")
    return orders.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~early).alias("kept"), total(here).alias("removed"), total(fails & early).alias("redundant"),
        total(failed == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
        F.sum(share).alias("shapley"),
    )
