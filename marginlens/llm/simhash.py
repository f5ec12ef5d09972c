"""SimHash near-dedup over a segment-popcount grid.

A 64-bit fingerprint is embedded as the bit counts of its sixteen 4-bit segments. Flipping one bit changes one count by one,
so the Manhattan distance of two embeddings never exceeds the number of differing bits: fingerprints within two bits lie
within distance two. Every embedding registers in its own grid cell and in the cells one step along an axis; two embeddings
meet in a common cell exactly if their distance is two or less. What meets is verified by counting the differing bits.

Cells are sorted and streamed, so a cell never has to fit in memory. The members of a cell that holds more than ``CROWDED``
fingerprints are not paired: they are linked through shared one-bit neighbours, which is just as exact (two fingerprints
within two bits have a common neighbour within one bit of both, and any two that share one are within two bits) and takes 65
rows a fingerprint instead of a square of the cell.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm import resemblance
from marginlens.llm.common import Batches, batch, map_batches, shingle_hashes, text_bytes
from marginlens.llm.components import components

BITS = 64
MAX_BITS = 2  # the grid's step of one on either side
SEGMENT_BITS = 4
CROWDED = 64
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 15

_PRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
_BANDED = pa.schema([*_PRINTS, ("text_key", pa.int64()), ("bands", pa.list_(pa.int64()))])
_KEYED = pa.schema([*_PRINTS, ("text_key", pa.int64())])
_CELLS = pa.schema([("cell", pa.int64()), ("fp", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, words: int) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 for a text without words."""
    return _majority(shingle_hashes(text, words))


def _print_batches(batches: Batches, words: int) -> Batches:
    for rows in batches:
        prints = [fingerprint(t.as_py(), words) for t in rows.column("text")]
        yield batch(_PRINTS, rows.column("doc_id"), prints)


def _banded_batches(batches: Batches, words: int) -> Batches:
    for rows in batches:
        prints, bands = [], []
        for text in rows.column("text"):
            hashes = shingle_hashes(text.as_py(), words)
            prints.append(_majority(hashes))
            bands.append(resemblance.bands(hashes))
        yield batch(_BANDED, rows.column("doc_id"), prints, rows.column("text_key"), bands)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): one row per document, the fingerprint as a signed BIGINT."""
    rows = docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("text"))
    return map_batches(rows, partial(_print_batches, words=words), "doc_id bigint, fp bigint")


def banded_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, fp, text_key, bands): fingerprints with what ``resemblance.links`` takes, from one pass over the texts."""
    rows = docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("text"), F.xxhash64("text").alias("text_key"))
    schema = "doc_id bigint, fp bigint, text_key bigint, bands array<bigint>"
    return map_batches(rows, partial(_banded_batches, words=words), schema)


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """The bit counts of all 4-bit segments, packed into the nibbles of one integer."""
    pairs = prints - ((prints >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return (pairs & np.uint64(0x3333333333333333)) + ((pairs >> np.uint64(2)) & np.uint64(0x3333333333333333))


def _cell_batches(batches: Batches) -> Batches:
    for rows in batches:
        signed = rows.column("fp").to_numpy()
        counts = segment_counts(signed.view(np.uint64))
        cells, owners = [counts], [signed]
        for shift in range(0, BITS, SEGMENT_BITS):
            step, value = np.uint64(1 << shift), (counts >> np.uint64(shift)) & np.uint64(15)
            for moved, inside in ((counts + step, value < SEGMENT_BITS), (counts - step, value > 0)):
                cells.append(moved[inside])
                owners.append(signed[inside])
        yield batch(_CELLS, np.concatenate(cells).view(np.int64), np.concatenate(owners))


def _runs(batches: Batches, key: str) -> Batches:
    """Regroups sorted batches so that a run of equal keys is cut only after more than ``CROWDED`` rows of it."""
    held: pa.RecordBatch | None = None
    for rows in batches:
        if rows.num_rows == 0:
            continue
        rows = rows if held is None else pa.concat_batches([held, rows])
        keys = rows.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        if len(keys) - last > CROWDED:
            yield rows
            # the run may go on: its last rows stay so that what follows is seen as crowded too
            held = rows.slice(len(keys) - CROWDED - 1)
        else:
            if last:
                yield rows.slice(0, last)
            held = rows.slice(last)
    if held is not None:
        yield held


def _verify_batches(batches: Batches) -> Batches:
    """Verified links (a, b) of each cell; a member of a crowded cell comes as (fp, null) instead."""
    for rows in _runs(batches, "cell"):
        cells, prints = rows.column("cell").to_numpy(), rows.column("fp").to_numpy()
        _, group, sizes = np.unique(cells, return_inverse=True, return_counts=True)
        crowded = sizes[group] > CROWDED
        hot = np.unique(prints[crowded])
        yield batch(_LINKS, hot, pa.nulls(len(hot), pa.int64()))
        cells, prints = cells[~crowded], prints[~crowded]
        for gap in range(1, CROWDED):
            same = np.flatnonzero(cells[gap:] == cells[:-gap])
            if not len(same):
                break
            a, b = prints[same], prints[same + gap]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= MAX_BITS
            yield batch(_LINKS, a[near], b[near])


def _neighbour_batches(batches: Batches) -> Batches:
    for rows in batches:
        prints = rows.column("fp").to_numpy()
        masks = np.concatenate(([np.uint64(0)], np.uint64(1) << np.arange(BITS, dtype=np.uint64))).view(np.int64)
        yield batch(_CELLS, (prints[:, None] ^ masks).ravel(), np.repeat(prints, len(masks)))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that are within two bits."""
    grid = map_batches(prints.select("fp"), _cell_batches, "cell bigint, fp bigint")
    met = map_batches(grid.repartition("cell").sortWithinPartitions("cell"), _verify_batches, "a bigint, b bigint")
    met = stage(met, "simhash-met")
    hot = met.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    shared = map_batches(hot, _neighbour_batches, "cell bigint, fp bigint")
    hubs = shared.groupBy("cell").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a != most")
    via_hub = shared.join(hubs, "cell").select("a", F.col("fp").alias("b"))
    return met.filter(F.col("b").isNotNull()).unionByName(via_hub)


def near_duplicates(docs: DataFrame, words: int = 3, similarity: float | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs`` (columns doc_id, text; others are not read).

    Documents whose fingerprints differ in at most two bits are linked; component_id is the smallest doc_id reachable. With
    a ``similarity``, so are documents whose shingle sets have that Jaccard similarity: two bits do not reach far enough.
    A null, empty or blank text has fingerprint zero and is linked like any other; repeated rows come out as often as they
    go in; a null doc_id never names a component unless the component holds no other id. No rows in, no rows out.
    """
    marked = stage(fingerprints(docs, words) if similarity is None else banded_fingerprints(docs, words), "simhash-prints")
    by_print = _by_print(docs, marked, words, similarity)
    joined = marked.select("doc_id", "fp").join(by_print, F.col("fp") == F.col("of_fp"))
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _by_print(docs: DataFrame, marked: DataFrame, words: int, similarity: float | None) -> DataFrame:
    """(of_fp, root, component_id): the component of every fingerprint; roots also tell components of one name apart."""
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    found = links(prints)
    if similarity is not None:
        found = found.unionByName(resemblance.links(docs, marked, words, similarity))
    roots = stage(components(found), "simhash-roots")
    rooted = prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(named, "root").select(F.col("fp").alias("of_fp"), "root", "component_id")


def _keyed_batches(batches: Batches, words: int) -> Batches:
    for rows in batches:
        prints = [fingerprint(t.as_py(), words) for t in rows.column("text")]
        yield batch(_KEYED, rows.column("doc_id"), prints, rows.column("text_key"))


def _keyed_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint"), text_bytes().alias("text"), F.xxhash64("text").alias("text_key"))
    return map_batches(rows, partial(_keyed_batches, words=words), "doc_id bigint, fp bigint, text_key bigint")


def first_of_each(docs: DataFrame, words: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest doc_id, and one without doc_id.

    Unlike texts of one doc_id are documents of their own. Among rows of one component and doc_id, the smallest hash of the
    text decides, and repeated rows stay once. Columns are those of ``docs``.

    Decisions are made on (doc_id, hash of the text) alone. What goes is written down, so where it is small by its measured
    size the texts are filtered where they lie, and they are shuffled once where it is not; repeated rows are taken apart.
    """
    marked = stage(_keyed_fingerprints(docs, words) if similarity is None else banded_fingerprints(docs, words), "simhash-prints")
    by_print = _by_print(docs, marked, words, similarity)
    rows = marked.groupBy("doc_id", "fp", "text_key").agg(F.count("*").alias("n"))
    joined = rows.join(by_print, F.col("fp") == F.col("of_fp"))
    named = joined.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    first = named.groupBy(F.col("root").alias("of_root"), F.col("doc_id").alias("of_id")).agg(F.min("text_key").alias("first_key"))
    same = (F.col("root") == F.col("of_root")) & F.col("doc_id").eqNullSafe(F.col("of_id"))
    stays = F.coalesce(F.col("first_key") == F.col("text_key"), F.lit(False)).alias("stays")
    decided = joined.join(first, same, "left").select("doc_id", "text_key", "n", stays)
    changed = stage(decided.filter(~F.col("stays") | (F.col("n") > 1)), "simhash-decisions")

    def of(row: DataFrame, decision: DataFrame) -> Column:
        return row["doc_id"].cast("bigint").eqNullSafe(decision["doc_id"]) & (F.xxhash64(row["text"]) == decision["text_key"])

    once = docs.join(changed, of(docs, changed), "left_anti")
    repeated = changed.filter("stays").select("doc_id", "text_key")
    copies = docs.join(repeated, of(docs, repeated), "left_semi")
    return once.unionByName(copies.dropDuplicates(["doc_id", "text"]))
