"""Links between texts whose sets of word shingles have a Jaccard similarity of a given size or more.

A text's shingle hashes give ``BANDS * ROWS`` minima under different orders; ``ROWS`` minima make one band, and texts meet
where a band is equal. A pair at similarity 0.8 shares one of the 20 bands with a probability of 0.9996. Of every pair that
meets, one byte of each minimum is compared first: as many agree as the similarity says, within a few per cent, and a pair
five standard deviations below goes. (That loses a pair at 0.8 with a probability below 0.00001.) Every pair that is left is
verified on its whole shingle sets, which are much wider.

Equal texts are one text here. A band shared by up to ``CROWDED`` texts pairs them all. In a band shared by more, every text
meets a leader first, the text that shares the most crowded bands: of copies of one text, that is the text itself or one close
to it. Texts that do not resemble the leader meet some more. This only connects most of what is alike at little cost. Then all
texts of a band that are not connected with each other yet are compared, in blocks of two chunks of the band, whether they
have found a leader or not; so no pair that meets anywhere is left out, unless other links connect it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm.common import Batches, batch, map_batches, shingle_hashes, text_bytes
from marginlens.llm.components import components

BANDS, ROWS = 20, 5
CROWDED = 32
#: Leaders that a text of a crowded band meets before the rest is compared, in rounds; texts of a band that make a chunk.
LEADERS, CHUNK = (1, 4), 2048
#: Shingles taken through all orders at a time.
BLOCK = 1 << 12

_ORDERS = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_SETS = pa.schema([("text_key", pa.int64()), ("sketch", pa.binary()), ("shingles", pa.binary())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _minima(hashes: np.ndarray) -> np.ndarray:
    flips, factors = _ORDERS[0], _ORDERS[1] | np.uint64(1)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), BLOCK):
        least = np.minimum(least, ((hashes[at : at + BLOCK] ^ flips) * factors).min(axis=1))
    return least


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key per band; none for a text without words."""
    if not len(hashes):
        return []
    rows = _minima(hashes).reshape(BANDS, ROWS)
    keys = np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64)
    return keys.view(np.int64).tolist()


def _set_batches(batches: Batches, words: int) -> Batches:
    for rows in batches:
        hashes = [np.unique(shingle_hashes(text.as_py(), words)) for text in rows.column("text")]
        sketches = [_minima(h).astype(np.uint8).tobytes() for h in hashes]
        yield batch(_SETS, rows.column("text_key"), sketches, [h.tobytes() for h in hashes])


def _least(similarity: float) -> float:
    """Minima of a sketch that agree at least, in a pair worth a whole comparison."""
    most = BANDS * ROWS
    return most * similarity - 5 * math.sqrt(most * similarity * (1 - similarity))


def _sketches(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def _likely_batches(batches: Batches, similarity: float) -> Batches:
    for rows in batches:
        alike = (_sketches(rows.column("a_sketch")) == _sketches(rows.column("b_sketch"))).sum(axis=1) >= _least(similarity)
        yield batch(_PAIRS, rows.column("a"), rows.column("b")).filter(pa.array(alike))


def _block_likely(least: float) -> Callable[[pa.Table], pa.Table]:
    """The likely pairs of two chunks (or of one with itself) whose texts have different roots."""

    def compare(block: pa.Table) -> pa.Table:
        keys, roots, chunk = (block.column(c).to_numpy() for c in ("text_key", "root", "chunk"))
        sketches = _sketches(block.column("sketch"))
        one, other = np.flatnonzero(chunk == chunk.min()), np.flatnonzero(chunk == chunk.max())
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for place, at in enumerate(one):
            rest = other[place + 1 :] if chunk.min() == chunk.max() else other
            rest = rest[roots[rest] != roots[at]]
            if len(rest):
                near = keys[rest[(sketches[rest] == sketches[at]).sum(axis=1) >= least]]
                a.append(np.minimum(near, keys[at]))
                b.append(np.maximum(near, keys[at]))
        return pa.table([np.concatenate(a), np.concatenate(b)], schema=_PAIRS)

    return compare


def _similar_batches(batches: Batches, similarity: float) -> Batches:
    for rows in batches:
        alike = []
        for a, b in zip(rows.column("a_shingles"), rows.column("b_shingles"), strict=True):
            one, other = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            common = len(np.intersect1d(one, other, assume_unique=True))
            alike.append(common >= similarity * (len(one) + len(other) - common))
        yield batch(_PAIRS, rows.column("a"), rows.column("b")).filter(pa.array(alike, pa.bool_()))


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    first = sets.select(F.col("text_key").alias("a"), F.col(column).alias(f"a_{column}"))
    second = sets.select(F.col("text_key").alias("b"), F.col(column).alias(f"b_{column}"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", f"a_{column}", f"b_{column}")


def _verified(likely: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``likely``, a table, whose whole shingle sets are as similar as asked for."""
    verify = partial(_similar_batches, similarity=similarity)
    return stage(map_batches(_with_both(likely, sets, "shingles"), verify, "a bigint, b bigint"), "resemblance-links")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``pairs`` that are as similar as asked for."""
    pairs = stage(pairs, "resemblance-pairs")  # a text with very many partners is split when joined from a table
    likely = map_batches(_with_both(pairs, sets, "sketch"), partial(_likely_batches, similarity=similarity), "a bigint, b bigint")
    return _verified(stage(likely, "resemblance-likely"), sets, similarity)


def _shared(cells: DataFrame) -> DataFrame:
    """(cell, text_key, n) of the cells that n texts share, two or more."""
    sizes = stage(cells.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 1"), "resemblance-sizes")
    return stage(cells.select("cell", "text_key").join(sizes, "cell"), "resemblance-cells")


def _paired(cells: DataFrame) -> DataFrame:
    few = cells.filter(F.col("n") <= CROWDED)
    partner = few.select("cell", F.col("text_key").alias("b"))
    return few.join(partner, "cell").filter("text_key < b").select(F.col("text_key").alias("a"), "b").distinct()


def _led(crowded: DataFrame, leaders: int) -> DataFrame:
    """(cell, text_key, lead): every text of a cell with each of its leaders; a leader comes with itself, too."""
    central = stage(crowded.groupBy("text_key").agg(F.count("*").alias("central")), "resemblance-central")
    ranked = crowded.join(central, "text_key").withColumn("part", F.pmod(F.xxhash64("text_key"), F.lit(leaders)))
    first = ranked.groupBy("cell", "part").agg(F.max(F.struct("central", "text_key"))["text_key"].alias("lead"))
    return crowded.select("cell", "text_key").join(stage(first.select("cell", "lead"), "resemblance-leads"), "cell")


def _unconnected(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, a_root, b_root): the pairs that the links ``found`` do not connect yet; of a large group of copies, hardly any."""
    roots = stage(components(found), "resemblance-roots")
    ends = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("a_root")), "a", "left")
    ends = ends.join(roots.select(F.col("node").alias("b"), F.col("root").alias("b_root")), "b", "left")
    ends = ends.select("a", "b", F.coalesce("a_root", "a").alias("a_root"), F.coalesce("b_root", "b").alias("b_root"))
    return ends.filter("a_root != b_root")


def _blocks(crowded: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the likely pairs of every crowded cell that ``found`` does not connect; cells all connected cost nothing."""
    roots = stage(components(found), "resemblance-roots")
    rooted = crowded.join(roots, F.col("text_key") == F.col("node"), "left")
    rooted = stage(rooted.select("cell", "text_key", "n", F.coalesce("root", "text_key").alias("root")), "resemblance-rooted")
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = rooted.join(mixed.select("cell"), "cell", "left_semi").withColumns({
        "chunk": F.pmod(F.xxhash64("text_key"), chunks).cast("int"), "other": F.explode(F.sequence(F.lit(0), chunks - 1))})
    dealt = dealt.select("cell", "text_key", "root", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    block = dealt.join(sets.select("text_key", "sketch"), "text_key").groupBy("cell", "low", "high")
    likely = block.applyInArrow(_block_likely(_least(similarity)), "a bigint, b bigint")
    return stage(stage(likely, "resemblance-blocks").distinct(), "resemblance-likely")


def _connected(likely: DataFrame, sets: DataFrame, similarity: float, found: DataFrame) -> DataFrame:
    """``found`` with links that connect whatever the similar pairs of ``likely`` connect.

    Of two components, one pair is verified first, then up to 16, 256 and so on, until all are verified or connected.
    """
    share = 1
    while True:
        left = stage(_unconnected(likely, found), "resemblance-left")
        if left.isEmpty():
            return found
        part = F.pmod(F.xxhash64("a", "b"), F.lit(share))
        picked = left.groupBy(F.least("a_root", "b_root"), F.greatest("a_root", "b_root"), part).agg(F.min(F.struct("a", "b")).alias("pair"))
        picked = stage(picked.select("pair.a", "pair.b"), "resemblance-picked")
        found = found.unionByName(_verified(picked, sets, similarity))
        likely, share = left.select("a", "b").join(picked, ["a", "b"], "left_anti"), 16 * share


def _started(crowded: DataFrame, pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of crowded cells' texts with leaders, then those among ``pairs`` that connect more."""
    found, rest = None, crowded
    for leaders in LEADERS:
        led = stage(_led(rest, leaders), "resemblance-led")
        ordered = led.filter("text_key != lead").select(F.least("text_key", "lead").alias("a"), F.greatest("text_key", "lead").alias("b"))
        alike = _similar(ordered.distinct(), sets, similarity)
        found = alike if found is None else found.unionByName(alike)
        either = alike.unionByName(alike.select(F.col("b").alias("a"), F.col("a").alias("b")))
        followers = led.join(either, (F.col("text_key") == F.col("a")) & (F.col("lead") == F.col("b"))).select("cell", "text_key")
        settled = followers.unionByName(led.filter("text_key = lead").select("cell", "text_key")).distinct()
        rest = _shared(rest.join(settled, ["cell", "text_key"], "left_anti")).filter(F.col("n") > CROWDED)
        if rest.isEmpty():
            break
    return found.unionByName(_similar(_unconnected(pairs, found).select("a", "b"), sets, similarity))


def links(docs: DataFrame, marked: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): links between fingerprints of texts at least as similar as asked for, enough to connect all that were found.

    ``marked`` has text_key (xxhash64 of the text), fp and bands of every row of ``docs``. A null or blank text has no
    shingles and no links; a text of fewer words than a shingle is one shingle. Texts of one fingerprint are one, as the
    caller links them. No rows in, no rows out.
    """
    # one text of each fingerprint in each band
    single = marked.select(F.explode("bands").alias("cell"), "fp", "text_key").groupBy("cell", "fp").agg(
        F.min("text_key").alias("text_key")
    )
    cells = _shared(stage(single, "resemblance-bands"))
    texts = docs.select(F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    chosen = texts.join(cells.select("text_key").distinct(), "text_key", "left_semi")
    schema = "text_key bigint, sketch binary, shingles binary"
    sets = stage(map_batches(chosen.dropDuplicates(["text_key"]), partial(_set_batches, words=words), schema), "resemblance-sets")

    pairs, crowded = _paired(cells), cells.filter(F.col("n") > CROWDED)
    if crowded.isEmpty():
        found = _similar(pairs, sets, similarity)
    else:
        started = _started(crowded, pairs, sets, similarity)
        found = _connected(_blocks(crowded, sets, started, similarity), sets, similarity, started)
    fp_of = stage(marked.groupBy("text_key").agg(F.min("fp").alias("fp")), "resemblance-fp")
    named = found.join(fp_of.select(F.col("text_key").alias("a"), F.col("fp").alias("a_fp")), "a")
    named = named.join(fp_of.select(F.col("text_key").alias("b"), F.col("fp").alias("b_fp")), "b")
    return named.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).filter("a != b").distinct()
