"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

The mix is made of equal blocks of ``BLOCK`` words. Blocks are seats and sources are parties: a source gets the blocks of
the highest quotients ``target / (2k - 1)``, and shares them among its shards in the same way by their words. A shard is a
seeded ring of its documents; it gives its quota as a run of consecutive blocks from a seeded block on, whole rings first.
Every quantity of a document follows from its place on the ring, so no block is ever a row.

Shards hold about ``SHARD_WORDS`` words each, so a source that owns a third of the corpus has proportionally more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm.common import word_count

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
BLOCK = 8
SHARD_WORDS = 1 << 17
SEED = 17


def _draw(*parts: Column) -> Column:
    """A seeded number below 2**32, the same in every run."""
    texts = [F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(SEED)), *texts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with its number of words; a column of that name is replaced."""
    return docs.withColumn("size", word_count())


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_rank, source_size, target): one row per source, a null source ranked last.

    Weights repeat along the ranking and share ``TOTAL_SHARE`` of all words; no target exceeds ``MOST_REPEATS`` times its
    source, what is cut is shared again by weight. The final level per unit of weight is found in one pass: with sources
    ordered by the level at which each is full, it is the first level that does not fill the source it is computed at.
    The windows hold one row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = sources.withColumn("source_rank", rank)
    weight = F.element_at(F.lit(list(WEIGHTS)), ((F.col("source_rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    full = MOST_REPEATS * F.col("source_size")
    ranked = ranked.withColumns({"weight": weight, "cap": full, "full_at": full.cast("double") / weight})
    every, before = Window.partitionBy(), Window.orderBy("full_at", "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(TOTAL_SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    order = F.row_number().over(Window.orderBy("full_at", "source_rank"))
    leveled = ranked.withColumns({"level": level, "place": order})
    fits = F.col("level") <= F.col("full_at")
    final = F.min_by("level", F.when(fits, F.col("place"))).over(every)
    return leveled.withColumn("final", final).select(
        "source", "source_rank", "source_size",
        F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target"),
    )


def sainte_lague(parties: DataFrame, within: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` dealt to the highest quotients votes / (2k - 1), ties to the smaller party.

    Rounding votes times (seats - parties / 2) / total never gives a party too much, with + instead of - never too little,
    so only the quotients between the two bounds are ranked: about two rows per party, however many seats there are.
    Parties without votes get nothing. ``within`` names the columns of an election, ``seats`` is the same in all its rows.
    """
    election = Window.partitionBy(*within)
    total, half = F.sum(votes).over(election), F.count("*").over(election) / 2

    def rounded(n: Column) -> Column:
        exact = F.col(votes) * n / F.nullif(total, F.lit(0))
        return F.greatest(F.coalesce(F.floor(exact + 0.5), F.lit(0)).cast("bigint"), F.lit(0).cast("bigint"))

    bounds = parties.withColumns({"_low": rounded(F.col(seats) - half), "_high": rounded(F.col(seats) + half) + 1})
    bounds = bounds.withColumn("_left", F.col(seats) - F.sum("_low").over(election))
    seat = F.explode(F.sequence(F.col("_low") + 1, F.col("_high")))
    open_seats = bounds.filter(F.col(votes) > 0).select(*within, party, votes, "_left", seat.alias("_k"))
    quotient = F.col(votes).cast("double") / (2 * F.col("_k") - 1)
    place = F.row_number().over(election.orderBy(quotient.desc(), F.col(party), F.col("_k")))
    won = open_seats.withColumn("_place", place).filter(F.col("_place") <= F.col("_left"))
    extra = won.groupBy(*within, party).agg(F.count("*").alias("_extra"))
    quota = F.col("_low") + F.coalesce("_extra", F.lit(0))
    return bounds.join(extra, [*within, party], "left").withColumn("quota", quota).drop("_low", "_high", "_left", "_extra")


def shard_of(source_size: Column) -> Column:
    shards = F.greatest(F.ceil(source_size / SHARD_WORDS), F.lit(1))
    return (_draw(F.lit("shard"), F.col("doc_id")) % shards).cast("bigint")


def shard_quotas(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, shard, shard_size, quota) from rows (doc_id, source, size)."""
    aims = targets(sizes).withColumn("all_seats", F.floor(F.sum("target").over(Window.partitionBy()) / BLOCK + 0.5))
    dealt = sainte_lague(aims.withColumn("mix", F.lit(1)), ["mix"], "source_rank", "target", "all_seats")
    dealt = dealt.select(F.col("source").alias("of_source"), "source_rank", "source_size", "target", F.col("quota").alias("seats"))
    placed = sizes.join(dealt, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("shard", shard_of(F.col("source_size")))
    by_source = ["source_rank", "of_source", "source_size", "target", "seats"]
    shards = placed.groupBy(*by_source, "shard").agg(F.sum("size").alias("shard_size"))
    return sainte_lague(shards, ["source_rank"], "shard", "shard_size", "seats").select(
        "source_rank", "of_source", "source_size", "target", "shard", "shard_size", "quota"
    )


def take(docs: DataFrame, quotas: DataFrame) -> DataFrame:
    """``docs`` (with doc_id, source, size) and columns source_size, target and taken; other columns are carried along."""
    per_source = quotas.select("of_source", "source_rank", "source_size", "target").distinct()
    placed = docs.drop("source_size", "target", "taken").join(per_source, F.col("source").eqNullSafe(F.col("of_source")))
    placed = placed.drop("of_source").withColumn("_shard", shard_of(F.col("source_size")))
    rings = quotas.select(
        F.col("source_rank").alias("_rank"), F.col("shard").alias("_of_shard"), F.col("shard_size").alias("_ring"),
        F.least(F.col("quota") * BLOCK, F.col("shard_size") * MOST_REPEATS).alias("_take"),
        (F.coalesce(F.try_mod(_draw(F.lit("start"), F.col("source_rank"), F.col("shard")),
                              F.ceil(F.col("shard_size") / BLOCK)), F.lit(0)) * BLOCK).alias("_from"),
    )
    on_ring = placed.join(rings, (F.col("source_rank") == F.col("_rank")) & (F.col("_shard") == F.col("_of_shard")))
    order = Window.partitionBy("source_rank", "_shard").orderBy("_draw", "doc_id", "size")
    start = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    on_ring = on_ring.withColumn("_draw", _draw(F.lit("order"), F.col("doc_id"))).withColumn("_start", start)
    rounds = F.when(F.col("_ring") > 0, F.floor(F.col("_take") / F.col("_ring"))).otherwise(0)
    rest = F.col("_take") - rounds * F.col("_ring")

    def overlap(shift: Column) -> Column:
        begin, end = F.col("_from") - shift, F.col("_from") - shift + rest
        met = F.least(F.col("_start") + F.col("size"), end) - F.greatest(F.col("_start"), begin)
        return F.greatest(met, F.lit(0).cast("bigint"))

    taken = (rounds * F.col("size") + overlap(F.lit(0)) + overlap(F.col("_ring"))).cast("bigint")
    return on_ring.withColumn("taken", taken).drop(
        "source_rank", "_shard", "_rank", "_of_shard", "_ring", "_take", "_from", "_draw", "_start"
    )


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each document, repeats counted.

    One row per row of ``docs`` (columns doc_id, text, source; others are not read). A null or blank text has size 0 and
    gives nothing; documents without source form a source of their own, ranked last; repeated rows are documents of their
    own; ties of the seeded order fall to the smaller doc_id, then the smaller size. Every run on the same rows agrees. A
    source misses its target by at most half a block for each of its shards; no rows in, no rows out.
    """
    sizes = stage(sized(docs.select(F.col("doc_id").cast("bigint"), "source", "text")).drop("text"), "mix-sizes")
    quotas = stage(shard_quotas(sizes), "mix-quotas")
    return take(sizes, quotas).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes its words, to the nearest whole time.

    Whole documents only: at most two documents of a shard are cut by a run's ends, and those count if at least half of
    their words are taken. Columns are those of ``docs``.
    """
    sizes = stage(sized(docs).select(F.col("doc_id").cast("bigint"), "source", "size"), "mix-sizes")
    quotas = stage(shard_quotas(sizes), "mix-quotas")
    row = docs.select(F.struct("*").alias("row"), "doc_id", "source", word_count().alias("size"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    repeated = take(row, quotas).filter(copies > 0).withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies)))
    return repeated.select("row.*")
