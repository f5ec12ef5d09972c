"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Lines without a word are passed over; the others form the sequence of a document. Two windows belong to every line: the
shortest run of lines from it on, and the shortest run up to it, that holds ``MIN_WORDS`` words or more. A run of that many
words which repeats anywhere consists of such windows: of any of its lines, either the window from the run's first line on or
the window that ends at the line lies within the run.

The smallest line hash of a window is its fingerprint. Equal windows have equal fingerprints at equal places, so a window
whose fingerprint stands at one place in the corpus only cannot repeat, and most text ends there. Around each fingerprint
that several places share, the match is extended both ways to the whole windows, and windows of equal lines are one passage.
Its first place, by doc_id and line, stays; every later place goes, and the windows that go are merged into runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginlens.functions.staged import stage
from marginlens.llm.common import WORD

MIN_WORDS = 50


def _line(line: Column) -> Column:
    """Hash and words of a line. Two hashes, 96 bits, tell lines apart."""
    words = F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)))
    return F.struct(F.xxhash64(line).alias("h"), F.hash(line).alias("g"), words.alias("words"))


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, pos, h, g, words, before, after): the lines with a word, one document per doc_id and text.

    ``before`` and ``after`` count the words of the lines before and after it.
    """
    rows = docs.filter("text IS NOT NULL").select(
        F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("text_hash"), F.transform(F.split("text", "\n"), _line).alias("all")
    )
    once = rows.groupBy("doc_id", "text_hash").agg(F.first("all").alias("all"))
    single = once.select("doc_id", "text_hash", F.posexplode("all").alias("pos", "line")).filter("line.words > 0")
    document = Window.partitionBy("doc_id", "text_hash")
    before = F.sum("line.words").over(document.orderBy("pos")) - F.col("line.words")
    total = F.sum("line.words").over(document)
    flat = single.withColumns({"before": before, "total": total})
    return flat.select("doc_id", "text_hash", "pos", "line.h", "line.g", "line.words", "before",
                       (F.col("total") - F.col("before") - F.col("line.words")).alias("after"))


def windows(sequence: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, first, last, place, h, content): both windows of every line, where long enough.

    ``place`` is where the fingerprint ``h`` stands, ``content`` tells windows of different lines apart. ``before`` rises
    from line to line, so a range of it is a run of lines.
    """
    document = Window.partitionBy("doc_id", "text_hash")
    onward = document.orderBy("before").rangeBetween(0, min_words - 1)
    back = document.orderBy("after").rangeBetween(0, min_words - 1)
    line = F.struct("h", "pos")
    both = sequence.withColumns({
        "f_min": F.min(line).over(onward), "f_all": F.collect_list(F.struct("h", "g")).over(onward),
        "f_words": F.sum("words").over(onward), "f_last": F.max("pos").over(onward),
        "b_min": F.min(line).over(back), "b_all": F.collect_list(F.struct("h", "g")).over(back),
        "b_words": F.sum("words").over(back), "b_first": F.min("pos").over(back),
    })

    def window(words: str, first: str, last: str, smallest: str, content: Column) -> Column:
        made = F.struct(F.col(first).alias("first"), F.col(last).alias("last"), F.col(f"{smallest}.pos").alias("place"),
                        F.col(f"{smallest}.h").alias("h"), F.struct(F.xxhash64(content), F.hash(content)).alias("content"))
        return F.when(F.col(words) >= min_words, made)

    # the backward frame runs from the line to earlier ones: reversed, so that equal windows of either kind are equal
    made = F.array(window("f_words", "pos", "f_last", "f_min", F.col("f_all")),
                   window("b_words", "b_first", "pos", "b_min", F.reverse("b_all")))
    each = both.select("doc_id", "text_hash", F.explode(F.array_distinct(F.array_compact(made))).alias("w"))
    return each.select("doc_id", "text_hash", "w.*")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_hash, runs): for documents with later repeats, their disjoint runs (first, last) in order."""
    found = stage(windows(lines(docs), min_words), "line-windows")
    spot = F.struct("doc_id", "text_hash", "place")
    shared = found.groupBy("h").agg(F.min(spot).alias("least"), F.max(spot).alias("most")).filter("least != most").select("h")
    candidates = found.join(shared, "h", "left_semi")
    here = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "first")
    origins = candidates.groupBy("content").agg(F.min(here).alias("origin"), F.max(here).alias("end"))
    origins = origins.filter("origin != end").select(F.col("content").alias("same"), "origin")
    later = candidates.join(origins, F.col("content") == F.col("same")).filter(here != F.col("origin"))
    in_order = Window.partitionBy("doc_id", "text_hash").orderBy("first", "last")
    reach = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.coalesce(F.col("first") > reach + 1, F.lit(True)), 1).otherwise(0)
    islands = later.select("doc_id", "text_hash", "first", "last").withColumn("opens", opens)
    islands = islands.withColumn("run", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("doc_id", "text_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _without(text: Column, runs: Column) -> Column:
    """The text less the lines of ``runs``: the slices between the runs, joined."""
    split, n = F.split(text, "\n"), F.size(runs)
    starts = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["last"] + 1))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(split)))
    kept = F.zip_with(starts, ends, lambda s, e: F.slice(split, s + 1, e - s))
    return F.when(n > 0, F.array_join(F.flatten(kept), "\n")).otherwise(text)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with its later repeated runs of lines removed from ``text``, and columns n_lines and n_removed (BIGINT).

    One row per row; other columns stay (columns named n_lines or n_removed are replaced). A null text stays null with no
    lines, an empty text has one line; a document all of whose lines repeat is left with an empty text. A run that repeats
    within one document goes from its second place on; the second place may overlap the first, and then lines of the first go,
    too: of lines H A B A B ... with 50 words in any run of five, what begins at the first A stands again at the second, and
    H A B and what is left at the end stay. Every distinct line stays once at least. Lines without a word neither make nor break a run; they go with a
    run that spans them. Rows with equal doc_id and text count as one document and are treated alike; among documents of
    one doc_id the text hash decides which is first, documents without id come last. No rows in, no rows out.
    """
    runs = repeated_runs(docs, min_words).select(
        F.col("doc_id").alias("_doc_id"), F.col("text_hash").alias("_text_hash"), F.col("runs").alias("_runs")
    )
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("text") == F.col("_text_hash"))
    joined = docs.drop("n_lines", "n_removed").join(runs, same, "left")
    cut = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint"),
        "n_removed": F.coalesce(cut, F.lit(0)).cast("bigint"),
        "text": F.when(F.col("_runs").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("_runs"))),
    }).drop("_doc_id", "_text_hash", "_runs")
