"""Small helpers shared by the text operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word: a run of characters other than ASCII blanks. ``bytes.split()`` splits at exactly these blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SHINGLE_SEED = 42

Batches = Iterator[pa.RecordBatch]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text; a null text counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="marginlens-code-"), "marginlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """``mapInArrow``: batches hold at most spark.sql.execution.arrow.maxBytesPerBatch bytes, so memory is bounded."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Has the session hand texts to Python in batches of BATCH_BYTES at most, unless a smaller bound is set.

    A batch is held several times, on both sides of the pipe and by every task of an executor; jobs that carry whole rows through
    Python and share executors with large sorts have no memory for Spark's default of 64 MB.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    bytes_now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
    if not 0 < bytes_now <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def word_count(text: str = "text") -> Column:
    """Number of words of a text as BIGINT, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def crc_bucket(key: str, buckets: int) -> Column:
    """crc32 of the decimal text of ``key`` modulo ``buckets``; null for a null key."""
    return (F.crc32(F.col(key).cast("string").cast("binary")) % buckets).cast("int")


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every shingle of so many words, repeats included, A-Z lowered; fewer words are one shingle, none are none."""
    tokens = text.lower().split()  # bytes: lowers A-Z only and splits at ASCII blanks only
    if not tokens:
        return np.empty(0, "<u8")
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(tokens))
    spans = zip(starts[: len(tokens) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SHINGLE_SEED) for s, e in spans], "<u8")
