"""Intermediate tables written to the cluster's shared checkpoint folder.

A frame that is read by two parts of one plan (a total and the rows it divides, say) is written once as Parquet and read
back, so the expensive lineage below it runs once, column pruning still works for each reader, Catalyst plans later joins
from real file sizes, and a lost executor costs no recomputation of the source.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder: ``spark.checkpoint.dir``, else the one set on the context.

    A scratch folder of our own is used only in local mode and only where neither is set.
    """
    context = spark.sparkContext
    configured = spark.conf.get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="marginlens-")
    return _local_dirs[context.applicationId]


#: Without it, shuffle files stay until the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Every query that runs inside deletes its shuffle files when it ends, so the disk holds those of one step and not of all."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


#: For rows of several MB. Parquet looks at the size of what it holds after 100 rows at the earliest, and a scan decodes up to 4096
#: rows of a row group at once; with these options a row group is closed after the row that fills it, for writer and reader alike.
WIDE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def stage(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` under the shared folder, with ``options`` of the writer, and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marginlens/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
