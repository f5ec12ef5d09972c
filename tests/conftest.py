from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("marginlens-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("tables")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """Lazy model over the smallest driver tables."""
    from marginlens.plans.model import OrderModel

    return OrderModel(spark, f"{TESTDATA}/sf0.001")


@pytest.fixture(scope="session")
def file_model(spark, tmp_path_factory):
    """Model over a clean set of delimited source files with windows 2020 and 2021."""
    from marginlens.plans.model import FileModel
    from marginlens.sources.delimited import staging
    from tests.fixtures import pvm_params
    from tests.source_files import write_source_files

    folder = write_source_files(tmp_path_factory.mktemp("raw"))
    return FileModel(spark, staging(spark, folder), pvm_params())
