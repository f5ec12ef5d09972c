"""Queries over the stored model: a warehouse is built from the source once per application and opened again from its manifest."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.functions.staged import shared_dir
from marginlens.plans.model import OrderModel
from marginlens.sources import exports

_built: dict[tuple[str, str], str] = {}


def stored_copy(m: OrderModel):
    """The stored model of the same source, opened from its manifest."""
    from marginlens.plans.warehouse import Warehouse  # the warehouse itself looks queries up in the catalog

    application = m.spark.sparkContext.applicationId
    if (application, m.source.base) not in _built:
        path = f"{shared_dir(m.spark)}/marginlens/{application}/warehouse-{uuid.uuid4().hex}"
        Warehouse.build(m, path)
        _built[application, m.source.base] = path
    return Warehouse(m.spark, _built[application, m.source.base], m.params)


def over_stored(m: OrderModel, name: str) -> DataFrame:
    """Query ``name`` over the stored model of the same source."""
    return stored_copy(m).query(name)


def every_result(m: OrderModel) -> DataFrame:
    """(result, field, number, text): every field of every row of the JSON results, written from the stored model and read back."""
    from marginlens.plans.warehouse import REPORTS

    folder = f"{shared_dir(m.spark)}/marginlens/{m.spark.sparkContext.applicationId}/results-{uuid.uuid4().hex}"
    stored_copy(m).write_results(folder)

    def fields(name: str) -> DataFrame:
        rows = exports.read_results(m.spark, folder, name)
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in rows.columns])
        number = F.col("value").try_cast("double")
        text = F.when(number.isNull(), F.col("value"))
        return rows.select(F.inline(pairs)).select(F.lit(name).alias("result"), "field", number.alias("number"), text.alias("text"))

    return reduce(DataFrame.unionByName, map(fields, REPORTS))
