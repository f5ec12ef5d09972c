"""Scans of headerless pipe-delimited files into staging frames.

A line is checked as a whole before any of its fields is used: the number of fields, and every typed field. The check is part
of what makes a row, so neither a count nor a query of one column can leave it out, however few columns Spark reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marginlens.sources.schemas import FILES, layout

SEPARATOR = "|"
#: So much of a rejected line is quoted in an error.
QUOTED = 200


def _schema(schema: StructType | str) -> StructType:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the lines of the files that hold anything."""
    read = spark.read.text(path).filter(F.length("value") > 0)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def _texts() -> Column:
    """The fields of a line; an empty one is NULL."""
    return F.transform(F.split("line", rf"\{SEPARATOR}", -1), lambda text: F.nullif(text, F.lit("")))


def _once(value: Column, result: Callable[[Column], Column]) -> Column:
    """``result`` of a value that is computed once per row, however often ``result`` names it.

    Projections and filters that are merged would compute it again for each of its uses.
    """
    return F.get(F.transform(F.array(value), result), F.lit(0))


def _read(texts: Column, schema: StructType) -> Column:
    """The texts of a line and its typed fields, each NULL if it is empty or does not fit its type."""
    typed = [F.get(texts, F.lit(at)).try_cast(f.dataType).alias(f.name) for at, f in enumerate(schema)]
    return F.struct(texts.alias("texts"), F.struct(*typed).alias("typed"))


def _reject_reason(read: Column, schema: StructType) -> Column:
    """Why a line does not fit, or NULL: the number of its fields, else the first typed field that cannot be read."""
    texts, typed = read["texts"], read["typed"]
    found = F.size(texts)
    counted = F.concat(found.cast("string"), F.lit(f" fields instead of {len(schema)}"))
    reason = F.when(found != len(schema), counted)
    for at, field in enumerate(schema):
        if not isinstance(field.dataType, StringType):
            text = F.get(texts, F.lit(at))
            told = F.concat(F.lit(f"{field.name} is not {field.dataType.simpleString()}: "), text)
            reason = reason.when(text.isNotNull() & typed[field.name].isNull(), told)
    return reason


def scan_delimited(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a headerless ``|`` file: an empty field is NULL, quotes and backslashes are plain characters, empty lines are none.

    A line with too few or too many fields or with a typed field that cannot be read fails the job, and the error names the
    file, the reason and the line, whatever columns the job uses. ``rejects`` lists such lines instead.
    """
    declared = _schema(schema)

    def checked(read: Column) -> Column:
        def told(reason: Column) -> Column:
            text = F.concat(F.lit("Malformed line in "), F.col("file"), F.lit(": "), reason, F.lit(": "), F.substring("line", 1, QUOTED))
            return F.when(reason.isNull(), read["typed"]).otherwise(F.raise_error(text))

        return _once(_reject_reason(read, declared), told)

    # a generator's rows are made before any filter or projection on them, so no plan leaves the check out or does it twice
    fields = F.transform(F.array(_texts()), lambda texts: _once(_read(texts, declared), checked))
    return _lines(spark, path).select(F.inline(fields))


def rejects(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, reason, line) of every line that does not fit the schema."""
    declared = _schema(schema)
    reason = F.transform(F.array(_texts()), lambda texts: _once(_read(texts, declared), lambda read: _reject_reason(read, declared)))
    return _lines(spark, path).select("file", F.explode(reason).alias("reason"), "line").filter(F.col("reason").isNotNull())


def unambiguous(text: Column, name: str) -> Column:
    """``text`` as a field of such a file. The format has no quoting: text with the separator or a line break fails the job."""
    refused = F.raise_error(F.concat(F.lit(f"{name} holds a separator or a line break: "), text)).cast("string")
    return F.when(text.rlike(r"[|\n\r]"), refused).otherwise(text)


def staging(spark: SparkSession, raw_dir: str, names: tuple[str, ...] = FILES, suffix: str = ".csv") -> dict[str, DataFrame]:
    """The named source files of ``raw_dir``. A missing file raises here, before any work is planned."""
    return {name: scan_delimited(spark, f"{raw_dir.rstrip('/')}/{name}{suffix}", layout(name)) for name in names}
