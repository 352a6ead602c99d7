"""Typed text as streams: folders that files are added to, and queries that write such folders.

Spark's file stream finds new files and keeps checkpoints; the rows are parsed by the same native expressions as in
batch. A schema is always declared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from ..functions.render import object_of, table_header
from ..operators.rows import object_rows, line_rows
from ..operators.schema import check_compatible
from ..sources.text import replace, write_lines


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "^\ufeff|\r$", "").alias("value"))
    return lines.where(F.trim("value") != "")


def stream_lines(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = ",", mode: str = "compat", on_error: str = "fail") -> DataFrame:
    """Rows of files whose header names the schema's fields in order; a file with another header fails the query."""
    lines = _lines(spark, path)
    own = table_header(schema.names, "*", delimiter)[2:]
    is_header = F.col("value").rlike(r"^\[[\d*]*[^\]]*\]\{.*\}:\s*$")
    other = F.raise_error(F.concat(F.lit("schema error: header "), F.col("value"))).cast("boolean")
    rows = lines.where(F.when(~is_header, True).when(F.rtrim("value").endswith(own), False).otherwise(other))
    return line_rows(rows, F.col("value"), schema, delimiter, mode, on_error)


def stream_objects(spark: SparkSession, path: str, schema: T.StructType, mode: str = "compat", on_error: str = "fail") -> DataFrame:
    """Rows of files with an object a line."""
    return object_rows(_lines(spark, path), F.col("value"), schema, mode, on_error)


def writer_lines(df: DataFrame, path: str, schema: T.StructType, delimiter: str = ",") -> DataStreamWriter:
    """Each batch goes to a folder of its own below path; a batch that runs again writes the same folder anew."""

    def write(batch: DataFrame, number: int) -> None:
        replace(batch.sparkSession, f"{path}/batch={number}")
        write_lines(batch, f"{path}/batch={number}", delimiter)

    return check_compatible(df, schema).writeStream.foreachBatch(write)


def writer_objects(df: DataFrame, path: str, schema: T.StructType) -> DataStreamWriter:
    df = check_compatible(df, schema)
    return df.select(object_of(df).alias("value")).writeStream.format("text").option("path", path)
