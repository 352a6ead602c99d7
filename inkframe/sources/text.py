"""Folders of typed text as tables, with Spark's own text readers and writers.

Tables of lines: every file has its own header line, ``[*]{a,b}:`` or one with the number of its rows; Spark splits files at
line ends, so a file of any size is read by many tasks. Objects: one a line, or bracketed lists. Lists whose objects don't
span lines, as this module writes them, are split like lines; others are read a file a row. Column pruning and filters
work as for any expression over a text scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import PLAIN, detect_format, unit
from ..functions.render import line_of, object_of, table_header
from ..operators.rows import header, line_rows, object_rows, objects_of_array, plain_line, split_row
from ..operators.schema import check_compatible, entries, infer, merge

#: No literal has this character, so a line is one field of the writer.
_NEVER = "\x03"
#: A header line: the count, and what all files of a folder have in common.
_HEADER = r"^\s*\[(\*|\d*)([^\]]*\]\{.*\}:)\s*$"
#: Different headers, but for their counts, that the files of a folder may have.
MOST_HEADERS = 100
#: Lines from which types are supposed, before all lines are looked at.
FIRST_LINES = 1000


def _framed(first: Callable[[int], str], last: str | None, join: str, counts: dict[int, int] | None = None):
    """Rows of text with a first and a last one around those of each task that has any; join goes before all but the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(0).to_pylist()
            head = [first(number)] if not n else []
            n += len(rows)
            if join or last is not None:
                rows = [(join if head == [] or i else "") + row for i, row in enumerate(rows)]
                if head:
                    rows[0] = head[0] + rows[0]
            else:
                rows = head + rows
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"])
        if counts is not None and n != counts.get(number, 0):
            raise ValueError(f"serialize error: {counts.get(number, 0)} rows were counted and {n} came")
        if n and last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last])], names=["value"])

    return run


def write_lines(df: DataFrame, path: str, delimiter: str = ",", binary_format: str = "hex", exact: bool = False, schema: T.StructType | None = None) -> None:
    """A header and the rows in each file. exact: each header has the number of its file's rows; df is computed twice, and must
    give the same rows in the same partitions. A table without rows is one file with a count of 0."""
    df = check_compatible(df, schema) if schema else df
    lines = df.select(line_of(df, delimiter, binary_format).alias("value"))
    # a number for each task
    counts = {r.n: r["count"] for r in lines.groupBy(F.spark_partition_id().alias("n")).count().collect()} if exact else None
    if not counts if exact else df.isEmpty():
        none = df.sparkSession.createDataFrame([(table_header(df.columns, 0, delimiter),)], "value string")
        none.coalesce(1).write.text(path, lineSep="\n")
    elif exact:
        names = df.columns
        lines.mapInArrow(_framed(lambda i: table_header(names, counts[i], delimiter), None, "", counts), "value string").write.text(path, lineSep="\n")
    else:
        plain = {"header": True, "sep": _NEVER, "quote": "\x00", "escape": "\x00", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "lineSep": "\n"}
        lines.toDF(table_header(df.columns, "*", delimiter)).write.options(**plain).csv(path)


def write_objects(df: DataFrame, path: str, binary_format: str = "hex", schema: T.StructType | None = None, layout: str = "lines") -> None:
    """layout: "lines" (an object a line), or "list": each file is a bracketed list with an object a line. A table without rows is
    one empty list."""
    df = check_compatible(df, schema) if schema else df
    objects = df.select(object_of(df, binary_format).alias("value"))
    if layout == "list":
        if df.isEmpty():
            objects = df.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
        else:
            objects = objects.mapInArrow(_framed(lambda _: "[", "]", ", "), "value string")
    objects.write.text(path, lineSep="\n")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select("_metadata.file_path", "_metadata.file_block_start", F.regexp_replace("value", "^﻿|\r$", "").alias("value")).where(F.trim("value") != "")


def headers(lines: DataFrame) -> DataFrame:
    """(file_path, header): the first line of each file."""
    numbered = lines.select("file_path", "value", F.struct("file_block_start", F.monotonically_increasing_id().alias("n")).alias("place"))
    return numbered.groupBy("file_path").agg(F.min_by("value", "place").alias("header"))


def _line_entries(lines: DataFrame, names: list[str], delimiter: str, mode: str) -> DataFrame:
    rows = lines.select(F.posexplode(split_row(F.col("value"), delimiter)).alias("pos", "cell")).select("pos", F.trim("cell").alias("cell"))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("pos") + 1)
    return rows.select(F.lit(0).alias("row"), "pos", named.alias("field"), unit(F.col("cell"), mode).alias("p")).select("row", "pos", "field", "p.*")


def infer_lines(lines: DataFrame, names: list[str], delimiter: str, mode: str) -> T.StructType:
    """By all cells. The kinds of some lines are supposed for all; a line that one pattern shows to have plain literals of
    these kinds, or nulls, adds nothing to them, and the others are aggregated cell by cell."""
    some = merge(_line_entries(lines.limit(FIRST_LINES), names, delimiter, mode)).select(F.col("first.pos").alias("pos"), "field", "kind").collect()
    kinds = {r.field: r.kind for r in some}
    if any(name not in kinds for name in names):
        return infer(_line_entries(lines, names, delimiter, mode))
    shape = plain_line([f"null|{PLAIN[kinds[name]]}" if kinds[name] in PLAIN else "null" for name in names], delimiter)
    others = _line_entries(lines.where(~F.col("value").rlike(shape)), names, delimiter, mode)
    known = lines.sparkSession.createDataFrame([(0, r.pos, r.field, r.kind) for r in some], "row int, pos int, field string, kind string")
    return infer(others.unionByName(known, allowMissingColumns=True))


def read_lines(spark: SparkSession, path: str, schema: T.StructType | None = None, mode: str = "compat", on_error: str = "fail") -> DataFrame:
    """The rows of all files. Each file has a header of its own; the names must be the schema's in order, or without a schema
    those of one another, and the types are inferred. Counts in headers are checked as the rows are read; [*] needs a row in the folder."""
    lines = _lines(spark, path)
    first = headers(lines)
    own = first.select("file_path", "header", F.regexp_extract("header", _HEADER, 1).alias("count"), F.regexp_extract("header", _HEADER, 2).alias("rest"))
    grouped = own.groupBy("rest", F.when(F.col("rest") == "", F.col("header")).alias("bad")).agg(F.min("header").alias("least"), F.max("header").alias("most"), F.bool_or(F.col("count") != "*").alias("exact"))
    groups = grouped.limit(MOST_HEADERS + 1).collect()
    found = [r.rest or r.bad for r in groups]
    if not found:
        return spark.createDataFrame([], schema or T.StructType())
    parsed = {rest: header(f"[0{rest}") for rest in found}
    if not all(parsed.values()):
        raise ValueError(f"parse error: a header expected: {next(r for r, p in parsed.items() if not p)[:80]}")
    names = next(iter(parsed.values()))[2]
    for _, _, other in parsed.values():
        if other != (schema.names if schema else names):
            raise ValueError(f"schema error: columns {other}, expected {schema.names if schema else names}")
    counted = own.select("file_path", "header", "rest", F.when(F.col("count") != "*", F.coalesce(F.col("count").try_cast("long"), F.lit(0))).alias("expected"))
    exact = any(r.exact for r in groups)
    if exact:
        rows_of = lines.groupBy("file_path").agg((F.count("*") - 1).alias("n"))
        wrong = F.raise_error(F.concat(F.lit("validate error: "), F.col("expected").cast("string"), F.lit(" rows expected, found "), F.col("n").cast("string"), F.lit(" in "), "file_path")).cast("string")
        checked = counted.join(rows_of, "file_path").withColumn("header", F.when(F.col("expected").isNull() | (F.col("expected") == F.col("n")), F.col("header")).otherwise(wrong))
        # files without rows give nothing below, so that a wrong count is looked for here
        if not checked.where("expected > 0 and n = 0").isEmpty():
            raise ValueError("validate error: rows expected, found 0")
        counted = checked.select("file_path", "header", "rest")
    if len(groups) == 1 and groups[0].least == groups[0].most and not exact:  # the same header in all files, found once
        rows = lines.select("value").where(F.col("value") != groups[0].least)
    else:
        rows = lines.select("file_path", "value").join(counted.select("file_path", "header", "rest"), "file_path").where(F.col("value") != F.col("header"))
    if not exact and rows.isEmpty():
        raise ValueError("validate error: [*] needs a row")
    out = None
    for delimiter in {p[1] for p in parsed.values()}:
        mine = rows.where(F.col("rest").isin([rest for rest, p in parsed.items() if p[1] == delimiter])) if len(parsed) > 1 else rows
        schema = schema or infer_lines(mine, names, delimiter, mode)
        if not schema.fields:  # no rows to infer from
            schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = line_rows(mine, F.col("value"), schema, delimiter, mode, on_error)
        out = part if out is None else out.unionByName(part)
    return out


def _objects_of_lines(lines: DataFrame) -> DataFrame:
    """Objects of lists whose objects don't span lines: each line is taken as a list of its own, whatever stands between lines."""
    inside = F.regexp_replace(F.regexp_replace("value", r"^\s*[\[,]\s*", ""), r"\s*[\],]\s*$", "")
    whole = F.concat(F.lit("["), inside, F.lit("]"))
    bad = F.raise_error(F.concat(F.lit("parse error: a list of flat objects expected: "), F.substring("value", 1, 80))).cast("array<string>")
    return lines.select(F.explode(F.coalesce(objects_of_array(whole), bad)).alias("obj"))


def read_objects(spark: SparkSession, path: str, schema: T.StructType | None = None, mode: str = "compat", on_error: str = "fail", layout: str = "lines") -> DataFrame:
    """layout: "lines" (an object a line), "list" (bracketed lists whose objects don't span lines) or "array" (any bracketed list, a file a row)."""
    if layout == "lines":
        objects = _lines(spark, path).select(F.col("value").alias("obj"))
    elif layout == "list":
        objects = _objects_of_lines(_lines(spark, path))
    else:
        whole = spark.read.text(path, wholetext=True).where(F.col("value").rlike(r"\S"))  # a task without rows writes an empty file
        bad = F.raise_error(F.lit("parse error: a list of flat objects expected")).cast("array<string>")
        objects = whole.select(F.explode(F.coalesce(objects_of_array(F.col("value")), bad)).alias("obj"))
    if schema is None:
        schema = infer(entries(objects, F.col("obj"), F.monotonically_increasing_id()))
    return object_rows(objects, F.col("obj"), schema, mode, on_error)


def read_text(spark: SparkSession, path: str, schema: T.StructType | None = None, mode: str = "compat", on_error: str = "fail") -> DataFrame:
    """Either syntax, as the first lines of the files say: all lines of a table, objects or lists."""
    first = headers(_lines(spark, path)).select(detect_format(F.col("header")).alias("kind"), F.substring(F.ltrim("header"), 1, 1).alias("opens"))
    kinds = {(r.kind, r.opens) for r in first.distinct().limit(MOST_HEADERS).collect()}
    if len({kind for kind, _ in kinds}) > 1:
        raise ValueError(f"parse error: files of several kinds: {sorted(kinds)}")
    if not kinds or kinds <= {("indented", "[")}:
        return read_lines(spark, path, schema, mode, on_error)
    if kinds == {("bracketed", "{")}:
        return read_objects(spark, path, schema, mode, on_error)
    if kinds == {("bracketed", "[")}:
        return read_objects(spark, path, schema, mode, on_error, "array")
    raise ValueError("arrow error: a list of flat objects expected")


def replace(spark: SparkSession, path: str) -> None:
    """Removes a folder that a batch which failed has left."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
