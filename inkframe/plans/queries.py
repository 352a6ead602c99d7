"""The registered queries over typed text, each with SQL that gives the same rows from the base tables.

Queries named engine_ and stream_ are Spark's own operators over parsed rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import documents
from ..functions.codecs import Codec, Codecs
from ..functions.literals import detect_format, mask, parse_unit, safe_int, time_micros, typed, uuid_bytes
from ..functions.render import line_of, object_of, quote_bracketed, render_cell, table_header
from ..operators.rows import embedded_table, inline_array, line_rows, object_rows
from ..operators.schema import declare, entries, merge
from ..sources.text import read_lines, read_objects, read_text, write_lines, write_objects
from ..streaming.text import stream_lines, stream_objects, writer_lines, writer_objects

Query = Callable[[SparkSession, str], DataFrame]
FLAT = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it has fewer splits than there are: a large table has more, and isn't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def through_lines(df: DataFrame, delimiter: str = ",") -> DataFrame:
    """df written as lines of a table and parsed again."""
    df = spread(df)
    return line_rows(df.select(line_of(df, delimiter).alias("line")), F.col("line"), df.schema, delimiter)


def through_objects(df: DataFrame) -> DataFrame:
    df = spread(df)
    return object_rows(df.select(object_of(df).alias("obj")), F.col("obj"), df.schema)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see. Where spark.checkpoint.dir is unset, a local session uses its warehouse; a cluster fails."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(given or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/text-{uuid.uuid4().hex}"


def cell(df: DataFrame, name: str, **options) -> Column:
    return render_cell(F.col(name), df.schema[name], **options)


for _name in FLAT:
    query(f"SELECT * FROM {_name}", f"lines_roundtrip_{_name}")(lambda s, d, n=_name: through_lines(table(s, d, n)))
    query(f"SELECT * FROM {_name}", f"objects_roundtrip_{_name}")(lambda s, d, n=_name: through_objects(table(s, d, n)))


@query("SELECT * FROM orders")
def lines_files(spark, sf_dir):
    """Files with inferred types: written, read, inferred and read again; whole prices come back as written."""
    df, path = table(spark, sf_dir, "orders"), scratch(spark)
    write_lines(df, path, "|")
    return read_lines(spark, path)


@query("SELECT * FROM customer")
def lines_exact_file(spark, sf_dir):
    df, path = table(spark, sf_dir, "customer"), scratch(spark)
    write_lines(df, path, "\t", exact=True)
    return read_lines(spark, path, df.schema)


@query("SELECT * FROM events")
def objects_files(spark, sf_dir):
    df, path = table(spark, sf_dir, "events"), scratch(spark)
    write_objects(df, path)
    return read_objects(spark, path, df.schema)


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def object_lists_file(spark, sf_dir):
    """Files that are bracketed lists, read by many tasks."""
    df, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch(spark)
    write_objects(df, path, layout="list")
    return read_objects(spark, path, df.schema, layout="list")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def object_array_files(spark, sf_dir):
    """The same files, each read whole and found to be lists by their first lines."""
    df, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch(spark)
    write_objects(df, path, layout="list")
    return read_text(spark, path)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def multi_header_files(spark, sf_dir):
    """A folder to which two writers added files, with other delimiters and each with the counts of its own rows."""
    df, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), scratch(spark)
    write_lines(df.where("o_orderkey % 2 = 0").repartition(3), f"{path}/even", ",", exact=True)
    write_lines(df.where("o_orderkey % 2 = 1").repartition(2, "o_custkey"), f"{path}/odd", "|", exact=True)
    return read_lines(spark, f"{path}/*", df.schema)


@query("SELECT event_id, user_id, event_type, value FROM events")
def read_text_of_lines(spark, sf_dir):
    df, path = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), scratch(spark)
    write_lines(df, path, "\t")
    return read_text(spark, path, df.schema)


@query("SELECT 0 AS n, '[0]{c_custkey,c_name}:' AS line")
def empty_table_file(spark, sf_dir):
    df, path = table(spark, sf_dir, "customer").select("c_custkey", "c_name"), scratch(spark)
    write_lines(df.where(F.lit(False)), path)
    n = read_lines(spark, path, df.schema).count()
    return spark.read.text(path).select(F.lit(n).cast("int").alias("n"), F.col("value").alias("line"))


@query("SELECT fmt, count(*) AS n FROM (SELECT 'indented' AS fmt FROM orders UNION ALL SELECT 'bracketed' FROM orders UNION ALL SELECT 'typed_unit' FROM orders) GROUP BY fmt")
def detect_format_counts(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    texts = F.array(F.concat(F.lit("\n[1]{a}:\n"), key), F.concat(F.lit("\ufeff {\"a\": "), key, F.lit("}")), F.concat(F.lit("a: "), key))
    return table(spark, sf_dir, "orders").select(F.explode(texts).alias("t")).groupBy(detect_format(F.col("t")).alias("fmt")).agg(F.count("*").alias("n"))


@query("SELECT '[' || count(*) || ']{l_orderkey,l_partkey,l_quantity}:' AS header FROM lineitem")
def render_table_header(spark, sf_dir):
    _, after = table_header(["l_orderkey", "l_partkey", "l_quantity"], "#").split("#")
    return table(spark, sf_dir, "lineitem").agg(F.concat(F.lit("["), F.count("*").cast("string"), F.lit(after)).alias("header"))


@query("""SELECT n_nationkey, n_nationkey || ', "' || n_name || '", ' || n_regionkey AS line FROM nation""")
def render_lines_nation(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return df.select("n_nationkey", line_of(df).alias("line"))


@query("""SELECT s_suppkey, s_suppkey || '|"' || s_name || '"|' || s_acctbal AS line FROM supplier""")
def render_lines_pipe(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return df.select("s_suppkey", line_of(df, "|").alias("line"))


@query("""SELECT c_custkey, '{"c_custkey": ' || c_custkey || ', "c_name": "' || c_name || '", "c_acctbal": ' || c_acctbal || '}' AS obj FROM customer""")
def render_objects_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return df.select("c_custkey", object_of(df).alias("obj"))


@query(r"""SELECT doc_id, '"' || replace(replace(replace(replace(replace(text,'\','\\'),'"','\"'),chr(10),'\n'),chr(13),'\r'),chr(9),'\t') || '"' AS lit FROM documents""")
def render_json_string(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quote_bracketed(F.col("text")).alias("lit"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || 'm' AS lit FROM lineitem")
def render_decimal(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_extendedprice").cast("decimal(18,2)"))
    return df.select("l_orderkey", "l_linenumber", cell(df, "d").alias("lit"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS lit FROM orders")
def render_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return df.select("o_orderkey", cell(df, "d").alias("lit"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN '.' || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END AS lit FROM events")
def render_datetime_naive(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", cell(df, "ts").alias("lit"))


def _uuid(c: Column) -> Column:
    m = F.md5(c)
    return F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


@query("SELECT c_custkey, 'uuid(' || substr(md5(c_name),1,8) || '-' || substr(md5(c_name),9,4) || '-' || substr(md5(c_name),13,4) || '-' || substr(md5(c_name),17,4) || '-' || substr(md5(c_name),21,12) || ')' AS lit FROM customer")
def render_uuid(spark, sf_dir):
    field = declare({"u": "uuid"})["u"]
    return table(spark, sf_dir, "customer").select("c_custkey", render_cell(_uuid(F.col("c_name")), field).alias("lit"))


@query("SELECT p_partkey, 'hex(' || lower(hex(encode(p_name))) || ')' AS h, 'b64(' || to_base64(encode(p_name)) || ')' AS b FROM part")
def render_hex_b64(spark, sf_dir):
    df = table(spark, sf_dir, "part").withColumn("x", F.encode("p_name", "UTF-8"))
    return df.select("p_partkey", cell(df, "x").alias("h"), cell(df, "x", binary_format="b64").alias("b"))


@query("SELECT p_partkey, md5(p_name) AS u, p_name AS x FROM part")
def parse_uuid_binary(spark, sf_dir):
    schema = declare({"u": "uuid", "x": "binary"})
    df = table(spark, sf_dir, "part").select("p_partkey", _uuid(F.col("p_name")).alias("u"), F.encode("p_name", "UTF-8").alias("x"))
    line = F.concat_ws(", ", render_cell(F.col("u"), schema["u"]), F.when(F.col("p_partkey") % 2 == 0, render_cell(F.col("x"), schema["x"])).otherwise(render_cell(F.col("x"), schema["x"], binary_format="b64")))
    return line_rows(df, line, schema, keep=["p_partkey"]).select("p_partkey", F.replace("u", F.lit("-"), F.lit("")).alias("u"), F.decode("x", "UTF-8").alias("x"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'int' AS kind FROM orders UNION ALL SELECT 'decimal' FROM orders UNION ALL SELECT 'date' FROM orders UNION ALL SELECT 'string' FROM orders) GROUP BY kind")
def parse_unit_kinds(spark, sf_dir):
    df = table(spark, sf_dir, "orders").withColumns({"d": F.col("o_totalprice").cast("decimal(18,2)"), "day": F.to_date("o_orderdate")})
    cells = F.explode(F.array(*(cell(df, c) for c in ("o_orderkey", "d", "day", "o_orderpriority"))))
    return df.select(cells.alias("c")).groupBy(parse_unit(mask(F.col("c"))).kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total FROM lineitem GROUP BY l_returnflag")
def parse_decimal_sum(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("d"))
    return through_objects(df).groupBy("l_returnflag").agg(F.sum("d").alias("total"))


@query("SELECT event_id, ts - INTERVAL 8 HOUR AS ts_utc FROM events")
def parse_datetime_tz(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    lit = F.concat(cell(df, "ts"), F.lit("+08:00"))
    at = typed(parse_unit(lit), declare({"t": "datetime"})["t"])
    return df.select("event_id", F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz").alias("ts_utc"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS t FROM events")
def parse_time(spark, sf_dir):
    field = declare({"t": "time"})["t"]
    return table(spark, sf_dir, "events").select("event_id", typed(parse_unit(F.date_format("ts", "HH:mm:ss")), field).alias("t"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / 64 AS v FROM orders")
def parse_floats(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") / 64).alias("v"))
    return through_objects(df)


@query("SELECT max(length(split_part(d,'.',1))) + max(length(split_part(d,'.',2))) AS precision, max(length(split_part(d,'.',2))) AS scale FROM (SELECT CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS d FROM orders)")
def infer_decimal_lattice(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_totalprice").cast("decimal(18,2)").alias("d"))
    rows = df.select(object_of(df).alias("obj"))
    return merge(entries(rows, F.col("obj"), F.lit(0))).select(F.col("precision").cast("bigint").alias("precision"), F.col("scale").cast("bigint").alias("scale"))


@query("SELECT * FROM (VALUES (0,'n_nationkey','int'),(1,'n_name','string'),(2,'n_regionkey','int')) t(pos, field, kind)")
def infer_schema_nation(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    found = merge(entries(df.select("n_nationkey", object_of(df).alias("obj")), F.col("obj"), F.col("n_nationkey")))
    return found.select((F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("pos"), "field", "kind")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders")
def sparse_missing_to_null(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    full = df.select("o_orderkey", "o_orderpriority")
    obj = F.when(F.col("o_orderstatus") == "F", object_of(full.select("o_orderkey"))).otherwise(object_of(full))
    return object_rows(df.select(obj.alias("obj")), F.col("obj"), full.schema)


@query("SELECT o_orderkey, o_custkey AS a FROM orders")
def duplicate_key_last_wins(spark, sf_dir):
    obj = F.format_string('{"o_orderkey": %d, "a": %d, "a": %d}', "o_orderkey", F.lit(-1), "o_custkey")
    return object_rows(table(spark, sf_dir, "orders").select(obj.alias("obj")), F.col("obj"), declare({"o_orderkey": "int", "a": "int"}))


@query("SELECT c_custkey, c_name FROM customer")
def compat_discard_unknown(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return object_rows(df.select(object_of(df).alias("obj")), F.col("obj"), declare({"c_custkey": "int", "c_name": "string"}))


@query("SELECT count(*) AS rejected FROM orders")
def strict_reject_count(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(parse_unit(F.col("o_orderpriority"), "strict").error.isNotNull()).agg(F.count("*").alias("rejected"))


@query("SELECT o_orderkey, v FROM (SELECT o_orderkey, unnest([o_orderkey, o_custkey, 7]) AS v FROM orders)")
def inline_array_explode(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("a[3]: %d, %d, 7", "o_orderkey", "o_custkey").alias("t"))
    value = declare({"v": "int"})["v"]
    return df.select("o_orderkey", F.explode(inline_array(F.col("t"))).alias("c")).select("o_orderkey", typed(parse_unit(F.col("c")), value).alias("v"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")
def embedded_table_explode(spark, sf_dir):
    """A nested document for each line, with a table in it, whose lines are taken out."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    docs = spread(df).select(F.concat(F.lit("meta:\n  n: 1\nrows[1]{l_orderkey,l_partkey,l_quantity}:\n  "), line_of(df), F.lit("\n")).alias("doc"))
    lines = docs.select(F.explode(embedded_table(F.col("doc"), "rows")).alias("line"))
    return line_rows(lines, F.col("line"), df.schema)


@query("""SELECT c_custkey, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: "' || c_name || '"' || chr(10) AS txt FROM customer""")
def transcode_to_indented(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return df.select("c_custkey", documents.bracketed_to_indented(object_of(df)).alias("txt"))


@query("""SELECT n_nationkey, '{"n_nationkey": ' || n_nationkey || ', "n_name": "' || n_name || '"}' AS txt FROM nation""")
def transcode_to_bracketed(spark, sf_dir):
    text = F.format_string('n_nationkey: %d\nn_name: "%s"\n', "n_nationkey", "n_name")
    return table(spark, sf_dir, "nation").select("n_nationkey", documents.indented_to_bracketed(text).alias("txt"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_object_parse(spark, sf_dir):
    return object_rows(table(spark, sf_dir, "events"), F.col("props"), declare({"k": "int?"}), keep=["event_id"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey * 9007199254740 > 9007199254740991 THEN CAST('nan' AS DOUBLE) ELSE CAST(o_orderkey * 9007199254740 AS DOUBLE) END AS v FROM orders")
def codec_safe_int_nan(spark, sf_dir):
    product = F.col("o_orderkey").cast("decimal(19,0)") * F.lit(9007199254740)  # beyond 2^63 where keys pass 1,024,000
    return table(spark, sf_dir, "orders").select("o_orderkey", safe_int(product, "nan").alias("v"))


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'null') AS cell FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def null_cells(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return df.select("doc_id", cell(df, "quality").alias("cell"))


@query("SELECT l_returnflag, l_linestatus, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q, count(*) AS n FROM lineitem GROUP BY ALL")
def engine_q1_over_lines(spark, sf_dir):
    rows = through_lines(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def engine_join_over_typed(spark, sf_dir):
    orders = through_lines(table(spark, sf_dir, "orders").select("o_custkey"))
    customers = through_objects(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
def engine_window_over_typed(spark, sf_dir):
    rows = through_lines(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    return rows.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("bigint").alias("rn"))


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_events_hourly(spark, sf_dir):
    """Events written as a table, read as a stream until no file is left, and counted by the hour."""
    df, path, name = table(spark, sf_dir, "events").select("event_id", "ts"), scratch(spark), f"hourly_{uuid.uuid4().hex}"
    write_lines(df, path)
    hours = stream_lines(spark, path, df.schema).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    out = f"{path}-out"
    hours.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).option("checkpointLocation", f"{path}-state").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def streamed(spark: SparkSession, stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Runs a query over a stream until no file is left, each batch in place of its own folder."""
    out = f"{path}-out"
    write = lambda batch, number: batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={number}")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query("SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_objects_hourly(spark, sf_dir):
    """Events written as objects and read as a stream."""
    df, path = table(spark, sf_dir, "events").select("event_id", "ts"), scratch(spark)
    write_objects(df, path)
    hours = stream_objects(spark, path, df.schema).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))
    return streamed(spark, hours, path, "complete")


@query("SELECT event_id, event_type, value FROM events")
def stream_writer_lines(spark, sf_dir):
    """A stream of lines written as a folder of lines by another stream, with its columns in the schema's order."""
    df, path = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), scratch(spark)
    write_lines(df, f"{path}-in")
    rows = stream_lines(spark, f"{path}-in", df.schema).select("value", "event_id", "event_type")
    writer_lines(rows, path, df.schema, "|").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return read_lines(spark, f"{path}/*", df.schema)


@query("SELECT event_id, event_type, value FROM events")
def stream_writer_objects(spark, sf_dir):
    df, path = table(spark, sf_dir, "events").select("event_id", "event_type", "value"), scratch(spark)
    write_objects(df, f"{path}-in")
    rows = stream_objects(spark, f"{path}-in", df.schema)
    writer_objects(rows, path, df.schema).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return read_objects(spark, path, df.schema)


@query("""SELECT o_orderkey, '[2|]: ' || o_orderkey || '|' || o_custkey || chr(10) AS txt FROM orders""")
def render_root_list_pipe(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", documents.bracketed_to_indented(F.format_string("[%d, %d]", "o_orderkey", "o_custkey"), "|").alias("txt"))


@query("""SELECT n_nationkey, '[[' || n_nationkey || ', "' || n_name || '"], [' || n_regionkey || ', null]]' AS txt FROM nation""")
def rows_of_lists(spark, sf_dir):
    """A table without names: its rows are lists."""
    text = F.format_string("[2]:\n%d, %s\n%d, null\n", "n_nationkey", "n_name", "n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", documents.indented_to_bracketed(text).alias("txt"))


@query("""SELECT c_custkey, '{"k": ' || c_custkey || ', "tags": ["' || c_mktsegment || '"]}' AS txt FROM customer""")
def canonical_documents(spark, sf_dir):
    """Documents of either syntax, by what their first line says."""
    indented = F.format_string('k: %d\ntags[1]: "%s"\n', "c_custkey", "c_mktsegment")
    bracketed = F.format_string(' {"k": %d,\n"tags": ["%s"]}', "c_custkey", "c_mktsegment")
    text = F.when(F.col("c_custkey") % 2 == 0, indented).otherwise(bracketed)
    return table(spark, sf_dir, "customer").select("c_custkey", documents.canonical(text).alias("txt"))


@query("SELECT o_orderkey, o_totalprice > 100000 AS big, CASE WHEN o_totalprice > 100000 THEN 'true' ELSE 'false' END AS lit FROM orders")
def boolean_cells(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("big"))
    lit = cell(df, "big")
    rows = line_rows(df.select("o_orderkey", lit.alias("lit")), F.col("lit"), declare({"big": "bool"}), keep=["o_orderkey", "lit"])
    return rows.select("o_orderkey", "big", "lit")


@query("SELECT c_custkey, substr(md5(c_name),1,8) || '-' || substr(md5(c_name),9,4) || '-' || substr(md5(c_name),13,4) || '-' || substr(md5(c_name),17,4) || '-' || substr(md5(c_name),21,12) AS u, md5(c_name) AS b FROM customer")
def uuid_bytes_both_ways(spark, sf_dir):
    """The 16 bytes of uuids rendered as literals, read as text, and turned into bytes."""
    field = declare({"u": "uuid"})["u"]
    raw = table(spark, sf_dir, "customer").select("c_custkey", F.unhex(F.md5("c_name")).alias("u"))
    binary = T.StructField("u", T.BinaryType(), True, field.metadata)
    read = line_rows(raw, render_cell(F.col("u"), binary), T.StructType([field]), keep=["c_custkey"])
    return read.select("c_custkey", "u", F.lower(F.hex(uuid_bytes(F.col("u")))).alias("b"))


@query("SELECT event_id, epoch_us(ts) % 86400000000 AS micros FROM events")
def time_of_day_micros(spark, sf_dir):
    """Times of day from microseconds to literals and back."""
    field = declare({"t": "time"})["t"]
    df = table(spark, sf_dir, "events").select("event_id", time_micros(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("t"))
    text = line_rows(df, render_cell(F.col("t"), T.StructField("t", T.LongType(), True, field.metadata)), T.StructType([field]), keep=["event_id"])
    return text.select("event_id", time_micros(F.col("t")).alias("micros"))


@query("SELECT p_partkey, p_retailprice * 100 AS p_retailprice, 'x' || p_name AS p_name FROM part")
def codecs_by_kind(spark, sf_dir):
    """A reader's own codecs for kinds, over those for all uses."""
    df = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_name")
    shared = Codecs({"float": Codec(decode=lambda c: c * 100), "string": Codec(decode=F.upper)})
    own = shared.snapshot({"string": Codec(decode=lambda c: F.concat(F.lit("x"), c))})
    return own.decode(through_lines(df), df.schema)
