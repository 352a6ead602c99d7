"""Schemas: the declared ones, and those inferred from literals by aggregation."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import number
from ..functions.render import IDENTIFIER, TYPED
from .rows import with_entries

#: The names of scalar types.
TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "time": T.StringType(), "datetime": T.TimestampType(), "datetime_naive": T.TimestampNTZType(), "uuid": T.StringType(), "binary": T.BinaryType()}


def declare(fields: Mapping[str, str] | list[tuple[str, str]]) -> T.StructType:
    """A schema from names and types such as "int", "decimal(10,2)", "string?"; a question mark allows null."""
    out, seen = [], set()
    for name, kind in fields.items() if isinstance(fields, Mapping) else fields:
        if not re.fullmatch(IDENTIFIER, name):
            raise ValueError(f"schema error: field name {name!r}")
        if name in seen:
            raise ValueError(f"schema error: field {name} twice")
        seen.add(name)
        base, nullable = kind.rstrip("?"), kind.endswith("?")
        if m := re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", base):
            p, s = int(m[1]), int(m[2])
            if not 1 <= p <= 38 or s > p:
                raise ValueError(f"schema error: {base}: 1 to 38 digits, and no more of them behind the point")
            t = T.DecimalType(p, s)
        elif base in TYPES:
            t = TYPES[base]
        else:
            raise ValueError(f"schema error: type {base}")
        out.append(T.StructField(name, t, nullable, {TYPED: base} if base in ("uuid", "time") else {}))
    if not out:
        raise ValueError("schema error: a field at least")
    return T.StructType(out)


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    """Uuids are 16 bytes with a mark of their own, times are microseconds of the day, zoned times are UTC."""
    simple = [(T.BooleanType, pa.bool_()), (T.IntegralType, pa.int64()), (T.FloatType, pa.float64()), (T.DoubleType, pa.float64()), (T.DateType, pa.date32()), (T.TimestampNTZType, pa.timestamp("us")), (T.TimestampType, pa.timestamp("us", "UTC")), (T.BinaryType, pa.binary()), (T.StringType, pa.string())]
    out = []
    for f in schema.fields:
        typed = (f.metadata or {}).get(TYPED)
        if typed == "uuid":
            kind = pa.binary(16)
        elif typed == "time" or isinstance(f.dataType, T.TimeType):
            kind = pa.time64("us")
        elif isinstance(f.dataType, T.DecimalType):
            kind = pa.decimal128(f.dataType.precision, f.dataType.scale)
        else:
            kind = next((a for cls, a in simple if isinstance(f.dataType, cls)), None)
        if kind is None:
            raise ValueError(f"arrow error: {f.name} is {f.dataType.simpleString()}")
        out.append(pa.field(f.name, kind, f.nullable, {TYPED: typed} if typed else None))
    return pa.schema(out)


def from_arrow_schema(schema: pa.Schema) -> T.StructType:
    """What ``to_arrow_schema`` came from; other Arrow types are an error."""
    fields = []
    for f in schema:
        t, mark = f.type, ((f.metadata or {}).get(TYPED.encode()) or b"").decode()
        if pa.types.is_decimal(t):
            kind = f"decimal({t.precision},{t.scale})"
        elif pa.types.is_timestamp(t) and t.unit == "us" and t.tz in (None, "UTC"):
            kind = "datetime" if t.tz else "datetime_naive"
        elif t == pa.binary(16) and mark == "uuid":
            kind = "uuid"
        else:
            kind = {pa.string(): "string", pa.int64(): "int", pa.float64(): "float", pa.bool_(): "bool", pa.date32(): "date", pa.time64("us"): "time", pa.binary(): "binary"}.get(t)
        if kind is None:
            raise ValueError(f"arrow error: {f.name} is {t}")
        fields.append((f.name, kind + "?" * f.nullable))
    return declare(fields)


def check_compatible(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the schema's columns in its order: names and types must be the same. Integers and decimals may be narrower."""

    def fits(have: T.DataType, want: T.DataType) -> bool:
        if isinstance(have, T.DecimalType) and isinstance(want, T.DecimalType):
            return have.scale <= want.scale and have.precision - have.scale <= want.precision - want.scale
        return have == want or isinstance(have, T.IntegralType) and isinstance(want, T.LongType) or isinstance(have, T.FloatType) and isinstance(want, T.DoubleType)

    if sorted(df.columns) != sorted(schema.names):
        raise ValueError(f"schema error: columns {df.columns}, expected {schema.names}")
    df = df.select(*(f"`{name}`" for name in schema.names))
    for have, want in zip(df.schema, schema, strict=True):
        if not fits(have.dataType, want.dataType):
            raise ValueError(f"schema error: {want.name} is {have.dataType.simpleString()}, expected {want.dataType.simpleString()}")
    return df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata or {}) for f in schema))


def entries(objects: DataFrame, text: Column, order: Column) -> DataFrame:
    """(row, pos, field, kind, value, error): a row for each entry of flat objects."""
    pairs = with_entries(objects.select(order.alias("row"), text.alias("_text")), F.col("_text"), ["row"])
    cells = pairs.select("row", F.posexplode(F.arrays_zip("_keys", "_values")).alias("pos", "e")).select("row", "pos", F.col("e._keys").alias("field"), F.trim("e._values").alias("c"))
    return cells.select("row", "pos", "field", number(F.col("c")).alias("p")).select("row", "pos", "field", "p.*")


def merge(found: DataFrame) -> DataFrame:
    """(pos, field, kind, precision, scale) by first appearance: kinds merge only with themselves and null; decimals take the
    most digits on either side of the point. A table of one row a field."""
    digits = F.regexp_replace("value", r"^[+-]", "")
    decimal = F.col("kind") == "decimal"
    kinds = F.array_sort(F.collect_set(F.when(F.col("kind") != "null", F.col("kind"))))
    one = found.groupBy("field").agg(
        F.min(F.struct("row", "pos")).alias("first"),
        kinds.alias("kinds"),
        F.max(F.when(decimal, F.length(F.substring_index(digits, ".", 1)))).alias("whole"),
        F.max(F.when(decimal, F.length(F.regexp_extract(digits, r"\.(\d+)$", 1)))).alias("scale"),
        F.max("error").alias("error"),
    )
    mixed = F.raise_error(F.concat(F.lit("arrow error: "), "field", F.lit(" mixes "), F.coalesce("error", F.concat_ws(", ", "kinds")))).cast("string")
    kind = F.when((F.size("kinds") > 1) | F.col("error").isNotNull(), mixed).otherwise(F.coalesce(F.get("kinds", F.lit(0)), F.lit("null")))
    return one.select("first", "field", kind.alias("kind"), (F.col("whole") + F.col("scale")).alias("precision"), "scale")


def infer(found: DataFrame) -> T.StructType:
    """The schema of entries; every field may be null. Reads a row for each field to the driver."""
    out = []
    for r in merge(found).orderBy("first").collect():
        if r.kind == "decimal" and r.precision > 38:
            raise ValueError(f"arrow error: {r.field} needs {r.precision} digits; 38 at most")
        t = T.DecimalType(r.precision, r.scale) if r.kind == "decimal" else T.StringType() if r.kind == "null" else TYPES[r.kind]
        out.append(T.StructField(r.field, t, True, {TYPED: r.kind} if r.kind in ("uuid", "time") else {}))
    return T.StructType(out)
