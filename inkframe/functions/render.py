"""Typed values as text: cells, rows and headers of both syntaxes, as native column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: For each delimiter its mark in a header, between names, and between cells.
DELIMITERS = {",": ("", ",", ", "), "\t": ("\t", "\t", "\t"), "|": ("|", "|", "|")}
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
TYPED = "typed"  # the field metadata that tells uuid and time from other strings


def quote_bracketed(c: Column) -> Column:
    """A JSON string: the short escapes, and \\u00XX for other control characters."""
    text = F.to_json(F.array(c))
    return F.when(c.rlike(r'[\x00-\x1f"\\]'), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def quote_indented(c: Column) -> Column:
    """Five escapes; other control characters are an error."""
    out = c
    for raw, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escape))
    bad = c.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
    escaped = F.when(bad, F.raise_error(F.lit("serialize error: control character in a string")).cast("string")).otherwise(F.concat(F.lit('"'), out, F.lit('"')))
    return F.when(c.rlike(r'[\x00-\x1f"\\\x7f-\x9f]'), escaped).otherwise(F.concat(F.lit('"'), c, F.lit('"')))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is made once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _digits(size: Column) -> Column:
    """Of a finite double above 0: the fewest digits m and a power q, so that m * 10^q reads back as the same double. Java before 19
    may write a digit or two too many: they are dropped where what is left reads back as the same double."""

    text = size.cast("string")
    mantissa, power = F.substring_index(text, "E", 1), F.coalesce(F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
    given = F.struct(F.regexp_replace(mantissa, r"\.", "").cast("decimal(38,0)").alias("m"), (power - F.length(F.substring_index(mantissa, ".", -1))).alias("q"))

    def fewest(d: Column) -> Column:
        less = [F.struct(F.floor((d["m"] + half) / 10**k).cast("decimal(38,0)").alias("m"), (d["q"] + k).alias("q")) for k in (1, 2) for half in (0, 5 * 10 ** (k - 1))]
        return F.element_at(F.filter(F.array(d, *less), lambda x: F.concat(x["m"].cast("string"), F.lit("E"), x["q"].cast("string")).try_cast("double") == size), -1)

    def trimmed(d: Column) -> Column:
        digits = d["m"].cast("string")
        kept = F.regexp_replace(digits, r"(?<=.)0+$", "")
        return F.struct(kept.alias("m"), (d["q"] + F.length(digits) - F.length(kept)).alias("q"))

    return _let(_let(given, fewest), trimmed)


def _plain_or_exponent(size: Column, d: Column) -> Column:
    m, q, n = d["m"], d["q"], F.length(d["m"])
    point = n + q  # digits in front of it
    plain = (
        F.when(q >= 0, F.concat(m, F.repeat(F.lit("0"), q), F.lit(".0")))
        .when(point > 0, F.concat(F.substring(m, F.lit(1), point), F.lit("."), F.substring(m, point + 1, n)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), m))
    )
    exponent = F.concat(F.substring(m, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(m, F.lit(2), n))).otherwise(""), F.lit("e"), (point - 1).cast("string"))
    return F.when((size >= 1e-5) & (size < 1e16), plain).otherwise(exponent)


def render_float(c: Column) -> Column:
    """Shortest digits that read back as the same double; plain from 1e-5 to 1e16, else with an exponent; nan, inf, -inf."""
    c = c.cast("double")
    size, text = F.abs(c), c.cast("string")
    return (
        F.when(F.isnan(c), "nan")
        .when(size == F.lit(float("inf")), F.when(c > 0, "inf").otherwise("-inf"))
        .when((size == 0) | ((size >= 1e-3) & (size < 1e7) & (F.length(text) < 17)), text)  # so few digits are the shortest
        .when(c.isNotNull(), F.concat(F.when(c < 0, "-").otherwise(""), _let(_digits(size), lambda d: _plain_or_exponent(size, d))))
    )


def _moment(c: Column) -> Column:
    """Date and time; of a second none, three or six digits. It is formatted once."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"(?:\.000000|000)$", "")


def uuid_text(c: Column) -> Column:
    """16 bytes as the text of a uuid; other lengths are an error."""
    h = F.lower(F.hex(c))
    text = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(F.octet_length(c) == 16, text).when(c.isNotNull(), F.raise_error(F.lit("arrow error: a uuid has 16 bytes")).cast("string"))


def time_text(micros: Column) -> Column:
    """Microseconds of a day as hours, minutes, seconds, and a fraction without zeros at its end; beyond a day an error."""
    part = lambda unit, most: F.lpad(F.pmod(F.floor(micros / unit), F.lit(most)).cast("string"), 2, "0")
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")), r"\.?0+$", "")
    text = F.concat(part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), fraction)
    return F.when((micros >= 0) & (micros < 86_400_000_000), text).when(micros.isNotNull(), F.raise_error(F.lit("arrow error: a time of day beyond the day")).cast("string"))


def render_cell(c: Column, field: T.StructField, syntax: str = "indented", binary_format: str = "hex") -> Column:
    """The literal of a flat value; null is the keyword."""
    kind, typed = field.dataType, (field.metadata or {}).get(TYPED)
    if typed == "uuid":
        out = F.concat(F.lit("uuid("), uuid_text(c) if isinstance(kind, T.BinaryType) else F.lower(c), F.lit(")"))
    elif typed == "time" and isinstance(kind, T.IntegralType):
        out = time_text(c)
    elif typed == "time":
        out = F.regexp_replace(F.regexp_replace(c, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        out = quote_indented(c) if syntax == "indented" else quote_bracketed(c)
    elif isinstance(kind, (T.BooleanType, T.IntegralType)):
        out = c.cast("string")
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        out = render_float(c)
    elif isinstance(kind, T.DecimalType):
        out = F.concat(c.cast("string"), F.lit("m"))
    elif isinstance(kind, T.TimeType):
        out = c.cast("string")  # without zeros at the end
    elif isinstance(kind, T.DateType):
        out = F.date_format(c, "yyyy-MM-dd")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = F.concat(_moment(c), F.lit("Z")) if isinstance(kind, T.TimestampType) else _moment(c)
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("hex("), F.lower(F.hex(c)), F.lit(")")) if binary_format == "hex" else F.concat(F.lit("b64("), F.base64(c), F.lit(")"))
    elif isinstance(kind, T.NullType):
        out = F.lit(None).cast("string")
    else:
        raise ValueError(f"serialize error: unsupported type {kind.simpleString()} of column {field.name}")
    return F.coalesce(out, F.lit("null"))


def _utc(df: DataFrame) -> DataFrame:
    if df.sparkSession.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        raise ValueError("zoned times are written in UTC: set spark.sql.session.timeZone to UTC")
    return df


def write_key(name: str) -> str:
    """Bare if an identifier, else quoted."""
    return name if re.fullmatch(IDENTIFIER, name) else '"' + name.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def table_header(names: list[str], count: int | str = "*", delimiter: str = ",") -> str:
    mark, between, _ = DELIMITERS[delimiter]
    return f"[{count}{mark}]{{{between.join(map(write_key, names))}}}:"


def line_of(df: DataFrame, delimiter: str = ",", binary_format: str = "hex") -> Column:
    """A row of df as a line of a table."""
    cells = [render_cell(_utc(df)[f.name], f, "indented", binary_format) for f in df.schema.fields]
    return F.concat_ws(DELIMITERS[delimiter][2], *cells)


def object_of(df: DataFrame, binary_format: str = "hex") -> Column:
    """A row of df as an object."""
    parts = []
    for i, f in enumerate(df.schema.fields):
        key = '"' + write_key(f.name).strip('"') + '": '
        parts += [F.lit((", " if i else "{") + key), render_cell(_utc(df)[f.name], f, "bracketed", binary_format)]
    return F.concat(*parts, F.lit("}")) if parts else F.lit("{}")
