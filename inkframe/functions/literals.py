"""Typed literals: text to (kind, value, error), and to columns of a declared type, as native column expressions.

There are two grammars. The number grammar (``parse_number``) is for values of the bracket syntax: no leading zeros,
digit groups of three, a lower-case exponent, digits on both sides of the point. The unit grammar (``parse_unit``) is
for cells and indented values: lenient numbers, and in compat mode any other text is a string. value is the
canonical text of the literal: strings without quotes and escapes, integers and decimals without underscores, uuid
and binary without their wrapper.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .render import TYPED

#: The shapes of literals.
INT_G1 = r"^[+-]?(0|[1-9]\d*|[1-9]\d{0,2}(_\d{3})+)$"
INT_G2 = r"^[+-]?\d[\d_]*$"
FLOAT_G1 = r"^[+-]?(0|[1-9]\d*)(\.\d+)?(e[+-]?\d+)?$"
FLOAT_G2 = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DECIMAL = r"^[+-]?(0|[1-9]\d*)(\.\d+)?m$"
MINUS_ZERO = r"^-0(\.0+)?m?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
TIME = r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?$"
DATETIME = r"^(\d{4}-\d{2}-\d{2})T(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{1,6})?)([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)?$"
UUID = r"^uuid\(([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\)$"
HEX = r"^hex\((([0-9a-fA-F]{2})*)\)$"
B64 = r"^b64\((([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?)\)$"
QUOTED = r'^"[^"]*"$'
ZONED = r"([Zz]|[+-]\d\d:\d\d)$"
#: What isn't a string in a cell without quotes: keywords, literals, and texts that start as a literal and would be an error.
NOT_BARE = rf"^(?s:null|true|false|nan|[+-]?inf|(?:uuid|hex|b64)\(.*\)|.*T.*:.*|.*:.*T.*|..:..:.*|{DATE[1:-1]}|{DECIMAL[1:-1]}|[+-]?(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?|[+-]?\d+[eE][+-]?\d+)$"
#: Stand for an escaped backslash and quote while a line is split: raw control characters are errors in strings.
SLASH, QUOTE = "\x01", "\x02"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
_DAY = r"(?!0000)\d{4}-(?:(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])|(?:0[13-9]|1[0-2])-(?:29|30)|(?:0[13578]|1[02])-31)"
#: What is a plain literal of a kind in both grammars, so that a cast reads it; other kinds have bare tokens.
PLAIN = {
    "string": r'"[^"\\\x00-\x1f\x7f-\x9f]*+"',
    "bool": "true|false",
    "int": r"0|-?[1-9]\d{0,17}+",  # as many digits as always fit
    "float": r"-?(?:0|[1-9]\d*+)\.\d++(?:e-?\d++)?|nan|-?inf",
    "date": _DAY,
    "datetime_naive": rf"{_DAY}T(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d{{1,6}}+)?",
}
BARE = r'[^"\\,|\[\]{}\s\x00-\x1f\x7f-\x9f]++'
PARSED = "struct<kind:string,value:string,error:string>"


def mask(c: Column) -> Column:
    """Without escaped backslashes and quotes, so that each quote in it opens or closes a string."""
    return F.replace(F.replace(c, F.lit("\\\\"), F.lit(SLASH)), F.lit('\\"'), F.lit(QUOTE))


def _unmask(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(QUOTE), F.lit('"')), F.lit(SLASH), F.lit("\\"))


def unescape_indented(masked: Column) -> Column:
    """The content of a masked string literal; null if it has another escape than the five."""
    body = F.substring(masked, F.lit(2), F.length(masked) - 2)
    text = body
    for escape, raw in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t")):
        text = F.replace(text, F.lit(escape), F.lit(raw))
    return F.when(~text.contains("\\"), _unmask(text))


def unescape_bracketed(masked: Column) -> Column:
    """The content of a masked JSON string literal, null if it isn't one."""
    raw = F.replace(F.replace(masked, F.lit(QUOTE), F.lit('\\"')), F.lit(SLASH), F.lit("\\\\"))
    read = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]
    return F.when(masked.rlike(r"[\x00-\x1f\\]"), read).otherwise(F.substring(masked, F.lit(2), F.length(masked) - 2))


def _found(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(None).cast("string").alias("error"))


def _failed(what: str) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit(what).alias("error"))


def _or_error(kind: str, value: Column, what: str) -> Column:
    return F.when(value.isNotNull(), _found(kind, value)).otherwise(_failed(what))


def _keywords(c: Column, chain):
    return chain(c == "null", _found("null", F.lit(None))).when(c.isin("true", "false"), _found("bool", c)).when(c.isin("nan", "inf", "+inf", "-inf"), _found("float", F.ltrim(c, F.lit("+"))))


def _wrapped(c: Column, chain: Column) -> Column:
    for name, shape, kind in (("uuid", UUID, "uuid"), ("hex", HEX, "binary"), ("b64", B64, "binary")):
        inner = F.regexp_extract(c, shape, 1)
        inner = F.lower(inner) if name == "hex" else F.lower(F.hex(F.unbase64(inner))) if name == "b64" else inner
        chain = chain.when(c.startswith(f"{name}(") & c.endswith(")"), F.when(c.rlike(shape), _found(kind, inner)).otherwise(_failed(f"parse error: {name} literal")))
    date = F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")
    real = date.isNotNull() & ~c.startswith("0000")
    zoned = c.rlike(ZONED)
    chain = chain.when(c.contains("T") & c.contains(":"), F.when(c.rlike(DATETIME) & real, F.when(zoned, _found("datetime", c)).otherwise(_found("datetime_naive", c))).otherwise(_failed("parse error: datetime literal")))
    chain = chain.when(c.rlike(DATE), F.when(real, _found("date", c)).otherwise(_failed("parse error: date literal")))
    chain = chain.when(c.rlike(r"^..:..:"), F.when(c.rlike(TIME), _found("time", c)).otherwise(_failed("parse error: time literal")))
    return chain.when(c.rlike(DECIMAL), F.when(c.rlike(MINUS_ZERO), _failed("parse error: negative zero")).otherwise(_found("decimal", F.regexp_replace(c, "^\\+|m$", ""))))


def _numbers(c: Column, chain: Column, integer: str, real: str) -> Column:
    plain = F.replace(c, F.lit("_"), F.lit(""))
    whole = plain.try_cast("bigint")
    chain = chain.when(c.rlike(integer) & whole.isNotNull(), _found("int", whole))
    return chain.when(c.rlike(real) & ~c.rlike(INT_G2), _found("float", c.try_cast("double")))


def parse_unit(c: Column, mode: str = "compat") -> Column:
    """The unit grammar. c: a masked cell (see ``mask``; text without backslashes is its own mask)."""
    return unit(F.trim(c), mode)


def unit(c: Column, mode: str) -> Column:
    """``parse_unit`` of a trimmed cell. It is named many times here, so callers make it a column first."""
    chain = F.when(c == "", _found("string", c)).when(c.rlike(QUOTED), _or_error("string", unescape_indented(c), "lex error: escape"))
    chain = _keywords(c, chain.when)
    chain = _numbers(c, _wrapped(c, chain), INT_G2, FLOAT_G2)
    return chain.otherwise(_found("string", _unmask(c)) if mode == "compat" else _failed("lex error: bare text"))


def parse_number(c: Column) -> Column:
    """The number grammar. c: a masked value."""
    return number(F.trim(c))


def number(c: Column) -> Column:
    """``parse_number`` of a trimmed value; null (a missing value) is the null literal."""
    chain = F.when(c.isNull(), _found("null", F.lit(None))).when(c.rlike(QUOTED), _or_error("string", unescape_bracketed(c), "lex error: escape"))
    chain = _numbers(c, _wrapped(c, _keywords(c, chain.when)).when(c.rlike(r"^-0$"), _failed("parse error: negative zero")), INT_G1, FLOAT_G1)
    return chain.otherwise(_failed("parse error: value"))


def micros_of_datetime(text: Column) -> tuple[Column, Column]:
    """Of a datetime literal: the local time as timestamp_ntz, and the offset in minutes (of up to 23:59)."""
    offset = F.regexp_extract(text, DATETIME, 4)
    minutes = F.coalesce(F.substring(offset, 2, 2).try_cast("int"), F.lit(0)) * 60 + F.coalesce(F.substring(offset, 5, 2).try_cast("int"), F.lit(0))
    local = F.concat_ws(" ", F.regexp_extract(text, DATETIME, 1), F.regexp_extract(text, DATETIME, 2))
    return local.try_cast("timestamp_ntz"), F.when(offset.startswith("-"), -minutes).otherwise(minutes)


def uuid_bytes(text: Column) -> Column:
    """The 16 bytes of a uuid's text; null if it isn't one."""
    return F.when(F.concat(F.lit("uuid("), text, F.lit(")")).rlike(UUID), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))


def time_micros(text: Column) -> Column:
    """Microseconds of the day of a time's text; null if it isn't one."""
    part = lambda a: F.substring(text, a, 2).cast("long")
    fraction = F.rpad(F.substring(text, F.lit(10), F.length(text)), 6, "0").cast("long")
    return F.when(text.rlike(TIME), ((part(1) * 60 + part(4)) * 60 + part(7)) * 1_000_000 + fraction)


def kind_of(field: T.StructField) -> str:
    """The literal kind that a declared field takes."""
    typed, t = (field.metadata or {}).get(TYPED), field.dataType
    if typed:
        return typed
    kinds = [(T.BooleanType, "bool"), (T.IntegralType, "int"), (T.DecimalType, "decimal"), (T.FractionalType, "float"), (T.DateType, "date"), (T.TimestampNTZType, "datetime_naive"), (T.TimestampType, "datetime"), (T.BinaryType, "binary"), (T.TimeType, "time"), (T.StringType, "string")]
    for cls, kind in kinds:
        if isinstance(t, cls):
            return kind
    raise ValueError(f"schema error: {field.name} can't be {t.simpleString()}")


def _decimal(value: Column, t: T.DecimalType) -> Column:
    """Null if it doesn't fit: nothing is rounded."""
    digits = F.regexp_replace(value, r"^[+-]", "")
    fits = (F.length(F.substring_index(digits, ".", 1)) <= max(1, t.precision - t.scale)) & (F.length(F.regexp_extract(digits, r"\.(\d+)$", 1)) <= t.scale)
    return F.when(fits, value.try_cast(t))


def _instant(value: Column) -> Column:
    local, minutes = micros_of_datetime(value)
    at = F.make_timestamp_ltz(F.year(local), F.month(local), F.dayofmonth(local), F.hour(local), F.minute(local), F.date_format(local, "s.SSSSSS").cast("decimal(16,6)"), F.lit("UTC"))
    return at - F.make_interval(mins=minutes)


def _checked(found: Column, null: Column, what: Column, field: T.StructField, on_error: str) -> Column:
    """found, and null where the literal is null; else what was found instead is told, or null with on_error="null"."""
    t = field.dataType
    bad = F.concat(F.lit(f"parse error: {field.name}: {kind_of(field)} expected, found "), what)
    wrong = F.raise_error(bad).cast(t) if on_error == "fail" else F.lit(None).cast(t)
    return F.when(null, F.lit(None).cast(t) if field.nullable or on_error != "fail" else wrong).otherwise(F.coalesce(found, wrong))


def typed(parsed: Column, field: T.StructField, on_error: str = "fail") -> Column:
    """A parsed value as the declared type. A wrong kind, a null where none is allowed, and a decimal that doesn't fit are
    errors: they fail the query, or with on_error="null" give null."""
    value, kind, want, t = parsed["value"], parsed["kind"], kind_of(field), field.dataType
    if want == "datetime":
        out = _instant(value)
    elif want == "datetime_naive":
        out = micros_of_datetime(value)[0]
    elif want == "binary":
        out = F.unhex(value)
    elif want == "decimal":
        out = _decimal(value, t)
    else:
        out = value.try_cast(t)
    return _checked(F.when(kind == want, out), kind == "null", F.coalesce(parsed["error"], kind, F.lit("nothing")), field, on_error)


def plain(field: T.StructField) -> str:
    """The shape of plain literals of a field, and of null."""
    want = kind_of(field)
    digits = {"tinyint": 2, "smallint": 4, "int": 9}.get(field.dataType.simpleString(), 18)
    return "null|" + PLAIN.get(want, BARE).replace("{0,17}", f"{{0,{digits - 1}}}" if want == "int" else "{0,17}")


def found(c: Column, field: T.StructField, grammar: str = "unit", mode: str = "compat", known: Column | None = None) -> Column:
    """A trimmed, masked cell as the declared type, with the shapes of its kind only: a projection of many fields stays small
    enough to be compiled. Null if it is anything else. known: whether it has the shape ``plain`` of its field, and need not be looked at again."""
    want, t, number_like = kind_of(field), field.dataType, grammar == "number"
    if want == "string":
        quoted = c.startswith('"') & (F.locate('"', c, 2) == F.length(c))
        out = F.when(quoted, unescape_bracketed(c) if number_like else unescape_indented(c))
        if not number_like:
            out = out.when(c == "", c)
            if mode == "compat":
                number_ = c.rlike(INT_G2) & F.replace(c, F.lit("_"), F.lit("")).try_cast("bigint").isNotNull()
                out = out.when(~c.rlike(NOT_BARE) & ~number_, _unmask(c))
    elif want == "bool":
        out = F.when(c == "true", True).when(c == "false", False)
    elif want == "int":
        good = c.rlike(INT_G1) & (c != "-0") if number_like else c.rlike(INT_G2)
        out = F.when(good, F.replace(c, F.lit("_"), F.lit("")).try_cast(t))
    elif want == "float":
        out = F.when(c.isin("nan", "inf", "+inf", "-inf") | (c.rlike(FLOAT_G1 if number_like else FLOAT_G2) & ~c.rlike(INT_G2)), c.try_cast(t))
    elif want == "decimal":
        out = F.when(c.rlike(DECIMAL) & ~c.rlike(MINUS_ZERO), _decimal(F.regexp_replace(c, "^\\+|m$", ""), t))
    elif want == "date":
        out = F.when(c.rlike(DATE) & ~c.startswith("0000"), c.try_cast("date"))
    elif want == "time":
        out = F.when(c.rlike(TIME), c)
    elif want == "uuid":
        out = F.when(c.rlike(UUID), F.substring(c, 6, 36))
    elif want == "binary":
        inner = F.substring(c, F.lit(5), F.length(c) - 5)
        out = F.when(c.rlike(HEX), F.unhex(inner)).when(c.rlike(B64), F.unbase64(inner))
    else:
        zoned = c.rlike(ZONED)
        real = c.rlike(DATETIME) & ~c.startswith("0000")
        out = F.when(real & zoned, _instant(c)) if want == "datetime" else F.when(real & ~zoned, c.try_cast("timestamp_ntz"))
    if known is not None and want in PLAIN:
        quick = F.substring(c, F.lit(2), F.length(c) - 2) if want == "string" else c == "true" if want == "bool" else c.try_cast(t)
        out = F.when(known, F.when(c != "null", quick.cast(t))).otherwise(out)
    return out.cast(t)


def checked(value: Column, c: Column, field: T.StructField, grammar: str = "unit", on_error: str = "fail") -> Column:
    """What was ``found`` in a cell, a column as it is named twice; else null for a null or missing cell, where null is allowed,
    and an error."""
    null = c.isNull() | (c == "null") if grammar == "number" else c == "null"
    none = F.lit(None).cast(field.dataType)
    return F.when(value.isNotNull(), value).otherwise(_checked(none, null, F.coalesce(_unmask(c), F.lit("nothing")), field, on_error))


def read(c: Column, field: T.StructField, grammar: str = "unit", mode: str = "compat", on_error: str = "fail") -> Column:
    """``typed`` of ``unit`` or ``number`` (by grammar) of a trimmed, masked cell."""
    return checked(found(c, field, grammar, mode), c, field, grammar, on_error)


def detect_format(text: Column) -> Column:
    """bracketed, indented or typed_unit, by the first line that isn't blank."""
    start = F.regexp_replace(text, r"^[\s\uFEFF]+", "")
    line = F.regexp_extract(start, r"^([^\n]*)", 1)
    header = line.rlike(r"^\[[^\]\[]*\]\{.*\}:\s*$") | (line.rlike(r"^\[\d[^\]\[]*\]:") & ~line.startswith("[*"))
    return F.when(start.startswith("{"), "bracketed").when(start.startswith("["), F.when(header, "indented").otherwise("bracketed")).otherwise("typed_unit")


def safe_int(c: Column, overflow: str = "error") -> Column:
    """An integer (or a decimal without a fraction, for products beyond 2^63) as a double where it is exact (up to 2^53 - 1);
    beyond, an error, nan, or text as the caller says. Null stays null."""
    most = (1 << 53) - 1
    inside = (c >= -most) & (c <= most)  # there is no abs of the least bigint
    if overflow == "nan":
        return F.when(inside, c.cast("double")).when(c.isNotNull(), F.lit(float("nan")))
    if overflow == "string":
        return c.cast("string")
    return F.when(inside, c.cast("double")).when(c.isNotNull(), F.raise_error(F.lit("integer beyond 2^53")).cast("double"))
