"""Rows of typed text to typed columns, natively: lines of tables and flat objects."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.literals import checked, found, mask, plain, unescape_bracketed
from ..functions.render import IDENTIFIER, write_key

#: A table's header: count (or *), delimiter and names.
HEADER = re.compile(r"\[(\d*|\*)(,|\t|\\?\||\\t)?\]\{(.*)\}:\s*")
_STRING = '"[^"]*+"'
#: Control characters but for those that stand for escapes, and tabs, line feeds and returns.
#: One by one, as a class of single characters is a table lookup and one of ranges isn't.
_CONTROLS = "".join(rf"\x{i:02x}" for i in (*range(0x20), *range(0x7F, 0xA0)) if i not in (1, 2, 9, 10, 13))
_PAIR = rf'"[^"]*+"\s*+:\s*+(?:{_STRING}|[^",\[\]{{}}\s][^",\[\]{{}}]*+)'


def header(line: str) -> tuple[int | None, str, list[str]] | None:
    """(count, None if it is *; delimiter; names) of a header line, else None."""
    m = HEADER.fullmatch(line.lstrip("\ufeff").strip(" "))
    if not m:
        return None
    delimiter = {"": ",", ",": ",", "\\t": "\t", "\t": "\t"}.get(m[2] or "", "|")
    names = [n.strip() for n in re.findall(rf'\s*("(?:[^"\\]|\\.)*"|[^{re.escape(delimiter)}]*)(?:{re.escape(delimiter)}|$)', m[3])]
    names = names[:-1] if names and not names[-1] else names
    return (None if m[1] == "*" else int(m[1] or 0)), delimiter, [n[1:-1].replace('\\"', '"').replace("\\\\", "\\") if n.startswith('"') else n for n in names]


def split_row(line: Column, delimiter: str = ",") -> Column:
    """Masked cells of a line, with delimiters in strings left alone; null if a quote stays open."""
    return _cells(F.concat(mask(line), F.lit(delimiter)), delimiter)


def _cells(masked: Column, delimiter: str, controls: str = "") -> Column:
    """Null if a quote stays open, or if there is any of these characters. Where no string has a delimiter in it, a plain split will do."""
    d = re.escape(delimiter)
    line = lambda inside: rf'^(?:[^"{d}{controls}]*+(?:"[^"{inside}{controls}]*+"[^"{d}{controls}]*+)*+{d})++$'
    last = F.length(masked) - 1
    return F.when(masked.rlike(line(d)), F.split(F.substring(masked, F.lit(1), last), d)).when(masked.rlike(line("")), F.regexp_extract_all(masked, F.lit(rf'([^"{d}]*+(?:{_STRING}[^"{d}]*+)*+){d}'), F.lit(1)))


#: Between the cells of a plain row: no text that can be read has it.
_BETWEEN = "\x03"


def plain_line(shapes: Sequence[str], delimiter: str) -> str:
    """The shape of a line whose cells have these shapes, a group each."""
    return rf"\A *+{rf' *+{re.escape(delimiter)} *+'.join(f'({shape})' for shape in shapes)} *+\z"


def _with_plain(df: DataFrame, text: str, shape: str, n: int, keep: Sequence[str]) -> DataFrame:
    """The kept columns, text, and _plain: the n groups of a shape that fits the whole text, from the second place on; null
    if it doesn't fit. It is looked at once."""
    marked = F.regexp_replace(text, shape, "".join(f"{_BETWEEN}${i + 1}" for i in range(n)))
    found = df.select(*keep, text, F.when(~F.col(text).contains(_BETWEEN), F.split(marked, _BETWEEN)).alias("_plain"))
    return found.select(*keep, text, F.when(F.size("_plain") == n + 1, F.col("_plain")).alias("_plain"))


def _finish(cells: DataFrame, schema: T.StructType, grammar: str, mode: str, on_error: str, keep: Sequence[str]) -> DataFrame:
    """cells: the kept columns, _known, and a trimmed literal for each field. Each step is a projection of its own, so that
    nothing is parsed twice: Spark doesn't merge projections of what is used several times."""
    values = cells.select(*keep, *(c for i, f in enumerate(schema.fields) for c in (f"_c{i}", found(F.col(f"_c{i}"), f, grammar, mode, F.col("_known")).alias(f"_v{i}"))))
    return values.select(*keep, *(checked(F.col(f"_v{i}"), F.col(f"_c{i}"), f, grammar, on_error).alias(f.name, metadata=f.metadata or {}) for i, f in enumerate(schema.fields)))


def line_rows(df: DataFrame, line: Column, schema: T.StructType, delimiter: str = ",", mode: str = "compat", on_error: str = "fail", keep: Sequence[str] = ()) -> DataFrame:
    """The columns of a table's lines; every line must have a cell for each field. keep: columns of df that stay. Lines of
    plain literals are taken apart by one pattern; all others cell by cell, with the same result."""
    n = len(schema.fields)
    lines = _with_plain(df.select(*keep, line.alias("_line")), "_line", plain_line([plain(f) for f in schema.fields], delimiter), n, keep)
    other = F.col("_plain").isNull()
    lines = lines.select(*keep, "_line", "_plain", F.when(other, F.concat(mask(F.col("_line")), F.lit(delimiter))).alias("_masked"))
    lines = lines.select(*keep, "_line", "_plain", F.when(other & ~F.col("_line").rlike("[\x01\x02]"), _cells(F.col("_masked"), delimiter, _CONTROLS)).alias("_cells"))
    wrong = F.raise_error(F.concat(F.lit(f"parse error: {n} cells expected: "), "_line")).cast("array<string>") if on_error == "fail" else F.lit(None).cast("array<string>")
    good = F.coalesce(F.size("_cells") == n, F.lit(False))
    lines = lines.select(*keep, "_plain", F.when(other, F.when(good, F.col("_cells")).otherwise(wrong)).alias("_cells"))
    cells = lines.select(*keep, (~other).alias("_known"), *(F.coalesce(F.get("_plain", F.lit(i + 1)), F.trim(F.get("_cells", F.lit(i)))).alias(f"_c{i}") for i in range(n)))
    return _finish(cells, schema, "unit", mode, on_error, keep)


def _entries(masked: Column) -> tuple[Column, Column]:
    """Of flat objects, the keys (null of anything else) and the masked values."""
    flat = masked.rlike(rf"^\s*\{{\s*(?:{_PAIR}\s*(?:,\s*{_PAIR}\s*)*+)?\}}\s*$")
    pairs = lambda key, i: F.regexp_extract_all(masked, F.lit(rf'{key}\s*+:\s*+({_STRING}|[^",\[\]{{}}\s][^",\[\]{{}}]*+)'), F.lit(i))
    # without escapes the keys are as they stand
    keys = F.when(masked.rlike(r"[\x00-\x1f\\]"), F.transform(pairs('("[^"]*+")', 1), unescape_bracketed)).otherwise(pairs('"([^"]*+)"', 1))
    return F.when(flat, keys), pairs('"[^"]*+"', 1)


def with_entries(df: DataFrame, obj: Column, keep: Sequence[str] = ()) -> DataFrame:
    """The kept columns, _obj, and of flat objects _keys (null of anything else) and _values (masked)."""
    out = df.select(*keep, obj.alias("_obj")).select(*keep, "_obj", mask(F.col("_obj")).alias("_masked"))
    keys, values = _entries(F.col("_masked"))
    return out.select(*keep, "_obj", keys.alias("_keys"), values.alias("_values"))


def object_rows(df: DataFrame, obj: Column, schema: T.StructType, mode: str = "compat", on_error: str = "fail", keep: Sequence[str] = ()) -> DataFrame:
    """The columns of flat objects, by name: missing names are null, and of equal names the last counts; other names are
    skipped, or an error in strict mode. Objects of plain literals whose names are the schema's in its order are taken apart
    by one pattern; all others entry by entry, with the same result."""
    n, names = len(schema.fields), F.array(*map(F.lit, schema.names))
    out = df.select(*keep, obj.alias("_obj"))
    if n and all(re.fullmatch(IDENTIFIER, name) for name in schema.names):
        pairs = " *+, *+".join(rf'"{f.name}" *+: *+({plain(f)})' for f in schema.fields)
        out = _with_plain(out, "_obj", rf"\A *+\{{ *+{pairs} *+\}} *+\z", n, keep)
    else:
        out = out.select(*keep, "_obj", F.lit(None).cast("array<string>").alias("_plain"))
    other = F.col("_plain").isNull()
    out = out.select(*keep, "_obj", "_plain", F.when(other, mask(F.col("_obj"))).alias("_masked"))
    keys, values = _entries(F.col("_masked"))
    pairs = out.select(*keep, "_obj", "_plain", F.when(other, keys).alias("_keys"), F.when(other, values).alias("_values"))
    good = F.col("_keys").isNotNull()
    if mode == "strict":
        good = good & (F.size(F.array_except("_keys", names)) == 0)
    wrong = F.raise_error(F.concat(F.lit("parse error: not a flat object of the schema: "), F.coalesce("_obj", F.lit("null")))).cast("array<string>") if on_error == "fail" else F.lit(None).cast("array<string>")
    # reversed, so that the first place of a name is its last value
    own = F.when(other, F.reverse(F.when(F.coalesce(good, F.lit(False)), F.col("_keys")).otherwise(wrong)))
    pairs = pairs.select(*keep, "_plain", own.alias("_keys"), F.reverse("_values").alias("_values"))
    at = lambda name: F.nullif(F.array_position("_keys", name), F.lit(0))
    cells = pairs.select(*keep, (~other).alias("_known"), *(F.coalesce(F.get("_plain", F.lit(i + 1)), F.trim(F.get("_values", (at(f.name) - 1).cast("int")))).alias(f"_c{i}") for i, f in enumerate(schema.fields)))
    return _finish(cells, schema, "number", mode, on_error, keep) if n else pairs.select(*keep)


def objects_of_array(text: Column) -> Column:
    """The flat objects of a bracketed list, as texts; null if there is anything else in it."""
    masked = F.regexp_replace(mask(text), r"^[\s\uFEFF]+|\s+$", "")
    obj = rf'\{{[^{{}}"]*+(?:{_STRING}[^{{}}"]*+)*+\}}'
    found = F.regexp_extract_all(masked, F.lit(rf"({obj})"), F.lit(1))
    rest = F.regexp_replace(F.regexp_replace(masked, obj, "o"), r"\s", "")
    unmask = lambda x: F.replace(F.replace(x, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(rest.rlike(r"^\[(o(,o)*)?\]$"), F.transform(found, unmask))


def inline_array(text: Column, delimiter: str = ",") -> Column:
    """The cells of `name[N]: a, b` or `[N]: a, b`, masked; an empty list has none."""
    body = F.regexp_extract(text, rf"^(?:{IDENTIFIER})?\[\d*[^\]]*\]:(.*)$", 1)
    return F.when(F.trim(body) == "", F.array().cast("array<string>")).otherwise(split_row(body, delimiter))


def embedded_table(text: Column, key: str) -> Column:
    """The lines of the table that stands under a key of the outermost block of an indented document, without its header; null if there is none."""
    block = F.regexp_extract(text, rf"(?:^|\n){re.escape(write_key(key))}\[[^\]\n]*\]\{{[^\n]*\}}:[ \r]*\n((?:[ ]+[^\n]*(?:\n|$)|[ \r]*\n)*)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r$", ""))), lambda x: x != "")
    return F.when(text.rlike(rf"(?:^|\n){re.escape(write_key(key))}\[[^\]\n]*\]\{{[^\n]*\}}:"), lines)
