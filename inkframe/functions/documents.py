"""Nested documents: a document is one row, read and written whole by a small helper in an Arrow UDF.

Flat data doesn't come here: see ``operators.rows``. A document is a list, a dict (in order, the last of equal keys
at the place of the first) or a scalar: a ``Scalar`` of kind and literal text, whose string value is unescaped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import literals as L
from .render import DELIMITERS, IDENTIFIER, write_key

DEEPEST = 256
_HEADER = re.compile(r"\[(\*|\d*)[^\]]*\](?:\{(.*)\})?:(?: (.*))?")
_ENTRY = re.compile(rf'("(?:[^"\\]|\\.)*"|{IDENTIFIER})(\[.*)?(?::(?: (.*))?)?')
_ESCAPES = {"\\": "\\", '"': '"', "n": "\n", "r": "\r", "t": "\t"}
_SHAPES = [("uuid", L.UUID, "uuid("), ("binary", L.HEX, "hex("), ("binary", L.B64, "b64(")]


class Scalar(NamedTuple):
    kind: str
    text: str


def unescape(literal: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in _ESCAPES:
            raise ValueError("lex error: escape")
        return _ESCAPES[m[1]]

    return re.sub(r"\\(.?)", one, literal[1:-1])


def scalar(text: str, grammar: str, mode: str = "compat") -> Scalar:
    """A literal; grammar is number or unit."""
    import datetime

    text = text.strip(" ")
    if text.startswith('"'):
        if not re.fullmatch(r'"(?:[^"\\]|\\.)*"', text):
            raise ValueError("lex error: string")
        return Scalar("string", json.loads(text) if grammar == "number" else unescape(text))
    if not text and grammar == "unit":
        return Scalar("string", "")
    if text in ("null", "true", "false", "nan", "inf", "+inf", "-inf"):
        return Scalar({"n": "null", "t": "bool", "f": "bool"}.get(text[0], "float") if text != "nan" else "float", text.lstrip("+"))
    for kind, shape, start in _SHAPES:
        if text.startswith(start) and text.endswith(")"):
            if re.fullmatch(shape, text):
                return Scalar(kind, text)
            raise ValueError(f"parse error: {text}")
    if ("T" in text and ":" in text) or re.match(r"^..:..:", text) or re.match(L.DATE, text):
        kind = "datetime" if "T" in text and ":" in text else "date" if re.match(L.DATE, text) else "time"
        if not re.match({"datetime": L.DATETIME, "date": L.DATE, "time": L.TIME}[kind], text) or text.startswith("0000"):
            raise ValueError(f"parse error: {text}")
        if kind != "time":
            datetime.date.fromisoformat(text[:10])
        return Scalar(kind, text)
    if re.match(L.DECIMAL, text) and not re.match(L.MINUS_ZERO, text):
        return Scalar("decimal", text)
    plain = text.replace("_", "")
    if re.match(L.INT_G1 if grammar == "number" else L.INT_G2, text) and text != "-0" * (grammar == "number") and -(1 << 63) <= int(plain) < 1 << 63:
        return Scalar("int", str(int(plain)))
    if re.match(L.FLOAT_G1 if grammar == "number" else L.FLOAT_G2, text) and not re.match(L.INT_G2, text):
        return Scalar("float", repr(float(text)).replace("e+", "e"))
    if grammar == "unit" and mode == "compat":
        return Scalar("string", text)
    raise ValueError(f"parse error: {text}")


def place(text: str, at: int) -> str:
    """Line and column of a place in a text, from 1."""
    return f"line {text.count(chr(10), 0, at) + 1}, column {at - text.rfind(chr(10), 0, at)}"


def parse_bracketed(text: str):
    if not text.strip("\ufeff \t\r\n"):
        return {}
    string, bare, space = re.compile(r'"(?:[^"\\\x00-\x1f\x7f-\x9f]|\\.)*"'), re.compile(r"[^\s,\[\]{}\"]+"), re.compile(r"[\s\ufeff]*")
    skip = lambda at: space.match(text, at).end()

    def value(at: int, depth: int):
        at = skip(at)
        if depth > DEEPEST:
            raise ValueError("parse error: too deep")
        opened = text[at : at + 1]
        if opened not in ("{", "["):
            m = (string if opened == '"' else bare).match(text, at)
            if not m:
                raise ValueError(f"parse error: value at {place(text, at)}")
            try:
                return scalar(m[0], "number"), m.end()
            except ValueError as e:
                raise ValueError(f"{e} at {place(text, at)}") from None
        out, close, first = ({}, "}", True) if opened == "{" else ([], "]", True)
        at = skip(at + 1)
        while not (first and text[at : at + 1] == close):
            if opened == "{":
                m = string.match(text, at)
                if not m or text[skip(m.end()) : skip(m.end()) + 1] != ":":
                    raise ValueError(f"parse error: key at {place(text, at)}")
                out[json.loads(m[0])], at = value(skip(m.end()) + 1, depth + 1)
            else:
                item, at = value(at, depth + 1)
                out.append(item)
            at, first = skip(at), False
            if text[at : at + 1] == close:
                break
            if text[at : at + 1] != ",":
                raise ValueError(f"parse error: comma at {place(text, at)}")
            at = skip(at + 1)
        return out, at + 1

    out, at = value(0, 0)
    if skip(at) != len(text):
        raise ValueError(f"parse error: text after the end at {place(text, skip(at))}")
    return out


def split_cells(line: str, delimiter: str) -> list[str]:
    d = re.escape(delimiter)
    if not re.fullmatch(rf'(?:[^"]|"(?:[^"\\]|\\.)*")*', line):
        raise ValueError("lex error: unclosed quote")
    return re.findall(rf'((?:[^"{d}]|"(?:[^"\\]|\\.)*")*){d}', line + delimiter)


def _lines(text: str) -> list[tuple[int, str]]:
    raw = [line for line in text.lstrip("\ufeff").split("\n") if line.strip()]
    unit = next((len(line) - len(line.lstrip(" ")) for line in raw if line.startswith(" ")), 2)
    return [((len(line) - len(line.lstrip(" "))) // unit, line.strip(" \r")) for line in raw]


def parse_indented(text: str, mode: str = "compat"):
    lines = _lines(text)
    if not lines:
        return {}
    unit = lambda cell: scalar(cell, "unit", mode)

    def array(i: int, header: str, depth: int):
        m = _HEADER.fullmatch(header)
        if not m:
            raise ValueError(f"parse error: header {header}")
        mark = header[1 + len(m[1]) : header.index("]")]
        delimiter = {"": ",", ",": ",", "\t": "\t", "\\t": "\t"}.get(mark, "|")
        exact = None if m[1] == "*" else int(m[1] or 0)
        if m[2] is not None:
            names = [unescape(n) if n.startswith('"') else n for n in (n.strip() for n in split_cells(m[2], delimiter))]
            rows = []
            while i < len(lines) and (lines[i][0] > depth or depth < 0):
                cells = split_cells(lines[i][1], delimiter)
                if len(cells) != len(names):
                    raise ValueError("parse error: width of a row")
                rows.append(dict(zip(names, map(unit, cells), strict=True)))
                i += 1
            if exact not in (None, len(rows)) or exact is None and not rows:
                raise ValueError("validate error: number of rows")
            return rows, i
        if m[3]:
            return [unit(c) for c in split_cells(m[3], delimiter)], i
        if depth < 0 and not (i < len(lines) and re.match("-( |$)", lines[i][1])):
            rows = [[unit(c) for c in split_cells(line, delimiter)] for _, line in lines[i:]]
            if exact not in (None, len(rows)) or exact is None and not rows:
                raise ValueError("validate error: number of rows")
            return rows, len(lines)
        if i < len(lines) and lines[i][0] > depth:
            return block(i, lines[i][0])
        return [], i

    def entry(i: int, line: str, depth: int, out: dict) -> int:
        m = _ENTRY.fullmatch(line)
        if not m or m[2] is None and ":" not in line:
            raise ValueError(f"parse error: {line}")
        key = unescape(m[1]) if m[1].startswith('"') else m[1]
        if line[len(m[1]) :].startswith("["):
            out[key], i = array(i, line[len(m[1]) :], depth)
        elif m[3] is not None:
            out[key] = [] if m[3] == "[]" else unit(m[3])
        elif i < len(lines) and lines[i][0] > depth:
            out[key], i = block(i, lines[i][0])
        else:
            out[key] = {}
        return i

    def block(i: int, depth: int):
        if depth > DEEPEST:
            raise ValueError("parse error: too deep")
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out = []
            while i < len(lines) and lines[i][0] == depth and lines[i][1].startswith("-"):
                item, i = lines[i][1][2:], i + 1
                if re.match(rf'(?:{IDENTIFIER}|"(?:[^"\\]|\\.)*")(?:\[[^\]]*\](?:\{{.*\}})?)?:(?: |$)', item):
                    one: dict = {}
                    i = entry(i, item, depth + 1, one)
                    while i < len(lines) and lines[i][0] == depth + 1:
                        i = entry(i + 1, lines[i][1], depth + 1, one)
                    out.append(one)
                else:
                    out.append(unit(item))
            return out, i
        found: dict = {}
        while i < len(lines) and lines[i][0] == depth:
            i = entry(i + 1, lines[i][1], depth, found)
        return found, i

    first = lines[0][1]
    if first == "[]" and len(lines) == 1:
        return []
    if _HEADER.fullmatch(first):
        out, i = array(1, first, -1)
    elif len(lines) == 1 and not _ENTRY.fullmatch(first) and not first.startswith("- "):
        if "," in first and not first.startswith('"'):
            raise ValueError("parse error: cells without a header")
        return unit(first)
    elif len(lines) == 1 and ":" not in first and not first.startswith("- "):
        return unit(first)
    else:
        out, i = block(0, 0)
    if i != len(lines):
        raise ValueError(f"parse error: {lines[i][1]}")
    return out


def _indented_string(s: str) -> str:
    if re.search(L.CONTROL, s):
        raise ValueError("serialize error: control character in a string")
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t") + '"'


def render_bracketed(node) -> str:
    if isinstance(node, Scalar):
        return re.sub(r"\\u00(..)", lambda m: "\\u00" + m[1].upper(), json.dumps(node.text, ensure_ascii=False)) if node.kind == "string" else node.text
    if isinstance(node, dict):
        return "{" + ", ".join(f"{json.dumps(k, ensure_ascii=False)}: {render_bracketed(v)}" for k, v in node.items()) + "}"
    return "[" + ", ".join(map(render_bracketed, node)) + "]"


def render_indented(node, delimiter: str = ",", indent: int = 2) -> str:
    mark, between, join = DELIMITERS[delimiter]
    cell = lambda v: _indented_string(v.text) if v.kind == "string" else v.text
    out: list[str] = []

    def items(key: str, node: list, depth: int, pad: str) -> None:
        names = list(node[0]) if node and isinstance(node[0], dict) else []
        if names and all(isinstance(r, dict) and list(r) == names and all(isinstance(v, Scalar) for v in r.values()) for r in node):
            out.append(f"{pad}{key}[{len(node)}{mark}]{{{between.join(map(write_key, names))}}}:")
            out.extend(" " * (depth * indent) + join.join(map(cell, r.values())) for r in node)
        elif node and all(isinstance(v, Scalar) for v in node):
            out.append(f"{pad}{key}[{len(node)}{mark}]: " + join.join(map(cell, node)))
        elif not node:
            out.append(f"{pad}{key}: []" if key else "[]")
        else:
            if key:
                out.append(f"{pad}{key}[{len(node)}]:")
            for item in node:
                lead = " " * (depth * indent) + "- "
                if isinstance(item, Scalar):
                    out.append(lead + cell(item))
                elif isinstance(item, dict) and item:
                    for n, (k, v) in enumerate(item.items()):
                        entry(k, v, depth + 1, " " * ((depth + 1) * indent) if n else lead)
                else:
                    raise ValueError("serialize error: a list or an empty object in a list")

    def entry(k: str, v, depth: int, pad: str) -> None:
        if isinstance(v, Scalar):
            out.append(f"{pad}{write_key(k)}: {cell(v)}")
        elif isinstance(v, list):
            items(write_key(k), v, depth + 1, pad)
        else:
            out.append(f"{pad}{write_key(k)}:")
            for k2, v2 in v.items():
                entry(k2, v2, depth + 1, " " * ((depth + 1) * indent))

    if isinstance(node, Scalar):
        out.append(cell(node))
    elif isinstance(node, dict):
        for k, v in node.items():
            entry(k, v, 0, "")
    else:
        items("", node, 0, "")
    return "".join(line + "\n" for line in out)


def parse_any(text: str, mode: str = "compat"):
    """Brackets that aren't a table header: the bracket syntax; else the indented one."""
    start = text.lstrip("\ufeff \t\r\n")
    line = start.split("\n", 1)[0].strip()
    return parse_bracketed(text) if start.startswith("{") or start.startswith("[") and not _HEADER.fullmatch(line) else parse_indented(text, mode)


def _udf(operation: str, source: str, parse: Callable, render: Callable, on_error: str):
    """An error says what was being done, whether the text was read or written, and of which syntax the text is."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            phase = "parse"
            try:
                node = None if t is None else parse(t)
                phase = "serialize"
                out.append(None if t is None else render(node))
            except (ValueError, RecursionError) as e:
                if on_error == "fail":
                    raise ValueError(f"transcode error: {operation}, {phase}, {source}: {e}") from e
                out.append(None)
        return pa.array(out, pa.string())

    return run


def bracketed_to_indented(c: Column, delimiter: str = ",", indent: int = 2, on_error: str = "fail") -> Column:
    """Transcodes documents; strict. Null stays null; with on_error="null" so does what can't be read."""
    return _udf("bracketed_to_indented", "bracketed", parse_bracketed, lambda n: render_indented(n, delimiter, indent), on_error)(c)


def indented_to_bracketed(c: Column, mode: str = "compat", on_error: str = "fail") -> Column:
    return _udf("indented_to_bracketed", "indented", lambda t: parse_indented(t, mode), render_bracketed, on_error)(c)


def canonical(c: Column, mode: str = "compat", on_error: str = "fail") -> Column:
    """Either syntax to the bracket syntax."""
    return _udf("canonical", "any", lambda t: parse_any(t, mode), render_bracketed, on_error)(c)
