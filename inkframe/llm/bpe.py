"""Operator 6: byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

``encoder(path, pattern)`` and ``decoder(path, pattern)`` make column functions: text to array<int>,
and array<int> to binary; ``round_trip(path, pattern)`` makes one that does both, so that no text is encoded twice. Long texts are split at places where the pattern can't match across, so that
the library never holds more than a bounded piece; the ids are those of the whole text.

Null text: no ids (an empty array); empty text: the same. Null ids decode to no bytes. Ids that are not
in the rank file fail. Repeated rows and further columns are left as they are.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts beyond this many characters are split.
PIECE = 200_000
#: White space runs beyond this are encoded apart: the library's matcher backtracks on a stack.
RUN = 4_000
#: A match of the pattern never goes from a character that isn't white space to one that is.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BEFORE_SPACE = regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])")
_BOUNDARY = regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=\p{{L}})(?=\p{{N}})|(?<=\p{{N}})(?=[^{_SPACE}\p{{L}}\p{{N}}])")
_RUN = regex.compile(rf"[{_SPACE}]{{{RUN},}}")

_loaded: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The library's encoding for a rank file, once a process."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def pieces(text: str, boundary=_BOUNDARY, limit: int = PIECE) -> Iterator[str]:
    """The text in pieces of about limit characters, cut at matches of the boundary only."""
    at = 0
    while len(text) - at > limit:
        cut = boundary.search(text, at + limit)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str) -> list[np.ndarray]:
    """Ids of a text, in parts.

    In a run of white space before other text, the pattern leaves the last character to what follows
    it; so a long run is one match without that character, and at the end of the text the whole run is.
    """
    out = []
    for piece in pieces(text) if len(text) > PIECE else (text,):
        at = 0
        for m in _RUN.finditer(piece) if len(piece) > RUN else ():
            end = m.end() if m.end() == len(piece) else m.end() - 1
            out.append(enc.encode_to_numpy(piece[at : m.start()], disallowed_special=()))
            out.append(np.array(enc._core_bpe.encode_single_piece(piece[m.start() : end].encode()), dtype=np.uint32))
            at = end
        out.append(enc.encode_to_numpy(piece[at:], disallowed_special=()))
    return out


def _encode(enc, texts: pa.Array) -> pa.ListArray:
    offsets, parts = [0], []
    for text in texts:
        got = encode_text(enc, text.as_py() or "")
        parts += got
        offsets.append(offsets[-1] + sum(map(len, got)))
    ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))


def _decode(enc, ids: pa.Array) -> pa.Array:
    return pa.array([enc.decode_bytes(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in ids], pa.binary())


def encoder(path: str, pattern: str) -> Callable[[Column], Column]:
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return _encode(encoding(path, pattern), texts)

    return encode


def decoder(path: str, pattern: str) -> Callable[[Column], Column]:
    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        return _decode(encoding(path, pattern), ids)

    return decode


def round_trip(path: str, pattern: str) -> Callable[[Column], Column]:
    """Text to its ids and the bytes that these decode to."""

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        enc = encoding(path, pattern)
        ids = _encode(enc, texts)
        return pa.StructArray.from_arrays([ids, _decode(enc, ids)], names=["ids", "decoded"])

    return both
