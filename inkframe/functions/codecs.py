"""Codecs: what columns of a kind become when they are read, and what they are made of when they are written.

A codec is a pair of column functions for a kind of literal, such as "decimal" or "datetime". A registry has some for all uses;
a reader or writer takes a snapshot of it, with some replaced for its own.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .literals import kind_of

Function = Callable[[Column], Column]


class Codec(NamedTuple):
    encode: Function | None = None
    decode: Function | None = None


class Codecs:
    def __init__(self, codecs: Mapping[str, Codec] | None = None):
        self._by_kind: dict[str, Codec] = {}
        self.use(codecs or {})

    def use(self, codecs: Mapping[str, Codec]) -> None:
        for kind, codec in codecs.items():
            if not any(codec) or not all(f is None or callable(f) for f in codec):
                raise TypeError("a codec has a function to encode, to decode or both")
            self._by_kind[kind] = codec

    def snapshot(self, codecs: Mapping[str, Codec] | None = None) -> Codecs:
        """A copy that later calls of use don't change, with these replaced."""
        return Codecs({**self._by_kind, **(codecs or {})})

    def _apply(self, df: DataFrame, schema: T.StructType, which: str) -> DataFrame:
        fields = {f.name: f for f in schema.fields}

        def column(name: str) -> Column:
            f = getattr(self._by_kind.get(kind_of(fields[name]), Codec()), which) if name in fields else None
            c = F.col(f"`{name}`")
            return (F.when(c.isNotNull(), f(c)) if f else c).alias(name)

        return df.select(*map(column, df.columns))

    def decode(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """df, as it was read with the schema, with the columns decoded; nulls and other columns stay."""
        return self._apply(df, schema, "decode")

    def encode(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """df with the columns that the schema declares encoded for writing."""
        return self._apply(df, schema, "encode")


#: The registry for all uses.
CODECS = Codecs()
