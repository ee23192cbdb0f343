"""The format's fingerprint of a text in parts, so that many tasks can work on one text.

A step takes the state h and a byte b to (h xor b) * prime. The xor changes the lowest byte only, by an amount that h's lowest
byte decides, and the lowest byte of the next state depends on that of the last alone. A part of n bytes therefore takes h
to h * prime^n + c, where c is one of 256 constants, by the lowest byte of h: the part's table. Tables of neighbouring parts
join into the table of both, in order and in any grouping; the seed comes in at the very end.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.constants import FNV_PRIME, FNV_SEED

_MASK = (1 << 64) - 1
_BASES, _WORD = b"ACGT", 4
#: Pieces of a part that are worked on side by side.
_ROWS = 128
_LOW = np.arange(256, dtype=np.uint64)


def power(n: int) -> np.uint64:
    return np.uint64(pow(FNV_PRIME, n, 1 << 64))


def lowest(table: np.ndarray, n: int) -> np.ndarray:
    """The lowest byte after n bytes, by that before."""
    return ((_LOW * power(n) + table) & np.uint64(255)).astype(np.uint8)


def joined(first: np.ndarray, n: int, second: np.ndarray, m: int) -> np.ndarray:
    """The table of a part of n bytes and one of m bytes behind it."""
    return first * power(m) + second[lowest(first, n)]


def byte_tables() -> np.ndarray:
    """Tables of single bytes, a row each."""
    b = np.arange(256, dtype=np.uint64)[:, None]
    return ((_LOW ^ b) - _LOW) * np.uint64(FNV_PRIME)


@functools.cache
def steps(bases: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Tables, lowest bytes after, and length, of all words that a text is read by: four bases, or one byte."""
    single = byte_tables()
    if not bases:
        return single, np.array([lowest(t, 1) for t in single]), 1
    tables, n = [single[b] for b in _BASES], 1
    while n < _WORD:
        tables, n = [joined(a, n, single[b], 1) for a in tables for b in _BASES], n + 1
    return np.array(tables), np.array([lowest(t, n) for t in tables]), n


def table_of(raw: bytes) -> np.ndarray:
    """The table of a part; a part without bytes leaves the state as it is."""
    data = np.frombuffer(raw, np.uint8)
    digit = np.full(256, 255, np.uint8)
    digit[list(_BASES)] = range(4)
    code = digit[data]
    bases = len(data) >= _WORD and bool((code < 4).all())
    tables, after, n = steps(bases)
    words = data.astype(np.int64)
    if bases:
        count = len(data) // n
        parts = code[: count * n].reshape(count, n).astype(np.int64)
        words = parts @ (4 ** np.arange(n - 1, -1, -1))
    rows = min(_ROWS, max(1, len(words)))
    each = len(words) // rows
    here, state = np.zeros((rows, 256), np.uint64), np.tile(np.arange(256, dtype=np.uint8), (rows, 1))
    by_step = words[: rows * each].reshape(rows, each)
    for k in range(each):
        word = by_step[:, k, None]
        here *= power(n)
        here += tables[word, state]
        state = after[word, state]
    out, done = np.zeros(256, np.uint64), 0
    for r in range(rows):
        out, done = joined(out, done, here[r], each * n), done + each * n
    for w in words[rows * each :].tolist():
        out, done = joined(out, done, tables[w], n), done + n
    single = steps(False)[0]
    for b in raw[done:]:
        out, done = joined(out, done, single[b], 1), done + 1
    return out


def finished(table: np.ndarray, n: int) -> str:
    """The fingerprint of a whole text."""
    return f"{(FNV_SEED * int(power(n)) + int(table[FNV_SEED & 255])) & _MASK:016x}"


@F.arrow_udf(T.BinaryType())
def part_table(text: pa.Array) -> pa.Array:
    """The table of each text, 256 little-endian numbers of 8 bytes; null for null."""
    return pa.array([None if x is None else table_of(x.encode()).astype("<u8").tobytes() for x in text.to_pylist()], pa.binary())


@F.pandas_udf(T.BinaryType())
def joined_tables(parts: pd.Series) -> pd.Series:
    """The table of parts in order, each a struct of its size and its table."""

    def of(own) -> bytes:
        out, done = np.zeros(256, np.uint64), 0
        for p in own:
            out, done = joined(out, done, np.frombuffer(p["t"], "<u8"), p["size"]), done + p["size"]
        return out.astype("<u8").tobytes()

    return parts.map(of)


@F.pandas_udf(T.StringType())
def end(size: pd.Series, table: pd.Series) -> pd.Series:
    """The fingerprint of a text of that size and table."""
    return pd.Series([finished(np.frombuffer(t, "<u8"), int(n)) for n, t in zip(size, table, strict=True)], dtype=object)
