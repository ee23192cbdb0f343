"""Bits of bytes and repeats in bit strings, as column expressions inside Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.constants import QUATERNARY, SEGMENT_HEX

_DIGITS, _LETTERS = "0123456789ABCDEF", "ghijklmnopqrstuv"


def _spelled(hexadecimal: Column, words: list[str]) -> Column:
    """Each hexadecimal digit as a word. Digits become letters first, so that no word is replaced again."""
    out = F.translate(hexadecimal, _DIGITS, _LETTERS)
    for letter, word in zip(_LETTERS, words, strict=True):
        out = F.replace(out, F.lit(letter), F.lit(word))
    return out


def hex_bits(hexadecimal: Column) -> Column:
    return _spelled(hexadecimal, [f"{k:04b}" for k in range(16)])


def segment_bits(hexadecimal: Column) -> Column:
    """hex_bits() of one segment's digits: 15 at a time as numbers, which takes half the time."""
    parts = []
    for first in range(1, SEGMENT_HEX + 1, 15):
        digits = F.substring(hexadecimal, first, 15)
        parts.append(F.coalesce(F.lpad(F.conv(digits, 16, 2), 4 * F.length(digits), F.lit("0")), F.lit("")))
    return F.concat(*parts)


def bytes_to_bits(payload: Column) -> Column:
    """A binary as '0' and '1', most significant bit first."""
    return hex_bits(F.hex(payload))


def quaternary(payload: Column) -> Column:
    """A binary at two bits a nucleotide, without a code table."""
    return _spelled(F.hex(payload), [QUATERNARY[f"{k:04b}"[:2]] + QUATERNARY[f"{k:04b}"[2:]] for k in range(16)])


def nonoverlap_count(s: Column, p: Column) -> Column:
    """Occurrences of p in s, left to right without overlap; 0 for an empty p."""
    return F.when(F.length(p) > 0, F.floor((F.length(s) - F.length(F.replace(s, p, F.lit("")))) / F.length(p))).otherwise(0).cast("bigint")


def _longest(s: str, test: str) -> str:
    """The largest length from 3 to half of s that passes `test` (on {m}), by binary search: tests hold for all shorter
    lengths too. Nine steps are enough for 500 bits."""
    m = "CAST((a.lo + a.hi) DIV 2 AS INT)"
    return (
        f"aggregate(sequence(1, 9), named_struct('lo', 3, 'hi', CAST(length({s}) DIV 2 AS INT), 'best', 0), (a, k) -> CASE WHEN a.lo > a.hi THEN a "
        f"WHEN {test.format(s=s, m=m)} THEN named_struct('lo', {m} + 1, 'hi', a.hi, 'best', {m}) ELSE named_struct('lo', a.lo, 'hi', {m} - 1, 'best', a.best) END, a -> a.best)"
    )


def longest_prefix(s: str) -> Column:
    """Length of the longest prefix of column s that occurs again without overlap; 0 if none has three bits."""
    return F.expr(_longest(s, "locate(left({s}, {m}), {s}, {m} + 1) > 0"))


def longest_suffix(s: str) -> Column:
    """Length of the longest suffix of column s that occurs before without overlap; 0 if none has three bits."""
    return F.expr(_longest(s, "locate(right({s}, {m}), {s}) BETWEEN 1 AND length({s}) - 2 * {m} + 1"))
