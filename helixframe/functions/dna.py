"""Columns of nucleotides: addresses, constraints, fingerprints."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.constants import ADDRESS_NT, ADDRESSES, END_NT, FNV_PRIME, FNV_SEED, PAYLOAD_NT, PRIMER_LEFT, PRIMER_RIGHT
from helixframe.functions import folds


def address(block_id: Column) -> Column:
    """Nine base-4 digits in A, C, G, T; numbers wrap at 4 ** 9."""
    return F.translate(F.lpad(F.conv((block_id % ADDRESSES).cast("string"), 10, 4), ADDRESS_NT, "0"), "0123", "ACGT")


def strand(block_id: Column, payload: Column) -> Column:
    return F.concat(F.lit(PRIMER_LEFT), address(block_id), F.rpad(payload, PAYLOAD_NT, "A"), F.lit(PRIMER_RIGHT))


def gc_count(dna: Column) -> Column:
    return (F.length(dna) - F.length(F.translate(dna, "GC", ""))).cast("int")


def max_run(dna: Column) -> Column:
    """Longest run of one base, 1 at least."""
    runs = F.regexp_extract_all(dna, F.lit("(A+|C+|G+|T+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(1))


def end_gc(dna: Column) -> Column:
    return gc_count(F.right(dna, F.lit(END_NT)))


#: Bytes that are folded at once; rows that they are laid out in, one column after the other; bytes of texts that a loop takes sooner.
_FOLDED, _ROWS, _FEW = 1 << 15, 16, 500
_POWERS = np.array([pow(FNV_PRIME, _FOLDED - k, 1 << 64) for k in range(_FOLDED)], np.uint64)
_MASK = (1 << 64) - 1


def fold(data: np.ndarray) -> int:
    """FNV-1a of 64 bits from the format's own seed. Each of the state's lowest eight bits is the exclusive or of all that came before it
    at its place: the text's bits, and carries that lower bits alone decide; so they are known for all places, one bit after the other.
    A byte changes the lowest byte only, and so adds a known amount times a power of the prime."""
    state, low = FNV_SEED, np.uint8(FNV_PRIME & 255)
    if len(data) < _FEW:
        for b in data.tolist():
            state = (state ^ b) * FNV_PRIME & _MASK
        return state
    for a in range(0, len(data), _FOLDED):
        n = min(_FOLDED, len(data) - a)
        columns = -(-n // _ROWS)
        text, powers = np.zeros(columns * _ROWS, np.uint8), np.zeros(columns * _ROWS, np.uint64)
        text[:n], powers[:n] = data[a : a + n], _POWERS[_FOLDED - n :]
        own = np.ascontiguousarray(text.reshape(columns, _ROWS).T)
        here = np.zeros_like(own)  # the lowest byte before each step
        for bit in range(8):
            turned = own ^ here
            turned &= np.uint8((1 << bit) - 1)
            turned *= low
            turned ^= own
            turned &= np.uint8(1 << bit)
            for k in range(1, _ROWS):
                turned[k] ^= turned[k - 1]
            before = np.bitwise_xor.accumulate(np.concatenate(([state & 1 << bit], turned[-1, :-1])).astype(np.uint8))
            here[0] |= before
            here[1:] |= turned[:-1] ^ before
        added = ((own ^ here).astype(np.int16) - here).T.astype(np.int64).view(np.uint64)
        state = (state * pow(FNV_PRIME, n, 1 << 64) + int((added.ravel() * powers).sum(dtype=np.uint64))) & _MASK
    return state


@F.pandas_udf(T.StringType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """fold() in 16 hexadecimal digits."""
    return pd.Series([None if x is None else f"{fold(np.frombuffer(x.encode(), np.uint8)):016x}" for x in texts], dtype=object)


#: Places of bases whose states are found side by side; powers of the prime, and of its inverse, for each word of four bases of them.
_PLACES = 1 << 19
_NIBBLES = np.uint64(0x1111111111111111)


def _powers(step: int) -> np.ndarray:
    steps = np.full(_PLACES // 4 + 1, step, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_UP, _DOWN = _powers(pow(FNV_PRIME, 4, 1 << 64)), _powers(pow(FNV_PRIME, -4, 1 << 64))


@functools.cache
def _word_table() -> np.ndarray:
    """What four bases (two bits each, A, C, T, G as their letters' bits say) add to a state, by them and by the state's lowest seven bits: the
    letters have no more, so that the eighth is of no account."""
    single = folds.byte_tables()
    tables, n = [single[b] for b in b"ACTG"], 1
    while n < 4:
        tables, n = [folds.joined(a, n, single[b], 1) for a in tables for b in b"ACTG"], n + 1
    return np.concatenate([t[:128] for t in tables])


def _spread(bits: np.ndarray) -> np.ndarray:
    """All ones for a one."""
    return np.uint64(0) - bits


def _lowest(padded: np.ndarray, first: np.ndarray, count: np.ndarray, states: np.ndarray) -> np.ndarray:
    """The state's lowest seven bits before each fourth place of texts of bases, each of which begins at a word of 64 places (`first`, `count` of them).
    64 places of one bit are a number: a bit of the next state is that bit of this one, the base's, and what lower bits carry into it, so that
    each is a running exclusive or of what is known by then. The prime's lowest seven bits are 51, 3 * 17."""
    one, zero, ones = np.uint64(1), np.uint64(0), np.uint64((1 << 64) - 1)
    low, high = (np.packbits(padded & np.uint8(b), bitorder="little").view("<u8") for b in (2, 4))
    t = high & ~low
    base = (~t, low, high, zero, t, zero, ones)
    halves, u, c, d, past = [np.zeros_like(low), np.zeros_like(low)], [], zero, zero, zero
    for j in range(7):
        y = past ^ c ^ base[j]
        if j >= 4:
            y ^= u[0]
            y ^= d
        for k in (1, 2, 4, 8, 16, 32):
            y ^= y << np.uint64(k)
        before = np.bitwise_xor.accumulate(y >> np.uint64(63))
        before = np.concatenate(([zero], before[:-1]))
        before ^= np.repeat(before[first] ^ (states >> np.uint64(j) & one), count)
        y <<= one
        y ^= _spread(before)
        own = y ^ base[j]
        y &= _NIBBLES
        y <<= np.uint64(j % 4)
        halves[j // 4] |= y
        apart = own ^ past
        u.append(apart ^ c)
        if j >= 4:
            d = (u[-1] & u[0]) | (d & (u[-1] ^ u[0]))
            u.pop(0)
        c = (own & past) | (c & apart)
        past = own
    first, last = (x.view(np.uint8) for x in halves)
    out = np.empty((len(first), 2), np.uint8)
    out[:, 0] = (first & 15) | (last << 4)
    out[:, 1] = (first >> 4) | (last & 0xF0)
    return out.ravel()


def _folded(texts: list[np.ndarray], states: np.ndarray) -> np.ndarray:
    """States after texts of bases, of _PLACES at most in all, from those before."""
    sizes = np.array([len(x) for x in texts], np.int64)
    count = -(-sizes // 64)
    first = np.cumsum(count) - count
    padded = np.full(64 * int(count.sum()), ord("A"), np.uint8)
    for x, a in zip(texts, (64 * first).tolist(), strict=True):
        padded[a : a + len(x)] = x
    lowest = _lowest(padded, first, count, states)
    words = ((padded.view("<u4") >> np.uint32(1)) & np.uint32(0x03030303)) * np.uint32(0x40100401)
    added = np.zeros(len(lowest) + 1, np.uint64)
    np.take(_word_table(), ((words >> np.uint32(17)) & np.uint32(0x7F80)) | lowest, out=added[:-1], mode="clip")
    added[:-1] *= _DOWN[: len(lowest)]
    full, begin = sizes // 4, 16 * first
    sums = np.add.reduceat(added, np.stack((begin, begin + full), 1).ravel())[::2]
    # A text's sum is that of its words' amounts, each times the prime once for each place behind it.
    out = np.where(full > 0, states * _UP[full] + sums * _UP[np.maximum(begin + full - 1, 0)], states)
    for k in range(3):
        more = np.flatnonzero(sizes % 4 > k)
        out[more] = (out[more] ^ padded[4 * (begin + full)[more] + k]) * np.uint64(FNV_PRIME)
    return out


def folded(texts: list[np.ndarray]) -> list[int]:
    """fold() of texts of the letters A, C, G and T alone: many side by side, long ones a piece after the other."""
    out = np.full(len(texts), FNV_SEED, np.uint64)
    held, places = [], 0
    for k, x in [*enumerate(texts), (-1, None)]:
        for a in range(0, 1 if x is None else len(x), _PLACES):
            piece = None if x is None else x[a : a + _PLACES]
            need = 0 if x is None else -(-len(piece) // 64) * 64
            if held and (x is None or places + need > _PLACES):
                own = [n for n, _ in held]
                out[own] = _folded([y for _, y in held], out[own])
                held, places = [], 0
            if x is not None:
                held.append((k, piece))
                places += need
    return out.tolist()


#: Digits of an address that differ within a table of addresses.
_LAST_NT = 6


@functools.cache
def _addresses() -> np.ndarray:
    """The first 4 ** _LAST_NT addresses."""
    return np.frombuffer(b"ACGT", np.uint8)[np.arange(4**_LAST_NT)[:, None] >> np.arange(2 * ADDRESS_NT - 2, -1, -2) & 3]


def strands_of(dna: bytes) -> np.ndarray:
    """All strands of a payload's nucleotides, in order, as bytes: what strand() gives for each block."""
    n = -(-len(dna) // PAYLOAD_NT)
    out = np.empty((n, len(PRIMER_LEFT) + ADDRESS_NT + PAYLOAD_NT + len(PRIMER_RIGHT)), np.uint8)
    at = len(PRIMER_LEFT)
    out[:, :at] = np.frombuffer(PRIMER_LEFT.encode(), np.uint8)
    for a in range(0, n, len(_addresses())):
        out[a : a + len(_addresses()), at : at + ADDRESS_NT] = _addresses()[: n - a]
        out[a : a + len(_addresses()), at : at + ADDRESS_NT - _LAST_NT] = np.frombuffer(b"ACGT", np.uint8)[a // len(_addresses()) >> np.arange(2 * (ADDRESS_NT - _LAST_NT) - 2, -1, -2) & 3]
    out[:, at + ADDRESS_NT : at + ADDRESS_NT + PAYLOAD_NT] = np.frombuffer(dna.ljust(n * PAYLOAD_NT, b"A"), np.uint8).reshape(n, PAYLOAD_NT)
    out[:, at + ADDRESS_NT + PAYLOAD_NT :] = np.frombuffer(PRIMER_RIGHT.encode(), np.uint8)
    return out.ravel()


def both_fingerprints(dna: pa.Array) -> list[pa.Array]:
    """Fingerprints of each payload's nucleotides, and of its strands."""
    texts = [x.encode() for x in dna.to_pylist()]
    bases = not any(x.translate(None, b"ACGT") for x in texts)
    both = [np.frombuffer(x, np.uint8) for x in texts], [strands_of(x) for x in texts]
    return [pa.array([f"{h:016x}" for h in (folded(own) if bases else map(fold, own))], pa.string()) for own in both]
