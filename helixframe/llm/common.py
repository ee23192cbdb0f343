"""Helpers that several operators share: tables in the shared folder, Arrow text, words as numbers."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.sources.shared import cut as cut
from helixframe.sources.shared import forget as forget

#: Text that one numpy pass works on. A longer document is a piece of its own.
PIECE_BYTES = 1 << 20

#: Words of contracts 3 and 5: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z. Bytes from 0x80 belong to
#: letters outside ASCII, which that class takes whole.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
#: Words of contract 9: [^\x20\x09-\x0D]+.
SOLID_BYTE = np.ones(256, bool)
SOLID_BYTE[[9, 10, 11, 12, 13, 32]] = False


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers that are broadcast at most (about 10 MB); more are joined by shuffle, and Spark splits a frequent key.
BROADCAST_ROWS = 100_000


def few(table: DataFrame) -> DataFrame:
    """A written table of numbers, marked for broadcast if it is small enough."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def remainder(column, n: int):
    """crc32 of the id as text, modulo n: the folds that the contracts of operators 1 and 6 fix."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def without(docs: DataFrame, *names: str) -> DataFrame:
    """docs without columns of these names in any case: an operator's new columns take the place of such."""
    taken = {n.lower() for n in names}
    own = [c for c in docs.columns if c.lower() not in taken]
    return docs if len(own) == len(docs.columns) else docs.select(*[F.col(f"`{c}`") for c in own])


def hashes(column):
    """Two 64-bit hashes of a text, of different seeds."""
    return F.xxhash64(column), F.xxhash64(F.lit(1), column)


def document_key(doc_id, text):
    """(none, doc, mark), none of them null: a document is named by its doc_id and a hash of its text, without an id by two
    hashes. Rows that repeat both are one document; in order of these keys null ids come last. doc_id is a number, or text that
    spells one: ids of other kinds are to be hashed before."""
    one, two = hashes(text)
    return doc_id.isNull(), F.coalesce(doc_id.cast("long"), two), one


def map_batches(docs: DataFrame, scan, schema: T.StructType) -> DataFrame:
    """docs.mapInArrow(scan, schema), also where a name has a dot, which that method would take for a field's."""
    if not any("." in c for c in docs.columns):
        return docs.mapInArrow(scan, schema)
    plain = [f.name.replace(".", f"_dot{k}_") for k, f in enumerate(schema)]
    kinds = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(plain, schema, strict=True)])
    place = {f.name: c for f, c in zip(schema, plain, strict=True)}
    renamed = docs.toDF(*[place.get(c, c) for c in docs.columns])
    return renamed.mapInArrow(scan, kinds).toDF(*[f.name for f in schema])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without copying, and where each row's begin (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Splits a batch into runs of whole rows of about `limit` bytes of text: rows, bytes, offsets."""
    data, at = text_bytes(batch.column(text))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        end = min(end, n)
        yield batch.slice(row, end - row), data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def fragments(data: np.ndarray, at: np.ndarray, border: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in runs of about `limit` bytes, longer ones cut before bytes that `border` (by byte) allows: the row of each
    fragment, bytes, offsets. A stretch without a border stays whole."""
    cuts = []
    for row in np.flatnonzero(np.diff(at) > limit).tolist():
        place, end = int(at[row]) + limit, int(at[row + 1])
        while place < end:
            ahead = border[data[place : min(end, place + 4096)]]
            if not ahead.any():
                place += 4096
                continue
            place += int(ahead.argmax())
            cuts.append(place)
            place += limit
    own = np.sort(np.concatenate((at, np.array(cuts, at.dtype)))) if cuts else at
    row = np.searchsorted(at, own[:-1], "right") - 1
    k, n = 0, len(own) - 1
    while k < n:
        end = min(n, max(k + 1, int(np.searchsorted(own, own[k] + limit, "right")) - 1))
        yield row[k:end], data[own[k] : own[end]], own[k : end + 1] - own[k]
        k = end


def spans_text(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans of bytes as an array of strings."""
    size = ends - starts
    at = np.concatenate(([0], np.cumsum(size)))
    gathered = data[np.repeat(starts - at[:-1], size) + np.arange(int(at[-1]))]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(gathered))


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of true; a run never crosses a row border given in `at`."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(n + 1, bool)
    border[at] = True
    starts = np.flatnonzero(inside & (border[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (border[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends


#: The lowest 0 to 8 bytes of a number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans longer than this are hashed and compared one by one, by C code of their own.
LONG_SPAN = 512


def eights(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each place on, as a number; behind the end stand zeros."""
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, eight bytes at a time. Each step is one-to-one, so that spans of eight bytes
    or fewer never collide with others of their length; users verify the rest by same_spans()."""
    size, eight = ends - starts, eights(data)
    h = (size.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xC2B2AE3D27D4EB4F)
    live, k = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        x = h[live] ^ (eight[starts[live] + k] & MASKS[np.minimum(size[live] - k, 8)])
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        h[live] = x ^ (x >> np.uint64(32))
        k += 8
        live = live[size[live] > k]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def same_spans(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span of `a` holds the bytes of that of `b`; both have the sizes given."""
    out, one, two = np.ones(len(size), bool), eights(a), eights(b)
    live, k = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(live):
        same = (one[a_starts[live] + k] ^ two[b_starts[live] + k]) & MASKS[np.minimum(size[live] - k, 8)] == 0
        out[live[~same]] = False
        k += 8
        live = live[same & (size[live] > k)]
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = bool((a[a_starts[i] : a_starts[i] + size[i]] == b[b_starts[i] : b_starts[i] + size[i]]).all())
    return out


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """One span of each text, and each span's number among those; equal texts by their bytes, not by their hashes alone.
    The third is a seed under which no two of the texts share a hash."""
    seed = 0
    while True:
        _, one, number = np.unique(span_hashes(data, starts, ends, seed), return_index=True, return_inverse=True)
        like = one[number]
        if len(starts) == 0 or ((ends - starts == (ends - starts)[like]) & same_spans(data, starts, data, starts[like], np.minimum(ends - starts, (ends - starts)[like]))).all():
            return one, number, seed
        seed += 1


class Words:
    """The words of a piece as arrays: lower-cased bytes, starts, ends, row of each word, first word of each row."""

    def __init__(self, data: np.ndarray, at: np.ndarray, kind: np.ndarray = WORD_BYTE):
        self.data = LOWER[data]
        self.starts, self.ends = runs(kind[self.data], at)
        self.first = np.searchsorted(self.starts, at)
        self.counts = np.diff(self.first)
        self.row = np.repeat(np.arange(len(at) - 1), self.counts)


def words_of(texts: list[str | None]) -> Words:
    return Words(*text_bytes(pa.array([x or "" for x in texts], pa.large_string())))


class Vocabulary:
    """Distinct words, numbered. They are found by hash and verified by their bytes."""

    def __init__(self, words: Words):
        """numbers: that of each of the words."""
        one, self.numbers, self.seed = distinct_spans(words.data, words.starts, words.ends)
        self.sizes = words.ends[one] - words.starts[one]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = words.data[np.repeat(words.starts[one] - self.starts, self.sizes) + np.arange(int(self.sizes.sum()))]
        self._index()

    def _index(self) -> None:
        self.index = HashIndex(span_hashes(self.data, self.starts, self.starts + self.sizes, self.seed))

    def __len__(self) -> int:
        return len(self.sizes)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("index", "numbers")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self._index()

    def find(self, words: Words) -> np.ndarray:
        """The number of each word, or -1."""
        out, size = self.index.find(span_hashes(words.data, words.starts, words.ends, self.seed)), words.ends - words.starts
        found = np.flatnonzero(out >= 0)
        fit = size[found] == self.sizes[out[found]]
        out[found[~fit]] = -1
        found = found[fit]
        same = same_spans(words.data, words.starts[found], self.data, self.starts[out[found]], size[found])
        out[found[~same]] = -1
        return out


class HashIndex:
    """An open-addressing table from 64-bit keys to 0..n-1, probed by whole arrays."""

    def __init__(self, keys: np.ndarray):
        keys = np.asarray(keys, np.uint64)
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.values[slot] < 0
            self.values[slot[free]] = todo[free]
            self.keys[slot[free]] = keys[todo[free]]
            lost = self.values[slot] != todo
            slot, todo = (slot[lost] + 1) & (len(self.keys) - 1), todo[lost]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        slot = self._slot(keys)
        out = self.values[slot]
        away = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(away):
            slot[away] = (slot[away] + 1) & (len(self.keys) - 1)
            v = out[away] = self.values[slot[away]]
            away = away[(v >= 0) & (self.keys[slot[away]] != keys[away])]
        return out
