"""Codes for repeats, and greedy encoding with them."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.constants import TABLE_CAP
from helixframe.functions.kernels import Book, chunk_tables, encode_bytes, encoded_rows
from helixframe.functions.slices import mapped, slices
from helixframe.operators.segments import meet

#: Phases of an encoding, and their columns of seconds where they are taken in one pass.
PHASES = ("lsbm", "huffman", "encode")
SPENT = tuple(f"{p}_s" for p in PHASES)


def tree_codes(freqs: list[int]) -> list[str]:
    """Codes of leaves given in table order: a Huffman tree whose ties go by age, read from the root with G or C on odd
    levels and A or T on even ones."""
    if len(freqs) < 2:
        return [""] * len(freqs)
    leaves = sorted(zip(freqs, range(len(freqs))))
    made: list[tuple[int, int]] = []  # inner nodes weigh no less than those before them, and are younger than leaves
    above: dict[int, tuple[int, int]] = {}
    a, b, n = 0, 0, len(leaves)
    for fresh in range(n, 2 * n - 1):
        weight = 0
        for side in (0, 1):
            if a < n and (b == len(made) or leaves[a] < made[b]):
                f, k = leaves[a]
                a += 1
            else:
                f, k = made[b]
                b += 1
            above[k] = (fresh, side)
            weight += f
        made.append((weight, fresh))
    fresh += 1
    sides: dict[int, str] = {fresh - 1: ""}
    for node in range(fresh - 2, -1, -1):  # parents are younger than their children
        parent, side = above[node]
        sides[node] = sides[parent] + ("GC" if len(sides[parent]) % 2 == 0 else "AT")[side]
    return [sides[k] for k in range(len(freqs))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def codes(freqs: pd.Series) -> pd.Series:
    return pd.Series([tree_codes(x.tolist()) for x in freqs])


def codebooks(table: DataFrame, by: list[str]) -> DataFrame:
    """(by, keys, codes): one row a group, longest keys first; codes of one nucleotide are left out. A group has 512
    keys at most, or short ones only."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "substr", "freq")))
    one = table.groupBy(*by).agg(rows.alias("t")).select(*by, F.col("t.substr").alias("substr"), codes(F.col("t.freq")).alias("code"))
    pairs = F.filter(F.arrays_zip("substr", "code"), lambda x: F.length(x["code"]) >= 2)
    return one.withColumn("pairs", pairs).select(*by, F.col("pairs.substr").alias("keys"), F.col("pairs.code").alias("codes"))


def kept_rows(pairs: list[tuple[str, int]], cap: int = TABLE_CAP) -> list[tuple[str, int]]:
    """What segments.kept() keeps of one payload's table, in its order."""
    ordered = lambda own: [(s, -n) for _, n, s in sorted([(-len(s), -n, s) for s, n in own])]
    most = min(len(pairs), cap)
    if most < 2:
        return ordered(pairs)[:cap]
    floor = 2 * (most - 1).bit_length() + 1  # none of the longest `cap` that is shorter stays, if any is as long
    return ordered([x for x in pairs if len(x[0]) >= floor])[:cap] or ordered(pairs)


def own_book(pairs: list[tuple[str, int]]) -> tuple[list[str], list[str]]:
    """Keys and codes of a payload's whole table."""
    rows = kept_rows(pairs)
    own = [(k, c) for (k, _), c in zip(rows, tree_codes([f for _, f in rows]), strict=True) if len(c) >= 2]
    return [k for k, _ in own], [c for _, c in own]


def own_books(pairs: pa.Array) -> Iterator[tuple[list[str], list[str]]]:
    """own_book() of payloads each of which has its table in one row (lists of substr and hits)."""
    ends, flat = pairs.offsets.to_pylist(), pairs.values
    substr, hits = flat.field("substr").to_pylist(), flat.field("hits").to_pylist()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield own_book(list(zip(substr[a:b], hits[a:b], strict=True)))


def _in_place(part: pa.RecordBatch) -> tuple[list[pa.Array], Iterator[tuple[list[str], list[str]]]]:
    """best_sum, if the chunks' repeats aren't there yet, and each payload's book."""
    if "pairs" in part.schema.names:
        return [], own_books(part.column("pairs"))
    sums, tables = chunk_tables(part.column("bytes").to_pylist())
    return [pa.array(sums, pa.int64())], (own_book(list(x.items())) for x in tables)


def _with_sums(chunks: DataFrame, more: str) -> tuple[str, tuple[str, ...]]:
    """The columns that _in_place() and `more` add, and those that go."""
    return (more, ("pairs", "bytes")) if "pairs" in chunks.columns else (f"best_sum long, {more}", ("bytes",))


def books_in_place(chunks: DataFrame) -> DataFrame:
    """chunks of payloads of one chunk, with keys and codes for bytes and pairs: a payload's table lies in its row, or is made there, and nothing moves."""

    def kernel(part: pa.RecordBatch) -> list[pa.Array]:
        sums, books = _in_place(part)
        own = list(books)
        return [*sums, *[pa.array([x[k] for x in own], pa.list_(pa.string())) for k in (0, 1)]]

    return mapped(chunks, "bytes", kernel, *_with_sums(chunks, "keys array<string>, codes array<string>"))


def encoded_in_place(chunks: DataFrame, more: str = "dna string", then: Callable[[pa.Array], list[pa.Array]] = lambda dna: [dna], listed: bool = False, spent: bool = False) -> DataFrame:
    """chunks of payloads of one chunk with best_sum, and with what `then` makes of their nucleotides for bytes and pairs, by each payload's own
    code table; listed: of the nucleotides of each segment. A payload's repeats (unless they are there), its table, its nucleotides and what is
    made of them take one pass over it, and no more than that leaves the task. spent: with the seconds (SPENT) of each phase, a slice's dealt out
    to its rows by their bytes."""

    def kernel(part: pa.RecordBatch) -> list[pa.Array]:
        marks = [time.perf_counter()]
        sums, books = _in_place(part)
        marks.append(time.perf_counter())
        if spent:
            books = list(books)
            marks.append(time.perf_counter())
        out = then(encoded_rows(part.column("bytes").to_pylist(), (Book(*own) for own in books), listed))
        marks.append(time.perf_counter())
        size = pc.binary_length(part.column("bytes")).to_numpy(zero_copy_only=False)
        return [*sums, *out, *[pa.array(size * ((b - a) / size.sum())) for a, b in itertools.pairwise(marks) if spent]]

    return mapped(chunks, "bytes", kernel, *_with_sums(chunks, ", ".join([more, *[f"{c} double" for c in SPENT if spent]])))


def encoded_packs(packs: DataFrame, books: DataFrame, by: list[str], few: bool, listed: bool) -> DataFrame:
    """packs (by, rows: structs with bytes) with a row for each of theirs, and dna (listed: seg_dna) for bytes: a code table meets a pack, not
    each of its rows. few: the books fit in a broadcast."""
    joined = meet(packs, F.broadcast(books) if few else books, by, "left")
    inside = [f for f in packs.schema["rows"].dataType.elementType.fields if f.name != "bytes"]
    schema = T.StructType([*[packs.schema[c] for c in by], *inside, T.StructField("seg_dna" if listed else "dna", T.ArrayType(T.StringType()) if listed else T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                book = Book(*[batch.column(c)[k].as_py() or [] for c in ("keys", "codes")])
                held = pa.RecordBatch.from_struct_array(batch.column("rows")[k].values)
                for part in slices(held, "bytes"):
                    rows = encoded_rows(part.column("bytes").to_pylist(), [book] * part.num_rows, listed)
                    own = [pa.array([batch.column(c)[k].as_py()] * len(rows), batch.column(c).type) for c in by]
                    yield pa.RecordBatch.from_arrays([*own, *[part.column(f.name) for f in inside], rows], schema.names)

    return joined.mapInArrow(run, schema)


def encoded_plain(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """payloads that aren't empty with dna, two bits a pair of nucleotides, for the payload: what encoded() gives without a code table."""
    book = Book([], [])
    code = lambda part: [encoded_rows(part.column(payload).to_pylist(), [book] * part.num_rows, False)]
    return mapped(payloads.where(F.octet_length(payload) > 0), payload, code, "dna string", (payload,))


def encoded(payloads: DataFrame, books: DataFrame, by: list[str], payload: str = "payload") -> DataFrame:
    """payloads with seg_dna, the nucleotides of each segment in order. Groups without a code table take pairs of bits.
    Books are joined by `by`, null as a value: Spark broadcasts them if they are few, and splits a frequent group if not."""
    joined = meet(payloads.where(F.octet_length(payload) > 0), books, by, "left")
    return joined.withColumn("seg_dna", encode_bytes(F.col(payload), F.col("keys"), F.col("codes"))).drop("keys", "codes")
