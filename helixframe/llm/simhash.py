"""SimHash near-duplicates by pivot distance tables.

Fingerprints are made in one pass over the texts, without a shuffle. Equal fingerprints are put together first, so that
copies never meet as pairs. Each distinct fingerprint then gets its table of Hamming distances to reference
fingerprints. Two fingerprints within 4 bits agree on at least two of six blocks, so they are dealt by each pair of
blocks (15 keys of 21 bits or more) and meet by an equi-join, which Spark can split where a key is frequent. The more
fingerprints there are, the more blocks (three of seven, four of eight, ...: longer keys), so that as few share a key.
A pair is discarded if any coordinate of its tables differs by more than 4, then verified, and kept only under the first
key that it shares. Links become components by contraction, each round written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import SOLID_BYTE, Words, cut, document_key, few, forget, map_batches, pieces

SHINGLE, DISTANCE, SEED, PIVOTS = 4, 4, 42, 16
#: Fingerprints that share a key, about, before keys are made longer.
CROWD = 32


def row_fingerprints(data: np.ndarray, at: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each row of a piece, unsigned; 0 where a row has no word."""
    words = Words(data, at, SOLID_BYTE)
    n = len(words.starts)
    out = np.zeros(len(at) - 1, np.uint64)
    if not n:
        return out
    # All words, each followed by one space: a shingle is then a slice of these bytes.
    lengths = words.ends - words.starts
    to = np.concatenate(([0], np.cumsum(lengths + 1)))
    flat = np.full(int(to[-1]), 32, np.uint8)
    shift = np.repeat(to[:-1] - words.starts, lengths)
    inside = SOLID_BYTE[words.data]
    source = np.flatnonzero(inside)
    flat[source + shift] = words.data[source]
    flat = flat.tobytes()
    # Every word that has shingle - 1 more behind it in its row begins one; a shorter row has one, of all its words.
    count = np.where(words.counts > 0, np.maximum(1, words.counts - shingle + 1), 0)
    row = np.repeat(np.arange(len(count)), count)
    start = words.first[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    last = np.minimum(start + shingle, words.first[1:][row]) - 1
    one = xxhash.xxh64_intdigest
    hashes = np.fromiter((one(flat[a:b], SEED) for a, b in zip(to[start].tolist(), (to[last + 1] - 1).tolist(), strict=True)), np.uint64, len(row))
    some = np.flatnonzero(count)
    edges = np.concatenate(([0], np.cumsum(count[some])))
    for k in range(0, len(some), 256):  # some rows at a time: 64 bytes for each shingle
        a, b = edges[k], edges[min(k + 256, len(some))]
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edges[k : min(k + 256, len(some))] - a, axis=0, dtype=np.int64)
        over = (2 * ones > count[some[k : k + 256], None]).astype(np.uint8)
        out[some[k : k + 256]] = np.packbits(over, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs with a column fp (the fingerprint as a signed long). Null and wordless texts have 0."""
    schema = T.StructType([*docs.schema.fields, T.StructField("fp", T.LongType())])

    def scan(batches):
        for batch in batches:
            for part, data, at in pieces(batch):
                fp = pa.array(row_fingerprints(data, at, shingle).view(np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, fp], [*part.schema.names, "fp"])

    return map_batches(docs, scan, schema)


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed longs: hashes of 0..n-1."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), SEED)).astype(np.int64)) for i in range(n)]


def layout(blocks: int) -> list[tuple[int, int]]:
    """First bit and width of each block."""
    widths = [64 // blocks + (k < 64 % blocks) for k in range(blocks)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Blocks for n fingerprints: the fewest by which a key has about CROWD of them or fewer, if they are spread evenly.
    Any number finds the same pairs; more blocks make more, and longer, keys."""
    blocks = distance + 2
    while n > CROWD << sum(w for _, w in layout(blocks)[distance:]) and comb(blocks + 1, distance) <= 256:
        blocks += 1
    return blocks


def block(fp, place: tuple[int, int]):
    first, width = place
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int | None = None) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column fp) that differ in 1..distance bits, each once."""
    places = layout(blocks or blocks_for(distinct.count(), distance))
    table = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("byte") for p in pivots()])
    chosen = list(combinations(range(len(places)), len(places) - distance))
    if len(chosen) > 256:
        raise ValueError("a key's number has 8 bits: too many blocks for this distance")
    keys = []
    for k, own in enumerate(chosen):
        key = F.lit(0).cast("long")
        for i in own:
            key = F.shiftleft(key, places[i][1]).bitwiseOR(block(F.col("fp"), places[i]))
        keys.append(F.shiftleft(key, 8).bitwiseOR(F.lit(k)))
    dealt = distinct.select("fp", table.alias("d"), F.explode(F.array(*keys)).alias("key"))
    a, b = dealt.alias("a"), dealt.alias("b")
    near = F.lit(True)
    for i in range(PIVOTS):
        near &= F.abs(F.col("a.d")[i].cast("int") - F.col("b.d")[i].cast("int")) <= distance
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # A pair counts under its first key alone: no equal block stands before the key's last one but those of the key.
    equal = sum((F.when(block(differ, p) == 0, 1 << i).otherwise(0) for i, p in enumerate(places)), F.lit(0))
    skipped = F.array(*[F.lit(sum(1 << i for i in range(own[-1]) if i not in own)) for own in chosen])
    first = equal.bitwiseAND(skipped[F.col("a.key").bitwiseAND(F.lit(255)).cast("int")]) == 0
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & near & (F.bit_count(differ) <= distance) & first
    return a.join(b, on).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of edges (a, b): every node points to the smallest of its component.

    Rounds of large-star and small-star contraction (Kiveris et al., 2014), which need about log n rounds whatever the
    shape; minima are taken by grouping, so a node of very many links is pre-aggregated before it is shuffled.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
        small = large.join(least, large.a == least.n).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = cut(small.union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        # Done when each node has one link and no target has a link of its own: stars.
        unsettled = after.groupBy("a").count().where("count > 1").limit(1).count() or after.select("a").intersect(after.select("b")).limit(1).count()
        forget(now, large)
        now = after
        if not unsettled:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def classes(distinct: DataFrame) -> DataFrame:
    """(fp, group) of the fingerprints of distinct (fp, ...) that have links: the component's smallest fingerprint."""
    roots = components(links(distinct))
    return cut(roots.select(F.col("node").alias("fp"), F.col("root").alias("group")).union(roots.select("root", "root").distinct()))


def shared(marked: DataFrame, best, name: str) -> DataFrame:
    """(fp, name) of the fingerprints that several rows have or that have links: the least of `best` over the component."""
    own = cut(marked.groupBy("fp").agg(F.min(best).alias(name), F.count(F.lit(1)).alias("rows")))
    members = classes(own)
    linked = cut(members.join(own, "fp").select("fp", "group", name))
    # A component may hold very many fingerprints: what it is named by goes to them by broadcast, or by a join Spark can split.
    names = cut(linked.groupBy("group").agg(F.min(name).alias(name)))
    named = linked.drop(name).join(few(names), "group").select("fp", name)
    alone = own.where("rows > 1").join(few(members.select("fp")), "fp", "left_anti").select("fp", name)
    out = cut(named.union(alone))
    forget(own, members, linked, names)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id), a row for each of docs: component_id is the smallest doc_id that links reach.

    A null doc_id names no component unless its whole component has none. Empty and null texts share fingerprint zero.
    Repeated rows and doc_ids are rows of their own. Other columns of docs are not read. Texts of any length are read whole.
    No documents give no rows.
    """
    marked = cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"))
    named = shared(marked, F.col("doc_id"), "component_id")
    # A row that shares its fingerprint with none and has no link is a component by itself.
    return marked.join(few(named), "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id (nulls last, by hashes of their texts; among rows
    of that id the one of the smallest text hash; exact repeats of a row count as one). Columns are those of docs; no rows give no rows. Texts
    are shuffled only if documents that go are too many to broadcast, or to leave one of exact repeats."""
    key = ("none", "doc", "mark")
    named = [c.alias(n) for c, n in zip(document_key(F.col("doc_id"), F.col("text")), key, strict=True)]
    marked = cut(fingerprints(docs.select("doc_id", "text")).select("fp", *named))
    winners = shared(marked, F.struct(*key), "first")
    rows = marked.join(few(winners), "fp").groupBy(*key).agg(F.min(F.struct(*key) == F.col("first")).alias("wins"), F.count(F.lit(1)).alias("rows"))
    rows = cut(rows.where("rows > 1 or not wins"))
    forget(marked, winners)
    gone, repeated = rows.where("not wins").select(*key), rows.where("wins").select(*key)
    # Rows travel as one struct, so that no name in docs meets one of ours.
    own = docs.select(*named, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"))
    kept = own.join(few(gone), list(key), "left_anti")
    if not repeated.isEmpty():
        some = few(repeated)
        kept = kept.join(some, list(key), "left_anti").unionByName(kept.join(some, list(key), "left_semi").dropDuplicates(list(key)))
    return kept.select(*[F.col("d").getField(c).alias(c) for c in docs.columns])


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
