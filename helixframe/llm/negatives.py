"""Hard negatives by Kronecker-packed products.

Scores are inner products of whole numbers. Components are biased so that none is below 0, and those of several candidates are put
into fields of one wide integer, each wide enough for a whole inner product. An anchor component multiplies all of them
at once, and the sum over components holds one exact inner product in each field, which shifts and masks take out and whose
bias is subtracted. Integers of up to 53 bits are exact in doubles, so that such products are one matrix product; wider ones are
Python's own integers.

Candidates lie in shards, runs of rows that a task has at hand, sorted by label, and written once. Anchors are taken in
blocks of bounded bytes, which are broadcast, and all shards stream past a block twice: for the best rows of the anchor's own label
(its positives; only that label's rows are multiplied), and, with those scores known, for the best rows of other
labels within each positive's window. A shard returns no more rows than an anchor may have in the end, and those are ranked
once more. No group is ever put together: a label, however frequent, lies spread over all shards.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import cut, forget
from helixframe.llm.topk import LONG, narrow, usable

#: Positives of an anchor, and negatives of a positive; a negative's score is between these shares of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, (50, 100), (95, 100)
#: Rows of a shard; bytes of anchors in a block, eight a component, which is broadcast; anchors that are multiplied together.
SHARD_ROWS, BLOCK_BYTES, TOGETHER = 8192, 32 << 20, 256
#: Bits that are exact in a double; fields of one of Python's integers.
DOUBLE_BITS, WIDE_FIELDS = 53, 16


class Packed:
    """Candidates (rows of whole numbers) packed for anchors whose components lie between `low` and `high`."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.dim = rows.shape
        self.low, self.base = low, int(rows.min()) if rows.size else 0
        top = self.dim * (high - low) * (int(rows.max()) - self.base if rows.size else 0)
        self.width = max(1, top.bit_length())
        self.fields = DOUBLE_BITS // self.width or WIDE_FIELDS
        self.exact = self.width <= DOUBLE_BITS
        held = rows - self.base if self.exact else whole(rows) - self.base
        self.sums = held.sum(1)
        if not rows.size:
            return
        pad = -self.n % self.fields
        held = np.concatenate((held, np.zeros((pad, self.dim), held.dtype))).reshape(-1, self.fields, self.dim)
        place = [1 << self.width * k for k in range(self.fields)]
        self.wide = sum(held[:, k] * (float(p) if self.exact else p) for k, p in enumerate(place)).T

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors (rows) with all candidates, as 64-bit numbers; one beyond LONG or -LONG is that."""
        if not self.n or not self.dim:
            return np.zeros((len(anchors), self.n), np.int64)
        held = (anchors if self.exact else whole(anchors)) - self.low
        out = held @ self.wide
        mask = (1 << self.width) - 1
        if self.exact:
            out = out.astype(np.int64)
            fields = np.empty((*out.shape, self.fields), np.int64)
            for k in range(self.fields):
                fields[:, :, k] = out >> self.width * k & mask
        else:
            fields = np.stack([out >> self.width * k & mask for k in range(self.fields)], 2)
        fields = fields.reshape(len(anchors), -1)[:, : self.n]
        mine, theirs, both = self.base * held.sum(1), self.low * self.sums, self.dim * self.low * self.base
        if self.exact and max(abs(self.low), abs(self.base)) * self.dim * (abs(self.low) + abs(self.base) + mask) < 1 << 62:
            return fields + (mine.astype(np.int64)[:, None] + theirs.astype(np.int64)[None] + both)
        near = lambda x: min(max(int(x), -LONG), LONG)
        mine, theirs = [int(x) for x in mine.tolist()], [int(x) for x in theirs.tolist()]
        return np.array([[near(int(x) + b + a + both) for x, b in zip(row, theirs, strict=True)] for row, a in zip(fields.tolist(), mine, strict=True)], np.int64).reshape(len(anchors), self.n)


def whole(rows: np.ndarray) -> np.ndarray:
    """Whole numbers held in doubles as Python's."""
    return np.array([int(x) for x in rows.ravel().tolist()], object).reshape(rows.shape)


class Shard:
    """Rows sorted by label; parts: where each label's lie."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        by = np.lexsort((ids, labels))
        self.ids, self.labels, self.rows = ids[by], labels[by], rows[by]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rows": narrow(self.rows)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state | {"rows": state["rows"].astype(np.float64)}

    def part(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))


class Anchors:
    """Anchors of a block that have vectors of one length, sorted by label."""

    def __init__(self, ids: list[int], labels: list[int], rows: list):
        by = np.lexsort((ids, labels))
        self.ids, self.labels = np.array(ids, np.int64)[by], np.array(labels, np.int64)[by]
        self.rows = np.array(rows, np.float64).reshape(len(ids), -1)[by]
        self.low, self.high = (int(self.rows.min()), int(self.rows.max())) if self.rows.size else (0, 0)

    def groups(self):
        """(label, slice) of up to TOGETHER anchors that share a label."""
        for label in np.unique(self.labels).tolist():
            a, b = np.searchsorted(self.labels, [label, label + 1])
            for k in range(a, b, TOGETHER):
                yield label, slice(k, min(b, k + TOGETHER))


def positives_in(shard: Shard, anchors: Anchors, k: int):
    """(anchor, row, score) arrays of each anchor's k best rows of its label in a shard, itself apart."""
    for label, group in grouped(anchors.groups()):
        a, b = shard.part(label)
        if a == b:
            continue
        packed = Packed(shard.rows[a:b], anchors.low, anchors.high)
        for own in group:
            scores = packed.scores(anchors.rows[own])
            others = shard.ids[a:b][None] != anchors.ids[own][:, None]
            if b - a > k + 1:
                least = np.iinfo(np.int64).min
                floor = np.partition(np.where(others, scores, least), b - a - k, axis=1)[:, b - a - k]
                others &= scores >= floor[:, None]
            i, j = np.nonzero(others)
            by = np.lexsort((shard.ids[a:b][j], -scores[i, j], i)) if len(i) else i
            i, j = i[by], j[by]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[nth < k], j[nth < k]
            yield anchors.ids[own][i], shard.ids[a:b][j], scores[i, j]


def grouped(groups):
    """(label, slices) with all slices of a label together."""
    out: dict[int, list] = {}
    for label, own in groups:
        out.setdefault(label, []).append(own)
    return out.items()


def negatives_in(shard: Shard, anchors: Anchors, windows: dict[int, list[tuple[int, int, int]]], k: int):
    """(anchor, number, row, score) lists: for each anchor and positive (number, low, high) the k best rows of other labels whose
    score is from low to high."""
    packed = Packed(shard.rows, anchors.low, anchors.high)
    for start in range(0, len(anchors.ids), TOGETHER):
        own = slice(start, start + TOGETHER)
        given = [windows.get(i, ()) for i in anchors.ids[own].tolist()]
        low = np.array([min((w[1] for w in x), default=LONG) for x in given], np.int64)
        high = np.array([max((w[2] for w in x), default=-LONG) for x in given], np.int64)
        if (low > high).all():
            continue
        scores = packed.scores(anchors.rows[own])
        i, j = np.nonzero((scores >= low[:, None]) & (scores <= high[:, None]))
        other = (shard.labels[j] != anchors.labels[own][i]) & (shard.ids[j] != anchors.ids[own][i])
        i, j = i[other], j[other]
        by = np.lexsort((shard.ids[j], -scores[i, j], i))
        i, j = i[by], j[by]
        falling, ids = -scores[i, j], shard.ids[j]
        borders = np.searchsorted(i, np.arange(len(given) + 1))
        found: tuple[list, list, list, list] = ([], [], [], [])
        for n in np.flatnonzero(np.diff(borders)).tolist():
            part = falling[borders[n] : borders[n + 1]]
            for number, least, most in given[n]:
                first, last = np.searchsorted(part, -most), np.searchsorted(part, -least, "right")
                for x in range(borders[n] + first, borders[n] + min(last, first + k)):
                    for column, value in zip(found, (anchors.ids[start + n], number, ids[x], -falling[x]), strict=True):
                        column.append(int(value))
        yield found


def shards(vectors: DataFrame, shard_rows: int) -> DataFrame:
    """(length, data): shards of each task's rows, one for each shard_rows rows and each length of vectors there."""

    def build(frames):
        held: list[pd.DataFrame] = []

        def made():
            rows = pd.concat(held)
            for n, own in rows.groupby(rows["v"].str.len()):
                yield pd.DataFrame({"length": [n], "data": [pickle.dumps(Shard(own["vec_id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), np.array(own["v"].tolist(), np.float64).reshape(len(own), n)), 5)]})

        for pdf in frames:
            for k in range(0, len(pdf), shard_rows):
                held.append(pdf.iloc[k : k + shard_rows])
                if sum(map(len, held)) >= shard_rows:
                    yield from made()
                    held.clear()
        if held:
            yield from made()

    return vectors.mapInPandas(build, "length int, data binary")


def windows_of(rows: list, low: tuple[int, int], high: tuple[int, int]) -> dict[int, list[tuple[int, int, int]]]:
    """anchor: (number, least, most) of its positives; the scores a negative may have, worked out in whole numbers."""
    out: dict[int, list] = {}
    for r in rows:
        p = r["positive_score"]
        least, most = -(-low[0] * p // low[1]), high[0] * p // high[1]
        out.setdefault(r["anchor_id"], []).append((r["number"], max(least, -LONG), min(most, LONG)))
    return out


def mine(vectors: DataFrame, every: int, positives: int = POSITIVES, negatives: int = NEGATIVES, low: tuple[int, int] = LOW, high: tuple[int, int] = HIGH, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, rows of vectors (vec_id, embedding,
    label) whose vec_id is divisible by `every`. Components count as floor(256 * x).

    An anchor's positives are the best `positives` other rows of its label; for each the best `negatives` rows of other labels count whose
    score is between low and high times the positive's. Higher scores come first, ties by smaller vec_id. A positive without negatives
    has no row. Rows without an id, label or vector, and vectors that hold null or non-finite components, take no part. Rows that repeat a
    vec_id are candidates of their own; as anchors they are one (the smallest label, then vector), and an anchor never
    meets its own id. Vectors of different lengths never meet; empty ones have score 0. Scores beyond 2^63 - 1, of either sign, count as
    that. No rows: no rows.
    """
    spark = vectors.sparkSession
    given = usable(vectors.where("label is not null"), F.col("label").cast("long").alias("label"))
    held = cut(shards(given, shard_rows))
    asked = cut(given.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.label", "a.v"))
    size = asked.agg(F.sum(F.size("v") * 8 + 32).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // block_bytes))
    nth = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id", "copy")
    last = Window.partitionBy("anchor_id", "number").orderBy(F.desc("negative_score"), "negative_id")
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(13)), F.lit(blocks)) == b).toArrow()  # a block
        sent = spark.sparkContext.broadcast(anchors_of(rows))

        def find_positives(frames, sent=sent):
            for n, shard in loaded(frames):
                if n in sent.value:
                    for i, j, s in positives_in(shard, sent.value[n], positives):
                        yield pd.DataFrame({"anchor_id": i, "positive_id": j, "positive_score": s, "copy": np.arange(len(i), dtype=np.int32)})

        found = held.mapInPandas(find_positives, "anchor_id long, positive_id long, positive_score long, copy int")
        own = cut(found.withColumn("number", F.row_number().over(nth)).where(F.col("number") <= positives).drop("copy"))
        limits = spark.sparkContext.broadcast(windows_of(own.collect(), low, high))  # `positives` numbers for each anchor of the block

        def find_negatives(frames, sent=sent, limits=limits):
            for n, shard in loaded(frames):
                if n in sent.value:
                    for columns in negatives_in(shard, sent.value[n], limits.value, negatives):
                        yield pd.DataFrame({c: np.array(x, np.int64) for c, x in zip(("anchor_id", "number", "negative_id", "negative_score"), columns, strict=True)}).astype({"number": np.int32})

        most = held.mapInPandas(find_negatives, "anchor_id long, number int, negative_id long, negative_score long")
        best = most.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= negatives)
        more = own.join(best, ["anchor_id", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        if blocks > 1:
            more = cut(more)
            forget(own)
        out = more if out is None else out.union(more)
    forget(asked)
    return out


def anchors_of(rows) -> dict[int, Anchors]:
    """Anchors by the length of their vectors."""
    out: dict[int, tuple[list, list, list]] = {}
    for i, label, v in zip(rows.column("vec_id").to_pylist(), rows.column("label").to_pylist(), rows.column("v").to_numpy().tolist(), strict=True):
        for column, x in zip(out.setdefault(len(v), ([], [], [])), (i, label, v), strict=True):
            column.append(x)
    return {n: Anchors(*x) for n, x in out.items()}


def loaded(frames):
    for pdf in frames:
        for n, data in zip(pdf["length"], pdf["data"], strict=True):
            yield n, pickle.loads(data)


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    given = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (given % 10 + 1) % 10).otherwise(given)
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("label", label), 50)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
