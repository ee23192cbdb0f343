"""Quality scores by a byte-level convolutional network in numpy.

Bytes are embedded, FILTERS learned filters look at chunks of 16 bytes, one each 8 bytes, so that chunks overlap and
cover the whole document; each filter's maximum over all chunks is kept, and a logistic unit makes them one probability.
The network is trained here on a bounded sample of labelled documents; gradients flow through the chunks that won.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import map_batches, pieces, remainder, text_bytes, without

STEP, WIDTH, FILTERS = 8, 8, 24
#: Labelled documents that training reads at most, and the longest of them, in characters.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
EPOCHS, BATCH, RATE, THRESHOLD = 8, 32, 0.01, 0.7
#: Blocks of a text that are looked at together; a longer one takes several slices.
LONG_BLOCKS = 1 << 16


@dataclass
class Network:
    """embed: 257 x WIDTH (256 stands for no byte); near, far: filters over the two halves of a chunk."""

    embed: np.ndarray
    near: np.ndarray
    far: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    base: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.near, self.far, self.bias, self.out, self.base]


def chunks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes as blocks of STEP (int16; 256 fills the end, and one block more), and each row's first block."""
    size = np.diff(at)
    blocks = -(-size // STEP) + 1 + (size == 0)
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.full(int(first[-1]) * STEP, 256, np.int16)
    if len(data):
        out[np.arange(len(data)) + np.repeat(first[:-1] * STEP - at[:-1], size)] = data
    return out.reshape(-1, STEP), first


def pooled(net: Network, blocks: np.ndarray, first: np.ndarray, winners: bool = False):
    """Each row's maximum of each filter over its chunks, and, if asked, the block in which the winning chunk begins."""
    x = net.embed[blocks].reshape(len(blocks), -1)
    act = x[:-1] @ net.near
    act += x[1:] @ net.far
    n = len(first) - 1
    # The chunk that begins in a row's last block would reach into the next row.
    act[first[1:-1] - 1] = -np.inf
    best = np.maximum.reduceat(act, first[:-1], axis=0) + net.bias
    if not winners:
        return best
    return best, np.array([first[i] + act[first[i] : min(first[i + 1], len(act))].argmax(0) for i in range(n)])


def pooled_long(net: Network, data: np.ndarray) -> np.ndarray:
    """pooled() of one text, by slices of LONG_BLOCKS blocks: the maximum of slices' maxima."""
    count = max(2, -(-len(data) // STEP) + 1)
    best = None
    for k in range(0, count - 1, LONG_BLOCKS):
        end = min(count, k + LONG_BLOCKS + 1)  # the last block of a slice is the next one's first
        blocks = np.full((end - k) * STEP, 256, np.int16)
        own = data[k * STEP : end * STEP]
        blocks[: len(own)] = own
        x = net.embed[blocks.reshape(-1, STEP)].reshape(end - k, -1)
        most = (x[:-1] @ net.near + x[1:] @ net.far).max(0)
        best = most if best is None else np.maximum(best, most)
    return (best + net.bias)[None]


def probability(net: Network, best: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.maximum(best, 0) @ net.out + net.base, -30, 30)))


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the logistic loss. The seed and the order of texts fix the result."""
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = Network(0.5 * draw(257, WIDTH), 0.12 * draw(STEP * WIDTH, FILTERS), 0.12 * draw(STEP * WIDTH, FILTERS), np.zeros(FILTERS, np.float32), 0.1 * draw(FILTERS), np.zeros(1, np.float32))
    y = np.array(labels, np.float32)
    net.base[0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    made = [chunks(*text_bytes(pa.array([x or ""], pa.large_string())))[0] for x in texts]
    m, v, t = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()], 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            blocks = np.concatenate([made[i] for i in rows])
            first = np.concatenate(([0], np.cumsum([len(made[i]) for i in rows])))
            best, won = pooled(net, blocks, first, winners=True)
            error = (probability(net, best) - y[rows]) / len(rows)
            hidden = np.maximum(best, 0)
            delta = (error[:, None] * net.out * (best > 0)).astype(np.float32)
            one, two = blocks[won], blocks[won + 1]  # rows x FILTERS x STEP
            e1, e2 = net.embed[one].reshape(*won.shape, -1), net.embed[two].reshape(*won.shape, -1)
            grads = [np.zeros_like(net.embed), np.einsum("rf,rfx->xf", delta, e1), np.einsum("rf,rfx->xf", delta, e2), delta.sum(0), hidden.T @ error, np.array([error.sum()])]
            for half, filters in ((one, net.near), (two, net.far)):
                np.add.at(grads[0], half, (delta[:, :, None] * filters.T[None]).reshape(*half.shape, WIDTH))
            grads[4] += 1e-4 * net.out
            t += 1
            rate = RATE * (1 - epoch / epochs)
            for p, g, a, b in zip(net.parts(), grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network | None:
    """Trains on up to `rows` labelled documents of at most `chars` characters, first by a hash of the id.

    labels: doc_id, quality (null labels are skipped, and labels of documents that docs lacks; of several the largest counts;
    of several texts of an id the smallest). None if none is usable. What reaches the driver is bounded by rows x chars;
    only ids, and the chosen ids' texts, are shuffled, copies put together first, as those ids are few and broadcast.
    """
    usable = docs.where(F.length("text") <= chars)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.join(usable.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    joined = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most `rows` ids
    found = sorted((r["doc_id"], r["text"], r["quality"]) for r in joined.toLocalIterator())
    return train([x for _, x, _ in found], [int(q > 0) for *_, q in found]) if found else None


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with score, the probability of good quality, from the text alone; 0.5 if nothing was learned.

    Null and empty texts score as one chunk without bytes. Rows that repeat score alike; other columns pass through, but for
    one named score, which is replaced. Texts of any length are read whole, long ones by slices. No documents give no rows.
    """
    docs = without(docs, "score")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches):
        net = sent.value
        for batch in batches:
            for part, data, at in pieces(batch):
                if net is None:
                    p = np.full(part.num_rows, 0.5)
                else:
                    p = probability(net, pooled_long(net, data) if part.num_rows == 1 and len(data) > LONG_BLOCKS * STEP else pooled(net, *chunks(data, at)))
                p = np.round(p.astype(np.float64), 6)  # last digits depend on what else is in the piece
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p, pa.float64())], [*part.schema.names, "score"])

    return map_batches(docs, scan, schema)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    net = fit(docs, labels.where(remainder(F.col("doc_id"), 4) != 2))
    found = score(docs.select("doc_id", "text"), net)
    return found.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
