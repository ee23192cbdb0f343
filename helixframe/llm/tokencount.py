"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie over bytes. Each node has a failure link and the number of pieces that following it
pops, both worked out beforehand (the LinMaxMatch rules of Song et al., 2021, with counts for lists of pieces), so that
the greedy longest-match length of a unit comes from one pass over its bytes, and no piece is ever built. A unit is a
run of bytes other than white space, with the one space before it, if any; other white space is units of its own.
Units of a piece of text that have the same bytes are counted once, and all of them step through the automaton together.
"""

from __future__ import annotations

import base64
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from helixframe.llm.common import SOLID_BYTE, HashIndex, distinct_spans, map_batches, pieces, runs, without

#: A file of "base64 rank" lines; read on the driver and sent to tasks. Without it count() needs a vocabulary.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Units that aren't stepped as arrays any more: there a step has a fixed cost of many bytes.
FEW = 64


def load(path: str = VOCABULARY) -> list[bytes]:
    """Pieces of a vocabulary file: lines of base64 and a rank, or a JSON list of strings. A path where no file is raises
    FileNotFoundError, before any job runs."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw.lstrip()[:1] == b"[":
        return [x.encode() for x in json.loads(raw)]
    return [base64.b64decode(line.split()[0]) for line in raw.splitlines() if line.strip()]


class Automaton:
    """Arrays over trie nodes: moves (node * 256 + byte -> node), fail, pops. Every single byte is a piece, as single
    bytes that the vocabulary lacks are added."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}]
        piece = [False]
        for word in sorted({*vocabulary, *(bytes([b]) for b in range(256))} - {b""}):
            node = 0
            for b in word:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    piece.append(False)
                node = children[node][b]
            piece[node] = True
        n = len(children)
        fail, pops = np.zeros(n, np.int32), np.zeros(n, np.int32)
        level = [0]
        while level:  # breadth first: shorter strings' links are known
            after = []
            for u in level:
                for b, v in children[u].items():
                    after.append(v)
                    if piece[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, count = int(fail[u]), int(pops[u])
                    while b not in children[z]:  # ends at the root at the latest, which has every byte
                        count += int(pops[z])
                        z = int(fail[z])
                    fail[v], pops[v] = children[z][b], count
            level = after
        keys = np.array([u << 8 | b for u in range(n) for b in children[u]], np.uint64)
        self.moves, self.to = HashIndex(keys), np.array([v for c in children for v in c.values()], np.int32)
        self.fail, self.pops = fail, pops
        self.plain = None
        self.root = np.array([children[0][b] for b in range(256)], np.int32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"plain": None}

    def alone(self, unit: bytes, state: int, count: int) -> tuple[int, int]:
        """State and pieces after `unit`, stepped by itself: a byte costs the same however few units are left."""
        if self.plain is None:
            slots = np.flatnonzero(self.moves.values >= 0)
            self.plain = dict(zip(self.moves.keys[slots].tolist(), self.to[self.moves.values[slots]].tolist(), strict=True)), self.fail.tolist(), self.pops.tolist()
        moves, fail, pops = self.plain
        for b in unit:
            after = moves.get(state << 8 | b)
            while after is None:
                count += pops[state]
                state = fail[state]
                after = moves.get(state << 8 | b)
            state = after
        return state, count

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each unit, all units stepped byte by byte together; longer ones go on when shorter ones are done, and
        the last FEW by themselves."""
        order = np.argsort(starts - ends, kind="stable")
        starts, size = starts[order], (ends - starts)[order]
        state, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live = len(starts)
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size[:live], -k, "left"))
            if live <= FEW:
                for i in range(live):
                    state[i], count[i] = self.alone(data[starts[i] + k : starts[i] + size[i]].tobytes(), int(state[i]), int(count[i]))
                break
            byte = data[starts[:live] + k].astype(np.int64)
            todo = np.arange(live)
            while len(todo):
                s, b = state[todo], byte[todo]
                move = self.moves.find((s << 8 | b).astype(np.uint64))
                ok = move >= 0
                state[todo[ok]] = self.to[move[ok]]
                todo, s = todo[~ok], s[~ok]
                count[todo] += self.pops[s]
                state[todo] = self.fail[s]
        todo = np.flatnonzero(state)
        while len(todo):
            s = state[todo]
            count[todo] += self.pops[s]
            state[todo] = self.fail[s]
            todo = todo[self.fail[s] > 0]
        out = np.empty(len(order), np.int64)
        out[order] = count
        return out


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of units."""
    solid = SOLID_BYTE[data]
    starts, ends = runs(solid, at)
    border = np.zeros(len(data) + 1, bool)
    border[at] = True
    spaced = (starts > 0) & ~border[starts]
    spaced[spaced] = data[starts[spaced] - 1] == 32
    starts = starts - spaced
    rest = ~solid
    rest[starts[spaced]] = False
    a, b = runs(rest, at)
    starts, ends = np.concatenate((starts, a)), np.concatenate((ends, b))
    by = np.argsort(starts)
    return starts[by], ends[by]


def count(docs: DataFrame, vocabulary: list[bytes] | None = None) -> DataFrame:
    """docs with n_units, n_tokens and n_bytes of whole texts; 0 for null and empty ones.

    Rows that repeat are each counted; other columns pass through, but for those that have one of the three names,
    which are replaced. Long units cost time in proportion to their bytes. No documents give no rows. The automaton is broadcast: a vocabulary is bounded.
    """
    docs = without(docs, "n_units", "n_tokens", "n_bytes")
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(load() if vocabulary is None else vocabulary))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n_units", "n_tokens", "n_bytes")]])

    def scan(batches):
        automaton = sent.value
        for batch in batches:
            for part, data, at in pieces(batch):
                starts, ends = units(data, at)
                one, same, _ = distinct_spans(data, starts, ends)
                n = np.concatenate(([0], np.cumsum(automaton.counts(data, starts[one], ends[one])[same])))
                first = np.searchsorted(starts, at)
                columns = [np.diff(first), n[first[1:]] - n[first[:-1]], np.diff(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, pa.int64()) for c in columns]], [*part.schema.names, "n_units", "n_tokens", "n_bytes"])

    return map_batches(docs, scan, schema)


def op4_tokencount(spark, sf_dir: str) -> DataFrame:
    return count(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
