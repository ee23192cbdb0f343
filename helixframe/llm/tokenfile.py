"""Token ids as raw binary shards, with a minimal perfect hash index from document keys to their places.

Documents are range-partitioned by doc_id, so that shard files in order hold them in ascending order. The task of a range
encodes its texts and writes one shard: a header of 16 bytes, then the ids of one document after the other, each as a
little-endian number of 2 or 4 bytes (what the vocabulary needs). Keys are dealt to buckets by a hash; each bucket is a
file of its own with a minimal perfect hash: levels of bits in which a key owns the place where it is alone, the others going
to the next level, so that the rank of a key's bit is a number from 0 to n - 1 of its own. At that number stand the key's
fingerprint (64 bits; it tells keys that were never stored), shard, place and length. Looking a key up takes a few reads of
fixed places, however large the corpus, and reading its ids one more.

A key is a doc_id and the number of the copy, from 0, as doc_ids may repeat. Files are written under a name of the task attempt's own
and moved into place when whole, so that a lost executor leaves no half file; a repeated attempt writes the same bytes.
"""

from __future__ import annotations

import io
import json
import os
import uuid
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import LOWER, SOLID_BYTE, cut, distinct_spans, forget, fragments, pieces, runs, text_bytes
from helixframe.sources.ranges import file_system
from helixframe.sources.shared import new_folder

#: Text that a shard is made of, about, and how many shards there are at most (then they are larger).
SHARD_BYTES, SHARDS = 64 << 20, 50_000
#: Keys in a bucket of the index, about; room for a level's bits, and levels before what is left goes to a sorted list.
BUCKET_KEYS, ROOM, LEVELS = 1 << 16, 2.0, 40
#: Parts of texts whose ids a task remembers, and their bytes, about; text that is encoded at once; copies of a doc_id that one row stands for.
REMEMBERED, REMEMBERED_BYTES, ENCODED_BYTES, COPIES = 1 << 19, 32 << 20, 2 << 20, 1 << 16
#: Kinds of bytes: ASCII letters, apostrophes, digits and other signs (0: the rest).
LETTER, APOSTROPHE, DIGIT, SIGN = 1, 2, 3, 4
KIND = np.zeros(256, np.uint8)
KIND[33:127] = SIGN
KIND[48:58], KIND[39] = DIGIT, APOSTROPHE
KIND[65:91] = KIND[97:123] = LETTER
#: Bytes of ids in a batch of read(), about.
READ_BYTES = 8 << 20
MAGIC, HEADER = b"HXIDS001", 16
END_ID = 2


class Put:
    """A file that is there whole, under its name, once close() is done, and not at all before."""

    def __init__(self, folder: str, name: str):
        self.system, path = file_system(folder)
        self.own, self.name = f"{path}/.{name}.{uuid.uuid4().hex}", f"{path}/{name}"
        self.file = self.system.open_output_stream(self.own, compression=None)
        self.write = self.file.write

    def close(self) -> None:
        self.file.close()
        self.system.move(self.own, self.name)


def got(folder: str, name: str) -> bytes:
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        return f.read()


def cut_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text with A-Z lower-cased, and the starts and ends of parts that the tokenizer takes one by one: it lower-cases, drops white
    space, and takes runs of letters, single digits and runs of other signs, an apostrophe with letters behind it as one. Cuts are
    made where ASCII alone tells that: at white space, after a letter, around a digit, and before a letter that
    follows another sign than an apostrophe. What may hold a special token (<|) stays as it is."""
    starts, ends = runs(SOLID_BYTE[data], at)
    kind = KIND[data]
    left, right = kind[:-1], kind[1:]
    inner = np.zeros(len(data), bool)
    inner[1:] = ((left == LETTER) & (right > LETTER)) | ((left == DIGIT) & (right > 0)) | ((left > 0) & (right == DIGIT)) | ((left == SIGN) & (right == LETTER))
    lowered = LOWER[data]
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    for k in np.unique(np.searchsorted(starts, special, "right") - 1).tolist():
        lowered[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        inner[starts[k] : ends[k]] = False
    border = np.zeros(len(data) + 1, bool)
    border[starts], border[ends] = True, True
    border[:-1] |= inner & SOLID_BYTE[data]
    solid = np.concatenate((SOLID_BYTE[data], [False]))
    places = np.flatnonzero(border)
    firsts = places[solid[places]]
    lasts = np.concatenate((places[1:], [len(data)]))[solid[places]]
    return lowered, firsts, lasts


class Encoder:
    """Texts to ids: each distinct part of cut_words() is encoded once, as long as a task remembers it."""

    def __init__(self, tokenizer: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_str(tokenizer), end
        self.known: dict[bytes, int] = {}
        self.length, self.flat, self.first, self.each, self.uses = 0, np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(3))

    def forget(self, least: int) -> None:
        """Keeps the parts that were asked for `least` times."""
        keep = np.flatnonzero(self.uses >= least)
        names = list(self.known)  # in order of their numbers
        self.known = {names[k]: i for i, k in enumerate(keep.tolist())}
        each = self.each[keep]
        first = np.cumsum(each) - each
        self.flat = self.flat[np.repeat(self.first[keep] - first, each) + np.arange(int(each.sum()))]
        self.length, self.first, self.each, self.uses = sum(map(len, self.known)), first, each, np.zeros(len(keep), np.int64)

    def numbers(self, parts: list[bytes]) -> np.ndarray:
        """The number of each part among those known; `first` and `each` say where in `flat` its ids begin, and how many they are.
        parts: each once."""
        for least in (2, 1 << 62):  # most parts come once only
            if len(self.known) > REMEMBERED or self.length > REMEMBERED_BYTES:
                self.forget(least)
        known = self.known
        new = [x for x in parts if x not in known]
        if new:
            ids: list[int] = []
            sizes = []
            for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in new], add_special_tokens=False):
                own = e.ids
                ids += own
                sizes.append(len(own))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.length += sum(map(len, new))
            each = np.array(sizes, np.int64)
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(each) - each))
            self.flat, self.each, self.uses = np.concatenate((self.flat, np.array(ids, np.uint32))), np.concatenate((self.each, each)), np.concatenate((self.uses, np.zeros(len(new), np.int64)))
        out = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
        self.uses[out] += 1
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each with the end id, and how many each has."""
        data, at = text_bytes(texts.fill_null("") if texts.null_count else texts)
        counts, flats, rows = np.zeros(len(texts), np.int64), [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for row, own, bounds in fragments(data, at, ~SOLID_BYTE, ENCODED_BYTES):
            own, starts, ends = cut_words(own, bounds)
            if not len(starts):
                continue
            one, same, _ = distinct_spans(own, starts, ends)
            raw = own.tobytes()
            number = self.numbers([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])[same]
            first, each = self.first[number], self.each[number]
            flats.append(self.flat[np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))])
            owner = row[np.searchsorted(bounds, starts, "right") - 1]
            counts += np.bincount(owner, each, len(counts)).astype(np.int64)
            rows.append(np.repeat(owner.astype(np.int32), each))
        flat, row = np.concatenate(flats), np.concatenate(rows)
        out = np.full(len(flat) + len(counts), self.end, np.uint32)
        out[np.arange(len(flat)) + row] = flat
        return out, counts + 1


#: This process's encoder: the next task goes on with what the last one remembers.
_encoder: list = []


def encoder_of(tokenizer: str, end: int) -> Encoder:
    name = (hash(tokenizer), len(tokenizer), end)
    if not _encoder or _encoder[0][0] != name:
        _encoder[:] = [(name, Encoder(tokenizer, end))]
    return _encoder[0][1]


def key_hashes(ids: list, copies: list) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of each key: what the index hashes, and the fingerprint."""
    digest = b"".join(blake2b(f"{copy}:{'null' if i is None else f'id {i}'}".encode(), digest_size=16).digest() for i, copy in zip(ids, copies, strict=True))
    both = np.frombuffer(digest, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def spread(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    """The place of each key among `size` on a level."""
    x = (keys ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class MinimalHash:
    """Numbers 0 to n - 1 for n keys (64-bit numbers), without storing them. Keys that are alike, or clash on every level, share
    a sorted list; `rest` tells those apart by the fingerprint."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray, rest: np.ndarray):
        self.sizes, self.words, self.rest = sizes, words, rest
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.ranks = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def of(cls, keys: np.ndarray, marks: np.ndarray) -> MinimalHash:
        left, sizes, bits = np.arange(len(keys)), [], []
        while len(left) and len(sizes) < LEVELS:
            size = 64 * int(np.ceil(ROOM * len(left) / 64))
            place = spread(keys[left], len(sizes), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            own = np.zeros(size, np.uint8)
            own[place[alone]] = 1
            bits.append(own)
            sizes.append(size)
            left = left[~alone]
        words = np.packbits(np.concatenate([np.zeros(0, np.uint8), *bits]), bitorder="little").view("<u8")
        rest = np.array(sorted(zip(keys[left].tolist(), marks[left].tolist(), strict=True)), np.uint64).reshape(-1, 2)
        return cls(np.array(sizes, np.int64), words, rest)

    def find(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, of one that isn't there."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            place = self.first[level] + spread(keys[left], level, size)
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[here]] = (self.ranks[place >> 6] + below)[here]
            left = left[~here]
            if not len(left):
                return out
        known = {(k, m): int(self.ranks[-1]) + i for i, (k, m) in enumerate(self.rest.tolist())}
        for i in left.tolist():
            out[i] = known.get((int(keys[i]), int(marks[i])), -1)
        return out


class Bucket:
    """A part of the index: the minimal hash, and at each number a key's fingerprint, shard, place and length."""

    def __init__(self, minimal: MinimalHash, marks: np.ndarray, entries: np.ndarray):
        self.minimal, self.marks, self.entries = minimal, marks, entries

    @classmethod
    def of(cls, keys: np.ndarray, marks: np.ndarray, entries: np.ndarray) -> Bucket:
        """entries: shard, place and length of each key."""
        minimal = MinimalHash.of(keys, marks)
        number = minimal.find(keys, marks)
        by = np.empty(len(keys), np.int64)
        by[number] = np.arange(len(keys))
        return cls(minimal, marks[by], entries[by])

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=self.minimal.sizes, words=self.minimal.words, rest=self.minimal.rest, marks=self.marks, entries=self.entries)
        return out.getvalue()

    @classmethod
    def unpack(cls, raw: bytes) -> Bucket:
        with np.load(io.BytesIO(raw)) as x:
            return cls(MinimalHash(x["sizes"], x["words"], x["rest"]), x["marks"], x["entries"])

    def find(self, keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and shard, place and length of those."""
        number = self.minimal.find(keys, marks)
        there = (number >= 0) & (number < len(self.marks))
        there[there] = self.marks[number[there]] == marks[there]
        return there, self.entries[number[there]]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % np.uint64(buckets)).astype(np.int64)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int, width: int, shards: int) -> DataFrame:
    """Writes shard files; (doc_id, shard, at, n, copy, first) of each document: its place and length in ids, its number among
    the shard's documents of that doc_id, whether that is the shard's first doc_id."""
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer)
    kind = next(f.dataType for f in docs.schema.fields if f.name == "doc_id")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("shard", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("first", T.BooleanType())])
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).repartitionByRange(shards, F.asc_nulls_last("doc_id"), "mark").sortWithinPartitions(F.asc_nulls_last("doc_id"), "mark", "text")

    def write(batches):
        encoder, shard = encoder_of(sent.value, end), TaskContext.get().partitionId()
        file, at, before, copy, first = None, 0, None, -1, True
        for batch in (part for whole in batches for part, *_ in pieces(whole, limit=ENCODED_BYTES)):
            if file is None:
                file = Put(folder, shard_name(shard))
                file.write(MAGIC + np.array([width, end], "<u4").tobytes())
            ids, n = encoder.encode(batch.column("text"))
            copies, firsts = [], []
            for i in batch.column("doc_id").to_pylist():
                if copy >= 0 and i == before:
                    copy += 1
                else:
                    before, first, copy = i, copy < 0, 0
                copies.append(copy)
                firsts.append(first)
            file.write(ids.astype(f"<u{width}").tobytes())
            place = at + np.cumsum(n) - n
            at += int(n.sum())
            columns = [batch.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(place), pa.array(n), pa.array(copies, pa.int64()), pa.array(firsts)]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])
        if file is not None:
            file.close()

    return cut(ranged.mapInArrow(write, schema))


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.ids"


def bucket_name(bucket: int) -> str:
    return f"index-{bucket:06d}.npz"


class Store:
    """A folder of shards and index: `about` is what its manifest says."""

    def __init__(self, folder: str):
        self.folder = folder
        self.about = json.loads(got(folder, "manifest.json"))
        self.width, self.buckets = self.about["width"], self.about["buckets"]
        #: Ids of all documents before each shard.
        self.base = {int(k): v for k, v in self.about["base"].items()}

    def bucket(self, number: int) -> Bucket:
        return Bucket.unpack(got(self.folder, bucket_name(number)))

    def ids(self, shard: int, at: int, n: int) -> np.ndarray:
        """Ids at a place, as 32-bit numbers."""
        system, path = file_system(self.folder)
        with system.open_input_file(f"{path}/{shard_name(shard)}") as f:
            f.seek(HEADER + at * self.width)
            return np.frombuffer(f.read(n * self.width), f"<u{self.width}").astype("<u4")

    def get(self, doc_id, copy: int = 0) -> np.ndarray | None:
        """A document's ids by its key, in this process; None if there is no such key."""
        keys, marks = key_hashes([None if doc_id is None else str(doc_id)], [copy])
        if not self.buckets:
            return None
        there, entries = self.bucket(int(bucket_of(keys, self.buckets)[0])).find(keys, marks)
        return self.ids(*entries[0].tolist()) if there[0] else None

    def places(self, keys: DataFrame) -> DataFrame:
        """(doc_id, copy, shard, at, n) of the keys (doc_id, copy) that the store has, by its index; others have no row."""
        folder, buckets = self.folder, self.buckets
        kind = next(f.dataType.simpleString() for f in keys.schema.fields if f.name == "doc_id")
        found = f"doc_id {kind}, copy long, shard int, at long, n long"

        def deal(batches):
            for batch in batches:
                h, mark = key_hashes(batch.column("_key").to_pylist(), batch.column("copy").to_pylist())
                columns = [batch.column("doc_id"), batch.column("copy"), pa.array(h.view(np.int64)), pa.array(mark.view(np.int64)), pa.array(bucket_of(h, buckets).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "copy", "h", "mark", "bucket"])

        def look(batches):
            number, bucket = -1, None
            for batch in batches:
                own = batch.column("bucket").to_numpy()
                borders = [0, *(np.flatnonzero(own[1:] != own[:-1]) + 1).tolist(), len(own)]
                for a, b in zip(borders, borders[1:]):
                    if b == a:
                        continue
                    if own[a] != number:
                        number = int(own[a])
                        bucket = Bucket.unpack(got(folder, bucket_name(number)))
                    part = batch.slice(a, b - a)
                    there, entries = bucket.find(part.column("h").to_numpy().view(np.uint64), part.column("mark").to_numpy().view(np.uint64))
                    part = part.filter(pa.array(there))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copy"), pa.array(entries[:, 0], pa.int32()), pa.array(entries[:, 1]), pa.array(entries[:, 2])], ["doc_id", "copy", "shard", "at", "n"])

        if not buckets:
            return keys.sparkSession.createDataFrame([], found)
        dealt = keys.select("doc_id", F.col("copy").cast("long").alias("copy"), F.col("doc_id").cast("string").alias("_key")).mapInArrow(deal, f"doc_id {kind}, copy long, h long, mark long, bucket int")
        return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(look, found)

    def read(self, places: DataFrame) -> DataFrame:
        """places (doc_id, copy, shard, at, n) with start (ids of all documents before) and ids (32-bit little-endian numbers), from
        the shards, each read from its first place asked for to its last."""
        folder, width, base = self.folder, self.width, self.base
        schema = T.StructType([*places.schema.fields, T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

        def fetch(batches):
            system, path = file_system(folder)
            number, file = -1, None
            for batch in batches:
                k, shards, at, n = 0, *(batch.column(c).to_pylist() for c in ("shard", "at", "n"))
                while k < len(shards):
                    part, size = k, 0
                    raw = []
                    while part < len(shards) and size < READ_BYTES:
                        if shards[part] != number:
                            if file is not None:
                                file.close()
                            number = shards[part]
                            file = system.open_input_file(f"{path}/{shard_name(number)}")
                        file.seek(HEADER + at[part] * width)
                        raw.append(np.frombuffer(file.read(n[part] * width), f"<u{width}").astype("<u4").tobytes())
                        size += len(raw[-1])
                        part += 1
                    own = batch.slice(k, part - k)
                    start = [base[s] + x for s, x in zip(shards[k:part], at[k:part], strict=True)]
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(start, pa.int64()), pa.array(raw, pa.binary())], [*own.schema.names, "start", "ids"])
                    k = part
            if file is not None:
                file.close()

        return places.repartition("shard").sortWithinPartitions("shard", "at").mapInArrow(fetch, schema)


def carried(rows: list) -> dict[int, int]:
    """How many documents of a shard's first doc_id earlier shards have, from a row for each shard, in order."""
    out, before, seen = {}, None, 0
    for r in rows:
        goes_on = before is not None and before["last"] == r["least"]
        out[r["shard"]] = seen if goes_on else 0
        seen = r["copies"] + (out[r["shard"]] if r["alone"] == r["docs"] else 0)
        before = r
    return out


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END_ID, shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> Store:
    """Writes documents' ids (doc_id, text) to a folder of the shared file system, and opens the store.

    tokenizer: path of a file of the tokenizers library, read on the driver. Null and empty texts have the end id alone. Null doc_ids come
    last, and are the key None; rows that repeat a doc_id come in order of a hash of their texts, each with a number of its own. No documents
    give a store without shards. Texts of any length are encoded whole, in parts between white space.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    with open(tokenizer) as f:
        text = f.read()
    top = max([end, *Tokenizer.from_str(text).get_vocab(with_added_tokens=True).values()])
    width = 2 if top < 1 << 16 else 4
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16).alias("n")).first()["n"] or 0
    shards = max(1, min(SHARDS, -(-size // shard_bytes)))
    held = write_shards(docs, folder, text, end, width, shards)
    # One row a shard, of which there are SHARDS at most.
    rows = held.groupBy("shard").agg(
        F.sum("n").alias("ids"), F.count(F.lit(1)).alias("docs"), F.count_if("first").alias("alone"), F.min_by("doc_id", "at").alias("least"), F.max_by("doc_id", "at").alias("last"),
        (F.max_by("copy", "at") + 1).alias("copies"),
    ).orderBy("shard").collect()
    more = {s: n for s, n in carried(rows).items() if n}
    keys = held
    if more:
        extra = spark.createDataFrame(list(more.items()), "shard int, more long")
        keys = held.join(F.broadcast(extra), "shard", "left").withColumn("copy", F.col("copy") + F.when(F.col("first"), F.coalesce("more", F.lit(0))).otherwise(0))
    buckets = -(-sum(r["docs"] for r in rows) // bucket_keys)
    if buckets:
        index(keys, folder, buckets)
    base = np.cumsum([0, *(r["ids"] for r in rows)]).tolist()
    about = {"width": width, "end": end, "buckets": buckets, "docs": sum(r["docs"] for r in rows), "ids": base[-1], "base": {r["shard"]: b for r, b in zip(rows, base)}}
    file = Put(folder, "manifest.json")
    file.write(json.dumps(about).encode())
    file.close()
    forget(held)
    return Store(folder)


def index(keys: DataFrame, folder: str, buckets: int) -> None:
    """Writes a file for each bucket of keys (doc_id, copy, shard, at, n)."""

    def deal(batches):
        for batch in batches:
            h, mark = key_hashes(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(mark.view(np.int64)), *[batch.column(c) for c in ("shard", "at", "n")], pa.array(bucket_of(h, buckets).astype(np.int32))], ["h", "mark", "shard", "at", "n", "bucket"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        number, column = int(pdf["bucket"].iloc[0]), lambda c: pdf[c].to_numpy(np.int64)
        file = Put(folder, bucket_name(number))
        file.write(Bucket.of(column("h").view(np.uint64), column("mark").view(np.uint64), np.stack([column("shard"), column("at"), column("n")], 1)).pack())
        file.close()
        return pd.DataFrame({"bucket": [number], "keys": [len(pdf)]})

    dealt = keys.select(F.col("doc_id").cast("string").alias("doc_id"), "copy", "shard", "at", "n").mapInArrow(deal, "h long, mark long, shard int, at long, n long, bucket int")
    dealt.groupBy("bucket").applyInPandas(build, "bucket int, keys long").agg(F.sum("keys")).first()  # a bucket has bucket_keys, about, whatever the keys


def keys_of(docs: DataFrame) -> DataFrame:
    """(doc_id, copy): a key for each row; a doc_id of very many rows is spread over tasks."""
    counted = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"))
    many = counted.where(F.col("rows") > COPIES).select("doc_id", "rows", F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(COPIES))).alias("low")).repartition("doc_id", "low")
    spans = counted.where(F.col("rows") <= COPIES).select("doc_id", "rows", F.lit(0).cast("long").alias("low")).union(many)
    return spans.select("doc_id", F.explode(F.sequence(F.col("low"), F.least(F.col("rows"), F.col("low") + COPIES) - 1)).alias("copy"))


def op12_tokenfile(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store = write(docs, new_folder(spark), public_tokenizers.path("word_bpe_49k.json"))
    read = store.read(store.places(keys_of(docs)))
    return read.select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
