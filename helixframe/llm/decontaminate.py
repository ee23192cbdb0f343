"""Benchmark decontamination by an FM-index for each shard of the training texts.

A shard is a run of whole documents (about 2 MB of text) that one task has at hand. Its words become symbols of the
benchmark's vocabulary; words that no benchmark item has can be in no match and stand as borders. Over that sequence an
FM-index is built (fmindex.py), every benchmark window whose words the shard has is searched backward through its
wavelet-tree ranks, occurrences are located by sampled suffix positions, and hit words are merged into removal spans.
Training texts are not shuffled. The benchmark is cut into blocks of bounded size by Spark, each packed by a task and
written to the shared folder; the driver and the workers hold one block at a time. A benchmark of one block (16 MB of
text) takes one pass over the texts. A larger one takes a pass for each block, which writes what it has found, not the
texts: those are written once, and changed ones once a round when texts are cleaned.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import Vocabulary, Words, cut, few, forget, map_batches, pieces, runs, without, words_of
from helixframe.llm.fmindex import FMIndex

#: Words in a window; benchmark text in a block, about.
WINDOW, BLOCK_BYTES = 10, 16 << 20
#: Text in a shard, about; windows that are searched side by side.
SHARD_BYTES, TOGETHER = 2 << 20, 1 << 16
#: Occurrences, or pairs of rows and items, that are looked at together.
AT_ONCE = 1 << 20
NEW = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


@dataclass
class Block:
    """Some benchmark items: their words as symbols (from 1), the first word and length of each distinct window, and the numbers of
    the names of the items that have window w: items[first[w] : first[w + 1]]."""

    vocabulary: Vocabulary
    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: np.ndarray
    names: list[str]


def padded(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Windows as rows, filled from the left, 0 behind."""
    column = np.arange(int(lengths.max(initial=1)))
    inside = column < lengths[:, None]
    return np.where(inside, symbols[np.where(inside, starts[:, None] + column, 0)] if len(symbols) else 0, 0)


def block_of(items: list[str | None], texts: list[str], window: int) -> Block:
    words = words_of(texts)
    names = sorted({x for x in items if x is not None})
    number = {x: k for k, x in enumerate(names)} | {None: -1}
    size = np.minimum(window, words.counts)
    n = np.where(size > 0, words.counts - size + 1, 0)
    starts = np.repeat(words.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    vocabulary = Vocabulary(words)
    symbols, lengths = (vocabulary.numbers + 1).astype(np.int32), np.repeat(size, n).astype(np.int32)
    item = np.repeat(np.array([number[x] for x in items], np.int64), n)
    rows = padded(symbols, starts, lengths)
    _, one, same = np.unique(np.ascontiguousarray(rows).view([("", rows.dtype)] * rows.shape[1]).ravel(), return_index=True, return_inverse=True)
    top = max(1, len(names))
    pairs = np.unique(same.ravel()[item >= 0] * top + item[item >= 0])  # a window that an item repeats counts once
    return Block(vocabulary, symbols, starts[one], lengths[one], np.searchsorted(pairs // top, np.arange(len(one) + 1)), (pairs % top).astype(np.int32), names)


def blocks_of(benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(block, data): items dealt to blocks of about block_bytes of text each, and packed there. An item is in one block."""
    given = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), "text").distinct()
    total = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["text", "item"], na_position="first")
        items = [None if pd.isna(x) else x for x in rows["item"]]
        return pd.DataFrame({"block": [int(pdf["block"].iloc[0])], "data": [pickle.dumps(block_of(items, rows["text"].tolist(), window), 5)]})

    dealt = given.withColumn("block", F.pmod(F.xxhash64("text", "item", F.lit(3)), F.lit(blocks)).cast("int"))
    return cut(dealt.groupBy("block").applyInPandas(pack, "block int, data binary"))


def search_block(words: Words, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hit marks (+1 and -1 at word borders) and the pairs (row, item) found in a shard."""
    marks = np.zeros(len(words.starts) + 1, np.int64)
    none = np.zeros(0, np.int64)
    known = block.vocabulary.find(words).astype(np.int64) + 1
    # A border before the first word of each row and one for each run of unknown words; known words stay as they are.
    new_row = np.zeros(len(known), bool)
    new_row[words.first[:-1][words.counts > 0]] = True
    after_gap = np.concatenate(([True], known[:-1] == 0)) | new_row
    word = np.flatnonzero(known)
    # A window one of whose words the shard lacks can't be there.
    here = np.zeros(len(block.vocabulary) + 1, bool)
    here[known[word]] = True
    lacks = np.concatenate(([0], np.cumsum(~here[block.symbols], dtype=np.int32)))
    asked = np.flatnonzero(lacks[block.starts + block.lengths] == lacks[block.starts])
    if not len(asked):
        return marks, none, none
    gap = after_gap[word]
    place = np.arange(len(word)) + np.cumsum(gap)
    symbols = np.zeros(int(place[-1]) + 2, np.int64)
    symbols[place] = known[word]
    word_at = np.full(len(symbols), -1, np.int64)
    word_at[place] = word
    fm = FMIndex(symbols, len(block.vocabulary))
    pairs, names = [none], max(1, len(block.names))
    windows: list[np.ndarray] = [none]
    for k in range(0, len(asked), TOGETHER):
        some = asked[k : k + TOGETHER]
        lengths = block.lengths[some]
        low, high = fm.search(padded(block.symbols, block.starts[some], lengths).astype(np.int64), lengths)
        # Distinct windows of a length never begin at the same word, so that all occurrences are WINDOW times the words at most.
        there = np.flatnonzero(high > low)
        low, found, some, lengths = low[there], (high - low)[there], some[there], lengths[there]
        ends = np.cumsum(found)
        for a in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
            rank = np.arange(a, min(a + AT_ONCE, int(ends[-1])))
            own = np.searchsorted(ends, rank, "right")
            start = word_at[fm.locate(low[own] + rank - (ends - found)[own])]
            marks += np.bincount(start, minlength=len(marks)) - np.bincount(start + lengths[own], minlength=len(marks))
            windows.append(np.unique(words.row[start] * len(block.starts) + some[own]))
    # Rows and the windows that they have, once each, to rows and items.
    row, window = np.divmod(np.unique(np.concatenate(windows)), max(1, len(block.starts)))
    each = (block.first[1:] - block.first[:-1])[window] if len(window) else none
    ends = np.cumsum(each)
    for a in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        rank = np.arange(a, min(a + AT_ONCE, int(ends[-1])))
        own = np.searchsorted(ends, rank, "right")
        pairs.append(np.unique(row[own] * names + block.items[block.first[window[own]] + rank - (ends - each)[own]]))
    return marks, *np.divmod(np.unique(np.concatenate(pairs)), names)


def spans_of(marks: np.ndarray, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hit words of each row, and merged removal spans in bytes of the row: row, start, end."""
    hit = np.cumsum(marks[:-1]) > 0
    sums = np.concatenate(([0], np.cumsum(hit)))
    n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
    border = words.first
    a = np.zeros(len(hit) + 1, bool)
    a[border] = True
    first = np.flatnonzero(hit & (a[:-1] | ~np.concatenate(([False], hit[:-1]))))
    last = np.flatnonzero(hit & (a[1:] | ~np.concatenate((hit[1:], [False]))))
    row = words.row[first]
    return n_hit, row, words.starts[first] - at[row], words.ends[last] - at[row]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """docs with n_words, n_hit, items (strings, sorted, distinct) and spans (start, end: UTF-8 bytes of the text).

    clean: text loses its spans instead (each leaves one line break), until no window is left even across cuts, and
    n_chars, if there, is the new length; the result then has the columns of docs alone. A null text has no words and stays null. An item without words has no
    window; one without an item_id hits words but is named nowhere. Rows that repeat, and doc_ids that do, are each
    judged by their own text. Without items nothing is hit. Other columns pass through; unless texts are cleaned, those that
    have one of the four new names are replaced. Texts of any length are searched whole, one longer than a shard as a shard of its own.
    No documents give no rows.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs if clean else without(docs, *NEW.names)
    blocks = blocks_of(benchmark, window, block_bytes)
    numbers = sorted(r["block"] for r in blocks.select("block").collect()) or [None]  # one for each block_bytes of benchmark
    if len(numbers) > 1:
        return clean_by_blocks(docs, blocks, numbers, window) if clean else find_by_blocks(docs, blocks, numbers, window)
    return one_pass(docs, sc.broadcast(packed(blocks, numbers[0], window)), clean)


def packed(blocks: DataFrame, number: int | None, window: int) -> bytes:
    """One block, as it is sent to tasks; without a number one that has no items."""
    rows = blocks.where(F.col("block") == number).select("data").collect() if number is not None else []  # one block
    return bytes(rows[0]["data"]) if rows else pickle.dumps(block_of([], [], window), 5)


#: A document that was hit, by its row's number: its spans (words, end exclusive), and items.
ROW = "_helix_row"
HITS = T.StructType([T.StructField(ROW, T.LongType()), T.StructField("_helix_pairs", T.ArrayType(T.LongType())), T.StructField("_helix_names", T.ArrayType(T.StringType()))])


def hits_of(texts: DataFrame, sent) -> DataFrame:
    """HITS of texts (ROW, text) for one block: only of those that have any, and no text."""

    def scan(batches):
        block = pickle.loads(sent.value)
        for batch in batches:
            for part, data, at in pieces(batch, limit=SHARD_BYTES):
                words = Words(data, at)
                marks, rows, found = search_block(words, block)
                hit = np.concatenate(([False], np.cumsum(marks[:-1]) > 0, [False]))
                # Runs of hit words, a row's end ending one, as words of the row.
                starts, ends = runs(hit[1:-1], words.first)
                row = words.row[starts]
                some = np.unique(row)
                first = np.searchsorted(row, np.append(some, len(at)))
                pairs = np.stack([starts - words.first[row], ends - words.first[row]], 1).ravel()
                names = [[block.names[i] for i in found[a:b].tolist()] for a, b in zip(np.searchsorted(rows, some).tolist(), np.searchsorted(rows, some, "right").tolist(), strict=True)]
                columns = [part.column(ROW).take(pa.array(some)), pa.ListArray.from_arrays(pa.array(2 * first, pa.int32()), pa.array(pairs, pa.int64())), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, HITS.names)

    return texts.mapInArrow(scan, HITS)


def all_hits(texts: DataFrame, blocks: DataFrame, numbers: list[int], window: int) -> DataFrame:
    """HITS of all blocks, a row for each document hit; written, and a pass over the texts for each block. Of a document what each
    block has found is put together: as many entries as there are blocks at most."""
    sc, parts = texts.sparkSession.sparkContext, []
    for b in numbers:
        parts.append(cut(hits_of(texts, sc.broadcast(packed(blocks, b, window)))))
    both = parts[0]
    for p in parts[1:]:
        both = both.union(p)
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_helix_names"))))
    out = cut(both.groupBy(ROW).agg(F.flatten(F.collect_list("_helix_pairs")).alias("_helix_pairs"), names.alias("_helix_names")))
    forget(*parts)
    return out


def find_by_blocks(docs: DataFrame, blocks: DataFrame, numbers: list[int], window: int) -> DataFrame:
    """find() for several blocks: texts are written once, and each block's pass writes what it hits."""
    held = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    hits = all_hits(held.where("text is not null").select(ROW, "text"), blocks, numbers, window)
    schema, own = T.StructType([*docs.schema.fields, *NEW.fields]), slice(1, 1 + len(docs.columns))  # behind ROW, by which rows were joined

    def fill(batches):
        for batch in batches:
            for part, data, at in pieces(batch, limit=SHARD_BYTES):
                words = Words(data, at)
                n_hit, row, start, end = spans_of(marks_of(part, words), words, at)
                spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                items = [x or [] for x in part.column("_helix_names").to_pylist()]
                columns = [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(first, pa.int32()), spans)]
                yield pa.RecordBatch.from_arrays([*part.columns[own], *columns], [*part.schema.names[own], *NEW.names])

    return map_batches(held.join(few(hits), ROW, "left"), fill, schema)


def marks_of(part: pa.RecordBatch, words: Words) -> np.ndarray:
    """search_block()'s marks again, from the pairs of words in a batch with HITS."""
    marks = np.zeros(len(words.starts) + 1, np.int64)
    for r, pairs in enumerate(part.column("_helix_pairs").to_pylist()):
        if pairs:
            np.add.at(marks, words.first[r] + np.array(pairs[::2]), 1)
            np.add.at(marks, words.first[r] + np.array(pairs[1::2]), -1)
    return marks


def clean_by_blocks(docs: DataFrame, blocks: DataFrame, numbers: list[int], window: int) -> DataFrame:
    """find(clean=True) for several blocks. Each round cuts what any block hits out of the texts that the last round has changed, as a cut
    may bring a window of another block together; only changed texts are written again."""
    held = cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    texts, changed = held.where("text is not null").select(ROW, "text"), None
    while True:
        hits = all_hits(texts, blocks, numbers, window)
        if hits.isEmpty():
            forget(hits)
            break

        def shorten(batches):
            for batch in batches:
                for part, data, at in pieces(batch, limit=SHARD_BYTES):
                    words, once = Words(data, at), [0]

                    def spans(data, at, part=part, words=words, once=once):
                        once[0] += 1
                        return spans_of(marks_of(part, words), words, at)[1:] if once[0] == 1 else (np.zeros(0, np.int64),) * 3

                    yield cleaned(part, data, at, spans).select([ROW, "text"])

        newer = cut(texts.join(few(hits), ROW).mapInArrow(shorten, f"{ROW} long, text string"))
        forget(hits)
        texts = newer
        changed = newer if changed is None else cut(changed.join(newer.select(ROW), ROW, "left_anti").union(newer))
    if changed is None:
        return held.drop(ROW)
    other = changed.select(ROW, F.col("text").alias("_helix_text"))
    both = held.join(other, ROW, "left")
    gone = F.col("_helix_text").isNotNull()
    own = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.coalesce("_helix_text", "text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(gone, F.length("_helix_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[x.alias(c) for c, x in own.items()])


def one_pass(docs: DataFrame, sent, clean: bool) -> DataFrame:
    """find() for one block."""
    schema = docs.schema if clean else T.StructType([*docs.schema.fields, *NEW.fields])

    def scan(batches):
        block = pickle.loads(sent.value)

        def spans(data, at):
            words = Words(data, at)
            return spans_of(search_block(words, block)[0], words, at)[1:]

        for batch in batches:
            for part, data, at in pieces(batch, limit=SHARD_BYTES):
                if clean:
                    yield cleaned(part, data, at, spans)
                    continue
                words = Words(data, at)
                marks, rows, found = search_block(words, block)
                items: list[set] = [set() for _ in range(part.num_rows)]
                for r, i in zip(rows.tolist(), found.tolist(), strict=True):
                    items[r].add(block.names[i])
                n_hit, row, start, end = spans_of(marks, words, at)
                spanned = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                columns = [pa.array(words.counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.ListArray.from_arrays(pa.array(first, pa.int32()), spanned)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *NEW.names])

    return map_batches(docs, scan, schema)


def cleaned(part: pa.RecordBatch, data: np.ndarray, at: np.ndarray, search) -> pa.RecordBatch:
    """part without the spans that search(bytes, offsets) gives (row, start, end). A cut brings words together that may
    be a window again, so changed texts are searched anew until nothing is hit; each round takes words away."""
    number, new = np.arange(part.num_rows), {}
    row, start, end = search(data, at)
    while len(row):
        changed = np.unique(row)
        for r, a, b in zip(changed.tolist(), np.searchsorted(row, changed).tolist(), np.searchsorted(row, changed, "right").tolist(), strict=True):
            whole, kept, done = data[at[r] : at[r + 1]].tobytes(), [], 0
            for k in range(a, b):
                kept.append(whole[done : start[k]])
                done = end[k]
            new[int(number[r])] = b"\n".join([*kept, whole[done:]])
        number = number[changed]
        left = [new[k] for k in number.tolist()]
        data, at = np.frombuffer(b"".join(left), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in left])))
        row, start, end = search(data, at)
    if not new:
        return part
    columns, names = list(part.columns), part.schema.names
    texts = columns[names.index("text")].to_pylist()
    for k, x in new.items():
        texts[k] = x.decode("utf-8", "replace")
    columns[names.index("text")] = pa.array(texts, part.schema.field("text").type)
    if "n_chars" in names:
        lengths = columns[names.index("n_chars")].to_pylist()
        for k in new:
            lengths[k] = len(texts[k])
        columns[names.index("n_chars")] = pa.array(lengths, part.schema.field("n_chars").type)
    return pa.RecordBatch.from_arrays(columns, names)


def digest(found: DataFrame) -> DataFrame:
    """The columns of contract 3 from find()'s."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return digest(find(docs.select("doc_id", "text"), benchmark).drop("text"))


def lower(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


#: Words by a regular expression and windows by an equi-join on their text: another way to the same rows.
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
