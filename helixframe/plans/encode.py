"""The whole encoding as named frames."""

from __future__ import annotations

import functools
import itertools
import time
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.constants import MAX_END_GC, MAX_RUN, PAYLOAD_NT, SEGMENT_BITS, STRAND_NT
from helixframe.functions import folds, kernels
from helixframe.functions.dna import both_fingerprints, strand
from helixframe.functions.slices import mapped
from helixframe.operators import codebook, segments
from helixframe.sources.ranges import FILE_KEYS, FILES, file_chunks
from helixframe.sources.shared import cut, forget

#: Segments, and so bytes, of a chunk: what one row holds of a payload. An even number of segments ends with a byte.
CHUNK_SEGMENTS = 4096
CHUNK_BYTES = CHUNK_SEGMENTS * SEGMENT_BITS // 8
#: Blocks whose strands are fingerprinted as one part of a payload of several chunks; tables of parts that are joined at once.
PART_BLOCKS, PARTS = 2048, 256
#: Chunks of a file that one task reads.
READ_CHUNKS = 16
#: Payloads of more chunks are ranked by a rank filter before the shuffle, not each by one task.
LONG_CHUNKS = 16
#: Places of payloads of one chunk (every second number is one), and chunks of longer ones, that are a pack at most; code tables that are broadcast.
PACK_ROWS, PACK_CHUNKS, FEW_BOOKS = 512, 16, 64
PAIRS = "array<struct<substr: string, hits: bigint>>"


def payload_of(docs: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """(keys, payload): a text column's UTF-8 bytes, or a binary column."""
    kind = dict(docs.dtypes)[column]
    own = docs.select(*dict.fromkeys(keys), (F.col(column) if kind == "binary" else F.encode(F.col(column), "UTF-8")).alias("payload"))
    return spread(own)


def spread(own: DataFrame) -> DataFrame:
    """A small file is one task: payloads are spread if there are fewer tasks than cores, and stay where they are if not."""
    cores = own.sparkSession.sparkContext.defaultParallelism
    return own.repartition(cores) if own.rdd.getNumPartitions() < cores else own


def chunked(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """(_row, keys, chunk, chunks, bytes): payloads that aren't empty, in chunks of whole segments; _row numbers payloads, so
    that keys may be null or repeat. Chunks of long payloads are spread over tasks; others stay where they are."""
    spark = payloads.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = payloads.where(F.octet_length("payload") > 0).withColumn("chunks", F.ceil(F.octet_length("payload") / CHUNK_BYTES).cast("int")).withColumn("_id", F.monotonically_increasing_id() * 2)
    short = own.where("chunks = 1").select(F.col("_id").alias("_row"), *keys, F.lit(0).alias("chunk"), "chunks", F.col("payload").alias("bytes"))
    long = own.where("chunks > 1").select((F.col("_id") + 1).alias("_row"), *keys, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "chunks", "payload")
    long = long.select("_row", *keys, "chunk", "chunks", F.substring("payload", F.col("chunk") * CHUNK_BYTES + 1, F.lit(CHUNK_BYTES)).alias("bytes"))
    return short.union(long.repartition(tasks, "_row", "chunk"))


def tiles(dna) -> F.Column:
    """Pieces of 120 nucleotides in order, the last one may be short; in one pass over the text."""
    return F.regexp_extract_all(dna, F.lit(f".{{1,{PAYLOAD_NT}}}"), F.lit(0))


def blocks(payload: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, block): 120 nucleotides each, the last one may be short."""
    return payload.where(F.length("dna") > 0).select(*keys, F.posexplode(tiles(F.col("dna"))).alias("block_id", "block"))


def chunk_blocks(done: DataFrame, keys: list[str]) -> DataFrame:
    """blocks() of payloads in chunks (_row, keys, chunk, chunks, nt, dna). Where a block lies in two chunks or more its
    pieces, two a chunk at most, are put together; no payload is."""
    own = ["_row", *keys]
    whole = blocks(done.where("chunks = 1"), own)
    before = Window.partitionBy("_row").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    long = done.where("chunks > 1")
    offsets = long.select("_row", "chunk", F.coalesce(F.sum("nt").over(before), F.lit(0)).alias("at"))
    rest = F.pmod(-F.col("at"), F.lit(PAYLOAD_NT)).cast("int")  # of a block that an earlier chunk began
    placed = long.join(offsets, ["_row", "chunk"]).withColumn("rest", rest).withColumn("first", F.ceil(F.col("at") / PAYLOAD_NT).cast("int"))
    head = F.when(F.col("rest") > 0, F.array(F.struct((F.col("first") - 1).alias("block_id"), F.left("dna", "rest").alias("piece"))))
    tail = F.transform(tiles(F.substring("dna", F.col("rest") + 1, F.length("dna"))), lambda x, i: F.struct((F.col("first") + i).alias("block_id"), x.alias("piece")))
    pieces = placed.select(*own, "chunk", F.inline(F.concat(F.coalesce(head, F.expr("CAST(array() AS ARRAY<STRUCT<block_id: INT, piece: STRING>>)")), tail)))
    full = pieces.where(F.length("piece") == PAYLOAD_NT).select(*own, "block_id", F.col("piece").alias("block"))
    parts = pieces.where(F.length("piece").between(1, PAYLOAD_NT - 1)).groupBy(*own, "block_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece"))).alias("parts"))
    return whole.union(full).union(parts.select(*own, "block_id", F.array_join(F.col("parts.piece"), "").alias("block")))


def constraints(tiles: DataFrame) -> DataFrame:
    """tiles (block, ...) with gc, rll and endgc."""
    return tiles.withColumn("_checks", kernels.checks("block")).select(*tiles.columns, "_checks.*")


def block_summary(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Counts over blocks."""
    share = F.col("gc") / F.lit(float(PAYLOAD_NT))
    return checked.groupBy(*keys).agg(
        F.avg(share).alias("gc_mean"), F.var_pop(share).alias("gc_var"), F.max("rll").cast("bigint").alias("rll_max"), F.count_if(F.col("rll") > MAX_RUN).alias("rll_violations"),
        F.count_if(F.col("endgc") > MAX_END_GC).alias("end_violations"), F.count(F.lit(1)).alias("storage_seq_count"), F.sum(F.length("block")).cast("bigint").alias("nt"),
    )


class Encoding:
    """The frames of an encoding, each made when it is first asked for. What several start from is written once: chunks,
    their repeats, code tables and nucleotides."""

    def __init__(self, chunks: DataFrame, keys: list[str], scope: str, by: list[str]):
        """chunks: _row, keys, by, chunk, chunks, bytes."""
        self.keys, self.scope, self.have = keys, scope, list(dict.fromkeys([*keys, *by]))
        self.by = ["_row", *keys] if scope == "doc" else by
        self._written: list[DataFrame] = []
        self._chunks = chunks

    def _cut(self, table: DataFrame) -> DataFrame:
        self._written.append(cut(table))
        return self._written[-1]

    def close(self) -> None:
        """Deletes what was written; to be called when nothing that was made from the frames is read any more."""
        forget(*self._written)
        self._written.clear()

    def __enter__(self) -> Encoding:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def segments(self) -> DataFrame:
        """(keys, by, seg_id, s, lp, ls)"""
        inside = segments.repeats(segments.segments(self.marked, ["_row", *self.have, "chunk"], "bytes"))
        return inside.select(*self.have, _number("seg_id"), "s", "lp", "ls")

    @cached_property
    def marked(self) -> DataFrame:
        """(_row, keys, by, chunk, chunks, bytes, best_sum, pairs): chunks, and the repeats in each. Written once, where all of them are asked for
        or payloads share a table: numbers of payloads don't change then. In doc scope what is made of payloads of one chunk takes one pass and
        needs no more than the payloads, so that without it only the others are written."""
        return self._cut(self._repeats(self._chunks))

    @cached_property
    def _marked_long(self) -> DataFrame:
        return self._cut(self._repeats(self._chunks.where("chunks > 1")))

    def _repeats(self, chunks: DataFrame) -> DataFrame:
        own = chunks.select("_row", *self.have, "chunk", "chunks", "bytes")
        return mapped(own, "bytes", lambda part: kernels.chunk_repeats(part.column("bytes")), f"best_sum long, pairs {PAIRS}")

    def _marked(self, long: bool) -> DataFrame:
        if self.scope != "doc" or "marked" in self.__dict__ and not (long and "_marked_long" in self.__dict__):
            return self.marked.where("chunks > 1" if long else "chunks = 1")
        return self._marked_long if long else self._repeats(self._chunks.where("chunks = 1"))

    def _short(self) -> DataFrame:
        """(_row, keys, by, chunk, chunks, n_bytes, segments, bytes): payloads of one chunk, with best_sum and pairs if these are written already."""
        written = "marked" in self.__dict__
        return self._sized(self._marked(False) if written else self._chunks.where("chunks = 1"), ("best_sum", "bytes", "pairs") if written else ("bytes",))

    def _sized(self, chunks: DataFrame, more: tuple[str, ...]) -> DataFrame:
        size = F.octet_length("bytes").cast("bigint")
        return chunks.select("_row", *self.have, "chunk", "chunks", size.alias("n_bytes"), F.ceil(size * 8 / SEGMENT_BITS).cast("bigint").alias("segments"), *more)

    @cached_property
    def _frequencies(self) -> tuple[DataFrame, bool]:
        """Occurrences of each repeat, of payloads of several chunks alone in doc scope, and whether a group's lie together."""
        if self.scope != "doc":
            return self._cut(segments.frequencies(self.marked.select(*self.by, F.inline("pairs")), self.by)), False
        found = self._marked(True).select(*self.by, F.inline("pairs"))
        if self._marked(True).where(F.col("chunks") > LONG_CHUNKS).isEmpty():
            # All that follows groups by the payload: one shuffle serves all of it.
            return segments.frequencies(found.repartition("_row"), self.by), True
        return self._cut(segments.frequencies(found, self.by)), False

    @property
    def map1(self) -> DataFrame:
        """(keys or by, substr, freq)"""
        freq = self._frequencies[0].drop("_row")
        if self.scope != "doc":
            return freq
        return self._marked(False).select(*self.keys, F.inline("pairs")).withColumnRenamed("hits", "freq").union(freq)

    @cached_property
    def _long_books(self) -> DataFrame:
        """Books of groups whose repeats lie in several rows: all in corpus scope, payloads of several chunks in doc scope."""
        freq, together = self._frequencies
        if together:  # made from one shuffle: where they are read they are made in passing
            return codebook.codebooks(segments.kept_in_place(freq, self.by), self.by)
        return self._cut(codebook.codebooks(segments.kept(freq, self.by), self.by))

    @property
    def books(self) -> DataFrame:
        """(_row and keys, or by; keys, codes): what codebook shows."""
        if self.scope != "doc":
            return self._long_books
        # As a group of its own each payload has a row if it has repeats.
        short = codebook.books_in_place(self._marked(False).where(F.size("pairs") > 0).select(*self.by, "bytes", "pairs"))
        return short.union(self._long_books)

    @property
    def codebook(self) -> DataFrame:
        """(keys or by, keys, codes)"""
        return self.books.drop("_row")

    def _encoded(self, long: bool, listed: bool = False) -> DataFrame:
        """(_row, keys, by, chunk, chunks, n_bytes, segments, best_sum, dna; listed: seg_dna): nucleotides of the chunks of payloads of one chunk, or of
        several. Each row's code table is made where the row lies, or meets it."""
        if self.scope == "doc" and not long:
            return codebook.encoded_in_place(self._short(), "seg_dna array<string>" if listed else "dna string", listed=listed)
        marked = self._sized(self._marked(long), ("best_sum", "bytes", "pairs"))
        if self.scope == "doc":
            done = codebook.encoded(marked.drop("pairs"), self._long_books.select("_row", "keys", "codes"), ["_row"], "bytes").drop("bytes")
            return done if listed else done.withColumn("dna", F.array_join("seg_dna", "")).drop("seg_dna")
        # A table of all groups' keys is far longer than most payloads: payloads of a group are packed, by their places, and a pack meets it once.
        by = [c for c in self.by if c != "_row"]
        at = (F.col("_row"), F.floor(F.col("chunk") / PACK_CHUNKS)) if long else (F.floor(F.col("_row") / PACK_ROWS), F.lit(0))
        inside = [c for c in marked.columns if c not in (*by, "pairs")]
        packs = marked.groupBy(*by, *[x.alias(f"_at{k}") for k, x in enumerate(at)]).agg(F.collect_list(F.struct(*inside)).alias("rows")).select(*by, "rows")
        return codebook.encoded_packs(packs, self._long_books, by, self._few_books, listed).select(*[c for c in marked.columns if c not in ("bytes", "pairs")], "seg_dna" if listed else "dna")

    @cached_property
    def _few_books(self) -> bool:
        return self._long_books.limit(FEW_BOOKS + 1).count() <= FEW_BOOKS

    @cached_property
    def _long(self) -> DataFrame:
        """_encoded(True) with nt, written."""
        return self._cut(self._encoded(True).withColumn("nt", F.length("dna").cast("bigint")))

    @property
    def coded(self) -> DataFrame:
        """(keys, seg_id, dna)"""
        both = self._encoded(False, True).union(self._encoded(True, True))
        return both.select(*self.keys, "chunk", F.posexplode("seg_dna").alias("seg_id", "dna")).select(*self.keys, _number("seg_id"), "dna")

    @property
    def payload(self) -> DataFrame:
        """(keys, n_bytes, segments, dna)"""
        ordered = F.array_sort(F.collect_list(F.struct("chunk", "dna")))
        long = self._encoded(True).groupBy("_row", *self.keys).agg(F.sum("n_bytes").alias("n_bytes"), F.sum("segments").alias("segments"), ordered.alias("parts"))
        return self._encoded(False).select(*self.keys, "n_bytes", "segments", "dna").union(long.select(*self.keys, "n_bytes", "segments", F.array_join(F.col("parts.dna"), "")))

    def _from_short(self, more: str, then, spent: bool = False) -> DataFrame:
        """(_row, keys, by, chunk, chunks, n_bytes, segments, best_sum, more): what `then` makes of the nucleotides of payloads of one chunk; spent,
        in doc scope alone: with the seconds of each phase."""
        if self.scope == "doc":
            return codebook.encoded_in_place(self._short(), more, then, spent=spent)
        return mapped(self._encoded(False), "dna", lambda part: then(part.column("dna")), more, ("dna",))

    def _blocks(self) -> DataFrame:
        """(keys, block_id, block)"""
        tiled = self._from_short("tiles array<string>", lambda dna: [kernels.tiles(dna)])
        return tiled.select(*self.keys, F.posexplode("tiles").alias("block_id", "block")).union(chunk_blocks(self._long, self.keys).drop("_row"))

    @property
    def strands(self) -> DataFrame:
        """(keys, block_id, strand)"""
        return self._blocks().select(*self.keys, "block_id", strand(F.col("block_id"), F.col("block")).alias("strand"))

    @property
    def block_metrics(self) -> DataFrame:
        """(keys, block_id, block, gc, rll, endgc)"""
        return constraints(self._blocks())

    @property
    def fingerprints(self) -> DataFrame:
        """(keys, dna_hash_payload, dna_hash_storage): of the nucleotides and of all strands in order. Payloads of several chunks are
        worked on in parts, by as many tasks as there are, and none is put together."""
        short = self._from_short(_HASHES, both_fingerprints).select(*self.keys, *HASHES)
        return short.union(self._long_fingerprints().select(short.columns))

    @property
    def summary(self) -> DataFrame:
        """metrics and fingerprints, side by side."""
        short = self._short_metrics(HASHES)
        return short.union(self._long_summary().select(short.columns))

    def _long_summary(self) -> DataFrame:
        return self._long_metrics().join(self._long_fingerprints().drop(*self.keys), "_row").drop("_row")

    def timed(self) -> tuple[DataFrame, list[float]]:
        """summary, written, and the seconds of each of codebook.PHASES. Where payloads share a table, and for payloads of several chunks, each phase is a
        job that writes: repeats; frequencies and codes; nucleotides and all that is said of them. In doc scope payloads of one chunk take all phases
        in one pass; its time is dealt out as the seconds of its tasks are, which say how long each slice was in each phase."""
        doc, columns, clock = self.scope == "doc", [*self.keys, *METRICS, *HASHES], time.perf_counter
        marks, tables, spent = [clock()], [], [0.0] * len(codebook.PHASES)
        if not doc or not self._marked_long.isEmpty():
            self._marked(True)
            marks.append(clock())
            self._long_books.write.format("noop").mode("overwrite").save()
            marks.append(clock())
            tables.append(self._cut((self._long_summary() if doc else self.summary).select(columns)))
            marks.append(clock())
            spent = [z - a for a, z in itertools.pairwise(marks)]
        if doc:
            begin = clock() if tables else marks[0]
            short = self._cut(self._short_metrics(HASHES, True))
            own = [x or 0.0 for x in short.agg(*[F.sum(c) for c in codebook.SPENT]).first()]
            took, every = clock() - begin, sum(own)
            spent = [x + took * (y / every if every else 1 / len(own)) for x, y in zip(spent, own, strict=True)]
            tables.append(short.select(columns))
        return functools.reduce(DataFrame.union, tables), spent

    def _long_fingerprints(self) -> DataFrame:
        """(_row, keys, hashes) of payloads of several chunks."""
        long = self._long
        row = ["_row", *self.keys]
        strands = chunk_blocks(long, self.keys).select(*row, F.floor(F.col("block_id") / PART_BLOCKS).alias("part"), F.struct("block_id", strand(F.col("block_id"), F.col("block")).alias("s")).alias("s"))
        texts = strands.groupBy(*row, "part").agg(F.array_sort(F.collect_list("s")).alias("s")).select(*row, "part", F.array_join(F.col("s.s"), "").alias("text"))
        both = long.select(*row, F.lit("payload").alias("of"), F.col("chunk").cast("long").alias("part"), F.col("dna").alias("text")).union(texts.select(*row, F.lit("storage"), F.col("part").cast("long"), "text"))
        parts = self._cut(both.select(*row, "of", "part", F.octet_length("text").cast("long").alias("size"), folds.part_table("text").alias("t")))
        most = parts.agg(F.max("part")).first()[0]
        while most is not None:  # each round joins PARTS tables at most
            own = F.array_sort(F.collect_list(F.struct("part", "size", "t")))
            parts = parts.groupBy(*row, "of", F.floor(F.col("part") / PARTS).alias("part")).agg(own.alias("own"))
            parts = parts.select(*row, "of", "part", F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["size"]).alias("size"), folds.joined_tables("own").alias("t"))
            most //= PARTS
            if not most:
                break
        return parts.select(*row, "of", folds.end("size", "t").alias("h")).groupBy("_row").agg(*[F.first(k).alias(k) for k in self.keys], *[F.max(F.when(F.col("of") == x, F.col("h"))).alias(f"dna_hash_{x}") for x in ("payload", "storage")])

    @property
    def metrics(self) -> DataFrame:
        """A row for each payload."""
        short = self._short_metrics(())
        return short.union(self._long_metrics().select(short.columns))

    def _short_metrics(self, more: tuple[str, ...], spent: bool = False) -> DataFrame:
        """metrics of payloads of one chunk, with HASHES if asked, and with the seconds of each phase: each is encoded and its blocks are checked and summed
        where it lies."""
        found = kernels.BLOCK_SUMS
        checked = self._from_short(f"{found}, {_HASHES}", lambda dna: [*kernels.block_sums(dna), *both_fingerprints(dna)], spent) if more else self._from_short(found, kernels.block_sums, spent)
        return rates(checked).select(*self.keys, *METRICS, *more, *[c for c in codebook.SPENT if spent])

    def _long_metrics(self) -> DataFrame:
        sizes = self._long.groupBy("_row").agg(*[F.first(k).alias(k) for k in self.keys], *[F.sum(c).alias(c) for c in ("n_bytes", "segments", "best_sum")])
        return rates(sizes.join(block_summary(constraints(chunk_blocks(self._long, [])), ["_row"]), "_row")).select("_row", *self.keys, *METRICS)


METRICS = (
    "n_bytes", "segments", "gc_mean", "gc_var", "rll_max", "rll_violations", "end_violations", "storage_seq_count", "nt", "avg_best_lsbm_len", "n_bits", "encoding_rate_bits_per_nt",
    "gross_rate_bits_per_nt",
)
HASHES = ("dna_hash_payload", "dna_hash_storage")
_HASHES = ", ".join(f"{h} string" for h in HASHES)


def rates(summed: DataFrame) -> DataFrame:
    """A summary of blocks beside n_bytes, segments and best_sum, with what follows from them."""
    bits = F.col("n_bytes") * 8
    own = {"avg_best_lsbm_len": F.col("best_sum") / F.col("segments"), "n_bits": bits, "encoding_rate_bits_per_nt": bits / F.greatest(F.lit(1), F.col("nt")), "gross_rate_bits_per_nt": bits / (F.col("storage_seq_count") * STRAND_NT)}
    return summed.withColumns(own)


def hashed(done: DataFrame, drop: tuple[str, ...]) -> DataFrame:
    """Payloads' nucleotides (dna), each whole, with their HASHES."""
    return mapped(done, "dna", lambda part: both_fingerprints(part.column("dna")), _HASHES, drop)


def _number(inside: str) -> F.Column:
    """A segment's number in its payload, from that in its chunk."""
    return (F.col("chunk") * CHUNK_SEGMENTS + F.col(inside)).alias("seg_id")


def encode(docs: DataFrame, keys: list[str], column: str = "text", scope: str = "doc", by: list[str] | None = None) -> Encoding:
    """Encodes each row's payload. scope "doc": a code table for each payload; "corpus": one for each value of `by` (columns
    of docs, null a value; none: one for all). Keys name payloads; rows of one key, or of none, are payloads of their own,
    each with its row in every frame. Empty and null payloads are left out. A payload is worked on in chunks, by as many
    tasks as there are; only the frame payload puts one together, so that its nucleotides must fit in one text there (2 ** 31,
    of 256 MB of payload or more)."""
    have = list(dict.fromkeys([*keys, *(by or [])]))
    return Encoding(chunked(payload_of(docs, have, column), have), keys, scope, list(by or []))


def encode_files(spark: SparkSession, path: str, glob: str = FILES, scope: str = "doc", by: list[str] | None = None) -> Encoding:
    """Encodes the files of a folder, each a payload, by their ranges: no row holds a file, however large. Keys are path, dataset,
    file_name and file_size_bytes; `by` names some of these."""
    return Encoding(file_chunks(spark, path, glob, CHUNK_BYTES, READ_CHUNKS), list(FILE_KEYS), scope, list(by or []))


def fingerprints(payload: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, dna_hash_payload, dna_hash_storage): of the nucleotides and of all strands in order."""
    return hashed(payload.select(*keys, "dna"), ("dna",))
