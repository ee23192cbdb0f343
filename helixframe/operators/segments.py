"""Segments of a payload's bits, their repeats, and the table of repeats that a code is built from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.constants import MIN_KEY_LEN, SEGMENT_HEX, TABLE_CAP
from helixframe.functions import kernels
from helixframe.functions.bits import nonoverlap_count, segment_bits
from helixframe.functions.slices import mapped


def segments(payloads: DataFrame, keys: list[str], payload: str = "payload") -> DataFrame:
    """(keys, seg_id, s): tiles of 500 bits, the last one may be short. Empty and null payloads have none. Each tile is cut
    from the bytes by its place and spelled out as bits afterwards, so that a payload costs time in proportion to its
    length and no row holds all of its bits. A tile begins within a byte if its number is odd."""
    raw, i = F.col("_raw"), F.col("seg_id")
    count = F.ceil(F.octet_length("_raw") * 2 / SEGMENT_HEX).cast("int")
    cut = payloads.where(F.octet_length(payload) > 0).select(*keys, F.col(payload).alias("_raw")).select(*keys, "_raw", F.explode(F.sequence(F.lit(0), count - 1)).alias("seg_id"))
    digits = F.hex(F.substring(raw, F.expr(f"CAST(CAST(seg_id AS BIGINT) * {SEGMENT_HEX} DIV 2 AS INT)") + 1, F.lit(SEGMENT_HEX // 2 + 1)))
    return cut.select(*keys, "seg_id", F.substring(digits, i % 2 + 1, F.lit(SEGMENT_HEX)).alias("h")).select(*keys, "seg_id", once(segment_bits(F.col("h")).alias("s")))


def once(*columns):
    """Columns that are worked out once a row, however often later expressions name them: the optimiser doesn't copy
    what a generator gives into its users."""
    return F.inline(F.array(F.struct(*columns)))


def repeats(segs: DataFrame) -> DataFrame:
    """Adds lp and ls: lengths of the longest repeating prefix and suffix. Row by row, without a shuffle. Searching text is
    some seven times as fast in Python's own find() as in the expressions of functions.bits, Arrow's part counted."""
    return segs.withColumn("_found", kernels.repeats("s")).select(*segs.columns, "_found.lp", "_found.ls")


def spelled(payloads: DataFrame, payload: str) -> DataFrame:
    """payloads with bits, '0' and '1', for the payload: what functions.bits.bytes_to_bits() gives."""
    return mapped(payloads, payload, lambda part: [kernels.spelled(part.column(payload))], "bits string", (payload,))


def in_chunks(chunks: DataFrame, keys: list[str], kernel, kind: str) -> DataFrame:
    """(keys, chunk, found): what a kernel finds in each chunk's segments, a list of structs of `kind`; no segment leaves its chunk."""
    return mapped(chunks.select(*keys, "chunk", "bytes"), "bytes", lambda part: kernel(part.column("bytes")), f"found array<struct<{kind}>>", ("bytes",))


def chunk_profile(chunks: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, seg_id, lp, ls, best_len, best_hits): what repeats() and profile() add to each segment, of chunks of `size` segments."""
    found = in_chunks(chunks, keys, kernels.chunk_profiles, "lp: int, ls: int, best_len: int, best_hits: bigint")
    rows = found.select(*keys, "chunk", F.posexplode("found").alias("_at", "f"))
    return rows.select(*keys, (F.col("chunk") * size + F.col("_at")).alias("seg_id"), "f.*")


def chunk_candidates(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, substr, hits): candidates() of chunks."""
    return in_chunks(chunks, keys, kernels.chunk_entries, "substr: string, hits: bigint").select(*keys, F.inline("found"))


def chunk_pairs(chunks: DataFrame) -> DataFrame:
    """(substr, hits): chunk_candidates() without keys, hits summed in each chunk."""
    return in_chunks(chunks, [], lambda raw: kernels.chunk_repeats(raw)[1:], "substr: string, hits: bigint").select(F.inline("found"))


def profile(reps: DataFrame) -> DataFrame:
    """Adds best_len (the longer of the two) and best_hits (its occurrences); 0 for segments under four bits."""
    best = F.greatest("lp", "ls")
    hits = F.greatest(nonoverlap_count(F.col("s"), F.left("s", best)), nonoverlap_count(F.col("s"), F.right("s", best)))
    short = F.length("s") < 4
    return reps.withColumn("best_len", F.when(short, 0).otherwise(best)).withColumn("best_hits", F.when(short | (best == 0), F.lit(0)).otherwise(hits).cast("bigint"))


def pair():
    """Array of (substr, hits) of a segment: its repeating prefix, and suffix unless it is a prefix no longer than that."""
    prefix, suffix = F.left("s", F.col("lp")), F.right("s", F.col("ls"))
    same = (F.col("ls") <= F.col("lp")) & (suffix == F.left("s", F.col("ls")))
    long = F.length("s") > MIN_KEY_LEN
    both = F.array(F.when(long & (F.col("lp") >= MIN_KEY_LEN), prefix), F.when(long & (F.col("ls") >= MIN_KEY_LEN) & ~same, suffix))
    return F.transform(F.array_compact(both), lambda x: F.struct(x.alias("substr"), nonoverlap_count(F.col("s"), x).alias("hits")))


def candidates(reps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, substr, hits): a row for each entry of pair()."""
    return reps.select(*keys, F.inline(pair()))


def frequencies(found: DataFrame, by: list[str]) -> DataFrame:
    """(by, substr, freq): summed on each task before the shuffle."""
    return found.groupBy(*by, "substr").agg(F.sum("hits").alias("freq"))


def _order(by: list[str]):
    window = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return window.orderBy(F.length("substr").desc(), F.desc("freq"), "substr")


def ranked(freq: DataFrame, by: list[str], cap: int = TABLE_CAP) -> DataFrame:
    """(by, substr, freq, rank): the first `cap` by length and frequency, falling, then text. Spark limits each task's
    rows of a group before the shuffle (a rank filter over row_number)."""
    return freq.withColumn("rank", F.row_number().over(_order(by))).where(F.col("rank") <= cap)


def meet(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined to b, by columns in which null is a value like others; without columns b is one row."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    other = b.withColumnsRenamed({c: f"_{c}_" for c in by})
    on = F.lit(True)
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}_"))
    return a.join(other, on, how).drop(*[f"_{c}_" for c in by])


def kept(freq: DataFrame, by: list[str], cap: int = TABLE_CAP) -> DataFrame:
    """(by, substr, freq, rank) of the rows that enter the code: of n rows under the cap, those of at least
    2 * ceil(log2 n) + 1 bits; if there is none, all rows of the group, the cap undone."""
    top = ranked(freq, by, cap)
    sizes = top.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    floor = 2 * F.length(F.bin((F.col("_rows") - 1).cast("bigint"))) + 1  # bits of n - 1 are ceil(log2 n)
    deep = meet(top, sizes, by)
    cuts = deep.groupBy(*by).agg(F.max("_rows").alias("_rows"), F.count_if(F.length("substr") >= floor).alias("_deep"))
    whole = cuts.select(*by, F.when(F.col("_rows") <= 1, F.col("_rows")).otherwise(F.col("_deep")).alias("_limit"))
    first = meet(top, whole, by).where(F.col("rank") <= F.col("_limit"))
    # Groups without a deep row: keys there are short, so that distinct ones are few.
    shallow = whole.where("_limit = 0")
    rest = meet(freq, shallow, by)
    rest = rest.withColumn("rank", F.row_number().over(_order(by)))
    return first.select(*by, "substr", "freq", "rank").unionByName(rest.select(*by, "substr", "freq", "rank"))


def kept_in_place(freq: DataFrame, by: list[str], cap: int = TABLE_CAP) -> DataFrame:
    """kept(), by windows alone: for groups that are one payload each and already lie together, so that nothing moves."""
    group = Window.partitionBy(*by)
    rows = freq.withColumn("rank", F.row_number().over(_order(by))).withColumn("_rows", F.least(F.count(F.lit(1)).over(group), F.lit(cap)))
    floor = 2 * F.length(F.bin((F.col("_rows") - 1).cast("bigint"))) + 1
    deep = F.sum(((F.col("rank") <= cap) & (F.length("substr") >= floor)).cast("int")).over(group)
    limit = F.when(F.col("_rows") <= 1, F.col("_rows")).otherwise(F.col("_deep"))
    return rows.withColumn("_deep", deep).where((limit == 0) | (F.col("rank") <= limit)).select(*by, "substr", "freq", "rank")
