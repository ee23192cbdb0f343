"""Comparing runs: joins, ratios and summaries of metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHASES = ("lsbm_ms", "huffman_ms", "encode_ms")
#: Phases of the other implementation, in order, and those of its that compute (fixed values).
PARALLEL_PHASES = ("h2d_ms", "bits_kernel_ms", "lsbm_kernel_ms", "huffman_cpu_ms", "encode_kernel_ms", "constraint_kernel_ms", "assembly_ms", "d2h_ms")
COMPUTING = ("bits_kernel_ms", "lsbm_kernel_ms", "huffman_cpu_ms", "encode_kernel_ms", "constraint_kernel_ms")


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that df lacks."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def lenient(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, null where they aren't numbers."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns})


def joined(a: DataFrame, b: DataFrame, on: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Inner equi-join whose other columns get a suffix each."""
    named = [df.select(*on, *[F.col(c).alias(c + s) for c in df.columns if c not in on]) for df, s in zip((a, b), suffixes, strict=True)]
    return named[0].join(named[1], on)


def ratio(a, b) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def speedups(pairs: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds a ratio for each name: slower over faster, 0 where the faster isn't above 0."""
    return pairs.withColumns({n: ratio(F.col(a), F.col(b)) for n, (a, b) in columns.items()})


def parity(a: str, b: str) -> Column:
    """Equal and not empty; null counts as different."""
    return F.col(a).eqNullSafe(F.col(b)) & (F.coalesce(F.length(a), F.lit(0)) > 0)


def tagged(frames: dict[str, DataFrame], name: str = "impl") -> DataFrame:
    out = None
    for tag, df in frames.items():
        own = df.withColumn(name, F.lit(tag))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def phases(df: DataFrame, keys: list[str], columns: tuple[str, ...] = PHASES) -> DataFrame:
    """(keys, phase, ms): a row for each phase."""
    return df.unpivot(keys, list(columns), "phase", "ms")


def bottleneck(df: DataFrame, keys: list[str], columns: tuple[str, ...] = PHASES) -> DataFrame:
    """(keys, phase, ms, share) of each row's longest phase; ties go to the first name."""
    long = phases(df, keys, columns)
    best = long.groupBy(*keys).agg(F.max("ms").alias("ms"), F.sum("ms").alias("total"))
    first = long.join(best, [*keys, "ms"]).groupBy(*keys, "ms", "total").agg(F.min("phase").alias("phase"))
    return first.select(*keys, "phase", "ms", ratio(F.col("ms"), F.col("total")).alias("share"))


def labelled(df: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """Display names, the value itself where none is given."""
    pairs = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn("label", F.coalesce(F.element_at(pairs, F.col(column)) if names else F.lit(None), F.col(column)))


def last_labelled(df: DataFrame, column: str, names: dict[str, str], order: list[str]) -> DataFrame:
    """One row a label: of rows that share one the last by `order` (ties: the largest other columns), as a later launch of
    a kernel takes the place of an earlier one."""
    own = labelled(df, column, names)
    rest = [c for c in own.columns if c != "label" and c not in order]
    return own.groupBy("label").agg(F.max(F.struct(*order, *rest)).alias("r")).select("label", *[F.col("r").getField(c).alias(c) for c in df.columns])


def match_summary(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(dataset, hash_seq, hash_gpu, match): what a comparison of two implementations reports."""
    return pairs.select("dataset", F.col(a).alias("hash_seq"), F.col(b).alias("hash_gpu"), parity(a, b).alias("match"))


def mismatches(summary: DataFrame) -> DataFrame:
    """(datasets, mismatches): how many were compared and how many differ; a run fails if any does."""
    return summary.agg(F.count(F.lit(1)).alias("datasets"), F.count_if(~F.col("match")).alias("mismatches"))


def bandwidth(size: Column, ms: Column) -> Column:
    """GB/s of bytes in milliseconds, 0 without time."""
    return F.when(ms > 0, size / 1e9 / (ms / 1e3)).otherwise(0.0)


def occupancy(regs: Column, shared: Column, block: Column) -> Column:
    """Share of 48 warps, in per cent, that registers, shared memory and blocks allow."""
    warps = F.when(block >= 32, F.floor(block / 32)).otherwise(1)
    by_regs = F.when(regs > 0, F.floor(F.lit(65536) / (regs * 32))).otherwise(48)
    by_shared = F.least(F.lit(32), F.floor(F.lit(102400) / F.when(shared > 0, shared).otherwise(1))) * warps
    return F.least(F.lit(48), by_regs, by_shared) / 48.0 * 100.0


def total(columns: tuple[str, ...]) -> Column:
    """The sum of columns of a row."""
    out = F.col(columns[0])
    for c in columns[1:]:
        out = out + F.col(c)
    return out


def older(df: DataFrame, parallel: bool) -> DataFrame:
    """A table of runs with the columns that older ones lack, worked out from those they have."""
    own = {"gross_rate_bits_per_nt": F.col("encoding_rate_bits_per_nt"), "dna_hash_payload": F.lit("")}
    return with_defaults(df, own | ({"phase_sum_ms": F.col("total_ms")} if parallel else {}))


def compare(metrics_a: DataFrame, metrics_b: DataFrame) -> DataFrame:
    """Runs of the sequential implementation (a) beside the parallel one's (b), by dataset: all columns with suffixes, size_kb,
    compute_ms_seq and compute_ms_cuda (the phases that compute), speedups of the whole, both phases and what computes, and
    payload_hash_match. A ratio over nothing is 0; older tables may lack what older() gives them. A dataset that is there
    several times meets each of its like."""
    pairs = joined(older(metrics_a, False), older(metrics_b, True), ["dataset"], ("_seq", "_cuda"))
    sums = {"size_kb": F.col("file_size_bytes_seq") / 1024, "compute_ms_seq": total(tuple(f"{c}_seq" for c in PHASES)), "compute_ms_cuda": total(tuple(f"{c}_cuda" for c in COMPUTING))}
    faster = {
        "speedup_total": ("total_ms_seq", "total_ms_cuda"), "speedup_lsbm": ("lsbm_ms_seq", "lsbm_kernel_ms_cuda"), "speedup_encode": ("encode_ms_seq", "encode_kernel_ms_cuda"),
        "speedup_compute": ("compute_ms_seq", "compute_ms_cuda"),
    }
    return speedups(pairs.withColumns(sums), faster).withColumn("payload_hash_match", parity("dna_hash_payload_seq", "dna_hash_payload_cuda"))


def summary(compared: DataFrame) -> DataFrame:
    """One row: mean speedups of compare()'s rows, and how many payloads match."""
    names = ("speedup_total", "speedup_lsbm", "speedup_encode", "speedup_compute")
    return compared.agg(*[F.avg(c).alias(c) for c in names], F.count_if("payload_hash_match").alias("matches"), F.count(F.lit(1)).alias("datasets"))


def phase_pivot(df: DataFrame, key: str, columns: tuple[str, ...], order: DataFrame | None = None) -> DataFrame:
    """(key, a column for each phase): each key's mean of each phase, by a pivot over the phases named. order: a frame of keys
    to be shown, in their order, one without runs with nulls."""
    means = phases(df, [key], columns).groupBy(key).pivot("phase", list(columns)).agg(F.avg("ms"))
    return means if order is None else reindexed(means, key, order)


def reindexed(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """A row for each of the keys (a frame of one column), in their order, with nulls where df has none; other rows go."""
    return keys.select(key).distinct().join(df, key, "left").orderBy(key)


def means(df: DataFrame, by: str, columns: tuple[str, ...]) -> DataFrame:
    """Means of a group's columns, in order of the groups."""
    return df.groupBy(by).agg(*[F.avg(c).alias(c) for c in columns]).orderBy(by)


def timings(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, runs, mean_ms, std_ms): runs of a group, their mean and population deviation."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("runs"), F.avg(column).alias("mean_ms"), F.stddev_pop(column).alias("std_ms"))


def looked_up(df: DataFrame, names: DataFrame, on: str, key: str) -> DataFrame:
    """df with the columns that a table of names has for its key; rows without a name go."""
    return df.join(names, F.col(on) == F.col(key))


def sums(df: DataFrame, by: str, columns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """(by, names): sums of columns, each over all rows of a group or those of a condition."""
    return df.groupBy(by).agg(*[F.sum(F.col(c) if where is None else F.when(where, F.col(c))).alias(n) for n, (c, where) in columns.items()])


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both frames have, in order."""
    return a.intersect(b).orderBy(*a.columns)


def first(df: DataFrame, order: str) -> DataFrame:
    return df.orderBy(order).limit(1)


def choices(menus: DataFrame, column: str, most: int) -> DataFrame:
    """(columns of menus, choice): a row for each number from 1 to `most` that a menu's text names: numbers between commas, or A for all;
    nothing at all is 1. What isn't such a number is passed over."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    named = F.transform(F.split(F.when(text == "", F.lit("1")).otherwise(text), ","), lambda x: F.trim(x))
    digits = F.filter(named, lambda x: x.rlike("^[0-9]+$"))
    numbers = F.filter(F.transform(digits, lambda x: x.try_cast("int")), lambda n: n.between(1, most))
    given = F.when(F.upper(text) == "A", F.sequence(F.lit(1), F.lit(most))).otherwise(F.array_distinct(numbers))
    return menus.withColumn("choice", F.explode(given))


def selected(df: DataFrame, key: str, menus: DataFrame, column: str, most: int) -> DataFrame:
    """Rows whose key one of the menus' texts chooses."""
    return df.join(choices(menus.select(column), column, most).select(F.col("choice").alias(key)), key, "left_semi")
