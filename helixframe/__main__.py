"""python -m helixframe <input> <dataset_tag> <output_csv> [--runs N]: encodes a file, and appends its row of metrics."""

from __future__ import annotations

import re
import sys

USAGE = "Usage: python -m helixframe <input_file> <dataset_tag> <output_csv> [--runs N]"
RUNS = 5


def runs_of(args: list[str]) -> int:
    """The number behind the last --runs, as far as it is one, at least 1."""
    out = RUNS
    for flag, value in zip(args, args[1:]):
        if flag == "--runs":
            number = re.match(r"\s*[+-]?[0-9]+", value)
            out = max(1, int(number[0]) if number else 0)
    return out


def line_of(row) -> str:
    """What is said of a run that is done."""
    shown = {
        "dataset": row["dataset"], "file": row["file_name"], "rate": f"{row['encoding_rate_bits_per_nt']:.6g} bits/nt", "gross": f"{row['gross_rate_bits_per_nt']:.6g} bits/nt", "gc_mean": f"{row['gc_mean']:.6g}",
        "rll_max": row["rll_max"], "rll_viol": row["rll_violations"], "end_viol": row["end_violations"], "hash": row["dna_hash_payload"],
    }
    return "[DONE] " + " ".join(f"{k}={v}" for k, v in shown.items())


def main(args: list[str]) -> int:
    if len(args) < 3:
        print(USAGE, file=sys.stderr)
        return 1
    path, tag, out = args[:3]
    from pyspark.sql import SparkSession

    from helixframe.plans.runs import run_files
    from helixframe.sources.ranges import listed
    from helixframe.sources.sink import append_rows

    try:
        size = sum(n for _, n in listed(path, "*"))
    except OSError:
        size = 0
    if not size:
        print(f"Input read failed or empty: {path}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    row = run_files(spark, path, runs_of(args[3:]), "*", tag)
    kept = spark.createDataFrame(row.collect(), row.schema)  # a row for each file named
    try:
        append_rows(kept, out)
    except Exception as e:
        print(f"Can't write {out}: {str(e).splitlines()[0]}", file=sys.stderr)
        return 1
    for r in kept.collect():
        print(line_of(r))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
