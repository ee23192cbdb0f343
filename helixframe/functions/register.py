"""The encoder's functions under names of their own in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from helixframe.constants import ADDRESS_NT, ADDRESSES, END_NT, PAYLOAD_NT, PRIMER_LEFT, PRIMER_RIGHT
from helixframe.functions import dna, kernels

_ADDRESS = f"translate(lpad(conv(CAST(block_id % {ADDRESSES} AS STRING), 10, 4), {ADDRESS_NT}, '0'), '0123', 'ACGT')"
_BITS = "hex(payload)"
for _k in range(16):
    _BITS = f"replace({_BITS}, '{_k:X}', '{chr(103 + _k)}')"
for _k in range(16):
    _BITS = f"replace({_BITS}, '{chr(103 + _k)}', '{_k:04b}')"

#: Name, parameters, type and body of functions that are expressions alone.
EXPRESSIONS = (
    ("dna_bits", "payload BINARY", "STRING", _BITS),
    ("dna_address", "block_id BIGINT", "STRING", _ADDRESS),
    ("dna_strand", "block_id BIGINT, block STRING", "STRING", f"concat('{PRIMER_LEFT}', {_ADDRESS}, rpad(block, {PAYLOAD_NT}, 'A'), '{PRIMER_RIGHT}')"),
    ("dna_gc", "block STRING", "INT", "length(block) - length(translate(block, 'GC', ''))"),
    ("dna_end_gc", "block STRING", "INT", f"length(right(block, {END_NT})) - length(translate(right(block, {END_NT}), 'GC', ''))"),
    ("dna_count", "s STRING, p STRING", "BIGINT", "CASE WHEN length(p) > 0 THEN (length(s) - length(replace(s, p, ''))) DIV length(p) ELSE 0 END"),
    ("dna_blocks", "dna STRING", "ARRAY<STRING>", f"regexp_extract_all(dna, '.{{1,{PAYLOAD_NT}}}', 0)"),
)
#: Functions that work on Arrow columns.
ARROW = {"dna_fingerprint": dna.fingerprint, "dna_repeats": kernels.repeats, "dna_checks": kernels.checks, "dna_encode": kernels.encode_bytes}


def registerFunctions(spark: SparkSession) -> list[str]:  # noqa: N802
    """Makes the functions known to the session's SQL; gives their names."""
    for name, given, kind, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {kind} RETURN {body}")
    for name, f in ARROW.items():
        spark.udf.register(name, f)
    return [x[0] for x in EXPRESSIONS] + list(ARROW)
