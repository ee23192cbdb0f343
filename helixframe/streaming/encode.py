"""Encoding a stream with a frozen code table: each payload by itself, so that no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.kernels import encode_bytes


def encode_stream(payloads: DataFrame, keys: list[str], codes: list[str], payload: str = "payload") -> DataFrame:
    """payloads (a stream or a table) with dna; null and empty ones are left out. keys and codes: one code table of any number of keys,
    which goes out as one broadcast row."""
    book = payloads.sparkSession.createDataFrame([(list(keys), list(codes))], "_keys array<string>, _codes array<string>")
    joined = payloads.where(F.length(payload) > 0).crossJoin(F.broadcast(book))
    return joined.withColumn("dna", F.array_join(encode_bytes(F.col(payload), F.col("_keys"), F.col("_codes")), "")).drop("_keys", "_codes")
