"""Every registered query of the encoder, and the SQL that should give the same rows.

Encoder queries take documents as payloads. Comparison queries need two tables of runs, which the reporting side of an
encoder would read from CSV; here they are made from lineitem, so that their work grows with the tables: a supplier is a
dataset, returned lines are one implementation and the others the other one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe import core_sql
from helixframe.constants import FALLBACK, PAYLOAD_NT, QUATERNARY
from helixframe.functions import bits, dna
from helixframe.operators import compare, segments
from helixframe.plans import encode
from helixframe.plans import runs as timed
from helixframe.sources import files, publish, ranges, sink
from helixframe.sources.shared import cut, new_folder

KEY = ["doc_id"]


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def payloads(spark, sf: str) -> DataFrame:
    return encode.payload_of(table(spark, sf, "documents"), KEY)


def segs(spark, sf: str) -> DataFrame:
    return segments.segments(payloads(spark, sf), KEY)


def chunks(spark, sf: str) -> DataFrame:
    return encode.chunked(payloads(spark, sf), KEY)


def profile(spark, sf: str) -> DataFrame:
    return segments.chunk_profile(chunks(spark, sf), KEY, encode.CHUNK_SEGMENTS)


def freq(spark, sf: str) -> DataFrame:
    """Summed in each chunk before anything is shuffled."""
    return segments.frequencies(segments.chunk_pairs(chunks(spark, sf)), [])


def encoding(spark, sf: str) -> encode.Encoding:
    return encode.encode(table(spark, sf, "documents"), KEY)


def tiles(spark, sf: str) -> DataFrame:
    """Blocks of the plain two-bit encoding: the same layout, from SQL that needs no code table."""
    plain = payloads(spark, sf).where(F.length("payload") > 0).select(*KEY, segments.once(bits.quaternary(F.col("payload")).alias("dna")))
    return encode.blocks(plain, KEY)


def runs(spark, sf: str, returned: bool) -> DataFrame:
    lines = table(spark, sf, "lineitem").where((F.col("l_returnflag") == "R") == returned)
    one = lambda c, n=4: F.round(F.sum(c), n)
    return lines.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dataset")).agg(
        one(F.col("l_extendedprice"), 2).alias("total_ms"), one(F.col("l_quantity")).alias("lsbm_ms"), one(F.col("l_tax")).alias("huffman_ms"), one(F.col("l_discount")).alias("encode_ms"),
        (F.count(F.lit(1)) * 1024).alias("file_size_bytes"), F.sha2(F.max("l_linenumber").cast("string"), 256).alias("dna_hash_payload"),
    )


def pairs(spark, sf: str) -> DataFrame:
    return compare.joined(runs(spark, sf, False), runs(spark, sf, True), ["dataset"], ("_seq", "_cuda"))


def parallel(spark, sf: str, *by: str) -> DataFrame:
    """Runs of the parallel implementation: a phase for each line number, and the last one from returned lines."""
    lines = table(spark, sf, "lineitem").withColumn("dataset", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    of = [F.col("l_linenumber") == k + 1 for k in range(7)] + [F.col("l_returnflag") == "R"]
    return lines.groupBy("dataset", *by).agg(*[F.coalesce(F.sum(F.when(x, F.col("l_quantity"))), F.lit(0.0)).alias(c) for c, x in zip(compare.PARALLEL_PHASES, of, strict=True)], F.round(F.sum("l_extendedprice"), 2).alias("total_ms"))


def metric_tables(spark, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of runs as an older and a newer version would write them: other columns, in another order."""
    own = runs(spark, sf, False)
    return own.select("dataset", "total_ms", "file_size_bytes", "dna_hash_payload"), runs(spark, sf, True).select("dna_hash_payload", "huffman_ms", "dataset", "total_ms", "file_size_bytes")


def files_of(spark, sf: str, by: str) -> str:
    """A folder with a text file of each document, or some for each group of them, in the shared folder."""
    path = f"{new_folder(spark)}/files"
    table(spark, sf, "documents").select(F.coalesce("text", F.lit("")).alias("text"), F.col(by).cast("string").alias("name")).repartition("name").write.partitionBy("name").text(path)
    return path


def payload_files(spark, sf: str) -> DataFrame:
    """A file of each document, written and read back; a number after its id keeps rows of one id apart."""
    path = f"{new_folder(spark)}/files"
    docs = table(spark, sf, "documents")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("_"), F.monotonically_increasing_id().cast("string"), F.lit(".txt"))
    content = F.encode(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "UTF-8")
    files.write_files(encode.spread(docs.select("doc_id", "text")).select(name.alias("name"), content.alias("content")), path)
    found = files.payload_files_below(spark, path)
    return found.select(F.regexp_extract("file_name", "^(-?[0-9]*)_", 1).try_cast("long").alias("doc_id"), "file_size_bytes", F.sha2("payload", 256).alias("sha"))


def file_ranges(spark, sf: str) -> DataFrame:
    """Bytes of each source's files, counted by ranges of them."""
    chunks = ranges.file_chunks(spark, files_of(spark, sf, "source"), "*.txt", recursive=True)
    own = F.octet_length("bytes").cast("long")
    return chunks.groupBy(F.regexp_extract("path", "name=([^/]*)/", 1).alias("source")).agg(F.sum(own).alias("n_bytes"), F.sum(own - F.length(F.replace(F.hex("bytes"), F.lit("0A"), F.lit(""))) / 2).cast("long").alias("n_breaks"))


def metrics_by_name(spark, sf: str) -> DataFrame:
    path = f"{new_folder(spark)}/metrics"
    for t in metric_tables(spark, sf):
        files.append_metrics(t, path)
    return files.read_metrics(spark, path, METRICS, {"huffman_ms": F.col("total_ms") / 2})


def metrics_appended(spark, sf: str) -> DataFrame:
    path = f"{new_folder(spark)}/metrics"
    for t, batch in zip(metric_tables(spark, sf) * 2, ("a", "b", "a", "b"), strict=True):  # the second time in place of the first
        sink.append_rows(t, path, batch)
    return files.read_metrics(spark, path, METRICS)


def published(spark, sf: str) -> DataFrame:
    path = f"{new_folder(spark)}/sheets"
    publish.publish({"Sequential": runs(spark, sf, False), "Parallel": runs(spark, sf, True)}, path)
    return compare.tagged(publish.published(spark, path), "sheet")


def phase_pivot(spark, sf: str) -> DataFrame:
    """Mean phases of each supplier's runs by line status, and one dataset that has none for each nation."""
    keys = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("dataset")).union(table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    found = compare.phase_pivot(parallel(spark, sf, "l_linestatus"), "dataset", compare.PARALLEL_PHASES, keys)
    return found.select("dataset", *[r6(F.col(c)).alias(c) for c in compare.PARALLEL_PHASES])


def menu_selection(spark, sf: str) -> DataFrame:
    """Choices that customers' numbers spell: their segment's first letter, or their key and nation."""
    text = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("A")).otherwise(F.concat_ws(", ", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), (F.col("c_nationkey") % 5).cast("string")))
    return compare.choices(table(spark, sf, "customer").select("c_custkey", text.alias("menu")), "menu", 4)


def sequential(spark, sf: str) -> DataFrame:
    return runs(spark, sf, False).withColumn("encoding_rate_bits_per_nt", F.col("lsbm_ms") / 100)


def parallel_runs(spark, sf: str) -> DataFrame:
    """parallel() in full: sizes and hashes are those of runs()."""
    more = runs(spark, sf, True).select("dataset", "file_size_bytes", "dna_hash_payload", F.lit(1.0).alias("encoding_rate_bits_per_nt"))
    return parallel(spark, sf).join(more, "dataset")


def timed_documents(spark, sf: str) -> DataFrame:
    """What the rows of a timed run say of each document but for times and memory; names are keys."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("dataset"), F.coalesce("source", F.lit("")).alias("file_name"), "text")
    found = timed.encode_run(lambda: encode.encode(docs, ["dataset", "file_name"]), 1)
    return found.select("dataset", "file_name", "file_size_bytes", "runs", "segments", "seq_count", "rll_max", "rll_violations", "end_violations", r6(F.col("gc_mean")).alias("gc_mean"), (F.col("total_ms") > 0).alias("timed"))


METRICS = "dataset STRING, total_ms DOUBLE, huffman_ms DOUBLE, file_size_bytes BIGINT, dna_hash_payload STRING"


def computed(spark, sf: str) -> DataFrame:
    """pairs() with the time that isn't transfer."""
    return pairs(spark, sf).withColumns({f"compute_ms_{x}": F.col(f"lsbm_ms_{x}") + F.col(f"encode_ms_{x}") for x in ("seq", "cuda")})


FASTER = {"speedup_total": ("total_ms_seq", "total_ms_cuda"), "speedup_lsbm": ("lsbm_ms_seq", "lsbm_ms_cuda"), "speedup_encode": ("encode_ms_seq", "encode_ms_cuda"), "speedup_compute": ("compute_ms_seq", "compute_ms_cuda")}
LABELS = {"MAIL": "by mail", "click": "Clicked", "view": "Viewed"}


def r6(c) -> F.Column:
    return F.round(c, 6)


def encode_metrics(spark, sf):
    m = encoding(spark, sf).metrics
    return m.select(*KEY, "n_bytes", "n_bits", "segments", "nt", "storage_seq_count", "rll_max", "rll_violations", "end_violations", *[r6(F.col(c)).alias(c) for c in ("gc_mean", "gc_var", "encoding_rate_bits_per_nt", "gross_rate_bits_per_nt", "avg_best_lsbm_len")])


def queries() -> dict:
    q = {}
    q["bytes_to_bits"] = lambda s, d: segments.spelled(payloads(s, d), "payload")
    q["segments"] = lambda s, d: segs(s, d)
    q["nonoverlap_count"] = lambda s, d: segs(s, d).select("doc_id", "seg_id", bits.nonoverlap_count(F.col("s"), F.left("s", F.lit(5))).alias("n"))
    q["lsbm_prefix"] = lambda s, d: profile(s, d).select("doc_id", "seg_id", "lp")
    q["lsbm_suffix"] = lambda s, d: profile(s, d).select("doc_id", "seg_id", "ls")
    q["lsbm_profile"] = lambda s, d: profile(s, d).select("doc_id", "seg_id", "best_len", "best_hits")
    q["map1_candidates"] = lambda s, d: segments.chunk_candidates(chunks(s, d), KEY)
    q["map1_freq"] = freq
    q["map1_ranked"] = lambda s, d: segments.ranked(freq(s, d), [])
    q["map1_kept"] = lambda s, d: segments.kept(cut(freq(s, d)), [])  # read several times
    q["huffman_codes"] = lambda s, d: encoding(s, d).codebook.select("doc_id", F.inline(F.arrays_zip("keys", "codes")))
    q["encode_segments"] = lambda s, d: encoding(s, d).coded
    q["payload_dna"] = lambda s, d: encoding(s, d).payload
    q["storage_strands"] = lambda s, d: encoding(s, d).strands
    q["dna_fingerprint"] = lambda s, d: encoding(s, d).fingerprints
    q["encode_metrics"] = encode_metrics
    corpus = lambda s, d: encode.encode(table(s, d, "documents"), KEY, scope="corpus", by=["source"])
    q["encode_corpus"] = lambda s, d: corpus(s, d).payload
    q["corpus_codes"] = lambda s, d: corpus(s, d).codebook.select("source", F.inline(F.arrays_zip("keys", "codes")))
    q["fallback_encode"] = lambda s, d: encode.codebook.encoded_plain(payloads(s, d))
    q["quaternary_dna"] = lambda s, d: payloads(s, d).select("doc_id", bits.quaternary(F.col("payload")).alias("dna"))
    q["payload_blocks"] = lambda s, d: tiles(s, d)
    q["strand_address"] = lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", dna.address(F.col("l_orderkey") * 7).alias("address"))
    q["strands_plain"] = lambda s, d: tiles(s, d).select("doc_id", "block_id", dna.strand(F.col("block_id"), F.col("block")).alias("strand"))
    q["block_constraints"] = lambda s, d: encode.constraints(tiles(s, d)).select("doc_id", "block_id", "gc", "rll", "endgc")
    q["block_summary"] = lambda s, d: encode.block_summary(encode.constraints(tiles(s, d)), KEY).select("doc_id", r6(F.col("gc_mean")).alias("gc_mean"), r6(F.col("gc_var")).alias("gc_var"), "rll_max", "rll_violations", "end_violations", "storage_seq_count", "nt")
    q["fingerprint_plain"] = lambda s, d: table(s, d, "customer").select("c_custkey", dna.fingerprint(F.col("c_name")).alias("h"))
    q["run_timing_stats"] = lambda s, d: compare.timings(table(s, d, "events"), "event_type", "value").select("event_type", "runs", r6(F.col("mean_ms")).alias("mean_ms"), r6(F.col("std_ms")).alias("std_ms"))
    q["compare_runs"] = pairs
    q["compare_runs_two_keys"] = lambda s, d: compare.joined(*[table(s, d, "lineitem").where(F.col("l_returnflag") == f).groupBy("l_suppkey", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q")) for f in "RN"], ["l_suppkey", "l_linestatus"], ("_r", "_n"))
    q["speedup_ratios"] = lambda s, d: compare.speedups(computed(s, d), FASTER).select("dataset", *[r6(F.col(c)).alias(c) for c in FASTER])
    q["hash_parity"] = lambda s, d: pairs(s, d).select("dataset", compare.parity("dna_hash_payload_seq", "dna_hash_payload_cuda").alias("match"))
    q["match_summary"] = lambda s, d: compare.match_summary(pairs(s, d), "dna_hash_payload_seq", "dna_hash_payload_cuda")
    q["mismatches"] = lambda s, d: compare.mismatches(compare.match_summary(pairs(s, d), "dna_hash_payload_seq", "dna_hash_payload_cuda"))
    q["speedup_summary"] = lambda s, d: compare.speedups(computed(s, d), FASTER).agg(*[r6(F.avg(c)).alias(c) for c in FASTER], F.count_if(compare.parity("dna_hash_payload_seq", "dna_hash_payload_cuda")).alias("matches"))
    q["rounded_summary"] = lambda s, d: pairs(s, d).select("dataset", F.round(F.col("file_size_bytes_seq") / 1024, 1).alias("kb"), F.round("total_ms_seq", 1).alias("seq"), F.format_string("%.2f", "lsbm_ms_cuda").alias("lsbm"))
    q["phase_breakdown"] = lambda s, d: compare.phases(parallel(s, d), ["dataset"], compare.PARALLEL_PHASES)
    q["phase_sum"] = lambda s, d: parallel(s, d).select("dataset", F.round(compare.total(compare.PARALLEL_PHASES), 3).alias("phase_sum_ms"))
    q["phase_means"] = lambda s, d: compare.means(table(s, d, "lineitem"), "l_shipdate", ("l_quantity", "l_tax", "l_discount")).select("l_shipdate", *[r6(F.col(c)).alias(c) for c in ("l_quantity", "l_tax", "l_discount")])
    q["bottleneck_phase"] = lambda s, d: compare.bottleneck(runs(s, d, True), ["dataset"]).withColumn("share", r6(F.col("share")))
    q["common_datasets"] = lambda s, d: compare.in_both(table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "customer").select(F.col("c_custkey").alias("k")))
    q["tagged_union"] = lambda s, d: compare.tagged({"SEQ": runs(s, d, False), "CUDA": runs(s, d, True).drop("huffman_ms")})
    q["lenient_cast"] = lambda s, d: compare.lenient(table(s, d, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer#0000000"), F.lit("")).alias("x")), ["x"])
    q["label_map"] = lambda s, d: compare.labelled(table(s, d, "events").select("event_id", "event_type"), "event_type", LABELS)
    q["label_last"] = lambda s, d: compare.last_labelled(table(s, d, "events").select("event_id", "event_type", "ts", "user_id"), "event_type", LABELS, ["ts", "event_id"])
    q["dim_lookup_join"] = lambda s, d: compare.looked_up(table(s, d, "lineitem"), table(s, d, "part"), "l_partkey", "p_partkey").select("l_orderkey", "l_linenumber", "p_name", "l_quantity")
    q["grouped_transfer"] = lambda s, d: compare.sums(table(s, d, "lineitem"), "l_returnflag", {"bytes": ("l_quantity", None), "open_bytes": ("l_quantity", F.col("l_linestatus") == "O")}).select("l_returnflag", *[F.round(c, 2).alias(c) for c in ("bytes", "open_bytes")])
    q["transfer_bandwidth"] = lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", r6(compare.bandwidth(F.col("l_extendedprice") * 1e6, F.col("l_tax") * 1000)).alias("gbs"))
    q["row_wise_least"] = lambda s, d: table(s, d, "part").select("p_partkey", r6(compare.occupancy(F.col("p_size"), (F.col("p_retailprice") * 10).cast("bigint"), F.col("p_size") * 8)).alias("occupancy"))
    q["first_row"] = lambda s, d: compare.first(table(s, d, "supplier"), "s_suppkey")
    q["payload_files"] = payload_files
    q["file_ranges"] = file_ranges
    q["basename"] = lambda s, d: table(s, d, "pages").select("page_id", files.basename(F.col("url")).alias("name"))
    q["metrics_by_name"] = metrics_by_name
    q["metrics_appended"] = metrics_appended
    q["latest_run"] = lambda s, d: files.latest(table(s, d, "events").select("event_type", "ts", "event_id", "user_id"), "event_type", "ts")
    q["missing_columns"] = lambda s, d: compare.older(runs(s, d, True).withColumnRenamed("huffman_ms", "encoding_rate_bits_per_nt").drop("dna_hash_payload"), True)
    q["published_frames"] = published
    q["phase_pivot"] = phase_pivot
    q["menu_selection"] = menu_selection
    q["compare_summary"] = lambda s, d: compare.summary(compare.compare(sequential(s, d), parallel_runs(s, d))).select("datasets", "matches", *[r6(F.col(c)).alias(c) for c in FASTER])
    q["timed_documents"] = timed_documents
    return q


#: A document's bits, segments and repeats, by DuckDB's bit strings and linear searches: other algorithms than ours.
BITS = "d AS (SELECT doc_id, encode(text)::BIT::VARCHAR AS bits FROM documents WHERE len(text) > 0)"
SEGS = f"{BITS}, g AS (SELECT doc_id, i::INT AS seg_id, bits[i * 500 + 1 : i * 500 + 500] AS s FROM (SELECT doc_id, bits, unnest(range(0, (len(bits) + 499) // 500)) AS i FROM d))"
LINEAR = f"""{SEGS}, r AS (SELECT *, coalesce(list_max(list_filter(range(3, len(s) // 2 + 1), lambda n: contains(s[n + 1 :], s[1 : n]))), 0)::INT AS lp,
coalesce(list_max(list_filter(range(3, len(s) // 2 + 1), lambda n: contains(s[1 : len(s) - n], s[len(s) - n + 1 :]))), 0)::INT AS ls FROM g)"""


def halved_sql(test: str) -> str:
    """By binary search, where many queries need the lengths."""
    m = "((a[1] + a[2]) // 2)"
    return f"list_reduce(list_concat([[3, len(s) // 2, 0]], [[0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0]]), lambda a, x: CASE WHEN a[1] > a[2] THEN a WHEN {test.format(m=m)} THEN [{m} + 1, a[2], {m}] ELSE [a[1], {m} - 1, a[3]] END)[3]::INT"


REPS = f"{SEGS}, r AS (SELECT *, {halved_sql('contains(s[{m} + 1 :], s[1 : {m}])')} AS lp, {halved_sql('contains(s[1 : len(s) - {m}], s[len(s) - {m} + 1 :])')} AS ls FROM g)"


def count_sql(s: str, p: str) -> str:
    return f"((len({s}) - len(replace({s}, {p}, ''))) // len({p}))"


CANDS = f"""{REPS}, c AS (SELECT doc_id, substr, {count_sql('s', 'substr')} AS hits FROM (
SELECT doc_id, s, s[1 : lp] AS substr FROM r WHERE len(s) > 3 AND lp >= 3
UNION ALL SELECT doc_id, s, s[len(s) - ls + 1 :] FROM r WHERE len(s) > 3 AND ls >= 3 AND NOT (ls <= lp AND s[len(s) - ls + 1 :] = s[1 : ls])))"""
FREQ = f"{CANDS}, f AS (SELECT substr, sum(hits)::BIGINT AS freq FROM c GROUP BY substr)"
RANKED = f"{FREQ}, k AS (SELECT *, row_number() OVER (ORDER BY len(substr) DESC, freq DESC, substr)::INT AS rank FROM f)"


def spelled_sql(pairs: dict[str, str]) -> str:
    """Each hexadecimal digit of a text's bytes as the words of its two bit pairs."""
    words = ", ".join(f"'{pairs[f'{k:04b}'[:2]]}{pairs[f'{k:04b}'[2:]]}'" for k in range(16))
    return f"array_to_string(list_transform(string_split(hex(encode(text)), ''), lambda h: ([{words}])[strpos('0123456789ABCDEF', h)]), '')"


PLAIN = f"n AS (SELECT doc_id, {spelled_sql(QUATERNARY)} AS dna FROM documents WHERE len(text) > 0), b AS (SELECT doc_id, i::INT AS block_id, dna[i * 120 + 1 : i * 120 + 120] AS block FROM (SELECT doc_id, dna, unnest(range(0, (len(dna) + 119) // 120)) AS i FROM n))"
CHECKED = f"""{PLAIN}, x AS (SELECT doc_id, block_id, block, len(regexp_replace(block, '[AT]', '', 'g'))::INT AS gc, list_max(list_transform(regexp_extract_all(block, 'A+|C+|G+|T+'), lambda z: len(z)))::INT AS rll, len(regexp_replace(right(block, 5), '[AT]', '', 'g'))::INT AS endgc FROM b)"""


def digits_sql(n: str) -> str:
    return " || ".join(f"'ACGT'[((({n}) >> {2 * k}) & 3)::INT + 1]" for k in range(8, -1, -1))


def runs_sql(returned: bool) -> str:
    return f"""SELECT 's' || l_suppkey AS dataset, round(sum(l_extendedprice), 2) AS total_ms, round(sum(l_quantity), 4) AS lsbm_ms, round(sum(l_tax), 4) AS huffman_ms, round(sum(l_discount), 4) AS encode_ms,
count(*) * 1024 AS file_size_bytes, sha256(max(l_linenumber)::VARCHAR) AS dna_hash_payload FROM lineitem WHERE {'' if returned else 'NOT '}(l_returnflag = 'R') GROUP BY l_suppkey"""


def parallel_sql(*by: str) -> str:
    names = [*(f"l_linenumber = {k + 1}" for k in range(7)), "l_returnflag = 'R'"]
    sums = ", ".join(f"coalesce(sum(l_quantity) FILTER (WHERE {x}), 0) AS {c}" for c, x in zip(compare.PARALLEL_PHASES, names, strict=True))
    return f"SELECT 's' || l_suppkey AS dataset, {sums}, round(sum(l_extendedprice), 2) AS total_ms FROM lineitem GROUP BY {', '.join(['l_suppkey', *by])}"


_RUN = ("total_ms", "lsbm_ms", "huffman_ms", "encode_ms", "file_size_bytes", "dna_hash_payload")
PAIRS = f"a AS ({runs_sql(False)}), b AS ({runs_sql(True)}), p AS (SELECT dataset, {', '.join(f'a.{c} AS {c}_seq, b.{c} AS {c}_cuda' for c in _RUN)} FROM a JOIN b USING (dataset))"


COMPUTED = f"{PAIRS}, v AS (SELECT *, lsbm_ms_seq + encode_ms_seq AS compute_ms_seq, lsbm_ms_cuda + encode_ms_cuda AS compute_ms_cuda FROM p)"
LABEL = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in LABELS.items()) + " ELSE event_type END AS label"


def quotient(n: str) -> str:
    a, b = FASTER[n]
    return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"


def oracle_sql() -> dict[str, str]:
    o = {}
    o["bytes_to_bits"] = "SELECT doc_id, CASE WHEN len(text) > 0 THEN encode(text)::BIT::VARCHAR ELSE text END AS bits FROM documents"
    o["segments"] = f"WITH {SEGS} SELECT * FROM g"
    o["nonoverlap_count"] = f"WITH {SEGS} SELECT doc_id, seg_id, {count_sql('s', 's[1:5]')} AS n FROM g"
    o["lsbm_prefix"] = f"WITH {LINEAR} SELECT doc_id, seg_id, lp FROM r"
    o["lsbm_suffix"] = f"WITH {LINEAR} SELECT doc_id, seg_id, ls FROM r"
    o["lsbm_profile"] = f"""WITH {REPS}, m AS (SELECT *, CASE WHEN len(s) < 4 THEN 0 ELSE greatest(lp, ls) END AS best_len FROM r)
SELECT doc_id, seg_id, best_len, CASE WHEN best_len = 0 THEN 0 ELSE greatest({count_sql('s', 's[1 : best_len]')}, {count_sql('s', 's[len(s) - best_len + 1 :]')}) END AS best_hits FROM m"""
    o["map1_candidates"] = f"WITH {CANDS} SELECT * FROM c"
    o["map1_freq"] = f"WITH {FREQ} SELECT * FROM f"
    o["map1_ranked"] = f"WITH {RANKED} SELECT * FROM k WHERE rank <= 512"
    o["map1_kept"] = f"""WITH {RANKED}, t AS (SELECT * FROM k WHERE rank <= 512), n AS (SELECT count(*) AS n0 FROM t), z AS (SELECT n0, (SELECT count(*) FROM t WHERE len(substr) >= 2 * (SELECT min(e) FROM range(0, 11) y(e) WHERE (1 << e) >= n0) + 1) AS m FROM n)
SELECT k.* FROM k, z WHERE CASE WHEN n0 <= 1 THEN rank <= n0 WHEN m > 0 THEN rank <= m ELSE true END"""
    o["fallback_encode"] = f"SELECT doc_id, {spelled_sql(FALLBACK)} AS dna FROM documents WHERE len(text) > 0"
    o["quaternary_dna"] = f"WITH {PLAIN} SELECT documents.doc_id, CASE WHEN len(text) > 0 THEN dna ELSE text END AS dna FROM documents LEFT JOIN n USING (doc_id)"
    o["payload_blocks"] = f"WITH {PLAIN} SELECT * FROM b"
    o["strand_address"] = f"SELECT l_orderkey, l_linenumber, {digits_sql('l_orderkey * 7')} AS address FROM lineitem"
    o["strands_plain"] = f"WITH {PLAIN} SELECT doc_id, block_id, 'ACGTTGCATGTCAGTACGTA' || {digits_sql('block_id::BIGINT')} || rpad(block, {PAYLOAD_NT}, 'A') || 'TACGACTGACATGCAACGTT' AS strand FROM b"
    o["block_constraints"] = f"WITH {CHECKED} SELECT doc_id, block_id, gc, rll, endgc FROM x"
    o["block_summary"] = f"""WITH {CHECKED} SELECT doc_id, round(avg(gc / 120.0::DOUBLE), 6) AS gc_mean, round(var_pop(gc / 120.0::DOUBLE), 6) AS gc_var, max(rll)::BIGINT AS rll_max, count(*) FILTER (WHERE rll > 2) AS rll_violations,
count(*) FILTER (WHERE endgc > 3) AS end_violations, count(*) AS storage_seq_count, sum(len(block))::BIGINT AS nt FROM x GROUP BY doc_id"""
    o["fingerprint_plain"] = "SELECT c_custkey, lower(lpad(printf('%x', list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(string_split(c_name, ''), lambda z: ascii(z)::UHUGEINT)), lambda h, z: (xor(h, z) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT), 16, '0')) AS h FROM customer"
    o["run_timing_stats"] = "SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS std_ms FROM events GROUP BY event_type"
    o["compare_runs"] = f"WITH {PAIRS} SELECT * FROM p"
    o["compare_runs_two_keys"] = "WITH g AS (SELECT l_suppkey, l_linestatus, l_returnflag AS f, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL) SELECT a.l_suppkey, a.l_linestatus, a.q AS q_r, b.q AS q_n FROM g a JOIN g b ON a.l_suppkey = b.l_suppkey AND a.l_linestatus = b.l_linestatus AND a.f = 'R' AND b.f = 'N'"
    o["speedup_ratios"] = f"WITH {COMPUTED} SELECT dataset, {', '.join(f'round({quotient(n)}, 6) AS {n}' for n in FASTER)} FROM v"
    o["hash_parity"] = f"WITH {PAIRS} SELECT dataset, dna_hash_payload_seq = dna_hash_payload_cuda AND len(dna_hash_payload_seq) > 0 AS match FROM p"
    o["speedup_summary"] = f"WITH {COMPUTED} SELECT {', '.join(f'round(avg({quotient(n)}), 6) AS {n}' for n in FASTER)}, count(*) FILTER (WHERE dna_hash_payload_seq = dna_hash_payload_cuda) AS matches FROM v"
    match = f"WITH {PAIRS}, t AS (SELECT dataset, dna_hash_payload_seq AS hash_seq, dna_hash_payload_cuda AS hash_gpu, dna_hash_payload_seq = dna_hash_payload_cuda AND len(dna_hash_payload_seq) > 0 AS match FROM p)"
    o["match_summary"] = f"{match} SELECT * FROM t"
    o["mismatches"] = f"{match} SELECT count(*) AS datasets, count(*) FILTER (WHERE NOT match) AS mismatches FROM t"
    o["rounded_summary"] = f"WITH {PAIRS} SELECT dataset, round(file_size_bytes_seq / 1024, 1) AS kb, round(total_ms_seq, 1) AS seq, printf('%.2f', lsbm_ms_cuda) AS lsbm FROM p"
    o["phase_breakdown"] = f"WITH a AS ({parallel_sql()}) SELECT dataset, phase, ms FROM (SELECT * EXCLUDE (total_ms) FROM a) UNPIVOT (ms FOR phase IN ({', '.join(compare.PARALLEL_PHASES)}))"
    o["phase_sum"] = f"WITH a AS ({parallel_sql()}) SELECT dataset, round({' + '.join(compare.PARALLEL_PHASES)}, 3) AS phase_sum_ms FROM a"
    o["payload_files"] = "SELECT doc_id, octet_length(encode(coalesce(text, '') || chr(10)))::BIGINT AS file_size_bytes, sha256(coalesce(text, '') || chr(10)) AS sha FROM documents"
    o["file_ranges"] = "SELECT source, sum(octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS n_bytes, sum(len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) + 1)::BIGINT AS n_breaks FROM documents GROUP BY source"
    o["basename"] = r"SELECT page_id, list_last(string_split(replace(url, '\\', '/'), '/')) AS name FROM pages"
    older = f"SELECT dataset, total_ms, {{}} AS huffman_ms, file_size_bytes, dna_hash_payload FROM ({runs_sql(False)}) UNION ALL SELECT dataset, total_ms, huffman_ms, file_size_bytes, dna_hash_payload FROM ({runs_sql(True)})"
    o["metrics_by_name"] = older.format("total_ms / 2")
    o["metrics_appended"] = older.format("NULL::DOUBLE")
    o["latest_run"] = "SELECT event_type, ts, event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC, user_id DESC) AS k FROM events) WHERE k = 1"
    o["missing_columns"] = f"SELECT * EXCLUDE (huffman_ms, dna_hash_payload), huffman_ms AS encoding_rate_bits_per_nt, total_ms AS phase_sum_ms, huffman_ms AS gross_rate_bits_per_nt, '' AS dna_hash_payload FROM ({runs_sql(True)})"
    o["published_frames"] = f"SELECT *, 'Sequential' AS sheet FROM ({runs_sql(False)}) UNION ALL BY NAME SELECT *, 'Parallel' AS sheet FROM ({runs_sql(True)})"
    means = ", ".join(f"round(avg({c}), 6) AS {c}" for c in compare.PARALLEL_PHASES)
    o["phase_pivot"] = f"WITH a AS ({parallel_sql('l_linestatus')}), k AS (SELECT 's' || s_suppkey AS dataset FROM supplier UNION SELECT 'n' || n_nationkey FROM nation) SELECT dataset, {means} FROM k LEFT JOIN a USING (dataset) GROUP BY dataset"
    menu = "CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'A' ELSE c_custkey || ', ' || c_nationkey || ', ' || c_mktsegment || ', ' || c_nationkey % 5 END"
    o["menu_selection"] = f"SELECT c_custkey, menu, n::INT AS choice FROM (SELECT c_custkey, {menu} AS menu FROM customer), range(1, 5) r(n) WHERE menu = 'A' OR list_contains(string_split(menu, ', '), n::VARCHAR)"
    o["compare_summary"] = f"""WITH a AS ({runs_sql(False)}), b AS ({parallel_sql()}), h AS ({runs_sql(True)}), p AS (SELECT a.total_ms AS t, b.total_ms AS u, a.lsbm_ms AS l, lsbm_kernel_ms AS m, a.encode_ms AS e, encode_kernel_ms AS f,
a.lsbm_ms + a.huffman_ms + a.encode_ms AS c, {' + '.join(compare.COMPUTING)} AS d, a.dna_hash_payload = h.dna_hash_payload AS same FROM a JOIN b USING (dataset) JOIN h USING (dataset))
SELECT count(*) AS datasets, count(*) FILTER (WHERE same) AS matches, {', '.join(f"round(avg(CASE WHEN {y} > 0 THEN {x} / {y} ELSE 0 END), 6) AS {n}" for n, x, y in zip(FASTER, 'tlec', 'umfd'))} FROM p"""
    o["phase_means"] = "SELECT l_shipdate, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY l_shipdate"
    o["bottleneck_phase"] = f"WITH a AS ({runs_sql(True)}), u AS (SELECT dataset, phase, ms FROM (SELECT dataset, lsbm_ms, huffman_ms, encode_ms FROM a) UNPIVOT (ms FOR phase IN (lsbm_ms, huffman_ms, encode_ms))) SELECT dataset, phase, ms, round(ms / total, 6) AS share FROM (SELECT *, sum(ms) OVER (PARTITION BY dataset) AS total, row_number() OVER (PARTITION BY dataset ORDER BY ms DESC, phase) AS k FROM u) WHERE k = 1"
    o["common_datasets"] = "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer"
    o["tagged_union"] = f"SELECT *, 'SEQ' AS impl FROM ({runs_sql(False)}) UNION ALL BY NAME SELECT * EXCLUDE (huffman_ms), 'CUDA' AS impl FROM ({runs_sql(True)})"
    o["lenient_cast"] = "SELECT c_custkey, try_cast(replace(c_name, 'Customer#0000000', '') AS DOUBLE) AS x FROM customer"
    o["label_map"] = f"SELECT event_id, event_type, {LABEL} FROM events"
    o["label_last"] = f"SELECT label, event_id, event_type, ts, user_id FROM (SELECT *, {LABEL}, row_number() OVER (PARTITION BY label ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"
    o["dim_lookup_join"] = "SELECT l_orderkey, l_linenumber, p_name, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey"
    o["grouped_transfer"] = "SELECT l_returnflag, round(sum(l_quantity), 2) AS bytes, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS open_bytes FROM lineitem GROUP BY l_returnflag"
    o["transfer_bandwidth"] = "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax > 0 THEN l_extendedprice * 1e6 / 1e9 / (l_tax * 1000 / 1e3) ELSE 0 END, 6) AS gbs FROM lineitem"
    o["row_wise_least"] = """SELECT p_partkey, round(least(48, CASE WHEN r > 0 THEN 65536 // (r * 32) ELSE 48 END, least(32, 102400 // CASE WHEN s > 0 THEN s ELSE 1 END) * CASE WHEN b >= 32 THEN b // 32 ELSE 1 END) / 48.0::DOUBLE * 100, 6) AS occupancy
FROM (SELECT p_partkey, p_size AS r, trunc(p_retailprice * 10)::BIGINT AS s, p_size * 8 AS b FROM part)"""
    o["first_row"] = "SELECT * FROM supplier ORDER BY s_suppkey LIMIT 1"
    return o | core_sql.oracle_sql(REPS, count_sql, digits_sql)
