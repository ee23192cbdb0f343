import random

import pytest

from helixframe.functions import dna
from helixframe.operators import codebook
from helixframe.plans import encode
from tests import model

VECTORS = {  # payload: (payload hash, storage hash)
    b"A": ("31cda67b8d7990bb", "68d55047036845e5"),
    bytes(16): ("895e811da36bc383", "0e389d7a4b0e494d"),
    bytes(125): ("1ef3475893fcff83", "911035c858bb6dfb"),
    b"ABC" * 100: ("f56b7602819926ab", "7031a2e5ee4f0bb8"),
    bytes(range(250)): ("7caa8687fbe3b488", "782913eb1085dfdd"),
    bytes(range(256)) * 8: ("939cc82a2e1d5d2b", "305b6b333af6f44d"),
    b"The quick brown fox jumps over the lazy dog. " * 40: ("1f3ec803a1cbb36b", "d9d310e11be98a23"),
    bytes(((i * 1103515245 + 12345) >> 16) & 255 for i in range(4096)): ("f0a487bf1150ae6e", "9e28dbeb71178ef0"),
}


def frame(spark, payloads, n=3):
    return spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(payloads)], "k long, payload binary").repartition(n)


@pytest.mark.parametrize("parts", [1, 5])
def test_golden_vectors(spark, parts):
    done = encode.encode(frame(spark, [*VECTORS, b"", None], parts), ["k"], "payload")
    got = {r["k"]: (r["dna_hash_payload"], r["dna_hash_storage"]) for r in encode.fingerprints(done.payload, ["k"]).collect()}
    assert got == dict(enumerate(VECTORS.values()))
    assert all(len(r["strand"]) == 169 for r in done.strands.collect())
    metrics = done.metrics.collect()
    assert len(metrics) == len(VECTORS) and all(m["rll_max"] <= 2 for m in metrics)


def test_against_the_model(spark):
    rng = random.Random(3)
    payloads = [bytes(rng.choices(b"ab c", k=rng.randint(1, 900))) for _ in range(12)] + [rng.randbytes(400) for _ in range(6)] + ["é€𝄞".encode() * 40]
    done = encode.encode(frame(spark, payloads), ["k"], "payload")
    got = {r["k"]: r["dna"] for r in done.payload.collect()}
    books = {r["k"]: dict(zip(r["keys"], r["codes"])) for r in done.codebook.collect()}
    for k, raw in enumerate(payloads):
        segs = model.segments(raw)
        book = model.codes(model.table(segs))
        assert books.get(k, {}) == book
        assert got[k] == model.encode(segs, book)
    coded = {(r["k"], r["seg_id"]): r["dna"] for r in done.coded.collect()}
    assert coded == {(k, n): model.encode([x], books.get(k, {})) for k, raw in enumerate(payloads) for n, x in enumerate(model.segments(raw))}


def test_corpus_scope_shares_one_table(spark):
    payloads = [b"abcabcabc" * 30, b"xyzxyz" * 40, b"abcxyz" * 50]
    done = encode.encode(frame(spark, payloads), ["k"], "payload", scope="corpus")
    book = model.codes(model.table([s for x in payloads for s in model.segments(x)]))
    assert {r["k"]: r["dna"] for r in done.payload.collect()} == {k: model.encode(model.segments(x), book) for k, x in enumerate(payloads)}


def test_long_payloads_in_chunks(spark, monkeypatch):
    """Blocks, texts and counts of payloads of several chunks, short and long ones side by side, by either way of ranking."""
    rng = random.Random(7)
    words = [rng.randbytes(rng.randint(2, 9)) for _ in range(40)]
    payloads = [b"".join(rng.choices(words, k=n)) for n in (3, 60, 200, 900)] + [rng.randbytes(n) for n in (124, 125, 126, 250, 251, 999)]
    monkeypatch.setattr(encode, "CHUNK_SEGMENTS", 2)
    monkeypatch.setattr(encode, "CHUNK_BYTES", 125)
    for long in (64, 3):
        monkeypatch.setattr(encode, "LONG_CHUNKS", long)
        done = encode.encode(frame(spark, payloads, 2), ["k"], "payload")
        want = {k: model.encode(model.segments(x), model.codes(model.table(model.segments(x)))) for k, x in enumerate(payloads)}
        assert {r["k"]: r["dna"] for r in done.payload.collect()} == want
        strands = {(r["k"], r["block_id"]): r["strand"][29:149] for r in done.strands.collect()}
        assert strands == {(k, i): x[120 * i : 120 * i + 120].ljust(120, "A") for k, x in want.items() for i in range(-(-len(x) // 120))}
        metrics = {r["k"]: r for r in done.metrics.collect()}
        for k, x in enumerate(payloads):
            segs = model.segments(x)
            best = [max(model.longest(s, True), model.longest(s, False)) if len(s) > 3 else 0 for s in segs]
            assert (metrics[k]["n_bytes"], metrics[k]["segments"], metrics[k]["nt"]) == (len(x), len(segs), len(want[k])) and metrics[k]["avg_best_lsbm_len"] == pytest.approx(sum(best) / len(best))
        assert {(r["k"], r["seg_id"]): r["s"] for r in done.segments.collect()} == {(k, n): x for k, raw in enumerate(payloads) for n, x in enumerate(model.segments(raw))}


def test_null_groups_and_keys_that_repeat(spark):
    rows = [(1, b"abcabcabc" * 40, "x"), (1, b"zyxzyx" * 30, "x"), (None, b"abcabcabc" * 40, None), (None, b"hello hello hello" * 9, None), (2, b"abcabcabc" * 40, None)]
    docs = spark.createDataFrame([(k, bytearray(x), s) for k, x, s in rows], "k long, payload binary, source string").repartition(2)
    own = lambda texts: model.codes(model.table([s for x in texts for s in model.segments(x)]))
    done = encode.encode(docs, ["k"], "payload")
    want = sorted((str(k), model.encode(model.segments(x), own([x]))) for k, x, _ in rows)
    assert sorted((str(r["k"]), r["dna"]) for r in done.payload.collect()) == want
    assert sorted((str(r["k"]), r["nt"], r["n_bytes"]) for r in done.metrics.collect()) == sorted((str(k), len(model.encode(model.segments(x), own([x]))), len(x)) for k, x, _ in rows)
    assert done.codebook.count() == len(rows)
    done = encode.encode(docs, ["k"], "payload", scope="corpus", by=["source"])
    books = {s: own([x for _, x, t in rows if t == s]) for s in ("x", None)}
    assert sorted((str(r["k"]), r["dna"]) for r in done.payload.collect()) == sorted((str(k), model.encode(model.segments(x), books[s])) for k, x, s in rows)
    assert done.metrics.count() == len(rows)


def test_repeats_by_expressions_and_in_python(spark):
    from pyspark.sql import functions as F

    from helixframe.functions import bits, kernels

    rng = random.Random(1)
    texts = ["".join(rng.choices("01", weights=(rng.random(), 0.3), k=rng.randint(0, 500))) for _ in range(60)] + ["", "0", "0" * 500, "01" * 250, "0001000", None]
    rows = spark.createDataFrame([(x,) for x in texts], "s string").select("s", kernels.repeats("s").alias("r"), bits.longest_prefix("s").alias("p"), bits.longest_suffix("s").alias("q")).collect()
    for r in rows:
        if r["s"] is not None:
            assert (r["r"]["lp"], r["r"]["ls"]) == (r["p"], r["q"]) == (model.longest(r["s"], True), model.longest(r["s"], False))
    blocks = ["".join(rng.choices("ACGT", k=rng.randint(0, 9))) for _ in range(60)] + ["A", "GGGG", None, ""]
    for r in spark.createDataFrame([(x,) for x in blocks], "b string").select("b", kernels.checks("b").alias("c"), dna.gc_count(F.col("b")), dna.max_run(F.col("b")), dna.end_gc(F.col("b"))).collect():
        assert (r["c"] is None) == (r["b"] is None) and (r["c"] is None or tuple(r["c"]) == tuple(r[2:]))


def test_keys_of_any_length_in_the_coder():
    from helixframe.functions import kernels

    rng = random.Random(1)
    for _ in range(300):
        raw = bytes(rng.choices(b"ab c", k=rng.randint(1, 400)))
        book = {"".join(rng.choices("01", k=rng.randint(1, rng.choice([4, 20, 70])))): "G" * (k + 2) for k in range(rng.randint(0, 6))}
        assert kernels.coder(list(book), list(book.values()))(raw) == [model.encode([s], book) for s in model.segments(raw)]


def test_depth_cut():
    assert codebook.tree_codes([]) == [] and codebook.tree_codes([5]) == [""] and codebook.tree_codes([1, 1]) == ["G", "C"]
    assert model.table(["0" * 9]) == [("0000", 2)]


def test_address_and_constraints(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(262143, 262146).select(dna.address(F.col("id"))).collect()]
    assert sorted(got) == ["AAAAAAAAA", "AAAAAAAAC", "TTTTTTTTT"]
    row = spark.createDataFrame([("GAGGATTTC",)], "block string").select(dna.gc_count(F.col("block")), dna.max_run(F.col("block")), dna.end_gc(F.col("block")), dna.fingerprint(F.lit("GATC")), dna.fingerprint(F.lit(""))).first()
    assert tuple(row) == (4, 3, 1, "01e4f8bfa83ca06e", "14650fb0739d0383")


def test_streaming_equals_batch(spark, tmp_path):
    from helixframe.streaming.encode import encode_stream

    frame(spark, [b"abc" * 50, b"zz"]).write.parquet(str(tmp_path / "in"))
    book = (["0110", "011"], ["GAG", "CA"])
    batch = encode_stream(spark.read.parquet(str(tmp_path / "in")), *book)
    stream = encode_stream(spark.readStream.schema("k long, payload binary").parquet(str(tmp_path / "in")), *book)
    q = stream.writeStream.format("memory").queryName("dna").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["k"]: r["dna"] for r in spark.table("dna").collect()} == {r["k"]: r["dna"] for r in batch.collect()}


def test_a_stream_with_a_table_of_many_keys(spark, tmp_path):
    """More than 512 keys, as an encoding keeps them where none is deep."""
    from helixframe.streaming.encode import encode_stream

    rng = random.Random(4)
    keys = sorted({f"{rng.getrandbits(11):011b}" for _ in range(900)}, key=lambda x: (-len(x), x))
    codes = [f"G{''.join(rng.choices('AT', k=10))}" for _ in keys]
    assert len(keys) > 512
    payloads = [rng.randbytes(n) for n in (1, 60, 125, 126, 400)]
    frame(spark, [*payloads, b"", None]).write.parquet(str(tmp_path / "in"))
    stream = encode_stream(spark.readStream.schema("k long, payload binary").parquet(str(tmp_path / "in")), keys, codes)
    q = stream.writeStream.format("memory").queryName("many").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    book = dict(zip(keys, codes, strict=True))
    assert {r["k"]: r["dna"] for r in spark.table("many").collect()} == {k: model.encode(model.segments(x), book) for k, x in enumerate(payloads)}


def test_edges_of_the_code_table(spark):
    """More than 512 keys that are all short: the cap is undone; frequencies so skewed that codes are long."""
    rng = random.Random(9)
    units, found = [], set()
    while len(found) <= 520:
        unit = rng.randbytes(125)  # two segments
        best = [(s, model.longest(s, True), model.longest(s, False)) for s in model.segments(unit)]
        if all(max(p, q) < 19 for _, p, q in best):
            units.append(unit)
            found |= {s[:p] for s, p, _ in best} | {s[len(s) - q :] for s, _, q in best}
    raw = b"".join(units)
    kept = model.table(model.segments(raw))
    assert len(kept) > 512 and max(len(k) for k, _ in kept) < 19
    done = encode.encode(frame(spark, [raw]), ["k"], "payload")
    assert done.payload.first()["dna"] == model.encode(model.segments(raw), model.codes(kept))
    freqs = [1, 1]
    while len(freqs) < 30:
        freqs.append(freqs[-1] + freqs[-2])
    codes = codebook.tree_codes(freqs)
    assert max(map(len, codes)) == 29 > 12 and len(set(codes)) == 30 and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_more_blocks_than_addresses(spark):
    """Addresses begin anew after 4 ** 9 blocks, in strands as in the function."""
    from pyspark.sql import functions as F

    blocks = spark.range(262140, 262150).select(F.col("id").cast("int").alias("block_id"), F.lit("GAT").alias("block"))
    got = {r["block_id"]: r["s"][20:29] for r in blocks.select("block_id", dna.strand(F.col("block_id"), F.col("block")).alias("s")).collect()}
    digits = lambda n: "".join("ACGT"[n >> 2 * k & 3] for k in range(8, -1, -1))
    assert got == {n: digits(n % 4**9) for n in range(262140, 262150)} and got[262144] == "AAAAAAAAA"


def test_files_and_metrics(spark, tmp_path):
    from helixframe.sources import files

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a-b.txt").write_bytes(b"hello")
    (tmp_path / "f" / "e.pdf").write_bytes(b"")
    (tmp_path / "f" / "no.csv").write_bytes(b"x")
    found = files.payload_files(spark, str(tmp_path / "f"))
    assert sorted((r["dataset"], r["file_size_bytes"]) for r in found.collect()) == [("a_b.txt", 5)]
    (tmp_path / "f" / "b +c.txt").write_bytes(b"")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in files.rejected_files(spark, str(tmp_path / "f")).collect()) == ["b +c.txt", "e.pdf"]
    assert files.rejected_files(spark, str(tmp_path / "f"), "*.csv").count() == 0
    m = spark.createDataFrame([("d", 1, "1e5")], "dataset string, runs int, dna_hash_payload string")
    for _ in range(2):
        files.append_metrics(m, str(tmp_path / "m"))
    back = files.read_metrics(spark, str(tmp_path / "m"), m.schema)
    assert files.read_metrics(spark, str(tmp_path / "f" / "e.pdf"), m.schema).count() == 0
    assert back.count() == 2 and files.latest(back, "dataset", "runs").first()["dna_hash_payload"] == "1e5"


def test_metrics_are_read_by_name(spark, tmp_path):
    from pyspark.sql import functions as F

    from helixframe.sources import files

    schema = "dataset string, rll int, endv int, phase_sum_ms double, total_ms double, dna_hash_payload string"
    for name, text in {
        "a.csv": "dataset,rll,endv\nx,1,2\n", "b.csv": "dataset,endv,rll\ny,20,10\n", "c.csv": "dataset,endv\nz,7\n", "d.csv": 'more,"total_ms",dataset,phase_sum_ms,dna_hash_payload\n1,2.5,"v, w",oops,1e5\n',
        "e.csv": "", "f.csv": "dataset,rll\n", "g.csv": "dataset,endv,rll\r\nu,4,3\r\n", "h.csv": "rll,rll,dataset\n5,6,t\n",
    }.items():
        (tmp_path / name).write_text(text)
    rows = {r["dataset"]: tuple(r)[1:] for r in files.read_metrics(spark, str(tmp_path), schema, {"phase_sum_ms": F.col("rll") * 2}).collect()}
    assert rows == {
        "x": (1, 2, 2.0, None, None), "y": (10, 20, 20.0, None, None), "z": (None, 7, None, None, None), "v, w": (None, None, None, 2.5, "1e5"), "u": (3, 4, 6.0, None, None), "t": (5, None, 10.0, None, None),
    }
    assert files.read_metrics(spark, str(tmp_path / "b.csv"), schema).select("rll", "endv").first() == (10, 20)
    assert files.read_metrics(spark, str(tmp_path / "[e]*.csv"), schema).count() == 0
    many = spark.createDataFrame([("d", 1, 5, "b"), ("d", 2, 1, "a"), ("d", 2, 1, "c"), ("e", None, None, None)], "dataset string, runs int, n int, h string")
    assert {tuple(r) for r in files.latest(many, "dataset", "runs").collect()} == {("d", 2, 1, "c"), ("e", None, None, None)}


def test_missing_columns_get_defaults(spark):
    from pyspark.sql import functions as F

    from helixframe.operators import compare

    df = spark.createDataFrame([("a", 1.0)], "dataset string, total_ms double")
    assert compare.with_defaults(df, {"phase_sum_ms": F.col("total_ms"), "total_ms": F.lit(0)}).first()["phase_sum_ms"] == 1.0
    assert compare.lenient(spark.createDataFrame([("x",), ("2.5",)], "v string"), ["v"]).collect()[1]["v"] == 2.5


def test_functions_in_sql(spark):
    from helixframe.functions.register import registerFunctions

    assert len(registerFunctions(spark)) == len(set(registerFunctions(spark))) == 11
    row = spark.sql("""SELECT dna_bits(X'A5') b, dna_address(262145) a, dna_strand(0, 'GAT') s, dna_gc('GATC') g, dna_end_gc('CCAAAAA') e, dna_count('aaaaa', 'aa') n, dna_count('a', '') z,
    size(dna_blocks(repeat('A', 121))) k, dna_fingerprint('GATC') h, dna_repeats('01100110') r, dna_checks('GGGA') c, dna_encode(X'FF', array('1111'), array('GAG')) d""").first()
    assert tuple(row)[:9] == ("10100101", "AAAAAAAAC", "ACGTTGCATGTCAGTACGTA" + "A" * 9 + "GAT".ljust(120, "A") + "TACGACTGACATGCAACGTT", 2, 0, 2, 0, 2, "01e4f8bfa83ca06e")
    assert (tuple(row["r"]), tuple(row["c"]), row["d"]) == ((4, 4), (3, 3, 3), ["GAGGAG"])


def test_fingerprints_in_parts(spark, monkeypatch):
    """Payloads of one chunk and of many, by tables that are joined over several rounds, against whole texts."""
    rng = random.Random(11)
    payloads = [*VECTORS, *[rng.randbytes(n) for n in (124, 125, 126, 1000, 3000)], b"abcabc" * 400]
    monkeypatch.setattr(encode, "CHUNK_SEGMENTS", 2)
    monkeypatch.setattr(encode, "CHUNK_BYTES", 125)
    monkeypatch.setattr(encode, "PART_BLOCKS", 3)
    monkeypatch.setattr(encode, "PARTS", 3)
    with encode.encode(frame(spark, [*payloads, b"", None]), ["k"], "payload") as done:
        got = {r["k"]: (r["dna_hash_payload"], r["dna_hash_storage"]) for r in done.fingerprints.collect()}
        whole = {r["k"]: (r["dna_hash_payload"], r["dna_hash_storage"]) for r in encode.fingerprints(done.payload, ["k"]).collect()}
    assert got == whole and [got[k] for k in range(len(VECTORS))] == list(VECTORS.values())


def test_fold_tables():
    from helixframe.constants import FNV_PRIME, FNV_SEED
    from helixframe.functions import folds

    def fold(raw, h=FNV_SEED):
        for b in raw:
            h = (h ^ b) * FNV_PRIME & (1 << 64) - 1
        return f"{h:016x}"

    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 17, 100, 700, 5003):
        for letters in (b"ACGT", bytes(range(256)), b"ACGTN"):
            raw = bytes(rng.choices(letters, k=n))
            assert folds.finished(folds.table_of(raw), n) == fold(raw)
            a, b = sorted(rng.choices(range(n + 1), k=2))
            one, two, three = (folds.table_of(x) for x in (raw[:a], raw[a:b], raw[b:]))
            left = folds.joined(folds.joined(one, a, two, b - a), b, three, n - b)
            right = folds.joined(one, a, folds.joined(two, b - a, three, n - b), n - a)
            assert (left == right).all() and folds.finished(left, n) == fold(raw)


def test_files_by_ranges(spark, tmp_path, monkeypatch):
    """Files read in ranges of chunks and whole files give the same frames; folders, globs, empty files, one file by its path."""
    from pyspark.sql import functions as F

    from helixframe.sources import files, ranges

    rng = random.Random(5)
    folder = tmp_path / "in"
    folder.mkdir()
    contents = {"a-b.txt": b"hello hello hello " * 60, "c.pdf": rng.randbytes(999), "d.jpg": bytes(125), "e.txt": b"", "no.csv": b"xxx", "f g.txt": b"z"}
    for name, raw in contents.items():
        (folder / name).write_bytes(raw)
    monkeypatch.setattr(encode, "CHUNK_SEGMENTS", 2)
    monkeypatch.setattr(encode, "CHUNK_BYTES", 125)
    monkeypatch.setattr(ranges, "RANGE_CHUNKS", 3)
    read = ranges.file_chunks(spark, str(folder), chunk_bytes=125, range_chunks=3)
    ranged = [-(-len(x) // (3 * 125)) for n, x in contents.items() if not n.endswith("csv")]
    assert read.rdd.getNumPartitions() == sum(ranged) > 5
    rows = read.collect()
    for name, raw in contents.items():
        own = sorted((r["chunk"], r["chunks"], bytes(r["bytes"])) for r in rows if r["file_name"] == name)
        assert b"".join(x for *_, x in own) == (b"" if name.endswith("csv") else raw)
        assert [(k, n) for k, n, _ in own] == [(k, len(own)) for k in range(len(own))]
    with encode.encode_files(spark, str(folder)) as done, encode.encode(files.payload_files(spark, str(folder)), ["file_name"], "payload") as whole:
        columns = ["file_name", "n_bytes", "segments", "nt", "storage_seq_count", "rll_max", "avg_best_lsbm_len", F.round("gc_mean", 9)]
        assert sorted(map(tuple, done.metrics.select(columns).collect())) == sorted(map(tuple, whole.metrics.select(columns).collect()))
        assert sorted(map(tuple, done.fingerprints.select("file_name", "dna_hash_payload", "dna_hash_storage").collect())) == sorted(map(tuple, whole.fingerprints.collect()))
        assert {r["dataset"] for r in done.metrics.collect()} == {"a_b.txt", "c.pdf", "d.jpg", "f g.txt"}
    one = ranges.file_chunks(spark, str(folder / "no.csv"), chunk_bytes=2)
    assert [bytes(r["bytes"]) for r in one.orderBy("chunk").collect()] == [b"xx", b"x"]
    assert ranges.file_chunks(spark, str(folder), "*.none").count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        ranges.file_chunks(spark, str(tmp_path / "gone")).count()
