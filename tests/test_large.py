"""Steps that are made for large tables, held against the plain ways."""

import random

import numpy as np
import pyarrow as pa

from helixframe.functions import dna, kernels, slices
from helixframe.operators import codebook, segments
from helixframe.plans import encode, runs
from tests import model


def texts(rng, n):
    """Bit strings of one segment, random, lopsided and repetitive ones."""
    out = []
    for k in range(n):
        p = rng.random()
        s = "".join("1" if rng.random() < p else "0" for _ in range(500))
        out.append((s[: rng.randint(1, 200)] * 500)[:500] if k % 2 else s)
    return out


def test_repeats_side_by_side():
    own = texts(random.Random(1), 120) + ["0" * 500, "01" * 250]
    rows = np.array([[int(x) for x in s] for s in own], np.uint8)
    lp, ls = kernels.repeats_side_by_side(rows)
    assert lp == [model.longest(s, True) for s in own] and ls == [model.longest(s, False) for s in own]


def test_counts_by_sliding_bytes():
    rng = random.Random(2)
    for raw in [rng.randbytes(63), b"abababab" * 7, bytes(62)]:
        s, slid = kernels.bits_of(raw)[1], kernels.sliding(raw)[: 8 * len(raw) - 7]
        for size in (3, 7, 8, 9, 20, 64, 200):
            for at in (0, 5, len(s) - size):
                assert kernels.count_of(s, slid, at, size) == s.count(s[at : at + size])


def test_books_in_place_equal_books_of_groups():
    rng = random.Random(3)
    for n in (0, 1, 2, 40, 600):
        rows = list({"".join(rng.choices("01", k=rng.randint(3, rng.choice([5, 12, 60])))): rng.randint(1, 5) for _ in range(n)}.items())
        keys, codes = next(iter(codebook.own_books(pa.array([[{"substr": s, "hits": f} for s, f in rows]], pa.list_(pa.struct([("substr", pa.string()), ("hits", pa.int64())]))))))
        ordered = sorted(rows, key=lambda r: (-len(r[0]), -r[1], r[0]))
        top = ordered[:512]
        deep = [r for r in top if len(top) > 1 and len(r[0]) >= 2 * (len(top) - 1).bit_length() + 1]
        assert dict(zip(keys, codes, strict=True)) == model.codes(top if len(top) < 2 else deep or ordered)


def test_folds_of_any_length():
    rng = random.Random(4)
    for n in (0, 1, 499, 500, 501, 32768, 32769, 70001):
        for raw in (rng.randbytes(n), bytes(rng.choices(b"ACGT", k=n)), bytes(rng.choices(b"ACGT", k=n)) + b"N"):
            h = dna.FNV_SEED
            for b in raw:
                h = (h ^ b) * dna.FNV_PRIME & (1 << 64) - 1
            assert dna.fold(np.frombuffer(raw, np.uint8)) == h
    assert dna.strands_of(b"GAT").tobytes().decode() == "ACGTTGCATGTCAGTACGTA" + "A" * 9 + "GAT".ljust(120, "A") + "TACGACTGACATGCAACGTT"


def test_slices_are_small(monkeypatch):
    """A kernel never sees more than a slice, whatever the batch; no row is lost."""
    monkeypatch.setattr(slices, "SLICE_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array([b"x" * n if n is not None else None for n in (60, 50, None, 0, 300, 40, 40)], pa.binary())], ["b"])
    assert [x.num_rows for x in slices.slices(batch, "b")] == [1, 3, 1, 2]


def test_packs_of_a_group(spark, monkeypatch):
    """Corpus scope: many payloads of one group meet its table in packs, broadcast or not; long payloads in packs of chunks."""
    rng = random.Random(5)
    rows = [(k, bytearray(rng.choice([b"abc", b"xyz ", b"0101"]) * rng.randint(1, 90)), rng.choice(["a", "b", None])) for k in range(30)]
    docs = spark.createDataFrame(rows, "k long, payload binary, source string").repartition(2)
    books = {s: model.codes(model.table([g for _, x, t in rows if t == s for g in model.segments(bytes(x))])) for s in ("a", "b", None)}
    want = {k: model.encode(model.segments(bytes(x)), books[s]) for k, x, s in rows}
    monkeypatch.setattr(encode, "CHUNK_SEGMENTS", 2)
    monkeypatch.setattr(encode, "CHUNK_BYTES", 125)
    monkeypatch.setattr(encode, "PACK_CHUNKS", 2)
    for few in (64, 0):
        monkeypatch.setattr(encode, "FEW_BOOKS", few)
        with encode.encode(docs, ["k"], "payload", scope="corpus", by=["source"]) as done:
            packs = done._encoded(False)
            assert packs.count() == sum(len(x) <= 125 for _, x, _ in rows)
            assert {r["k"]: r["dna"] for r in done.payload.collect()} == want


def test_files_in_folders(spark, tmp_path):
    from helixframe.sources import files

    rows = [(f"{k}_{k}.txt", bytearray(b"x" * k)) for k in range(40)] + [("no.csv", bytearray(b"y"))]
    files.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(3), str(tmp_path / "f"))
    found = files.payload_files_below(spark, str(tmp_path / "f")).collect()
    assert sorted((r["file_name"], r["file_size_bytes"], bytes(r["payload"])) for r in found) == sorted((n, len(x), bytes(x)) for n, x in rows if x and n.endswith("txt"))


def test_bits_and_profiles(spark):
    rng = random.Random(6)
    raws = [rng.randbytes(200), b"ab" * 90, b"a", b"", None]
    frame = spark.createDataFrame([(k, None if x is None else bytearray(x)) for k, x in enumerate(raws)], "k long, payload binary")
    assert {r["k"]: r["bits"] for r in segments.spelled(frame, "payload").collect()} == {k: None if x is None else "".join(f"{b:08b}" for b in x) for k, x in enumerate(raws)}
    plain = segments.profile(segments.repeats(segments.segments(frame, ["k"]))).drop("s")
    own = segments.chunk_profile(encode.chunked(frame, ["k"]), ["k"], encode.CHUNK_SEGMENTS)
    assert sorted(map(tuple, own.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    pairs = segments.candidates(segments.repeats(segments.segments(frame, ["k"])), ["k"])
    assert sorted(map(tuple, segments.chunk_candidates(encode.chunked(frame, ["k"]), ["k"]).collect())) == sorted(map(tuple, pairs.collect()))
    assert sorted(map(tuple, segments.frequencies(segments.chunk_pairs(encode.chunked(frame, ["k"])), []).collect())) == sorted(map(tuple, segments.frequencies(pairs, []).collect()))


def test_longest_keys_side_by_side():
    """Keys cut from the texts, nested, longer than a word, and codes of one letter less: all chunks at once as one by one."""
    rng = random.Random(7)
    raws, books, want = [], [], []
    for _ in range(120):
        raw = bytes(rng.choices(rng.choice([b"ab c", b"\0", b"\0\xff", b"aaaaab"]), k=rng.randint(1, 300)))
        text, book = "".join(f"{b:08b}" for b in raw), {}
        for _ in range(rng.randint(0, 50)):
            a = rng.randrange(len(text))
            book[text[a : a + rng.randint(1, rng.choice([8, 64, 130, 250, 400]))]] = "".join(rng.choices("ACGT", k=rng.randint(2, 9)))
        raws.append(raw)
        books.append(kernels.Book(list(book), list(book.values())))
        want.append([model.encode([s], book) for s in model.segments(raw)])
    assert kernels.encoded_rows(raws, books, True).to_pylist() == want
    assert kernels.encoded_rows(raws, books, False).to_pylist() == ["".join(x) for x in want]


def test_occurrences_side_by_side():
    rng = random.Random(8)
    raws = [rng.randbytes(300), b"abababab" * 40, bytes(250), b"The same line, again. " * 20, b"\xff\x00" * 90, b"a"]
    for raw, own in zip(raws, kernels.found_in(raws), strict=True):
        assert [x[0] for x in own] == model.segments(raw)
        for s, lp, ls, first, last in own:
            assert (first, last) == (model.count(s, s[:lp]) if lp else 0, model.count(s, s[len(s) - ls :]) if ls else 0)


def written(monkeypatch):
    """The tables that an encoding writes from now on."""
    own, cut = [], encode.cut
    monkeypatch.setattr(encode, "cut", lambda table: own.append(cut(table)) or own[-1])
    return own


def small(spark, monkeypatch):
    monkeypatch.setattr(encode, "CHUNK_SEGMENTS", 2)
    monkeypatch.setattr(encode, "CHUNK_BYTES", 125)
    rng = random.Random(9)
    rows = [(str(k), "f", bytearray(rng.choices(b"ab c", k=n))) for k, n in enumerate((3, 60, 125, 126, 300, 1000))]
    return spark.createDataFrame(rows, "dataset string, file_name string, payload binary").repartition(2)


def test_segments_of_short_payloads_are_coded_in_one_pass(spark, monkeypatch):
    """chunks of payloads of one chunk are not written first."""
    docs, tables = small(spark, monkeypatch), written(monkeypatch)
    assert encode.encode(docs, ["dataset"], "payload").coded.select("dataset").distinct().count() == 6
    assert all(t.where("chunks = 1").isEmpty() for t in tables if "chunks" in t.columns)


def test_short_payloads_are_coded_in_one_pass(spark, monkeypatch):
    """as above, for whole payloads, and with the chunks written they come out the same."""
    docs, tables = small(spark, monkeypatch), written(monkeypatch)
    rows = sorted(map(tuple, encode.encode(docs, ["dataset"], "payload").payload.collect()))
    assert len(rows) == 6 and all(t.where("chunks = 1").isEmpty() for t in tables if "chunks" in t.columns)
    other = encode.encode(docs, ["dataset"], "payload")
    assert other.marked.where("chunks = 1").count() == 3 and sorted(map(tuple, other.payload.collect())) == rows


def test_metrics_of_short_payloads_keep_nucleotides_in_the_task(spark, monkeypatch):
    """one step in Python from bytes to checks."""
    done = encode.encode(small(spark, monkeypatch), ["dataset"], "payload")
    plan = done._short_metrics(encode.HASHES)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_timed_run_encodes_once(spark, monkeypatch):
    """the rows of a run are those that its last phase made."""
    docs, calls, own = small(spark, monkeypatch), [], codebook.encoded_in_place
    monkeypatch.setattr(codebook, "encoded_in_place", lambda *a, **k: calls.append(1) or own(*a, **k))
    assert runs.encode_run(lambda: encode.encode(docs, ["dataset", "file_name"], "payload"), 1).count() == 6
    assert len(calls) == 1


def test_a_timed_run_writes_no_chunks_of_short_payloads(spark, monkeypatch):
    """F1 of round 4: payloads of one chunk take all phases in one pass, which says how long each was; the others' chunks are written."""
    docs, tables = small(spark, monkeypatch), written(monkeypatch)
    found, spent = encode.encode(docs, ["dataset", "file_name"], "payload").timed()
    assert found.count() == 6 and len(spent) == 3 and all(x > 0 for x in spent)
    assert any("chunks" in t.columns for t in tables) and all(t.where("chunks = 1").isEmpty() for t in tables if "chunks" in t.columns)
    tables.clear()
    short = docs.where("octet_length(payload) <= 125")
    assert encode.encode(short, ["dataset", "file_name"], "payload").timed()[0].count() == short.count() > 0
    assert [t.isEmpty() for t in tables if "chunks" in t.columns] == [True] and len(tables) == 2
    same = encode.encode(docs, ["dataset", "file_name"], "payload").summary
    assert sorted(map(repr, found.collect())) == sorted(map(repr, same.select(found.columns).collect()))


def test_fingerprints_of_many_texts_side_by_side(monkeypatch):
    """F1 of round 4: texts of bases, short ones, long ones that take several turns, and words of four that end anywhere."""
    rng = np.random.default_rng(4)
    text = lambda n: np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, n)]
    texts = [text(n) for n in (*range(140), 255, 256, 257, 5000)] + [np.full(n, b, np.uint8) for n in (3, 64, 200) for b in b"ACGT"]
    assert dna.folded(texts) == [dna.fold(x) for x in texts]
    monkeypatch.setattr(dna, "_PLACES", 128)
    assert dna.folded(texts) == [dna.fold(x) for x in texts] and dna.folded([]) == []
    for other in ("ACGT" * 3, "ACGt", "", "ACG\u00e9"):
        h = [f"{dna.fold(np.frombuffer(x, np.uint8)):016x}" for x in (other.encode(), dna.strands_of(other.encode()).tobytes())]
        assert [x.to_pylist() for x in dna.both_fingerprints(pa.array([other, "GATC"]))] == [[h[0], "01e4f8bfa83ca06e"], [h[1], f"{dna.fold(dna.strands_of(b'GATC')):016x}"]]


def test_sums_of_blocks_are_those_of_their_checks(spark):
    """F1 of round 4: blocks' counts are summed where the payload lies."""
    rng = random.Random(6)
    texts = ["".join(rng.choices("ACGT", w, k=n)) for w in ((1, 1, 1, 1), (9, 1, 1, 1), (1, 9, 9, 1)) for n in (*range(1, 8), 59, 64, 68, 69, 70, 119, 120, 121, 184, 185, 240, 1000)] + ["A" * 300, "G" * 120, "C" * 65]
    found = list(zip(*(x.to_pylist() for x in kernels.block_sums(pa.array(["AAA", *texts]).slice(1))), strict=True))
    for dna_of, got in zip(texts, found, strict=True):
        tiles = [dna_of[a : a + 120] for a in range(0, len(dna_of), 120)]
        gc, rll, end = (x.tolist() for x in kernels.check_columns(tiles))
        assert got[2:] == (max(rll), sum(x > 2 for x in rll), sum(x > 3 for x in end), len(tiles), len(dna_of))
    # To the last bit as Spark has them, as 0.0055625 and what is just below it are rounded apart.
    rows = spark.createDataFrame([(k, i, x[a : a + 120]) for k, x in enumerate(texts) for i, a in enumerate(range(0, len(x), 120))], "k int, i int, block string").coalesce(1).sortWithinPartitions("k", "i")
    sums = encode.block_summary(encode.constraints(rows), ["k"]).orderBy("k").select("gc_mean", "gc_var").collect()
    assert [tuple(r) for r in sums] == [x[:2] for x in found]


def test_pieces_of_long_chunks_and_many_books(monkeypatch):
    """F1 of round 4: chunks that are longer than what is encoded side by side, and more books than are told apart there."""
    rng = random.Random(8)
    raws = [bytes(rng.choices(b"abc ", k=n)) for n in (1, 62, 63, 125, 126, 700, 1250, 3)]
    books = [kernels.Book(*codebook.own_book(list(x.items()))) for x in kernels.chunk_tables(raws)[1]]
    whole, listed = (kernels.encoded_rows(raws, books, x).to_pylist() for x in (False, True))
    monkeypatch.setattr(kernels, "_PIECE", 250)
    monkeypatch.setattr(kernels, "_SIDE_BOOKS", 2)
    assert kernels.encoded_rows(raws, books, False).to_pylist() == whole == ["".join(x) for x in listed]
    assert kernels.encoded_rows(raws, iter(books), True).to_pylist() == listed
