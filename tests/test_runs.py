"""Timed runs, the command line, sinks that commit, and frames that are published together."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from helixframe.operators import compare
from helixframe.plans import encode, runs
from helixframe.sources import files, publish, sink
from tests import model

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    contents = {"a-b.txt": b"hello hello hello " * 60, "c.pdf": rng.randbytes(999), "d.jpg": bytes(125), "e.txt": b""}
    (tmp_path / "in").mkdir()
    for name, raw in contents.items():
        (tmp_path / "in" / name).write_bytes(raw)
    return tmp_path / "in", contents


def test_rows_of_timed_runs(spark, folder, monkeypatch):
    path, contents = folder
    for chunk in (1024, 2):
        monkeypatch.setattr(encode, "CHUNK_SEGMENTS", chunk)
        monkeypatch.setattr(encode, "CHUNK_BYTES", chunk * 500 // 8)
        found = runs.run_files(spark, str(path), 2)
        assert [c for c, _ in found.dtypes] == [x.split()[0] for x in files.SEQUENTIAL.replace("\n", " ").split(", ")]
        rows = {r["file_name"]: r for r in found.collect()}
        assert set(rows) == {n for n, raw in contents.items() if raw}
        for name, r in rows.items():
            raw = contents[name]
            segs = model.segments(raw)
            dna = model.encode(segs, model.codes(model.table(segs)))
            blocks = -(-len(dna) // 120)
            best = [max(model.longest(s, True), model.longest(s, False)) if len(s) > 3 else 0 for s in segs]
            assert (r["dataset"], r["file_size_bytes"], r["runs"], r["segments"], r["seq_count"], r["storage_seq_count"]) == (name.replace("-", "_"), len(raw), 2, len(segs), blocks, blocks)
            assert r["encoding_rate_bits_per_nt"] == pytest.approx(8 * len(raw) / len(dna)) and r["gross_rate_bits_per_nt"] == pytest.approx(8 * len(raw) / (169 * blocks))
            assert r["avg_best_lsbm_len"] == pytest.approx(sum(best) / len(best)) and len(r["dna_hash_payload"]) == len(r["dna_hash_storage"]) == 16
            assert r["total_ms"] == pytest.approx(r["lsbm_ms"] + r["huffman_ms"] + r["encode_ms"]) and r["lsbm_ms"] > 0 and r["std_total_ms"] >= 0
            assert r["peak_ram_mb"] == -1 or r["peak_ram_mb"] > 1
            assert r["cpu_percent"] == -1 or 0 < r["cpu_percent"] <= 110


def test_times_of_runs():
    times = runs.Times()
    times.add([0.0, 1.0, 1.5, 4.0])
    times.add([10.0, 10.5, 11.0, 12.0])
    assert (times.total_ms, times.lsbm_ms, times.huffman_ms, times.encode_ms) == ([4000, 2000], [1000, 500], [500, 500], [2500, 1000])


def run(*args):
    env = os.environ | {"PYTHONPATH": ROOT, "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-m", "helixframe", *map(str, args)], env=env, capture_output=True, text=True, timeout=300)
    return done.returncode, done.stdout, done.stderr


def test_command_line(spark, folder, tmp_path):
    path, contents = folder
    for few in ((), (path,), (path, "tag")):
        code, out, err = run(*few)
        assert code == 1 and not out and err.startswith("Usage: ")
    for bad in (path / "e.txt", path / "gone.txt"):
        code, out, err = run(bad, "tag", tmp_path / "m")
        assert code == 1 and not out and err.strip() == f"Input read failed or empty: {bad}"
    code, out, err = run(path / "a-b.txt", "my_tag", tmp_path / "m", "--runs", "1x")
    assert code == 0 and out.startswith("[DONE] dataset=my_tag file=a-b.txt rate=")
    (row,) = files.read_metrics(spark, str(tmp_path / "m"), files.SEQUENTIAL).collect()
    assert (row["dataset"], row["runs"], row["file_size_bytes"]) == ("my_tag", 1, len(contents["a-b.txt"])) and f"hash={row['dna_hash_payload']}" in out
    (tmp_path / "file").write_text("x")
    code, out, err = run(path / "c.pdf", "t", tmp_path / "file" / "m", "--runs", "0")
    assert code == 1 and "Can't write" in err


def test_runs_argument():
    from helixframe.__main__ import runs_of

    assert [runs_of(x.split()) for x in ("", "--runs 3", "--runs 0", "--runs -4", "--runs x", "--runs", "--runs 2 --runs 7", "-v --runs 4y")] == [5, 3, 1, 1, 1, 5, 7, 4]


def test_appended_rows_are_all_there_or_none(spark, tmp_path):
    path = str(tmp_path / "m")
    schema = "dataset string, runs int, total_ms double, dna_hash_payload string, ok boolean"
    rows = spark.createDataFrame([("a", 1, 0.1, "1e5", True), ("b, c", None, 1e-9, None, False), ('q"x', 3, 12345678.25, "00", None)], schema).repartition(3)
    sink.append_rows(rows, path, "one")
    sink.append_rows(rows.coalesce(1), path, "one")  # again: it takes its own place
    sink.append_rows(rows.limit(1), path)
    back = files.read_metrics(spark, path, schema)
    assert back.where("dataset = 'b, c'").count() in (1, 2) and back.count() == 4
    assert sorted(map(str, rows.collect())) == sorted({str(r) for r in back.collect()})
    bad = rows.withColumn("runs", F.expr("CASE WHEN dataset = 'a' THEN raise_error('lost') ELSE runs END").cast("int"))
    with pytest.raises(Exception, match="lost"):
        sink.append_rows(bad, path, "two")
    assert back.count() == 4 and files.read_metrics(spark, path, schema).count() == 4
    assert not [f for f in os.listdir(path) if f.startswith((".two", "two"))]
    sink.append_rows(rows.limit(0), path, "none")
    assert files.read_metrics(spark, path, schema).count() == 4


def test_a_task_that_fails_once_leaves_one_copy(spark, tmp_path):
    """What a first attempt has written under its own name is gone when the second one's is there."""
    path = str(tmp_path / "m")
    writer = sink.MetricsWriter(path, "b", ["x"])
    from unittest import mock

    with mock.patch.object(sink.TaskContext, "get", return_value=mock.Mock(partitionId=lambda: 0)):
        lost = writer.write(iter([(1,), (2,)]))  # never committed
        kept = writer.write(iter([(1,), (2,)]))
    assert os.path.exists(lost.own) and lost.own != kept.own
    writer.commit([kept, None, sink.Part("", "")])
    assert os.listdir(path) == ["b-00000.csv"] and files.read_metrics(spark, path, "x int").count() == 2


def test_frames_are_published_together(spark, tmp_path):
    folder = str(tmp_path / "out")
    assert publish.published(spark, folder) == {}
    one, two = spark.range(3), spark.createDataFrame([("a", None)], "name string, n int")
    first = publish.publish({"Comparison": one, "Raw Data": two}, folder)
    seen = publish.published(spark, folder)
    assert {k: sorted(map(tuple, d.collect())) for k, d in seen.items()} == {"Comparison": [(0,), (1,), (2,)], "Raw Data": [("a", None)]}
    bad = spark.range(2).select(F.expr("raise_error('lost')").cast("int").alias("x"))
    with pytest.raises(Exception, match="lost"):
        publish.publish({"Comparison": spark.range(9), "Raw Data": bad}, folder)
    assert publish.published(spark, folder)["Comparison"].count() == 3
    publish.publish({"Comparison": spark.range(5)}, folder)
    assert set(publish.published(spark, folder)) == {"Comparison"} and publish.published(spark, folder, first)["Raw Data"].count() == 1
    publish.retire(folder)
    assert len(publish.manifests(folder)) == 1 and publish.published(spark, folder)["Comparison"].count() == 5
    assert len([f for f in os.listdir(folder) if f.startswith("data-")]) == 1
    with pytest.raises(ValueError, match="no frame"):
        publish.publish({}, folder)


def test_comparison_of_two_tables(spark):
    seq = spark.createDataFrame([("a", 2048, 10.0, 2.0, 1.0, 6.0, 1.5, "h"), ("b", 1, 4.0, 1.0, 1.0, 1.0, 1.0, ""), ("c", 1, 1.0, 1.0, 1.0, 1.0, 1.0, "x")], "dataset string, file_size_bytes long, total_ms double, lsbm_ms double, huffman_ms double, encode_ms double, encoding_rate_bits_per_nt double, dna_hash_payload string")
    columns = ", ".join(f"{c} double" for c in compare.PARALLEL_PHASES)
    par = spark.createDataFrame([("a", 2048, 5.0, 1.5, *map(float, range(1, 9))), ("b", 1, 0.0, 1.0, *[0.0] * 8)], f"dataset string, file_size_bytes long, total_ms double, encoding_rate_bits_per_nt double, {columns}")
    got = {r["dataset"]: r for r in compare.compare(seq, par).collect()}
    a, b = got["a"], got["b"]
    assert set(got) == {"a", "b"} and (a["speedup_total"], a["speedup_lsbm"], a["speedup_encode"], a["speedup_compute"], a["size_kb"]) == (2.0, 2 / 3, 6 / 5, 9 / 20, 2.0)
    assert (b["speedup_total"], b["speedup_lsbm"], b["payload_hash_match"]) == (0.0, 0.0, False) and a["phase_sum_ms_cuda"] == 5.0 and a["gross_rate_bits_per_nt_seq"] == 1.5
    assert compare.summary(compare.compare(seq, par.withColumn("dna_hash_payload", F.lit("h")))).first()["matches"] == 1


def test_pivot_and_choices(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 3.0, 4.0), ("y", 5.0, None)], "dataset string, a_ms double, b_ms double")
    keys = spark.createDataFrame([("z",), ("x",), ("y",), ("x",)], "dataset string")
    assert [tuple(r) for r in compare.phase_pivot(df, "dataset", ("a_ms", "b_ms"), keys).collect()] == [("x", 2.0, 3.0), ("y", 5.0, None), ("z", None, None)]
    menus = spark.createDataFrame([(x,) for x in ("1,2,4", " a ", "A,1", "", None, "9, 3 ,x,3,0,-1", "99999999999,2", ",")], "m string")
    got = {}
    for r in compare.choices(menus, "m", 4).collect():
        got.setdefault(r["m"], []).append(r["choice"])
    assert got == {"1,2,4": [1, 2, 4], " a ": [1, 2, 3, 4], "A,1": [1], "": [1], None: [1], "9, 3 ,x,3,0,-1": [3], "99999999999,2": [2]}
    assert sorted(r[0] for r in compare.selected(spark.range(1, 9), "id", menus.where("m = '1,2,4'"), "m", 4).collect()) == [1, 2, 4]
