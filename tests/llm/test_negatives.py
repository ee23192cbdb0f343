"""Hard negatives against brute force, and packed products against Python's own numbers."""

import math
import random

import numpy as np
import pytest

from helixframe.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, v string"
WIDE = SCHEMA.replace("float", "double")


def scaled(x):
    y = 256 * x
    return math.floor(y) if abs(y) < 2**52 else int(y)


def brute(rows, every, positives=5, count=3, low=(50, 100), high=(95, 100)):
    limit = 2**63 - 1
    given = [(i, lab, [scaled(x) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v)]
    anchors: dict = {}
    for i, lab, v in given:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for i, (lab, v) in anchors.items():
        score = [(min(max(sum(a * b for a, b in zip(v, w, strict=True)), -limit), limit), j, other) for j, other, w in given if j != i and len(w) == len(v)]
        best = sorted((-s, j) for s, j, other in score if other == lab)[:positives]
        for p, j in best:
            p = -p
            fit = sorted((-s, k) for s, k, other in score if other != lab and low[0] * p <= low[1] * s and high[1] * s <= high[0] * p)[:count]
            out += [(i, j, n + 1, k, p, -s) for n, (s, k) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, v, lab, 1, "z") for i, v, lab in rows], schema).repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    centre = [[rng.gauss(0, 0.3) for _ in range(8)] for _ in range(4)]
    point = lambda: [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(centre)]
    out = [(k, point(), rng.randint(0, 3)) for k in range(160)]
    out += [(k, [0.5, -0.25] * 4, rng.randint(0, 2)) for k in range(160, 190)]  # ties
    out += [(200, None, 1), (201, [None] * 8, 1), (202, point(), None), (None, point(), 1), (204, [math.nan] * 8, 1), (205, [math.inf] + [0.0] * 7, 2), (210, [], 1), (211, [], 2), (212, [], 1)]
    return out + [(220, [1.0, 2.0], 1), (221, [1.0, 2.0], 1), (222, [1.0, 1.5], 2), (223, [-1.0, -1.0], 1), (224, [0.0] * 8, 9)]


@pytest.mark.parametrize(("shard", "block"), [(8192, 32 << 20), (16, 600)])
def test_against_brute_force(spark, rows, shard, block, monkeypatch):
    monkeypatch.setattr(negatives, "TOGETHER", 256 if shard > 16 else 3)
    assert got(negatives.mine(frame(spark, rows), 10, shard_rows=shard, block_bytes=block)) == brute(rows, 10)
    assert got(negatives.mine(frame(spark, rows), 10, 2, 4, (0, 1), (3, 2), shard_rows=shard)) == brute(rows, 10, 2, 4, (0, 1), (3, 2))


def test_repeated_ids_and_rows(spark, rows):
    """A repeated vec_id is one anchor; its rows are candidates of others, each."""
    again = [*rows[:60], *rows[:30], *[(i, v, 3) for i, v, _ in rows[20:40]]]
    found = negatives.mine(frame(spark, again), 10)
    want = brute(again, 10)
    key = lambda r: (r[0], r[1], r[2], r[4])
    assert sorted(map(key, got(found))) == sorted(map(key, want)) and sorted(r[5] for r in got(found)) == sorted(r[5] for r in want)


def test_large_components(spark):
    rng = random.Random(8)
    for size in (1e3, 1e6, 1e12, 1e200):
        rows = [(k, [rng.choice([-1, 1, 1]) * rng.random() * size for _ in range(5)], k % 3) for k in range(40)]
        assert got(negatives.mine(frame(spark, rows, WIDE), 4, 3, 3, (0, 1), (1, 1), shard_rows=9)) == brute(rows, 4, 3, 3, (0, 1), (1, 1))


def test_the_query_on_a_small_table(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = queries.queries()["op13_negatives"](spark, str(tmp_path))
    assert df.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    changed = [(i, v, (lab + 1) % 10 if i is not None and lab is not None and i % 7 == 0 else lab) for i, v, lab in rows]
    assert got(df) == brute(changed, 50)


def test_no_rows(spark, rows):
    for given in ([], [(1, None, 1)], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 2)]):
        assert got(negatives.mine(frame(spark, given), 10)) == []


def test_packed_fields_are_exact():
    rng = np.random.default_rng(3)
    for size, dim, n in ((3, 4, 7), (256, 64, 9), (1 << 12, 64, 5), (1 << 24, 8, 5), (1 << 40, 4, 40), (1, 1, 1)):
        rows, anchors = rng.integers(-size, size + 1, (n, dim)).astype(float), rng.integers(-size, size + 1, (6, dim)).astype(float)
        packed = negatives.Packed(rows, int(anchors.min()), int(anchors.max()))
        want = [[min(max(sum(int(a) * int(b) for a, b in zip(x, y, strict=True)), 1 - (1 << 63)), (1 << 63) - 1) for y in rows] for x in anchors]
        assert packed.scores(anchors).tolist() == want
        assert packed.fields > 1 or packed.width > 26
    assert negatives.Packed(np.zeros((0, 3)), -1, 1).scores(np.ones((2, 3))).shape == (2, 0)
    far = np.array([[1e15, 1e15 + 1], [1e15 - 1, 1e15]])
    assert negatives.Packed(far, int(far.min()), int(far.max())).scores(far).tolist() == [[(1 << 63) - 1] * 2] * 2
    packed = negatives.Packed(np.full((5, 3), 7.0), 2, 2)
    assert packed.scores(np.full((1, 3), 2.0)).tolist() == [[42] * 5]
