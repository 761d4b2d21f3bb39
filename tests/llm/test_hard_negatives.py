"""Hard negatives against a plain version, on odd rows, and what the zone maps leave out."""

import glob
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowcensus.llm.hard_negatives import LIMIT, bounds, hard_negatives, products
from rowcensus.llm.hilbert import fit_curve, hilbert_keys
from rowcensus.sources.staging import Stage

SCHEMA = "vec_id long, label int, embedding array<float>, id long, rank int, block long, score long, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], SCHEMA).repartition(3)


def plain(rows, every=100, positives=5, negatives=10):
    """All products of an anchor, sorted."""
    first = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [float(np.float32(x)) for x in v]
        if i not in first or (str(label), v) < first[i]:
            first[i] = (str(label), v)
    good = [(i, label, [math.floor(256 * x) for x in v]) for i, (label, v) in first.items()]
    out = []
    for i, label, v in good:
        if i % every:
            continue
        rest = [(-max(-LIMIT, min(LIMIT, sum(a * b for a, b in zip(v, u)))), j, other) for j, other, u in good if j != i and len(u) == len(v)]
        rest.sort()
        for ps, j, _ in [r for r in rest if r[2] == label][:positives]:
            ps = -ps
            fits = [r for r in rest if r[2] != label and 30 * ps <= -100 * r[0] <= 90 * ps][:negatives]
            out += [(i, j, k, n, ps, -s) for k, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows, every=100, **more):
    return sorted(tuple(r) for r in hard_negatives(frame(spark, rows), F.expr(f"vec_id % {every} = 0"), **more).collect())


def clustered(seed, n, width=8, groups=6, spread=0.1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, width))
    own = r.integers(0, groups, n)
    return own, centres[own] + spread * r.standard_normal((n, width))


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(keys)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_a_curve_of_few_or_equal_vectors():
    for sample in (np.zeros((1, 3)), np.ones((5, 1)), np.full((3, 2), 1e30)):
        keys = fit_curve(sample, 8, 7).keys(sample)
        assert len(set(keys.tolist())) == 1


def test_bounds_hold_the_products():
    r = np.random.default_rng(2)
    for scale in (10, 30_000, 1e12, 1e30):
        a, b = (np.floor(scale * r.standard_normal((9, 5))) for _ in range(2))
        lower, upper = bounds(a, b.min(axis=0)[None], b.max(axis=0)[None])
        scores = products(a, b)
        assert (lower <= scores).all() and (scores <= upper).all()
        whole = [[max(-LIMIT, min(LIMIT, sum(int(x) * int(y) for x, y in zip(u, v)))) for v in b] for u in a]
        assert scores.tolist() == whole


@pytest.mark.parametrize("sizes", [dict(block=7, set_size=2, page=3), dict(block=64, set_size=256, page=64)])
def test_clusters_with_ties(spark, sizes):
    own, x = clustered(4, 260)
    rows = [(i, int((own[i] + (i % 7 == 0)) % 3), x[i].tolist()) for i in range(len(x))]
    # Copies of one vector in all labels, many of one, and vectors the wrong way round.
    rows += [(1000 + i, i % 3, x[0].tolist()) for i in range(40)] + [(2000 + i, 1, x[1].tolist()) for i in range(60)]
    rows += [(-100 * i, i % 3, (-x[i]).tolist()) for i in range(1, 9)] + [(-1, 0, [0.0] * 8), (-200, 1, [0.0] * 8)]
    got = found(spark, rows, every=20, **sizes)
    assert got == plain(rows, 20) and len(got) > 300


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [1.0, 0.5]), (1, 1, [0.9, 0.4]), (2, 2, [0.5, 0.2]), (3, 2, [0.4, 0.4]), (4, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]),
        (5, 2, None), (6, 2, [None, 1.0]), (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [1.0]), (10, 1, [2.0]), (11, 1, []),
        (100, 1, []), (12, 2, []), (200, 3, [1.0, 1.0]), (300, 2, [3.0]), (2, 2, [0.5, 0.2]), (2, 1, [0.7, 0.2]), (0, 1, [1.0, 0.5]),
        (400, 5, [1e20, -1e20]), (401, 5, [1e20, 1e19]), (402, 6, [1e-3, 1e19]), (403, 6, [1.0, 0.0]), (500, 7, [-0.5, 0.25]), (501, 7, [0.5, 0.25]),
    ]
    got = found(spark, rows, block=2, set_size=1, page=1)
    assert got == plain(rows) and {g[0] for g in got} >= {0, 100}


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, 1, [1.0])]) == []
    assert found(spark, [(0, 1, [1.0])]) == []


def test_fewer_than_asked(spark):
    own, x = clustered(5, 40)
    rows = [(i, int(own[i]) % 2, x[i].tolist()) for i in range(40)]
    assert found(spark, rows, every=10, positives=2, negatives=3, block=4) == plain(rows, 10, 2, 3)


def test_windows_leave_most_blocks_unread(spark, tmp_path):
    """In clustered data, the zone maps leave few blocks to an anchor's windows."""
    own, x = clustered(6, 4000, width=16, groups=40, spread=0.02)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, int((own[i] + (i % 7 == 0)) % 10), x[i].tolist()) for i in range(len(x))]
    stage = Stage(spark, str(tmp_path))
    got = sorted(tuple(r) for r in hard_negatives(frame(spark, rows), F.expr("vec_id % 100 = 0"), block=32, set_size=1, stage=stage).collect())
    assert got == plain(rows)
    blocks = spark.read.parquet(*glob.glob(f"{stage.folder}/*-block")).count()
    chosen = [spark.read.parquet(p).count() for p in sorted(glob.glob(f"{stage.folder}/*-chosen"))]
    anchors = 40
    # For the positives, and then for all windows of the negatives.
    assert chosen[0] <= 0.05 * anchors * blocks and chosen[1] <= 0.5 * anchors * blocks
