"""Hard negatives by the hyperplane tree, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score string"


def brute(rows, positives=5, negatives=5, low=80, high=100):
    """anchor, positive, rank, negative, both scores, each row standing for itself."""
    usable = [(i, v, c) for i, v, c, *_ in rows if i is not None and c is not None and v is not None
              and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(256 * float(np.float32(x))) for x in v] for _, v, _ in usable]
    out = []
    for a, (anchor, _, label) in enumerate(usable):
        if anchor % 10:
            continue
        scores = [sum(x * y for x, y in zip(whole[a], w)) for w in whole]
        order = sorted((k for k in range(len(usable)) if k != a), key=lambda k: (-scores[k], usable[k][0], k))
        for p in [k for k in order if usable[k][2] == label][:positives]:
            fit = [k for k in order if usable[k][2] != label and low * scores[p] <= 100 * scores[k] <= high * scores[p]][:negatives]
            out += [(anchor, usable[p][0], r, usable[k][0], scores[p], scores[k]) for r, k in enumerate(fit, 1)]
    return sorted(out)


def clustered(n, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 12))
    x = centres[rng.integers(0, 6, n)] + 0.2 * rng.normal(size=(n, 12))
    x /= np.sqrt((x * x).sum(1))[:, None]
    return [(i, [float(c) for c in v], int(rng.integers(0, labels)), "mine", "mine") for i, v in enumerate(x)]


def odd():
    nan, inf = float("nan"), float("inf")
    return [
        (None, [1.0] * 12, 1, None, None), (1000, None, 1, None, None), (1010, [1.0] * 12, None, None, None), (1020, [None] * 12, 1, None, None),
        (1030, [nan] * 12, 1, None, None), (1040, [-inf] * 12, 1, None, None), (1050, [0.0] * 12, 1, None, None), (1060, [0.5, 0.5], 2, None, None),
        (1070, [], 1, None, None), (1080, [3.0] * 14, 1, None, None), (1090, [-1.0] * 12, 0, None, None),
    ]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("LEAF_ROWS", 30), ("BLOCK", 16), ("ANCHOR_BLOCK", 8), ("BLOCKS_PER_KEY", 2), ("FAN", 4), ("HELD_ROWS", 50)):
        monkeypatch.setattr(hardneg, name, value)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hardneg.mine(df, F.col("vec_id") % 10 == 0, **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def test_equals_brute_force(spark, small):
    # odd rows, repeated rows, and a hot vector with the labels mixed, so that scores tie
    hot = [(2000 + i, [0.25] * 12, i % 2, None, None) for i in range(150)]
    rows = clustered(300, 1) + odd() + hot + clustered(40, 1)
    assert mined(spark, rows) == brute(rows)


def test_other_windows_and_counts(spark, small):
    rows = clustered(200, 2, labels=2)
    assert mined(spark, rows, positives=2, negatives=7, low=50, high=110) == brute(rows, 2, 7, 50, 110)


def test_whole_numbers_beyond_doubles(spark, small):
    rows = [(i, [1e5 * (i + 1), -3e4 * i, 2.0**20], i % 2, None, None) for i in range(40)]
    assert mined(spark, rows) == brute(rows)


def test_few_or_no_rows(spark):
    assert mined(spark, []) == []
    alone = [(0, [1.0, 0.0], 1, None, None)]
    assert mined(spark, alone) == []
    pair = [*alone, (1, [0.9, 0.0], 1, None, None), (2, [0.8, 0.0], 2, None, None), (3, [0.1, 0.0], 2, None, None)]
    assert mined(spark, pair) == brute(pair) and len(brute(pair)) == 1


def test_ranges_leave_out_subtrees_and_never_a_row_of_a_window():
    x = np.floor(256 * np.array([r[1] for r in clustered(4000, 3)]))
    tree = hardneg.Tree(float(((np.abs(x) + 1) ** 2).sum(1).max()), x[::5], 40, 4)
    leaves = tree.leaves(x)
    shape = (len(tree.nodes), 4, 4)
    tree.low, tree.high = np.full(shape, np.inf), np.full(shape, -np.inf)
    for leaf in np.unique(leaves):
        for node, child, low, high in tree.ranges(leaf, x[leaves == leaf]):
            n = len(low)
            tree.low[node, :n, child] = np.minimum(tree.low[node, :n, child], low)
            tree.high[node, :n, child] = np.maximum(tree.high[node, :n, child], high)
    asks = x[:50]
    scores = (asks @ x.T).astype(np.int64)
    highs = np.sort(scores, 1)[:, -5:]
    lows = highs * 8 // 10
    reached = dict(tree.reached(asks, lows, highs))
    for a in range(50):
        needed = {int(leaves[k]) for w in range(5) for k in np.flatnonzero((scores[a] >= lows[a, w]) & (scores[a] <= highs[a, w]))}
        assert needed <= {leaf for leaf, who in reached.items() if a in who}
    assert sum(map(len, reached.values())) < 0.6 * 50 * len(tree.paths)
