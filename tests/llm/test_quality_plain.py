"""The classifier's fit against the same cyclic boosting written as plain loops over rows, bins and cuts."""

import math

import numpy as np
import pytest

from palisade.llm import quality


def _gain(g, h):
    return g * g / (h + quality.RIDGE)


def _sums(rows, at, slopes, n):
    out = [[0.0, 0.0] for _ in range(n)]
    for r in rows:
        out[at[r]][0] += slopes[r][0]
        out[at[r]][1] += slopes[r][1]
    return out


def _total(parts):
    return sum(p[0] for p in parts), sum(p[1] for p in parts)


def _tree(parts):
    leaves = [(0, len(parts))]
    for _ in range(2):
        best, chosen = 1e-9, None
        for leaf in leaves:
            for cut in range(leaf[0] + 1, leaf[1]):
                gain = _gain(*_total(parts[leaf[0]:cut])) + _gain(*_total(parts[cut:leaf[1]])) - _gain(*_total(parts[leaf[0]:leaf[1]]))
                if gain > best:
                    best, chosen = gain, (leaf, cut)
        if chosen is None:
            break
        leaf, cut = chosen
        leaves = [k for k in leaves if k != leaf] + [(leaf[0], cut), (cut, leaf[1])]
        leaves.sort()
    values = [0.0] * len(parts)
    for lo, hi in leaves:
        g, h = _total(parts[lo:hi])
        values[lo:hi] = [g / (h + quality.RIDGE)] * (hi - lo)
    return values


def _quadrants(parts, a, b):
    def leaf(rows, cols):
        return _total([parts[r * b + c] for r in rows for c in cols])

    best = None
    for i in range(1, a):
        for j in range(1, b):
            leaves = [(r, c) for r in (range(i), range(i, a)) for c in (range(j), range(j, b))]
            gain = sum(_gain(*leaf(*q)) for q in leaves)
            if best is None or gain > best[0]:
                best = gain, leaves
    values = [0.0] * (a * b)
    for rows, cols in best[1]:
        g, h = leaf(rows, cols)
        for r in rows:
            for c in cols:
                values[r * b + c] = g / (h + quality.RIDGE)
    return best[0] - _gain(*_total(parts)), values


def plain_scores(x, y, new):
    n, wide = len(x), len(x[0])
    bias = math.log((sum(y) + 1) / (n - sum(y) + 1))

    def edges(f, bins):
        return sorted(set(np.quantile([r[f] for r in x], [k / bins for k in range(1, bins)]).tolist()))

    fine, coarse = ([edges(f, b) for f in range(wide)] for b in (quality.BINS, quality.PAIR_BINS))

    def place(cuts, value):
        return sum(c <= value for c in cuts)

    tables = [[0.0] * (len(e) + 1) for e in fine]
    pair_tables = {}

    def logit(row):
        out = bias + sum(tables[f][place(fine[f], row[f])] for f in range(wide))
        for (f, k), table in pair_tables.items():
            out += table[place(coarse[f], row[f]) * (len(coarse[k]) + 1) + place(coarse[k], row[k])]
        return out

    def slopes():
        chances = [1 / (1 + math.exp(-logit(r))) for r in x]
        return [(t - p, p * (1 - p)) for t, p in zip(y, chances)]

    for _ in range(quality.ROUNDS):
        for f in range(wide):
            at = [place(fine[f], r[f]) for r in x]
            for b, v in enumerate(_tree(_sums(range(n), at, slopes(), len(tables[f])))):
                tables[f][b] += quality.RATE * v

    def grid(f, k):
        a, b = len(coarse[f]) + 1, len(coarse[k]) + 1
        at = [place(coarse[f], r[f]) * b + place(coarse[k], r[k]) for r in x]
        return _quadrants(_sums(range(n), at, slopes(), a * b), a, b)

    ranked = sorted((-grid(f, k)[0], f, k) for f in range(wide) for k in range(f + 1, wide))
    for _, f, k in ranked[:quality.PAIRS]:
        pair_tables[f, k] = [0.0] * ((len(coarse[f]) + 1) * (len(coarse[k]) + 1))
    for _ in range(quality.ROUNDS // 2):
        for pair, table in pair_tables.items():
            for b, v in enumerate(grid(*pair)[1]):
                table[b] += quality.RATE * v
    return [1 / (1 + math.exp(-logit(r))) for r in new]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_equals_plain_loops(monkeypatch, seed):
    for name, value in {"BINS": 7, "PAIR_BINS": 3, "PAIRS": 2, "ROUNDS": 6}.items():
        monkeypatch.setattr(quality, name, value)
    rng = np.random.default_rng(seed)
    x, new = rng.normal(size=(80, 4)), rng.normal(size=(50, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=80) * 0.3) > 0).astype(float)
    got = quality.fit_arrays(x, y).scores(new)
    assert np.allclose(got, plain_scores(x.tolist(), y.tolist(), new.tolist()), rtol=0, atol=1e-9)
    assert got.max() - got.min() > 0.2
