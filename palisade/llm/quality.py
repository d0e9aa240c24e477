"""Quality classifier: a generalised additive model with pairwise interactions, fitted by cyclic boosting of shallow trees.

Every feature has one lookup table over its bins and a few pairs of features have one over a coarse grid; a score is the sum of
the cells a text falls into. Labels never meet a score's inputs: those are taken from the text's bytes alone.

A null text counts as an empty one and gets the score its bins give. Labels of a document given more than once are averaged; null
labels and null ids are not learned from. Without labels of both kinds every score is the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import BLANK, Hasher, bounded_batches, fresh, text_slices, with_text, words

#: Labelled documents that a fit may use: those with the smallest hashes of their ids.
SAMPLE_ROWS = 50_000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, RATE, RIDGE = 160, 0.15, 4.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "lower_share", "digit_share", "blank_share", "lines_per_word",
    "stops_per_word", "symbols_per_word", "marks_per_word", "bars_per_word", "foreign_share", "other_per_word", "repeats",
    "distinct", "odd_ends", "upper_words", "single_byte_words", "top_word", "entropy", "repeated_lines", "line_bytes",
)

_STOPS, _SYMBOLS, _MARKS = [44, 46], [35, 36, 37, 38, 42, 64, 94, 126], [33, 63]
_OTHER = [b for b in range(33, 127) if not chr(b).isalnum() and b not in [*_STOPS, *_SYMBOLS, *_MARKS, 124]]
_SYMBOL = np.isin(np.arange(256), [*_SYMBOLS, *_MARKS, 124])
_UPPER = np.isin(np.arange(256), np.arange(65, 91))


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _grouped(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many distinct hashes it has, and how often its commonest occurs."""
    distinct, top = np.zeros(n), np.zeros(n)
    if len(rows):
        keys = np.sort((rows.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        runs, own = np.diff(np.append(at, len(keys))), (keys[at] >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(own, minlength=n).astype(float)
        np.maximum.at(top, own, runs)
    return distinct, top


def features(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    """One row of FEATURES for each text of a slice."""
    n = len(offsets) - 1
    sizes = np.diff(offsets).astype(float)
    counts = np.stack([np.bincount(data[offsets[i]:offsets[i + 1]], minlength=256) for i in range(n)]).astype(float)
    starts, ends, rows = words(data, offsets, ~BLANK)
    sums = hasher.prefix(data)
    hashes = hasher.ranges(sums, starts, ends)
    per_row = lambda flags: np.bincount(rows[flags], minlength=n).astype(float)
    n_words = np.bincount(rows, minlength=n).astype(float)
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    distinct, top = _grouped(rows, hashes, n)
    first, last = (data[starts], data[ends - 1]) if len(starts) else (data[:0], data[:0])
    line_starts, line_ends, line_rows = words(data, offsets, np.arange(256) != 10)
    lines = np.bincount(line_rows, minlength=n).astype(float)
    own_lines, _ = _grouped(line_rows, hasher.ranges(sums, line_starts, line_ends), n)
    upper, lower = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1)
    shares = counts / np.maximum(sizes, 1)[:, None]
    entropy = -(shares * np.log2(np.where(shares > 0, shares, 1))).sum(1)
    return np.column_stack([
        np.log1p(sizes), np.log1p(n_words), _share(np.bincount(rows, ends - starts, n), n_words),
        _share(upper, upper + lower), _share(lower, sizes),
        _share(counts[:, 48:58].sum(1), sizes), _share(counts[:, BLANK].sum(1), sizes), _share(counts[:, 10], n_words),
        _share(counts[:, _STOPS].sum(1), n_words), _share(counts[:, _SYMBOLS].sum(1), n_words),
        _share(counts[:, _MARKS].sum(1), n_words), _share(counts[:, 124], n_words), _share(counts[:, 128:].sum(1), sizes),
        _share(counts[:, _OTHER].sum(1), n_words), _share(per_row(same), n_words), _share(distinct, n_words),
        _share(per_row(_SYMBOL[last]), n_words), _share(per_row(_UPPER[first] & _UPPER[last] & (ends - starts > 1)), n_words),
        _share(per_row(ends - starts == 1), n_words), _share(top, n_words), entropy, _share(lines - own_lines, lines),
        np.log1p(_share(sizes, lines)),
    ])


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for (f, g), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[np.searchsorted(self.pair_edges[f], x[:, f], side="right"),
                         np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per bin of a tree of at most three leaves: the best cut, then the best further cut."""
    cuts = [0, len(g)]
    for _ in range(2):
        best, place = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi - lo > 1:
                left_g, left_h = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
                all_g, all_h = g[lo:hi].sum(), h[lo:hi].sum()
                gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
                if gains.max() > best:
                    best, place = gains.max(), lo + 1 + int(gains.argmax())
        if place is None:
            break
        cuts = sorted([*cuts, place])
    out = np.empty(len(g))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + RIDGE)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best pair of cuts of a grid into four leaves: its gain and the values per cell."""
    sg, sh = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for s in (sg, sh):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        parts.append((a, b, c, s[-1, -1] - a - b - c))
    gains = sum(_gain(x, y) for x, y in zip(*parts, strict=True))
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gains.max() - _gain(g.sum(), h.sum())), out


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Model:
    """Cycle over the features, one small step of one tree each; then rank pairs by what they still explain and cycle over those."""
    ones = int(y.sum())
    zeros = len(y) - ones
    wide = x.shape[1]
    edges, coarse = ([_edges(x[:, f], b) for f in range(wide)] for b in (BINS, PAIR_BINS))
    model = Model(float(np.log((ones + 1) / (zeros + 1))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if not ones or not zeros:
        return model
    bins = [np.searchsorted(edges[f], x[:, f], side="right") for f in range(wide)]
    grid = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(wide)]
    logit = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(wide):
            g, h = slopes()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, n), np.bincount(bins[f], h, n))
            model.tables[f] += step
            logit += step[bins[f]]

    def cells(f: int, k: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(coarse[f]) + 1, len(coarse[k]) + 1)
        return grid[f] * shape[1] + grid[k], shape

    g, h = slopes()
    ranked = []
    for f in range(wide):
        for k in range(f + 1, wide):
            at, (a, b) = cells(f, k)
            gain, _ = _quadrants(np.bincount(at, g, a * b).reshape(a, b), np.bincount(at, h, a * b).reshape(a, b))
            ranked.append((-gain, f, k))
    model.pairs = [(f, k) for _, f, k in sorted(ranked)[:PAIRS]]
    model.pair_tables = [np.zeros(cells(*p)[1]) for p in model.pairs]
    for _ in range(ROUNDS // 2):
        for table, pair in zip(model.pair_tables, model.pairs, strict=True):
            g, h = slopes()
            at, (a, b) = cells(*pair)
            _, step = _quadrants(np.bincount(at, g, a * b).reshape(a, b), np.bincount(at, h, a * b).reshape(a, b))
            table += RATE * step
            logit += RATE * step.ravel()[at]
    return model


def with_features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    bounded_batches(docs.sparkSession)
    slim, at = with_text(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(at)):
                x = features(data, offsets, hasher)
                cells = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, end - first) for k in range(len(keep))), cells], names=[*keep, "features"])

    return slim.mapInArrow(run, _schema(slim, keep, "features array<double>"))


def _schema(slim: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)]), more])


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled documents; `learn` is a condition on the labels' rows."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull() & (F.lit(True) if learn is None else learn))
    order = F.xxhash64(F.col("__id"))
    chosen = (
        known.groupBy(F.col(doc_id).alias("__id")).agg((F.avg(label) >= 0.5).cast("int").alias("__label"))
        .orderBy(order, "__id").limit(sample_rows)
    )
    joined = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__words")).join(F.broadcast(chosen), "__id")
    rows = with_features(joined, "__words", ["__id", "__label"]).orderBy(order, "__id", "features").limit(sample_rows).toArrow()
    x = rows["features"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    return fit_arrays(x, rows["__label"].to_numpy().astype(float))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The `keep` columns (all by default) and, last, the model's probability of label 1, by vectorised bin additions."""
    bounded_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*keep), name)
    slim, at = with_text(docs, keep, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(), shared.value
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(at)):
                scores = pa.array(own.scores(features(data, offsets, hasher)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(first, end - first) for k in range(len(keep))), scores], names=[*keep, name])

    return slim.mapInArrow(run, _schema(slim, keep, f"`{name}` double"))
