"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT): exact windows of inner products around an anchor.

A component x counts as floor(scale * x); a row's score is its integer inner product with the anchor. Every row is lifted by one more
coordinate to a common length M, so that the distance between an anchor (lifted by 0) and a row falls as their score rises: a window of
scores is an annulus around the anchor. The tree's split points come from a bounded sample; each row, sampled or not, goes down to the
nearest split point of each node into a leaf, which is cut into blocks. For every two siblings the node stores the least and the largest
distance from the one's split point to the rows of the other's subtree. An anchor leaves out a subtree when, by the triangle inequality,
one of these ranges shows that none of its rows can lie in the annulus. What is left is measured exactly, block by block.

An anchor's positives are looked for in its own leaf first; the last score found there bounds the annulus of the whole search. A leaf of
many blocks (a vector that a third of the rows share) is dealt to as many keys.

Rows without id or label, and vectors that are null or hold a null or non-finite component, take no part; shorter vectors count as filled
up with zeros. Every row stands for itself: rows that repeat an id are candidates and anchors each. Ties go to the smaller id. An anchor
without positives, or a positive without negatives in its window, returns no row. Scores that 64 bits cannot hold are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import bounded_batches, checkpointed, written

#: Rows, and bytes of them, of the sample that gives the split points.
SAMPLE_ROWS, SAMPLE_BYTES = 16_384, 16 << 20
#: Children of a node, rows a leaf should hold, and sampled rows it must hold.
FAN, LEAF_ROWS, LEAF_SAMPLE = 16, 2048, 8
#: Rows and anchors of one block, and blocks of a leaf that share a key.
BLOCK, ANCHOR_BLOCK, BLOCKS_PER_KEY = 1024, 256, 16
#: Found rows that a task holds before it keeps only the first of each window.
HELD_ROWS = 200_000
#: The part of M by which an annulus is widened against rounding.
SLACK = 1e-6

_LEAST, _MOST = -(1 << 62), 1 << 62


@dataclass
class Node:
    points: np.ndarray  # lifted split points, one a row
    children: list[int] = field(default_factory=list)  # number of a node, or -1 - leaf


class Tree:
    """Split points, the same in every worker; `low` and `high` are each node's ranges once all rows are in."""

    def __init__(self, square: float, sample: np.ndarray, leaf_sample: int, fan: int, seed: int = 11):
        self.square, self.fan = square, fan
        self.nodes: list[Node] = []
        self.paths: list[list[tuple[int, int]]] = []  # (node, child) from the root, of each leaf
        self.low = self.high = np.zeros(0)
        rng = np.random.default_rng(seed)
        todo = [(self.lifted(sample), [], None)]
        while todo:
            points, path, parent = todo.pop()
            chosen = self._split_points(points, rng) if len(points) > leaf_sample else points[:0]
            if len(chosen) < 2:
                number = -1 - len(self.paths)
                self.paths.append(path)
            else:
                number = len(self.nodes)
                self.nodes.append(Node(chosen, [0] * len(chosen)))
                nearest = self.apart(points, chosen).argmin(1)
                for j in range(len(chosen)):
                    todo.append((points[nearest == j], [*path, (number, j)], (number, j)))
            if parent:
                self.nodes[parent[0]].children[parent[1]] = number

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack((x, np.sqrt(np.maximum(0.0, self.square - (x * x).sum(1)))))

    def apart(self, lifted: np.ndarray, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.square - 2 * lifted @ points.T))

    def _split_points(self, points: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The points far from each other among some of the sample, each next one farthest from those before."""
        some = points[rng.permutation(len(points))[: 4 * self.fan]]
        chosen, away = [0], self.apart(some, some[:1])[:, 0]
        while len(chosen) < self.fan and away.max() > 1e-3 * np.sqrt(self.square):
            chosen.append(int(away.argmax()))
            away = np.minimum(away, self.apart(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        lifted, out = self.lifted(x), np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))] if self.nodes else []
        while todo:
            node, rows = todo.pop()
            nearest = self.apart(lifted[rows], self.nodes[node].points).argmin(1)
            for j, child in enumerate(self.nodes[node].children):
                own = rows[nearest == j]
                if child < 0:
                    out[own] = -1 - child
                elif len(own):
                    todo.append((child, own))
        return out

    def ranges(self, leaf: int, x: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """For each node above the leaf: node, child, and least and largest distance of the rows to each split point."""
        lifted = self.lifted(x)
        away = [(node, child, self.apart(lifted, self.nodes[node].points)) for node, child in self.paths[leaf]]
        return [(node, child, d.min(0), d.max(0)) for node, child, d in away]

    def reached(self, a: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves whose rows may have a score in one of an anchor's windows (rows of lows and highs), with the anchors."""
        norms = (a * a).sum(1) + self.square
        slack = SLACK * np.sqrt(norms.max(initial=1.0) + self.square)
        far = np.where(lows <= _LEAST, np.inf, np.sqrt(np.maximum(0.0, norms[:, None] - 2.0 * lows))) + slack
        near = np.where(highs >= _MOST, 0.0, np.sqrt(np.maximum(0.0, norms[:, None] - 2.0 * highs))) - slack
        usable = lows <= highs
        todo = [(0 if self.nodes else -1, np.flatnonzero(usable.any(1)))]
        while todo:
            number, rows = todo.pop()
            if not len(rows):
                continue
            if number < 0:
                yield -1 - number, rows
                continue
            points = self.nodes[number].points
            away = np.sqrt(np.maximum(0.0, norms[rows, None] - 2 * a[rows] @ points[:, :-1].T))
            for j, child in enumerate(self.nodes[number].children):
                low, high = self.low[number, : len(points), j], self.high[number, : len(points), j]
                # no row of the subtree is nearer than `least`, none farther than `most`
                least = np.maximum(away - high, low - away).max(1)
                most = (away + high).min(1)
                meets = usable[rows] & (least[:, None] <= far[rows]) & (most[:, None] >= near[rows])
                todo.append((child, rows[meets.any(1)]))


def _padded(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """The vectors of a column as rows of floored components, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    x = np.zeros((len(column), dim))
    x[np.arange(dim) < sizes[:, None]] = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False))
    return x


def _stacked(column: pa.Array, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _batch(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


_ROWS = "leaf int, row long, id long, label long, vector binary"
_BLOCKS = "leaf int, first long, rows binary, ids binary, labels binary, vectors binary, ranges binary"


def _to_leaves(rows: DataFrame, dim: int, scale: float, kind: str, tree) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = _padded(part.column(3), dim, scale)
                yield _batch(leaf=tree.value.leaves(x).astype(np.int32), row=part.column(0), id=part.column(1), label=part.column(2),
                             vector=_bytes(x.astype(kind)))

    return rows.select("row", "id", "label", "vector").mapInArrow(run, _ROWS)


def _to_blocks(leafed: DataFrame, dim: int, kind: str, tree) -> DataFrame:
    """Rows sorted by leaf and id as blocks, with the ranges of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def cut(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            leaf, vectors = part["leaf"][0].as_py(), b"".join(part["vector"].to_pylist())
            x = np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
            bounds = tree.value.ranges(leaf, x)
            ranges = np.concatenate([np.concatenate((low, high)) for _, _, low, high in bounds] or [np.zeros(0)])
            own = {c: part[c].to_numpy() for c in ("row", "id", "label")}
            return _batch(leaf=pa.array([leaf], pa.int32()), first=[int(own["row"][0])], rows=[own["row"].tobytes()],
                          ids=[own["id"].tobytes()], labels=[own["label"].tobytes()], vectors=[vectors], ranges=[ranges.tobytes()])

        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            while held.num_rows:
                leaves = held["leaf"].to_numpy()
                size = int(np.searchsorted(leaves, leaves[0], side="right"))
                if size == held.num_rows and size < BLOCK:
                    break
                size = min(size, BLOCK)
                yield cut(held.slice(0, size))
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield cut(held)

    return leafed.mapInArrow(run, _BLOCKS)


def _stored_ranges(blocks: DataFrame, tree) -> DataFrame:
    """Least and largest distance of each node's subtrees (child) to each of its split points: node, point, child, low, high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree.value
        shape = (len(own.nodes), own.fan, own.fan)
        low, high = np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            for leaf, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values, at = np.frombuffer(packed), 0
                for node, child in own.paths[leaf]:
                    n = len(own.nodes[node].points)
                    low[node, :n, child] = np.minimum(low[node, :n, child], values[at:at + n])
                    high[node, :n, child] = np.maximum(high[node, :n, child], values[at + n:at + 2 * n])
                    at += 2 * n
        node, point, child = np.nonzero(high >= 0)
        yield _batch(node=node, point=point, child=child, low=low[node, point, child], high=high[node, point, child])

    partial = blocks.select("leaf", "ranges").mapInArrow(run, "node long, point long, child long, low double, high double")
    return partial.groupBy("node", "point", "child").agg(F.min("low").alias("low"), F.max("high").alias("high"))


_ASKED = "leaf int, salt int, ask_rows binary, ask_labels binary, ask_vectors binary, ask_lows binary, ask_highs binary"


def _asked(asks: DataFrame, dim: int, scale: float, kind: str, windows: int, tree, salts, home: bool) -> DataFrame:
    """Blocks of anchors (row, label, vector, lows, highs) for the leaves that their windows reach, or their own leaf alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4 * ANCHOR_BLOCK):
                part = batch.slice(lo, 4 * ANCHOR_BLOCK)
                rows, labels = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = _padded(part.column(2), dim, scale)
                bounds = []
                for column, missing in ((3, _MOST), (4, _LEAST)):  # a window that is not there is empty
                    sizes = np.diff(part.column(column).offsets.to_numpy())
                    filled = np.full((len(rows), windows), missing, np.int64)
                    filled[np.arange(windows) < sizes[:, None]] = part.column(column).flatten().to_numpy()
                    bounds.append(filled)
                if home:
                    leaves = tree.value.leaves(x)
                    reached = [(leaf, np.flatnonzero(leaves == leaf)) for leaf in np.unique(leaves)]
                else:
                    reached = list(tree.value.reached(x, *bounds))
                out: list[tuple] = []
                for leaf, who in reached:
                    for at in range(0, len(who), ANCHOR_BLOCK):
                        own = who[at:at + ANCHOR_BLOCK]
                        packed = (rows[own].tobytes(), labels[own].tobytes(), x[own].astype(kind).tobytes(),
                                  bounds[0][own].tobytes(), bounds[1][own].tobytes())
                        out.extend((int(leaf), salt, *packed) for salt in range(salts.value.get(int(leaf), 1)))
                columns = list(zip(*out, strict=True)) or [[]] * 7
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield _batch(**{name.split()[0]: pa.array(c, t) for name, c, t in zip(_ASKED.split(", "), columns, types, strict=True)})

    return asks.select("row", "label", "vector", "lows", "highs").mapInArrow(run, _ASKED)


_FOUND = np.dtype([("row", np.int64), ("window", np.int32), ("score", np.int64), ("id", np.int64), ("found_row", np.int64)])


def _first(found: np.ndarray, k: int) -> np.ndarray:
    """The first k of each window."""
    order = np.lexsort((found["found_row"], found["id"], -found["score"], found["window"], found["row"]))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found["row"][1:] != found["row"][:-1]) | (found["window"][1:] != found["window"][:-1])
    begins = np.maximum.accumulate(np.where(new, np.arange(len(found)), 0))
    return found[np.arange(len(found)) - begins < k]


def _scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if a.shape[1] * np.abs(a).max(initial=0.0) * np.abs(x).max(initial=0.0) < 2.0 ** 53:
        return (a @ x.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in x], object).T
    if np.abs(whole).max(initial=0) >= _MOST:
        raise OverflowError("an inner product passes 62 bits")
    return whole.astype(np.int64)


def _search(blocks: DataFrame, asked: DataFrame, dim: int, kind: str, windows: int, k: int, same: bool) -> DataFrame:
    """The first k rows of each anchor's windows, of its label or of others: row, window, score, id, found_row."""
    joined = blocks.join(asked, ["leaf", "salt"]).select(
        "rows", "ids", "labels", "vectors", "ask_rows", "ask_labels", "ask_vectors", "ask_lows", "ask_highs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n_held = 0
        whole = lambda column, i: np.frombuffer(column[i].as_py(), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                c = batch.columns
                rows, ids, labels = whole(c[0], i), whole(c[1], i), whole(c[2], i)
                ask_rows, ask_labels = whole(c[4], i), whole(c[5], i)
                lows, highs = whole(c[7], i).reshape(-1, windows), whole(c[8], i).reshape(-1, windows)
                scores = _scores(_stacked(c[6].slice(i, 1), dim, kind), _stacked(c[3].slice(i, 1), dim, kind))
                allowed = (labels == ask_labels[:, None]) if same else (labels != ask_labels[:, None])
                if same:
                    allowed &= rows != ask_rows[:, None]
                allowed &= (scores >= lows.min(1)[:, None]) & (scores <= highs.max(1)[:, None])
                for at in np.flatnonzero(allowed.any(1)):
                    some = np.flatnonzero(allowed[at])
                    # a block's rows stand in the order of their ids, so equal scores keep it
                    order = some[np.argsort(-scores[at, some], kind="stable")]
                    ranked = -scores[at, order]
                    for w in range(windows):
                        begin = np.searchsorted(ranked, -highs[at, w], side="left")
                        end = min(begin + k, np.searchsorted(ranked, -lows[at, w], side="right"))
                        if end > begin:
                            own = order[begin:end]
                            found = np.empty(len(own), _FOUND)
                            found["row"], found["window"], found["score"] = ask_rows[at], w, scores[at, own]
                            found["id"], found["found_row"] = ids[own], rows[own]
                            held.append(found)
                            n_held += len(found)
                if n_held > HELD_ROWS:
                    held = [_first(np.concatenate(held), k)]
                    n_held = len(held[0])
                    if n_held > HELD_ROWS // 2:  # many anchors: hand on what is held
                        yield _batch(**{name: held[0][name] for name in _FOUND.names})
                        held, n_held = [], 0
        if held:
            kept = _first(np.concatenate(held), k)
            yield _batch(**{name: kept[name] for name in _FOUND.names})

    found = joined.mapInArrow(run, "row long, window int, score long, id long, found_row long")
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """For each row for which `is_anchor` (on the frame's columns) holds and each of its first `positives` other rows of the same label, the first
    `negatives` rows of other labels whose score is between `low` and `high` percent of the positive's.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score; the label is an integer.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                     F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite)
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "*"))
    square = F.aggregate("vector", F.lit(0.0), lambda sum_, v: sum_ + (F.abs(v * scale) + 1) * (F.abs(v * scale) + 1))
    facts = rows.agg(
        F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"), F.max(square).alias("square"),
        F.max(F.array_max(F.transform("vector", lambda v: F.abs(v * scale) + 1))).alias("reach")).first()
    n, dim = facts["n"], max(1, facts["dim"] or 1)
    kind = "<i2" if (facts["reach"] or 0) < 1 << 15 else "<f8"

    most = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dim)))
    share = min(1.0, 0.9 * most / max(1, n))
    chosen = F.pmod(F.xxhash64("row", "id"), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = rows.where(chosen).limit(most).select("vector").toArrow()
    column = sample["vector"].combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64()))
    x = _padded(column, dim, scale)
    tree = Tree(max(1.0, facts["square"] or 1.0), x, max(LEAF_SAMPLE, int(len(x) * LEAF_ROWS / max(1, n))), FAN)

    shared = spark.sparkContext.broadcast(tree)
    parts = 1 + int(n * (dim * np.dtype(kind).itemsize + 24)) // (32 << 20)
    leafed = _to_leaves(rows, dim, scale, kind, shared).repartitionByRange(parts, "leaf", "id", "row").sortWithinPartitions("leaf", "id", "row")
    blocks = written(_to_blocks(leafed, dim, kind, shared))

    shape = (len(tree.nodes), FAN, FAN)
    tree.low, tree.high = np.full(shape, np.inf), np.full(shape, -np.inf)
    # at most nodes x FAN x FAN rows, and leaves rows; the sample bounds both
    for r in _stored_ranges(blocks, shared).collect():
        tree.low[r["node"], r["point"], r["child"]], tree.high[r["node"], r["point"], r["child"]] = r["low"], r["high"]
    salts = {r["leaf"]: -(-r["count"] // BLOCKS_PER_KEY) for r in blocks.groupBy("leaf").count().collect()}
    shared, salted = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(salts)
    keys = F.broadcast(spark.createDataFrame(sorted(salts.items()), "leaf int, keys int"))
    blocks = blocks.join(keys, "leaf").withColumn("salt", F.pmod(F.xxhash64("first"), F.col("keys")).cast("int")).drop("keys", "ranges")

    def found(asks: DataFrame, windows: int, k: int, same: bool, home: bool = False) -> DataFrame:
        return _search(blocks, _asked(asks, dim, scale, kind, windows, shared, salted, home), dim, kind, windows, k, same)

    anchors = rows.where("anchor").select("row", "id", "label", "vector")
    everything = [F.array(F.lit(_LEAST)).alias("lows"), F.array(F.lit(_MOST)).alias("highs")]
    asks = anchors.select("*", *everything)
    if len(tree.paths) > 1:
        near = found(asks, 1, positives, same=True, home=True).where(F.col("rank") == positives)
        asks = anchors.join(near.select("row", F.col("score").alias("bound")), "row", "left").select(
            "row", "id", "label", "vector", F.array(F.coalesce("bound", F.lit(_LEAST))).alias("lows"), everything[1])
    own = found(asks, 1, positives, same=True).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("id").alias("positive"), "score"))).alias("own"))
    asks = checkpointed(anchors.join(own, "row").select(
        "row", "id", "label", "vector", "own",
        # decimals hold the products exactly
        F.expr(f"transform(own, p -> cast(ceil(cast(p.score as decimal(20, 0)) * {low} / 100) as bigint))").alias("lows"),
        F.expr(f"transform(own, p -> cast(floor(cast(p.score as decimal(20, 0)) * {high} / 100) as bigint))").alias("highs")))
    hard = found(asks, positives, negatives, same=False)
    return hard.join(asks.select("row", F.col("id").alias("anchor_id"), "own"), "row").select(
        "anchor_id", F.element_at("own", F.col("window") + 1)["positive"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"), F.element_at("own", F.col("window") + 1)["score"].alias("positive_score"),
        F.col("score").alias("negative_score"))
