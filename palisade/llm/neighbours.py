"""Approximate nearest neighbours by cross-polytope hashing, with an exact ranking of everything the probed tables hold.

A table turns a unit vector by three rounds of random signs and a fast Hadamard transform and names it after the nearest signed
axis. Points go to their own bucket of each table, in blocks of bounded size; a query probes the nearest axes of each. Blocks of
points meet blocks of queries by an equality join on (table, bucket), so a crowded bucket is many rows, never one.

Rows without an id, and vectors that are null, zero, of another length than the commonest (the longer, in a tie), or hold a null
or non-finite component take no part. Rows of the same id count as one, with the smallest of their vectors. A query whose probes
find fewer than k others is looked for in every bucket of one table, which is every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import bounded_batches, checkpointed

#: Tables, hashes joined in a bucket's name, and buckets probed in each table.
TABLES, HASHES, PROBES = 16, 1, 6
#: Points and queries of one block.
POINT_BLOCK, QUERY_BLOCK = 256, 256
#: Queries that one task turns into blocks.
QUERIES_PER_TASK = 4096
#: Found rows that a task holds before it keeps only the nearest of each query.
HELD_ROWS = 400_000


class Rotations:
    """The pseudo-rotations of every table, the same in every worker."""

    def __init__(self, dim: int, tables: int, hashes: int, seed: int = 7):
        self.wide = 1 << max(0, dim - 1).bit_length()
        self.tables, self.hashes = tables, hashes
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, self.wide))

    def turned(self, x: np.ndarray, table: int, k: int) -> np.ndarray:
        y = np.zeros((len(x), self.wide))
        y[:, : x.shape[1]] = x / np.sqrt((x * x).sum(1))[:, None]
        for signs in self.signs[table, k]:
            y = y * signs
            h = 1
            while h < self.wide:
                pair = y.reshape(len(y), -1, 2, h)
                y = np.stack((pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]), 2).reshape(len(y), -1)
                h *= 2
            y = y / np.sqrt(self.wide)
        return y

    def probes(self, x: np.ndarray, table: int, count: int) -> np.ndarray:
        """Bucket numbers by nearness for each vector: signed axes of the largest coordinates, combined over the hashes."""
        codes, costs = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for k in range(self.hashes):
            y = self.turned(x, table, k)
            axes = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :count]
            size = np.take_along_axis(np.abs(y), axes, 1)
            own = axes * 2 + (np.take_along_axis(y, axes, 1) > 0)
            codes = (codes[:, :, None] * (2 * self.wide) + own[:, None, :]).reshape(len(x), -1)
            costs = (costs[:, :, None] + ((size[:, :1] - size) ** 2)[:, None, :]).reshape(len(x), -1)
            order = np.argsort(costs, axis=1, kind="stable")[:, :count]
            codes, costs = np.take_along_axis(codes, order, 1), np.take_along_axis(costs, order, 1)
        return codes


_BLOCKS = "bucket_table int, bucket long, ids binary, vectors binary"


def _blocks(vectors: DataFrame, dim: int, rotations: Rotations, probes: int, most: int, every: bool = False) -> DataFrame:
    """(id, vector) rows as blocks per (table, bucket); `every` puts them in all buckets of the first table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 8192):
                part = batch.slice(lo, 8192)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
                for t in range(1 if every else rotations.tables):
                    if every:
                        wide = (2 * rotations.wide) ** rotations.hashes
                        codes = np.tile(np.arange(wide), (len(x), 1))
                    else:
                        codes = rotations.probes(x, t, probes)
                    flat = codes.ravel()
                    who = np.repeat(np.arange(len(x)), codes.shape[1])
                    order = np.argsort(flat, kind="stable")
                    cuts = np.flatnonzero(np.diff(flat[order])) + 1
                    out: list[tuple] = []
                    for own in np.split(order, cuts):
                        for at in range(0, len(own), most):
                            some = who[own[at:at + most]]
                            out.append((t, int(flat[own[0]]), ids[some].tobytes(), x[some].tobytes()))
                    columns = list(zip(*out, strict=True)) or [[], [], [], []]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()),
                         pa.array(columns[3], pa.binary())], names=["bucket_table", "bucket", "ids", "vectors"])

    return vectors.mapInArrow(run, _BLOCKS)


_FOUND = np.dtype([("query_id", np.int64), ("vec_id", np.int64), ("score", np.float64)])


def _kept(found: np.ndarray, k: int) -> np.ndarray:
    """The k nearest of each query among the rows a task holds, each partner once."""
    found = found[np.lexsort((found["vec_id"], found["score"], found["query_id"]))]
    again = np.zeros(len(found), bool)
    again[1:] = (found["query_id"][1:] == found["query_id"][:-1]) & (found["vec_id"][1:] == found["vec_id"][:-1])
    found = found[~again]
    first = np.searchsorted(found["query_id"], found["query_id"])
    return found[np.arange(len(found)) - first < k]


def _batch(held: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held[0][c]) for c in _FOUND.names], names=list(_FOUND.names))


def _nearest(points: DataFrame, queries: DataFrame, dim: int, k: int) -> DataFrame:
    """Join blocks of the same bucket, measure exactly, and keep the k nearest of each query in a task."""
    joined = points.join(queries.select(
        "bucket_table", "bucket", F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")), ["bucket_table", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0
        for batch in batches:
            for row in batch.to_pylist():
                ids, query_ids = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["query_ids"], np.int64)
                x = np.frombuffer(row["vectors"]).reshape(-1, dim)
                q = np.frombuffer(row["query_vectors"]).reshape(-1, dim)
                for lo in range(0, len(q), 16):
                    away = np.sqrt(((x[None] - q[lo:lo + 16, None]) ** 2).sum(-1))
                    for i, own in enumerate(query_ids[lo:lo + 16]):
                        best = np.lexsort((ids, away[i]))[:k + 1]
                        best = best[ids[best] != own][:k]
                        found = np.empty(len(best), _FOUND)
                        found["query_id"], found["vec_id"], found["score"] = own, ids[best], away[i][best]
                        held.append(found)
                        rows += len(found)
            if rows > HELD_ROWS:
                held = [_kept(np.concatenate(held), k)]
                rows = len(held[0])
                if rows > HELD_ROWS // 2:  # many queries: hand on what is held
                    yield _batch(held)
                    held, rows = [], 0
        if held:
            yield _batch([_kept(np.concatenate(held), k)])

    return joined.select("ids", "vectors", "query_ids", "query_vectors").mapInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """Distinct ids with their vectors of doubles, and the vectors' length."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & finite & F.exists("vector", lambda v: v != 0))
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dim = common["n"] if common else 1
    return rows.where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector")), dim


def nearest(df: DataFrame, is_query: Column, k: int = 10, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES,
            vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every row for which `is_query` (on the column vec_id) holds, its k nearest other rows: query_id, rank, vec_id, score."""
    bounded_batches(df.sparkSession)
    rows, dim = usable(df, vec_id, vector)
    rows = checkpointed(rows)
    queries = rows.where(is_query)
    n, n_queries = rows.count(), queries.count()
    rotations = Rotations(dim, tables, hashes)
    queries = queries.repartition(-(-max(1, n_queries) // QUERIES_PER_TASK))
    points = _blocks(rows, dim, rotations, 1, POINT_BLOCK)
    found = checkpointed(_top(_nearest(points, _blocks(queries, dim, rotations, probes, QUERY_BLOCK), dim, k), k))
    complete = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1))
    short = queries.join(complete, queries["vec_id"] == complete["query_id"], "left_anti")
    if not short.isEmpty():
        rest = _nearest(points.where("bucket_table = 0"), _blocks(short, dim, rotations, probes, QUERY_BLOCK, every=True), dim, k)
        found = _top(reduce(DataFrame.unionByName, [found.drop("rank"), rest]), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
