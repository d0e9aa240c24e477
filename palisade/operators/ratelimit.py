"""Sliding-window rate limit: a request passes if fewer than ``limit`` passed in the last 60 s.

Rejected requests do not count, so a decision depends on the client's earlier decisions: request number ``limit``
after a pass must come later than that pass plus the window. (Following such a pointer from each of the first ``limit``
requests is not enough: two passes may point to the same request, and the second of them then takes the one after it.)

Only the chain of passes is sequential, and it is short: ``limit`` passes a window at most, whatever number of requests
lies between. So requests are dealt by ranges of client and time, and a client with most of the rows is many ranges.
Each range becomes blocks of sorted requests. Per stretch of a client's time line (nothing carries over a silence of a
window) one task walks through the blocks' times alone, which are differences of a few bits; it reads a block only if
a pass can lie in it, and names the passes. These go back to the blocks, and every range writes its own decisions.

A null client is a client of its own; a request without a time never passes.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fx
from palisade.plans.checkpoints import tabled

#: Requests of one block.
BLOCK = 16_384


def admit(times: np.ndarray, history: deque, limit: int, window_us: int) -> np.ndarray:
    """Places of the passes among ordered request times in micros; ``history``, the last passes, is updated in place."""
    places: list[int] = []
    at = 0
    while at < len(times) and limit > 0:
        if len(history) == limit:
            at = max(at, int(np.searchsorted(times, history[0] + window_us, side="right")))
            if at == len(times):
                break
            history.popleft()
        places.append(at)
        history.append(int(times[at]))
        at += 1
    return np.array(places, np.int32)


def _packed(times: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(times, prepend=times[:1]).tobytes())


def _unpacked(first: int, packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), np.int64)) + first


_BLOCKS = "block long, client string, first_us long, last_us long, times binary, ties array<string>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted requests (client, ts_us, tie) of one range as blocks, numbered in their order over all ranges."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        clients = batch.column(0).dictionary_encode()
        codes = clients.indices.fill_null(-1).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
        rows: list[tuple] = []
        for begin, end in zip(cuts, cuts[1:]):
            for at in range(begin, end, BLOCK):
                part = batch.slice(at, min(BLOCK, end - at))
                times = part.column(1).to_numpy()
                rows.append((number, part.column(0)[0].as_py(), int(times[0]), int(times[-1]), _packed(times), part.column(2).to_pylist()))
                number += 1
        columns = list(zip(*rows)) or [[]] * 6
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], names=["block", "client", "first_us", "last_us", "times", "ties"])


def _chain(limit: int, window_us: int):
    """Blocks in the order of client, stretch and number: the places of the passes of each block that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, history = None, deque()
        for batch in batches:
            clients, stretches, blocks, firsts, lasts, times = (c.to_pylist() for c in batch.columns)
            found: list[tuple[int, bytes]] = []
            for i, block in enumerate(blocks):
                if (clients[i], stretches[i]) != current:
                    current, history = (clients[i], stretches[i]), deque()
                if len(history) == limit and (not limit or lasts[i] <= history[0] + window_us):
                    continue
                places = admit(_unpacked(firsts[i], times[i]), history, limit, window_us)
                if len(places):
                    found.append((block, places.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], names=["block", "places"])

    return run


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for client, first, times, ties, places in zip(*(c.to_pylist() for c in batch.columns)):
            stamps = _unpacked(first, times)
            passed = np.zeros(len(stamps), bool)
            if places:
                passed[np.frombuffer(places, np.int32)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([client] * len(stamps), pa.string()), pa.array(ties, pa.string()), pa.array(stamps), pa.array(passed)],
                names=["client", "tie", "ts_us", "admitted"])


def rate_limit(
    df: DataFrame,
    client: str,
    ts: str,
    tie: str,
    limit: int,
    window_seconds: int = fx.RATE_WINDOW_SECONDS,
) -> DataFrame:
    """(client, tie, ts_us, admitted) for every request. ``tie`` orders equal times and is unique."""
    window_us = window_seconds * 1_000_000
    requests = df.selectExpr(f"cast({client} as string) as client", f"unix_micros({ts}) as ts_us", f"cast({tie} as string) as tie")
    ranges = requests.filter("ts_us is not null").repartitionByRange("client", "ts_us", "tie").sortWithinPartitions(
        "client", "ts_us", "tie")
    blocks = tabled(ranges.mapInArrow(_blocks, _BLOCKS))
    # The rows of these windows are blocks, not requests.
    gaps = blocks.selectExpr(
        "client", "block", "first_us", "last_us", "times",
        f"first_us - lag(last_us) over (partition by client order by block) > {window_us} as cut")
    stretches = gaps.selectExpr(
        "client", "count_if(cut) over (partition by client order by block) as stretch", "block", "first_us", "last_us", "times")
    passes = stretches.repartition("client", "stretch").sortWithinPartitions("client", "stretch", "block").mapInArrow(
        _chain(limit, window_us), "block long, places binary")
    decided = blocks.join(passes, "block", "left").select("client", "first_us", "times", "ties", "places").mapInArrow(
        _decided, "client string, tie string, ts_us long, admitted boolean")
    return decided.union(requests.filter("ts_us is null").select("client", "tie", "ts_us", F.lit(False)))
