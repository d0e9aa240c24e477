"""The sliding-window rate limit on a stream, with the passes of the last window as state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from palisade import fixed_values as fx
from palisade.operators.ratelimit import admit

_STATE = StructType([StructField("passes", ArrayType(LongType()))])
_OUTPUT = "client string, tie string, ts_us long, admitted boolean"


class _Limiter(StatefulProcessor):
    """Per client: decide the batch's requests in time order, keep the window's passes."""

    def __init__(self, limit: int, window_us: int, keep_ms: int | None):
        self.limit = limit
        self.window_us = window_us
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passes = handle.getValueState("passes", _STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = self.passes.get()[0] if self.passes.exists() else []
        history = deque(kept)
        ordered = pd.concat(rows).sort_values(["ts_us", "tie"])
        admitted = np.zeros(len(ordered), bool)
        admitted[admit(ordered["ts_us"].to_numpy(np.int64), history, self.limit, self.window_us)] = True
        ordered["admitted"] = admitted
        self.passes.update((list(history),))
        yield ordered[["client", "tie", "ts_us", "admitted"]].astype({"client": object, "tie": object})

    def close(self) -> None:
        pass


def rate_limit_stream(
    stream: DataFrame, client: str, ts: str, tie: str, limit: int, window_seconds: int = fx.RATE_WINDOW_SECONDS,
    keep_ms: int | None = None,
) -> DataFrame:
    """Decisions per request. State per client is at most ``limit`` times; the trigger size
    (files or offsets per batch) bounds what one client can bring into a task.

    With ``keep_ms``, a client that is silent for so many milliseconds of the clock leaves the state. Choose it far longer
    than the window, so that a stream that lags forgets no pass that counts; such a query runs a batch at every trigger.
    """
    requests = stream.selectExpr(
        f"cast({client} as string) as client", f"cast({tie} as string) as tie", f"unix_micros({ts}) as ts_us")
    return requests.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_Limiter(limit, window_seconds * 1_000_000, keep_ms),
        outputStructType=_OUTPUT, outputMode="append", timeMode="none" if keep_ms is None else "processingTime")
