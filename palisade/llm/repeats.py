"""Removal of repeated byte strings: fingerprints of windows, sampled at minimisers, are grouped in two rounds.

Every window of `length` bytes names the position of the smallest hash near its start (a minimiser), so equal windows name the same
place in their strings; suffixes are kept at these places only, each with how far the windows that name it reach to its left. A shard
(a block of texts) collapses equal suffixes. Fingerprints go to the partition of their hash, which sorts those of all shards and counts:

1. suffixes that share the common prefix form an interval; an interval of one suffix ends here. Within an interval, suffixes that also
   share everything their windows reach, on both sides, are repeated as a whole, whatever their number. A shard sends an interval's prefix
   once, whatever its suffixes, and the suffixes apart from it by all they reach, so no prefix is a hot key;
2. in intervals of several suffixes, the single windows, one representative for each collapsed suffix, are grouped with their place in the
   window, and each is repeated or not. They are dealt by the whole window, so a hot prefix is spread.

Each round sends a shard's keys and gets an answer for each; a shard sorts its keys again in each pass over its texts, and equal strings of
a shard are one key, so groups of copies cost a row per shard. Between rounds the texts, compressed, meet their answers again by shard.

A null text is empty; texts shorter than `length` have no repeat. Repeated rows are repeats of each other.

The shards are cut anew in each round and must come out alike: the frame must give the same rows in the same partitions each time it is
read, as a table on disk does. A difference is found and stops the job.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Hasher, bounded_batches, fresh, mix, text_slices, written

#: Bytes of a repeat; starts among which a window's minimiser is chosen; bytes hashed at each.
LENGTH, NEAR, GRAM = 400, 128, 8
#: Bytes of a shard (a longer text is a shard of its own), and of text for each partition of the keys.
SHARD_BYTES = 1 << 20
PART_BYTES = 16 << 20

_NEVER, _MIXED, _WHOLE, _SPEAKS = 0, 1, 2, 3


class Shard:
    """Sampled suffixes of some texts: place, first and last window that name it, and the keys of rounds one and two."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int = LENGTH):
        self.data, self.offsets, self.length = data, offsets, length
        near = min(NEAR, length - GRAM)
        self.width = 1 << (near.bit_length() - 1)
        starts = self._window_starts()
        if not len(starts):
            self.place = self.first = self.last = np.zeros(0, np.int64)
            self.core = self.whole = np.zeros(0, np.uint64)
            return
        grams = np.ndarray((len(data) - GRAM + 1,), "<u8", buffer=data.tobytes(), strides=(1,))
        low = ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32) << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step < self.width:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        named = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        del low, grams
        cut = np.flatnonzero(np.diff(named)) + 1
        self.first = starts[np.concatenate(([0], cut))]
        self.last = starts[np.concatenate((cut - 1, [len(starts) - 1]))]
        self.place = named[np.concatenate(([0], cut))]
        one, two = _HASHERS
        sums = one.prefix(data)
        self.core = one.ranges(sums, self.place, self.place + length - self.width + 1)
        self.sums = two.prefix(data)
        reach = (self.place - self.first).astype(np.uint64) << np.uint64(32) | (self.place - self.last).astype(np.uint64)
        self.whole = mix(two.ranges(self.sums, self.first, self.last + length) + mix(reach))

    def _window_starts(self) -> np.ndarray:
        sizes = np.maximum(np.diff(self.offsets) - self.length + 1, 0)
        return np.arange(sizes.sum()) + np.repeat(self.offsets[:-1] - (np.cumsum(sizes) - sizes), sizes)

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct (whole, core) as an array of two columns, each one's count, and each suffix's place among them."""
        return _distinct(self.whole, self.core)

    @staticmethod
    def cores(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of such suffixes the sorted cores, each with its only whole or 0 for several, how many it has, and each suffix's core."""
        core, first, number = np.unique(keys[:, 1], return_index=True, return_inverse=True)
        only = np.where(np.bincount(number, minlength=len(core)) == 1, keys[first, 0], np.uint64(0))
        return np.column_stack((core, only)), np.bincount(number, counts, len(core)).astype(np.int64), number

    def windows(self, status: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of suffixes that are mixed or speak for others, and the suffix of each."""
        own = np.flatnonzero((status == _MIXED) | (status == _SPEAKS))
        sizes = self.last[own] - self.first[own] + 1
        at = np.arange(sizes.sum()) + np.repeat(self.first[own] - (np.cumsum(sizes) - sizes), sizes)
        return at, np.repeat(own, sizes)

    def window_keys(self, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left = (self.place[own] - at).astype(np.uint64)
        return _distinct(mix(_HASHERS[1].ranges(self.sums, at, at + self.length) + mix(left)), self.core[own])


_HASHERS = (Hasher(41), Hasher(43))
_LIBC = ctypes.CDLL(None)


def _release() -> None:
    """Give what this worker's shards have grown back to the system; the next stage's worker is the same process."""
    for hasher in _HASHERS:
        hasher.size, hasher.power, hasher.back = 0, None, None
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    number = np.empty(len(a), np.int64)
    number[order] = np.cumsum(new) - 1
    return np.column_stack((a[new], b[new])), np.diff(np.append(np.flatnonzero(new), len(a))), number


def _shards(batches: Iterator[pa.RecordBatch], at: int, length: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Number, rows, bytes and offsets of each shard of a partition; column `at` holds the text."""
    base, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column(at), SHARD_BYTES):
            yield base + number, batch.slice(first, end - first), data, offsets
            number += 1
    _release()


_REQUEST = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_REQUEST_SQL = "part int, shard long, keys binary, counts binary"
_ANSWER_SQL = "part int, shard long, size long, answer binary"


def _sent(shard: int, keys: np.ndarray, counts: np.ndarray, parts: int, of_cores: bool = False) -> Iterator[pa.RecordBatch]:
    """A shard's keys, cut by their first column; the parts of cores are numbered -1, -2, ..."""
    edges = np.array([(1 << 64) * k // parts for k in range(parts)], np.uint64)
    cuts = np.append(np.searchsorted(keys[:, 0], edges), len(keys))
    for p in range(parts):
        a, b = int(cuts[p]), int(cuts[p + 1])
        if a < b:
            own = np.minimum(counts[a:b], 255).astype(np.uint8)  # only one or more than one matters
            yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(
                (-1 - p if of_cores else p, shard, keys[a:b].tobytes(), own.tobytes()), _REQUEST, strict=True)], schema=_REQUEST)


def _interleaved(group: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The shards' lists of one partition as one: shards, ends of their lists, all keys, and counts."""
    shards = group.column("shard").to_pylist()
    lists = [np.frombuffer(k, np.uint64).reshape(-1, 2) for k in group.column("keys").to_pylist()]
    counts = np.concatenate([np.frombuffer(c, np.uint8) for c in group.column("counts").to_pylist()])
    return shards, np.cumsum([0, *map(len, lists)]), np.concatenate(lists), counts


def _answers(key: tuple, shards: list[int], ends: np.ndarray, answer: np.ndarray) -> pa.Table:
    return pa.table({
        "part": pa.array([key[0].as_py()] * len(shards), pa.int32()), "shard": pa.array(shards, pa.int64()), "size": pa.array(np.diff(ends), pa.int64()),
        "answer": [answer[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]})


def _first_round(key: tuple, group: pa.Table) -> pa.Table:
    """Of a suffix 0 if it is alone, else 1, and 2 for the first shard that holds it; of a core 1 if it is repeated, plus 2 if in several suffixes."""
    shards, ends, flat, counts = _interleaved(group)
    if key[0].as_py() < 0:
        order = np.lexsort((flat[:, 1], flat[:, 0]))
        core, only = flat[order, 0], flat[order, 1]
        begin = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
        size = np.diff(np.append(begin, len(core)))
        various = (only[begin] == 0) | (only[begin] != only[begin + size - 1])
        answer = np.empty(len(core), np.uint8)
        answer[order] = np.repeat((np.add.reduceat(counts[order].astype(np.int64), begin) > 1) + 2 * various, size)
        return _answers(key, shards, ends, answer)
    merged, _, number = _distinct(flat[:, 0], flat[:, 1])
    many = np.bincount(number, counts, len(merged)) > 1
    answer = many[number].astype(np.uint8)
    _, first = np.unique(number, return_index=True)
    answer[first[many]] = 2
    return _answers(key, shards, ends, answer)


def _second_round(key: tuple, group: pa.Table) -> pa.Table:
    shards, ends, flat, counts = _interleaved(group)
    merged, _, number = _distinct(flat[:, 0], flat[:, 1])
    return _answers(key, shards, ends, (np.bincount(number, counts, len(merged)) > 1)[number].astype(np.uint8))


def _status(answers: pa.Table, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a shard's suffixes are, by the answers of round one. Where a core has several suffixes, one holder of a repeated one speaks."""
    of_cores = np.array(answers.column("part").to_pylist(), np.int64) < 0
    cores, _, number = Shard.cores(keys, counts)
    core = _gathered(answers.filter(pa.array(of_cores)), len(cores))[number]
    own = _gathered(answers.filter(pa.array(~of_cores)), len(keys))
    repeated = np.where((own == 2) & (core >= 2), _SPEAKS, _WHOLE)
    return np.where(core % 2 == 0, _NEVER, np.where(own == 0, _MIXED, repeated))


def _gathered(answers: pa.Table, size: int) -> np.ndarray:
    rows = sorted(answers.select(["part", "answer"]).to_pylist(), key=lambda r: abs(r["part"]))
    out = np.frombuffer(b"".join(r["answer"] for r in rows), np.uint8)
    if len(out) != size:
        raise RuntimeError("the texts came in other shards the second time; write them to a table first")
    return out


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(row["bytes"]), np.uint8), np.frombuffer(row["offsets"], np.int64)


def spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None, length: int = LENGTH, finish=None, schema: str = "") -> DataFrame:
    """The `keep` columns (all by default) of every row, with what `finish` makes of its bytes and a flag for each byte to be removed.

    finish(bytes of a text, flags) gives the values of the columns that `schema` names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    keep = docs.columns if keep is None else keep
    finish, schema = (finish, schema) if finish else (_runs, f"`{fresh(docs.select(*keep), 'spans')[0]}` array<struct<first:bigint,last:bigint>>")
    hidden = fresh(docs, "text")[0]
    slim = docs.select(*keep, F.col(text).alias(hidden))
    at, row_type = len(keep), slim.select(*keep).schema
    size = slim.agg(F.sum(F.octet_length(hidden))).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in row_type), schema])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, data, offsets in _shards(batches, at, length):
            keys, counts, _ = Shard(data, offsets, length).suffixes()
            yield from _sent(number, keys, counts, parts)
            yield from _sent(number, *Shard.cores(keys, counts)[:2], parts, of_cores=True)

    def pack(with_rows: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            squeeze = zstandard.ZstdCompressor(level=3)
            for number, rows, data, offsets in _shards(batches, at, length):
                kept = b""
                if with_rows:
                    sink = pa.BufferOutputStream()
                    own = pa.RecordBatch.from_arrays(rows.columns[:at], names=keep)
                    with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                        w.write_batch(own)
                    kept = sink.getvalue().to_pybytes()
                yield pa.RecordBatch.from_pydict({
                    "shard": [number], "bytes": [squeeze.compress(data.tobytes())], "offsets": [offsets.tobytes()], "kept": [kept]}, schema=pa.schema([
                        ("shard", pa.int64()), ("bytes", pa.binary()), ("offsets", pa.binary()), ("kept", pa.binary())]))

        return slim.mapInArrow(run, "shard long, bytes binary, offsets binary, kept binary")

    def refine(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        data, offsets = _unpacked(texts.to_pylist()[0])
        shard = Shard(data, offsets, length)
        keys, counts, number = shard.suffixes()
        starts, own = shard.windows(_status(answers, keys, counts)[number])
        if not len(starts):
            return _REQUEST.empty_table()
        keys, counts, _ = shard.window_keys(starts, own)
        asked = pa.Table.from_batches(_sent(key[0].as_py(), keys, counts, parts), _REQUEST)
        del shard, keys, counts, starts, own
        _release()
        return asked

    def end(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        data, offsets = _unpacked(row)
        shard = Shard(data, offsets, length)
        keys, counts, number = shard.suffixes()
        rounds = answers.column("round").to_numpy()
        status = _status(answers.filter(pa.array(rounds == 1)), keys, counts)[number]
        repeated = np.zeros(len(data) + 1, np.int64)
        sure = np.flatnonzero(status >= _WHOLE)
        repeated[shard.first[sure]] += 1
        np.add.at(repeated, shard.last[sure] + 1, -1)
        again = np.cumsum(repeated)[:-1] > 0
        starts, own = shard.windows(status)
        if len(starts):
            keys, _, number = shard.window_keys(starts, own)
            found = _gathered(answers.filter(pa.array(rounds == 2)), len(keys))[number] > 0
            again[starts[found]] = True
        edge = np.zeros(len(data) + length + 1, np.int64)
        hit = np.flatnonzero(again)
        edge[hit] += 1
        edge[hit + length] -= 1
        gone = np.cumsum(edge)[: len(data)] > 0
        del shard, keys, counts, number, rounds, status, repeated, sure, again, starts, own, edge, hit
        _release()
        kept = pa.ipc.open_stream(row["kept"]).read_all()
        results = [finish(data[a:b], gone[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        fields = [f for f in made if f.name not in keep]
        columns = [pa.array([r[i] for r in results], f.type) for i, f in enumerate(fields)]
        return pa.Table.from_arrays([*kept.columns, *columns], names=[*keep, *(f.name for f in fields)])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_schema(_parse_datatype_string(out_schema))
    first = written(slim.mapInArrow(ask, _REQUEST_SQL).groupBy("part").applyInArrow(_first_round, _ANSWER_SQL))
    asked = pack(False).groupBy("shard").cogroup(first.groupBy("shard")).applyInArrow(refine, _REQUEST_SQL)
    second = written(asked.groupBy("part").applyInArrow(_second_round, _ANSWER_SQL))
    answers = first.withColumn("round", F.lit(1)).union(second.withColumn("round", F.lit(2)))
    return pack(True).groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(end, out_schema)


def _edges(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    return edge[::2], edge[1::2]


def _runs(data: np.ndarray, gone: np.ndarray) -> tuple:
    return ([{"first": int(a), "last": int(b)} for a, b in zip(*_edges(gone), strict=True)],)


def digest(data: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
    """Bytes, removed bytes, removed runs, SHA-256 of what is left."""
    return len(data), int(gone.sum()), len(_edges(gone)[0]), hashlib.sha256(data[~gone].tobytes()).hexdigest()


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """The documents without their repeated bytes; a character that a cut leaves in part goes too. A null text stays null."""
    others = [c for c in docs.columns if c != text]

    def left(data: np.ndarray, gone: np.ndarray) -> tuple[str]:
        return (data[~gone].tobytes().decode("utf-8", "ignore"),)

    (was_null,) = fresh(docs, "was_null")
    cut = spans(docs.withColumn(was_null, F.col(text).isNull()), text, [*others, was_null], length, left, f"`{text}` string")
    return cut.withColumn(text, F.when(~F.col(was_null), F.col(text))).select(*docs.columns)
