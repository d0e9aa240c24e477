"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Rows with a null text have no words and are never contaminated. Repeated rows are judged each on its own. Benchmark rows without
words have no window; a benchmark row with a null id hits words but is not listed. With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import (
    ALNUM, Hasher, LOWER, bounded_batches, checkpointed, fresh, row_bounds, signed, text_slices, words,
)

#: Words of a window, bytes of window text that one broadcast may hold, and the share of hit words that condemns a document.
WINDOW = 13
BROADCAST_BYTES = 16 << 20
HIT_SHARE = 20


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per distinct (item, window): words joined by blanks, their number, and the window's hash."""
    bounded_batches(benchmark.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                data = LOWER[data]
                starts, ends, rows = words(data, offsets, ALNUM)
                hashes = hasher.ranges(hasher.prefix(data), starts, ends)
                bounds = row_bounds(rows, end - first)
                out: dict[str, list] = {"item_id": [], "n": [], "hash": [], "words": []}
                for i in range(end - first):
                    lo, hi = int(bounds[i]), int(bounds[i + 1])
                    if lo == hi:
                        continue
                    n = min(window, hi - lo)
                    own = [data[starts[j]:ends[j]].tobytes() for j in range(lo, hi)]
                    keys = signed(_windows(hasher, hashes[lo:hi], n))
                    out["item_id"] += [batch.column(0)[first + i].as_py()] * len(keys)
                    out["n"] += [n] * len(keys)
                    out["hash"] += keys.tolist()
                    out["words"] += [b" ".join(own[j:j + n]) for j in range(len(keys))]
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("item_id", pa.string()), ("n", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))

    slim = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).alias("text"))
    return slim.mapInArrow(cut, "item_id string, n int, hash long, words binary").distinct()


def _windows(hasher: Hasher, hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word hashes."""
    hasher._grow(n + 1)
    total = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
    for k in range(n):
        total += hashes[k:k + len(total)] * hasher.power[k]
    return total


class _Index:
    """The windows of one broadcast: sorted hashes by window length, and the exact words behind each."""

    def __init__(self, rows: list):
        self.items: dict[tuple[int, bytes], list[str]] = {}
        by_length: dict[int, set[int]] = {}
        for r in rows:
            self.items.setdefault((r["n"], bytes(r["words"])), []).extend([r["item_id"]] if r["item_id"] is not None else [])
            by_length.setdefault(r["n"], set()).add(r["hash"])
        self.hashes = {n: np.sort(np.array(sorted(h), np.int64).view(np.uint64)) for n, h in by_length.items()}
        # The low bits of a hash pick a cell of this map; most windows of a text miss it and need no search.
        self.cells = {n: self._cells(h) for n, h in self.hashes.items()}

    @staticmethod
    def _cells(hashes: np.ndarray) -> np.ndarray:
        cells = np.zeros(1 << max(16, int(len(hashes)).bit_length() + 4), bool)
        cells[hashes & np.uint64(len(cells) - 1)] = True
        return cells

    def candidates(self, n: int, keys: np.ndarray) -> np.ndarray:
        known, cells = self.hashes[n], self.cells[n]
        at = np.flatnonzero(cells[keys & np.uint64(len(cells) - 1)])
        place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
        return at[known[place] == keys[at]]


def scan(docs: DataFrame, windows: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add `hits`: words of the text, byte spans of the hit runs, the number of hit words, and the ids of the items found.

    The windows are broadcast while their words fit `broadcast_bytes`; a larger set is taken in as many bounded parts, one
    pass of the documents each, and every pass is written out before the next.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    windows = checkpointed(windows)
    size = windows.agg(F.sum(F.length("words") + F.lit(64))).first()[0] or 0
    parts = max(1, -(-2 * size // broadcast_bytes) if size > broadcast_bytes else 1)
    (name,) = fresh(docs, "hits")
    out = docs.withColumn(name, F.lit(None).cast(_HITS))
    for part in range(parts):
        own = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        out = _scan_part(out, own.collect(), text, name, last=part == parts - 1)
        if part < parts - 1:
            out = checkpointed(out)
    return out


_HITS = "struct<n_words:bigint,n_hit:bigint,word_starts:array<bigint>,word_ends:array<bigint>," \
        "byte_starts:array<bigint>,byte_ends:array<bigint>,items:array<string>>"
_ARROW_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), *[
    (n, pa.list_(pa.int64())) for n in ("word_starts", "word_ends", "byte_starts", "byte_ends")], ("items", pa.list_(pa.string()))])


def _scan_part(docs: DataFrame, rows: list, text: str, name: str, last: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    at, at_hits = docs.columns.index(text), docs.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hasher = _Index(shared.value), Hasher()
        for batch in batches:
            earlier = batch.column(at_hits)
            for first, end, data, offsets in text_slices(batch.column(at)):
                hits = _hits(index, hasher, data, offsets, end - first, earlier[first:end])
                columns = [c.slice(first, end - first) for c in batch.columns]
                columns[at_hits] = pa.array(hits, _ARROW_HITS)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _hits(index: _Index, hasher: Hasher, data, offsets, n: int, earlier: pa.Array) -> list[dict]:
    data = LOWER[data]
    starts, ends, rows = words(data, offsets, ALNUM)
    bounds = row_bounds(rows, n)
    hashes = hasher.ranges(hasher.prefix(data), starts, ends)
    change = np.zeros(len(starts) + 1, np.int64)
    found: dict[int, set[str]] = {}
    for length in index.hashes:
        keys = _windows(hasher, hashes, length)
        for i in index.candidates(length, keys).tolist():
            if rows[i] != rows[i + length - 1]:
                continue
            own = b" ".join(data[starts[j]:ends[j]].tobytes() for j in range(i, i + length))
            items = index.items.get((length, own))
            if items is not None:
                change[i] += 1
                change[i + length] -= 1
                found.setdefault(int(rows[i]), set()).update(items)
    for r, old in enumerate(earlier):
        if old.is_valid:
            old = old.as_py()
            for a, b in zip(old["word_starts"], old["word_ends"], strict=True):
                change[bounds[r] + a] += 1
                change[bounds[r] + b] -= 1
            found.setdefault(r, set()).update(old["items"])
    hit = np.cumsum(change)[:-1] > 0
    out = []
    for r in range(n):
        lo, hi = int(bounds[r]), int(bounds[r + 1])
        own = hit[lo:hi]
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8)))
            a, b = edge[::2], edge[1::2]
            spans = (a, b, starts[lo + a] - offsets[r], ends[lo + b - 1] - offsets[r])
        else:
            spans = ([], [], [], [])
        out.append({"n_words": hi - lo, "n_hit": int(own.sum()), "items": sorted(found.get(r, ())), **{
            k: [int(v) for v in s] for k, s in zip(("word_starts", "word_ends", "byte_starts", "byte_ends"), spans, strict=True)}})
    return out


def contaminated(hits: str, share: int = HIT_SHARE):
    return F.expr(f"{hits}.n_hit > 0 and {share} * {hits}.n_hit >= {hits}.n_words")


def remove_documents(docs: DataFrame, benchmark: DataFrame, share: int = HIT_SHARE) -> DataFrame:
    """The documents that the rule does not call contaminated, with their own columns."""
    scanned = scan(docs, item_windows(benchmark))
    name = scanned.columns[-1]
    return scanned.where(~contaminated(name, share)).select(*docs.columns)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every hit run of words cut out of the text."""
    scanned = scan(docs, item_windows(benchmark), text)
    name = scanned.columns[-1]

    @F.pandas_udf("string")
    def cut(texts, hits):
        import pandas as pd

        def one(text, starts, ends):
            if text is None or not len(starts):
                return text
            raw, at, kept = text.encode(), 0, []
            for a, b in zip(starts, ends, strict=True):
                kept.append(raw[at:a])
                at = b
            return b"".join([*kept, raw[at:]]).decode()

        return pd.Series([one(t, a, b) for t, a, b in zip(texts, hits["byte_starts"], hits["byte_ends"], strict=True)], dtype=object)

    return scanned.withColumn(text, cut(text, name)).select(*docs.columns)


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
