"""MinHash near-duplicates with odd sketches.

Documents of equal shingle sets are one class from the start. Bands of MinHash values name buckets; the MinHash samples of a class are
also folded into a parity bitmap (odd sketch), and the population count of two bitmaps' XOR estimates a high similarity precisely
enough to leave out hopeless candidates and to try the most promising first. Every link is confirmed on the full shingle sets.

First each class is compared with the smallest class of each of its buckets, best estimate first confirmed, which joins most of
a group with few comparisons. Then what remains of each bucket, classes of different components, is compared in blocks, bitmap
against bitmap and then set against set, so no candidate is left out and no pair is written out but the links that join components.

A null text, and a text without words, has an empty set and is linked with nothing. Rows that repeat an id are separate rows of the
same id. A row without an id is named by the smallest id it reaches; if there is none its component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import BLANK, Hasher, LOWER, bounded_batches, fresh, mix, row_bounds, signed, text_slices, words, written
from palisade.llm.components import components

#: Words of a shingle, similarity of a link in percent, bands and MinHash values of a band. A pair of the least similarity that
#: links, 0.8, misses all 32 bands with a chance of 3 in a million.
SHINGLE, PERCENT = 5, 80
BANDS, BAND_ROWS = 32, 5
#: 64-bit words of an odd sketch. At a similarity of 0.8 the estimate from 160 samples has a standard error of about 0.035;
#: candidates estimated this far below the threshold are left out.
SKETCH_WORDS, MARGIN = 8, 0.2
#: Classes of a block when a bucket's components are compared.
BLOCK = 512

_FEATURES = "n_shingles long, set_key binary, sketch array<long>, bands array<long>"


class Shingler:
    """Shingle sets of texts, as sorted 64-bit hashes."""

    def __init__(self, size: int, seed: int = 11):
        self.size, self.hasher = size, Hasher(seed)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        data = LOWER[data]
        starts, ends, rows = words(data, offsets, ~BLANK)
        own = self.hasher.ranges(self.hasher.prefix(data), starts, ends)
        n = len(offsets) - 1
        bounds = row_bounds(rows, n)
        grams = np.zeros(max(0, len(own) - self.size + 1), np.uint64)
        for k in range(self.size):
            grams += own[k:k + len(grams)] * self.hasher.power[k + 1]
        grams = mix(grams)
        out = []
        for i in range(n):
            lo, hi = int(bounds[i]), int(bounds[i + 1])
            if hi - lo >= self.size:
                out.append(np.unique(grams[lo:hi - self.size + 1]))
            elif hi > lo:  # the whole sequence is the one shingle
                out.append(mix(np.array([sum(int(h) * pow(31, k + 1, 1 << 64) for k, h in enumerate(own[lo:hi])) + hi - lo & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def _set_keys(sets: list[np.ndarray]) -> list[bytes | None]:
    """Sixteen bytes that name a set; None for the empty one."""
    return [
        np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]).tobytes() if len(s) else None
        for s in sets
    ]


def _minima(sets: list[np.ndarray], factors: np.ndarray) -> np.ndarray:
    """MinHash values: one row per non-empty set."""
    full = [s for s in sets if len(s)]
    if not full:
        return np.zeros((0, len(factors)), np.uint64)
    flat = np.concatenate(full)
    at = np.cumsum([0, *map(len, full[:-1])])
    out = np.empty((len(full), len(factors)), np.uint64)
    for k, f in enumerate(factors):
        out[:, k] = np.minimum.reduceat(flat * f, at)
    return out


def signatures(docs: DataFrame, text: str, keep: list[str], shingle: int) -> DataFrame:
    """The `keep` columns with the set size, set key, odd sketch and band keys of each row's text."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col(text).alias("__text"))
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        samples = BANDS * BAND_ROWS
        factors = np.random.default_rng(23).integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        weights = np.random.default_rng(29).integers(0, 1 << 63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salts = np.random.default_rng(31).integers(0, 1 << 64, samples, dtype=np.uint64)
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(len(keep))):
                sets = shingler.sets(data, offsets)
                low = _minima(sets, factors)
                bands = mix((mix(low).reshape(-1, BANDS, BAND_ROWS) * weights).sum(2, dtype=np.uint64) + salts[:BANDS])
                bits = mix(low ^ salts) >> np.uint64(64 - (64 * SKETCH_WORDS).bit_length() + 1)
                sketch = np.zeros((len(low), SKETCH_WORDS), np.uint64)
                for k in range(samples):
                    sketch[np.arange(len(low)), (bits[:, k] >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bits[:, k] & np.uint64(63))
                full = iter(range(len(low)))
                at = [next(full) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(k).slice(first, end - first) for k in range(len(keep))),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(_set_keys(sets), pa.binary()),
                    _lists(signed(sketch), at), _lists(signed(bands), at),
                ], names=[*keep, "n_shingles", "set_key", "sketch", "bands"])

    return slim.mapInArrow(run, ", ".join([*head, _FEATURES]))


def _lists(values: np.ndarray, at: list[int | None]) -> pa.Array:
    ends = np.cumsum([0, *(0 if i is None else values.shape[1] for i in at)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.ravel()))


def estimate(a: str, b: str) -> Column:
    """Similarity by the odd sketches' differing bits."""
    bits, samples = 64.0 * SKETCH_WORDS, BANDS * BAND_ROWS
    differ = f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return F.expr(f"1 + {bits} / (4 * {samples}) * ln(greatest(1 - 2 * {differ} / {bits}, 1e-9))")


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class keys whose full sets reach the threshold; texts: set_key, text, one row per class."""
    left = pairs.join(texts.select(F.col("set_key").alias("a"), F.col("__text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("set_key").alias("b"), F.col("__text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                sides = []
                for side in (2, 3):
                    sets: list[np.ndarray] = []
                    for _, _, data, offsets in text_slices(part.column(side)):
                        sets += shingler.sets(data, offsets)
                    sides.append(sets)
                keep = [_similar(x, y, percent) for x, y in zip(*sides, strict=True)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _blocks(members: DataFrame) -> DataFrame:
    """Pairs of blocks of the same bucket: rows (bucket, rows, rows_b, same), blocks of about BLOCK classes."""
    blocks = members.groupBy("bucket", "part").agg(F.collect_list(F.struct(*(c for c in members.columns if c not in ("bucket", "part")))).alias("rows"))
    other = blocks.select("bucket", F.col("part").alias("part_b"), F.col("rows").alias("rows_b"))
    return blocks.join(other, "bucket").where("part <= part_b").select("bucket", "rows", "rows_b", (F.col("part") == F.col("part_b")).alias("same"))


def _promising(bucket: int, a: dict, b: dict, same: bool, floor: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each class of block a the classes of b in other components whose bitmaps pass; a pair only in its first common bucket."""
    bits, samples = 64 * SKETCH_WORDS, BANDS * BAND_ROWS
    most = bits / 2 * (1 - np.exp((floor - 1) * 4 * samples / bits))  # differing bits at the floor
    band = (a["bands"] == bucket).argmax(1)
    for x in range(len(a["key"])):
        good = (np.bitwise_count(b["sketch"] ^ a["sketch"][x]).sum(1) <= most) & (b["component"] != a["component"][x])
        if same:
            good[: x + 1] = False
        near = np.flatnonzero(good)
        near = near[~(b["bands"][near, : band[x]] == a["bands"][x, : band[x]]).any(1)]
        if len(near):
            yield x, near


def _block(column: pa.Array, i: int) -> dict:
    rows = column[i].values
    wide = {c: rows.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for c in ("sketch", "bands")}
    return {"key": rows.field("set_key").to_pylist(), "component": np.array(rows.field("component").to_pylist(), object),
            "sketch": wide["sketch"].view(np.uint64), "bands": wide["bands"], "rows": rows}


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, floor: float, shingle: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components that share a bucket: as many as join what a task has found to belong together.

    members: bucket, set_key, component. The bitmaps first tell which classes have a promising partner at all; only those come back with
    their texts, and promising pairs are confirmed where the blocks meet, so pairs are never rows.
    """
    mixed = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    mixed = mixed.where("lo <> hi").select("bucket", F.ceil(F.col("n") / BLOCK).cast("long").alias("parts"))
    split = members.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts"))).drop("parts")
    split = written(split.join(classes.select("set_key", "sketch", "bands"), "set_key"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, a, b = batch.column(0)[i].as_py(), _block(batch.column(1), i), _block(batch.column(2), i)
                used: set[bytes] = set()
                for x, near in _promising(bucket, a, b, batch.column(3)[i].as_py(), floor):
                    used.add(a["key"][x])
                    used.update(b["key"][y] for y in near.tolist())
                yield pa.RecordBatch.from_pydict({"bucket": [bucket] * len(used), "set_key": sorted(used)}, schema=pa.schema([
                    ("bucket", pa.int64()), ("set_key", pa.binary())]))

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(shingle)
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, a, b = batch.column(0)[i].as_py(), _block(batch.column(1), i), _block(batch.column(2), i)
                sets = []
                for side in (a, b):
                    own: list[np.ndarray] = []
                    for _, _, data, offsets in text_slices(side["rows"].field("text")):
                        own += shingler.sets(data, offsets)
                    sets.append(own)
                root: dict[bytes, bytes] = {}

                def top(c: bytes, root=root) -> bytes:
                    while root.get(c, c) != c:
                        c = root[c]
                    return c

                links: list[list[bytes]] = [[], []]
                for x, near in _promising(bucket, a, b, batch.column(3)[i].as_py(), floor):
                    for y in near.tolist():
                        one, two = top(a["component"][x]), top(b["component"][y])
                        if one != two and _similar(sets[0][x], sets[1][y], percent):
                            root[max(one, two)] = min(one, two)
                            links[0].append(a["key"][x])
                            links[1].append(b["key"][y])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()) for k in links], names=["a", "b"])

    needed = _blocks(split).mapInArrow(mark, "bucket long, set_key binary").distinct()
    again = split.join(needed, ["bucket", "set_key"]).join(texts.withColumnRenamed("__text", "text"), "set_key")
    return _blocks(again).mapInArrow(confirm, "a binary, b binary")


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    least = percent * (len(x) + len(y))
    if (100 + percent) * min(len(x), len(y)) < least:
        return False
    return (100 + percent) * len(np.intersect1d(x, y, assume_unique=True)) >= least


def classes_and_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                      percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, set_key, and group: the smallest set key it is linked with, its own if none."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("__text"))
    rows = written(signatures(source, "__text", ["doc_id", "text_hash"], shingle))
    first = F.min(F.struct("doc_id", "text_hash"))
    classes = written(rows.where("n_shingles > 0").groupBy("set_key").agg(
        first.alias("first"), F.any_value("sketch").alias("sketch"), F.any_value("bands").alias("bands")))
    floor = percent / 100 - MARGIN

    # Buckets of two classes or more, and the smallest class of each.
    banded = classes.select("set_key", F.explode("bands").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("set_key").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = written(banded.join(hubs, "bucket"))
    sketches = classes.select("set_key", "sketch")
    stars = members.where("set_key <> hub").select(F.col("set_key").alias("a"), F.col("hub").alias("b")).distinct()
    stars = (
        stars.join(sketches.select(F.col("set_key").alias("a"), F.col("sketch").alias("sketch_a")), "a")
        .join(sketches.select(F.col("set_key").alias("b"), F.col("sketch").alias("sketch_b")), "b")
        .select("a", "b", estimate("sketch_a", "sketch_b").alias("e")).where(F.col("e") >= floor)
    )
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("e", "b")).alias("b"))

    candidates = members.select("set_key").distinct()
    texts = candidates.join(classes, "set_key").select("set_key", F.col("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    texts = source.join(texts, (F.col("text_hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    texts = written(texts.select("set_key", "__text").dropDuplicates(["set_key"]))
    linked = written(_confirmed(best, texts, shingle, percent))
    placed = components(linked)

    labels = members.select("bucket", "set_key").join(placed, F.col("set_key") == F.col("node"), "left").select(
        "bucket", "set_key", F.coalesce("component", "set_key").alias("component"))
    more = _across(labels, classes, texts, floor, shingle, percent)
    placed = components(linked.union(more))
    return rows.select("doc_id", "text_hash", "n_shingles", "set_key").join(
        placed.select(F.col("node").alias("set_key"), "component"), "set_key", "left"
    ).withColumn("group", F.coalesce("component", "set_key")).drop("component")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable), kept (whether the row has that id)."""
    rows = written(classes_and_links(docs, doc_id, text, shingle, percent))
    least = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("doc_id").alias("least"))
    return rows.join(least, "group", "left").select(
        "doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents without all but one of each group: the row with the smallest id. Rows without words all stay."""
    rows = classes_and_links(docs, doc_id, text, shingle, percent)
    chosen = rows.where(F.col("group").isNotNull()).groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    number, hashed, one_id, one_hash = fresh(docs, "number", "hashed", "one_id", "one_hash")
    chosen = chosen.select(F.col("first.doc_id").alias(one_id), F.col("first.text_hash").alias(one_hash))
    hashes = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    blank = ~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    full = hashes.where(~blank).join(chosen, (F.col(hashed) == F.col(one_hash)) & F.col(doc_id).eqNullSafe(F.col(one_id)))
    repeats = Window.partitionBy(hashed, doc_id).orderBy(F.lit(1))
    once = full.withColumn(number, F.row_number().over(repeats)).where(F.col(number) == 1)
    return once.select(*docs.columns).unionByName(docs.where(blank))
