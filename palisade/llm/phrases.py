"""Phrases whose words stand together more often than by chance, found by Misra-Gries summaries and counted exactly afterwards.

Texts are lower-cased (A-Z), cut at punctuation and line ends into pieces, and pieces into words; everything is per language. N-grams are
hashed, and the hash deals them to parts. Each task sends what it counted to the n-grams' parts; a part merges these into one Misra-Gries
summary whose capacity exceeds its mass divided by the threshold, so that whatever occurs as often as the threshold is in it. First words
and pairs are summed up so; then the longer n-grams all of whose pairs survived. A second reading counts the survivors by their text and
lets the false ones go.

The summaries' survivors are broadcast as one bit filter per part, of FILTER_BYTES together at most; what a full filter lets through
besides is counted and dropped like any false survivor. Equal 64-bit hashes of different n-grams are taken not to meet among the
survivors. Counts, products and quotients are exact decimals.

A null text is empty, a null language counts as `und`. Empty texts, repeated rows and texts of any length are defined alike: a long text
is read in chunks that carry over the last words. Without words there is no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import LOWER, SLICE_BYTES, Hasher, bounded_batches, mix, text_slices, words, written

#: Bytes of text that stand behind one part, and the least and most parts (powers of two).
PART_BYTES, LEAST_PARTS, MOST_PARTS = 32 << 20, 64, 1 << 16
#: Counters of a summary for each time the threshold goes into its mass: above 1 every frequent n-gram survives, more spare false ones.
COUNTERS = 4
#: N-grams that a task counts before it sends them, and distinct phrases that it holds while counting exactly.
FLUSH, HELD = 1 << 21, 200_000
#: Bytes of all filters together, and bits for each survivor while they fit.
FILTER_BYTES, FILTER_BITS = 64 << 20, 16
#: Keys of a language's rows while the first of each are chosen.
SALTS = 64

#: Bytes that end a piece, and bytes of words.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_WORD = ~_ENDS
_WORD[[32, 9]] = False

_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Chunk:
    """Words of some texts: lower-cased bytes, first and last byte, row, piece; the first `skip` are context that was counted before."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    pieces: np.ndarray
    skip: int = 0


def chunks(column: pa.Array, longest: int) -> Iterator[Chunk]:
    for first, end, data, offsets in text_slices(column):
        if end - first > 1 or len(data) <= 2 * SLICE_BYTES:
            low = LOWER[data]
            starts, ends, rows = words(low, offsets, _WORD)
            yield Chunk(low, starts, ends, rows + first, np.cumsum(_ENDS[low])[starts])
            continue
        lo = context = 0
        while lo < len(data):
            hi = min(len(data), lo + SLICE_BYTES)
            while hi < len(data):  # to the end of a word
                gap = np.flatnonzero(~_WORD[data[hi:hi + SLICE_BYTES]])
                hi = min(len(data), hi + SLICE_BYTES) if not len(gap) else hi + int(gap[0])
                if len(gap):
                    break
            low = LOWER[data[context:hi]]
            starts, ends, rows = words(low, np.array([0, len(low)]), _WORD)
            yield Chunk(low, starts, ends, rows + first, np.cumsum(_ENDS[low])[starts], int(np.searchsorted(starts, lo - context)))
            if longest > 1:
                context = context + int(starts[-min(longest - 1, len(starts))]) if len(starts) else hi
            else:
                context = hi
            lo = hi


class Filter:
    """Bits of the surviving n-grams, one segment per part: whether a hash may have survived."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        self.bits, parts = bits, 1 << bits
        sizes = np.array([len(segments.get(p, b"")) * 8 for p in range(parts)], np.uint64)
        self.begin = np.concatenate(([0], np.cumsum(sizes)))[:-1].astype(np.uint64)
        self.mask = np.where(sizes > 0, sizes - np.uint64(1), np.uint64(0)).astype(np.uint64)
        self.empty = sizes == 0
        self.data = np.frombuffer(b"".join(segments.get(p, b"") for p in range(parts)) or b"\0", np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), bool)
        part, key = split_hash(hashes, self.bits)
        at = np.flatnonzero(~self.empty[part])
        for k in range(3):
            bit = self.begin[part[at]] + (_probe(key[at], k) & self.mask[part[at]])
            at = at[(self.data[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        out[at] = True
        return out


def _probe(keys: np.ndarray, k: int) -> np.ndarray:
    wide = keys.astype(np.uint64)
    return wide if not k else (wide * _STEP) >> np.uint64(8 + 16 * k)


def segment(keys: np.ndarray, most: int) -> bytes:
    """The bits of a part's surviving keys, in at most `most` bytes (a power of two of bits)."""
    bits = 64
    while bits < FILTER_BITS * len(keys) and bits * 2 <= max(64, most * 8):
        bits *= 2
    out = np.zeros(bits, np.uint8)
    for k in range(3):
        out[(_probe(keys, k) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def split_hash(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The part, and the 32 bits that stand for the n-gram in it."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), (hashes >> np.uint64(32 - bits)).astype(np.uint32)


class Grams:
    """Hashes of the n-grams of a task's chunks."""

    def __init__(self) -> None:
        self.hasher = Hasher(5)
        self.seeds: dict[str, np.uint64] = {}

    def seed(self, lang: str) -> np.uint64:
        if lang not in self.seeds:
            self.seeds[lang] = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        return self.seeds[lang]

    def of(self, chunk: Chunk, seeds: np.ndarray, longest: int, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Length, first words and hashes of the n-grams up to `longest`; those of three words and more only where all pairs survived."""
        n = len(chunk.starts)
        if not n:
            return
        sums = self.hasher.prefix(chunk.data)
        one = mix(self.hasher.ranges(sums, chunk.starts, chunk.ends) ^ seeds[chunk.rows])
        new = np.arange(n)
        yield 1, new[chunk.skip:], one[chunk.skip:]
        joined = (chunk.rows[1:] == chunk.rows[:-1]) & (chunk.pieces[1:] == chunk.pieces[:-1])
        at = np.flatnonzero(joined)
        hashes = mix(one[at] * _STEP + one[at + 1])
        counted = at + 1 >= chunk.skip
        yield 2, at[counted], hashes[counted]
        if longest > 2:
            pairs = np.zeros(n, bool)
            pairs[at] = filters[0].holds(hashes)
            keep = pairs[at]
            at, hashes = at[keep], hashes[keep]
            for length in range(3, longest + 1):
                keep = pairs[np.minimum(at + length - 2, n - 1)] & (at + length - 1 < n)
                at, hashes = at[keep], hashes[keep]
                hashes = mix(hashes * _STEP + one[at + length - 1])
                counted = at + length - 1 >= chunk.skip
                yield length, at[counted], hashes[counted]


def _seeds(grams: Grams, column: pa.Array) -> np.ndarray:
    return np.array([grams.seed(lang) for lang in column.to_pylist()], np.uint64)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of an array, from each bound to the next, as binary values."""
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


_SENT = "part int, kind int, mass long, keys binary, counts binary"


def _sent(docs: DataFrame, lengths: range, longest: int, bits: int, shared) -> DataFrame:
    """N-grams of these lengths as each task counted them, by part: first a row of the part's mass, then rows of keys and counts."""

    def batch(part, kind: int, mass, keys: pa.Array, counts: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(part, pa.int32()), pa.array(np.full(len(part), kind, np.int32)), pa.array(mass, pa.int64()), keys, counts],
            names=["part", "kind", "mass", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, filters = Grams(), shared.value
        mass = np.zeros(1 << bits, np.int64)
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            hashes = np.sort(np.concatenate(held))
            heads = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            counts = np.diff(np.append(heads, len(hashes))).astype(np.uint32)
            part, keys = split_hash(hashes[heads], bits)
            mass[:] += np.bincount(part, counts, 1 << bits).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            bounds = np.append(cuts, len(part))
            return batch(part[cuts], 1, np.zeros(len(cuts), np.int64), _binary(keys, bounds), _binary(counts, bounds))

        for rows in batches:
            seeds = _seeds(grams, rows.column(1))
            for chunk in chunks(rows.column(0), longest):
                for length, _, hashes in grams.of(chunk, seeds, lengths[-1], filters):
                    if length in lengths and len(hashes):
                        held.append(hashes)
                        size += len(hashes)
                if size > FLUSH:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()
        part = np.flatnonzero(mass)
        none = pa.nulls(len(part), pa.binary())
        yield batch(part, 0, mass[part], none, none)

    return docs.select("text", "lang").mapInArrow(run, _SENT)


class Summary:
    """A Misra-Gries summary: counts are too low by `error` at most, which stays below mass / capacity."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def merge(self, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Add the counts of other summaries; beyond the capacity, take the largest count left out from all."""
        every, sums = np.concatenate([self.keys, *keys]), np.concatenate([self.counts, *counts])
        order = np.argsort(every, kind="stable")
        every, sums = every[order], sums[order]
        heads = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
        every, sums = every[heads], np.add.reduceat(sums, heads) if len(heads) else sums
        if len(sums) > self.capacity:
            at = len(sums) - self.capacity - 1
            cut = int(np.partition(sums, at)[at])
            sums = sums - cut
            self.error += cut
            every, sums = every[sums > 0], sums[sums > 0]
        self.keys, self.counts = every, sums

    def survivors(self, threshold: int) -> np.ndarray:
        return self.keys[self.counts + self.error >= threshold]


def _survivors(sent: DataFrame, bits: int, threshold: int, most: int) -> Filter:
    """The filter of all n-grams that may occur `threshold` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = -1, 0, None
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        pending = 0

        def done() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                summary.merge(keys, counts)
                left = summary.survivors(threshold)
                if len(left):
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([segment(left, most)])], names=["part", "bits"])

        for batch in batches:
            columns = [batch.column(k) for k in range(5)]
            for i, (own, kind) in enumerate(zip(columns[0].to_pylist(), columns[1].to_pylist(), strict=True)):
                if own != part:
                    yield from done()
                    part, mass, summary, keys, counts, pending = own, 0, None, [], [], 0
                if not kind:
                    mass += columns[2][i].as_py()
                    continue
                if summary is None:  # all rows of the part's mass have come
                    summary = Summary(COUNTERS * (mass // threshold) + 1)
                keys.append(np.frombuffer(columns[3][i].as_py(), np.uint32))
                counts.append(np.frombuffer(columns[4][i].as_py(), np.uint32))
                pending += len(keys[-1])
                if pending > max(summary.capacity, 1 << 16):
                    summary.merge(keys, counts)
                    keys, counts, pending = [], [], 0
        yield from done()

    dealt = sent.repartition(1 << bits, "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(run, "part int, bits binary")
    # FILTER_BYTES at most, by the size of a segment
    return Filter(bits, {r["part"]: bytes(r["bits"]) for r in found.collect()})


_LISTS = "part int, lang string, phrases string, times binary"


def _lists(docs: DataFrame, longest: int, bits: int, shared) -> DataFrame:
    """Survivors as each task counted them, one row for each part and language: phrases, one a line, and their times. The empty phrase
    stands for all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, filters = Grams(), shared.value
        texts: dict[int, tuple[str, bytes]] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        totals: dict[str, int] = {}

        def batch(found: Iterator[tuple[int, str, bytes, int]]) -> pa.RecordBatch:
            lists: dict[tuple[int, str], tuple[list[bytes], list[int]]] = {}
            for part, lang, phrase, n in found:
                own = lists.setdefault((part, lang), ([], []))
                own[0].append(phrase)
                own[1].append(n)
            columns = [
                pa.array([part for part, _ in lists], pa.int32()), pa.array([lang for _, lang in lists], pa.string()),
                pa.array([b"\n".join(phrases).decode() for phrases, _ in lists.values()], pa.string()),
                pa.array([np.array(times, np.int64).tobytes() for _, times in lists.values()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "lang", "phrases", "times"])

        def joined() -> tuple[np.ndarray, np.ndarray]:
            every, inverse = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
            return every, np.bincount(inverse, np.concatenate([c for _, c in held])).astype(np.int64)

        def summed() -> pa.RecordBatch:
            every, times = joined()
            parts = split_hash(every, bits)[0]
            return batch((part, *texts[h], n) for part, h, n in zip(parts.tolist(), every.tolist(), times.tolist(), strict=True))

        for rows in batches:
            langs = rows.column(1).to_pylist()
            seeds = _seeds(grams, rows.column(1))
            for chunk in chunks(rows.column(0), longest):
                hits: list[tuple[int, np.ndarray, np.ndarray]] = []
                for length, at, hashes in grams.of(chunk, seeds, longest, filters):
                    if length == 1:
                        for row, n in zip(*np.unique(chunk.rows[at], return_counts=True), strict=True):
                            totals[langs[row]] = totals.get(langs[row], 0) + int(n)
                    kept = filters[length > 2].holds(hashes)
                    hits.append((length, at[kept], hashes[kept]))
                if not hits:
                    continue
                at = np.concatenate([a for _, a, _ in hits])
                lengths = np.repeat([n for n, _, _ in hits], [len(a) for _, a, _ in hits])
                every, first, times = np.unique(np.concatenate([h for *_, h in hits]), return_index=True, return_counts=True)
                held.append((every, times))
                raw: bytes | None = None
                for h, i in zip(every.tolist(), first.tolist(), strict=True):
                    if h not in texts:
                        raw = chunk.data.tobytes() if raw is None else raw
                        word = int(at[i])
                        spelled = raw[chunk.starts[word]:chunk.ends[word + int(lengths[i]) - 1]]
                        texts[h] = (langs[chunk.rows[word]], b" ".join(spelled.split()))
                if len(texts) > HELD:
                    yield summed()
                    texts, held = {}, []
                elif len(held) > 64:
                    held = [joined()]
        if held:
            yield summed()
        yield batch((int(grams.seed(lang)) >> (64 - bits), lang, b"", n) for lang, n in totals.items())

    return docs.select("text", "lang").mapInArrow(run, _LISTS)


def _summed(lists: DataFrame, bits: int, threshold: int) -> DataFrame:
    """Lists of the same part and language added up by their phrases' text: lang, phrase, n_words, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}
        key: tuple | None = None

        def done() -> pa.RecordBatch:
            kept = [(phrase, n) for phrase, n in sums.items() if n >= threshold or not phrase]
            columns = [pa.array([key[1]] * len(kept), pa.string()), pa.array([phrase for phrase, _ in kept], pa.string()),
                       pa.array([phrase.count(" ") + 1 if phrase else 0 for phrase, _ in kept], pa.int32()),
                       pa.array([n for _, n in kept], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n_words", "times"])

        for batch in batches:
            for part, lang, phrases, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, lang) != key:
                    if sums:
                        yield done()
                    key, sums = (part, lang), {}
                for phrase, n in zip(phrases.split("\n"), np.frombuffer(times, np.int64).tolist(), strict=True):
                    sums[phrase] = sums.get(phrase, 0) + n
        if sums:
            yield done()

    dealt = lists.repartition(1 << bits, "part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(run, "lang string, phrase string, n_words int, times long")


def frequent(docs: DataFrame, threshold: int = 100, longest: int = 5, text: str = "text", lang: str = "lang") -> DataFrame:
    """N-grams of up to `longest` words that occur at least `threshold` times in their language, and each language's words (n_words 0):
    lang, phrase, n_words, times."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    n_bytes = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = LEAST_PARTS
    while parts < MOST_PARTS and parts * PART_BYTES < n_bytes:
        parts *= 2
    bits, most = parts.bit_length() - 1, FILTER_BYTES // 2 // parts
    filters: list[Filter] = []
    for lengths in (range(1, 3), range(3, longest + 1)):
        if len(lengths):
            shared = spark.sparkContext.broadcast(filters)
            filters = [*filters, _survivors(_sent(docs, lengths, longest, bits, shared), bits, threshold, most)]
    return _summed(_lists(docs, longest, bits, spark.sparkContext.broadcast(filters)), bits, threshold)


def association(a: str, n: str, left: str, right: str) -> Column:
    """floor(1000 * a * n / (l * r)) of these columns, exactly."""
    wide = lambda c, digits: f"cast({c} as decimal({digits}, 0))"
    return F.expr(f"{wide(f'{a} * 1000L', 19)} * {wide(n, 18)} div ({wide(left, 18)} * {wide(right, 18)})")


def mine(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r the two parts of its worst cut, n the language's words. A phrase inside a longer one that occurs as often
    is left out.
    """
    counts = written(frequent(docs, threshold, longest, text, lang))
    # a language may hold most phrases: its row of totals goes to as many keys
    totals = counts.where("n_words = 0").select("lang", F.col("times").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    grams = counts.where("n_words > 0")
    # a longer phrase that occurs as often has a part, one word shorter than itself, that does so as well, down to the phrase
    shorter = F.explode(F.array(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1)))
    within = grams.where("n_words > 2").select("lang", "times", F.split("phrase", " ").alias("w")).select(
        "lang", "times", shorter.alias("w")).select("lang", F.array_join("w", " ").alias("phrase"), "times")
    phrases = grams.where("n_words > 1").join(within, ["lang", "phrase", "times"], "left_anti")
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")
    cut = phrases.select("lang", "phrase", F.col("times").alias("a"), salt.alias("salt"), F.split("phrase", " ").alias("w")).select(
        "*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "salt", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest"))
    left = grams.select("lang", F.col("phrase").alias("first"), F.col("times").alias("l"))
    right = grams.select("lang", F.col("phrase").alias("rest"), F.col("times").alias("r"))
    scored = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, ["lang", "salt"]).withColumn(
        "score", association("a", "n", "l", "r"))
    worst = scored.groupBy("lang", "salt", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    rows = worst.select("lang", "salt", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
