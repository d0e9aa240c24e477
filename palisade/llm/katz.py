"""Katz backoff language model of words: Good-Turing discounted bigrams over discounted unigrams, exactly normalised.

p(w | v) = r*(vw) / c(v) for a bigram seen in training, else bow(v) p(w), where r* is the Good-Turing count (counts above `CUT` only
give up the one part that keeps every context's mass below 1), and bow(v) makes the sum over all words, and one unknown word, 1 to
the last bit of the sums: (1 - sum of seen p) / (1 - sum of the same words' p). Unigrams are discounted alike, and what they leave is
the unknown word's.

Texts go through the tasks in blocks of a bounded number of tokens. A block sends every distinct word and bigram once, with its
training count, to the partition of the key's hash; there counts are summed, and each block gets the sums back in the order it
asked. So a frequent key costs a row per block, however often it occurs, and no table of words or bigrams is ever whole in one
place. The block then scores its texts; what it cannot know, the backoff weights of contexts before unseen bigrams, is joined from
the context table.

A null text is empty: it has one token, the end. Repeated rows are scored each on its own, and each is learned from. A null id
counts as empty text for the split. With no training text every word is the unknown one.

The blocks are cut twice, once to count and once to score, and must come out alike: the frame must give the same rows in the same
partitions each time it is read, as a table on disk does. A difference is found by the blocks' checksums and stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import BLANK, Hasher, LOWER, bounded_batches, mix, signed, text_slices, words, written

#: Tokens of a block, bytes of text for each partition of the keys, and the largest count that Good-Turing changes.
BLOCK_TOKENS = 1_000_000
PART_BYTES = 8 << 20
CUT = 5
#: The token that ends a text, and the context before its first word; no word hashes are fixed to these by more than chance.
END, BEGIN = np.uint64(0xE17D000000000001), np.uint64(0xB361000000000001)


def _joined(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(word))


class Block:
    """Tokens of some texts: word hashes with the end token after each text, and which texts are learned from."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, learn: np.ndarray):
        self.sizes, self.learn = sizes, learn
        self.words, self.index = np.unique(tokens, return_inverse=True)
        self.index = self.index.astype(np.uint32)

    def before(self) -> np.ndarray:
        tokens = self.words[self.index]
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[np.cumsum(self.sizes) - self.sizes] = BEGIN
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct bigram keys and each token's place among them."""
        return np.unique(_joined(self.before(), self.words[self.index]), return_inverse=True)

    def training(self) -> np.ndarray:
        return np.repeat(self.learn, self.sizes)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array], Block]]:
    """Number, id columns and tokens of each block of a partition; batches hold id, learn, text."""
    hasher, base, number = Hasher(3), TaskContext.get().partitionId() << 32, 0
    ids: list[pa.Array] = []
    tokens: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    learn: list[np.ndarray] = []
    held = 0

    def block() -> tuple[int, list[pa.Array], Block]:
        return base + number, ids, Block(np.concatenate(tokens), np.concatenate(sizes), np.concatenate(learn))

    for batch in batches:
        for first, end, data, offsets in text_slices(batch.column(2)):
            data = LOWER[data]
            starts, ends, rows = words(data, offsets, ~BLANK)
            hashes = hasher.ranges(hasher.prefix(data), starts, ends)
            count = np.bincount(rows, minlength=end - first) + 1
            out = np.full(int(count.sum()), END)
            out[np.arange(len(rows)) + rows] = hashes
            ids.append(batch.column(0).slice(first, end - first))
            tokens.append(out)
            sizes.append(count)
            learn.append(batch.column(1).slice(first, end - first).to_numpy(zero_copy_only=False))
            held += len(out)
            if held > BLOCK_TOKENS:
                yield block()
                ids, tokens, sizes, learn, held, number = [], [], [], [], 0, number + 1
    if tokens:
        yield block()


def _parts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of `parts` equal ranges of hashes begins among sorted keys; one more entry ends the last."""
    edges = np.array([((1 << 64) * k // parts) for k in range(parts)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


_REQUEST = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _requests(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, block in _blocks(batches):
            training = block.training()
            keys, index = block.keys()
            for kind, own, at in ((1, block.words, block.index), (2, keys, index)):
                counts = np.bincount(at[training], minlength=len(own)).astype(np.uint32)
                cuts = _parts(own, parts)
                for p in range(parts):
                    a, b = int(cuts[p]), int(cuts[p + 1])
                    if a < b:
                        yield pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(
                            (kind, p, number, own[a:b].tobytes(), counts[a:b].tobytes()), _REQUEST, strict=True)], schema=_REQUEST)

    return run


def _sum_part(key: tuple, group: pa.Table) -> pa.Table:
    """Sum the counts of a partition's keys; answer each block with the sums, and say which block answers for a key's context."""
    blocks = group.column("block").to_pylist()
    keys = [np.frombuffer(b, np.uint64) for b in group.column("keys").to_pylist()]
    own = [np.frombuffer(b, np.uint32) for b in group.column("counts").to_pylist()]
    flat = np.concatenate(own)
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(inverse, flat, len(every)).astype(np.int64)
    seen = np.flatnonzero(flat > 0)
    answering = np.zeros(len(flat), bool)
    _, first = np.unique(inverse[seen], return_index=True)
    answering[seen[first]] = True
    known = totals[totals > 0]
    facts = [int(len(known)), int(known.sum()), *(int((known == r).sum()) for r in range(1, CUT + 2))]
    at = np.cumsum([0, *map(len, keys)])
    n = len(blocks)
    return pa.table({
        "kind": pa.array([key[0].as_py()] * n, pa.int32()), "part": pa.array([key[1].as_py()] * n, pa.int32()), "block": pa.array(blocks, pa.int64()),
        "counts": [totals[inverse[a:b]].astype(np.uint32).tobytes() if totals.max(initial=0) < 1 << 32 else totals[inverse[a:b]].tobytes()
                   for a, b in zip(at, at[1:], strict=False)],
        "size": pa.array(np.diff(at), pa.int64()),
        "answers": [np.packbits(answering[a:b]).tobytes() for a, b in zip(at, at[1:], strict=False)],
        "facts": pa.array([facts, *[None] * (n - 1)], pa.list_(pa.int64())),
    })


_ANSWER = "kind int, part int, block long, counts binary, size long, answers binary, facts array<long>"


class Discounts:
    """Good-Turing counts r* from how many keys occur 1, 2, ... CUT + 1 times."""

    def __init__(self, types: int, tokens: int, n: list[int]):
        self.types, self.tokens = types, tokens
        # The part that counts above CUT give up: the usual estimate of an absolute discount, always within (0, 1).
        self.part = (n[0] + 1) / (n[0] + 2 * n[1] + 2)
        rest = (CUT + 1) * n[CUT] / max(1, n[0])
        self.low = np.zeros(CUT + 1)
        for r in range(1, CUT + 1):
            d = ((r + 1) * n[r] / (r * max(1, n[r - 1])) - rest) / (1 - rest) if rest < 1 else 1.0
            # Counts of counts too few or too odd for Good-Turing: the absolute discount instead.
            self.low[r] = r * d if 0 < d < 1 else r - self.part

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > CUT, counts - self.part, self.low[np.minimum(counts, CUT)])


_SCORED = pa.schema([
    ("kind", pa.int32()), ("block", pa.int64()), ("row", pa.int64()), ("doc_id", pa.string()), ("learn", pa.bool_()), ("n_tokens", pa.int64()),
    ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("context", pa.int64()), ("x", pa.float64()), ("y", pa.float64())])


def _rows(n: int, **columns) -> pa.Table:
    return pa.table({f.name: pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SCORED}, schema=_SCORED)


def _score(single: Discounts, double: Discounts, parts: int):
    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        row = texts.to_pylist()[0]
        block = Block.__new__(Block)
        block.words, block.index = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["tokens"], np.uint32)
        block.sizes, block.learn = np.array(row["sizes"]), np.array(row["learn"], bool)
        keys, index = block.keys()
        got: dict[int, list[tuple]] = {1: [], 2: []}
        for a in answers.select(["kind", "part", "counts", "size", "answers"]).to_pylist():
            n = a["size"]
            counts = np.frombuffer(a["counts"], np.uint32 if len(a["counts"]) == 4 * n else np.int64).astype(np.int64)
            got[a["kind"]].append((a["part"], counts, np.unpackbits(np.frombuffer(a["answers"], np.uint8), count=n).astype(bool)))
        once = np.concatenate([c for _, c, _ in sorted(got[1], key=lambda g: g[0])])
        twice = np.concatenate([c for _, c, _ in sorted(got[2], key=lambda g: g[0])])
        answer = np.concatenate([a for _, _, a in sorted(got[2], key=lambda g: g[0])])
        if len(once) != len(block.words) or len(twice) != len(keys):
            raise RuntimeError("the texts came in other blocks the second time; write them to a table first")
        number = block.index
        before = block.before()
        start = np.cumsum(block.sizes) - block.sizes
        c_before = np.empty(len(number), np.int64)
        c_before[1:] = once[number[:-1]]
        c_before[start] = row["starts"]
        chance = np.where(once > 0, single.of(once) / max(1, single.tokens), 1 - row["mass"])
        pair = twice[index]
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(pair > 0, np.log10(double.of(pair) / np.maximum(1, c_before)), np.log10(chance[number]))
        base = np.log10((once[number] + 1) / (single.tokens + single.types + 1))
        texts_ = np.repeat(np.arange(len(block.sizes)), block.sizes)
        n = len(block.sizes)
        out = [_rows(
            n, kind=np.zeros(n, np.int32), block=np.full(n, row["block"]), row=np.arange(n), doc_id=row["ids"], learn=block.learn,
            n_tokens=block.sizes, n_known=np.bincount(texts_, once[number] > 0, n).astype(np.int64), base_score=np.bincount(texts_, base, n),
            score=np.bincount(texts_, logs, n))]
        new = np.flatnonzero(pair == 0)
        if len(new):  # texts and contexts of unseen bigrams
            both = np.stack((texts_[new].astype(np.uint64), before[new]))
            where, times = np.unique(both, axis=1, return_counts=True)
            m = len(times)
            out.append(_rows(m, kind=np.full(m, 1, np.int32), block=np.full(m, row["block"]), row=where[0].astype(np.int64),
                             context=signed(where[1]), x=times.astype(float)))
        _, first = np.unique(index, return_index=True)
        mine = first[answer]
        if len(mine):  # this block's share of its contexts' sums
            contexts, at = np.unique(before[mine], return_inverse=True)
            m = len(contexts)
            out.append(_rows(m, kind=np.full(m, 2, np.int32), context=signed(contexts), x=np.bincount(at, double.of(twice[answer]), m),
                             y=np.bincount(at, chance[number[mine]], m), n_tokens=c_before[mine][np.unique(at, return_index=True)[1]]))
        return pa.concat_tables(out)

    return run


def score(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (log10 probability of the text).

    Learns from the rows for which `learn` holds and scores every row.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[doc_id].dataType
    slim = docs.select(F.col(doc_id).cast("string").alias("id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.col(text).alias("text"))
    size, starts = slim.agg(F.sum(F.octet_length("text")), F.count_if("learn")).first()
    parts = max(4, -(-(size or 0) // PART_BYTES))

    requests = slim.mapInArrow(_requests(parts), "kind int, part int, block long, keys binary, counts binary")
    answers = written(requests.groupBy("kind", "part").applyInArrow(_sum_part, _ANSWER))
    facts = answers.where("facts is not null").groupBy("kind").agg(*(F.sum(F.col("facts")[i]).alias(f"f{i}") for i in range(CUT + 3))).collect()
    by_kind = {r["kind"]: [r[f"f{i}"] for i in range(CUT + 3)] for r in facts}
    single, double = (Discounts(f[0], f[1], f[2:]) for f in (by_kind.get(k, [0] * (CUT + 3)) for k in (1, 2)))
    mass = _unigram_mass(single, by_kind.get(1, [0] * (CUT + 3))[2:2 + CUT])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, block in _blocks(batches):
            yield pa.RecordBatch.from_pylist([{
                "block": number, "ids": pa.concat_arrays(ids).to_pylist(), "sizes": block.sizes.tolist(), "learn": block.learn.tolist(),
                "words": block.words.tobytes(), "tokens": block.index.tobytes(), "starts": starts, "mass": mass}], schema=_TEXTS)

    texts = slim.mapInArrow(cut, "block long, ids array<string>, sizes array<long>, learn array<boolean>, words binary, tokens binary, "
                                 "starts long, mass double")
    scored = written(texts.groupBy("block").cogroup(answers.drop("facts").groupBy("block")).applyInArrow(
        _score(single, double, parts), "kind int, block long, row long, doc_id string, learn boolean, n_tokens long, n_known long, "
                                       "base_score double, score double, context long, x double, y double"))
    contexts = context_table(scored)
    backed = scored.where("kind = 1").join(contexts, "context", "left").groupBy("block", "row").agg(
        F.sum(F.col("x") * F.log10(F.coalesce("bow", F.lit(1.0)))).alias("backed"))
    return scored.where("kind = 0").join(backed, ["block", "row"], "left").select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("learn").alias("learned"), "n_tokens", "n_known",
        F.lit(int(single.tokens)).cast("long").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"))


_TEXTS = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())), ("learn", pa.list_(pa.bool_())),
    ("words", pa.binary()), ("tokens", pa.binary()), ("starts", pa.int64()), ("mass", pa.float64())])


def _unigram_mass(single: Discounts, times: list[int]) -> float:
    """The share of the unigrams' probability that seen words hold; what is left is the unknown word's.

    times: how many words occur 1, 2, ... CUT times.
    """
    if not single.tokens:
        return 0.0
    low = sum(single.low[r] * n for r, n in enumerate(times, 1))
    high = single.tokens - sum(r * n for r, n in enumerate(times, 1)) - (single.types - sum(times)) * single.part
    return float((low + high) / single.tokens)


def context_table(scored: DataFrame) -> DataFrame:
    """context, bow: what a context's seen bigrams leave, over what their words leave of the unigrams."""
    sums = scored.where("kind = 2").groupBy("context").agg(F.sum("x").alias("x"), F.sum("y").alias("y"), F.max("n_tokens").alias("c"))
    return sums.select("context", ((1 - F.col("x") / F.col("c")) / (1 - F.col("y"))).alias("bow"))
