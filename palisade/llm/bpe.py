"""BPE encoding by a contiguous rank array, and decoding, for the tokenizers that `tokencount.supported` describes.

A text is cut at special strings, normalised and split into pre-tokens; a pre-token's UTF-8 bytes are the first parts, the last one with
the word's end. Its parts and the ranks of neighbouring pairs lie side by side in two lists: the smallest rank is looked for, the
boundary it stands for deleted, and the ranks to its left and right looked up anew, until no pair has a rank. That is square in the
length of a pre-token, so one of more than SHORT parts merges by a queue over linked parts instead, with the same result. A worker
remembers the tokens of pre-tokens; ids of a batch are then gathered from one array.

Texts of characters below U+0250 are normalised and split by rules that equal the library's there; for all others its own normaliser and
pre-tokenizer are called (merges never are). Long texts go piece by piece, cut before a space, where neither rule looks across.

A null text is an empty one and has no token. Decoding joins the spellings of the ids by a space, as a tokenizer without a decoder does;
null ids and ids outside the vocabulary spell nothing, and null in place of ids is an empty text. Rows that repeat stay repeated; columns
named like the results get those results under a longer name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import bounded_batches, fresh, with_text
from palisade.llm.tokencount import _PLAIN, _byte_letters, supported

#: Parts up to which a pre-token is merged in the rank array.
SHORT = 128
#: Characters of a piece of a long text, and pre-tokens gathered at once.
PIECE, GATHERED = 1 << 20, 1 << 18
#: Pre-tokens that a worker remembers before it starts anew; the memory saves work and changes no id.
REMEMBERED = 200_000

_NONE = 1 << 40


class Merges:
    """Ranks of pairs of ids: the smallest first, the leftmost of equal ones."""

    def __init__(self, vocab: dict[str, int], merges: list):
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a] << 24 | vocab[b]] = rank
            self.made.append(vocab[a + b])

    def merge(self, parts: list[int]) -> list[int]:
        return self.short(parts) if len(parts) <= SHORT else self.long(parts)

    def short(self, parts: list[int]) -> list[int]:
        rank, made = self.ranks.get, self.made
        ranks = [rank(a << 24 | b, _NONE) for a, b in pairwise(parts)]
        while ranks:
            least = min(ranks)
            if least == _NONE:
                break
            i = ranks.index(least)
            parts[i] = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 24 | parts[i], _NONE)
            if i < len(ranks):
                ranks[i] = rank(parts[i] << 24 | parts[i + 1], _NONE)
        return parts

    def long(self, parts: list[int]) -> list[int]:
        rank, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank(a << 24 | b, _NONE), i) for i, (a, b) in enumerate(pairwise(parts))]
        queue = [entry for entry in queue if entry[0] < _NONE]
        heapq.heapify(queue)
        while queue:
            least, i = heapq.heappop(queue)
            j = after[i]
            # an entry that no longer describes its place is passed over
            if parts[i] < 0 or j >= n or rank(parts[i] << 24 | parts[j], _NONE) != least:
                continue
            parts[i], parts[j] = self.made[least], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                near = rank(parts[i] << 24 | parts[after[i]], _NONE)
                if near < _NONE:
                    heapq.heappush(queue, (near, i))
            if before[i] >= 0:
                near = rank(parts[before[i]] << 24 | parts[i], _NONE)
                if near < _NONE:
                    heapq.heappush(queue, (near, before[i]))
        return [p for p in parts if p >= 0]


class Known(dict):
    """Place of each pre-token's ids in one growing array; an unknown one is merged when asked for."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder, self.ids, self.ends = encoder, [], [0]

    def __missing__(self, token: str) -> int:
        self.ids.extend(self.encoder.token(token))
        self.ends.append(len(self.ids))
        self[token] = place = len(self)
        return place


class Encoder:
    """Encoding in one worker."""

    def __init__(self, tokenizer_json: str):
        import regex
        from tokenizers import Regex, Tokenizer
        from tokenizers.pre_tokenizers import Split

        if not supported(tokenizer_json):
            raise ValueError("the tokenizer's rules are not those of this encoder")
        parsed = json.loads(tokenizer_json)
        pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        vocab, suffix = parsed["model"]["vocab"], parsed["model"]["end_of_word_suffix"]
        self.merges = Merges(vocab, parsed["model"]["merges"])
        letters = sorted(_byte_letters().items(), key=lambda pair: pair[1])
        self.inner = [vocab[letter] for letter, _ in letters]
        self.last = [vocab[letter + suffix] for letter, _ in letters]
        self.special = {a["content"]: a["id"] for a in parsed["added_tokens"]}
        strings = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, strings)) + ")") if strings else None
        self.whole = any(c.isspace() for s in strings for c in s)
        self.split = regex.compile(pattern)
        self.simple = regex.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
        self.normal = Tokenizer.from_str(tokenizer_json).normalizer
        self.pieces = Split(Regex(pattern), "removed", invert=True)
        self.known = Known(self)

    def token(self, token: str) -> list[int]:
        if token in self.special:  # only a special string itself: pre-tokens never hold one
            return [self.special[token]]
        spelled = token.encode()
        return self.merges.merge([*(self.inner[b] for b in spelled[:-1]), self.last[spelled[-1]]])

    def _segment(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            low = text.lower()
            return (self.simple if low.isascii() else self.split).findall(low)
        return [piece for piece, _ in self.pieces.pre_tokenize_str(self.normal.normalize_str(text))]

    def tokens(self, text: str) -> Iterator[list[str]]:
        """The text's pre-tokens and special strings, piece by piece."""
        lo = 0
        while lo < len(text):
            hi = len(text)
            if hi - lo > PIECE and not self.whole:
                hi = text.rfind(" ", lo + 1, lo + PIECE)
                hi = text.find(" ", lo + PIECE) if hi < 0 else hi
                hi = len(text) if hi < 0 else hi
            piece = text[lo:hi] if lo or hi < len(text) else text
            if self.cut is None or not any(s in piece for s in self.special):
                yield self._segment(piece)
            else:
                for k, part in enumerate(self.cut.split(piece)):
                    yield [part] if k % 2 else self._segment(part)
            lo = hi

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's begin; one more entry ends the last."""
        flat: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def gather() -> None:
            places = np.fromiter(map(self.known.__getitem__, held), np.int64, len(held))
            ends, ids = np.array(self.known.ends), np.array(self.known.ids, np.int32)
            first, sizes = ends[places], ends[places + 1] - ends[places]
            before = np.concatenate(([0], np.cumsum(sizes)))
            flat.append(ids[np.repeat(first - before[:-1], sizes) + np.arange(before[-1])])
            at = 0
            for i, n in owners:
                counts[i] += before[at + n] - before[at]
                at += n
            held.clear()
            owners.clear()
            if len(self.known) > REMEMBERED:
                self.known = Known(self)

        for i, text in enumerate(texts):
            for tokens in self.tokens(text or ""):
                held.extend(tokens)
                owners.append((i, len(tokens)))
                if len(held) > GATHERED:
                    gather()
        gather()
        return np.concatenate(flat), np.concatenate(([0], np.cumsum(counts)))


def _read(tokenizer_path: str) -> str:
    with open(tokenizer_path, encoding="utf-8") as f:
        return f.read()


def _schema(df: DataFrame, keep: list[str], own: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields), own])


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None, name: str = "ids") -> DataFrame:
    """The `keep` columns (all by default) and, last, the ids of the whole text as array<int>."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(_read(tokenizer_path))
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*keep), name)
    slim, at = with_text(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                ids, bounds = encoder.encode(part.column(at).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], lists], names=[*keep, name])

    return slim.mapInArrow(run, _schema(docs, keep, f"`{name}` array<int>"))


def spellings(tokenizer_json: str) -> list[str | None]:
    """The spelling of each id; none where an id is not in use."""
    parsed = json.loads(tokenizer_json)
    named = {number: piece for piece, number in parsed["model"]["vocab"].items()} | {a["id"]: a["content"] for a in parsed["added_tokens"]}
    return [named.get(k) for k in range(max(named) + 1)]


def decode(frame: DataFrame, tokenizer_path: str, ids: str = "ids", keep: list[str] | None = None, name: str = "decoded") -> DataFrame:
    """The `keep` columns (all by default) and, last, the text that the ids spell."""
    spark = frame.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(_read(tokenizer_path))
    keep = frame.columns if keep is None else keep
    (name,) = fresh(frame.select(*keep), name)
    (own,) = fresh(frame.select(*keep), "ids")
    slim = frame.select(*keep, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(spellings(shared.value), pa.large_string())
        used = np.append(pieces.is_valid().to_numpy(zero_copy_only=False), False)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                lists = part.column(len(keep))
                flat = lists.flatten().fill_null(-1).to_numpy()
                flat = np.where((flat >= 0) & (flat < len(pieces)), flat, len(pieces))
                kept = used[flat]
                bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
                bounds = np.concatenate(([0], np.cumsum(kept)))[bounds]
                words = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pieces.take(pa.array(flat[kept])))
                texts = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], texts], names=[*keep, name])

    return slim.mapInArrow(run, _schema(frame, keep, f"`{name}` string"))
