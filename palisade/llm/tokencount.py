"""Token counts by the whole-token shortcut for a BPE whose merges stay inside pre-tokens.

Offline, every vocabulary string is encoded once; those that come out as exactly themselves form the proven set. Then a
pre-token of a text that is in the set is one token without any merging, and only the rest goes through the tokenizer's merges,
each distinct one once while a worker remembers it.

The shortcut normalises a text by itself only where that provably equals the tokenizer's own rules: characters below U+0250 that
composition cannot change, and no special string. Every other text is encoded by the library whole. Nulls are empty texts with no
token.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import bounded_batches, fresh, with_text

#: Rest pre-tokens that a worker remembers before it starts anew; the memory saves work and changes no count.
REMEMBERED = 200_000

#: The alphabet in which a byte-level vocabulary spells bytes keeps these byte ranges as they are.
_KEPT_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A text of these characters only is composed as it stands (no combining marks, which begin at U+0300).
_PLAIN = re.compile("[\x00-ɏ]*")


def _byte_letters() -> dict[str, int]:
    letters = {chr(b): b for b in _KEPT_BYTES}
    return letters | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(_KEPT_BYTES))}


def supported(tokenizer_json: str) -> bool:
    """Whether the shortcut's rules are the tokenizer's: NFC, blanks to one space, lower case, one split pattern, word-end BPE."""
    t = json.loads(tokenizer_json)
    kinds = [n.get("type") for n in (t.get("normalizer") or {}).get("normalizers", [])]
    splits = (t.get("pre_tokenizer") or {}).get("pretokenizers", [])
    model = t.get("model", {})
    return (
        kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
        and splits[0].get("invert") and splits[0].get("behavior") == "Removed" and not splits[1].get("use_regex")
        and not splits[1].get("add_prefix_space")
        and model.get("type") == "BPE" and model.get("dropout") is None and model.get("end_of_word_suffix") is not None
        and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in t.get("added_tokens", []))
    )


def prove(tokenizer_json: str) -> frozenset[str]:
    """Vocabulary strings, as text, that alone are one pre-token and encode as the one token they spell."""
    from tokenizers import Tokenizer

    tokenizer, parsed = Tokenizer.from_str(tokenizer_json), json.loads(tokenizer_json)
    suffix, letters = parsed["model"]["end_of_word_suffix"], _byte_letters()
    strings = []
    for piece, number in parsed["model"]["vocab"].items():
        if piece.endswith(suffix) and all(c in letters for c in piece[: -len(suffix)]):
            try:
                strings.append((bytes(letters[c] for c in piece[: -len(suffix)]).decode(), number))
            except UnicodeDecodeError:
                continue
    encoded = tokenizer.encode_batch([s for s, _ in strings], add_special_tokens=False)
    return frozenset(s for (s, number), e in zip(strings, encoded, strict=True) if e.ids == [number])


class Counting:
    """Counts in one worker: the proven set, the split pattern, and the tokenizer for the rest."""

    def __init__(self, tokenizer_json: str, proven: frozenset[str]):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.proven, self.short = proven, supported(tokenizer_json)
        self.rest: dict[str, int] = {}
        if self.short:
            parsed = json.loads(tokenizer_json)
            pattern = parsed["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            self.split = regex.compile(pattern)
            self.simple = regex.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))
            self.spelling = {b: letter for letter, b in _byte_letters().items()}
            self.special = [a["content"] for a in parsed["added_tokens"]]

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        split: list[tuple[int, Counter]] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.short and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
                low = text.lower()
                split.append((i, Counter((self.simple if low.isascii() else self.split).findall(low))))
            else:
                whole.append(i)
        unknown = {p for _, own in split for p in own.keys() - self.proven if p not in self.rest}
        if len(self.rest) + len(unknown) > REMEMBERED:
            self.rest = {}
            unknown = {p for _, own in split for p in own.keys() - self.proven}
        merge, spell = self.tokenizer.model.tokenize, self.spelling
        for p in unknown:
            self.rest[p] = len(merge(p if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(spell)))
        proven, rest = self.proven, self.rest
        for i, own in split:
            out[i] = sum(n if p in proven else n * rest[p] for p, n in own.items())
        for i in whole:
            out[i] = len(self.tokenizer.encode(texts[i], add_special_tokens=False))
        return out


def count_tokens(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: list[str] | None = None,
                 name: str = "n_tokens") -> DataFrame:
    """The `keep` columns (all by default) and, last, the number of tokens of the whole text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    shared = spark.sparkContext.broadcast((tokenizer_json, prove(tokenizer_json) if supported(tokenizer_json) else frozenset()))
    keep = docs.columns if keep is None else keep
    (name,) = fresh(docs.select(*keep), name)
    slim, at = with_text(docs, keep, text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[: len(keep)]), f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(*shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts = pa.array(counting.count(part.column(at).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], counts], names=[*keep, name])

    return slim.mapInArrow(run, schema)
