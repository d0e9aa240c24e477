"""Phrases by Misra-Gries summaries, against counting everything."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import phrases

LOW = {k: k + 32 for k in range(65, 91)}
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def counted(rows, longest):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, threshold, longest, top):
    f, n = counted(rows, longest)
    out = []
    for lang, own in f.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= threshold}
        inside = {p[i:j] for p, a in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and own[p[i:j]] <= a}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed=7):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(0, 60)):
            words.append(rng.choice(["New York City", "new  york", "ÉTÉ", "hot\tdog", "a", "b", "c d e f g h", "x.", "end!", "\n", f"rare{rng.randrange(500)}"]))
        rows.append((" ".join(words), rng.choice(["en", "en", "en", "fr", None])))
    rows += [(None, "en"), ("", "fr"), (None, None), ("und is a language", "und"), ("one", "")]
    return rows + [("the hot passage of all texts here", "en")] * 200  # a third of all rows alike


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).withColumns({"phrase": F.lit("mine"), "n": F.lit(1)})
    found = phrases.mine(df, **how)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


@pytest.fixture
def small(monkeypatch):
    for name, value in (("FLUSH", 300), ("HELD", 40), ("LEAST_PARTS", 4)):
        monkeypatch.setattr(phrases, name, value)


@pytest.mark.parametrize("threshold, longest, top", [(20, 5, 2000), (7, 3, 4), (3, 2, 100), (1, 6, 5)])
def test_equals_counting_everything(spark, small, threshold, longest, top):
    rows = corpus()
    found = mined(spark, rows, threshold=threshold, longest=longest, top=top)
    assert found == brute(rows, threshold, longest, top) and found


def test_full_filters_let_through_only_what_is_dropped_again(spark, small, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BYTES", 64)
    rows = corpus(8)
    assert mined(spark, rows, threshold=5) == brute(rows, 5, 5, 2000)


def test_long_texts_in_chunks(spark, small, monkeypatch):
    monkeypatch.setattr(phrases, "SLICE_BYTES", 100)
    rng = random.Random(2)
    text = " ".join(rng.choice(["alpha beta gamma", "delta", "z" * 300, "end. of", "line\nbreak"]) for _ in range(900))
    rows = [(text, "en"), ("w" * 1000, "en"), ("...", "en"), (text[:350], None)]
    assert mined(spark, rows, threshold=30) == brute(rows, 30, 5, 2000)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(None, None), (" \t", "en"), ("..", "en")]) == []


def test_products_beyond_64_bits(spark):
    wide = 9 * 10**14
    row = spark.createDataFrame([(wide, wide + 7, 3 * 10**13, 10**14 + 1)], "a long, n long, l long, r long")
    assert row.select(phrases.association("a", "n", "l", "r")).first()[0] == 1000 * wide * (wide + 7) // (3 * 10**13 * (10**14 + 1))


def test_merged_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(1)
    keys = (rng.zipf(1.3, 60_000) % 5000).astype(np.uint32)
    threshold, true = 300, np.bincount(keys)
    summary = phrases.Summary(len(keys) // threshold + 1)
    for part in np.array_split(keys, 40):
        every, counts = np.unique(part, return_counts=True)
        summary.merge([every], [counts])
        assert len(summary.keys) <= summary.capacity
    assert summary.error < threshold
    assert set(np.flatnonzero(true >= threshold)) <= set(summary.survivors(threshold).tolist())
    assert all(true[k] - summary.error <= c <= true[k] for k, c in zip(summary.keys, summary.counts, strict=True))
