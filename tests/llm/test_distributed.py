"""Operators that bring rows together: against brute force, on odd rows, hot groups and small blocks."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import katz, mixing, neardup, neighbours, repeats
from palisade.llm.components import components

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {k: k + 32 for k in range(65, 91)}


def words(text):
    return BLANK.findall((text or "").translate(LOW))


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def groups(rows, size):
    """Index of each row's group by links of similarity 0.8."""
    sets = [shingles(t, size) for _, t, _ in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(rows))]


def near_rows():
    """A hot group of copies, and near copies at every distance around the threshold."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(i, " ".join(base), "s") for i in range(40)]
    for i in range(120):
        own = list(base)
        for at in rng.sample(range(120), rng.randrange(0, 16)):
            own[at] = f"new{rng.randrange(9000)}"
        rows.append((100 + i, " ".join(own), "s"))
    return rows


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates_by_brute_force(make_docs, odd_rows, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = odd_rows + [(1000 + i, t, s) for i, t, s in near_rows()]
    rows.append((2000, "no Id twin but this one", "s"))
    rows.append((None, "no id twin but this one", "s"))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(
        make_docs(rows, extra=True), shingle=2).collect())
    group = groups(rows, 2)
    least = {}
    for (i, _, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = collections.Counter((i, len(shingles(t, 2)), least.get(g), i == least.get(g)) for (i, t, _), g in zip(rows, group, strict=True))
    assert got == want


def test_keeping_one_of_each_group(make_docs, odd_rows):
    rows = odd_rows + [(1000 + i, t, s) for i, t, s in near_rows()]
    docs = make_docs(rows, extra=True)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    group = groups(rows, 5)
    full = {g for g, (_, t, _) in zip(group, rows, strict=True) if words(t)}
    assert kept.count() == len(full) + sum(1 for _, t, _ in rows if not words(t))
    assert neardup.keep_one(make_docs([])).count() == 0
    assert neardup.near_duplicates(make_docs([])).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 5), (5, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def katz_by_hand(rows, learn):
    tokens = [(*words(t), None) for _, t, _ in rows]
    single, double, before = collections.Counter(), collections.Counter(), collections.Counter()
    for w, own in zip(tokens, learn, strict=True):
        if own:
            single.update(w)
            for a, b in zip(("<s>", *w), w, strict=False):
                double[a, b] += 1
                before[a] += 1

    def discounted(counts):
        n = [sum(v == r for v in counts.values()) for r in range(1, katz.CUT + 2)]
        d = katz.Discounts(len(counts), sum(counts.values()), n)
        return lambda c: float(d.of(np.array([c]))[0])

    one, two, total = discounted(single), discounted(double), sum(single.values())
    p = {w: one(c) / total for w, c in single.items()}
    unknown = 1 - sum(p.values())
    x, y = collections.Counter(), collections.Counter()
    for (a, b), c in double.items():
        x[a] += two(c)
        y[a] += p[b]
    bow = {a: (1 - x[a] / before[a]) / (1 - y[a]) for a in x}

    def chance(a, b):
        return two(double[a, b]) / before[a] if (a, b) in double else bow.get(a, 1) * p.get(b, unknown)

    for a in list(x)[:20]:  # exactly normalised
        assert math.isclose(sum(chance(a, b) for b in p) + bow[a] * unknown, 1, rel_tol=1e-9)
    return [(len(w), sum(b in single for b in w), total, sum(math.log10((single[b] + 1) / (total + len(single) + 1)) for b in w),
             sum(math.log10(chance(a, b)) for a, b in zip(("<s>", *w), w, strict=False))) for w in tokens]


@pytest.mark.parametrize("block", [1_000_000, 50])
def test_katz_by_brute_force(make_docs, odd_rows, monkeypatch, block):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    monkeypatch.setattr(katz, "PART_BYTES", 100_000)
    rows = odd_rows + near_rows()
    learn = [zlib.crc32(str("" if i is None else i).encode()) % 3 != 1 for i, _, _ in rows]
    from palisade.llm.common import text_remainder

    scored = katz.score(make_docs(rows, extra=True), text_remainder("doc_id", 3) != 1).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[4], 6), round(r[5], 6))
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scored), key=key)
    want = sorted(((i, *v) for (i, _, _), v in zip(rows, katz_by_hand(rows, learn), strict=True)), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4:] for g in got], [w[4:] for w in want], rtol=1e-9)


def test_katz_without_training_or_rows(make_docs):
    rows = katz.score(make_docs([(1, "a b", "s"), (2, None, "s")]), F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}
    assert katz.score(make_docs([]), F.lit(True)).count() == 0


def vectors(n, dim=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x / np.linalg.norm(x, axis=1)[:, None])]


def test_neighbours_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "POINT_BLOCK", 32)
    rows = vectors(1500)
    rows += [(5000 + i, rows[7][1]) for i in range(300)]  # a hot vector, all ties
    odd = [(None, rows[0][1]), (9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [1.0, None]), (9004, [1.0]), (3, rows[3][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("score", F.lit("mine"))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    ids = np.array(list(x))
    m = np.stack(list(x.values()))
    hit = total = 0
    for q in (i for i in x if i % 100 == 0):
        away = np.sqrt(((m - x[q]) ** 2).sum(1))
        order = [int(ids[k]) for k in np.lexsort((ids, away)) if ids[k] != q][:10]
        assert [round(s, 9) for _, s in got[q]] == [round(float(np.sqrt(((x[i] - x[q]) ** 2).sum())), 9) for i, _ in got[q]]
        assert got[q] == sorted(got[q], key=lambda p: (p[1], p[0])) and len(got[q]) == 10
        hit, total = hit + len(set(order) & {i for i, _ in got[q]}), total + 10
    assert hit / total >= 0.9


def test_neighbours_of_tiny_tables(spark):
    df = spark.createDataFrame(vectors(4, 3), "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 2 == 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in got} == {(q, v) for q in (0, 2) for v in range(4) if v != q}
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 2 == 0).count() == 0
    assert neighbours.nearest(df.limit(1), F.col("vec_id") % 2 == 0).count() == 0


def repeated(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[k:k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if seen[r[k:k + length]] > 1:
                gone[k:k + length] = True
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()), hashlib.sha256(
            np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "shard"), [(400, 8 << 20), (64, 3000), (40, 500)])
def test_repeats_by_brute_force(make_docs, odd_rows, monkeypatch, length, shard):
    monkeypatch.setattr(repeats, "SHARD_BYTES", shard)
    monkeypatch.setattr(repeats, "PART_BYTES", 1000)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdé ") for _ in range(1500))
    rows = [r for r in odd_rows if r[1] is None or len(r[1]) < 5000]
    for i in range(25):  # shared passages with edits, shifted, and periodic text
        a, b = sorted(rng.sample(range(1500), 2))
        own = list(base[a:b])
        for at in rng.sample(range(len(own)), len(own) // 300):
            own[at] = "#"
        rows.append((500 + i, "".join(rng.choice("xyz") for _ in range(rng.randrange(50))) + "".join(own), "s"))
    rows += [(600, "ab" * 700, "s"), (601, "abc" * 500, "s"), (602, "z" * length, "s"), (603, "z" * (length + 1), "s")]
    docs = make_docs(rows, extra=True)
    got = repeats.spans(docs, keep=["doc_id"], length=length, finish=repeats.digest, schema=repeats.DIGEST).collect()
    key = lambda v: (v[0] is None, v[0] or 0, *v[1:])
    want = [(i, *v) for (i, _, _), v in zip(rows, repeated([t for _, t, _ in rows], length), strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_a_shared_core_is_spread_over_partitions():
    rng = random.Random(8)
    core = "".join(rng.choice("abcdefgh ") for _ in range(390))  # shorter than a repeat, with other surroundings each time
    dealt = collections.defaultdict(collections.Counter)
    for shard in range(40):
        raw = [("".join(rng.choice("uvwxyz") for _ in range(30)) + core + "".join(rng.choice("uvwxyz") for _ in range(30))).encode() for _ in range(20)]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        own = repeats.Shard(data, offsets)
        starts, suffix = own.windows(np.full(len(own.place), repeats._MIXED))
        for what, (keys, counts, _) in {"suffixes": own.suffixes(), "windows": own.window_keys(starts, suffix)}.items():
            for batch in repeats._sent(shard, keys, counts, 16):
                dealt[what][batch.column(0)[0].as_py()] += len(batch.column(2)[0].as_py()) // 16
    for counts in dealt.values():
        assert len(counts) == 16 and max(counts.values()) < 2 * sum(counts.values()) / 16


def test_repeats_leave_texts_and_columns(make_docs):
    passage = "".join(random.Random(1).choice("abcdefgh ") for _ in range(500))
    docs = make_docs([(1, "é" + passage, "s"), (2, "Start. " + passage + " end", "s"), (3, None, "s"), (4, "clean", None)], extra=True)
    cut = repeats.remove(docs)
    assert cut.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == {1: "é", 2: "Start.  end", 3: None, 4: "clean"}
    assert repeats.remove(make_docs([])).count() == 0
    assert repeats.spans(docs).columns[-1] not in docs.columns


def test_hypergeometric_split_is_exact_and_fair(spark):
    quotas = spark.createDataFrame([(0, 4000), (1, 900), (2, 3), (3, 0)], "place long, quota long")
    leaves = mixing.split(quotas, 13).toPandas().pivot(index="shard", columns="place", values="n")
    assert leaves.sum().tolist() == [4000, 900, 3, 0] and (leaves >= 0).all().all()
    assert leaves.sum(axis=1).between(4903 // 13 - 5, 4903 // 13 + 5).all()
    # each share varies as a hypergeometric draw does
    spread = np.sqrt(4903 / 13 * (900 / 4903) * (4000 / 4903))
    assert (abs(leaves[1] - 900 / 13) < 5 * spread).all() and leaves[1].std() > spread / 3


def filled(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    whole, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        rest = whole - sum(3 * sizes[s] for s in capped)
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def test_mix_keeps_targets_and_bounds(make_docs, odd_rows):
    rng = random.Random(2)
    rows = [(i, t, s) for i, t, s in odd_rows if i not in (102, 103)]
    for i in range(900):  # one hot source, many small ones
        rows.append((1000 + i, "w " * rng.randrange(0, 40), "hot" if i % 3 else f"s{i % 30}"))
    docs = make_docs(rows, extra=True)
    dealt = mixing.allot(docs, block_words=200, shard_words=1500)
    name = dealt.columns[-1]
    got = dealt.select("doc_id", "text", "source", f"{name}.*").toPandas()
    assert len(got) == len(rows)
    assert (got["size"] == got["text"].map(lambda t: len(words(t)))).all()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = filled(sizes)
    assert got["shards"].map(len).max() <= 3
    got["taken"] = got["size"] * got["shards"].map(len)
    for source, own in got.groupby("source", dropna=False):
        source = None if source is None or source != source else source
        assert math.isclose(own["target"].iloc[0], want[source], rel_tol=1e-12)
        assert abs(own["taken"].sum() - want[source]) <= 20
    mixed = mixing.mix(docs, block_words=200, shard_words=1500)
    assert mixed.columns == [*docs.columns, "shard_", "shard_order"]
    assert mixed.count() == got["shards"].map(len).sum()
    again = mixing.mix(docs, block_words=200, shard_words=1500)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix(make_docs([])).count() == 0


def test_mix_fills_sources_from_later_blocks_and_by_whole_units(make_docs):
    rng = random.Random(4)
    rows = []
    for i in range(24):  # three large sources, whose blocks hold few long documents and many short ones
        for k in range(40):
            n = rng.randrange(300, 900) if k % 8 == 0 else rng.randrange(1, 12)
            rows.append((100 * i + k, "w " * n, "abc"[i % 3]))
    for i in range(60):  # repeated rows: a unit of its copies
        rows += [(9000 + i, "r " * rng.randrange(2, 60), "abc"[i % 3])] * rng.randrange(2, 9)
    rows += [(9900, "", "a"), (9901, None, "b")]
    dealt = mixing.allot(make_docs(rows), block_words=900, shard_words=3000)
    name = dealt.columns[-1]
    got = dealt.select("doc_id", "source", f"{name}.*").toPandas()
    got["n"] = got["shards"].map(len)
    assert len(got) == len(rows)
    assert (got.groupby(["source", "doc_id"])["n"].nunique() == 1).all()  # copies of a row are taken alike
    for _, own in got.groupby("source"):
        gap = own["target"].iloc[0] - (own["size"] * own["n"]).sum()
        assert gap >= 0
        units = own[own["n"] == own["n"].min()].groupby("hash")["size"].sum()
        assert not ((units > 0) & (units <= gap)).any()  # nothing that was left out fits
