"""The pipeline's stages against plain versions, each on what the stage before has kept."""

import collections
import zlib

import corpus_pipeline
from palisade.llm import quality
from tests.llm.test_distributed import filled, groups, repeated, words
from tests.llm.test_rowwise import contamination

import numpy as np


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    benchmark = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    columns, kept = docs.columns, []
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.columns[: len(columns)] == columns, name
        kept.append({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").distinct().collect()})
        if number == 3:
            before_mix = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}

    known = [i for i in source if i in labels and zlib.crc32(str(i).encode()) % 4 != 2]
    passed = [labels[i] for i in known if i in kept[0]]
    assert np.mean(passed) > 0.95 and all(kept[0][i] == source[i] for i in kept[0])
    assert len(quality.FEATURES) == len(set(quality.FEATURES))

    rows = sorted((i, t, None) for i, t in kept[0].items())
    firsts = {g: rows[g][0] for g, r in zip(groups(rows, 5), rows, strict=True) if words(r[1])}
    assert set(kept[1]) == set(firsts.values()) | {i for i, t, _ in rows if not words(t)}

    order = sorted(kept[1])
    for i, (_, gone, _, _) in zip(order, repeated([kept[1][i] for i in order], corpus_pipeline.REPEAT_BYTES), strict=True):
        if not gone:
            assert kept[2][i] == kept[1][i]
        else:
            assert len(kept[2][i].encode()) <= len(kept[1][i].encode()) - gone

    clean = {i for i, t in kept[2].items() if not (lambda n, h, _: h > 0 and 20 * h >= n)(*contamination(t, benchmark))}
    assert set(kept[3]) == clean

    sizes, taken = collections.Counter(), collections.Counter()
    for _, t, s in before_mix:
        sizes[s] += len(words(t))
    for r in docs.collect():
        taken[r["source"]] += len(words(r["text"]))
    longest = max(len(words(t)) for _, t, _ in before_mix)
    assert all(abs(taken[s] - target) <= longest for s, target in filled(sizes).items())
