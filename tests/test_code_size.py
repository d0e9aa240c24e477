"""The code of the whole way of a line stays within what the JIT compiler takes (8000 bytes a method)."""

import datetime
import re

import pytest

from palisade.plans.ingest import run
from workload.corpus import corpus
from workload.stored import edge_events


@pytest.fixture
def events(spark, tmp_path):
    rows = [(i, datetime.datetime(2026, 1, 1, 0, 0, i), i, "error" if i % 2 else "login", 1.5 * i) for i in range(20)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(
        str(tmp_path / "events.parquet"))
    return str(tmp_path)


def _judged_corpus(spark, sf_dir):
    return run(corpus(spark, sf_dir), position="event_id", ingest_ts="ingest_ts", document=False)


@pytest.mark.parametrize("query", [_judged_corpus, edge_events])
def test_methods_are_small_enough_to_compile(spark, events, capsys, query):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        query(spark, events).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) <= 8000
