"""Mining a group of lines that is dealt into slices."""

import collections

import pytest

from palisade.operators import mining, onboarding

LETTERS = "translate(cast({} as string), '0123456789', 'abcdefghij')"


@pytest.fixture
def lines(spark):
    # one shape with two thirds of the lines, two more under the same first word, and one seen once
    shapes = f"""case when id % 6 < 4 then concat('door user ', {LETTERS.format('id')}, ' came in by card today')
        when id % 6 = 4 then concat('door alarm set off at floor ', {LETTERS.format('id')}, ' again') when id = 5 then 'door is a single line of words'
        else concat('door user ', {LETTERS.format('id')}, ' went out with guest ', {LETTERS.format('id * 7')}) end"""
    return spark.range(900).selectExpr(f"{shapes} as raw_payload", "timestamp_seconds(id) as ingest_ts")


WANTED = {
    "door user <*> came in by card today": 600, "door alarm set off at floor <*> again": 150,
    "door is a single line of words": 1, "door user <*> went out with guest <*>": 149}


@pytest.mark.parametrize("slice_lines", [10_000, 100, 7])
def test_slices_give_the_templates_of_the_whole(spark, lines, monkeypatch, slice_lines):
    monkeypatch.setattr(mining, "SLICE_LINES", slice_lines)
    templates, assigned = mining.mine_templates(lines)
    rows = templates.orderBy("template_id").collect()
    assert {r.template: r.size for r in rows} == WANTED
    assert [r.template_id for r in rows] == [1, 2, 3, 4] and rows[0].template.startswith("door user <*> came")
    assert [r["first_seen"].timestamp() for r in rows] == sorted(r["first_seen"].timestamp() for r in rows)
    assert assigned.count() == 900 and assigned.join(templates, "template").count() == 900


def test_a_leaf_is_many_tasks(spark, lines, monkeypatch):
    monkeypatch.setattr(mining, "SLICE_LINES", 50)
    dealt = mining._with_leaf(mining.distinct_masked(lines), 100).selectExpr(
        "leaf", "cast(pmod(xxhash64(masked), 12) as int) as slice", "masked as line", "first_seen as seen").filter("leaf = '8 door'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = dealt.repartition("leaf", "slice").selectExpr("spark_partition_id() as task").groupBy("task").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(tasks) > 1 and max(t["count"] for t in tasks) < 600


def test_templates_join_their_like_and_no_other_of_their_tree():
    one, two = mining.Tree(), mining.Tree()
    for k in range(40):
        for tree, odd in ((one, 0), (two, 1)):
            if k % 2 == odd:
                tree.add(["a", "b", chr(97 + k % 26), "d", f"x{k}"])
                tree.add(["a", "z", "y", chr(97 + k % 26), f"x{k}"])
    merged = mining.Tree()
    placed = [merged.add(list(t)) for tree in (one, two) for t in tree.templates]
    assert collections.Counter(placed) == {0: 2, 1: 2}
    assert [" ".join(t) for t in merged.templates] == ["a b <*> d <*>", "a z y <*> <*>"]


def test_thousands_of_templates_under_their_rarest_tokens(spark):
    # all share the head; every one has a token of its own, some are all wildcards but one
    templates = spark.range(5000).selectExpr(
        "cast(id as int) as template_id", f"concat('head <*> of ', {LETTERS.format('id')}, ' <*> end') as template").union(
        spark.createDataFrame([(5000, "<*> <*> <*>"), (5001, "head <*> <*> <*> <*> end"), (5002, "a <*> c"), (5003, "<*> b <*>")], "template_id int, template string"))
    postings = mining.template_postings(templates)
    assert postings.count() == 5004
    # nearly every template stands alone under its key
    assert postings.groupBy("token_count", "at", "token").count().filter("count > 2").count() == 0
    lines = spark.createDataFrame([
        ("head x of bcd y end",), ("head x of zzz y end",), ("a b c",), ("p q r",), ("a q c",), ("p b r",), ("no template at all fits",), ("",)],
        "raw_payload string")
    found = {r.raw_payload: (r.template_id, r.parameters) for r in mining.match_template(lines, templates).collect()}
    assert found == {
        "head x of bcd y end": (123, ["x", "y"]), "head x of zzz y end": (5001, ["x", "of", "zzz", "y"]), "a b c": (5002, ["b"]),
        "p q r": (5000, ["p", "q", "r"]), "a q c": (5002, ["q"]), "p b r": (5003, ["p", "r"]), "no template at all fits": (None, None),
        "": (None, None)}


def test_lines_of_a_template_come_one_after_the_other(spark):
    lines = spark.createDataFrame([(f"{w} at {i} from 10.0.0.{i}",) for i in range(4) for w in ("alpha", "beta")], "raw_payload string")
    templates = spark.createDataFrame([(1, "alpha at <NUM> from <IP>"), (2, "beta at <NUM> from <IP>")], "template_id int, template string")
    found = mining.match_template(lines, templates)
    assert found.columns == ["masked", "raw_payload", "template_id", "template", "parameters"]
    assert {(r.raw_payload, tuple(r.parameters)) for r in found.collect()} == {
        (f"{w} at {i} from 10.0.0.{i}", (str(i), f"10.0.0.{i}")) for i in range(4) for w in ("alpha", "beta")}
    assert "Sort [_pattern" in found._jdf.queryExecution().optimizedPlan().toString()


def test_patterns_are_made_from_templates_not_from_lines(spark):
    """However many distinct lines a template has: no plan of the sessions holds its pattern's steps above the lines' assignment."""
    lines = spark.range(50).selectExpr(
        "concat('door ', translate(cast(id as string), '0123456789', 'abcdefghij'), ' opened by src=10.0.0.', id) as raw_payload",
        "timestamp_seconds(id) as ingest_ts")
    sessions = onboarding.onboarding_sessions(lines)
    plan = sessions._jdf.queryExecution().optimizedPlan().toString()
    assert "KEY" not in plan and "=<$1>" not in plan and "regexp_extract_all(" not in plan
    assert sessions.first()["size"] == 50
