"""Sessions over several batches of unknown lines."""

import datetime

from palisade.operators import onboarding, sessions

T0 = datetime.datetime(2026, 8, 27, 10)


def _lines(spark, texts, start=0):
    return spark.createDataFrame(
        [(t, T0 + datetime.timedelta(seconds=start + i)) for i, t in enumerate(texts)], "raw_payload string, ingest_ts timestamp")


def _rows(df):
    return {r["discovered_template"]: r for r in df.collect()}


def test_a_widened_session_keeps_id_status_and_reviewed_mappings(spark):
    first = onboarding.onboarding_sessions(_lines(spark, [f"pump one reads {k} bar from 10.0.0.{k}" for k in range(1, 4)])).cache()
    row = first.first()
    assert row.discovered_template == "pump one reads <NUM> bar from <IP>"
    edited = onboarding.update_mapping(first, row.session_id, 0, "pressure", "integer", "to_int")
    entry, published, _ = onboarding.publish(edited, onboarding.empty_catalogue(spark), row.session_id, "rev")
    more = _lines(spark, ["pump two reads 9 bar from 10.0.0.9", "pump one reads 4 bar from 10.0.0.4", "door left open by nobody at all"], 60)
    merged = sessions.merge_sessions(published, more)
    assert merged.columns == first.columns
    rows = _rows(merged)
    assert set(rows) == {"pump <*> reads <NUM> bar from <IP>", "door left open by nobody at all"}
    pump, door = rows["pump <*> reads <NUM> bar from <IP>"], rows["door left open by nobody at all"]
    assert (pump.session_id, pump.status, pump.published_parser_id, pump.template_id, pump.size) == (
        row.session_id, "PUBLISHED", published.first().published_parser_id, row.template_id, 5)
    assert [v.suggested_ocsf_field for v in pump.variables][1] == "pressure" and pump.variables[1].confidence == 1.0
    assert pump.variables[1].var_index == 1 and pump.rules[1].target_ocsf_field == "pressure" and pump.rules[1].transform == "to_int"
    assert pump.variables[0].confidence < 1.0 and pump.variables[0].sample_values[:2] == ["one", "two"]
    assert len(pump.raw_sample_logs) == 5 and pump.raw_sample_logs[:3] == row.raw_sample_logs
    assert (door.status, door.size, door.template_id) == ("PENDING", 1, row.template_id + 1)
    assert entry.count() == 1
    first.unpersist()


def test_untouched_sessions_and_empty_batches(spark):
    first = onboarding.onboarding_sessions(_lines(spark, ["alpha beta gamma 1", "one two three four five 6"])).cache()
    same = sessions.merge_sessions(first, _lines(spark, []))
    assert sorted(map(repr, same.collect())) == sorted(map(repr, first.collect()))
    started = sessions.merge_sessions(first.limit(0), _lines(spark, ["alpha beta gamma 1"]))
    assert started.first().session_id == _rows(first)["alpha beta gamma <NUM>"].session_id
    assert started.first().template_id == 1
    # a batch seen before adds its lines to the size, not to the samples
    again = _rows(sessions.merge_sessions(first, _lines(spark, ["alpha beta gamma 1"], 5)))
    assert again["alpha beta gamma <NUM>"].size == 2 and len(again["alpha beta gamma <NUM>"].raw_sample_logs) == 1
    first.unpersist()


def test_sessions_that_are_alike_stay_apart(spark):
    # Two known templates never become one session, however alike; a new one joins the nearer.
    first = onboarding.onboarding_sessions(_lines(spark, ["a b c d", "a b x y z", "a b c d e f"]))
    kept = sessions.merge_sessions(first.cache(), _lines(spark, ["a b c q", "a b x y w"], 9))
    assert set(_rows(kept)) == {"a b c <*>", "a b x y <*>", "a b c d e f"}
    assert {r.session_id for r in kept.collect()} == {r.session_id for r in first.collect()}
    first.unpersist()
