"""Framed captures, and retries without new lines."""

import time

from palisade.sources import captures
from palisade.sources.captures import frames, read_capture_stream, read_captures
from palisade.streaming import ingest
from tests import lines as L


def test_frames_of_both_kinds():
    text = "<34>1 é two\nlines".encode()
    content = b"%d " % len(text) + text + b"5 <1>ab" + b"plain line\n12 no count\n007 <1>zero\n\n" + b"99 <2>cut off"
    assert [m for _, m in frames(content)] == [text, b"<1>ab", b"plain line", b"12 no count", b"007 <1>zero", b"", b"<2>cut off"]
    assert all(content[at:at + len(m)] == m for at, m in frames(content))
    assert list(frames(b"")) == [] and [m for _, m in frames(b"\n\n")] == [b"", b""]
    # the line feed after a counted frame belongs to no message
    assert [m for _, m in frames(b"5 <1>ab\n5 <1>cd\nx")] == [b"<1>ab", b"<1>cd", b"x"]


def _captures(folder):
    folder.mkdir()
    (folder / "10.0.0.7_51514-1.cap").write_bytes(b"6 <1>a\nb7 <1>\xffcd" + b"<2>line\n  \n<3>last")
    (folder / "fe80--1_6000.cap").write_bytes(b"<4>six\r\n")
    (folder / "noname.cap").write_bytes(b"<5>none\n")
    return str(folder)


WANTED = {("<1>a\nb", "10.0.0.7"), ("<1>�cd<", "10.0.0.7"), ("2>line", "10.0.0.7"), ("<3>last", "10.0.0.7"), ("<4>six", "fe80::1"), ("<5>none", None)}


def test_batch_and_stream_read_alike(spark, tmp_path):
    folder = _captures(tmp_path / "in")
    rows = read_captures(spark, folder, "udp").collect()
    assert {(r.raw_payload, r.client_ip) for r in rows} == WANTED and {r.transport for r in rows} == {"udp"}
    out = str(tmp_path / "out")
    for _ in range(2):  # started again, it goes on where it was
        query = read_capture_stream(spark, folder, "udp").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    again = spark.read.parquet(out).collect()
    assert sorted(r.source_position for r in again) == sorted(r.source_position for r in rows)
    assert {(r.raw_payload, r.client_ip) for r in again} == WANTED


def test_a_delivery_completes_without_new_lines(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "192.168.1.9_1.cap").write_text(L.ALL[0] + "\n")
    taken, down = [], [True]

    def search_sink(df):
        if down[0]:
            raise OSError("down")
        taken.extend((r.event_id, r.client_ip) for r in df.select("event_id", "client_ip").collect())

    paths = [str(tmp_path / n) for n in ("staging", "dead", "ledger")]
    options = dict(search_sink=search_sink, lake_sink=lambda df: df.count())
    ingest.start(read_capture_stream(spark, str(source)), *paths, str(tmp_path / "check"), available_now=True, enriched=False, document=False,
                 **options).awaitTermination()
    state = lambda: {r.state for r in spark.read.parquet(paths[2]).collect()}
    assert state() == {"FAILED_RETRYABLE"} and not taken
    down[0] = False
    query = ingest.start_retries(spark, paths[0], paths[2], str(tmp_path / "clock"), every="1 second", **options)
    try:
        until = time.time() + 60
        while "DELIVERY_COMPLETE" not in state() and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    assert "DELIVERY_COMPLETE" in state() and [c for _, c in taken] == ["192.168.1.9"]


def test_a_long_capture_leaves_in_bounded_batches():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(["f"]), pa.array(["10.0.0.1"]), pa.array([b"<13>m\n\n" * 25_000], pa.binary())], names=["path", "client", "content"])
    out = list(captures._messages("tcp")(iter([batch])))
    assert [b.num_rows for b in out] == [10_000, 10_000, 5_000]
    assert [out[1]["source_position"][0].as_py(), out[1]["raw_payload"][0].as_py()] == ["f#70000", "<13>m"]
