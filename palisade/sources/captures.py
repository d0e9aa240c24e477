"""Captured connections: files that a collector has written per TCP connection or for UDP datagrams, framed as syslog is sent.

A capture's name begins with the client's address and an underscore (``10.0.0.7_51514-0001.cap``; the colons of an IPv6 address may be
dots or dashes as in ``fe80--1_...``). Its bytes are frames one after the other: with octet counting (``17 <34>1 message...``: a number without
leading zero, a space, and so many bytes) or up to a line feed; both may stand in one capture. A count that runs past the capture's
end takes what is there, as a connection may break; digits and a space before a frame that is no syslog message (no ``<`` behind them)
are text of a line. Bytes that are no UTF-8 read as U+FFFD, blank messages are dropped.

A message's position is file and byte, so it is the same in every run. A capture must fit in a row: collectors close files by size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_COUNT = re.compile(rb"([1-9][0-9]{0,8}) (?=<)")
#: Messages, and their bytes, that leave a capture together.
BATCH_MESSAGES, BATCH_BYTES = 10_000, 4 << 20
_FRAMES = "raw_payload string, source_position string, transport string, client_ip string"


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of each message."""
    at = 0
    while at < len(content):
        count = _COUNT.match(content, at)
        if count:
            begin, end = count.end(), min(len(content), count.end() + int(count[1]))
            yield begin, content[begin:end]
            at = end + (content[end:end + 1] == b"\n")
        else:
            end = content.find(b"\n", at)
            end = len(content) if end < 0 else end
            yield at, content[at:end]
            at = end + 1


def _messages(transport: str):
    def rows(path: str, client: str, found: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([m for _, m in found], pa.string()), pa.array([f"{path}#{at}" for at, _ in found], pa.string()),
             pa.array([transport] * len(found), pa.string()), pa.array([client] * len(found), pa.string())],
            names=["raw_payload", "source_position", "transport", "client_ip"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, clients, contents = batch.columns
            for path, client, content in zip(paths.to_pylist(), clients.to_pylist(), contents):
                found, size = [], 0
                for at, m in frames(content.as_py() or b""):
                    text = m.decode("utf-8", "replace").strip()
                    if text:
                        found.append((at, text))
                        size += len(m)
                    if len(found) >= BATCH_MESSAGES or size >= BATCH_BYTES:
                        yield rows(path, client, found)
                        found, size = [], 0
                if found:
                    yield rows(path, client, found)

    return run


def _read(files: DataFrame, transport: str) -> DataFrame:
    address = "regexp_extract(substring_index(path, '/', -1), '^([^_]+)_', 1)"
    dotted = rf"regexp_like({address}, '^[0-9.]+$')"
    client = f"nullif(if({dotted}, {address}, translate({address}, '-', ':')), '')"
    return files.selectExpr("path", f"{client} as client", "content").mapInArrow(_messages(transport), _FRAMES)


def read_captures(spark: SparkSession, path: str, transport: str = "tcp") -> DataFrame:
    """raw_payload, source_position, transport, client_ip of every message of the captures below a folder."""
    return _read(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), transport)


def read_capture_stream(spark: SparkSession, path: str, transport: str = "tcp", max_files_per_trigger: int = 100) -> DataFrame:
    """The same as a stream: captures that are moved into the folder when they are closed."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).load(path)
    return _read(files, transport)


__all__ = ["frames", "read_capture_stream", "read_captures"]
