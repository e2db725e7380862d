"""Binary event files: a reader, a writer, and decoders of what fixed headers hold.

An event is a 19-byte little-endian header (time, type, server, size, end position, flags) and a body.
"""

from __future__ import annotations

import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC, HEADER = b"\xfebin", struct.Struct("<IBIIIH")
#: Rows of a batch that is handed to Spark.
BATCH = 8192
#: Which part of the reader an event's body goes to; all others have a header only.
DECODERS = {2: "query", 4: "rotate", 16: "xid", 19: "table_map", 33: "gtid", **{k: "rows" for k in (23, 24, 25, 30, 31, 32)}}
SCHEMA = "path string, timestamp long, event_type int, server_id long, event_size long, log_pos long, flag int, payload binary"


def encode(events: list[tuple[int, int, int, int, bytes]]) -> bytes:
    """A file of (timestamp, type, server_id, flag, body)."""
    out, at = [MAGIC], len(MAGIC)
    for ts, kind, server, flag, body in events:
        size = HEADER.size + len(body)
        at += size
        out.append(HEADER.pack(ts, kind, server, size, at, flag) + body)
    return b"".join(out)


def decode(path: str, data: bytes) -> list[tuple]:
    """Events of a file; a partial one at the end is left for the next read."""
    at, out = len(MAGIC) if data[: len(MAGIC)] == MAGIC else 0, []
    while at + HEADER.size <= len(data):
        ts, kind, server, size, end, flag = HEADER.unpack_from(data, at)
        if size < HEADER.size or at + size > len(data):
            break
        out.append((path, ts, kind, server, size, end, flag, data[at + HEADER.size : at + size]))
        at += size
    return out


def decoded(files: DataFrame, checksums: bool = False, with_payload: bool = True) -> DataFrame:
    """The events of files (path, content). checksums: each ends in four bytes of one, which are left out; with_payload: bodies are kept."""

    def run(batches):
        names = ["path", "timestamp", "event_type", "server_id", "event_size", "log_pos", "flag", "payload"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                rows = decode(p, c)
                for at in range(0, len(rows), BATCH):
                    part = rows[at : at + BATCH]
                    *cols, bodies = zip(*part, strict=True)
                    bodies = [strip_checksum(x, checksums) for x in bodies] if with_payload else [None] * len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, bodies], types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """All events of the files at path; Spark lists and reads the files, so that any store works."""
    return decoded(spark.read.format("binaryFile").load(path), checksums)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1, checksums: bool = False) -> DataFrame:
    """Events of files as they arrive at path. A file is read once, when it is there: files are moved in whole."""
    raw = "path string, modificationTime timestamp, length long, content binary"
    return decoded(spark.readStream.schema(raw).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(path), checksums)


def write(ev: DataFrame, body, by: str, order: list[str], checksums: bool = False, tasks: int | None = None) -> DataFrame:
    """path, content: a binary file for each value of by, of the events in order. body(row) gives (timestamp, type, flag, bytes). tasks: to how many
    the files of a large log are dealt."""

    def run(batches):
        own, held = None, []

        def file():
            return pa.RecordBatch.from_arrays([pa.array([str(own)]), pa.array([encode(held)], pa.binary())], names=["path", "content"])

        for b in batches:
            for r in b.to_pylist():
                if r[by] != own:
                    if held:
                        yield file()
                    own, held = r[by], []
                ts, kind, flag, data = body(r)
                held.append((ts, kind, 1, flag, data + struct.pack("<I", zlib.crc32(data)) if checksums else data))
        if held:
            yield file()

    return (ev.repartition(tasks, by) if tasks else ev.repartition(by)).sortWithinPartitions(by, *order).mapInArrow(run, "path string, content binary")


def group_commit_of(body: bytes) -> tuple[int | None, int | None]:
    """last_committed and sequence_number of a gtid event, which has them if a type code of 2 and 16 bytes follow."""
    if len(body) < 42 or body[25] != 2:
        return None, None
    return struct.unpack_from("<qq", body, 26)


def query_of(body: bytes) -> tuple[str, str]:
    """Database and statement of a query event: 13 bytes, the status variables, whose length they tell, a name that ends in 0, and the rest."""
    names, status = body[8], struct.unpack_from("<H", body, 11)[0]
    at = 13 + status
    return body[at : at + names].decode(), body[at + names + 1 :].decode("utf-8", "replace")


DETAILS = "gtid string, last_committed long, sequence_number long, database_name string, statement string, next_file string, next_file_pos long, xid long, decoder string"


def details(events: DataFrame) -> DataFrame:
    """events (event_type, payload) with what their bodies hold, by the decoder of their type; null for what a type does not have."""

    fields = [(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in DETAILS.split(", ")]

    @F.arrow_udf(f"struct<{DETAILS.replace(' ', ':').replace(',:', ',')}>")
    def read_body(kinds: pa.Array, bodies: pa.Array) -> pa.Array:
        n = len(kinds)
        gtid, committed, sequence, database, statement, file, pos, xid = ([None] * n for _ in range(8))
        kinds = kinds.to_pylist()
        for i, (kind, body) in enumerate(zip(kinds, bodies.to_pylist(), strict=True)):
            if kind == 33:
                gtid[i], (committed[i], sequence[i]) = gtid_of(body), group_commit_of(body)
            elif kind == 2:
                database[i], statement[i] = query_of(body)
            elif kind == 4:
                file[i], pos[i] = rotate_of(body)
            elif kind == 16:
                (xid[i],) = struct.unpack_from("<q", body)
        cols = [gtid, committed, sequence, database, statement, file, pos, xid, [DECODERS.get(k, "header") for k in kinds]]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], names=[c for c, _ in fields])

    return events.withColumn("_d", read_body("event_type", "payload")).select(*events.columns, "_d.*")


def gtid_of(body: bytes) -> str:
    """16 bytes of uuid and a number, after a flag byte."""
    u = body[1:17].hex()
    return f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}:{struct.unpack_from('<q', body, 17)[0]}"


def rotate_of(body: bytes) -> tuple[str, int]:
    """Name of the next file and the position in it."""
    return body[8:].decode(), struct.unpack_from("<Q", body)[0]


def length_encoded(data: bytes, at: int) -> tuple[int | None, int]:
    """Value and the place after it."""
    first = data[at]
    if first < 251:
        return first, at + 1
    if first == 251:
        return None, at + 1
    n = {252: 2, 253: 3, 254: 8}[first]
    return int.from_bytes(data[at + 1 : at + 1 + n], "little"), at + 1 + n


def strip_checksum(body: bytes, enabled: bool, truncated: bool = False) -> bytes:
    return body[:-4] if enabled and not truncated else body
