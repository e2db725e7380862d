"""Messages on the wire: numbered fields, each a key (number and kind) and a number of 7 bits a byte or a length and its bytes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields of a package, by number, with their kinds.
PACKAGE = [(1, "epoch", "long"), (2, "trans_seq_no", "long"), (3, "gtid", "string"), (4, "split_flag", "long"), (5, "seq_no", "long"), (6, "data", "binary"), (7, "checksum", "long"), (8, "flag", "long"), (9, "source_data_len", "long"), (10, "version", "long")]

Fields = list[tuple[int, str, str]]


def varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first; negative numbers as their 64 bits."""
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n, at, shift = n | (b & 127) << shift, at + 1, shift + 7
        if b < 128:
            return n - (1 << 64) if n >> 63 else n, at


def message(values: list, fields: Fields) -> bytes:
    """Null fields are left out."""
    out = []
    for (number, _, kind), v in zip(fields, values, strict=True):
        if v is None:
            continue
        if kind == "long":
            out += [varint(number << 3), varint(int(v))]
        else:
            raw = v.encode() if kind == "string" else bytes(v)
            out += [varint(number << 3 | 2), varint(len(raw)), raw]
    return b"".join(out)


def parsed(data: bytes, fields: Fields) -> list | None:
    """Values by field; numbers that are not known are passed over. None if the message ends within a field."""
    place, kinds = {n: i for i, (n, _, _) in enumerate(fields)}, [k for _, _, k in fields]
    out, at = [None] * len(fields), 0
    try:
        while at < len(data):
            key, at = read_varint(data, at)
            i = place.get(key >> 3)
            if key & 7 == 0:
                v, at = read_varint(data, at)
            elif key & 7 == 2:
                n, at = read_varint(data, at)
                v, at = data[at : at + n], at + n
                if at > len(data) or n < 0:
                    return None
                v = v.decode() if i is not None and kinds[i] == "string" else v
            else:
                return None
            if i is not None:
                out[i] = v
    except (IndexError, UnicodeDecodeError):
        return None
    return out


def encode(df: DataFrame, fields: Fields) -> DataFrame:
    """message, binary, of each row of df, which has a column for each field."""

    def run(batches):
        for b in batches:
            cols = [b.column(n).to_pylist() for _, n, _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array([message(v, fields) for v in zip(*cols, strict=True)], pa.binary())], names=["message"])

    return df.select(*[F.col(n).cast(k).alias(n) for _, n, k in fields]).mapInArrow(run, "message binary")


def decode(df: DataFrame, fields: Fields) -> DataFrame:
    """The fields of each message; all null for one that cannot be read."""
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches):
        for b in batches:
            rows = [parsed(m, fields) or [None] * len(fields) for m in b.column("message").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, (_, _, k) in enumerate(fields)], names=[n for _, n, _ in fields])

    return df.select("message").mapInArrow(run, ", ".join(f"{n} {k}" for _, n, k in fields))
