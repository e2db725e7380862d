"""Payloads on the wire: LZ4 blocks without a frame, marked by a bit of the package's flag.

The block codec is the one that comes with Arrow; packages carry the length of what a block holds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Fixed value: the flag's bit for compressed data.
COMPRESSED = 1
#: Longest payload that is unpacked; packages that hold more are faulty.
MOST_BYTES = 1 << 30


def block(data: bytes) -> bytes:
    return pa.Codec("lz4_raw").compress(data, asbytes=True)


def unpacked_length(data: bytes) -> int | None:
    """How long a block's contents are, from its sequences; None if it ends within one.

    A sequence is a token, literals, and all but in the last a two-byte distance and a match of four bytes or more. The codec fills
    whatever room it is given, so that a length is never taken on trust."""
    at, total, end = 0, 0, len(data)

    def count(nibble: int, at: int) -> tuple[int, int]:
        n = nibble
        if nibble == 15:
            while True:
                n, at = n + data[at], at + 1
                if data[at - 1] != 255:
                    break
        return n, at

    try:
        while True:
            token = data[at]
            n, at = count(token >> 4, at + 1)
            at, total = at + n, total + n
            if at >= end:
                return total if at == end else None
            n, at = count(token & 15, at + 2)
            total += n + 4
    except IndexError:
        return None


def unblock(data: bytes, length: int | None, most: int = MOST_BYTES) -> bytes | None:
    """What a block holds; None if it is damaged, longer than most, or not of the length given."""
    room = unpacked_length(data)
    if room is None or room > most or length not in (None, room):
        return None
    try:
        return pa.Codec("lz4_raw").decompress(data, room, asbytes=True) if room else b""
    except (OSError, ValueError):
        return None


@F.arrow_udf(BinaryType())
def compressed(data: pa.Array) -> pa.Array:
    """Each payload as a block; null stays null."""
    return pa.array([None if x is None else block(x) for x in data.to_pylist()], pa.binary())


@F.arrow_udf(BinaryType())
def _unpacked(data: pa.Array, length: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unblock(x, n) for x, n in zip(data.to_pylist(), length.to_pylist(), strict=True)], pa.binary())


def pack(pkg: DataFrame, data: str = "data", enabled: bool = True) -> DataFrame:
    """pkg with data as it is sent, flag and source_data_len (the length before compression)."""
    plain = F.col(data).cast("binary")
    return pkg.withColumns({data: compressed(plain) if enabled else plain, "flag": F.lit(COMPRESSED if enabled else 0), "source_data_len": F.length(plain).cast("long")})


def unpack(pkg: DataFrame, data: str = "data", legacy: Column | None = None) -> DataFrame:
    """pkg with data as it was before compression, and fault (true if a block is damaged). Packages without the bit stay as they are,
    and their data is not handed to Python code; a null flag has no bit. legacy: packages from before the flag that are known to be compressed."""
    is_block = F.coalesce(F.col("flag").bitwiseAND(COMPRESSED) != 0, F.lit(False)) | F.coalesce(legacy if legacy is not None else F.lit(False), F.lit(False))
    own = F.when(is_block, F.col(data))
    out = pkg.withColumn("_is_block", is_block).withColumn("_plain", _unpacked(own, F.col("source_data_len").cast("long")))
    return out.withColumns({"fault": F.col("_is_block") & F.col(data).isNotNull() & F.col("_plain").isNull(), data: F.when(F.col("_is_block"), F.col("_plain")).otherwise(F.col(data))}).drop("_is_block", "_plain")
