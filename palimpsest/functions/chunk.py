"""Framed chunks as binary values: encode, check, and parse into records.

Layout, little-endian: a 64-byte head (magic, check, prefix, epoch, group,
tokens, version, expiry, records, flags, length, stripe index and count, pad),
then each record with an 8-byte head, zero-padded to whole pages.  The check is
the CRC-32 of the pages with its own field as zero.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = 4096
#: Fixed value: the format's mark.
MAGIC = 0x4B43564B
HEAD, HEAD_BYTES = "<IIQQIIIIHHIIIII", 64
RECORD, RECORD_BYTES = "<HHI", 8


def encode(prefix_id: int, group_idx: int, ver: int, records: list[bytes], expire_ts: int = 0, n_tokens: int = 32, epoch: int = 1) -> bytes:
    body = b"".join(struct.pack(RECORD, k, 0, len(r)) + r for k, r in enumerate(records))

    def head(crc):
        return struct.pack(HEAD, MAGIC, crc, prefix_id & ((1 << 64) - 1), epoch, group_idx, n_tokens, ver & 0xFFFFFFFF, expire_ts & 0xFFFFFFFF, len(records), 0, len(body), 0, 0, 0, 0)

    size = -(-(HEAD_BYTES + len(body)) // PAGE) * PAGE
    pages = (head(0) + body).ljust(size, b"\0")
    return head(zlib.crc32(pages)) + pages[HEAD_BYTES:]


def valid(chunk: bytes | None) -> bool:
    if not chunk or len(chunk) % PAGE or struct.unpack_from("<I", chunk)[0] != MAGIC:
        return False
    crc = struct.unpack_from("<I", chunk, 4)[0]
    return zlib.crc32(chunk[:4] + b"\0\0\0\0" + chunk[8:]) == crc


def parse(chunk: bytes) -> list[tuple[int, int, int]]:
    """(layer, offset, length) of the records, each checked against the chunk's bounds."""
    h, out, at = struct.unpack_from(HEAD, chunk), [], HEAD_BYTES
    for _ in range(h[8]):
        if at + RECORD_BYTES > len(chunk):
            raise ValueError("a record's head is out of bounds")
        layer, _, size = struct.unpack_from(RECORD, chunk, at)
        if at + RECORD_BYTES + size > len(chunk):
            raise ValueError("a record is out of bounds")
        out.append((layer, at + RECORD_BYTES, size))
        at += RECORD_BYTES + size
    return out


@F.pandas_udf(T.BinaryType())
def encode_udf(prefix: pd.Series, group: pd.Series, ver: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([encode(int(p), int(g), int(v), [(t or "").encode()]) for p, g, v, t in zip(prefix, group, ver, text)])


@F.pandas_udf(T.BooleanType())
def valid_udf(chunk: pd.Series) -> pd.Series:
    return pd.Series([valid(c) for c in chunk])


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("layer", "off", "len")])))
def parse_udf(chunk: pd.Series) -> pd.Series:
    return pd.Series([[{"layer": a, "off": b, "len": c} for a, b, c in parse(x)] if valid(x) else [] for x in chunk])


def records_of(df: DataFrame, chunk: str = "chunk") -> DataFrame:
    """One row a record of each valid chunk, with its bytes."""
    return df.withColumn("r", F.explode(parse_udf(chunk))).select("*", F.col("r.layer").alias("layer"), F.substring(F.col(chunk), F.col("r.off") + 1, F.col("r.len")).alias("payload")).drop("r")


def pages_crc(payload):
    """CRC-32 of a payload padded with zeros to whole pages; a built-in, so it stays in the JVM."""
    size = (F.ceil(F.length(payload) / PAGE) * PAGE).cast("int")
    return F.when(F.length(payload) > 0, F.crc32(F.rpad(payload, size, F.lit(b"\0"))))
