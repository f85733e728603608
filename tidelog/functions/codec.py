"""Scalar functions of the key-value model: tags, names, numbers, checksums, separators.

Where Spark's own functions can say it they do; the rest are Arrow functions that work on
many rows at once in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the formats.
CRC32C_POLYNOMIAL = 0x82F63B78
CRC_MASK_DELTA = 0xA282EAD8
HASH_MULTIPLIER = 0xC6A4A793
HASH_SHIFT = 24
BLOOM_SEED = 0xBC9F1D34
MAX_UINT64 = 18446744073709551615


def pack_tag(seq: Column, op: Column) -> Column:
    return F.shiftleft(seq.cast("long"), 8).bitwiseOR(op.cast("long"))


def unpack_seq(tag: Column) -> Column:
    return F.shiftrightunsigned(tag, 8)


def unpack_op(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(255).cast("long"))


def debug_key(k: Column, seq: Column, op: Column) -> Column:
    return F.format_string("'%s' @ %d : %d", k, seq.cast("long"), op.cast("long"))


def varint_length(n: Column) -> Column:
    """Bytes of a non-negative number at 7 bits a byte."""
    out = F.when(n < (1 << 7), 1)
    for size in range(2, 9):
        out = out.when(n < (1 << 7 * size), size)
    return out.otherwise(9)


def _reversed_hex(n: Column, width: int) -> Column:
    h = F.lpad(F.hex(n), 2 * width, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))])


def fixed_le(n: Column, width: int) -> Column:
    """Little-endian bytes of a number; width 4 or 8."""
    return F.unhex(_reversed_hex(n.cast("long"), width))


def fixed_le_value(b: Column, width: int) -> Column:
    """Number of little-endian bytes, as decimal(20,0): 64 unsigned bits don't fit a long."""
    h = F.hex(b)
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).cast("decimal(20,0)")


@F.pandas_udf(T.BinaryType())
def varint(numbers: pd.Series) -> pd.Series:
    """Varint bytes of non-negative longs."""
    n = numbers.to_numpy(np.uint64)
    out = np.zeros((len(n), 10), np.uint8)
    size = np.ones(len(n), np.int64)
    for i in range(10):
        rest = n >> np.uint64(7)
        out[:, i] = (n & np.uint64(127)) | np.where(rest > 0, np.uint64(128), np.uint64(0))
        size += (rest > 0) & (n > 0)
        n = rest
    return pd.Series([row[:k].tobytes() for row, k in zip(out, size)])


@F.pandas_udf(T.LongType())
def varint_value(data: pd.Series) -> pd.Series:
    """Number of varint bytes; null if they end too early."""

    def one(b: bytes | None):
        n = 0
        for i, x in enumerate(b or b""):
            n |= (x & 127) << 7 * i
            if x < 128:
                return n
        return None

    return pd.Series([one(b) for b in data], dtype="Int64")


def _matrix(values) -> tuple[np.ndarray, np.ndarray]:
    values = [bytes(v) if v is not None else b"" for v in values]
    size = np.fromiter(map(len, values), np.int64, len(values))
    width = int(size.max()) if len(size) else 0
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width), size


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(CRC32C_POLYNOMIAL), t >> np.uint32(1))
    return t


_CRC = _crc_table()


def crc32c_values(values, start: np.ndarray | int = 0) -> np.ndarray:
    """Castagnoli checksums, all values one byte at a time together; ``start``: of what came before."""
    rows, size = _matrix(values)
    crc = (np.zeros(len(size), np.uint32) + np.uint32(start)) ^ np.uint32(0xFFFFFFFF)
    for i in range(rows.shape[1]):
        crc = np.where(i < size, _CRC[(crc ^ rows[:, i]) & np.uint32(255)] ^ (crc >> np.uint32(8)), crc)
    return crc ^ np.uint32(0xFFFFFFFF)


@F.pandas_udf(T.LongType())
def crc32c(data: pd.Series) -> pd.Series:
    return pd.Series(crc32c_values(data).astype(np.int64))


def mask_crc(crc: Column) -> Column:
    """Checksum as stored next to data that may hold checksums itself."""
    turned = F.shiftright(crc, 15).bitwiseOR(F.shiftleft(crc, 17)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (turned + F.lit(CRC_MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))


def unmask_crc(masked: Column) -> Column:
    turned = (masked - F.lit(CRC_MASK_DELTA)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftright(turned, 17).bitwiseOR(F.shiftleft(turned, 15)).bitwiseAND(F.lit(0xFFFFFFFF))


def hash_values(values, seed: int = BLOOM_SEED) -> np.ndarray:
    """32-bit hashes: words of four bytes are mixed in together over all values, then the rest."""
    rows, size = _matrix(values)
    m = np.uint32(HASH_MULTIPLIER)
    pad = np.zeros((len(size), -rows.shape[1] % 4 + 4), np.uint8)
    words = np.ascontiguousarray(np.hstack([rows, pad])).view("<u4")
    h = np.uint32(seed) ^ (size.astype(np.uint32) * m)
    full = size // 4
    for i in range(words.shape[1] - 1):
        mixed = (h + words[:, i]) * m
        h = np.where(i < full, mixed ^ (mixed >> np.uint32(16)), h)
    rest = words[np.arange(len(size)), full]  # padded with zeros
    mixed = (h + rest) * m
    return np.where(size % 4 > 0, mixed ^ (mixed >> np.uint32(HASH_SHIFT)), h).astype(np.uint32)


@F.pandas_udf(T.LongType())
def hash32(data: pd.Series) -> pd.Series:
    return pd.Series(hash_values(data).astype(np.int64))


@F.pandas_udf(T.StringType())
def escaped(data: pd.Series) -> pd.Series:
    r"""Printable ASCII as it is, other bytes as \xNN."""
    text = [chr(b) if 32 <= b <= 126 else f"\\x{b:02x}" for b in range(256)]
    return pd.Series([None if v is None else "".join([text[b] for b in bytes(v)]) for v in data])


def decimal_prefix(s: Column) -> Column:
    """Number that a string starts with, as decimal(20,0); null if there is none or it passes 64 bits."""
    digits = F.regexp_extract(s, r"^[0-9]+", 0)
    significant = F.regexp_replace(digits, r"^0+(?=[0-9])", "")
    n = F.when((digits != "") & (F.length(significant) <= 20), significant.try_cast("decimal(20,0)"))
    return F.when(n <= F.lit(str(MAX_UINT64)).cast("decimal(20,0)"), n)


def after_decimal(s: Column) -> Column:
    return F.when(decimal_prefix(s).isNotNull(), F.regexp_replace(s, r"^[0-9]+", "")).otherwise(s)


# Names of files in a database folder.
_SUFFIX = {"log": "LOG", "ldb": "TABLE", "sst": "TABLE", "dbtmp": "TEMP"}
_NAMED = {"CURRENT": "CURRENT", "LOCK": "LOCK", "LOG": "INFO_LOG", "LOG.old": "OLD_INFO_LOG"}


def file_kind(path: Column) -> Column:
    """Kind of a file by its name; null if it isn't one of a database's."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    out = F.when(F.lit(False), F.lit(""))
    for text, kind in _NAMED.items():
        out = out.when(name == text, kind)
    out = out.when(name.rlike(r"^MANIFEST-[0-9]+$"), "MANIFEST")
    for suffix, kind in _SUFFIX.items():
        out = out.when(name.rlike(rf"^[0-9]+\.{suffix}$"), kind)
    return out


def file_number(path: Column) -> Column:
    """Number in a file's name: 0 for those without one, null if the name isn't known."""
    name = F.regexp_extract(path, r"[^/]*$", 0)
    return F.when(file_kind(path).isNotNull(), F.coalesce(F.regexp_extract(name, r"[0-9]+", 0).try_cast("long"), F.lit(0).cast("long")))


def file_name(kind: str, number: Column) -> Column:
    padded = F.lpad(number.cast("string"), 6, "0")
    if kind == "MANIFEST":
        return F.concat(F.lit("MANIFEST-"), padded)
    suffix = {"LOG": "log", "TABLE": "ldb", "TEMP": "dbtmp"}[kind]
    return F.concat(padded, F.lit("." + suffix))


def clipped(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def shortest_separator(start: bytes, limit: bytes) -> bytes:
    """A short key in [start, limit); ``start`` itself if none is shorter."""
    same = next((i for i, (a, b) in enumerate(zip(start, limit)) if a != b), None)
    if same is None or start[same] + 1 >= limit[same]:
        return start
    return start[:same] + bytes([start[same] + 1])


def short_successor(key: bytes) -> bytes:
    """A short key >= key."""
    at = next((i for i, b in enumerate(key) if b != 255), None)
    return key if at is None else key[:at] + bytes([key[at] + 1])


@F.pandas_udf(T.BinaryType())
def separator(start: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([shortest_separator(bytes(a), bytes(b)) for a, b in zip(start, limit)])


@F.pandas_udf(T.BinaryType())
def successor(key: pd.Series) -> pd.Series:
    return pd.Series([short_successor(bytes(k)) for k in key])


# Multiplier and modulus of the random numbers.
RANDOM_MULTIPLIER, RANDOM_MODULUS = 16807, 2147483647


def random_number(seed: int, i: Column) -> Column:
    """The i-th number after the seed: seed x multiplier^i by the bits of i, so any place is reached alone."""
    powers = [pow(RANDOM_MULTIPLIER, 1 << bit, RANDOM_MODULUS) for bit in range(40)]
    factors = F.transform(F.array(*[F.lit(p).cast("long") for p in powers]), lambda p, bit: F.when(F.getbit(i, bit) == 1, p).otherwise(F.lit(1).cast("long")))
    return F.aggregate(factors, F.lit(seed % RANDOM_MODULUS).cast("long"), lambda x, f: x * f % RANDOM_MODULUS)
