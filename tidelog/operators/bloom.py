"""Bloom filters over keys, one for each file, built and probed in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codec import hash_values

# Probes for each bit a key has, their bounds, and the least size.
PROBES_PER_BIT = 0.69
MOST_PROBES = 30
LEAST_BITS = 64


def _places(keys, probes: int, bits: int) -> np.ndarray:
    h = hash_values(keys)
    step = (h >> np.uint32(17)) | (h << np.uint32(15))
    return ((h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint32)) % np.uint32(bits)).astype(np.int64)


def create(keys: list[bytes], bits_per_key: int = 10) -> bytes:
    """Filter bytes: bits, then the number of probes."""
    probes = min(MOST_PROBES, max(1, int(bits_per_key * PROBES_PER_BIT)))
    size = (max(len(keys) * bits_per_key, LEAST_BITS) + 7) // 8
    bits = np.zeros(size * 8, np.uint8)
    if keys:
        bits[_places(keys, probes, size * 8).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes() + bytes([probes])


def may_contain(filter_: bytes, keys) -> np.ndarray:
    """False only for keys that aren't in. A filter too short holds none; one with too many probes tells nothing."""
    if len(filter_) < 2:
        return np.zeros(len(keys), bool)
    probes = filter_[-1]
    if probes > MOST_PROBES:
        return np.ones(len(keys), bool)
    bits = np.unpackbits(np.frombuffer(filter_[:-1], np.uint8), bitorder="little")
    return bits[_places(keys, probes, len(bits))].all(1) if len(keys) else np.zeros(0, bool)


def build(entries: DataFrame, bits_per_key: int = 10) -> DataFrame:
    """(file_no, filter) over the keys of each file. A file is what one task can hold, by its size."""

    def one(table: pa.Table) -> pa.Table:
        keys = sorted({bytes(k) if not isinstance(k, str) else k.encode() for k in table["k"].to_pylist()})
        return pa.table({"file_no": pa.array([table["file_no"][0].as_py()], pa.int64()), "filter": pa.array([create(keys, bits_per_key)], pa.binary())})

    return entries.select(F.col("file_no").cast("long"), "k").groupBy("file_no").applyInArrow(one, "file_no long, filter binary")


def probe(requests: DataFrame, filters: DataFrame) -> DataFrame:
    """Pairs (k, file_no) with whether the file may hold the key. Requests name the file they'd read.

    A file's requests and its filter meet as two groups, so the filter travels once, not
    with each request. A file without a filter may hold anything.
    """
    kind = dict(requests.dtypes)["k"]

    def one(asked: pa.Table, found: pa.Table) -> pa.Table:
        keys = [k.encode() if isinstance(k, str) else bytes(k) for k in asked["k"].to_pylist()]
        hit = may_contain(found["filter"][0].as_py(), keys) if found.num_rows else np.ones(len(keys), bool)
        return pa.table({"k": asked["k"], "file_no": asked["file_no"].cast(pa.int64()), "may_contain": pa.array(hit)})

    both = requests.select("k", F.col("file_no").cast("long")).groupBy("file_no").cogroup(filters.groupBy("file_no"))
    return both.applyInArrow(one, f"k {kind}, file_no long, may_contain boolean")
