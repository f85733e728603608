"""Record logs: bytes in 32 KiB blocks with checksums, and batches in them.

A record is cut into fragments so that none crosses a block; each has a header with a
masked CRC-32C of its type and bytes. A torn end is what a crash leaves and is passed
over; damage elsewhere is dropped and reported, with the rest of its block where lengths
can't be trusted. Many logs are scanned at once, a file a task; logs of tables of rows are
written by tasks, many of them or one in parts of whole blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.codec import CRC_MASK_DELTA, crc32c_values
from ..operators import ordered
from ..operators.batches import Batch, check_ops
from ..schema import DELETE, PUT, Corruption

# Fixed values of the format.
BLOCK = 32768
HEADER = 7
FULL, FIRST, MIDDLE, LAST = 1, 2, 3, 4


#: Blocks of which the checksums are made together, and bytes of a part of one log, about.
TOGETHER = 64
PART_BYTES = 4 << 20
#: What ends a file written by tasks: less than a header, so readers pass over it.
END = "\0"


def _sums(pieces: list[tuple[int, bytes]]) -> list[int]:
    """Masked checksums of fragments (kind, bytes): those of like length together, 8 MiB at most."""
    out = np.zeros(len(pieces), np.uint64)
    groups: dict[int, list[int]] = {}
    for i, (_, data) in enumerate(pieces):
        groups.setdefault(len(data).bit_length(), []).append(i)
    for bits, group in groups.items():
        step = max(1, (8 << 20) >> bits)
        for j in range(0, len(group), step):
            some = group[j : j + step]
            out[some] = crc32c_values([bytes([pieces[i][0]]) + pieces[i][1] for i in some])
    turned = (out >> np.uint64(15)) | (out << np.uint64(17))
    return ((turned + np.uint64(CRC_MASK_DELTA)) & np.uint64(0xFFFFFFFF)).tolist()


def _sum(kind: int, data: bytes) -> int:
    return _sums([(kind, data)])[0]


class Writer:
    """Appends records to a byte string; ``start``: bytes the log has already."""

    def __init__(self, start: int = 0):
        self.at = start % BLOCK
        self.out = bytearray()

    def _emit(self, data: bytes) -> None:
        self.out += data
        self.at = (self.at + len(data)) % BLOCK

    def append(self, record: bytes) -> None:
        self.append_all([record])

    def append_all(self, records: Iterable[bytes]) -> None:
        laid: list[tuple[int, bytes]] = []  # fragments, and space at a block's end as kind 0
        at = self.at
        for record in records:
            kind_first = True
            while True:
                room = BLOCK - at
                if room < HEADER:
                    laid.append((0, b"\0" * room))
                    at, room = 0, BLOCK
                part, record = record[: room - HEADER], record[room - HEADER :]
                kind = (FULL if kind_first else LAST) if not record else (FIRST if kind_first else MIDDLE)
                laid.append((kind, part))
                at = (at + HEADER + len(part)) % BLOCK
                kind_first = False
                if not record:
                    break
        sums = iter(_sums([x for x in laid if x[0]]))
        for kind, part in laid:
            self._emit(next(sums).to_bytes(4, "little") + len(part).to_bytes(2, "little") + bytes([kind]) + part if kind else part)


def _laid(data: bytes, start: int) -> Iterator[tuple]:
    """Fragments of a block as their headers have them, sums not compared: (offset, kind, bytes or reason, sum, bytes left)."""
    block = data[start : start + BLOCK]
    last_block, at = start + BLOCK > len(data), 0
    while len(block) - at >= HEADER:
        size, kind = int.from_bytes(block[at + 4 : at + 6], "little"), block[at + 6]
        body = block[at + HEADER : at + HEADER + size]
        if kind == 0 and size == 0:
            break  # space laid out beforehand
        if len(body) < size:
            if not last_block:
                yield start + at, None, "longer than its block", None, len(block) - at
            break
        yield start + at, kind, body, int.from_bytes(block[at : at + 4], "little"), len(block) - at
        at += HEADER + size


def fragments(data: bytes) -> Iterator[tuple]:
    """(offset, kind, bytes), or (offset, None, reason, bytes dropped) for damage."""
    for first in range(0, len(data), TOGETHER * BLOCK):
        blocks = [list(_laid(data, start)) for start in range(first, min(len(data), first + TOGETHER * BLOCK), BLOCK)]
        sums = iter(_sums([(kind, body) for block in blocks for _, kind, body, *_ in block if kind is not None]))
        for block in blocks:
            made = [None if kind is None else next(sums) for _, kind, *_ in block]
            for (at, kind, body, stored, left), right in zip(block, made):
                if kind is None or stored != right:
                    yield at, None, body if kind is None else "bytes and checksum differ", left
                    break
                yield at, kind, body


def scan(data: bytes, offset: int = 0) -> Iterator[tuple]:
    """(offset, record) of each whole record that starts at ``offset`` or later; (offset, None, reason, bytes) for drops."""
    held: list[bytes] | None = None
    began = 0
    for at, kind, body, *dropped in fragments(data):
        if kind is None:
            if at >= offset:
                yield at, None, body, dropped[0]
            if held is not None:
                yield began, None, "lost with the damage inside it", sum(map(len, held))
            held = None
        elif kind in (FULL, FIRST):
            if held is not None:
                yield began, None, "begun and never finished", sum(map(len, held))
            held, began = ([body], at) if kind == FIRST else (None, at)
            if kind == FULL and at >= offset:
                yield at, body
        elif kind in (MIDDLE, LAST):
            if held is None:
                if at >= offset and offset == 0:
                    yield at, None, "goes on what never began", len(body)
                continue
            held.append(body)
            if kind == LAST:
                if began >= offset:
                    yield began, b"".join(held)
                held = None
        else:
            yield at, None, "of no known kind", len(body) + sum(map(len, held or []))
            held = None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def encode_batch(batch: Batch, seq: int) -> bytes:
    out = bytearray(seq.to_bytes(8, "little") + len(batch).to_bytes(4, "little"))
    for op, k, v in batch.ops:
        out += bytes([op]) + _varint(len(k)) + k + (_varint(len(v)) + v if op == PUT else b"")
    return bytes(out)


def decode_batch(data: bytes) -> tuple[int, Batch]:
    """First sequence and the batch; raises Corruption where it isn't well formed."""
    if len(data) < 12:
        raise Corruption("batch too small")
    at, ops = 12, []

    def piece() -> bytes:
        nonlocal at
        n = shift = 0
        while True:
            if at >= len(data):
                raise Corruption("bad length in batch")
            b, at = data[at], at + 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                break
        at += n
        if at > len(data):
            raise Corruption("bad length in batch")
        return data[at - n : at]

    while at < len(data):
        op, at = data[at], at + 1
        if op not in (DELETE, PUT):
            raise Corruption(f"unknown batch tag {op}")
        ops.append((op, piece(), piece() if op == PUT else None))
    if len(ops) != int.from_bytes(data[8:12], "little"):
        raise Corruption("batch has the wrong count")
    check_ops(ops)
    return int.from_bytes(data[:8], "little"), Batch(ops)


def log_bytes(batches: Iterable[tuple[int, Batch]]) -> bytes:
    w = Writer()
    w.append_all(encode_batch(batch, seq) for seq, batch in batches)
    return bytes(w.out)


def _batches(rows: Iterator[pa.RecordBatch], gaps: bool) -> Iterator[tuple[int, int, Batch]]:
    """(log_no, first sequence, batch) of rows (log_no, batch_id, seq, op, k, v) in order; with ``gaps`` a batch ends before one in the sequence."""
    here, first, ops = None, 0, []
    for batch in rows:
        for log_no, batch_id, seq, op, k, v in zip(*(c.to_pylist() for c in batch.columns)):
            if (log_no, batch_id) != here or (gaps and seq != first + len(ops)):
                if ops:
                    yield here[0], first, Batch(ops)
                here, first, ops = (log_no, batch_id), seq, []
            ops.append((op, k, v))
    if ops:
        yield here[0], first, Batch(ops)


def _written(rows: DataFrame, path: str, by: str, run) -> None:
    """Each of the byte strings that ``run`` makes of rows dealt by ``by`` as a file, written by its task."""
    dealt = rows.select("log_no", "batch_id", "seq", "op", F.col("k").cast("binary").alias("k"), F.col("v").cast("binary").alias("v"))
    made = dealt.repartitionByRange(by).sortWithinPartitions("log_no", "batch_id", "seq").mapInArrow(run, "content binary")
    made.select(F.col("content").cast("string").alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def write_logs(rows: DataFrame, path: str) -> None:
    """A log for each ``log_no`` of rows (log_no, batch_id, seq, op, k, v), as a file in a new folder; see ``replay``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, log in itertools.groupby(_batches(batches, True), lambda b: b[0]):
            yield pa.RecordBatch.from_arrays([pa.array([log_bytes((seq, b) for _, seq, b in log)], pa.binary())], ["content"])

    _written(rows, path, "log_no", run)


def write_log(rows: DataFrame, path: str) -> None:
    """One log of all batches, as a new folder of parts in order, each of whole blocks; see ``read_log``. A batch is a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def part() -> pa.RecordBatch:
            w = Writer()
            w.append_all(held)
            data = bytes(w.out) + b"\0" * (-(len(w.out) + len(END)) % BLOCK)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["content"])

        for _, seq, batch in _batches(batches, False):
            held.append(encode_batch(batch, seq))
            size += len(held[-1])
            if size >= PART_BYTES:
                yield part()
                size = 0
        if held:
            yield part()

    _written(rows, path, "batch_id", run)


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", names).load(path)


def read(spark: SparkSession, path: str, names: str = "*.log") -> DataFrame:
    """(path, at, record, reason, dropped) of all logs in a folder: records, and what was dropped and why."""
    return _read(_files(spark, path, names).select("path", F.lit(0).cast("long").alias("base"), "content"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """As ``read``, of one log in parts: a part a task, places from the log's beginning."""
    files = _files(spark, path, "part-*").select("path", "length")  # a row for each part
    order = Window.orderBy(*(F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)", i).cast("long") for i in (1, 2))).rowsBetween(*ordered.BEFORE)
    bases = files.select("path", F.coalesce(F.sum("length").over(order), F.lit(0)).alias("base"))
    return _read(_files(spark, path, "part-*").join(F.broadcast(bases), "path").select("path", "base", "content")).withColumn("path", F.lit(path))


def _read(files: DataFrame) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, content in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(name, base + at, x[0], None, None) if x[0] is not None else (name, base + at, None, x[1], x[2]) for at, *x in scan(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()))], ["path", "at", "record", "reason", "dropped"])

    return files.mapInArrow(run, "path string, at long, record binary, reason string, dropped long")


def replay(spark: SparkSession, path: str, paranoid: bool = False, names: str = "*.log") -> DataFrame:
    """Log rows (k, seq, op, v) of all batches in a folder's logs (``names`` is "part-*" for those of ``write_logs``).

    Damage is passed over, or with ``paranoid`` raised when the rows are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for record, reason in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if record is None:
                        raise Corruption(reason)
                    seq, ops = decode_batch(record)
                except Corruption:
                    if paranoid:
                        raise
                    continue
                rows += [(k, seq + i, op, v) for i, (op, k, v) in enumerate(ops.ops)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int8(), pa.binary()))], ["k", "seq", "op", "v"])

    return read(spark, path, names).select("record", F.coalesce("reason", F.lit("")).alias("reason")).mapInArrow(run, "k binary, seq long, op byte, v binary")
