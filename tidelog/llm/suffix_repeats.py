"""Repeated byte strings across documents: suffix arrays and common-prefix intervals.

``Repeats`` builds an enhanced suffix array of a list of byte strings and scans it with a
stack. Each common-prefix interval whose occurrences differ in the byte to their left is a
maximal repeat; it is returned with all its occurrences.

For a corpus, every string of ``LENGTH`` bytes is assigned to the anchor in it: the
``GRAM`` bytes with the least hash. Equal strings have equal anchors, so only strings of
equal anchors need be compared. Strings of one anchor at consecutive starts are kept as a
context: the bytes from the first start to the last start's end. Each string is in one
context only.

1. Anchors are found in each text: hash, context hash, place. No text moves.
2. Anchors met once are dropped, but for contexts in which the least hash stands at two
   places: only those may repeat a string of their own. Equal contexts collapse to one with a count, so groups of
   exact copies of any size are settled here: all their strings are repeated.
3. One context of each kind whose anchor also has other contexts, or that may repeat
   itself, is cut from its text and
   dealt by anchor. Lists of whole groups go through the suffix array.
4. A group of over ``MOST`` different contexts would be too much for one task: its
   strings are dealt one by one by a 128-bit hash and counted instead. This is exact too.

Memory of a task is bounded by ``LIST_BYTES`` and by one group. Null and short texts have
no repeats; very long ones are taken ``PART`` starts at a time. Repeated rows are copies of
each other. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, durable, small_batches

LENGTH = 400
GRAM = 96
#: Different contexts of one anchor beyond which its strings are counted by hash.
MOST = 1000
#: Bytes of contexts in one suffix array, but for a larger single group.
LIST_BYTES = 1_000_000
#: Starts of a text looked at together.
PART = 1 << 17

BASE = np.uint64(0x9E3779B97F4A7C15)
NO_LEFT = -1


class Repeats:
    """Enhanced suffix array over byte strings; matches never cross strings."""

    def __init__(self, strings: list[bytes], least: int = LENGTH):
        self.least = least
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.concatenate([[0], np.cumsum(size)])[:-1]
        self.owner = np.repeat(np.arange(len(strings)), size)
        self.text = np.frombuffer(b"".join(strings), np.uint8)
        n = len(self.text)
        self.rest = (np.repeat(self.starts + size, size) - np.arange(n)).astype(np.int32)
        self._rank()
        order = self.order[self.rest[self.order] >= least]  # shorter suffixes start no repeat
        self.order = order
        self.prefix = self._common(order[:-1], order[1:]) if len(order) > 1 else np.zeros(0, np.int64)

    def _rank(self) -> None:
        """Ranks of the first 8, 16, ... bytes at each place (ends sort first), and the order of all suffixes."""
        n = len(self.text)
        key = np.zeros(n, np.uint64)
        for k in range(7):  # a byte is 1 to 256, an end 0: 9 bits each
            sym = np.zeros(n, np.uint64)
            ok = self.rest > k
            sym[ok] = self.text[np.flatnonzero(ok) + k].astype(np.uint64) + np.uint64(1)
            key = (key << np.uint64(9)) | sym
        self.levels: list[tuple[int, np.ndarray]] = []
        length = 7
        order = np.argsort(key, kind="stable")
        rank = self._dense(key[order], order)
        longest = int(self.rest.max()) if n else 0
        while True:
            self.levels.append((length, rank))
            if length >= longest:
                break
            after = np.zeros(n, np.int64)
            ok = self.rest > length
            after[ok] = rank[np.flatnonzero(ok) + length] + 1
            both = rank.astype(np.int64) << 32 | after
            tied = np.zeros(n, bool)  # only places whose rank is shared need sorting again
            same = rank[order[1:]] == rank[order[:-1]]
            tied[1:] |= same
            tied[:-1] |= same
            if not tied.any():
                break
            where = np.flatnonzero(tied)
            part = order[where]
            order[where] = part[np.argsort(both[part], kind="stable")]
            rank = self._dense(both[order], order)
            length *= 2
        self.order = order

    @staticmethod
    def _dense(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(order) else []
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, by ranks of halving lengths, then byte by byte."""
        most = np.minimum(self.rest[a], self.rest[b]).astype(np.int64)
        n, got = len(self.text), np.zeros(len(a), np.int64)
        steps = [(length, rank) for length, rank in reversed(self.levels)]
        for length, rank in [*steps, *[(1, self.text)] * 6]:
            i, j = a + got, b + got
            ok = got + length <= most
            ok &= rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)]
            got += np.where(ok, length, 0)
        return got

    def intervals(self) -> list[tuple[int, int, int]]:
        """(length, first, last): maximal repeats as ranges of the suffix array, by a stack scan."""
        out, least = [], self.least
        before = np.where(self.order > self.starts[self.owner[self.order]] if len(self.order) else False, self.text[np.maximum(self.order - 1, 0)].astype(np.int64), NO_LEFT).tolist()
        long = np.flatnonzero(self.prefix >= least)
        if not long.size:
            return out
        breaks = np.flatnonzero(np.diff(long) > 1)
        for a, b in zip(long[[0, *(breaks + 1)]].tolist(), long[[*breaks, -1]].tolist()):
            lengths = [*self.prefix[a : b + 1].tolist(), 0]
            stack: list[list[int]] = []  # length, first, byte to the left or NO_LEFT if they differ
            for i, l in enumerate(lengths, a + 1):
                first, left = i - 1, before[i - 1]
                while stack and stack[-1][0] > l:
                    length, first, seen = stack.pop()
                    if seen != left:
                        left = NO_LEFT
                    if left == NO_LEFT:
                        out.append((length, first, i - 1))
                if l >= least:
                    if stack and stack[-1][0] == l:
                        if stack[-1][2] != left:
                            stack[-1][2] = NO_LEFT
                    else:
                        stack.append([l, first, left])
        return out

    def groups(self) -> list[tuple[int, list[tuple[int, int]]]]:
        """Maximal repeats: (length, all occurrences as (string, place))."""
        found = []
        for length, a, b in self.intervals():
            at = self.order[a : b + 1]
            found.append((length, sorted(zip(self.owner[at].tolist(), (at - self.starts[self.owner[at]]).tolist()))))
        return found

    def covered(self) -> tuple[np.ndarray, np.ndarray]:
        """For each string, first start and last end of its occurrences of maximal repeats (start = end: none)."""
        reach = np.zeros(len(self.order), np.int64)
        for length, a, b in self.intervals():
            np.maximum(reach[a : b + 1], length, out=reach[a : b + 1])
        hit = np.flatnonzero(reach)
        at = self.order[hit]
        own = self.owner[at]
        low, high = np.full(len(self.starts), np.iinfo(np.int64).max), np.zeros(len(self.starts), np.int64)
        np.minimum.at(low, own, at - self.starts[own])
        np.maximum.at(high, own, at - self.starts[own] + reach[hit])
        return np.where(high > 0, low, 0), high


def _powers() -> tuple[np.ndarray, np.ndarray]:
    n = PART + LENGTH
    inverse = np.uint64(pow(int(BASE), -1, 2**64))
    one = np.ones(n + 1, np.uint64)
    up, down = one.copy(), one.copy()
    with np.errstate(over="ignore"):
        up[1:] = np.multiply.accumulate(np.full(n, BASE))
        down[1:] = np.multiply.accumulate(np.full(n, inverse))
    return up, down


_UP, _DOWN = _powers()


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first start, number of starts, whether the hash stands at two places or more) of each context of a text.

    Starts in a row whose strings have the same least hash go together, but for ``length``
    at most: a text that repeats itself has no more contexts than another.
    """
    hashes, firsts, counts, again = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    whole = np.frombuffer(text, np.uint8)
    for k in range(0, len(text) - length + 1, PART):
        t = whole[k : k + PART + length - 1]
        n = len(t)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((t.astype(np.uint64) + np.uint64(1)) * _DOWN[:n], out=total[1:])
        h = (total[gram:] - total[:-gram]) * _UP[: n - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        least = sliding_least(h, length - gram + 1)
        new = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        size = np.diff([*new, len(least)])
        pieces = -(-size // length)
        own = np.repeat(np.arange(len(new)), pieces)
        nth = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = new[own] + nth * length
        starts = np.minimum(length, new[own] + size[own] - first)
        hashes.append(least[first])
        firsts.append(first + k)
        counts.append(starts)
        again.append(_met_again(h, least[first], first, first + starts + length - gram))
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(counts), np.concatenate(again)


def _met_again(h: np.ndarray, least: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether h[a:b] has the value ``least`` at two places or more, for each of many ranges."""
    out = np.zeros(len(a), bool)
    ranked = np.sort(h)
    if not (ranked[1:] == ranked[:-1]).any():
        return out
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    after = np.full(len(h), len(h))  # the next place of the same value
    after[order[:-1][same]] = order[1:][same]
    pairs = np.flatnonzero(after < len(h))
    lo, hi = np.searchsorted(pairs, a), np.searchsorted(pairs, b)
    for i in np.flatnonzero(hi > lo):
        p = pairs[lo[i] : hi[i]]
        out[i] = bool(((h[p] == least[i]) & (after[p] < b[i])).any())
    return out


def _find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own, hs, cs, firsts, counts, agains = [], [], [], [], [], []
        for i, text in enumerate(batch.column(2).to_pylist()):
            if text is None or len(text) < LENGTH:
                continue
            h, first, n, again = anchors(text)
            digest = xxhash.xxh3_64_intdigest
            cs += [digest(text[a:b]) for a, b in zip(first.tolist(), (first + n + LENGTH - 1).tolist())]
            own.append(np.full(len(h), i))
            hs.append(h)
            firsts.append(first)
            counts.append(n)
            agains.append(again)
        if own:
            at = pa.array(np.concatenate(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.array(cs, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(firsts).astype(np.int32)), pa.array(np.concatenate(counts).astype(np.int32)), pa.array(np.concatenate(agains))],
                ["h", "c", "r1", "r2", "first", "starts", "again"],
            )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts wanted of each text: bytes, or for large groups the hashes of their strings."""
    for batch in batches:
        out = []
        for r1, r2, text, wanted in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4))):
            for w in wanted:
                first, starts = w["first"], w["starts"]
                row = {"h": w["h"], "n": w["n"], "r1": r1, "r2": r2, "first": first, "context": None, "strings": None}
                if w["large"]:
                    d = [xxhash.xxh3_128_digest(text[i : i + LENGTH]) for i in range(first, first + starts)]
                    row["strings"] = [{"x": x, "y": y} for x, y in np.frombuffer(b"".join(d), np.int64).reshape(-1, 2).tolist()]
                else:
                    row["context"] = text[first : first + starts - 1 + LENGTH]
                out.append(row)
        if out:
            yield pa.RecordBatch.from_pylist(out, CUT)


CUT = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("r1", pa.int64()), ("r2", pa.int32()), ("first", pa.int32()), ("context", pa.binary()), ("strings", pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))])
SPANS = pa.schema([("r1", pa.int64()), ("r2", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of repeats in contexts that come sorted by anchor."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        low, high = Repeats([r[4] for r in rows]).covered()
        hit = np.flatnonzero(high)
        first = np.fromiter((rows[i][3] for i in hit), np.int64, len(hit))
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in hit], pa.int64()), pa.array([rows[i][2] for i in hit], pa.int32()), pa.array((first + low[hit]).astype(np.int32)), pa.array((first + high[hit]).astype(np.int32))],
            schema=SPANS,
        )

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= LIST_BYTES and row[0] != rows[-1][0]:
                yield done(rows)
                rows, size = [], 0
            rows.append(row)
            size += len(row[4])
    if rows:
        yield done(rows)


def _row_keys(docs: DataFrame) -> DataFrame:
    """A key for each row from its id and text; equal rows share it and fare alike."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("r1"), F.hash("text").alias("r2"), F.col("doc_id"), text.alias("text"))


def repeat_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (r1, r2, doc_id, text), dealt by key, and spans (r1, r2, a, b) of their repeated bytes."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = _row_keys(docs)
    every = durable(rows.select("r1", "r2", "text").mapInArrow(_find_anchors, "h long, c long, r1 long, r2 int, first int, starts int, again boolean"))
    met = every.groupBy("h").agg(F.count("*").alias("count"), F.max("again").alias("again")).where("count > 1 OR again").select("h")
    found = durable(every.join(met, "h", "left_semi"))
    drop(every)
    kinds = found.groupBy("h", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("r1", "r2", "first", "starts", "again")])
    by_anchor = kinds.groupBy("h").agg(F.count("*").alias("contexts"), F.min("n").alias("rarest"), F.max("again").alias("repeats"))
    kinds = durable(kinds.join(by_anchor, "h"))
    end = (F.col("first") + F.col("starts") + LENGTH - 1).alias("b")
    copied = found.join(kinds.where("n > 1").select("h", "c"), ["h", "c"], "left_semi").select("r1", "r2", F.col("first").alias("a"), end)

    dealt = rows.repartition("r1", "r2")  # one exchange of the texts, read by both cuts and by the result
    kind_of = "h long, n long, r1 long, r2 int, first int, context binary, strings array<struct<x:long,y:long>>"

    def cut(large: bool) -> DataFrame:
        wanted = kinds.where("rarest = 1").where(f"contexts > {MOST}" if large else f"(contexts > 1 OR repeats) AND contexts <= {MOST}")
        wanted = wanted.groupBy("r1", "r2").agg(F.collect_list(F.struct("h", "n", "first", "starts", F.lit(large).alias("large"))).alias("wanted"))
        return dealt.join(wanted, ["r1", "r2"]).select("r1", "r2", "doc_id", "text", "wanted").mapInArrow(_cut, kind_of)

    small = cut(large=False).select("h", "r1", "r2", "first", "context").repartition("h").sortWithinPartitions("h")
    spans = copied.union(small.mapInArrow(_scan, "r1 long, r2 int, a int, b int"))
    if kinds.where(f"rarest = 1 AND contexts > {MOST}").limit(1).count():
        each = cut(large=True).select("n", "r1", "r2", "first", F.posexplode("strings").alias("at", "s")).select("n", "r1", "r2", (F.col("first") + F.col("at")).alias("a"), "s.x", "s.y")
        twice = each.groupBy("x", "y").agg(F.sum("n").alias("all")).where("all > 1").select("x", "y")
        counted = each.join(twice, ["x", "y"], "left_semi").select("r1", "r2", "a", (F.col("a") + LENGTH).alias("b"))
        spans = spans.union(counted)
    return dealt, spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _keep(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, runs, shas, texts = [], [], [], [], []
            for text, spans in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                cut = merged([(s["a"], s["b"]) for s in spans or []])
                kept = b"".join([text[i:j] for i, j in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(text)])])
                n.append(len(text))
                removed.append(len(text) - len(kept))
                runs.append(len(cut))
                shas.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            cols = [batch.column(2), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.binary())] if with_text else cols, NAMES + ["kept"] * with_text)

    return run


NAMES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """Each row without the bytes covered by repeated strings; ``kept`` has the bytes left."""
    dealt, spans = repeat_spans(docs)
    spans = spans.groupBy("r1", "r2").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    both = dealt.join(spans, ["r1", "r2"], "left").select("r1", "r2", F.col("doc_id").cast("long"), "text", "spans")
    return both.mapInArrow(_keep(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


QUERIES = {"op8_suffix_repeats": op8_suffix_repeats}
ORACLES: dict[str, str] = {}
