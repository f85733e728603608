"""Byte-pair encoding with a public vocabulary, and decoding.

A text is split at special tokens, then by the vocabulary's pattern into pieces.
A piece starts as its bytes. Over the ranks of its adjacent pairs stands a segment
tree whose root is the leftmost pair of the lowest rank; a merge changes at most
three leaves, each in logarithmic time, until no pair at the root can merge.

Pieces up to ``WIDE`` bytes are merged many at a time: one numpy row holds the tree
of one piece. Longer pieces use the same tree one by one, so a text of one endless
word takes n log n. Encoded pieces are kept in a table of bounded size.

Null and empty texts have no tokens. Repeated rows are encoded alike; an empty table
gives an empty result; extra columns are ignored unless named in ``keep``. Of equal
ranks the leftmost pair is merged.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_size, documents, small_batches

VOCABULARY = "byte_bpe_50k.json"
WIDE = 32
#: Pieces kept per worker; the table starts anew beyond that.
KEPT_PIECES = 400_000
#: Characters whose pieces are merged together.
GROUP_CHARS = 2_000_000
NONE = np.int64(2**62)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_characters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in to_byte.items():
            self.byte_ids[b] = vocab[c]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        keys = np.array(sorted(self.merges), np.int64)
        self.keys = np.append(keys, NONE)
        self.ranks = np.array([*(self.merges[int(k)][0] for k in keys), NONE >> 8], np.int64)
        self.made = np.array([*(self.merges[int(k)][1] for k in keys), 0], np.int64)
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.kept: dict[str, bytes] = {}

    # one long piece
    def merge_one(self, piece: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, far = len(ids), int(NONE)
        if n < 2:
            return ids
        width = 1 << (n - 1).bit_length()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges = self.merges

        def leaf(i: int) -> int:
            j = after[i]
            got = merges.get(ids[i] << 32 | ids[j]) if j >= 0 else None
            return got[0] << 32 | i if got else far

        tree = [far] * (2 * width)
        tree[width : width + n] = [leaf(i) for i in range(n)]
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    break
                tree[k] = least

        while tree[1] != far:
            i = tree[1] & 0xFFFFFFFF
            j = after[i]
            ids[i] = merges[ids[i] << 32 | ids[j]][1]
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            ids[j] = -1
            put(j, far)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [x for x in ids if x >= 0]

    def _find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges; the last index where there is none."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, at, len(self.keys) - 1)

    # many short pieces, each a row
    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        length = np.fromiter(map(len, pieces), np.int64, n)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < length[:, None], self.byte_ids[flat], -1)
        after = np.where(at + 1 < length[:, None], at + 1, -1)
        before = np.where(at < length[:, None], at - 1, -1)
        tree = np.full((n, 2 * width), NONE, np.int64)
        none = len(self.keys) - 1

        def leaves(rows: np.ndarray, i: np.ndarray) -> np.ndarray:
            j = after[rows, i]
            got = np.where(j >= 0, self._find(ids[rows, i], ids[rows, np.maximum(j, 0)]), none)
            return np.where(got < none, self.ranks[got] << 32 | i, NONE)

        rows, cols = np.nonzero(after >= 0)
        tree[rows, width + cols] = leaves(rows, cols)
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half

        def put(rows: np.ndarray, i: np.ndarray, value: np.ndarray) -> None:
            k = width + i
            tree[rows, k] = value
            while k.size and k[0] > 1:
                k = k >> 1
                tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

        live = np.flatnonzero(tree[:, 1] != NONE)
        while live.size:
            i = tree[live, 1] & 0xFFFFFFFF
            j = after[live, i]
            ids[live, i] = self.made[self._find(ids[live, i], ids[live, j])]
            ids[live, j] = -1
            k = after[live, j]
            after[live, i] = k
            has = k >= 0
            before[live[has], k[has]] = i[has]
            put(live, j, np.full(live.size, NONE))
            put(live, i, leaves(live, i))
            p = before[live, i]
            has = p >= 0
            put(live[has], p[has], leaves(live[has], p[has]))
            live = live[tree[live, 1] != NONE]
        stay = ids >= 0
        flat_ids = ids[stay].astype("<u4").tobytes()
        ends = np.cumsum(stay.sum(1) * 4).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, new: list[str]) -> None:
        """Encode pieces and keep them."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for s in new:
            b = s.encode()
            width = 4
            while width < len(b):
                width *= 2
            by_width.setdefault(width, []).append((s, b))
        for width, group in by_width.items():
            if width > WIDE:
                for s, b in group:
                    self.kept[s] = np.array(self.merge_one(b), "<u4").tobytes()
            else:
                for k in range(0, len(group), 8192):
                    part = group[k : k + 8192]
                    self.kept |= zip((s for s, _ in part), self.merge_many([b for _, b in part], width))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers.

        New pieces of all the texts are merged together, so keep the list to a few MB.
        """
        if len(self.kept) > KEPT_PIECES:
            self.kept.clear()
        cut, new = [], set()
        for text in texts:
            parts = self.at_special.split(text) if self.at_special else [text]
            parts[::2] = map(self.split.findall, parts[::2])  # a special token stands at each odd place
            cut.append(parts)
            for pieces in parts[::2]:
                new.update(pieces)
        self.learn(list(new.difference(self.kept)))
        get = self.kept.__getitem__
        return [
            b"".join([self.special[x].to_bytes(4, "little") if k % 2 else b"".join(map(get, x)) for k, x in enumerate(parts)])
            for parts in cut
        ]

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@functools.lru_cache(2)
def loaded(path: str) -> Bpe:
    return Bpe(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode each row's text: token count, digests, and the ids themselves if asked for."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n, ids_sha, text_sha, ids = [], [], [], []
            for group in by_size(texts, GROUP_CHARS):
                for e in bpe.encode(group):
                    n.append(len(e) // 4)
                    ids_sha.append(hashlib.sha256(e).hexdigest())
                    text_sha.append(hashlib.sha256(bpe.decode(e).encode()).hexdigest())
                    if with_ids:
                        ids.append(np.frombuffer(e, "<u4").astype(np.int32))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir))


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
