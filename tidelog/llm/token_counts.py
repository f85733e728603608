"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie. Greedy longest match takes, again and again, the
longest piece that the rest of a word starts with. The trie gets a failure link for
each node: where the match goes on after the pieces that the node's path is cut into
are taken off, together with how many those are. A word is then counted in one pass
over its bytes; no piece is ever built.

In byte-level vocabularies a space mark opens a word, so a word is matched as the mark
and its bytes, and all 256 bytes are pieces: every word can be cut.

Null and empty texts have no words and no tokens. A text of any length is taken whole,
one pass over its bytes. Repeated rows count alike; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_characters, vocabulary_path
from .common import documents, small_batches

#: Words kept per worker; the table starts anew beyond that.
KEPT_WORDS = 600_000
MARK = b" "


class LongestMatch:
    """Trie with failure links over byte pieces; all single bytes must be pieces."""

    def __init__(self, pieces: list[bytes]):
        self.edges: list[dict[int, int]] = [{}]
        final = [False]
        parent, byte = [0], [0]
        for piece in pieces:
            v = 0
            for b in piece:
                if (w := self.edges[v].get(b)) is None:
                    w = self.edges[v][b] = len(self.edges)
                    self.edges.append({})
                    final.append(False)
                    parent.append(v)
                    byte.append(b)
                v = w
            final[v] = True
        # by depth: a node's link follows from its parent's
        self.link, self.popped = [0] * len(final), [0] * len(final)
        level = list(self.edges[0].values())
        assert len(level) == 256 and all(final[v] for v in level), "every byte must be a piece"
        for v in level:
            self.popped[v] = 1
        while level:
            below = [w for v in level for w in self.edges[v].values()]
            for w in below:
                if final[w]:  # the whole path is one piece
                    self.link[w], self.popped[w] = 0, 1
                else:
                    v, n = self.link[parent[w]], self.popped[parent[w]]
                    while (x := self.edges[v].get(byte[w])) is None:
                        n += self.popped[v]
                        v = self.link[v]
                    self.link[w], self.popped[w] = x, n
            level = below

    def count(self, word: bytes) -> int:
        """Number of greedy pieces of a word."""
        edges, link, popped = self.edges, self.link, self.popped
        v = n = 0
        for b in word:
            while (w := edges[v].get(b)) is None:
                n += popped[v]
                v = link[v]
            v = w
        while v:
            n += popped[v]
            v = link[v]
        return n


class _Counts(dict):
    """Counts by word, made when first asked for."""

    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(MARK + word)
        return n


def byte_pieces(path: str) -> list[bytes]:
    to_byte = byte_characters()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return [bytes(to_byte[c] for c in token) for token in vocab if all(c in to_byte for c in token)]


@functools.lru_cache(2)
def loaded(path: str) -> _Counts:
    return _Counts(LongestMatch(byte_pieces(path)))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row's whole text."""
    path = path or vocabulary_path()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(path)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1).to_pylist():
                if len(counts) > KEPT_WORDS:
                    counts.clear()
                w = (text or b"").split()
                words.append(len(w))
                tokens.append(sum(map(counts.__getitem__, w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
