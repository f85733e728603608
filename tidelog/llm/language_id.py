"""Language identification with string kernels.

A text is the set of its byte n-grams of 1 to 4 bytes (blended spectrum, presence only),
after lower-casing A-Z and turning other ASCII characters into spaces; n-grams of 2 to 4
bytes share a fixed number of hashed slots each. The kernel of two texts is the number of
n-grams both have, over the geometric mean of how many each has. A few texts of each
language are landmarks; Nyström's map takes a text's kernels to them into a space where
one-versus-rest ridge regression is fitted. Texts are scored in batches: presence rows
times landmarks, then times weights.

Learning uses at most ``PER_LANG`` labelled texts of a language, chosen by a hash of the
id, and of each its first ``LEARN_BYTES`` bytes: a bounded sample. Every text is
scored whole, however long. A null text, or one without letters, is ``und`` with score 0;
so are all texts if nothing is labelled. Repeated rows score alike; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_rest, documents, small_batches

PER_LANG = 300
LANDMARKS = 24
SPARE = 5
LEARN_BYTES = 20_000
RIDGE = 1e-3
SHARPNESS = 8.0
UNKNOWN = "und"
#: Slots of n-grams of 1, 2, 3 and 4 bytes.
SLOTS = (256, 8192, 16384, 16384)
WIDTH = sum(SLOTS)
#: Bytes whose n-grams are taken at a time.
AT_ONCE = 1 << 20
#: Texts in one matrix product.
ROWS = 32

FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_ascii_letter = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ascii_letter.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def mark(text: bytes, row: np.ndarray) -> None:
    """Set the slots of the text's n-grams in a row of zeros."""
    text = text.translate(FOLD)
    for k in range(0, max(1, len(text)), AT_ONCE):
        a = np.frombuffer(text[k : k + AT_ONCE + 3], np.uint8).astype(np.uint32)
        row[a] = 1
        gram, base = a, SLOTS[0]
        for n in (1, 2, 3):
            gram = (gram[:-1] << np.uint32(8)) | a[n:]
            bits = SLOTS[n].bit_length() - 1
            row[((gram * np.uint32(2654435761)) >> np.uint32(32 - bits)) + np.uint32(base)] = 1
            base += SLOTS[n]


def presence(texts: list[bytes]) -> np.ndarray:
    rows = np.zeros((len(texts), WIDTH), np.uint8)
    for t, row in zip(texts, rows):
        mark(t, row)
    return rows


class Model:
    """Kernel ridge regression over Nyström features of presence kernels."""

    def __init__(self, texts: list[bytes], langs: list[str], n_landmarks: int = LANDMARKS, ridge: float = RIDGE):
        self.langs = sorted(set(langs))
        rows, y = presence(texts), np.array([self.langs.index(x) for x in langs])
        chosen = np.sort(np.concatenate([np.flatnonzero(y == c)[:n_landmarks] for c in range(len(self.langs))]))
        self.landmarks = np.packbits(rows[chosen], axis=1)
        self.prepare()
        k = np.concatenate([self.kernel(rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)])
        size, vec = np.linalg.eigh(k[chosen].astype(np.float64))
        keep = size > 1e-6 * size[-1]
        root = vec[:, keep] / np.sqrt(size[keep])
        phi = np.column_stack([k @ root, np.ones(len(k))])
        penalty = np.eye(phi.shape[1]) * ridge * len(k)
        penalty[-1, -1] = 1e-9
        share = np.bincount(y, minlength=len(self.langs))
        weight = (len(y) / len(self.langs) / share)[y][:, None]  # each language counts alike
        target = np.eye(len(self.langs))[y]
        w = np.linalg.solve(phi.T @ (phi * weight) + penalty, phi.T @ (target * weight))
        self.weights, self.offset = (root @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def prepare(self) -> None:
        rows = np.unpackbits(self.landmarks, axis=1)[:, :WIDTH].astype(np.float32)
        self.columns = np.ascontiguousarray((rows / np.sqrt(rows.sum(1, keepdims=True))).T)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "columns"}

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Normalised kernels of presence rows to the landmarks."""
        return rows.astype(np.float32) @ self.columns / np.sqrt(np.maximum(1, rows.sum(1, dtype=np.int64)))[:, None]

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score (0 to 1) and margin of each text.

        The margin is the best regression value's lead over the second best, so it doesn't
        hang on how many languages there are; 1 if there is one only. Of equal values the
        language first by name wins.
        """
        if not hasattr(self, "columns"):
            self.prepare()
        s = self.kernel(presence(texts)) @ self.weights + self.offset
        e = np.exp(SHARPNESS * (s - s.max(1, keepdims=True)))
        lead = np.ones(len(s)) if s.shape[1] == 1 else np.diff(np.partition(s, -2, axis=1)[:, -2:])[:, 0]
        return s.argmax(1), e.max(1) / e.sum(1), lead


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model | None:
    """Learn from labelled rows whose crc32(doc_id) mod 4 is not 2; None without any."""
    rows = docs.where((crc_rest(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    key = F.xxhash64(F.col("doc_id").cast("string"))
    # a language's count tells how low a key must be for about SPARE times the rows wanted: no task sees more
    least = F.lit(None).cast("long")
    for r in rows.groupBy("lang").count().collect():  # a row for each language
        share = min(1.0, SPARE * per_lang / r["count"])
        least = F.when(F.col("lang") == r["lang"], F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))).otherwise(least)
    first = Window.partitionBy("lang").orderBy(key, "doc_id")
    chosen = rows.where(key <= least).select("lang", "doc_id", F.row_number().over(first).alias("n")).where(F.col("n") <= per_lang).select("doc_id", "lang")
    # at most per_lang rows of each language
    got = rows.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"], "left_semi").select("lang", "doc_id", key.alias("key"), F.substring(F.col("text").cast("binary"), 1, LEARN_BYTES).alias("text")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["key"], r["doc_id"] is None, r["doc_id"] or 0, r["text"]))
    return Model([r["text"] for r in got], [r["lang"] for r in got]) if got else None


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` with lang_pred, score and margin."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(0).to_pylist()]
            pred, score, margin = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model and has_letter(t)]
            for k in range(0, len(known), ROWS):
                part = known[k : k + ROWS]
                best, score[part], margin[part] = model.predict([texts[i] for i in part])
                for i, c in zip(part, best):
                    pred[i] = model.langs[c]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(pred, pa.string()), pa.array(score), pa.array(margin)], names)

    names = [*keep, "lang_pred", "score", "margin"]
    rows = docs.select(F.col("text").cast("binary").alias("_text"), *keep)
    kinds = dict(docs.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double", "margin double"]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = predict(docs, fit(docs))
    return found.select("doc_id", (crc_rest(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
