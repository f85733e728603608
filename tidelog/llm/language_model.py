"""Language-model scores: a log-bilinear neural model over word classes, and exact word counts.

Tokens are lower-cased words and an end mark. The most frequent words are classes of
their own, more of them the larger the corpus (``own_words``); other words fall into
classes by their ending and punctuation. The model predicts the next class from the
classes at the ``POSITIONS`` tokens before it: each position has a matrix that its class's
vector is multiplied with, their sum meets each class's target vector, and a bias is added.

It is trained in numpy with noise-contrastive estimation, in parallel: every task goes over
its training texts once, every token of which is an example, draws noise classes from the
class frequencies, and learns to tell the examples' classes from the noise. The examples of
a step stand apart, spread over a group of texts. The tasks start from the same parameters; the average of what they end with,
weighted by their examples, is the model. Scores of a position's classes and all next
classes are a matrix product, and so are the sums over all next classes that normalise
them, for all pairs of context classes at once. Within a class of many words, a word has
(count + 1) / (all counts + words + 1), so unseen words have a share.

Counts cover all training rows. Words counted often (at most ``FREQUENT`` of them) go to
every task; the others of a text are looked up by a join on a 64-bit hash. What comes to
the driver has a fixed bound: the frequent words, the class table and the parameters.

A null or empty text is one end mark. Words of a text may be any number and any length;
texts are taken in groups of ``GROUP_BYTES``, and of one alone beyond that. Words counted
equally often are ranked by their hash. Repeated rows score alike. Without training rows
every count is zero and all classes are as likely. An empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, crc_rest, documents, durable, small_batches

FREQUENT = 100_000
#: Classes of one word: the square root of the training tokens over OWN_SHARE, within these bounds.
OWN_LEAST, OWN_MOST, OWN_SHARE = 255, 900, 8
ENDINGS = 32
BUCKETS = 3 * ENDINGS
END = b""
POSITIONS = 2
DIMENSIONS = 32
#: Examples learnt from together, and the noise classes drawn for them.
BATCH = 512
NOISE = 64
RATE = 0.15
#: Words, and bytes of words, that a worker keeps; the table starts anew beyond that.
KEPT_WORDS = 300_000
KEPT_BYTES = 32 << 20
#: Bytes of texts looked up together.
GROUP_BYTES = 2_000_000
PUNCTUATION = b".,;:!?|\"')]"
#: Parameters of one row when tasks' results are averaged.
BLOCK = 4096


def own_words(tokens: int) -> int:
    return int(min(OWN_MOST, max(OWN_LEAST, tokens**0.5 / OWN_SHARE)))


def bucket(word: bytes) -> int:
    """Class among the shared ones: by punctuation and the last bytes before it."""
    core = word.rstrip(PUNCTUATION)
    mark = 0 if len(core) == len(word) else 1 if word[-1:] in b".!?" else 2
    return mark * ENDINGS + zlib.crc32(core[-3:]) % ENDINGS


class Endings(dict):
    """The bucket of each word's last 4 bytes, as far as they decide it; else -1."""

    def __missing__(self, last: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        decided = len(last) < 4 or len(last.rstrip(PUNCTUATION)) >= 3
        found = self[last] = bucket(last) if decided else -1
        return found


_endings = Endings()


def buckets(words: list[bytes]) -> np.ndarray:
    """``bucket`` of each word, worked out once for words that end alike."""
    out = np.fromiter((_endings[w[-4:]] for w in words), np.int32, len(words))
    for i in np.flatnonzero(out < 0).tolist():
        out[i] = bucket(words[i])
    return out


def word_hash(word: bytes) -> int:
    return int(word_hashes([word])[0])


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(word_hashes(words)), pa.array(buckets(words)), pa.array(counts.values(), pa.int64())], ["h", "bucket", "n"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
            if len(counts) > KEPT_WORDS:
                yield rows(counts)
                counts.clear()
    if counts:
        yield rows(counts)


def word_counts(train: DataFrame) -> DataFrame:
    """(h, bucket, n): training count of each word, by hash."""
    found = train.select(F.col("text").cast("binary")).mapInArrow(_count_words, "h long, bucket int, n long")
    return durable(found.groupBy("h").agg(F.first("bucket").alias("bucket"), F.sum("n").alias("n")))


class Vocabulary:
    """Frequent words with their counts, classes, and the sums of the shared classes."""

    def __init__(self, counts: DataFrame, frequent: int = FREQUENT):
        size = F.floor(4 * F.log2("n")).cast("int")
        bins = sorted(((r["size"], r["count"]) for r in counts.groupBy(size.alias("size")).count().collect()), reverse=True)
        least, room = 10**6, frequent
        for b, n in bins:
            if n > room:
                break
            least, room = b, room - n
        self.total, self.words = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
        end = word_hash(END)  # has a class of its own, however rare
        top = counts.where((size >= least) | (F.col("h") == end)).toArrow()  # one row more than frequent at most
        h, n, b = (top[c].to_numpy() for c in ("h", "n", "bucket"))
        order = np.argsort(h)
        self.h, self.n, b = h[order], n[order], b[order]
        self.least = least
        self.own = own_words(self.total)  # the end mark's class; those before it are of one word, those after it shared
        self.classes = self.own + 1 + BUCKETS
        self.cls = (self.own + 1 + b).astype(np.int32)
        ranked = np.lexsort((self.h, -self.n))
        ranked = ranked[self.h[ranked] != end][: self.own]
        self.cls[ranked] = np.arange(len(ranked))
        self.cls[self.h == end] = self.own
        sums = np.zeros((BUCKETS, 2))
        for r in counts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
            sums[r["bucket"]] = r["n"], r["words"]
        alone = np.append(ranked, np.flatnonzero(self.h == end))  # words that left the shared classes
        np.subtract.at(sums, b[alone], np.column_stack([self.n[alone], np.ones(len(alone))]))
        self.shared = sums.sum(1) + 1
        each = np.zeros(self.classes)  # tokens of each class
        np.add.at(each, self.cls[alone], self.n[alone])
        each[self.own + 1 :] = sums[:, 0]
        self.frequency = (each + 1) / (each.sum() + self.classes)


class Numbers(dict):
    """Numbers words as they are first asked for, and lists those."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Table:
    """Class, log10(count + 1) and rarity of words, kept by word in a worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.ids = Numbers()
        self.bytes = 0
        self.cls, self.log, self.hash = np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64)
        self.rare = np.zeros(0, bool)

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """Row of the table for each word."""
        if len(self.ids) > KEPT_WORDS or self.bytes > KEPT_BYTES:
            self.clear()
        rows = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        new, self.ids.new = self.ids.new, []
        if new:
            v = self.v
            h = word_hashes(new)
            at = np.minimum(np.searchsorted(v.h, h), max(0, len(v.h) - 1))
            known = v.h[at] == h if len(v.h) else np.zeros(len(new), bool)
            cls = v.own + 1 + buckets(new)
            cls[h == word_hash(END)] = v.own
            self.bytes += sum(map(len, new))
            log = np.zeros(len(new))
            cls[known] = v.cls[at[known]]
            log[known] = np.log10(v.n[at[known]] + 1)
            self.cls, self.log = np.concatenate([self.cls, cls]), np.concatenate([self.log, log])
            self.hash, self.rare = np.concatenate([self.hash, h]), np.concatenate([self.rare, ~known])
        return rows

    def look_up_all(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the table for the tokens of all texts, and where each text starts."""
        words, starts = [], []
        for text in texts:
            starts.append(len(words))
            words += tokens(text)
        return self.look_up(words), np.array(starts)


def before(cls: np.ndarray, starts: np.ndarray, end_class: int) -> list[np.ndarray]:
    """The classes 1, 2, ... tokens before each token of its text; the end mark's before a text."""
    place = np.arange(len(cls)) - np.repeat(starts, np.diff([*starts, len(cls)]))
    return [np.where(place >= k, np.roll(cls, k), end_class) for k in range(1, POSITIONS + 1)]


class Parameters:
    """Vectors of context classes, a matrix for each position, target vectors and biases."""

    def __init__(self, frequency: np.ndarray, dimensions: int = DIMENSIONS):
        n, d = len(frequency), dimensions
        rng = np.random.default_rng(11)
        context = rng.normal(0, 0.3, (n, d))
        position = np.stack([np.eye(d) / (k + 1) for k in range(POSITIONS)])
        self.shapes = [(n, d), (POSITIONS, d, d), (n, d), (n,)]
        self.flat = np.concatenate([x.ravel() for x in (context, position, np.zeros((n, d)), np.log(frequency))]).astype(np.float32)
        self.views()

    def views(self) -> None:
        ends = np.cumsum([int(np.prod(s)) for s in self.shapes])
        self.context, self.position, self.target, self.bias = (x.reshape(s) for x, s in zip(np.split(self.flat, ends[:-1]), self.shapes))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores [position, context class, next class] with the bias in the first, and log sums [class 1 before, class 2 before]."""
        scores = np.stack([self.context @ m.T @ self.target.T for m in self.position]).astype(np.float64)
        scores[0] += self.bias
        most = scores.max(2, keepdims=True)
        first, second = np.exp(scores - most)
        return scores, np.log(first @ second.T) + most[0] + most[1].T


class Trainer:
    """Noise-contrastive estimation in small batches, with step sizes that shrink by each parameter's gradients."""

    def __init__(self, frequency: np.ndarray, seed: int = 5):
        self.p, self.rng = Parameters(frequency), np.random.default_rng(seed)
        self.frequency = frequency
        self.log_noise = (np.log(frequency) + np.log(NOISE)).astype(np.float32)
        self.up_to = np.cumsum(frequency)
        self.sums = [np.full(x.shape, 1e-3, np.float32) for x in (self.p.context, self.p.position, self.p.target, self.p.bias)]
        self.examples = 0

    def _move(self, no: int, x: np.ndarray, rows: np.ndarray | None, g: np.ndarray) -> None:
        step = g * g
        if rows is None:
            self.sums[no] += step
            x -= RATE * g / np.sqrt(self.sums[no])
            return
        step += self.sums[no].take(rows, 0)
        self.sums[no][rows] = step
        np.sqrt(step, out=step)
        np.divide(RATE * g, step, out=step)
        x[rows] = x.take(rows, 0) - step

    @staticmethod
    def _by_row(ids: np.ndarray, *gradients: np.ndarray) -> tuple[np.ndarray, ...]:
        """The different ids, and the gradients of equal ones added up."""
        order = np.argsort(ids.astype(np.int16), kind="stable")  # sorted by radix: there are fewer classes than that
        ids = ids.take(order)
        first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        return ids.take(first), *(np.add.reduceat(g.take(order, 0), first) for g in gradients)

    @staticmethod
    def _odds(s: np.ndarray) -> np.ndarray:
        """That it is data, not noise; in place."""
        np.clip(s, -30, 30, out=s)
        np.negative(s, out=s)
        np.exp(s, out=s)
        s += 1
        return np.divide(1, s, out=s)

    def learn(self, contexts: list[np.ndarray], words: np.ndarray) -> None:
        """One step; contexts holds the class at each position."""
        p = self.p
        noise = np.minimum(np.searchsorted(self.up_to, self.rng.random(NOISE)), len(self.up_to) - 1)
        vectors = [p.context.take(c, 0) for c in contexts]
        h = sum(v @ m.T for v, m in zip(vectors, p.position))
        target, noise_target = p.target.take(words, 0), p.target.take(noise, 0)
        g_word = self._odds(np.einsum("ij,ij->i", h, target) + p.bias.take(words) - self.log_noise.take(words)) - 1
        g_noise = h @ noise_target.T
        g_noise += p.bias.take(noise)
        g_noise -= self.log_noise.take(noise)
        self._odds(g_noise)
        g_h = g_word[:, None] * target
        g_h += g_noise @ noise_target
        ids, *targets = self._by_row(np.concatenate([words, noise]), np.concatenate([g_word[:, None] * h, g_noise.T @ h]), np.concatenate([g_word, g_noise.sum(0)]))
        positions = np.stack([g_h.T @ v for v in vectors])
        context = self._by_row(np.concatenate(contexts), np.concatenate([g_h @ m for m in p.position]))
        self._move(0, p.context, *context)
        self._move(1, p.position, None, positions)
        self._move(2, p.target, ids, targets[0])
        self._move(3, p.bias, ids, targets[1])
        self.examples += len(words)


def _train(vocabulary: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, trainer, left = Table(vocabulary), Trainer(vocabulary.frequency), None
        for batch in batches:
            for group in by_size([t or b"" for t in batch.column(0).to_pylist()], GROUP_BYTES):
                at, starts = table.look_up_all(group)
                cls = table.cls[at]
                new = [*before(cls, starts, vocabulary.own), cls]
                left = new if left is None else [np.concatenate(x) for x in zip(left, new)]
                steps = len(left[-1]) // BATCH
                apart = [np.ascontiguousarray(x[: steps * BATCH].reshape(BATCH, steps).T, np.intp) for x in left]  # a step's examples in a row
                for *contexts, words in zip(*apart):
                    trainer.learn(contexts, words)
                left = [x[steps * BATCH :] for x in left]
        if left is not None and len(left[-1]):
            trainer.learn(left[:-1], left[-1])
        if trainer.examples:
            blocks = [trainer.p.flat[i : i + BLOCK] for i in range(0, len(trainer.p.flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([float(trainer.examples)] * len(blocks)), pa.array([b.tolist() for b in blocks], pa.list_(pa.float32()))], ["block", "examples", "values"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums of the blocks that a task holds."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, n, values in zip(*(c.to_pylist() for c in batch.columns)):
            x = sums.setdefault(block, [0.0, 0.0])
            x[0] += n
            x[1] = x[1] + n * np.array(values)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([n for n, _ in sums.values()]), pa.array([(v / n).astype(np.float32).tolist() for n, v in sums.values()], pa.list_(pa.float32()))], ["block", "examples", "values"])


def train_model(train: DataFrame, vocabulary: Vocabulary) -> Parameters:
    kind = "block int, examples double, values array<float>"
    parts = train.select(F.col("text").cast("binary")).mapInArrow(_train(vocabulary), kind)
    found = parts.repartition("block").mapInArrow(_average, kind).toArrow().sort_by("block")  # a row for each block
    p = Parameters(vocabulary.frequency)
    if found.num_rows:
        p.flat = np.concatenate([np.array(v, np.float32) for v in found["values"].to_pylist()])
        p.views()
    return p


def _score(vocabulary: Vocabulary, parameters: Parameters):
    """Scores by table: the parameters go to the tasks, each makes the tables for itself."""
    whole = np.log10(vocabulary.total + vocabulary.words + 1)
    end_class, shared = vocabulary.own, np.zeros(vocabulary.classes)
    shared[end_class + 1 :] = -np.log10(vocabulary.shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (scores, sums) = Table(vocabulary), parameters.tables()
        for batch in batches:
            n, known, base, score, sizes, hashes, times = [], [], [], [], [], [], []
            for group in by_size([t or b"" for t in batch.column(3).to_pylist()], GROUP_BYTES):
                at, starts = table.look_up_all(group)
                cls, log, rare = table.cls[at], table.log[at], table.rare[at]
                first_before, second_before = before(cls, starts, end_class)
                count = np.diff([*starts, len(at)])
                n.append(count)
                known.append(count - np.add.reduceat(rare.astype(np.int64), starts))
                base.append(np.add.reduceat(log, starts) - count * whole)
                log_p = scores[0, first_before, cls] + scores[1, second_before, cls] - sums[first_before, second_before]
                each = log_p / np.log(10) + shared[cls] + np.where(cls > end_class, log, 0.0)
                score.append(np.add.reduceat(each, starts))
                own = np.repeat(np.arange(len(starts)), count)[rare]
                h = table.hash[at[rare]]
                order = np.lexsort((h, own))
                own, h = own[order], h[order]
                first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, int)
                hashes.append(h[first])
                times.append(np.diff([*first, len(h)]).astype(np.int32) if len(h) else np.zeros(0, np.int32))
                sizes.append(np.bincount(own[first], minlength=len(starts)))
            if n:
                join = lambda x: pa.array(np.concatenate(x))
                pieces = pa.StructArray.from_arrays([join(hashes), join(times)], ["h", "times"])
                ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
                cols = [*batch.columns[:3], join(n), join(known), join(base), join(score), pa.ListArray.from_arrays(ends, pieces)]
                yield pa.RecordBatch.from_arrays(cols, ["r1", "r2", "doc_id", "n_tokens", "n_known", "base_score", "score", "rare"])

    return run


def fit(train: DataFrame, frequent: int = FREQUENT) -> tuple[DataFrame, Vocabulary, Parameters]:
    """Word counts, vocabulary and model of the training rows."""
    small_batches(train.sparkSession)
    counts = word_counts(train)
    vocabulary = Vocabulary(counts, frequent)
    return counts, vocabulary, train_model(train, vocabulary)


def score(docs: DataFrame, is_training, frequent: int = FREQUENT) -> DataFrame:
    """Scores of all rows, learning from those for which the column ``is_training`` holds."""
    return score_with(docs, *fit(docs.where(is_training), frequent))


def score_with(docs: DataFrame, counts: DataFrame, vocabulary: Vocabulary, parameters: Parameters) -> DataFrame:
    """Scores of all rows with what ``fit`` gives."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("r1"), F.hash("text").alias("r2"), F.col("doc_id").cast("long"), text.alias("text"))
    schema = "r1 long, r2 int, doc_id long, n_tokens long, n_known long, base_score double, score double, rare array<struct<h:long,times:int>>"
    rows = durable(rows.mapInArrow(_score(vocabulary, parameters), schema))
    rare = rows.select("r1", "r2", F.explode("rare").alias("w")).select("r1", "r2", "w.h", "w.times")
    other = counts.where((F.floor(4 * F.log2("n")) < vocabulary.least) & (F.col("h") != word_hash(END))).select("h", "n")
    found = rare.join(other, "h")  # an unseen word adds log10(0 + 1)
    found = found.groupBy("r1", "r2").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more"), F.sum("times").alias("more_known"))
    copies = Window.partitionBy("r1", "r2")
    rows = rows.drop("rare").withColumn("copies", F.count("*").over(copies)).join(found, ["r1", "r2"], "left")
    more = F.coalesce(F.col("more") / F.col("copies"), F.lit(0.0))
    return rows.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce(F.col("more_known") / F.col("copies"), F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = crc_rest(F.col("doc_id"), 7) == 2
    found = score(docs, ~held)
    return found.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_lm_scores": op9_lm_scores}
ORACLES: dict[str, str] = {}
