"""SimHash near-duplicates with pivot distance tables.

Fingerprints are 64 bits over hashed word shingles. Equal fingerprints collapse to one
row first, so groups of exact copies cost nothing further on. Fingerprints at 3 or
fewer differing bits agree on at least 3 of 6 blocks of bits; rows are dealt by each
choice of 3 blocks (32 bits or so), which brings every link together somewhere without
a cross join. In a bucket, a table holds each fingerprint's Hamming distances to
reference fingerprints, the pivots. By the triangle inequality two linked rows differ
by at most 3 in every coordinate: pairs beyond that are discarded, survivors verified
exactly. A bucket returns a spanning forest of its links, never all its pairs; a dense
bucket is covered from a few of its members first, and only rows of different parts
are compared after that.

A text without words has fingerprint zero and is linked like any other. A null text
counts as empty. Repeated rows get the same fingerprint and component. Extra columns
are ignored; an empty table gives an empty result. Very long texts are hashed
``AT_ONCE`` shingles at a time.

``similar_groups`` finds near duplicates by the similarity of whole shingle sets: what the
links of fingerprints bring together is verified by it, and what lies beyond their reach
meets by least hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, durable, small_batches
from .components import components

BITS_APART = 3
BLOCKS = 6
PIVOTS = 16
SEED = 42
#: Shingles hashed at a time, so that a very long text needs little memory.
AT_ONCE = 100_000
#: Word shingles of whole texts are alike from this Jaccard similarity on.
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 5
#: Bits in which fingerprints of sets of that similarity differ at most; noisy for sets of fewer shingles.
FAR, FEW_SHINGLES = 24, 24
#: Bytes of shingle sets that one task compares at a time.
BLOCK_BYTES = 64 << 20
_mix = np.random.default_rng(3)
FACTORS, MASKS = _mix.integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1), _mix.integers(0, 2**64, BANDS * BAND_ROWS, np.uint64)
#: Buckets up to this size are compared by neighbours at each distance in sort order.
SMALL = 24


def hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Hashes of the lower-cased words' shingles, some at a time; the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return
    digest, line = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= width:
        yield np.frombuffer(digest(line, SEED), ">u8")
        return
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    n = len(words) - width + 1
    for k in range(0, n, AT_ONCE):
        m = min(AT_ONCE, n - k)
        a, b = start[k : k + m].tolist(), end[k + width - 1 : k + width - 1 + m].tolist()
        yield np.frombuffer(b"".join([digest(line[i:j], SEED) for i, j in zip(a, b)]), ">u8")


def majority(parts: Iterator[np.ndarray]) -> int:
    """SimHash of hashes: a bit is set if it is in over half of them."""
    n, ones = 0, np.zeros(64, np.int64)
    for h in parts:
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(h) // 255 * 255  # sums of 255 bits fit a byte
        ones += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        ones += bits[whole:].sum(0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text's shingles, repeats counted; 0 without words."""
    return majority(hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed long, text_hash to find the row again."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or b"", width) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def block_masks(blocks: int = BLOCKS, apart: int = BITS_APART) -> list[int]:
    """Masks of all choices of blocks - apart blocks: two linked fingerprints agree under one at least."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(parts, blocks - apart)]


def pivots(n: int = PIVOTS, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, np.uint64)


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def near(table: np.ndarray, fps: np.ndarray, i, j, apart: int) -> np.ndarray:
    """Whether rows i and j are linked: by their largest coordinate difference, then exactly."""
    ok = np.abs(table[i] - table[j]).max(-1) <= apart
    where = np.flatnonzero(ok)
    pick = lambda k: k[where] if np.ndim(k) else k
    ok[where] = np.bitwise_count(fps[pick(i)] ^ fps[pick(j)]) <= apart
    return ok


def small_links(bucket: np.ndarray, fps: np.ndarray, refs: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small buckets, whose rows stand together."""
    table, us, vs, lag = pivot_table(fps, refs), [], [], 1
    while True:
        i = np.flatnonzero(bucket[:-lag] == bucket[lag:]) if lag < len(bucket) else np.array([], int)
        if not i.size:
            break
        i = i[near(table, fps, i, i + lag, apart)]
        us.append(fps[i])
        vs.append(fps[i + lag])
        lag += 1
    none = np.array([], np.uint64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def forest_of(n: int, order: Iterable[int], around) -> tuple[np.ndarray, np.ndarray]:
    """Places (u, v) of a spanning forest of the links within one bucket of n rows.

    ``around(i)`` gives the rows linked to row i. A few rows cover the bucket, in the given
    order; then only rows outside the largest part are asked for links to other parts.
    """
    part, asked = np.full(n, -1), np.zeros(n, bool)
    us, vs = [np.zeros(0, int)], [np.zeros(0, int)]

    def join(i: int) -> None:
        """All rows around i belong to its part; one link for each row or part that is new to it."""
        asked[i] = True
        found = around(i)
        own = found[(part[found] != part[i])]
        _, one = np.unique(np.where(part[own] < 0, -2 - own, part[own]), return_index=True)
        us.append(np.full(len(one), i))
        vs.append(own[one])
        parts = np.unique(part[own])
        for p in parts[parts >= 0]:
            part[part == p] = part[i]
        part[own] = part[i]

    for i in order:
        if part[i] < 0:
            part[i] = i
            join(i)
    ids, sizes = np.unique(part, return_counts=True)
    for i in np.flatnonzero((part != ids[sizes.argmax()]) & ~asked):
        join(i)
    return np.concatenate(us), np.concatenate(vs)


def large_links(fps: np.ndarray, refs: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one large bucket."""
    table = pivot_table(fps, refs)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    first = table[:, 0].astype(np.int64)

    def around(i: int) -> np.ndarray:
        a, b = np.searchsorted(first, [first[i] - apart, first[i] + apart + 1])
        return a + np.flatnonzero(near(table, fps, np.arange(a, b), i, apart))

    u, v = forest_of(len(fps), range(len(fps)), around)
    return fps[u], fps[v]


def _links(apart: int, n_pivots: int):
    refs = pivots(n_pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(which, key, fps):
            new = np.flatnonzero((which[1:] != which[:-1]) | (key[1:] != key[:-1])) + 1
            size = np.diff([0, *new, len(fps)])
            bucket, size_of = np.repeat(np.arange(len(size)), size), np.repeat(size, size)
            few = (size_of > 1) & (size_of <= SMALL)
            found = [small_links(bucket[few], fps[few], refs, apart)]
            starts = np.concatenate([[0], new])
            found += [large_links(fps[a : a + n], refs, apart) for a, n in zip(starts[size > SMALL], size[size > SMALL])]
            u, v = (np.concatenate(x).view(np.int64) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        held = None
        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            if not len(cols[0]):
                continue
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            open_from = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            cut = int(open_from[-1]) + 1 if open_from.size else 0  # the last bucket may go on
            if cut > 50_000:
                yield out(*(x[:cut] for x in held))
                held = [x[cut:] for x in held]
        if held is not None:
            yield out(*held)

    return run


def links(nodes: DataFrame, blocks: int = BLOCKS, apart: int = BITS_APART, n_pivots: int = PIVOTS) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) that connect all that are near."""
    masks = block_masks(blocks, apart)
    dealt = nodes.select(
        F.explode(F.array(*[F.struct(F.lit(k).cast("int").alias("which"), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m)).alias("key")) for k, m in enumerate(masks)])).alias("b"), "fp"
    ).select("b.which", "b.key", "fp")
    dealt = dealt.repartition("which", "key").sortWithinPartitions("which", "key")
    return dealt.mapInArrow(_links(apart, n_pivots), "u long, v long")


def grouped(docs: DataFrame, width: int = 3, apart: int = BITS_APART) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id) for each row; root: smallest fingerprint reachable over links."""
    marked = durable(fingerprints(docs, width))
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    small_batches(docs.sparkSession, 20_000)
    roots = components(links(nodes, apart=apart)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    small_batches(docs.sparkSession)
    nodes = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(nodes.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = 3, apart: int = BITS_APART) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row; component_id: smallest doc_id reachable over links."""
    return grouped(docs, width, apart).drop("root")


# --- similarity of whole shingle sets


def bands(shingles: np.ndarray) -> np.ndarray:
    """A key of each band: the least values of ``BAND_ROWS`` hash functions over a shingle set."""
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 4096):
        mixed = (shingles[None, k : k + 4096] ^ MASKS[:, None]) * FACTORS[:, None]
        np.minimum(least, mixed.min(1), out=least)
    rows = least.reshape(-1, BAND_ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct hashes of the lower-cased words' shingles, mixed from hashes of the words; of fewer words, one hash."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    h = np.full(n, len(words) if len(words) < width else width, np.uint64)
    for k in range(min(width, len(words))):
        h = (h ^ each[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ h >> np.uint64(32))


def _sketches(width: int):
    """Of each text: its set's hash and size, fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, fp, keys = [], [], [], []
            for text in batch.column(2).to_pylist():
                shingles = shingle_set(text or b"", width)
                node.append(xxhash.xxh3_64_intdigest(shingles.tobytes()))
                size.append(len(shingles))
                fp.append(majority(iter([shingles])))
                keys.append(bands(shingles))
            longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            ends = pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), longs(node), pa.array(size, pa.int32()), longs(fp), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "text_hash", "node", "size", "fp", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                shingles = shingle_set(text or b"", width).view(np.int64)
                ends = pa.array(np.array([0, len(shingles)], np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.ListArray.from_arrays(ends, pa.array(shingles))], ["node", "shingles"])

    return run


def similar_forest(fps: np.ndarray, sets: list[np.ndarray], similarity: float, refs: np.ndarray, apart: int = FAR) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the pairs of sets with that Jaccard similarity.

    Distances to the pivots discard, then fingerprints, then the whole sets are compared.
    Sets whose shingles are common in the bucket come first: what others were copied from.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(size) - size
    kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
    table, mine = pivot_table(fps, refs), np.zeros(len(kinds), bool)
    rows = np.arange(len(sets))

    def around(i: int) -> np.ndarray:
        may = np.flatnonzero(near(table, fps, rows, i, apart) | (size < FEW_SHINGLES))
        mine[at[starts[i] : starts[i] + size[i]]] = True
        whole = np.concatenate([at[starts[j] : starts[j] + size[j]] for j in may.tolist()]) if len(may) < len(rows) else at
        shared = np.add.reduceat(mine[whole].astype(np.int64), np.cumsum(size[may]) - size[may])
        mine[:] = False
        return may[shared + 1e-9 >= similarity * (size[may] + size[i] - shared)]

    common = np.add.reduceat(np.bincount(at)[at], starts) / size
    return forest_of(len(sets), np.argsort(-common, kind="stable").tolist(), around)


def _similar(similarity: float):
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                u, v = similar_forest(np.array([r[3] for r in rows], np.int64).view(np.uint64), [r[4] for r in rows], similarity, refs)
                nodes = np.array([r[2] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[u]), pa.array(nodes[v])], ["u", "v"])

        held: list[tuple] = []
        for batch in batches:
            flat, ends = batch.column(4).flatten().to_numpy(), batch.column(4).offsets.to_numpy()
            ends = ends - ends[0]
            sets = [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), sets):
                if held and row[:2] != held[0][:2]:
                    yield from out(held)
                    held = []
                held.append(row)
        yield from out(held)

    return run


def similar_links(nodes: DataFrame, sets: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK_BYTES) -> DataFrame:
    """Links (u, v) that connect all nodes (node, size, fp, bands) that share a key of ``bands`` and are alike.

    A bucket is worked on with the sets of its nodes, and yields a forest, never all its
    pairs. Buckets of the same nodes, which near copies share many of, are worked on once.
    One too large for a task is dealt in parts by node; each two parts meet in a task.
    """
    dealt = nodes.select("node", "size", "fp", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(
        F.count("*").alias("n"), F.ceil(F.sum("size") * 8 / block).cast("int").alias("parts"),
        F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"),
    ).where("n > 1")
    shared = shared.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.min("parts").alias("parts")).select("key", "parts")
    members = dealt.join(shared, "key").select("key", "node", "fp", "parts")
    own = F.pmod("node", F.col("parts")).cast("int")
    # the pairs of parts that have this node's; with one part, the pair (0, 0)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: (F.col("parts") == 1) | (o != F.col("own")))
    pair = lambda o: F.least(o, F.col("own")) * F.col("parts") + F.greatest(o, F.col("own"))
    members = members.withColumn("own", own).withColumn("pair", F.explode(F.transform(others, pair))).select("key", "pair", "node", "fp")
    met = members.join(sets, "node").select("key", "pair", "node", "fp", "shingles").repartition("key", "pair").sortWithinPartitions("key", "pair", "node")
    return met.mapInArrow(_similar(similarity), "u long, v long")


def with_component(nodes: DataFrame, fps: DataFrame) -> DataFrame:
    """Nodes with one key more in ``bands``: that of the component of the node's fingerprint over the links of ``fps``.

    A node without shingles has no fingerprint to be near, and gets none.
    """
    small_batches(nodes.sparkSession, 20_000)
    roots = components(links(fps)).select(F.col("u").alias("fp"), F.col("v").alias("near"))
    small_batches(nodes.sparkSession)
    key = F.xxhash64(F.lit("component"), F.coalesce("near", "fp"))
    keys = F.when(F.col("size") > 0, F.array_append("bands", key)).otherwise(F.col("bands"))
    return nodes.join(roots, "fp", "left").select("node", "text_hash", "size", "fp", keys.alias("bands"))


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text_hash, root) for each row: root tells the rows connected by texts of that Jaccard similarity.

    Texts with equal shingle sets, such as all without words, are one node. Nodes meet by
    the components of their fingerprints, linked as those of ``grouped``: blocks, the table
    of distances to pivots, exact distance. Two sets of similarity 0.8 agree in 54 of 64
    bits on average, in 40 at least, and blocks that bring all such fingerprints together
    would be 2 bits wide; so sets meet by bands of least hashes, too (at 0.8 a pair misses
    all of them once in 13,000 times). Of what meets, the pivots and the fingerprints
    discard, the whole sets verify.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary"))
    marked = durable(rows.mapInArrow(_sketches(width), "doc_id long, text_hash long, node long, size int, fp long, bands array<long>"))
    nodes = marked.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    nodes = durable(with_component(nodes, marked.where("size > 0").select("fp").distinct()))
    meets = nodes.select("node", "text_hash", F.explode("bands").alias("key"))
    shared = meets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = meets.join(shared, "key", "left_semi").select("node", "text_hash").distinct()
    texts = docs.select(F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).join(wanted, "text_hash")
    texts = texts.groupBy("node").agg(F.first("text").alias("text"))
    sets = durable(texts.mapInArrow(_sets(width), "node long, shingles array<long>"))
    roots = components(similar_links(nodes, sets, similarity, BLOCK_BYTES)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = durable(roots)
    drop(sets)
    return marked.join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """One row of ``docs`` of each group of near duplicates: the one with the smallest doc_id.

    ``groups`` (doc_id, text_hash, root) is what ``grouped`` or ``similar_groups`` gives;
    without it, five words and a similarity of 0.8. A null id comes after all others. Where
    rows of a group share that id, the one with the smallest text hash stays. Groups that
    share an id, or have none, keep a row each. All columns of ``docs`` are kept as they are.
    """
    found = similar_groups(docs) if groups is None else groups
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    key = F.coalesce(F.col("doc_id"), F.col("text_hash")).alias("key")
    keep = found.groupBy("root").agg(F.min(order).alias("k")).select("k.*").select(key, "text_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.struct("*").alias("row")).select(key, "text_hash", "row")
    rows = rows.groupBy("key", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # equal rows go before they meet
    return rows.join(keep, ["key", "text_hash"], "left_semi").select("row.*")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLES: dict[str, str] = {}
