import numpy as np
import pytest
import xxhash
from cases import TEXTS, docs, empty, prose

from tidelog.llm import simhash
from tidelog.llm.components import components, forest


def plain(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def labels(fps, ids):
    """Smallest id reachable, by comparing all pairs."""
    f = np.array(fps, np.uint64)
    u, v = np.nonzero(np.bitwise_count(f[:, None] ^ f[None, :]) <= 3)
    a, b = forest(u, v)
    root = np.arange(len(f))
    root[a] = b
    least = {}
    for r, i in zip(root, ids):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    return [least.get(r) for r in root]


def test_fingerprints_and_components_equal_brute_force(spark):
    got = simhash.near_duplicates(docs(spark)).collect()
    fps = [plain(t) for _, t, *_ in TEXTS]
    want = sorted(map(repr, zip([i for i, *_ in TEXTS], fps, labels(fps, [i for i, *_ in TEXTS]))))
    assert sorted(repr((r["doc_id"], r["fp"] % 2**64, r["component_id"])) for r in got) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 300)
    assert simhash.fingerprint(TEXTS[8][1].encode()) == plain(TEXTS[8][1])


@pytest.mark.parametrize("flips", [1, 3, 6])
def test_links_connect_all_near_fingerprints(spark, flips):
    rng = np.random.default_rng(flips)
    f = rng.integers(0, 2**64, 6, np.uint64)[rng.integers(0, 6, 900)]
    for _ in range(flips):
        f ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    f = np.unique(f)
    nodes = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long").repartition(5)
    root = {r["u"]: r["v"] for r in components(simhash.links(nodes)).collect()}
    own = f.view(np.int64).tolist()
    assert [root.get(x, x) for x in own] == labels(f, own)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 400)]
    star = [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (5001, 5002), (5002, 5001)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(chain + star, "u long, v long").repartition(7)).collect()}
    want = {i: 0 for i in range(1, 401)} | {1000 + i: 1000 for i in range(1, 300)} | {5002: 5001}
    assert got == want


def test_components_over_rounds(spark, monkeypatch):
    """Where a task contracts only a few links at a time, rounds do the rest."""
    from tidelog.llm import components as module

    monkeypatch.setattr(module, "_contract", lambda batches: batches)
    chain = [(i, i + 1) for i in range(60)]
    got = {r["u"]: r["v"] for r in module.components(spark.createDataFrame(chain, "u long, v long").repartition(4)).collect()}
    assert got == {i: 0 for i in range(1, 61)}


def similar(rows, least=0.8):
    """Groups of (id, text, ...) connected by Jaccard similarity of five-word shingles, by comparing all pairs."""

    def grams(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [grams(t) for _, t, *_ in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and (a == b or len(a & b) >= least * len(a | b)):
                part = [part[j] if p == part[i] else p for p in part]
    return [[r for r, p in zip(rows, part) if p == q] for q in set(part)]


def family(seed, n, size=120):
    """A text, and copies of it with a word changed each, further and further from it."""
    words, out = prose(seed, size).split(), []
    for i in range(n):
        out.append(" ".join(words))
        words[(37 * i + 11) % size] = f"new{seed}x{i}"
    return out


@pytest.mark.parametrize("block", [64 << 20, 5000])
def test_similar_groups_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", block)
    rows = list(TEXTS)
    for seed in (31, 32, 33):
        rows += [(1000 * seed + i, t, "en", "a") for i, t in enumerate(family(seed, 14))]
    rows += [(50_000 + i, prose(40, 300) + " " + prose(41 + i, 60), "en", "a") for i in range(20)]  # a passage all share: J about 0.7
    rows += [(60_000 + i, " ".join("abcdefgh"[: 5 + i % 4]), "en", "a") for i in range(8)]
    groups = {}
    for r in simhash.similar_groups(docs(spark, rows)).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    key = lambda g: sorted(map(str, g))
    assert sorted(map(key, groups.values())) == sorted(key(i for i, *_ in g) for g in similar(rows))
    assert simhash.similar_groups(empty(spark)).count() == 0


def test_similar_texts_meet_by_their_fingerprints(spark, monkeypatch):
    """Where no band brings them together: those linked within 3 bits, verified by their sets."""

    def none_shared(shingles):
        return np.array([xxhash.xxh3_64_intdigest(shingles.tobytes(), i) for i in range(24)], np.uint64).view(np.int64)

    monkeypatch.setattr(simhash, "bands", none_shared)
    rows = [(100 * seed + i, t, "en", "a") for seed in range(8) for i, t in enumerate(family(50 + seed, 3, 3000))] + [(5000, "", "en", "a"), (5001, None, "en", "a")]
    fps = {i: simhash.majority(iter([simhash.shingle_set((t or "").encode(), 5)])) for i, t, *_ in rows}
    want = {i: i for i in fps}
    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 3 and want[i] != want[j]:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = {k: new if v == old else v for k, v in want.items()}
    groups = {}
    for r in simhash.similar_groups(docs(spark, rows)).collect():
        groups.setdefault(r["root"], []).append(r["doc_id"])
    assert {i: min(g) for g in groups.values() for i in g} == want and len(set(want.values())) < 20


def test_many_texts_of_one_template(spark):
    """None is like another but two, all meet."""
    shared = prose(70, 150)
    rows = [(i, f"{shared} {prose(100 + i, 45)}", "en", "a") for i in range(40)] + [(100, f"{shared} {prose(139, 45)} end", "en", "a")]
    roots = [r["root"] for r in simhash.similar_groups(docs(spark, rows)).collect()]
    assert len(set(roots)) == len(similar(rows)) == 40


def test_one_of_each(spark):
    rows = simhash.one_of_each(docs(spark)).collect()
    ids = [r["doc_id"] for r in rows]
    assert len(ids) == len(set(ids)) and 0 in ids and 3 not in ids and 12 not in ids and len(rows[0]) == 11


def test_one_of_each_keeps_columns_with_names_used_inside(spark):
    names = ("text_hash", "key", "row", "root", "_hash", "node")
    df = spark.createDataFrame([(1, "a b", *"uvwxyz"), (2, "a b", *"uvwxyz"), (None, "c", *"uvwxyz")], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    rows = simhash.one_of_each(df, simhash.grouped(df)).collect()
    assert sorted((r["doc_id"] or 0, *r[2:]) for r in rows) == [(0, *"uvwxyz"), (1, *"uvwxyz")]


def test_one_of_each_group_where_ids_are_null_or_shared(spark):
    rows = [(None, prose(i, 80), "en", "a") for i in range(20, 30)] + [(50, prose(i, 80), "en", "a") for i in range(30, 34)]
    rows += [(None, prose(20, 80), "en", "a"), (None, prose(30, 80), "en", "a"), (8, prose(21, 80), "en", "a"), (50, prose(31, 80), "en", "a")]
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.one_of_each(docs(spark, rows)).collect())
    want = [(8 if i == 21 else 0, prose(i, 80)) for i in range(20, 30)] + [(50, prose(i, 80)) for i in range(30, 34)]
    assert got == sorted(want)
