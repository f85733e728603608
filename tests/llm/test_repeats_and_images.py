import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import TEXTS, docs, empty
from pyspark.sql import functions as F

from tidelog.llm import image_copies, suffix_repeats
from tidelog.llm.common import durable
from tidelog.llm.suffix_repeats import LENGTH, Repeats


def all_repeats(strings, least):
    places = {}
    for i, s in enumerate(strings):
        for a in range(len(s)):
            for b in range(a + least, len(s) + 1):
                places.setdefault(s[a:b], []).append((i, a))
    out = []
    for w, at in places.items():
        left = {strings[i][a - 1] if a else (i, a) for i, a in at}
        right = {strings[i][a + len(w)] if a + len(w) < len(strings[i]) else (i, a) for i, a in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out.append((len(w), sorted(at)))
    return sorted(out)


def test_maximal_repeats_with_all_occurrences():
    rng = random.Random(5)
    for _ in range(60):
        strings = [bytes(rng.choices(b"ab", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 6))]
        least = rng.choice([2, 3, 5, 9])
        assert sorted(Repeats(strings, least).groups()) == all_repeats(strings, least)
    assert Repeats([]).groups() == [] and Repeats([b""]).groups() == []


def brute(texts):
    seen = {}
    for t in texts:
        for i in range(len(t) - LENGTH + 1):
            seen[t[i : i + LENGTH]] = seen.get(t[i : i + LENGTH], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - LENGTH + 1):
            if seen[t[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)])) == 1
        out.append((len(t), int(gone.sum()), int(edge.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("most, part", [(1000, 1 << 17), (1, 1 << 17), (1000, 700)])
def test_removal_equals_brute_force(spark, monkeypatch, most, part):
    monkeypatch.setattr(suffix_repeats, "MOST", most)
    monkeypatch.setattr(suffix_repeats, "PART", part)
    rows = [r if r[0] != 7 else (7, "x" * 2000, "es", "c") for r in TEXTS]
    rows += [(100 + i, f"{i} " + TEXTS[9][1][: 500 + 7 * i] + f" tail {i}", "en", "a") for i in range(12)]
    got = suffix_repeats.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute([(t or "").encode() for _, t, *_ in rows])


@pytest.mark.parametrize("part", [1 << 17, 700])
def test_a_text_that_repeats_itself_alone(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_repeats, "PART", part)
    runs = [("q" * 401).encode(), ("-" * 500).encode(), (" " * 799).encode(), ("word " * 100).encode(), (TEXTS[9][1].encode()[:305] * 3)[:799], b"a" + b"z" * 400 + b"b"]
    rows = [(i, t.decode(errors="replace"), "en", "a") for i, t in enumerate(runs)]
    for row in rows:  # each with no other document beside it, then all of them
        got = suffix_repeats.remove_repeats(docs(spark, [row])).collect()
        assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == brute([row[1].encode()])
    got = suffix_repeats.remove_repeats(docs(spark, rows)).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute([t.encode() for _, t, *_ in rows])
    assert sum(r["n_removed"] > 0 for r in got) == 5


def test_removal_of_nothing(spark):
    assert suffix_repeats.remove_repeats(empty(spark)).count() == 0
    rows = suffix_repeats.remove_repeats(docs(spark, TEXTS[1:3]), with_text=True).collect()
    assert [bytes(r["kept"]) for r in rows] == [b"", b""]


def test_images_are_decoded():
    image = np.arange(48, dtype=np.float32).reshape(6, 8)
    assert (image_copies.decode(image_copies.pgm(image)) == image).all()
    for kind in range(5):
        raw, prev = b"", np.zeros(9, int)
        for y in range(6):
            cur = np.concatenate([[0], image[y].astype(int)])
            guess = [0, cur[:-1], prev[1:], (cur[:-1] + prev[1:]) // 2, np.array([min((a, b, c), key=lambda v: abs(a + b - c - v)) for a, b, c in zip(cur[:-1], prev[1:], prev[:-1])])][kind]
            raw += bytes([kind]) + ((cur[1:] - guess) % 256).astype(np.uint8).tobytes()
            prev = cur
        part = lambda k, d: len(d).to_bytes(4, "big") + k + d + b"\0" * 4
        png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", (8).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
        assert (image_copies.decode(png) == image).all(), kind
    palette = png[:25] + bytes([3]) + png[26:]
    bomb = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", (8).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + part(b"IDAT", zlib.compress(bytes(1 << 24)))
    assert image_copies.decode(bomb).shape == (6, 8)  # only as much as the header says
    for bad in (None, b"", b"P5", b"P5 9 9 255\n", b"P5 0 9 255\n", b"P5 0 0 255\n", palette, b"P5 999999 999999 255\n", b"\x89PNG\r\n\x1a\n", b"GIF89a"):
        assert image_copies.decode(bad) is None


def test_edited_copies_are_found(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=16).tolist()) for i in range(0, 1200, 10)] + [(5, None), (1201, [0.5]), (1203, [0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(4)
    images = image_copies.media(df)
    queries = image_copies.media(df.where("vec_id % 100 = 0"), edit=True)
    extra = images.union(spark.createDataFrame([(9000, None), (9001, bytearray(b"junk")), (9002, bytearray(image_copies.pgm(np.zeros((64, 64)))))], "image_id long, image binary"))
    rows = image_copies.find_copies(queries, extra.union(images.where("image_id = 300").selectExpr("image_id + 7000", "image"))).collect()
    got = {(r["query_id"], r["match_id"]) for r in rows if r["query_id"] is not None}
    want = {(i, i) for i in range(0, 1200, 100)}
    assert {r["member_id"] for r in rows if r["match_id"] == 300 and r["query_id"] is None} == {300, 7300}
    assert all(r["copies"] == 1 + (r["match_id"] == 300) for r in rows)
    assert len(want & got) >= 0.9 * len(want) and len(got - want) <= 2
    none = spark.createDataFrame([], "image_id long, image binary")
    assert image_copies.find_copies(none, none).count() == 0


def turned(image, degrees):
    """About its middle, bilinear; what comes from outside is grey."""
    h, w = image.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.mgrid[0:h, 0:w] - (h - 1) / 2
    sy, sx = s * x + c * y + (h - 1) / 2, c * x - s * y + (w - 1) / 2
    inside = (sy >= 0) & (sy <= h - 1) & (sx >= 0) & (sx <= w - 1)
    y0, x0 = np.clip(sy.astype(int), 0, h - 2), np.clip(sx.astype(int), 0, w - 2)
    fy, fx = sy - y0, sx - x0
    out = (1 - fy) * ((1 - fx) * image[y0, x0] + fx * image[y0, x0 + 1]) + fy * ((1 - fx) * image[y0 + 1, x0] + fx * image[y0 + 1, x0 + 1])
    return np.where(inside, out, 128)


EDITS = {
    "turned by 17": lambda d: turned(d, 17), "turned by 37": lambda d: turned(d, 37), "turned by 180": lambda d: np.rot90(d, 2),
    "cropped to half": lambda d: d[24:72, 30:78], "resized by 0.5": lambda d: image_copies.resized(d, 0.5), "resized by 0.6": lambda d: image_copies.resized(d, 0.6), "resized by 0.87": lambda d: image_copies.resized(d, 0.87),
    "resized by 1.5": lambda d: image_copies.resized(d, 1.5), "resized by 2.3": lambda d: image_copies.resized(d, 2.3), "resized by 1.3, darker": lambda d: image_copies.resized(d * 0.7, 1.3),
}


def test_edits_between_the_steps_of_the_pyramid_are_found(spark):
    drawings = [image_copies.drawn([float(i), 1.0]) for i in range(60)]
    images = spark.createDataFrame([(i, bytearray(image_copies.pgm(d))) for i, d in enumerate(drawings)], "image_id long, image binary").repartition(4)
    asked = [(1000 * k + i, bytearray(image_copies.pgm(edit(drawings[i])))) for k, edit in enumerate(EDITS.values()) for i in range(0, 60, 2)]
    queries = spark.createDataFrame(asked, "image_id long, image binary").repartition(4)
    got = {(r["query_id"], r["match_id"]) for r in image_copies.find_copies(queries, images).collect() if r["query_id"] is not None}
    found = {name: len({(1000 * k + i, i) for i in range(0, 60, 2)} & got) for k, name in enumerate(EDITS)}
    assert all(n >= 27 for n in found.values()), found
    assert sum(q % 1000 != m for q, m in got) <= 2


def test_matching_corners_equal_brute_force(spark):
    """All corners of a query at a distance within the radius whose keys are one bit away at most, by comparing all."""
    drawings = [image_copies.drawn([float(i), 2.0]) for i in range(8)]
    table = lambda rows: spark.createDataFrame([(i, bytearray(image_copies.pgm(d))) for i, d in rows], "image_id long, image binary")
    found = lambda rows: durable(image_copies.distinct_images(image_copies.corners(table(rows))))  # noqa: E731  drawn once: sums of floats may differ
    index, queries = found(enumerate(drawings)), found([(100, image_copies.resized(drawings[3], 0.8))])
    got = set()
    for r in image_copies.met_pairs(queries, index, agree=1).collect():
        longs = {c: np.array(r[c], np.int64) for c in ("q_no", "no", "q_d0", "q_d1", "d0", "d1", "q_place", "place")}
        a, b = longs["q_no"], longs["no"]
        ok = image_copies.verified(longs["q_d0"][a], longs["q_d1"][a], longs["d0"][b], longs["d1"][b])
        got |= {(r["image_id"], p, o) for p, o in zip(longs["q_place"][a[ok]].tolist(), longs["place"][b[ok]].tolist())}
    width, q, want = image_copies.key_width(index), queries.first(), set()
    for r in index.collect():
        for a, b, p in zip(q["d0"], q["d1"], q["place"]):
            for c, d, o in zip(r["d0"], r["d1"], r["place"]):
                x, y = (a ^ c) % 2**64, (b ^ d) % 2**64
                key = min((x & m % 2**64).bit_count() + (y & n % 2**64).bit_count() for m, n in image_copies.masks(width))
                if key <= 1 and x.bit_count() + y.bit_count() <= image_copies.APART:
                    want.add((r["image_id"], p, o))
    assert got == want and len(want) > 20


def test_keys_are_as_wide_in_any_corpus(spark):
    few, many = (spark.range(n).select(F.array_repeat(F.lit(0).cast("long"), 1 << 20).alias("d0")) for n in (1, 40))
    assert image_copies.key_width(few) == image_copies.key_width(many)


def test_corners_and_keys_are_never_broadcast(spark):
    table = spark.createDataFrame([(i, bytearray(image_copies.pgm(image_copies.drawn([float(i), 3.0])))) for i in range(3)], "image_id long, image binary")
    found = durable(image_copies.distinct_images(image_copies.corners(table)))
    plan = image_copies.met_pairs(found, found)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def drawing_rows(n, seed):
    return [(i, image_copies.drawn([float(i), seed])) for i in range(n)]


def as_images(spark, rows):
    return spark.createDataFrame([(i, bytearray(image_copies.pgm(d))) for i, d in rows], "image_id long, image binary").repartition(4)


def shuffled(spark):
    """Bytes written to exchanges by all stages so far."""
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), jvm.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_corners_are_not_exchanged(spark):
    """What grows with the images' corners, or with queries times images, stays where it is written."""
    drawings = drawing_rows(300, 6.0)
    images, queries = as_images(spark, drawings), as_images(spark, [(i, image_copies.resized(d, 0.75)) for i, d in drawings[::100]])
    images, queries = durable(images), durable(queries)
    corners = sum(len(image_copies.describe(d)[0]) for _, d in drawings)
    before = shuffled(spark)
    got = {(r["query_id"], r["match_id"]) for r in image_copies.find_copies(queries, images).collect() if r["query_id"] is not None}
    assert {(0, 0), (100, 100), (200, 200)} <= got
    assert 0 < shuffled(spark) - before < 4 * corners  # a descriptor and its place are 24 bytes


@pytest.mark.parametrize("met", [1 << 20, 3])
def test_a_block_meets_what_brute_force_meets(monkeypatch, met):
    monkeypatch.setattr(image_copies, "MET", met)
    longs = lambda image: np.packbits(image_copies.describe(image)[4], axis=1).view(np.int64).reshape(-1, 2).T
    drawings = [d for _, d in drawing_rows(4, 7.0)]
    asked = [(i, 72, *longs(image_copies.resized(d, 0.75))) for i, d in enumerate(drawings[:2])]
    block = image_copies.Block([(*q, np.zeros(len(q[2]), np.int64)) for q in asked])
    d0, d1 = np.concatenate([longs(d) for d in drawings], axis=1)
    got = list(zip(*(x.tolist() for x in block.matches(d0, d1))))
    want = set()
    q0, q1 = (np.concatenate([q[k] for q in asked]) for k in (2, 3))
    for i, (a, b) in enumerate(zip(q0.tolist(), q1.tolist())):
        for j, (c, d) in enumerate(zip(d0.tolist(), d1.tolist())):
            x, y = (a ^ c) % 2**64, (b ^ d) % 2**64
            key = min((x & m % 2**64).bit_count() + (y & n % 2**64).bit_count() for m, n in image_copies.masks(image_copies.KEY_BITS))
            if key <= 1 and x.bit_count() + y.bit_count() <= image_copies.APART:
                want.add((i, j))
    assert sorted(got) == sorted(want) and len(want) > 20  # each once


def test_blocks_of_queries_find_what_one_block_finds(spark, monkeypatch):
    drawings = drawing_rows(24, 8.0)
    images = as_images(spark, drawings + [(100 + i, d) for i, d in drawings[:5]] + [(0, drawings[0][1])])  # copies, one under the same id
    queries = as_images(spark, [(i, image_copies.resized(d, 0.75)) for i, d in drawings[::3]])
    rows = lambda: sorted(map(repr, image_copies.find_copies(queries, images).collect()))
    one = rows()
    monkeypatch.setattr(image_copies, "BLOCK", 1)
    assert rows() == one
    assert sum("match_id=0," in r and "member_id=None" not in r for r in one) == 3


def test_copies_of_a_pair_equal_its_votes():
    """Pairs left out before their votes are counted have too few."""
    drawings = [d for _, d in drawing_rows(12, 9.0)]
    def one(i, image):
        x, y, level, angle, bits = image_copies.describe(image)
        at = [np.rint(v * 4).astype(np.int64) + image_copies.ZERO for v in (x, y)]
        d = np.packbits(bits, axis=1).view(np.int64).reshape(-1, 2)
        return i, max(image.shape), d[:, 0], d[:, 1], at[0] << 40 | at[1] << 20 | np.rint(angle % (2 * np.pi) * 1024).astype(np.int64) << 6 | level
    asked, images = [one(i, image_copies.resized(d, 0.75)) for i, d in enumerate(drawings[:6])], [one(i, d) for i, d in enumerate(drawings)]
    block = image_copies.Block(asked, agree=2)
    d0, d1, place = (np.concatenate([r[k] for r in images]) for k in (2, 3, 4))
    owner = np.repeat(np.arange(len(images)), [len(r[2]) for r in images])
    q, i = block.matches(d0, d1)
    want = set()
    for a in range(len(asked)):
        for b in range(len(images)):
            own = (block.owner[q] == a) & (owner[i] == b)
            n = image_copies.agreeing(asked[a][1], q[own], block.place[q[own]], place[i[own]]) if own.any() else 0
            if n >= max(2, image_copies.AGREE_SHARE * len(asked[a][2])):
                want.add((a, b, n))
    assert set(block.copies(d0, d1, place, owner)) == want and {(a, a) for a in range(6)} <= {w[:2] for w in want}


def test_votes_equal_a_plain_count():
    image = image_copies.drawn([4.0])
    q, r = image_copies.describe(image_copies.resized(image, 0.8)), image_copies.describe(image)
    pack = lambda d: np.rint(d[0] * 4).astype(np.int64) + image_copies.ZERO << 40 | np.rint(d[1] * 4).astype(np.int64) + image_copies.ZERO << 20 | np.rint(d[3] % (2 * np.pi) * 1024).astype(np.int64) << 6 | d[2].astype(np.int64)
    qp, rp = pack(q), pack(r)
    a, b = np.nonzero((q[4][:, None] != r[4][None]).sum(2) <= image_copies.APART)
    votes = {}
    for i, j in zip(a.tolist(), b.tolist()):
        (qx, qy, qa, ql), (x, y, an, le) = ([float(v) for v in image_copies.unpacked(np.array([p]))] for p in (qp[i], rp[j]))
        turn, ls = (an - qa) % (2 * np.pi), (le - ql) * -np.log2(image_copies.STEP)
        dx, dy = x - 2**ls * (np.cos(turn) * qx - np.sin(turn) * qy), y - 2**ls * (np.sin(turn) * qx + np.cos(turn) * qy)
        w = max(image_copies.SHIFT, image_copies.SHARE * 77 * 2 ** (np.floor(ls / 0.6 + 0.5) * 0.6))
        low = [int(np.floor(v - 0.5)) for v in (turn * 6 / np.pi, ls / 0.6, dx / w, dy / w)]
        spot = max(image_copies.SHIFT, image_copies.SHARE * 77)
        for k in range(16):
            at = [v + (k >> n & 1) for n, v in enumerate(low)]
            votes.setdefault((at[0] % 12, *at[1:]), set()).add((i, (int(qx // spot), int(qy // spot))))
    want = max(len({i for i, _ in v}) if len({s for _, s in v}) >= image_copies.PLACES else 0 for v in votes.values())
    assert image_copies.agreeing(77, a, qp[a], rp[b]) == want > 20
