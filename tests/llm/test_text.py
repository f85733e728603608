"""Language ID, PII, Merkle trees, mixing and language-model scores."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import TEXTS, docs, empty, in_sql, same, unique
from pyspark.sql import functions as F

from tidelog.llm import language_id, language_model, merkle, mixing, pii
from tidelog.llm.common import durable


# --- language ID


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = language_id.op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_of_awkward_rows(spark):
    model = language_id.fit(docs(spark))
    rows = language_id.predict(docs(spark), model, ("doc_id", "text")).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert language_id.fit(empty(spark)) is None
    assert {r["lang_pred"] for r in language_id.predict(docs(spark), None).collect()} == {"und"}
    assert language_id.predict(empty(spark), model).count() == 0


def brute_values(model, text):
    """Regression values of each language, from sets of n-grams."""

    def slots(t):
        out, base = set(t), 256
        for n, width in zip((2, 3, 4), language_id.SLOTS[1:]):
            bits = width.bit_length() - 1
            out |= {base + ((int.from_bytes(t[i : i + n], "big") * 2654435761) % 2**32 >> (32 - bits)) for i in range(len(t) - n + 1)}
            base += width
        return out

    own = slots(text.translate(language_id.FOLD))
    marks = [set(np.flatnonzero(r[: language_id.WIDTH]).tolist()) for r in np.unpackbits(model.landmarks, axis=1)]
    kernel = [len(own & m) / np.sqrt(len(own) * len(m)) for m in marks]
    return np.array(kernel) @ model.weights + model.offset


def test_predictions_equal_plain_kernels(spark):
    model = language_id.fit(docs(spark))
    texts = [t.encode() for _, t, *_ in TEXTS if t]
    best, score, margin = model.predict(texts)
    for t, b, s, m in zip(texts, best, score, margin):
        values = brute_values(model, t)
        e = np.exp(language_id.SHARPNESS * (values - values.max()))
        assert values[b] >= values.max() - 1e-4 and abs(s - e.max() / e.sum()) < 1e-3 and abs(m - np.diff(np.sort(values))[-1]) < 1e-3


# --- PII


def base_spans(t):
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for no, (k, p) in enumerate(plain.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if (k == "ip" and max(map(int, m[0].split("."))) > 255) or (k == "card" and not (12 <= len(d) <= 19 and luhn(d))) or (k == "phone" and not 9 <= len(d) <= 15):
                continue
            out.append((m.start(), no, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


PII = [
    "a@b@c.d e@f.g_h@i.j.k. x..y@z-.q @a.b a@.b a@b. %+-@1.2", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3 999999999999999999.1.1.1 1.2.3.400 01.02.03.04",
    "4539148803436467 4539 1488-0343 6467 4539-1488-0343-6468 45391488034364670000000 0000 0000 0000 1 4539148803436467 4539148803436467", "+1 (017) 555-7713 +12345678 +1234567890123456 ++1.2.3.4.5.6.7.8.9 +1(((((((9 +19",
    "é😀 a@b.cd 😀1.2.3.4é +49 170 1234567", "1" * 5000 + " " + "1.1." * 2000 + "a" * 3000, "12 " * 3000, "x@y.z " * 300,
]


def test_pii_equals_plain_patterns(spark):
    texts = PII + [t or "" for _, t, *_ in TEXTS]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in pii.pii(rows).collect():
        spans = [s for s in r["spans"].split(",") if s.split(":")[0] in pii.KINDS[: pii.BASE]]
        assert ",".join(spans) == base_spans(texts[r["doc_id"]])
    assert pii.pii(docs(spark)).count() == len(TEXTS) and pii.pii(empty(spark)).count() == 0


ADDED = ["dni 12345678Z y nif 12345678A, dni: 00000000-T", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" or so', "nir 1 85 05 78 006 084 91 ok, 185057800608490", "commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", "key aaaaaaaaaaaaaaaaaaaaaaaaaaa1"]


def test_pii_sql(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(PII[:5] + ADDED)], "doc_id long, text string")
    same(pii.pii(df).drop("scores"), in_sql(df, pii.ORACLES["op10_pii"]))


def test_pii_checksums_and_context(spark):
    texts = ["Konto DE89 3704 0044 0532 0130 00 ok", "IBAN DE89370400440532013001", "my SSN is 078-05-1120", "part 078-05-1120", "card 4539148803436467", "serial 4539148803436467", *ADDED]
    got = {r["doc_id"]: r for r in pii.pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0]["spans"] == "iban:6:33" and got[1]["spans"] == "" and got[2]["spans"].startswith("ssn") and got[3]["spans"] == ""
    assert got[4]["scores"][0] > got[5]["scores"][0]
    assert [got[i]["spans"] for i in range(6, 11)] == ["dni:4:13,dni:36:46", "secret:9:49", "nir:4:25", "", ""] and got[6]["n_spans"] == 2


def test_pii_places_in_a_text_of_very_many_matches(spark):
    text = "".join(f"é{'x' * (i % 37)} a{i}@b.cd" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.pii(df).first()["spans"] == base_spans(text)
    assert pii.redact(df).first()["text"] == re.sub(r"[a-z0-9]+@b.cd", "[EMAIL]", text)


def test_redaction_masks_unions(spark):
    df = spark.createDataFrame([(0, "mail a@b.cd now", 15), (1, None, None), (2, "x 4539148803436467 y +4539148803436467 z", 0), (3, "é😀 a@b.cd", 3)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert got[0]["text"] == "mail [EMAIL] now" and got[0]["n_chars"] == 16 and got[1]["text"] is None and got[3]["text"] == "é😀 [EMAIL]"
    assert "4539" not in got[2]["text"]


# --- Merkle trees


def test_merkle_sql(spark):
    df = docs(spark, unique())
    same(merkle.compare_with_next(df), in_sql(df, merkle.ORACLES["op7_merkle"]))


def test_merkle_awkward(spark):
    rows = merkle.compare_with_next(docs(spark)).collect()
    assert len(rows) == len(TEXTS) and merkle.compare_with_next(empty(spark)).count() == 0
    by_text = {}
    for r in rows:
        by_text.setdefault(r["fingerprint"], set()).add(r["n_chars"])
    assert all(len(v) == 1 for v in by_text.values())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    one = merkle.compare_with_next(docs(spark, [TEXTS[0]])).first()
    assert one["near_next"] == 1.0


def test_merkle_sql_of_long_paragraphs_and_scripts_without_spaces(spark):
    words = " ".join(f"wort{i}{'ae'[i % 2]}" for i in range(30_000))
    rows = [(i, t, "en", "a") for i, t in enumerate(["x" * 200_000, "x" * 150_000 + "y" * 50_000, words, words + " z", "\u6587\u5b57\u3002" * 400, "\u6587\u5b57" * 4000, "a\nb\n\n" * 300, "a\nb\n\n" * 299 + "c"])]
    df = docs(spark, rows)
    got = {r["doc_id"]: r for r in merkle.compare_with_next(df).collect()}
    assert got[2]["near_edited"] > 0.6 and got[3]["near_edited"] > 0.6 and got[3]["near_next"] > 0.99
    same(merkle.compare_with_next(df), in_sql(df, merkle.ORACLES["op7_merkle"]))


def test_merkle_of_many_rows_without_id(spark):
    rows = [(None, f"text {i % 7}. More of it.", "en", "a") for i in range(40)] + [(1, "One. Two.", "en", "a")]
    got = merkle.compare_with_next(docs(spark, rows)).collect()
    assert len(got) == 41 and sum(r["doc_id"] is None for r in got) == 40
    assert len({(r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in got}) == 8


def test_merkle_exchanges_the_texts_once(spark):
    """Also where the order of the ids is too large to be broadcast."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = merkle.compare_with_next(durable(docs(spark)))._jdf.queryExecution().explainString(mode)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: \[([^\]]*)\]", plan)
    assert sum("text#" in columns for columns in moved) == 1


def test_differences_locate_edits(spark):
    a, b = "One. Two. Three.\nFour. Five.\nSix.", "One. Two. Three.\nFour. Fife.\nSix. Seven."
    row = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.differences(merkle.tree(F.col("a")), merkle.tree(F.col("b"))).alias("d"), merkle.differences(merkle.tree(F.col("a")), merkle.tree(F.col("a"))).alias("none")).first()
    assert [(x["section"], x["paragraph"]) for x in row["d"]] == [(1, 1), (2, 0), (2, 1)] and row["none"] == []


# --- mixing


def test_mixing_sql_and_sums(spark):
    df = docs(spark)
    got = mixing.mix(df)
    same(got, in_sql(df, mixing.ORACLES["op5_mixing"]))
    by = {}
    for r in got.collect():
        by.setdefault(r["source"], []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    for rows in by.values():
        assert sum(r["taken"] for r in rows) == int(rows[0]["target"]) and rows[0]["target"] <= 3 * rows[0]["source_size"]
    total = sum(r["size"] for rows in by.values() for r in rows)
    assert abs(sum(rows[0]["target"] for rows in by.values()) - total) < 1e-6
    assert mixing.mix(empty(spark)).count() == 0


@pytest.mark.parametrize("sizes", [[1, 1, 1, 1], [100, 1, 1], [0, 0], [5], [1, 1000, 1, 1, 50, 0]])
def test_targets_by_resharing(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    free, target, total = set(range(len(sizes))), [0.0] * len(sizes), float(sum(sizes))
    left = total
    while free:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > 3 * sizes[i]}
        if not over:
            for i in free:
                target[i] = share[i]
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
            left -= target[i]
        free -= over
    rows = mixing.source_targets(spark.createDataFrame([(f"0{i}", s) for i, s in enumerate(sizes)], "src string, source_size long")).orderBy("src").collect()
    assert [r["target"] for r in rows] == pytest.approx(target)


# --- language model


def log_probabilities(p):
    """(class 2 before, class 1 before) -> log-probabilities of all classes, one context at a time."""

    def of(one, two):
        h = p.position[0].astype(float) @ p.context[one] + p.position[1].astype(float) @ p.context[two]
        s = p.target.astype(float) @ h + p.bias
        return s - s.max() - np.log(np.exp(s - s.max()).sum())

    return of


def check_scores(spark, rows, frequent):
    df = docs(spark, rows)
    training = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(3)) != 1
    known, v, p = language_model.fit(df.where(training), frequent)
    got = language_model.score_with(df, known, v, p).collect()
    counts = Counter()
    for i, t, *_ in rows:
        if (i or 0) % 3 != 1:
            counts.update(language_model.tokens((t or "").encode()))
    n, size = sum(counts.values()), len(counts)
    own = dict(zip(v.h.tolist(), v.cls.tolist()))
    cls = lambda w: own.get(language_model.word_hash(w), v.own if w == b"" else v.own + 1 + language_model.bucket(w))
    shared = Counter()
    for w, c in counts.items():
        shared[cls(w)] += c + 1
    log_p = log_probabilities(p)

    def want(t):
        w = language_model.tokens((t or "").encode())
        c, total = [v.own, v.own, *map(cls, w)], 0.0
        seen = {}
        for two, one, now, x in zip(c, c[1:], c[2:], w):
            if (one, two) not in seen:
                seen[one, two] = log_p(one, two)
            total += seen[one, two][now] / np.log(10) + (np.log10((counts[x] + 1) / (shared[now] + 1)) if now > v.own else 0.0)
        return len(w), sum(x in counts for x in w), round(float(sum(np.log10((counts[x] + 1) / (n + size + 1)) for x in w)), 4), round(total, 3)

    near = lambda a, b: a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-3 and abs(a[3] - b[3]) < 1e-2 + 1e-5 * abs(b[3])
    pairs = list(zip(sorted((r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), sorted(want(t) for _, t, *_ in rows)))
    assert all(near(a, b) for a, b in pairs), [x for x in pairs if not near(*x)]
    assert len(got) == len(rows) and all(r["train_tokens"] == n for r in got)


@pytest.mark.parametrize("frequent", [100_000, 3, 0])
def test_scores_equal_brute_force(spark, frequent):
    check_scores(spark, TEXTS, frequent)


def test_scores_of_empty_tables(spark):
    assert language_model.score(empty(spark), F.lit(True)).count() == 0
    rows = language_model.score(docs(spark), F.lit(False)).collect()
    assert len(rows) == len(TEXTS) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in rows)


def test_tables_are_normalised():
    rng = np.random.default_rng(2)
    p = language_model.Parameters(np.full(40, 1 / 40))
    p.flat[:] = rng.normal(0, 1, len(p.flat))
    scores, sums = p.tables()
    of = log_probabilities(p)
    for one, two in rng.integers(0, 40, (20, 2)):
        log_p = scores[0, one] + scores[1, two] - sums[one, two]
        assert np.allclose(log_p, of(one, two), atol=1e-5) and np.isclose(np.exp(log_p).sum(), 1)


def test_noise_contrastive_estimation_learns_the_next_class():
    rng = np.random.default_rng(3)
    n = 30
    follow = rng.dirichlet(np.full(n, 0.1), n)  # the next class hangs on the one before
    trainer = language_model.Trainer(np.full(n, 1 / n))
    for _ in range(600):
        one = rng.integers(0, n, 256)
        words = (follow[one].cumsum(1) > rng.random((256, 1))).argmax(1)
        trainer.learn([one, rng.integers(0, n, 256)], words)
    scores, sums = trainer.p.tables()
    log_p = np.stack([[scores[0, i] + scores[1, 0] - sums[i, 0]] for i in range(n)])[:, 0]
    assert -(follow * log_p).sum(1).mean() < 0.7 * np.log(n)


def test_words_that_end_alike_are_classed_once(spark, monkeypatch):
    rng = random.Random(4)
    odd = [b"", b".", b"..", b"a", b"a.", b"ab..", b"abc.", b"abc..", b"abcd", b"x....", b"....x", b"abcdef?!", b"\xc3\xa9.", b"ab\x00."]
    words = odd + [bytes(rng.choices(b"ab.,!?)", k=rng.randint(1, 9))) for _ in range(3000)]
    assert language_model.buckets(words).tolist() == [language_model.bucket(w) for w in words]
    _, vocabulary, _ = language_model.fit(docs(spark))
    asked, bucket = [], language_model.bucket
    monkeypatch.setattr(language_model, "bucket", lambda w: asked.append(w) or bucket(w))
    table, new = language_model.Table(vocabulary), [b"%dword" % i for i in range(1000)]
    rows = table.look_up(new + new)
    assert rows.tolist() == [*range(1000)] * 2 and len(asked) <= 1
    assert set(table.cls[rows].tolist()) == {vocabulary.own + 1 + bucket(b"word")} and table.rare.all()


def test_every_token_is_learnt_from(spark):
    _, vocabulary, _ = language_model.fit(docs(spark))
    texts = [t and t.encode() for _, t, *_ in TEXTS]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.binary())], ["text"]) for x in (texts[:9], texts[9:])]
    (learnt,) = language_model._train(vocabulary)(iter(batches))
    assert set(learnt.column("examples").to_pylist()) == {sum(len(language_model.tokens(t)) for t in texts)}


def test_classes_grow_with_the_corpus():
    sizes = [language_model.own_words(10**k) for k in range(3, 12)]
    assert sizes == sorted(sizes) and sizes[0] == language_model.OWN_LEAST and sizes[-1] == language_model.OWN_MOST


def test_model_is_better_than_base(spark):
    held = [r for r in language_model.op9_lm_scores(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    print("held out", sum(r["score"] for r in held), sum(r["base_score"] for r in held))
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in held)
