import hashlib
from collections import Counter

import numpy as np
from cases import TEXTS, docs, empty, in_sql, unique
from test_simhash import similar
from test_text import brute_values

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tidelog.llm import language_id, mixing, pii
from tidelog.llm.common import durable


def test_stages_take_effect(spark):
    d = docs(spark, TEXTS)
    kept = durable(pipeline.identify(spark, d, ""))
    texts = [r["text"] for r in kept.collect()]
    assert all(t and any(map(str.isalpha, t)) for t in texts) and kept.columns == list(pipeline.COLUMNS)
    one = durable(pipeline.deduplicate(spark, kept, ""))
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = {min((i for i, _ in group if i is not None), default=None) for group in similar(rows)}
    assert {r["doc_id"] for r in one.collect()} == want and one.count() == len(want)
    clean = durable(pipeline.redact(spark, one, ""))
    assert clean.count() == one.count() and not any("@c.de" in r["text"] for r in clean.collect())
    mixed = durable(pipeline.mix(spark, clean, ""))
    assert mixed.columns == list(pipeline.COLUMNS) and {r["doc_id"] for r in mixed.collect()} <= want
    out = pipeline.encode(spark, mixed, "")
    assert sorted(r["decoded_sha256"] for r in out.collect()) == sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect())


def test_stages_of_an_empty_table(spark):
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty(spark), "").count() == 0


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "simhash", "pii", "mixing", "bpe"]
    assert names["pipeline"](spark, "/root/testdata/sf0.001").count() > 0


def test_language_stage_equals_a_plain_prediction(spark):
    d = docs(spark, TEXTS)
    model = language_id.fit(d)
    lead = {}
    for _, t, *_ in TEXTS:
        if t and any(map(str.isalpha, t)):
            s = np.sort(brute_values(model, t.encode()))
            lead[t] = s[-1] - s[-2]
    want = sorted(t for _, t, *_ in TEXTS if t in lead and lead[t] >= pipeline.LEAST_MARGIN)
    assert all(abs(x - pipeline.LEAST_MARGIN) > 1e-4 for x in lead.values())
    assert sorted(r["text"] for r in pipeline.identify(spark, d, "").collect()) == want


def test_redaction_stage_equals_masks_of_spans(spark):
    d = docs(spark, TEXTS)
    spans = {r["text"]: r["spans"] for r in pii.with_spans(d).select("text", "spans").collect()}

    def masked(t):
        out, at = "", 0
        for start, no, end, _ in sorted(spans[t]):
            if start >= at:
                out += t[at:start] + f"[{pii.KINDS[no].upper()}]"
            at = max(at, end)
        return out + t[at:]

    got = sorted(r["text"] or "" for r in pipeline.redact(spark, d, "").collect())
    assert got == sorted(masked(t) if t else "" for _, t, *_ in TEXTS)


def test_mixing_stage_equals_its_sql(spark):
    d = docs(spark, unique())
    want = Counter()
    for r in in_sql(d, mixing.ORACLES["op5_mixing"]).fetchall():
        doc_id, _, size, *_, taken = r
        if taken > 0:
            want[doc_id] += -(-taken // size)
    assert Counter(r["doc_id"] for r in pipeline.mix(spark, d, "").collect()) == want
