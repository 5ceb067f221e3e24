import random
import re

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def literal(text):
    """The fixed patterns as they are written."""
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else None,
                "card": 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": 10 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), order, kind, m.end()))
    return [(k, s, e) for s, _, k, e in sorted(out)]


def test_base_spans_are_the_patterns():
    draw = random.Random(8)
    pieces = ["@", ".", "a", "b.c", "é", "-", " ", "1", "255", "256", "0007", "+", "(", ")", "4799134681044206", "4111 1111-1111 1111", "10.0.0.1", "x@y.z", "+1 (319) 555-5132", "٣", "a@b@c.d", "\n", "%+"]
    hits = 0
    for _ in range(30_000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 14)))
        want = literal(text)
        hits += len(want)
        assert pii.base_spans(text) == want, repr(text)
    assert hits > 5000
    for long in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+1 " * 100_000, "a@" * 100_000, "9-" * 150_000):
        pii.base_spans(long)
        list(pii.candidates(long, []))


def test_reliabilities_are_recovered():
    draw = np.random.default_rng(5)
    truth = draw.random(20_000) < 0.3
    good = [0.95, 0.9, 0.85, 0.9, 0.7]
    votes = np.stack([np.where(draw.random(len(truth)) < 0.2, 2, np.where(draw.random(len(truth)) < g, truth, ~truth)) for g in good], axis=1)
    patterns, counts = np.unique([pii.pattern_of(tuple(v)) for v in votes.tolist()], return_counts=True)
    reliability, prior, p = pii.estimate(np.array([pii.votes_of(x) for x in patterns.tolist()]), counts.astype(float))
    assert abs(prior - 0.3) < 0.03
    for i, g in enumerate(good):
        assert abs(reliability[i, 1, 1] / (1 - reliability[i, 1, 2]) - g) < 0.05
    back = dict(zip(patterns.tolist(), p, strict=True))
    called = np.array([back[pii.pattern_of(tuple(v))] > 0.5 for v in votes.tolist()])
    assert np.mean(called == truth) > 0.95


def test_labelers_propose_spans():
    key = "aB3" * 50
    cases = {
        f"x {key} y": key,
        'password = "hunter2" y': "hunter2",
        "pwd=correcthorse y": "correcthorse",
        'secret: "p w/ö+." y': "p w/ö+.",
        "k wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY y": "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
        "t eyJhbGciOi1.eyJzdWIiOiIx+a=.SflKxwRJSM. y": "eyJhbGciOi1.eyJzdWIiOiIx+a=.SflKxwRJSM",
        "n AbcdEfghIjklMnopQrst y": "AbcdEfghIjklMnopQrst",
        "call (319) 555-5132 now": "(319) 555-5132",
        "iban DE89 3704 0044 0532 0130 00 y": "DE89 3704 0044 0532 0130 00",
    }
    for text, want in cases.items():
        assert want in [text[s:e] for s, e in pii.candidates(text, [])], text
    for text in ("a word internationalization y", "in 1999 or 2024", "see 10.5 and 1,000,000"):
        assert not list(pii.candidates(text, [])), text


def test_proposed_keys_are_decided(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    keys = ["aB3x" * 40, "hunter2x", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEX4MPLEKEY"]
    rows = [(10**6 + i, f'note password="{k}" y') for i, k in enumerate(keys)]
    docs = docs.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in pii.redacted(docs, pii.train(docs)).filter("doc_id >= 1000000").collect()}
    assert set(got.values()) == {'note password="<SECRET>" y'}


def test_given_documents_and_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    extra = [(None, "mail a.b@c.de"), (90_001, None), (90_001, ""), (90_002, 'x password="a8f3c0de77b1aa90" y'), (90_003, "Donaudampfschifffahrtsgesellschaft2 https://x.y/abcdefghij0123456789abcd " * 2), (90_004, "word " * 40_000 + "+1 (319) 555-5132")]
    docs = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("base", F.lit(1))
    model = pii.train(docs)
    rows = pii.detected(docs, model, ["doc_id"]).join(docs.select("doc_id", "text"), "doc_id").collect()
    secret = 0
    for r in rows:
        text = r.text or ""
        if r.doc_id != 90_001:
            assert [tuple(s) for s in r.base] == literal(text)
            assert [s for s in r.spans if s.kind in pii.BASE_KINDS] == r.base
            said = {text[s.start : s.end] for s in r.spans if s.kind == "secret"}
            secret += len(said)
            assert all(x in said for x in re.findall(r"AKIA[0-9A-Z]{12,}|(?<=password=)[0-9a-f]{16,}", text))
    assert secret > 0
    by = {r.doc_id: r for r in rows}
    assert [s.kind for s in by[90_002].spans] == ["secret"] and not by[90_003].spans
    assert pii.detected(docs, model, ["doc_id"]).count() == docs.count()
    clean = {r.doc_id: r.text for r in pii.redacted(docs.drop("base"), model).collect()}
    assert clean[None] == "mail <EMAIL>" and clean[90_004].endswith("word <PHONE>") and clean[90_002] == 'x password="<SECRET>" y'
    assert pii.train(docs.limit(0)) is None and pii.detected(docs.limit(0), None, ["doc_id"]).count() == 0
