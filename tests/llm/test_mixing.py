import re

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import mixing


def water(sizes, weights=mixing.WEIGHTS, cap=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def check(df):
    out = mixing.mix(df).collect()
    assert len(out) == df.count()
    sizes = {}
    for r in df.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = water(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        largest = max(r.size for r in mine)
        assert mine[0].source_size == sizes[s] and abs(mine[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert all(0 <= r.copies <= 3 for r in mine)
        assert abs(sum(r.copies * r.size for r in mine) - want[s]) <= largest, s
    return out


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = check(docs)
    again = mixing.mix(docs.repartition(9)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_hot_source_and_odd_rows(spark):
    draw = np.random.default_rng(1)
    rows = [(i, "w " * int(draw.pareto(1.2) * 20 + 1), "hot" if i % 3 else f"s{i % 11}", 1) for i in range(4000)]
    rows += [(None, None, None, 1), (None, "a b", None, 1), (5, "", "zero", 1), (77, "x y z", "hot", 1)] + [(77, "x y z", "hot", 1)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    check(df)
    assert mixing.mix(df.limit(0)).count() == 0
    none = mixing.mix(df.filter("source = 'zero'")).first()
    assert (none.target, none.size) == (0.0, 0)


def test_flight_keeps_totals():
    draw = np.random.default_rng(2)
    p, size = draw.random(400), draw.integers(1, 3000, 400).astype(float)
    q = mixing.flight(p, size, draw.random(len(p)))
    assert np.sum((q > 1e-9) & (q < 1 - 1e-9)) <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-3
    expected = np.mean([mixing.flight(np.full(30, 0.3), size[:30], draw.random(30)) for _ in range(3000)], axis=0)
    assert np.all(np.abs(expected - 0.3) < 0.05)
