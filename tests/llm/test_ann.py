import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import ann


def brute(rows, queries, k):
    size = max((len(v) for _, v in rows), key=[len(v) for _, v in rows].count)
    out = {}
    for q, v in queries:
        best = {}
        for n, x in rows:
            if n != q and len(x) == size:
                best[n] = max(best.get(n, -1e300), float(np.sum(np.array(v) * np.array(x))))
        out[q] = sorted(((-s, n) for n, s in best.items()))[:k]
    return out


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        mine = {n for n, _ in got.get(q, [])}
        hits += len(mine & {n for _, n in best})
        total += len(best)
    return hits / total


def collect(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_given_embeddings(spark, sf):
    df = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None]
    got = collect(ann.nearest(df, F.col("vec_id") % 20 == 0))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], ann.K)
    assert set(got) == set(want) and recall(got, want) >= 0.9
    for q, best in got.items():
        assert len(best) == ann.K and best == sorted(best, key=lambda x: (-x[1], x[0]))
        own = dict(rows)
        assert all(abs(s - float(np.dot(np.array(own[q], float), np.array(own[n], float)))) < 1e-12 for n, s in best)


def test_odd_rows_and_copies(spark):
    draw = np.random.default_rng(3)
    hot = [1.0, 2.0, 0.5, -1.0]
    rows = [(i, draw.normal(size=4).tolist()) for i in range(300)] + [(1000 + i, hot) for i in range(200)]
    odd = [(None, hot), (400, None), (401, []), (402, [0.0] * 4), (403, [1.0, None, 2.0, 1.0]), (404, [float("nan"), 1.0, 1.0, 1.0]), (405, [float("inf"), 1.0, 1.0, 1.0]), (420, [9.0, 9.0])]
    twice = [(20, hot), (21, rows[21][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + odd + twice], "vec_id long, embedding array<double>, rank int, score int")
    got = collect(ann.nearest(df.repartition(5), F.col("vec_id") % 20 == 0, share=9.0))
    good = rows + twice
    want = brute(good, [r for r in rows if r[0] % 20 == 0 and r[0] != 20], ann.K)
    for q, best in want.items():
        assert [n for n, _ in got[q]] == [n for _, n in best], q
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in best])
    assert set(got) == set(want) | {20} and len(got[20]) == ann.K
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert [n for n, _ in collect(ann.nearest(few, F.col("vec_id") == 0))[0]] in ([1, 2], [2, 1])
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_float_vectors_of_one_kind(spark):
    df = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    got = collect(ann.nearest(df, F.col("vec_id") % 20 == 0))
    assert [n for n, _ in got[0]] == list(range(1, 21)) and [n for n, _ in got[20]] == list(range(20))


def test_many_ties_at_the_border(spark):
    draw = np.random.default_rng(6)
    rows = [(0, [1.0] + [0.0] * 9)] + [(int(n), [1.0, *draw.normal(size=9).tolist()]) for n in draw.permutation(np.arange(1, 2001))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collect(ann.nearest(df, F.col("vec_id") == 0, share=9.0))
    assert [n for n, _ in got[0]] == [n for _, n in brute(rows, rows[:1], ann.K)[0]]
