import random
import re
from collections import defaultdict

import numpy as np

from fleetpulse.llm import minmax

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and root(i) != root(j):
                shared = len(a & b)
                if 100 * shared >= 85 * (len(a) + len(b) - shared):
                    parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        groups[root(i)].append(key)
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return [(k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)]


def check(spark, rows):
    made = spark.createDataFrame([(k, t, 1, 2, "x") for k, t in rows], "doc_id long, text string, point int, row int, signature string")
    got = [tuple(r) for r in minmax.linked(made.repartition(4)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def edited(draw, words, edits):
    w = list(words)
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
    return w


def corpus(seed, copies=40):
    draw = random.Random(seed)
    line = lambda n: [f"w{draw.randint(0, 400)}" for _ in range(n)]
    boiler = line(40)
    rows = []
    for i in range(150):
        w = line(draw.randint(3, 160))
        rows.append((i, " ".join(w + (boiler if i % 2 else []))))
        if i % 5 == 0:  # the threshold itself
            rows += [(1000 + 10 * i + k, " ".join(edited(draw, w, draw.randint(0, 1 + len(w) // 35)))) for k in range(4)]
    base = line(200)
    rows += [(9000 + k, " ".join(edited(draw, base, draw.randint(2, 7)))) for k in range(copies)]
    w = line(120)
    for k in range(60):  # a chain whose ends are far apart
        rows.append((7000 + k, " ".join(w)))
        w = edited(draw, w, 2)
    rows += [(9500 + k, rows[7][1].upper()) for k in range(20)]
    rows += [(1, None), (2, ""), (2, " \n"), (None, "a b"), (None, "a b"), (50_000, "A B"), (50_001, "b a"), (None, "lonely text of some words here")]
    return rows


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_small_pages(spark, monkeypatch):
    monkeypatch.setattr(minmax, "PAGE_ROWS", 5)
    monkeypatch.setattr(minmax, "HUB_ROWS", 3)
    check(spark, corpus(2, 90))


def test_given_documents_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])
    assert minmax.linked(docs.limit(0)).count() == 0


def test_estimate_and_bands():
    draw = np.random.default_rng(5)
    errors, missed = [], 0
    for _ in range(200):
        whole = np.unique(draw.integers(0, 2**63, 400).astype(np.uint64))
        a, b = whole[: draw.integers(370, 390)], whole[draw.integers(10, 25) :]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = minmax.signature(a), minmax.signature(b)
        errors.append(float(minmax.estimate(x, y)) - true)
        if 100 * len(np.intersect1d(a, b)) >= minmax.PERCENT * len(np.union1d(a, b)):
            missed += not np.any(minmax.band_keys(x[None]) == minmax.band_keys(y[None]))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03 and missed == 0


def test_pairs_with_one_hub(spark):
    draw = random.Random(9)
    base = [f"w{draw.randint(0, 900)}" for _ in range(150)]
    made = [(k, " ".join(edited(draw, base, 1))) for k in range(300)]
    held = spark.createDataFrame(made, "point long, text string")
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 300)], "a long, b long")
    found = minmax._confirmed(pairs, held).collect()
    assert len(found) == sum(minmax.similar(*(minmax.shingle_set(np.frombuffer(made[k][1].encode(), np.uint8)) for k in (0, i))) for i in range(1, 300))


def test_slots_bound_what_sets_share():
    draw = np.random.default_rng(8)
    for _ in range(200):
        whole = np.unique(draw.integers(0, 2**63, draw.integers(1, 600)).astype(np.uint64))
        sets = [whole[draw.random(len(whole)) < draw.uniform(0.3, 1)] for _ in range(2)]
        a, b = (s if len(s) else whole for s in sets)
        most = minmax.most_shared(minmax.slots(a), len(a), minmax.slots(b)[None], np.array([len(b)]))[0]
        shared = len(np.intersect1d(a, b))
        assert shared <= most <= shared + 3 + len(whole) // 8
