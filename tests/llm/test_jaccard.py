import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import jaccard
from fleetpulse.llm.common import as_bytes
from fleetpulse.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    tried = set()
    for at in holders.values():
        for x in at:
            for y in at:
                if x < y and (x, y) not in tried:
                    tried.add((x, y))
                    shared = len(sets[x] & sets[y])
                    if 100 * shared >= 80 * len(sets[x] | sets[y]):
                        parent[root(x)] = root(y)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = {r: min((k for k in keys if k is not None), default=None) for r, keys in groups.items()}
    return [(k, len(sets[i]), least[root(i)]) for i, (k, _) in enumerate(rows)]


def check(spark, rows):
    made = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, point int, n int")
    got = [tuple(r) for r in jaccard.linked(made.coalesce(1)).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def edited(draw, words, edits):
    w = list(words)
    for _ in range(edits):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10**6)}"
    return w


def corpus(seed, copies=25):
    draw = random.Random(seed)
    line = lambda n: [f"w{draw.randint(0, 400)}" for _ in range(n)]
    boiler = line(40)
    rows = []
    for i in range(150):
        w = line(draw.randint(3, 160))
        rows.append((i, " ".join(w + (boiler if i % 2 else []))))
        if i % 5 == 0:
            # the threshold itself: edits of shingles around a tenth
            rows += [(1000 + 10 * i + k, " ".join(edited(draw, w, draw.randint(0, 1 + len(w) // 45)))) for k in range(4)]
    base = line(200)
    rows += [(9000 + k, " ".join(edited(draw, base, draw.randint(2, 5)))) for k in range(copies)]
    rows += [(9500 + k, rows[7][1].upper()) for k in range(20)]
    rows += [(1, None), (2, ""), (2, " \n"), (None, "a b"), (None, "a b"), (50_000, "A B"), (50_001, "b a"), (None, "lonely text of some words here")]
    return rows


def test_equals_brute_force(spark):
    check(spark, corpus(1))


def test_split_trees(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "PAGE_ROWS", 7)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 5)
    check(spark, corpus(2, 40))


def test_texts_of_a_large_group_move_a_few_times(spark):
    n = 3000
    stars = [(min(x, h), max(x, h)) for x in range(n) for h in (17, 1800) if x != h]
    dense = [(10_000 + x, 10_000 + y) for x in range(700) for y in range(x) if (x + y) % 3]
    pairs = spark.createDataFrame(sorted(set(stars + dense)), "a long, b long")
    blocks = jaccard._blocks(pairs, components(pairs)).cache()
    assert sorted((r.a, r.b) for r in blocks.select("a", "b").collect()) == sorted(set(stars + dense))
    moved = jaccard._needed(blocks)
    assert moved.filter("point < 10000").count() <= 2.1 * n and moved.filter("point >= 10000").count() <= 2 * 700
    assert moved.groupBy("label", "i", "j").count().agg(F.max("count")).first()[0] <= 2 * jaccard.BLOCK_ROWS


def test_star_round_copies_only_the_middle(spark, monkeypatch):
    n = 300
    monkeypatch.setattr(jaccard, "PAGE_ROWS", 20)
    counts = bytes(jaccard.count_vector(np.arange(40, dtype=np.uint64) << np.uint64(25)))
    points = spark.createDataFrame([(p, 40, 0, counts, 50 if p in (5, 250) else 3) for p in range(n)], "point long, n long, over long, counts binary, degree int")
    members = spark.createDataFrame([(1, p, p) for p in range(n)], "key long, point long, label long")
    got = {(r.a, r.b) for r in jaccard._tree_candidates(members, points, star=True).collect()}
    assert got == {(min(p, h), max(p, h)) for p in range(n) for h in (5, 250) if p != h}


def test_given_documents_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])
    assert jaccard.linked(docs.limit(0)).count() == 0


def test_tree_leaves_out_no_similar_pair():
    draw = np.random.default_rng(4)
    sets = []
    for _ in range(120):
        base = draw.integers(0, 2**63, draw.integers(1, 300)).astype(np.uint64)
        for _ in range(draw.integers(1, 6)):
            keep = base[draw.random(len(base)) > draw.random() * 0.2]
            sets.append(np.unique(np.concatenate([keep, draw.integers(0, 2**63, draw.integers(0, 8)).astype(np.uint64)])))
    sets = [s for s in sets if len(s)]
    base = draw.integers(0, 2**63, 80_000).astype(np.uint64)
    sets += [np.unique(base[draw.random(len(base)) > 0.05]) for _ in range(3)]  # counts beyond 255
    size = np.array([len(s) for s in sets])
    i, j = jaccard.tree_pairs(
        size, np.arange(len(sets)), np.array([jaccard.excess(s) for s in sets]), np.stack([jaccard.count_vector(s) for s in sets])
    )
    found = {frozenset(p) for p in zip(i.tolist(), j.tolist())}
    want = {frozenset((a, b)) for a in range(len(sets)) for b in range(a) if jaccard.similar(sets[a], sets[b])}
    assert want and want <= found and len(found) < 1.5 * len(want) + 20


def test_components(spark):
    draw = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(draw.randint(100, 300), draw.randint(100, 300)) for _ in range(150)] + [(500, 500 + k) for k in range(1, 80)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {label[i] for i in range(61)} == {0} and {label[500 + k] for k in range(80)} == {500}
    assert all(label[a] == label[b] and label[a] <= a for a, b in edges if a != b)


def test_colliding_set_hashes(spark, monkeypatch):
    made = jaccard._profiles

    def few_hashes(*args):
        return made(*args).withColumn("hash", F.when(F.col("n") > 0, F.pmod("hash", F.lit(7)) + 1).otherwise(F.lit(0)))

    monkeypatch.setattr(jaccard, "_profiles", few_hashes)
    check(spark, corpus(3))


def test_one_shingle_is_told_by_its_words():
    raw = [as_bytes(t) for t in ("A b", "a  B", "a b c", "a a a a a", "a a a a a a a", "ab")]
    marks = [jaccard.set_mark(jaccard.shingle_set(r), r) for r in raw]
    assert marks[0] == marks[1] and marks[3] == marks[4] and len(set(marks)) == 4


def test_representatives_of_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long), (1, long + " x"), (1, "quite another text of some words"), (2, long + " y"), (3, ""), (3, None), (3, " "), (None, ""), (None, "lonely"), (None, "lonely")]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, n_shingles int")
    got = [(r.doc_id, r.text) for r in jaccard.representatives(docs).collect()]
    want = [(1, long), (1, "quite another text of some words"), (3, ""), (3, None), (3, " "), (None, ""), (None, "lonely")]
    assert sorted(got, key=str) == sorted(want, key=str)
