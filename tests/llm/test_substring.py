import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import common, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    for (key, _), w in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        yield key, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)


def check(spark, rows, window=substring.WINDOW):
    made = spark.createDataFrame([(k, t, 1, "clash") for k, t in rows], "doc_id long, text string, at int, spans string")
    got = [tuple(r) for r in substring.without_repeats(made.repartition(5), window=window).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, window), key=str)
    return got


def test_word_hashes():
    raw = common.as_bytes(" the  cat\tthe " + "x" * 600_000 + " é\u0085é the " + "x" * 600_000 + "\n")
    h = common.word_hashes(raw, *common.word_bounds(raw))
    assert [len(set(h[list(i)])) for i in ((0, 2, 5), (3, 6), (0, 1, 3, 4))] == [1, 1, 4]
    assert len(h) == 7
    many = common.as_bytes(" ".join(map(str, range(200_000))))
    assert len(np.unique(common.word_hashes(many, *common.word_bounds(many)))) == 200_000


def test_equals_brute_force(spark):
    draw = random.Random(7)
    word = lambda: f"w{draw.randint(0, 3000)}"
    line = lambda n: [word() for _ in range(n)]
    passages = [line(draw.randint(30, 90)) for _ in range(12)]
    rows = []
    for i in range(250):
        w = line(draw.randint(0, 150))
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            a = draw.randint(0, 20)
            at = draw.randint(0, len(w))
            w[at:at] = p[a : draw.randint(a, len(p))]
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(w)))
    rows += [(1000, None), (1001, ""), (1002, "of " * 400), (1003, "a b " * 17 + "c"), (1004, "a b " * 18), (None, " ".join(line(60)))]
    rows += [(3, rows[3][1]), (2000, rows[3][1]), (2001, rows[60][1] + " tail"), (2002, rows[4][1]), (2003, " ".join(passages[0])), (2003, " ".join(passages[0]))]
    got = check(spark, rows)
    assert sum(r[2] for r in got) > 2000
    check(spark, rows[:120], 22)


def test_short_quotes_of_aligned_near_copies(spark):
    draw = random.Random(11)
    line = lambda n: [f"w{draw.randint(0, 10**6)}" for _ in range(n)]
    for quoted in (35, 45, 54, 80, 150):
        p = line(300)
        rows = [(0, " ".join(line(30) + p[100 : 100 + quoted] + line(40)))]
        rows += [(i, " ".join([f"x{i}", *p[1:]])) for i in (1, 2)]
        got = check(spark, rows)
        assert {r[0]: r[2] for r in got} == {0: quoted, 1: 299, 2: 299}
    rows = []
    for i in range(10):
        base = line(600)
        for j in range(3):
            w = list(base)
            w[draw.randrange(600)] = "changed"
            rows.append((10 * i + j, " ".join(w)))
    check(spark, rows)


def test_given_documents_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])
    assert substring.without_repeats(docs.limit(0)).count() == 0


def test_colliding_text_hashes(spark, monkeypatch):
    monkeypatch.setattr(substring, "_short_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(5)))
    draw = random.Random(5)
    line = lambda n: [f"w{draw.randint(0, 10**6)}" for _ in range(n)]
    p = line(70)
    rows = [(i, " ".join(line(50) + (p if i % 3 == 0 else []))) for i in range(60)]
    check(spark, rows + [(100, rows[5][1]), (101, None), (102, None)])


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(common.Bitmap, "BITS", 7)
    monkeypatch.setattr(common.Bitmap, "MOST", 7)
    draw = random.Random(8)
    line = lambda n: [f"w{draw.randint(0, 10**6)}" for _ in range(n)]
    p = [line(60) for _ in range(30)]
    check(spark, [(i, " ".join(line(50) + p[i % 30][i % 7 :] + line(9))) for i in range(90)])


def test_bitmap_grows_with_the_count(spark):
    assert [common.Bitmap.bits_for(n) for n in (0, 2_000_000, 3_000_000, 20_000_000, 10**9)] == [25, 25, 26, 28, 28]
    keys = spark.range(4_000_000).select(F.xxhash64("id").alias("h"))
    bitmap = common.Bitmap.of("h", keys)
    assert 64 * len(bitmap) == 1 << 26
    some = keys.limit(20_000).toPandas()["h"].to_numpy().view(np.uint64)
    assert common.Bitmap.has(bitmap, some).all() and common.Bitmap.has(bitmap, common.mixed(some + np.uint64(1))).mean() < 0.02


def test_told_apart(spark):
    rows = spark.range(200).select(F.expr("id % 50 % 3").alias("key"), F.expr("id % 50").alias("mark"))
    out = rows.select(common.told_apart(rows, F.col("key"), F.col("mark")).alias("k"), "mark").distinct().collect()
    assert len(out) == 50 and len({r.k for r in out}) == 50
