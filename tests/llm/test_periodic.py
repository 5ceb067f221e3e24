import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from fleetpulse.llm import periodic
from fleetpulse.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=12):
    """All runs as (start, length, period), straight from the definition."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def without(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def given(seed):
    draw = random.Random(seed)
    line = lambda n, v: [f"w{draw.randint(0, v)}" for _ in range(n)]
    rows = []
    for i in range(150):
        w = line(draw.randint(0, 200), draw.choice([1, 2, 30, 3000]))
        for _ in range(draw.randint(0, 3)):
            p = line(draw.randint(1, 60), draw.choice([1, 5, 3000]))
            part = (p * 8)[: draw.randint(1, len(p) * draw.randint(2, 6))]
            at = draw.randint(0, len(w))
            w[at:at] = part
        rows.append((i, draw.choice([" ", "\n", "\t "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "a"), (904, "a " * 11), (905, "a " * 12), (906, "a b " * 6), (907, "a b c d e f " * 2)]
    rows += [(908, "x " * 5000), (909, "x y z " * 700 + "end " + "x y z " * 700), (None, "n " * 30), (None, "n " * 30), (3, rows[3][1]), (910, "É é " * 9)]
    a, b = "a", "b"
    for _ in range(15):  # a word of Fibonacci has many runs
        a, b = b, a + b
    rows.append((911, " ".join(b[:1500])))
    return rows


@pytest.mark.parametrize("base", [11, 2])
def test_equals_brute_force(spark, monkeypatch, base):
    monkeypatch.setattr(periodic, "BASE_OCTAVES", base)
    rows = given(base)
    made = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, row string, period int")
    got = periodic.collapsed(made.repartition(5)).collect()
    want = []
    for k, t in rows:
        words = WORD.findall(t or "")
        runs = brute(words)
        want.append((k, len(words), runs, " ".join(without(words, runs))))
    mine = [(r.doc_id, r.n_words, [(x.start, x.length, x.period) for x in r.runs], r.collapsed) for r in got]
    assert sorted(mine, key=str) == sorted(want, key=str)
    assert sum(len(w[2]) for w in want) > 500
    digests = {(r.doc_id, r.collapsed) for r in periodic.collapsed(made, digest=True).collect()}
    assert digests == {(k, hashlib.sha256(t.encode()).hexdigest()) for k, _, _, t in want}


def test_tiles_hold_all_runs():
    draw = random.Random(3)
    for trial in range(150):
        words = [draw.randint(0, draw.choice([1, 1, 2, 20])) for _ in range(draw.randint(2, 120))]
        least = draw.choice([1, 5, 12])
        p = draw.randint(1, 20)
        words += [words[-1 - (i % p) % len(words)] for i in range(draw.randint(0, 60))]
        pieces = {}
        for _, first, part, octaves, at in periodic.tiles(np.array(words), least, draw.randint(1, 6)):
            for q, low, high in periodic.tile_pieces(first, part, octaves, at, least):
                pieces.setdefault(q, []).append((low, high))
        for s, n, q in brute(words, least):
            held = {i for low, high in pieces.get(q, []) for i in range(low, high)}
            assert set(range(s, s + n - q)) <= held, (trial, s, n, q)


def test_other_limits_and_empty(spark):
    made = spark.createDataFrame([(1, "a b a b c c")], "doc_id long, text string")
    [row] = periodic.collapsed(made, min_words=2).collect()
    assert [(r.start, r.length, r.period) for r in row.runs] == [(0, 4, 2), (4, 2, 1)] and row.collapsed == "a b c"
    assert periodic.collapsed(made.limit(0)).count() == 0


def test_query(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").join(op11_periodic_runs(spark, sf), "doc_id").collect():
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        if n > 6000:  # the definition takes quadratic time
            continue
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(without(words, runs)).encode()).hexdigest()
