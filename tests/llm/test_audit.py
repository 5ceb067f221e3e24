import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, top=200):
    counts, spread, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall((text or "").translate(_LOWER))
        sources[lang].add(source)
        counts[lang, source].update(words)
        spread[lang].update(set(words))
    out = []
    for lang in sources:
        kept = [t for t, n in spread[lang].items() if n >= 3]
        whole = Counter()
        for s in sources[lang]:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources[lang]}
        q = shares(whole)
        for s in sources[lang]:
            far = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in sources[lang] if o != s]
            high = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", far, None), ("term", high, top)):
                out += [(lang, s, part, o.decode(), -v, i + 1) for i, (v, o) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def given(seed):
    draw = random.Random(seed)
    vocabulary = [f"{'É' if i % 7 == 0 else 'w'}{chr(97 + i % 26) * (1 + i // 26 % 9)}é" for i in range(200)]
    rows = []
    for _ in range(400):
        source = f"s{min(draw.randint(0, 40), draw.randint(0, 40))}"
        words = [vocabulary[min(draw.randint(0, 199), draw.randint(0, 199))] for _ in range(draw.randint(0, 40))]
        rows.append((draw.choice(["en", "xx", "xx", None]), source, draw.choice([" ", "7", "_-"]).join(words)))
    rows += [("zz", "a", "alone"), ("zz", "b", None), ("zz", None, ""), ("en", "only here", "123 4"), (None, None, None)]
    rows += [("big", f"h{i % 3}", "The the KK İ naïve " * 50) for i in range(30)]
    return rows


@pytest.mark.parametrize("shape", [(2048, 256, 200), (16, 8, 5)])
def test_equals_brute_force(spark, monkeypatch, shape):
    for name, value in zip(("BLOCK_TERMS", "GROUP_ROWS", "TOP_TERMS"), shape, strict=True):
        monkeypatch.setattr(audit, name, value)
    monkeypatch.setattr(audit, "_HELD", 40)
    rows = given(shape[0])
    made = spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], "n int, term int, lang string, source string, text string")
    got = sorted(tuple(r) for r in audit.audited(made.repartition(6)).collect())
    assert got == brute(rows, shape[2])
    assert audit.audited(made.limit(0)).count() == 0


def test_quadtree_leaves_uniform_quadrants_out():
    draw = np.random.default_rng(2)
    rows, cols = 40, 300
    count = np.where(draw.random((rows, cols)) < 0.02, draw.integers(1, 9, (rows, cols)), 0)
    base = draw.integers(1, 50, rows)
    p = base[:, None] + count
    r, c = np.nonzero(count)
    tree = audit.Quadtree(r, c, p[r, c], base, 6)
    ahead, back, seen = audit.joint_pairs(tree, tree)
    for s in range(rows):
        for t in range(s, rows):
            either = (count[s] > 0) | (count[t] > 0)
            assert seen[s, t] == either.sum()
            assert ahead[s, t] == ((p[s] - p[t]) ** 2 // p[t])[either].sum()
            assert back[s, t] == ((p[s] - p[t]) ** 2 // p[s])[either].sum()
    assert len(tree.levels[-1]) < rows * cols / audit.LEAF**2


def test_shares_of_huge_counts(spark):
    n, words, terms = 9 * 10**14, 3 * 10**15, 12_345
    df = spark.createDataFrame([(n, words, terms)], "n long, words long, terms long")
    assert df.select(audit.share(F.col("n"), F.col("words"), F.col("terms"))).first()[0] == 1 + 10**9 * (n + 1) // (words + terms)
