import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm import toxicity
from fleetpulse.llm.common import learn_row


def made(spark, seed=1, n=600):
    draw = random.Random(seed)
    bad = ["scum", "idiote", "Müll", "trash"]
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        w = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(20, 80))]
        for _ in range(draw.randint(3, 6) * toxic):
            w[draw.randrange(len(w))] = draw.choice(bad)
        rows.append((i, " ".join(w), 9))
        labels.append((i, toxic))
    rows += [(n, None, 9), (n + 1, "", 9), (n + 2, "?!", 9), (None, "scum trash idiote", 9), (5, rows[5][1], 9), (n + 3, "scum " * 30_000, 9)]
    labels += [(n + 3, None), (0, 0), (10**9, 1), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("common", [1, 6, 32])
def test_search_is_exact(spark, monkeypatch, common):
    monkeypatch.setattr(toxicity, "_COMMON", common)
    docs, labels = made(spark)
    index = toxicity.train(docs, labels, learn_row(F.col("doc_id"), 5, 0), per_class=90)
    flat = index.postings.transpose(0, 2, 1).reshape(-1, len(index.terms))
    for r in docs.limit(80).collect():
        at, weight, share = index.query(*toxicity.term_counts(r.text))
        found, cosine = index.nearest(at, weight, 10)
        all_ = flat[:, at] @ weight if len(at) else np.zeros(len(flat))
        all_[index.labels.reshape(-1) < 0] = 0
        want = np.sort(all_[all_ > 0])[::-1][:10]
        assert np.allclose(cosine, want, atol=1e-5) and share >= 0
        assert np.allclose(all_[found], cosine, atol=1e-5)


def test_held_out(spark):
    docs, labels = made(spark, n=1500)
    index = toxicity.train(docs, labels, learn_row(F.col("doc_id"), 5, 0))
    rows = toxicity.scored(docs, index, ["doc_id"]).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    ones, zeros = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    assert np.mean(np.array(ones) >= 0.5) > 0.95 and np.mean(np.array(zeros) >= 0.5) < 0.02


def test_many_rare_insults(spark):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(1500):
        toxic = int(i % 5 == 0)
        w = [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(20, 60))]
        for _ in range(6 * toxic):
            w.insert(draw.randrange(len(w)), f"insult{draw.randint(0, 700)}")
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.train(docs, labels, learn_row(F.col("doc_id"), 5, 0))
    learned = [t for i, t in rows if i in set(index.ids.tolist())]
    assert set(index.terms.tolist()) == {h for t in learned for h in toxicity.term_counts(t)[0].tolist()}
    rows = toxicity.scored(docs, index, ["doc_id"]).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 5 = 0").collect()
    ones, zeros = ([r.score for r in rows if r.toxic == y] for y in (1, 0))
    assert np.mean(np.array(ones) >= 0.5) > 0.8 and np.mean(np.array(zeros) >= 0.5) < 0.05


def test_odd_rows(spark):
    docs, labels = made(spark)
    learn = learn_row(F.col("doc_id"), 5, 0)
    got = toxicity.scored(docs, toxicity.train(docs, labels, learn), ["doc_id"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[600].score == by[601].score == by[602].score and 0.1 < by[600].score < 0.25
    assert by[None].score > 0.5 and by[603].score > 0.5
    for some in (labels.filter("toxic = 0"), labels.limit(0)):
        index = toxicity.train(docs, some, learn)
        assert {r.score for r in toxicity.scored(docs, index, ["doc_id"]).collect()} == {0.0}
    assert toxicity.scored(docs.limit(0), toxicity.train(docs.limit(0), labels, learn), ["doc_id"]).count() == 0
    again = toxicity.train(docs.repartition(7), labels.repartition(3), learn)
    assert np.array_equal(again.curve, toxicity.train(docs, labels, learn).curve)


def test_repeated_ids_stay_within_the_bound(spark):
    docs, labels = made(spark)
    many = spark.range(500).selectExpr("7L doc_id", "concat('scum number ', id) text", "1 score")
    learn = learn_row(F.col("doc_id"), 5, 0)
    index = toxicity.train(docs.unionByName(many), labels, learn, per_class=40)
    assert (index.labels >= 0).sum() <= 80 and index.ids.tolist().count(7) <= 1
    assert len(toxicity.train(docs.unionByName(many), labels, learn).ids) == len(set(index.ids.tolist()) | set(toxicity.train(docs, labels, learn).ids.tolist()))


def test_common_terms_as_rows_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_COMMON", 6)
    docs, labels = made(spark)
    index = toxicity.train(docs, labels, learn_row(F.col("doc_id"), 5, 0))
    texts = [r.text for r in docs.limit(60).collect()]
    queries = [index.query(*toxicity.term_counts(t))[:2] for t in texts]
    assert 0 < len(index.rows) < len(index.terms)
    alone = [index.nearest(*q, 7) for q in queries]
    together = [index.nearest(*q, 7, summed=s) for q, s in zip(queries, index.summed(queries))]
    assert all(np.allclose(a[1], b[1], atol=1e-6) for a, b in zip(alone, together))


def test_score_is_the_vote_of_the_nearest(spark):
    """Scores again by plain dictionaries; only the calibration curve and the pseudo-vote are taken over."""
    docs, labels = made(spark)
    index = toxicity.train(docs, labels, learn_row(F.col("doc_id"), 5, 0), k=9)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    bags = [dict(zip(*(x.tolist() for x in toxicity.term_counts(t)))) for _, t in rows]
    label = {i: int(y) for i, y in zip(index.ids.tolist(), index.labels.reshape(-1)) if y >= 0}
    at = {i: n for n, (i, _) in enumerate(rows)}
    examples = [(bags[at[i]], y) for i, y in label.items()]
    ones = sum(label.values())
    share = ones / len(label)
    idf, relevance = {}, {}
    for t in set().union(*(b for b, _ in examples)):
        idf[t] = np.log((1 + len(rows)) / (1 + sum(t in b for b in bags))) + 1e-3
        x, y = np.array([t in b for b, _ in examples], float), np.array([y for _, y in examples], float)
        relevance[t] = np.corrcoef(x, y)[0, 1] ** 2 if x.std() else 0.0

    def vector(bag, weigh):
        return {t: (1 + np.log(n)) * idf[t] * weigh(t) for t, n in bag.items() if t in idf}

    def length(v):
        return np.sqrt(sum(w * w for w in v.values()))

    vectors = [(vector(b, relevance.get), y) for b, y in examples]
    got = toxicity.scored(docs, index, ["doc_id", "text"], k=9).collect()
    want = {}
    for (i, text), bag in list(zip(rows, bags))[:150] + list(zip(rows, bags))[-6:]:
        q, plain = vector(bag, relevance.get), length(vector(bag, lambda t: 1.0))
        if not length(q):
            want[text] = index.prior
            continue
        near = [(sum(q[t] * v[t] for t in q if t in v) / length(q) / max(length(v), 1e-12), y) for v, y in vectors]
        near = sorted((c for c in near if c[0] > 0), reverse=True)[:9]
        weight = [c * length(q) / plain for c, _ in near]
        vote = (sum(w * y for w, (_, y) in zip(weight, near)) + 9 * index.doubt * share) / (sum(weight) + 9 * index.doubt)
        want[text] = 1 / (1 + np.exp(-(vote * index.curve[0] + index.curve[1]))) if near else index.prior
    checked = [(r.score, want[r.text]) for r in got if r.text in want]
    assert len(checked) >= 150 and np.allclose(*zip(*checked), atol=1e-3)
