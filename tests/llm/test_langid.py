import zlib

import numpy as np
from pyspark.sql import functions as F

from fleetpulse.llm import langid
from fleetpulse.llm.common import learn_row


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.train(docs, learn_row(F.col("doc_id"), 4, 2))
    rows = langid.predicted(docs, model, ["doc_id", "lang"]).filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    again = langid.train(docs.repartition(5), learn_row(F.col("doc_id"), 4, 2))
    assert np.array_equal(again.weights, model.weights)


def test_kernel_is_the_share_of_common_ngrams():
    texts = ["abc abd", "abd x", "été"]
    grams = np.zeros((3, langid.FEATURES), np.float32)
    for i, t in enumerate(texts):
        langid.ngram_set(t, grams[i])
    own = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    assert grams.sum(axis=1).tolist() == [len(s) for s in own]
    assert grams[0] @ grams[1] == len(own[0] & own[1])


def test_odd_rows(spark):
    rows = [(i, ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 3, "en" if i % 2 else "fr", 1) for i in range(60)]
    rows += [(100, None, "en", 1), (101, "", None, 1), (102, " 123 !?", "en", 1), (None, "the mat the cat", "en", 1), (3, "THE CAT", None, 1), (3, "THE CAT", None, 1), (104, "the cat " * 50_000, "xx", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(docs, learn_row(F.col("doc_id"), 4, 2), per_language=20)
    got = langid.predicted(docs, model, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [(by[i].lang_pred, by[i].score) for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert by[3].lang_pred in ("en", "xx") and by[None].lang_pred in ("en", "xx")
    learned = {r[2] for r in rows if r[2] and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2}
    assert set(model.languages) == learned
    none = langid.train(docs, F.lit(False))
    assert none is None and langid.predicted(docs, none, ["doc_id"]).filter("lang_pred != 'und'").count() == 0
    assert langid.predicted(docs.limit(0), model, ["doc_id"]).count() == 0


def test_repeated_ids_stay_within_the_bound(spark, monkeypatch):
    docs = spark.range(300).selectExpr("id % 3 doc_id", "concat('some words ', id % 40) text", "'en' lang")
    sizes = []
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda grams, langs: sizes.append(len(langs)) or fit(grams, langs))
    langid.train(docs, F.lit(True), per_language=25)
    langid.train(docs, F.lit(True), per_language=1000)
    assert sizes == [25, 120]


def _grams(texts):
    grams = np.zeros((len(texts), langid.FEATURES), np.float32)
    for i, t in enumerate(texts):
        langid.ngram_set(t, grams[i])
    return grams


def test_equals_a_direct_kernel_ridge():
    draw = np.random.default_rng(3)
    words = {"en": "the cat sat on a mat".split(), "fr": "le chat est sur la table".split(), "de": "die katze sitzt auf dem tisch".split()}
    sample = lambda n: [(k, " ".join(draw.choice(words[k], 4))) for k in words for _ in range(n + len(k) * (k == "en"))]
    learn, other = sample(9), sample(5)
    model = langid.fit(_grams([t for _, t in learn]), [k for k, _ in learn], landmarks=len(learn))
    sets = lambda rows: [set(np.flatnonzero(g).tolist()) for g in _grams([t for _, t in rows])]
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    langs = sorted(words)
    y = np.array([[1.0 if k == c else -1.0 for c in langs] for k, _ in learn])
    count = np.array([sum(k == l for l, _ in learn) for k, _ in learn])
    dual = np.linalg.solve(kernel(sets(learn), sets(learn)) + langid.RIDGE * np.diag(count), y)
    raw = np.clip((kernel(sets(other), sets(learn)) @ dual + 1) / 2, 1e-3, 1)
    want = raw / raw.sum(axis=1, keepdims=True)
    got = model.scores(_grams([t for _, t in other]))
    assert np.abs(got - want).max() < 5e-3 and [langs[i] for i in got.argmax(axis=1)] == [k for k, _ in other]


def test_more_languages_than_landmarks():
    draw = np.random.default_rng(4)
    alphabet = [chr(0x4E00 + i) for i in range(3000)]
    langs = [f"l{i:03}" for i in range(150) for _ in range(4)]
    texts = ["".join(draw.choice(alphabet[20 * int(x[1:]) : 20 * int(x[1:]) + 20], 30)) for x in langs]
    model = langid.fit(_grams(texts), langs)
    assert model.landmarks.shape[1] == 150
    best = model.scores(_grams(texts)).argmax(axis=1)
    assert np.mean([model.languages[b] == x for b, x in zip(best, langs, strict=True)]) > 0.97
