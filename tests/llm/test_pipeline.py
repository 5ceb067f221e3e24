import re

import pytest
from test_jaccard import brute, shingles
from test_mixing import water
from test_pii import literal

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from fleetpulse.llm.queries import tokenizer_file  # noqa: E402


def test_stages_against_brute_force(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = docs.first()
    odd = [
        (10**6, None, "en", "src1", 1),
        (10**6 + 1, " 12 !", "en", "src1", 1),
        (10**6 + 2, near.text, None, None, near.n_chars),
        (10**6 + 3, near.text.upper(), "en", "src2", near.n_chars),
        (near.doc_id, near.text, near.lang, near.source, near.n_chars),
        (None, "a text without an id that nobody shares", "en", "src1", 1),
        (None, "a text without an id that nobody shares", "en", "src1", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    steps = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], sf).write.parquet(f"{tmp_path}/{i}")
        steps.append(spark.read.parquet(f"{tmp_path}/{i}"))
    given, named, single, clean, mixed, tokens = [s.collect() for s in steps]
    assert [s.columns for s in steps[1:5]] == [docs.columns] * 4

    assert sorted(str((r.doc_id, r.text)) for r in named) == sorted(
        str((r.doc_id, r.text)) for r in given if r.text and re.search(r"[^\W\d_]", r.text)
    )
    assert all(r.lang for r in named)

    rows = [(r.doc_id, r.text) for r in named]
    want = {(component, frozenset(shingles(t)) if component is None else None) for (_, t), (_, _, component) in zip(rows, brute(rows), strict=True)}
    assert len(single) == len(want) < len(named)
    assert {r.doc_id for r in single} == {c for c, _ in want}

    assert len(clean) == len(single)
    before = {r.doc_id: r.text for r in single}
    for r in clean:
        assert r.n_chars == len(r.text)
        for kind, s, e in literal(before[r.doc_id]):
            assert before[r.doc_id][s:e] not in r.text or f"<{kind.upper()}>" in r.text
        if "@" not in before[r.doc_id] and not re.search("[0-9]", before[r.doc_id]):
            assert r.text == before[r.doc_id]

    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, got = {}, {}
    for out, part in ((sizes, clean), (got, mixed)):
        for r in part:
            out[r.source] = out.get(r.source, 0) + count(r.text)
    for source, target in water(sizes).items():
        largest = max(count(r.text) for r in clean if r.source == source)
        assert abs(got.get(source, 0) - target) <= largest
    assert {(r.doc_id, r.text) for r in mixed} <= {(r.doc_id, r.text) for r in clean}

    library = Tokenizer.from_file(tokenizer_file())
    texts = sorted(r.text for r in mixed)
    assert len(tokens) == len(texts) and all(r.exact and r.n_tokens == len(r.ids) for r in tokens)
    assert sorted(r.ids for r in tokens) == sorted(library.encode(t, add_special_tokens=False).ids for t in texts)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).filter("not exact").count() == 0


def test_first_stage_without_languages_and_with_clashing_columns(spark, sf):
    docs = spark.createDataFrame([(1, "some words here", None), (2, "12 !", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, sf).collect()) == [1, 4]
    assert corpus_pipeline.identify_language(spark, docs.limit(0), sf).count() == 0
    given = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1.5D score", "'x' lang_pred", "doc_id mark", "7 nth")
    kept = corpus_pipeline.identify_language(spark, given, sf)
    assert kept.columns == given.columns and kept.filter("score = 1.5 and lang_pred = 'x'").count() == kept.count() > 150
