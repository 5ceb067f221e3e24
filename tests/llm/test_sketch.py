import hashlib
import re

from pyspark.sql import functions as F

from fleetpulse.llm import sketch

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = SPACE.findall(text or "")
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if len(w) >= 5 else {tuple(w)}


def expected(rows):
    """Brute force over (doc_id, text): successor and edited text of every row."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (key, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        yield key, text, text[: len(text) - cut] + following[:cut], following


def test_edited_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(10**15, None), (10**15 + 1, ""), (10**15 + 2, "😀 é " * 300), (None, "null id comes first"), (-5, "one two three four five six")]
    made = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, sketch string, __next int")
    got = {r.doc_id: r for r in sketch.edited_fingerprints(made.repartition(7)).collect()}
    assert len(got) == len(rows)
    for key, text, edited, following in expected(rows):
        r = got[key]
        assert (r.text, r.edited) == (text, edited)
        a, e, n = shingles(text), shingles(edited), shingles(following)
        assert len(r.sketch) == min(len(a), sketch.K) and sorted(set(r.sketch)) == r.sketch
        for mine, theirs in ((e, r.edited_sketch), (n, r.next_sketch)):
            if len(a | mine) <= sketch.K and a | mine:
                assert len(set(theirs) & set(r.sketch)) == len(a & mine)


def test_many_rows_of_one_id(spark):
    rows = [(7, f"text number {i} of the id") for i in range(300)] + [(i, f"other {i}") for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    dealt = sketch.by_next(made)
    assert dealt.filter("not __guard").count() == 360
    assert dealt.filter("doc_id = 7").select("__bucket").distinct().count() > 3
    assert sketch.edited_fingerprints(made).count() == 360
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert sketch.edited_fingerprints(one).first().edited == "a b c d e f a b"
    assert sketch.edited_fingerprints(one.limit(0)).count() == 0


def test_estimates(spark):
    text = [" ".join(hashlib.md5(f"{i}".encode()).hexdigest()[:6] for i in range(a, b)) for a, b in ((0, 3000), (0, 2400), (600, 3000), (9000, 9500))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    s = sketch.fingerprints(df).withColumn("part", F.lit(1)).cache()
    sk = {r.doc_id: r.sketch for r in s.collect()}
    lit = lambda x: F.array(*[F.lit(v) for v in x])
    row = spark.range(1).select(
        sketch.resemblance(lit(sk[0]), lit(sk[1])).alias("j"),
        sketch.resemblance(lit(sk[0]), lit(sk[3])).alias("none"),
        sketch.containment(lit(sk[1]), lit(sk[0])).alias("c"),
        sketch.distinct_shingles(lit(sk[0])).alias("n"),
    ).first()
    assert abs(row.j - 0.8) < 0.12 and row.none == 0 and row.c > 0.85 and abs(row.n / 2996 - 1) < 0.3
    whole = sketch.merged_by(s.filter("doc_id in (1, 2)"), ["part"], "sketch").first().sketch
    both = sketch.fingerprints(spark.createDataFrame([(5, text[1] + " " + text[2])], "doc_id long, text string")).first().sketch
    assert len(set(whole) & set(both)) >= sketch.K - 4
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.sketch for r in sketch.fingerprints(empty).collect()] == [[], []]
