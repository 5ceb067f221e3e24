"""Document fingerprints: bottom-k sketches of word shingles, with Spark expressions only.

A sketch is the ascending array of the k smallest distinct 64-bit hashes of a text's shingles
(five consecutive words; a shorter text is one shingle). Sketches merge: the sketch of a union
is the k smallest of both. From sketches alone follow resemblance, containment and the number
of distinct shingles.

Defined results: a null or empty text has the empty sketch; two empty sketches resemble each
other fully, an empty and another not at all; equal texts have equal sketches; up to k distinct
shingles all estimates are exact. Repeated rows give repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
SHINGLE_WORDS = 5
_SPACE = r"[\x20\x09-\x0D]+"
_LEAST = -(1 << 63)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def shingle_hashes(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of all shingles, repeats included."""
    return F.transform(
        F.array(words(text)),
        lambda w: F.when(F.size(w) == 0, F.array().cast("array<bigint>"))
        .when(F.size(w) < size, F.array(F.xxhash64(w)))
        .otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.xxhash64(F.slice(w, i, size)))),
    )[0]


def sketch(text: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two documents or parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged_by(sketches: DataFrame, keys: list[str], column: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per group. Parts of a group are merged first, so a hot group meets as `salts` sketches.

    Hashes are made distinct in the map tasks; no task holds a group's sketches at once.
    """
    hashes = sketches.select(*keys, F.explode(column).alias("__hash")).distinct()
    salted = hashes.withColumn("__salt", F.pmod("__hash", F.lit(salts)))
    rank = Window.partitionBy(*keys, "__salt").orderBy("__hash")
    least = salted.withColumn("__rank", F.row_number().over(rank)).filter(F.col("__rank") <= k)
    return least.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("__hash")), 1, k).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the two shingle sets, 0 to 1."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.element_at(a, -1).cast("double") + float(1 << 63)) / float(1 << 64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 where a has none."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def printed(a: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def by_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(`key`, `text`, __bucket, __guard, __tie): documents dealt into ranges of the key, in order.

    Ranges follow key quantiles, and ids that fill several ranges are spread by a hash of the text.
    A range also gets a copy, marked __guard, of the first document after it (after the last: the
    first of all), so every document stands before its successor in its own range. Null keys sort
    first. Only range limits, a few per shuffle partition, come to the driver.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.coalesce(F.col(key).cast("long"), F.lit(_LEAST))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias(text))
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    limits = sorted(rows.agg(F.percentile_approx(order, shares, 20 * ranges)).first()[0] or [])
    cuts = F.array(*[F.lit(c) for c in limits]).cast("array<bigint>")
    below, upto = (F.size(F.filter(cuts, f)) for f in (lambda c: c < order, lambda c: c <= order))
    tie = F.xxhash64(text)
    spread = (tie.cast("double") + float(1 << 63)) / float(1 << 64)
    bucket = (below + F.least(F.floor(spread * (upto - below + 1)), upto - below)).cast("int")
    rows = rows.select("*", bucket.alias("__bucket"), order.alias("__order"), tie.alias("__tie"))
    firsts = sorted(
        (r["__bucket"], r.first["__order"], r.first["__tie"])
        for r in rows.groupBy("__bucket").agg(F.min(F.struct("__order", "__tie")).alias("first")).collect()
    )
    entry = "struct<order:bigint,tie:bigint,bucket:int>"
    guards = F.array(
        *[
            F.struct(F.lit(o).alias("order"), F.lit(t).alias("tie"), F.lit(firsts[i - 1][0]).alias("bucket"))
            for i, (_, o, t) in enumerate(firsts)
        ]
    ).cast(f"array<{entry}>")
    mine = F.filter(guards, lambda g: (g.order == F.col("__order")) & (g.tie == F.col("__tie")))
    places = F.concat(
        F.array(F.struct(F.col("__bucket").alias("bucket"), F.lit(False).alias("guard"))),
        F.transform(mine, lambda g: F.struct(g.bucket.alias("bucket"), F.lit(True).alias("guard"))),
    )
    rows = rows.select(key, text, "__order", "__tie", F.explode(places).alias("__place"))
    return rows.select(
        key, text, "__order", "__tie", F.col("__place.bucket").alias("__bucket"), F.col("__place.guard").alias("__guard")
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """(`key`, sketch) of every row."""
    return docs.select(key, sketch(F.col(text), k).alias("sketch"))


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Every document beside its edited text and its successor: (`key`, `text`, edited, sketch, edited_sketch, next_sketch).

    The edited text has its last quarter replaced by the beginning of the next document.
    """
    # texts move once; sketches are taken after that, in the task that also knows the successor
    dealt = by_next(docs, key, text).repartition("__bucket").withColumn("sketch", sketch(F.col(text), k))
    order = Window.partitionBy("__bucket").orderBy("__guard", "__order", "__tie", text)
    rows = dealt.select(
        "*", F.lead(text).over(order).alias("__next"), F.lead("sketch").over(order).alias("next_sketch")
    ).filter(~F.col("__guard"))
    cut = F.floor(F.length(text) / 4).cast("int")
    edited = F.concat(F.substring(text, F.lit(1), F.length(text) - cut), F.substring("__next", F.lit(1), cut))
    rows = rows.select(key, text, edited.alias("edited"), "sketch", "next_sketch")
    return rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
