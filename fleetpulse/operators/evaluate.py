"""Evaluation curves and operating points as distributed aggregations.

Scores are grouped first, so ties share one threshold and a score held by many rows
costs one row; counts are then summed along the descending score axis in slices.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Series
from ..functions.columns import c, cols, ratio
from .quantiles import present
from .series import drop_slices, join_small, may_be_hot, running_sums, settled


def _group_totals(df: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add per-group totals; Catalyst picks the join, one group needs none."""
    if not by:
        whole = totals.select(F.struct("*").alias("t")).scalar()
        return df.select("*", whole.alias("__t")).select(*cols(df.columns), "__t.*")
    right = totals.select(*[c(k).alias(f"__g{i}") for i, k in enumerate(by)], *cols(n for n in totals.columns if n not in by))
    condition = [c(k).eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(by)]
    return df.join(right, condition).drop(*[f"__g{i}" for i in range(len(by))])


def _scored(df: DataFrame, label: str, score: str) -> Column:
    """Rows with a label and a score that is a number."""
    return c(label).isNotNull() & present(df, score).isNotNull()


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    return (
        df.where(_scored(df, label, score))
        .groupBy(*cols(by), c(score).cast("double").alias("threshold"))
        .agg(F.count_if(c(label) == 1).alias("pos"), F.count_if(c(label) == 0).alias("neg"))
    )


def curve(
    df: DataFrame,
    label: str,
    score: str,
    by: Sequence[str] = (),
    hot_rows: int | None = 1_000_000,
    at_most: int | None = None,
) -> DataFrame:
    """One row per distinct score t: the outcome of predicting 1 where score >= t.

    `at_most` is a known bound on the rows of a group; it saves counting them.
    """
    counts = score_counts(df, label, score, by).withColumn("__down", -F.col("threshold"))
    along = Series(tuple(by), "__down", (), hot_rows)
    large = may_be_hot(df, along) if at_most is None or hot_rows is None else at_most > hot_rows
    if large:
        counts = settled(counts)
    summed = running_sums(
        counts, along if large else replace(along, hot_rows=None), {"tp": F.col("pos"), "fp": F.col("neg")}
    )
    summed = drop_slices(summed)
    totals = counts.groupBy(*cols(by)).agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return _group_totals(summed, totals, by).select(
        *cols(by),
        "threshold",
        "pos",
        "neg",
        "tp",
        "fp",
        (F.col("__p") - F.col("tp")).alias("fn"),
        (F.col("__n") - F.col("fp")).alias("tn"),
        ratio(F.col("tp"), F.col("__p")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("fp"), F.col("__n")).alias("fpr"),
    )


def roc_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, fpr, tpr), with the starting point (0, 0) above every score."""
    start = points.select(*cols(by)).distinct() if by else points.agg(F.count(F.lit(1)).alias("__c")).where("__c > 0")
    start = start.select(
        *cols(by), F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.select(*cols(by), "threshold", "fpr", F.col("recall").alias("tpr")).unionByName(start)


def pr_points(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(threshold, recall, precision), with the end point (0, 1) that has no threshold."""
    end = points.select(*cols(by)).distinct() if by else points.agg(F.count(F.lit(1)).alias("__c")).where("__c > 0")
    end = end.select(
        *cols(by), F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision")
    )
    return points.select(*cols(by), "threshold", "recall", "precision").unionByName(end)


def _auc() -> Column:
    """Trapezoid area from counts; NULL when a class is absent."""
    area = F.sum(F.col("neg").cast("double") * (2 * F.col("tp") - F.col("pos")))
    return F.try_divide(area, 2.0 * F.sum("pos").cast("double") * F.sum("neg").cast("double"))


def _average_precision() -> Column:
    return F.try_divide(F.sum(F.col("pos") * F.col("precision")), F.sum("pos").cast("double"))


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*cols(by)).agg(_auc().alias("roc_auc"))


def average_precision(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise sum of precision over recall gains (not a trapezoid)."""
    return points.groupBy(*cols(by)).agg(_average_precision().alias("average_precision"))


def _check_recall(target: float) -> None:
    if not 0.0 < target <= 1.0:
        raise ValueError("target recall must be above 0 and at most 1")


def threshold_at_recall(points: DataFrame, target: float, by: Sequence[str] = ()) -> DataFrame:
    """Highest threshold whose recall still reaches the target."""
    _check_recall(target)
    return points.groupBy(*cols(by)).agg(
        F.max(F.when(F.col("recall") >= F.lit(target), F.col("threshold"))).alias("threshold")
    )


def operating_report(points: DataFrame, target_recall: float, by: Sequence[str] = ()) -> DataFrame:
    """AUC, average precision, and the confusion counts and rates at the target recall."""
    _check_recall(target_recall)
    reached = F.when(F.col("recall") >= F.lit(target_recall), F.col("threshold"))
    best = points.groupBy(*cols(by)).agg(
        _auc().alias("roc_auc"),
        _average_precision().alias("average_precision"),
        F.max(reached).alias("threshold"),
        F.max_by(F.struct("tp", "fp", "fn", "tn", "recall", "precision", "fpr"), reached).alias("__at"),
    )
    return best.select(*cols(by), "roc_auc", "average_precision", "threshold", "__at.*")


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp in one pass; absent combinations are 0."""
    def cell(y: int, p: int) -> Column:
        return F.count_if((c(label) == y) & (c(predicted) == p))

    return df.groupBy(*cols(by)).agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def confusion_cells(counts: DataFrame) -> DataFrame:
    """The four cells as rows, with their percentage of all rows and share of the largest cell."""
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    largest = F.greatest("tn", "fp", "fn", "tp")
    others = [n for n in counts.columns if n not in ("tn", "fp", "fn", "tp")]
    return counts.select(
        *cols(others),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(y).cast("long").alias("actual"),
                        F.lit(p).cast("long").alias("predicted"),
                        F.col(cell).alias("count"),
                        (ratio(F.col(cell), total) * 100.0).alias("percent"),
                        ratio(F.col(cell), largest).alias("share_of_max"),
                    )
                    for y, p, cell in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
                ]
            )
        ),
    )


def rates(counts: DataFrame) -> DataFrame:
    """Add recall, precision and false positive rate; NULL where undefined."""
    return counts.select(
        "*",
        ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
    )


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts and rates at given thresholds: one scan, no join, no shuffle of rows."""
    kept = df.where(_scored(df, label, score))
    one = kept.agg(
        F.count_if(c(label) == 1).alias("__p"),
        F.count_if(c(label) == 0).alias("__n"),
        *[F.count_if((c(label) == 1) & (c(score) >= F.lit(t))).alias(f"__tp{i}") for i, t in enumerate(thresholds)],
        *[F.count_if((c(label) == 0) & (c(score) >= F.lit(t))).alias(f"__fp{i}") for i, t in enumerate(thresholds)],
    )
    tall = one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(float(t)).alias("threshold"),
                        F.col(f"__tp{i}").alias("tp"),
                        F.col(f"__fp{i}").alias("fp"),
                        (F.col("__p") - F.col(f"__tp{i}")).alias("fn"),
                        (F.col("__n") - F.col(f"__fp{i}")).alias("tn"),
                    )
                    for i, t in enumerate(thresholds)
                ]
            )
        )
    )
    return rates(tall)


def cost_curve(points: DataFrame, miss_cost: float, alarm_cost: float) -> DataFrame:
    """Total cost of missed failures and false alarms at every threshold."""
    return points.select(
        "*", (F.col("fn") * F.lit(float(miss_cost)) + F.col("fp") * F.lit(float(alarm_cost))).alias("cost")
    )


def cheapest_threshold(points: DataFrame, miss_cost: float, alarm_cost: float, by: Sequence[str] = ()) -> DataFrame:
    """The threshold of least cost; the lowest one on ties."""
    best = F.min(F.struct("cost", "threshold"))
    return (
        cost_curve(points, miss_cost, alarm_cost)
        .groupBy(*cols(by))
        .agg(best.alias("__b"))
        .select(*cols(by), F.col("__b.threshold").alias("threshold"), F.col("__b.cost").alias("cost"))
    )


def score_density(
    df: DataFrame, label: str, score: str, points: int = 200, cut: float = 3.0, bins: int | None = 1000
) -> DataFrame:
    """Gaussian kernel density of the score per class (0 and 1) on an even grid.

    Equal scores are counted first. `bins` snaps scores to that many cells per class,
    which bounds the work to bins * points on top of the counting pass; with None the
    density is exact, at distinct scores * points.
    """
    kept = df.where(c(label).isin(0, 1) & _scored(df, label, score)).select(
        c(label).cast("long").alias("class"), c(score).cast("double").alias("x")
    )
    stats = kept.groupBy("class").agg(
        F.count(F.lit(1)).alias("__n"),
        F.stddev_samp("x").alias("__sd"),
        F.min("x").alias("__lo"),
        F.max("x").alias("__hi"),
    )
    stats = stats.select("*", (F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))).alias("__bw"))
    stats = stats.where(F.col("__bw") > 0)
    # at most two classes, so the statistics are at most two rows
    if bins is not None:
        cell = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
        place = F.least(F.floor((F.col("x") - F.col("__lo")) / cell), F.lit(bins - 1))
        kept = join_small(kept, stats.select("class", "__lo", "__hi"), ["class"], "inner", few=True).select(
            "class", (F.col("__lo") + (place + 0.5) * cell).alias("x")
        )
    counted = kept.groupBy("class", "x").agg(F.count(F.lit(1)).alias("__w"))
    start = F.col("__lo") - F.lit(cut) * F.col("__bw")
    step = (F.col("__hi") - F.col("__lo") + F.lit(2 * cut) * F.col("__bw")) / F.lit(float(points - 1))
    grid = join_small(counted, stats, ["class"], "inner", few=True).select(
        "class", "x", "__w", "__n", "__bw", start.alias("__start"), step.alias("__step"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    )
    at = F.col("__start") + F.col("point") * F.col("__step")
    z = (at - F.col("x")) / F.col("__bw")
    norm = F.col("__n") * F.col("__bw") * F.lit(math.sqrt(2 * math.pi))
    return grid.groupBy("class", F.col("point").cast("long").alias("point")).agg(
        F.min(at).alias("x"), F.sum(F.col("__w") * F.exp(-0.5 * z * z) / norm).alias("density")
    )
