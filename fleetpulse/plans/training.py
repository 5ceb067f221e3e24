"""Training of the risk model and of one diagnostic model per failure mode.

Each model is an L1 logistic regression on robust-scaled features with balanced class
weights; C is searched exhaustively by stratified cross-validation on ROC-AUC. Scaler
and weights belong to the searched model, so they are fitted per fold, all from shared
passes. The rows of a search are written once, compressed, and removed afterwards. Tables of up to
CACHED_ROWS rows are cached, as is each training set; larger ones are read again for each pass, and split and
folds are conditions on them, so that no second copy is made.
All C of a training set are fitted together by Newton steps, one pass over the rows for each step,
so that a search takes some tens of passes, whatever the length of the grid. A penalty at or above the
largest gradient at zero gives the zero model, which needs no fit; only the chosen C is refitted
on all rows. A model that reaches `max_iter` steps is reported as not converged.

The penalised objective is sum(w * logloss) * C + |b|_1 with the intercept penalised
too; the steps minimise the same divided by C * sum(w), mean logloss + |b|_1 / (C * sum(w)). The
intercept is the coefficient of a constant input.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import LabelSpec, Series, TrainConfig
from ..functions.columns import c, cols, logspace
from ..functions.linear import LinearModel
from ..operators import evaluate, rows
from ..operators.quantiles import robust_scale_stats
from ..operators.split import TEST, TRAIN, chronological_split, spread_key, stratified_folds, stratified_split
from ..sources.sensors import scratch_path

# The published search settings.
RISK_TRAINING = TrainConfig(grid=tuple(logspace(-5, 7, 50)), max_iter=3000, target_recall=0.765)
MODE_TRAINING = TrainConfig(grid=tuple(logspace(-2, 2, 20)), max_iter=5000, target_recall=0.50)
# End of fixed values.

FULL = "full"
BIAS = "__bias"
FOLD = "__fold"
SPREAD = "__spread"
ROWS_PER_TASK = 100_000
CACHED_ROWS = 1_000_000
SLICE_ROWS = 2048
SWEEPS = 300


@dataclass(frozen=True)
class SetStats:
    """Scaler and class weights of one training set."""

    centers: tuple[float, ...]
    scales: tuple[float, ...]
    rows: int
    weights: tuple[float, float]  # of class 0 and class 1


@dataclass(frozen=True)
class Trained:
    model: LinearModel
    best_c: float
    search: DataFrame  # (c, mean_auc, auc_bound: its error bound, converged: in every fold)
    report: DataFrame  # one row of metrics on the evaluation split
    pipeline: PipelineModel


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """(class, rows, weight): n / (number of classes * rows of the class)."""
    counts = df.where(c(label).isNotNull()).groupBy(c(label).alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    both = counts.agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("k"))
    share = both.select((F.col("n") / F.col("k").cast("double")).alias("s")).scalar()
    return counts.select("class", "rows", (share / F.col("rows")).alias("weight"))


def set_statistics(
    df: DataFrame, features: Sequence[str], label: str, sets: dict[str, Column], exact: bool = True
) -> dict[str, SetStats]:
    """Scaler and weights of every training set, from one pass each."""
    found: dict[str, dict] = {s: {} for s in sets}
    for r in robust_scale_stats(df, features, sets, exact).collect():
        found[r["set"]][r["column"]] = (r["center"], r["scale"])
    counts = df.agg(
        *[F.count_if(inside & (c(label) == y)).alias(f"{s}{y}") for s, inside in sets.items() for y in (0, 1)]
    ).first()
    stats = {}
    for s, scale in found.items():
        n0, n1 = counts[f"{s}0"], counts[f"{s}1"]
        if not n0 or not n1:
            raise ValueError(f"training set {s!r} of {label!r} has {n0} negatives and {n1} positives; both are needed")
        n = n0 + n1
        stats[s] = SetStats(
            tuple(scale[f][0] for f in features),
            tuple(scale[f][1] for f in features),
            n,
            (n / (2.0 * n0), n / (2.0 * n1)),
        )
    return stats


def _scaled(features: Sequence[str], stats: SetStats) -> list[Column]:
    return [
        (c(f).cast("double") - F.lit(m)) / F.lit(s) for f, m, s in zip(features, stats.centers, stats.scales)
    ]


def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the upper half of an n x n matrix."""
    return np.triu_indices(n)


def _loss_sums(data: DataFrame, n_inputs: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian sums of (inputs, y, weight) rows at many points (rows), from one pass.

    Tasks add up their rows, so that only one number per task, point and entry is shuffled.
    """
    up, across = _pairs(n_inputs)
    width = 1 + n_inputs + len(up)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(points), width))
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                *x, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_inputs + 2))
                x, y, w = np.column_stack(x), y[:, None], w[:, None]
                eta = x @ points.T
                small = np.exp(-np.abs(eta))
                p = np.where(eta >= 0, 1.0, small) / (1.0 + small)
                sums[:, 0] += (w * (np.log1p(small) + np.maximum(eta, 0.0) - y * eta)).sum(axis=0)
                sums[:, 1 : 1 + n_inputs] += (w * (p - y)).T @ x
                sums[:, 1 + n_inputs :] += (w * small / (1.0 + small) ** 2).T @ (x[:, up] * x[:, across])
        point, place = np.divmod(np.arange(sums.size), width)
        yield pa.record_batch([pa.array(c) for c in (point, place, sums.ravel())], names=["point", "place", "value"])

    added = data.mapInArrow(run, "point long, place long, value double").groupBy("point", "place").agg(F.sum("value"))
    sums = np.zeros((len(points), width))
    for point, place, value in added.collect():  # points x width rows
        sums[point, place] = value
    hessian = np.zeros((len(points), n_inputs, n_inputs))
    hessian[:, up, across] = hessian[:, across, up] = sums[:, 1 + n_inputs :]
    return sums[:, 0], sums[:, 1 : 1 + n_inputs], hessian


def _newton_steps(b: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """For each point (row), the least of gradient * d + d * hessian * d / 2 + penalty * |b + d|_1.

    Coordinate descent finds the signs, the equations of the inputs that are not zero give the values.
    """
    n = b.shape[1]
    curve = np.einsum("mii->mi", hessian)
    flat = curve <= 1e-14 * np.maximum(curve.max(axis=1, keepdims=True), 1e-300)
    curve, limit = np.where(flat, 1.0, curve), penalty[:, None]

    def value(k: int, at: np.ndarray) -> float:
        d = at - b[k]
        return gradient[k] @ d + d @ hessian[k] @ d / 2 + penalty[k] * np.abs(at).sum()

    at = b.copy()
    slope = gradient.copy()
    for _ in range(SWEEPS):
        moved = 0.0
        for i in range(n):
            u = curve[:, i] * at[:, i] - slope[:, i]
            new = np.sign(u) * np.maximum(np.abs(u) - penalty, 0.0) / curve[:, i]
            change = np.where(flat[:, i], 0.0, new - at[:, i])
            at[:, i] += change
            slope += change[:, None] * hessian[:, i]
            moved = max(moved, float(np.max(np.abs(change) / (1e-300 + np.abs(at).max(axis=1)))))
        if moved < 1e-13:
            break
    off = np.abs(slope) > limit
    for k in range(len(b)):
        used = np.flatnonzero(((at[k] != 0.0) | off[k]) & ~flat[k])
        sign = np.where(at[k] != 0.0, np.sign(at[k]), -np.sign(slope[k]))[used]
        solved = np.zeros(n)
        right = hessian[k][used] @ b[k] - gradient[k][used] - penalty[k] * sign
        solved[used] = np.linalg.lstsq(hessian[k][np.ix_(used, used)], right, rcond=1e-14)[0]
        if (np.sign(solved[used]) == sign).all() and value(k, solved) <= value(k, at[k]):
            at[k] = solved
    return at - b


def fit_logistic(
    data: DataFrame, n_inputs: int, c_values: Sequence[float], n: int, config: TrainConfig
) -> list[tuple[np.ndarray, bool]]:
    """(coefficients, whether the steps ended by themselves) of (inputs, y, weight) rows for every C.

    Newton steps for all C together, one pass over the rows for each: the pass gives loss, gradient and
    Hessian at the points tried, the driver solves one small penalised problem per C. A step that
    does not lower the objective is halved. A fit ends when its step promises less than `tol` squared of the
    objective, or nothing that a double can tell.
    """
    penalty = np.array([1.0 / (v * n) for v in c_values])
    tried = np.zeros((len(c_values), n_inputs))
    best, step, promised = tried.copy(), np.zeros_like(tried), np.zeros(len(tried))
    value, done = np.full(len(tried), np.inf), np.zeros(len(tried), bool)
    for _ in range(config.max_iter):
        left = np.flatnonzero(~done)
        if not len(left):
            break
        loss, gradient, hessian = (x / n for x in _loss_sums(data, n_inputs, tried[left]))
        now = loss + penalty[left] * np.abs(tried[left]).sum(axis=1)
        lower = now <= value[left] - 1e-4 * promised[left]
        for k in left[~lower]:
            step[k] /= 2
            promised[k] /= 2
        taken = left[lower]
        best[taken], value[taken] = tried[taken], now[lower]
        if len(taken):
            g, h, size = gradient[lower], hessian[lower], np.abs(best[taken]).sum(axis=1)
            step[taken] = _newton_steps(best[taken], g, h, penalty[taken])
            size = np.abs(best[taken] + step[taken]).sum(axis=1) - size
            promised[taken] = -(np.einsum("mi,mi->m", g, step[taken]) + penalty[taken] * size)
        tried[left] = best[left] + step[left]
        done[left] = promised[left] <= np.maximum(config.tol**2, 1e-15) * value[left]
        best[done] = tried[done]
    return [(b, bool(d)) for b, d in zip(best, done)]


def to_linear_model(name: str, features: Sequence[str], stats: SetStats, fitted: np.ndarray) -> LinearModel:
    *b, intercept = fitted.tolist()
    return LinearModel(name, tuple(features), tuple(b), stats.centers, stats.scales, intercept)


def pipeline_model(model: LinearModel) -> PipelineModel:
    """The model as a standard pipeline that adds `probability`, for use without this package."""
    terms = [repr(model.intercept)] + [
        f"CAST({b!r} AS DOUBLE) * (coalesce(nanvl(CAST(`{n.replace('`', '``')}` AS DOUBLE), 0.0D), 0.0D) - CAST({m!r} AS DOUBLE))"
        f" / CAST({s!r} AS DOUBLE)"
        for n, b, m, s in zip(model.features, model.coefficients, model.centers, model.scales)
        if b != 0.0
    ]
    terms[0] = f"CAST({terms[0]} AS DOUBLE)"
    z = " + ".join(terms)
    return PipelineModel(
        [SQLTransformer(statement=f"SELECT *, 1.0D / (1.0D + exp(-({z}))) AS probability FROM __THIS__")]
    )


def gradients_at_zero(
    df: DataFrame, features: Sequence[str], label: str, sets: dict[str, Column], stats: dict[str, SetStats]
) -> dict[str, float]:
    """Largest |gradient| of the mean loss of the zero model, for every training set, from one pass."""
    sums = []
    for s, inside in sets.items():
        weight = F.when(c(label) == 1, F.lit(-0.5 * stats[s].weights[1])).otherwise(F.lit(0.5 * stats[s].weights[0]))
        for i, z in enumerate(_scaled(features, stats[s])):
            sums.append((F.sum(F.when(inside, weight * z)) / stats[s].rows).alias(f"{s}/{i}"))
    found = df.agg(*sums).first()
    return {s: max(abs(found[f"{s}/{i}"] or 0.0) for i in range(len(features))) for s in sets}


def _fit_set(
    rows_in: DataFrame, features: Sequence[str], label: str, stats: SetStats, steepest: float, grid: Sequence[float], name: str, config: TrainConfig
) -> dict[float, tuple[LinearModel, bool]]:
    """(model, whether it converged) of one training set for every C of `grid`."""
    zero = LinearModel(name, tuple(features), (0.0,) * len(features), stats.centers, stats.scales, 0.0)
    # at this penalty and above the zero model is the optimum
    found = {v: (replace(zero, name=f"{name}/{v}"), True) for v in grid if 1.0 / (v * stats.rows) >= steepest}
    left = [v for v in grid if v not in found]
    if not left:
        return found
    weight = F.when(c(label) == 1, F.lit(stats.weights[1])).otherwise(F.lit(stats.weights[0]))
    inputs = [*_scaled(features, stats), F.lit(1.0), c(label).cast("double"), weight]
    data = rows_in.select(*[x.alias(f"x{i}") for i, x in enumerate(inputs)])
    small = stats.rows <= CACHED_ROWS
    if small:
        data = data.coalesce(max(1, -(-stats.rows // ROWS_PER_TASK))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for v, (b, done) in zip(left, fit_logistic(data, len(features) + 1, left, stats.rows, config)):
            found[v] = to_linear_model(f"{name}/{v}", features, stats, b), done
    finally:
        if small:
            data.unpersist()
    return found


def optimality_gap(df: DataFrame, model: LinearModel, label: str, c_value: float) -> float:
    """How far a model is from the optimum on its training rows, from one pass; 0 at the optimum.

    At the optimum the gradient of the mean loss is -penalty * sign(b) where b is not zero, and no
    larger than the penalty where it is; the gap is the largest departure.
    """
    n0, n1 = df.agg(F.count_if(c(label) == 0), F.count_if(c(label) == 1)).first()
    n = n0 + n1
    weight = F.when(c(label) == 1, F.lit(n / (2.0 * n1))).otherwise(F.lit(n / (2.0 * n0)))
    stats = SetStats(model.centers, model.scales, n, (0.0, 0.0))
    error = weight * (model.probability() - c(label).cast("double"))
    inputs = [*_scaled(model.features, stats), F.lit(1.0)]
    found = df.agg(*[(F.sum(error * z) / n).alias(f"g{i}") for i, z in enumerate(inputs)]).first()
    penalty = 1.0 / (c_value * n)
    return max(
        abs(g + penalty * (1 if b > 0 else -1)) if b else max(0.0, abs(g) - penalty)
        for g, b in zip(found, [*model.coefficients, model.intercept])
    )


def _scores(models: dict[int, Sequence[LinearModel]]):
    """(fold, slopes, shifts): log-odds of all models of a fold as one matrix product."""
    out = []
    for k, found in models.items():
        slopes = np.array([[b / s for b, s in zip(m.coefficients, m.scales)] for m in found])
        shift = [m.intercept - sum(b * x / s for b, x, s in zip(m.coefficients, m.centers, m.scales)) for m in found]
        out.append((k, slopes, np.array(shift)))
    return out


def fold_aucs(
    df: DataFrame, features: Sequence[str], label: str, fold: str, models: dict[int, Sequence[LinearModel]], bins: int
) -> dict[tuple[int, int], tuple[float | None, float]]:
    """(AUC, error bound) of each (fold, model): every row is scored by the models that did not see it.

    Scores are counted in `bins` cells between their least and greatest value, per model and in the
    tasks, so that only histograms are shuffled. Rows of one cell count as ties: the bound is half of the
    pairs that share a cell.
    """
    weights = _scores(models)
    inputs = [c(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]
    prepared = df.select(c(fold).cast("int").alias("fold"), c(label).cast("int").alias("y"), *inputs)

    def scored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        folds, y = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 1
        x = np.column_stack([batch.column(i + 2).to_numpy(zero_copy_only=False) for i in range(len(features))])
        for k, slopes, shift in weights:
            mine = folds == k
            if mine.any():
                yield k, y[mine], x[mine] @ slopes.T + shift

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, _, eta in scored(batch):
                n = eta.shape[1]
                yield pa.record_batch(
                    [pa.array([k] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(eta.min(axis=0)), pa.array(eta.max(axis=0))],
                    names=["fold", "model", "low", "high"],
                )

    limits = prepared.mapInArrow(ranges, "fold int, model int, low double, high double").groupBy("fold", "model")
    limits = {(r[0], r[1]): (r[2], r[3]) for r in limits.agg(F.min("low"), F.max("high")).collect()}  # one row per model

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, y, eta in scored(batch):
                for m in range(eta.shape[1]):
                    low, high = limits[k, m]
                    cell = np.zeros(len(y), np.int64) if high <= low else ((eta[:, m] - low) * (bins / (high - low))).astype(np.int64)
                    found = np.bincount(2 * np.clip(cell, 0, bins - 1) + y, minlength=2 * bins)
                    totals[k, m] = totals[k, m] + found if (k, m) in totals else found
        for (k, m), found in totals.items():
            cell = np.flatnonzero(found.reshape(bins, 2).any(axis=1))
            pairs = found.reshape(bins, 2)[cell]
            columns = (np.full(len(cell), k, np.int32), np.full(len(cell), m, np.int32), cell, pairs[:, 0], pairs[:, 1])
            yield pa.record_batch([pa.array(x) for x in columns], names=["fold", "model", "cell", "negatives", "positives"])

    counts = prepared.mapInArrow(histograms, "fold int, model int, cell long, negatives long, positives long")
    counts = counts.groupBy("fold", "model", "cell").agg(F.sum("negatives").alias("n"), F.sum("positives").alias("p"))
    below = F.sum("n").over(Window.partitionBy("fold", "model").orderBy("cell")) - F.col("n")
    won = counts.withColumn("won", F.col("p") * (below + F.col("n") / 2)).groupBy("fold", "model").agg(
        F.sum("won").alias("won"), F.sum(F.col("n") * F.col("p") / 2).alias("ties"), (F.sum("n") * F.sum("p")).cast("double").alias("pairs")
    )
    return {(r["fold"], r["model"]): (r["won"] / r["pairs"], r["ties"] / r["pairs"]) if r["pairs"] else (None, 0.0) for r in won.collect()}


def search_c(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    fold: str,
    models: dict[tuple[str, float], tuple[LinearModel, bool]],
    config: TrainConfig,
) -> list[tuple[float, float | None, float, bool]]:
    """(c, mean_auc over the folds, its error bound, converged in every fold) of every C."""
    by_fold = {k: [models[f"fold{k}", v][0] for v in config.grid] for k in range(config.folds)}
    aucs = fold_aucs(df, features, label, fold, by_fold, config.auc_bins)
    table = []
    for i, v in enumerate(config.grid):
        mine = [aucs[k, i] for k in by_fold if aucs.get((k, i), (None,))[0] is not None]
        # ties between C values are real; the order of summation must not decide them
        mean = round(sum(a for a, _ in mine) / len(mine), 12) if mine else None
        bound = sum(e for _, e in mine) / len(mine) if mine else 0.0
        table.append((v, mean, bound, all(models[f"fold{k}", v][1] for k in by_fold)))
    return sorted(table)


def train_model(
    df: DataFrame,
    name: str,
    features: Sequence[str],
    label: str,
    series: Series,
    labels: LabelSpec,
    config: TrainConfig,
    split: str = "split",
    exact: bool = True,
) -> Trained:
    """Search, refit on all training rows, and evaluate on the test rows.

    Pass a table without missing features that is cheap to read twice.
    """
    rows.check_no_leakage(features, labels)
    used = dict.fromkeys([*series.keys, series.order, *series.tiebreak, *features, label, split])
    kept = df.select(*cols(used))
    folded = stratified_folds(kept.where(c(split) == TRAIN), label, series, config.folds, FOLD)
    folded = folded.select(*cols([*features, label, FOLD]))
    # splits by literal cuts of a stored table are read from there, without a copy
    with stored(folded) if moves_rows(folded) else nullcontext(folded) as train:
        sets = {FULL: F.lit(True), **{f"fold{k}": c(FOLD) != k for k in range(config.folds)}}
        stats = set_statistics(train, features, label, sets, exact)
        steepest = gradients_at_zero(train, features, label, sets, stats)
        searched = [s for s in sets if s != FULL]
        with ThreadPoolExecutor(config.parallelism) as pool:
            fits = pool.map(
                lambda s: _fit_set(train.where(sets[s]), features, label, stats[s], steepest[s], config.grid, s, config), searched
            )
            models = {(s, v): m for s, found in zip(searched, fits) for v, m in found.items()}
        table = search_c(train, features, label, FOLD, models, config)
        best = max(table, key=lambda r: (-1.0 if r[1] is None else r[1], -r[0]))[0]
        found = _fit_set(train, features, label, stats[FULL], steepest[FULL], [best], FULL, config)
    model, done = found[best]
    model = replace(model, name=name)
    search = df.sparkSession.createDataFrame(table, "c double, mean_auc double, auc_bound double, converged boolean")
    test = kept.where(c(split) == TEST).select(c(label).alias("y"), model.probability().alias("p"))
    report = evaluate.operating_report(evaluate.curve(test, "y", "p"), config.target_recall)
    report = report.select(F.lit(name).alias("model"), F.lit(best).alias("c"), "*", F.lit(done).alias("converged"))
    return Trained(model, best, search, report, pipeline_model(model))


def train_risk_model(
    df: DataFrame,
    features: Sequence[str],
    series: Series,
    labels: LabelSpec,
    config: TrainConfig = RISK_TRAINING,
    exact: bool = True,
) -> Trained:
    """Risk model on all rows: the first part of the time axis trains, the rest tests."""
    rows.check_no_leakage(features, labels)
    used = dict.fromkeys([*series.keys, series.order, *series.tiebreak, *features, labels.target])
    with stored(rows.complete_cases(df.select(*cols(used)), [*features, labels.target])) as kept:
        ordered = chronological_split(kept, series, config.train_fraction)
        return _with_report(train_model(ordered, "risk", features, labels.target, series, labels, config, exact=exact))


def moves_rows(df: DataFrame) -> bool:
    """Whether a pass over the table shuffles or sorts rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Exchange" in plan or "Sort" in plan


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it ends: its result is kept elsewhere."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """The table kept for many passes: compressed in the shared folder, so that a lost executor does not
    bring back the feature windows, and cached if it is small. It is removed in the end."""
    spark = df.sparkSession
    path = scratch_path(spark, "rows")
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any column name can be stored
    with released(spark):
        plain.write.option("compression", "zstd").option("maxRecordsPerFile", 10 * ROWS_PER_TASK).parquet(path)
    kept = spark.read.schema(plain.schema).parquet(path).toDF(*df.columns)
    n = kept.count()
    cached = None
    if n <= CACHED_ROWS:
        # few classes leave their rows in few partitions
        tasks = -(-n // ROWS_PER_TASK)
        if kept.rdd.getNumPartitions() < tasks:
            kept = kept.repartition(tasks)
        kept = cached = kept.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        if cached is not None:
            cached.unpersist()
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _with_report(trained: Trained) -> Trained:
    """Evaluate the one-row report while its input is still cached."""
    row = trained.report.collect()
    return replace(trained, report=trained.report.sparkSession.createDataFrame(row, trained.report.schema))


def train_mode_models(
    df: DataFrame,
    features: Sequence[str],
    series: Series,
    labels: LabelSpec,
    id_column: str,
    config: TrainConfig = MODE_TRAINING,
    only: Sequence[str] | None = None,
    exact: bool = True,
) -> list[Trained]:
    """One diagnostic model per mode, on failure rows only, with a stratified random split."""
    rows.check_no_leakage(features, labels)
    used = dict.fromkeys([id_column, *series.keys, series.order, *series.tiebreak, *features, *labels.modes])
    failures = rows.complete_cases(rows.failures_only(df, labels.target).select(*cols(used)), list(features))
    with stored(failures.withColumn(SPREAD, spread_key(id_column, config.seed))) as kept:
        return [
            _with_report(
                train_model(
                    stratified_split(kept, mode, id_column, 1.0 - config.train_fraction, config.seed, spread=SPREAD),
                    mode, features, mode, series, labels, config, exact=exact,
                )
            )
            for mode in (labels.modes if only is None else only)
        ]


def metrics_table(trained: Iterable[Trained], run_id: str) -> DataFrame:
    """One metrics row per model with its feature list, to be appended to a metrics table."""
    out = None
    for t in trained:
        row = t.report.select(
            F.lit(run_id).alias("run_id"),
            F.current_timestamp().alias("created"),
            "*",
            F.array(*[F.lit(f) for f in t.model.features]).alias("features"),
        )
        out = row if out is None else out.unionByName(row)
    return out
