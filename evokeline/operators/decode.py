"""Time-resolved classification under repeated cross-validation.

Trials are rows (keys, trial, channel, t, x, y). A fold's training sums are the sums of all folds less its own, so the
training sets of all folds cost one aggregation and no repeated rows. Fold scores and areas under the curve are grouped
by (keys, repeat, fold, t): one plan for all subjects, comparisons and times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.hashing import drawn
from . import models


def build_comparison(trial: DataFrame, condition: DataFrame, comparison: DataFrame) -> DataFrame:
    """Rows of the trials of each comparison (name, cond_neg, cond_pos) with ``cmp`` and ``y``; condition: (condition, label)."""
    sides = comparison.select(F.col("name").alias("cmp"), F.explode(F.array(F.struct(F.col("cond_neg").alias("condition"), F.lit(0).alias("y")), F.struct(F.col("cond_pos").alias("condition"), F.lit(1).alias("y")))).alias("s")).select("cmp", "s.*")
    return trial.join(F.broadcast(sides.join(condition, "condition").drop("condition")), "label")


def label_encode(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Adds ``y``: 0 to k - 1 in the order of the labels; groups with one class get none."""
    labels = df.select(*keys, label).distinct()
    coded = labels.withColumn("y", F.dense_rank().over(Window.partitionBy(*keys).orderBy(label)) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return df.join(coded.where("_n > 1").drop("_n"), [*keys, label])


def class_guard(df: DataFrame, keys: Sequence[str], kmax: int = 10, y: str = "y") -> DataFrame:
    """(keys, k): the number of folds that the smallest class allows; fewer than two folds or classes drop out."""
    sizes = df.groupBy(*keys, y).agg(F.count_distinct("trial").alias("n"))
    return sizes.groupBy(*keys).agg(F.least(F.lit(kmax), F.min("n")).cast("int").alias("k"), F.count(F.lit(1)).alias("classes")).where("k >= 2 and classes >= 2").drop("classes")


def stratified_folds(df: DataFrame, keys: Sequence[str], k: int | Column, repeats: int, seed: int = 0) -> DataFrame:
    """(keys, trial, y, repeat, fold): each class of each group dealt out in a random order, anew for each repeat."""
    trials = df.select(*keys, "trial", "y", *(["k"] if "k" in df.columns else [])).distinct()
    dealt = trials.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = Window.partitionBy(*keys, "repeat", "y").orderBy(drawn(F.concat_ws(".", F.lit(str(seed)), F.col("repeat").cast("string")), F.col("trial")), "trial")
    folds = k if isinstance(k, Column) else F.lit(k)
    return dealt.withColumn("fold", ((F.row_number().over(order) - 1) % folds).cast("int"))


def group_folds(df: DataFrame, keys: Sequence[str], group: str, k: int) -> DataFrame:
    """(keys, group, fold): groups dealt out by size, whole."""
    sizes = df.groupBy(*keys, group).agg(F.count_distinct("trial").alias("n"))
    return sizes.withColumn("fold", ((F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("n").desc(), group)) - 1) % k).cast("int"))


def _sums() -> list[Column]:
    own = [(F.col("y") == 0, 0), (F.col("y") == 1, 1)]
    return [f(F.when(c, v)).alias(f"{n}{k}") for c, k in own for f, v, n in ((F.count, F.col("x"), "n"), (F.sum, F.col("x"), "s"), (F.sum, F.col("x") * F.col("x"), "q"))]


def class_moments(folded: DataFrame, keys: Sequence[str], feature: Sequence[str]) -> DataFrame:
    """(keys, fold, feature, m0, m1, within): the classes' means and pooled variance in the rows outside each fold."""
    own = folded.groupBy(*keys, "fold", *feature).agg(*_sums())
    w = Window.partitionBy(*keys, *feature)
    rest = {c: F.sum(c).over(w) - F.coalesce(c, F.lit(0)) for c in ("n0", "s0", "q0", "n1", "s1", "q1")}
    t = own.select(*keys, "fold", *feature, *[v.alias(c) for c, v in rest.items()]).where("n0 > 0 and n1 > 0")
    t = t.withColumn("m0", F.col("s0") / F.col("n0")).withColumn("m1", F.col("s1") / F.col("n1"))
    within = (F.col("q0") - F.col("s0") * F.col("m0") + F.col("q1") - F.col("s1") * F.col("m1")) / (F.col("n0") + F.col("n1"))
    return t.select(*keys, "fold", *feature, "m0", "m1", within.alias("within"))


def _slope(spread: Column) -> Column:
    return F.when(spread > 1e-18, (F.col("m1") - F.col("m0")) / spread).otherwise(F.lit(0.0))


def fit(folded: DataFrame, keys: Sequence[str], feature: Sequence[str], shrink: Column | float = 0.0) -> DataFrame:
    """(keys, fold, feature, w, mid): diagonal discriminant weights of the rows outside each fold; ``keys`` hold the repeat."""
    weight = _slope(F.col("within") + (shrink if isinstance(shrink, Column) else F.lit(float(shrink))))
    return class_moments(folded, keys, feature).select(*keys, "fold", *feature, weight.alias("w"), ((F.col("m0") + F.col("m1")) / 2).alias("mid"), "m0", "m1")


def scored(folded: DataFrame, weights: DataFrame, keys: Sequence[str], feature: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, by, trial, y, score): each held-out trial's decision value; above 0 is class 1. ``plus``, if there, is a feature's share of the constant."""
    plus = F.col("plus") if "plus" in weights.columns else F.lit(0.0)
    return folded.join(weights, [*keys, "fold", *feature]).groupBy(*keys, "fold", *by, "trial", "y").agg(F.sum(F.col("w") * (F.col("x") - F.col("mid")) + plus).alias("score"))


def scored_settings(folded: DataFrame, weights: DataFrame, keys: Sequence[str], feature: Sequence[str], n: int) -> DataFrame:
    """(keys, fold, trial, y, setting, score): as ``scored``, for ``n`` settings whose weights (and constants) are arrays ``w`` (``plus``).

    A trial's rows meet the weights once; settings are columns until its sums are there.
    """
    plus = (lambda s: F.get("plus", F.lit(s))) if "plus" in weights.columns else lambda s: F.lit(0.0)
    sums = [F.sum(F.get("w", F.lit(s)) * (F.col("x") - F.col("mid")) + plus(s)).alias(f"s{s}") for s in range(n)]
    each = folded.join(weights, [*keys, "fold", *feature]).groupBy(*keys, "fold", "trial", "y").agg(*sums)
    return each.select(*keys, "fold", "trial", "y", F.posexplode(F.array(*[F.col(f"s{s}") for s in range(n)])).alias("setting", "score"))


def best_setting(scores: DataFrame, keys: Sequence[str], settings: Sequence[tuple], names: str) -> DataFrame:
    """(keys, settings' ``names``, auc): the setting with the best mean area over repeats and folds, the first on ties."""
    mean = auc(scores, [*keys, "repeat", "fold", "setting"]).groupBy(*keys, "setting").agg(F.avg("auc").alias("auc"))
    best = mean.groupBy(*keys).agg(F.max(F.struct(F.round("auc", 9).alias("auc"), (-F.col("setting")).alias("s"))).alias("m"))
    told = scores.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(settings)], f"setting int, {names}")
    return best.select(*keys, (-F.col("m.s")).alias("setting"), "m.auc").join(F.broadcast(told), "setting").select(*keys, *told.columns[1:], "auc")


def linear_scorer(folded: DataFrame, keys: Sequence[str], kind: str = "dlda", **options) -> DataFrame:
    """(keys, fold, t, trial, y, score) of a model for each fold and time.

    ``dlda`` needs the sums of each channel, ``logistic`` takes a fixed number of steps over all rows. ``lda`` (full
    covariance), ``linear_svc``, ``logreg`` (to the end) and ``forest`` are those of ``models``, with their ``options``.
    """
    if kind == "dlda":
        return scored(folded, fit(folded, keys, ["channel", "t"]), keys, ["channel", "t"], ["t"])
    if kind == "logistic":
        return logistic(folded, keys)
    if kind == "forest":
        return models.fit_forest(folded, [*keys, "t"], **options)
    if kind == "lda":
        weights = models.fit_lda(folded, [*keys, "t"], **options)
    else:
        weights = models.fit_linear(folded, [*keys, "t"], loss={"linear_svc": "squared_hinge", "logreg": "logistic"}[kind], **options)
    return scored(folded, weights, keys, ["channel", "t"], ["t"])


#: Steps of ``logistic``, how far each goes along a coefficient's own Newton step, and the strength of the penalty.
STEPS, DAMPING, PENALTY = 6, 0.5, 1.0


def logistic(folded: DataFrame, keys: Sequence[str], steps: int = STEPS, rows: int = models.ROWS) -> DataFrame:
    """(keys, fold, t, trial, y, score): balanced, penalised logistic regression of each fold and time on scaled channels.

    Each step moves every coefficient by its own gradient over its own curvature, damped: sums over blocks of at most ``rows``
    trials, so a recording may be of any size. The constant has no penalty.
    """
    scores = models.diagonal_logistic(folded, [*keys, "t"], steps, DAMPING, PENALTY, rows=rows)
    return scores.select(*keys, "fold", "t", "trial", "y", "score")


def auc(df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under the curve with ties as halves; null with one class. Class weights cancel out.

    Equal scores are counted before the window, so ties of any size are one row.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.sum((F.col(y) == 1).cast("long")).alias("p"), F.sum((F.col(y) == 0).cast("long")).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = counts.withColumn("wins", F.col("p") * (below + F.col("n") / 2.0))
    return wins.groupBy(*keys).agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n")).select(*keys, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).alias("auc"))


def folded_rows(trial: DataFrame, fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each trial row once for each repeat, with its fold."""
    return trial.join(fold.select(*keys, "trial", "repeat", "fold"), [*keys, "trial"])


def sliding_auc(trial: DataFrame, fold: DataFrame, keys: Sequence[str], kind: str = "dlda") -> DataFrame:
    """(keys, repeat, fold, t, auc): trained and tested at the same time."""
    return auc(linear_scorer(folded_rows(trial, fold, keys), [*keys, "repeat"], kind), [*keys, "repeat", "fold", "t"])


def _dense(entries: pa.StructArray, channels: np.ndarray, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The times of some entries (channel, t, values), and times x channels: which are there, and each value; other channels are left out."""
    value = lambda c: entries.field(c).to_numpy(zero_copy_only=False)
    channel = value("channel")
    column = np.minimum(np.searchsorted(channels, channel), len(channels) - 1)
    own = (channels[column] == channel) & np.all([~np.isnan(value(c).astype(float)) for c in names], axis=0)
    times, line = np.unique(value("t")[own], return_inverse=True)
    known, out = np.zeros((len(times), len(channels))), [np.zeros((len(times), len(channels))) for _ in names]
    known[line, column[own]] = 1
    for matrix, c in zip(out, names, strict=True):
        matrix[line, column[own]] = value(c)[own]
    return times, known, out


def crossed(folded: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fold, trial, y, t_train, t_test, score): each held-out trial at every time, by the weights of every time.

    A trial is one row with its samples, and a fold one row with its weights, so the join has a row for each trial and
    repeat; the scores are one matrix product for each. Samples without a weight for their channel add nothing.
    """
    own = [*keys, "fold"]
    trials = folded.groupBy(*own, "trial", "y").agg(F.collect_list(F.struct("channel", "t", "x")).alias("_x"))
    models = weights.groupBy(*own).agg(F.collect_list(F.struct("channel", "t", "w", "mid")).alias("_w"))
    both, types = trials.join(models, own), dict(folded.dtypes)
    names = [*own, "trial", "y"]
    schema = ", ".join(f"`{c}` {types[c]}" for c in names) + f", t_train {types['t']}, t_test array<{types['t']}>, score array<double>"

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index
            time = batch.schema.field("_x").type.value_type.field("t").type
            for k in range(len(batch)):
                samples, model = (batch.column(place(c))[k].values for c in ("_x", "_w"))
                channels = np.unique(model.field("channel").to_numpy(zero_copy_only=False))
                train, there, (w, mid) = _dense(model, channels, ["w", "mid"])
                test, known, (x,) = _dense(samples, channels, ["x"])
                scores, met = w @ x.T - (w * mid) @ known.T, there @ known.T > 0
                lines = [(t, test[m], s[m]) for t, m, s in zip(train, met, scores, strict=True) if m.any()]
                if lines:
                    columns = [batch.column(place(c)).take(pa.array([k] * len(lines))) for c in names]
                    kinds = [time, pa.list_(time), pa.list_(pa.float64())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array(list(v), kind) for v, kind in zip(zip(*lines, strict=True), kinds, strict=True))], [*names, "t_train", "t_test", "score"])

    scored = both.mapInArrow(products, schema)
    return scored.select(*names, "t_train", F.explode(F.arrays_zip("t_test", "score")).alias("s")).select(*names, "t_train", "s.t_test", "s.score")


def generalisation_matrix(trial: DataFrame, fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, repeat, fold, t_train, t_test, auc): weights of every time on the trials of every time."""
    rows, own = folded_rows(trial, fold, keys), [*keys, "repeat"]
    return auc(crossed(rows, fit(rows, own, ["channel", "t"]), own), [*own, "fold", "t_train", "t_test"])


def pipeline_features(folded: DataFrame, keys: Sequence[str], feature: Sequence[str]) -> DataFrame:
    """(keys, fold, feature, sd, m0, m1, within, mid, f, place, n): of each feature in a fold's training rows the scale, the classes' means
    and even variance, the one-way F, its place by F and the number of features.

    All come from the training sums (all folds' less the fold's own), so nothing of the held-out rows enters.
    """
    own = folded.groupBy(*keys, "fold", *feature).agg(*_sums())
    w = Window.partitionBy(*keys, *feature)
    rest = {c: F.sum(c).over(w) - F.coalesce(c, F.lit(0)) for c in ("n0", "s0", "q0", "n1", "s1", "q1")}
    t = own.select(*keys, "fold", *feature, *[v.alias(c) for c, v in rest.items()]).where("n0 > 0 and n1 > 0")
    n, mean = F.col("n0") + F.col("n1"), (F.col("s0") + F.col("s1")) / (F.col("n0") + F.col("n1"))
    variance = F.greatest(F.lit(0.0), (F.col("q0") + F.col("q1")) / n - mean * mean)
    t = t.withColumn("sd", F.when(variance > 1e-18, F.sqrt(variance)).otherwise(F.lit(1.0)))
    t = t.withColumn("m0", F.col("s0") / F.col("n0")).withColumn("m1", F.col("s1") / F.col("n1"))
    t = t.withColumn("v0", F.greatest(F.lit(0.0), F.col("q0") / F.col("n0") - F.col("m0") * F.col("m0"))).withColumn("v1", F.greatest(F.lit(0.0), F.col("q1") / F.col("n1") - F.col("m1") * F.col("m1")))
    inside = F.col("n0") * F.col("v0") + F.col("n1") * F.col("v1")
    between = F.col("n0") * F.pow(F.col("m0") - mean, 2) + F.col("n1") * F.pow(F.col("m1") - mean, 2)
    t = t.withColumn("f", F.when((n > 2) & (inside > 1e-18), between / (inside / (n - 2))))
    by = Window.partitionBy(*keys, "fold")
    return t.select(*keys, "fold", *feature, "sd", "m0", "m1", ((F.col("v0") + F.col("v1")) / 2).alias("within"), ((F.col("m0") + F.col("m1")) / 2).alias("mid"), "f", F.row_number().over(by.orderBy(F.col("f").desc_nulls_last(), *feature)).alias("place"), F.count(F.lit(1)).over(by).alias("n"))


def _pipeline_weight(shrink: Column | float) -> Column:
    """A feature's weight for unscaled values, which gives the scores of scaled ones."""
    spread = F.col("within") / (F.col("sd") * F.col("sd")) + (shrink if isinstance(shrink, Column) else F.lit(float(shrink)))
    return F.when(spread > 1e-18, (F.col("m1") - F.col("m0")) / F.col("sd") / spread).otherwise(F.lit(0.0)) / F.col("sd")


def pipeline_weights(folded: DataFrame, keys: Sequence[str], feature: Sequence[str], percentile: float = 15.0, shrink: Column | float = 0.0) -> DataFrame:
    """(keys, fold, feature, w, mid, f): a scaler, the features with the highest F, and a balanced model, all of a fold's training rows.

    Classes weigh the same in the spread. At least one feature stays.
    """
    best = pipeline_features(folded, keys, feature).where(F.col("place") <= F.ceil(F.col("n") * F.lit(percentile / 100.0)))
    return best.select(*keys, "fold", *feature, _pipeline_weight(shrink).alias("w"), "mid", "f")


def global_decode_pipeline(trial: DataFrame, fold: DataFrame, keys: Sequence[str], percentile: float = 15.0, shrink: float = 0.0) -> DataFrame:
    """(keys, repeat, fold, trial, y, score): scaler, selection and balanced model of each fold's training trials, on all channels and times."""
    rows, own = folded_rows(trial, fold, keys), [*keys, "repeat"]
    return scored(rows, pipeline_weights(rows, own, ["channel", "t"], percentile, shrink), own, ["channel", "t"])


def grid_search_pipeline(trial: DataFrame, fold: DataFrame, grid: Sequence[tuple[float, float]], keys: Sequence[str]) -> DataFrame:
    """(keys, percentile, shrink, auc): of some settings (percentile, shrink) the one with the best mean area over the folds, the first on ties.

    One plan: the training sums and the features' places serve all settings, a feature's weights are an array.
    """
    rows, own = folded_rows(trial, fold, keys), [*keys, "repeat"]
    features = pipeline_features(rows, own, ["channel", "t"])
    weight = [F.when(F.col("place") <= F.ceil(F.col("n") * F.lit(p / 100.0)), _pipeline_weight(shrink)).otherwise(F.lit(0.0)) for p, shrink in grid]
    weights = features.select(*own, "fold", "channel", "t", F.array(*weight).alias("w"), "mid")
    scores = scored_settings(rows, weights, own, ["channel", "t"], len(grid))
    return best_setting(scores, keys, [(float(p), float(s)) for p, s in grid], "percentile double, shrink double")


def grid_search_linear(trial: DataFrame, fold: DataFrame, settings: Sequence[tuple[float, str]], keys: Sequence[str], loss: str = "logistic", **options) -> DataFrame:
    """(keys, cost, penalty, auc): of some settings (cost, l1 or l2) of ``models.fit_linear`` at each time the one with the best mean area over folds and times.

    Each step of the fits reads the trials once for all settings.
    """
    rows, own = folded_rows(trial, fold, keys), [*keys, "repeat", "t"]
    each = models.fit_linear(rows, own, settings, loss=loss, **options)
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("setting", c))), lambda s: s[c]).alias(c)
    weights = each.groupBy(*own, "fold", "channel").agg(part("w"), part("plus"), F.first("mid").alias("mid"))
    scores = scored_settings(rows, weights, own, ["channel"], len(settings)).withColumn("fold", F.struct("fold", "t"))
    return best_setting(scores, keys, [(float(c), p) for c, p in settings], "cost double, penalty string")


def global_decode(trial: DataFrame, fold: DataFrame, keys: Sequence[str], shrink: float = 0.0) -> DataFrame:
    """(keys, repeat, fold, trial, y, score): one model on all channels and times for each fold."""
    rows, own = folded_rows(trial, fold, keys), [*keys, "repeat"]
    return scored(rows, fit(rows, own, ["channel", "t"], shrink), own, ["channel", "t"])


def leave_one_subject_out(trial: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, subject, t, auc): each subject's trials by weights of all other subjects; sums of all less its own."""
    rows = trial.withColumn("fold", F.col("subject"))
    scores = scored(rows, fit(rows, keys, ["channel", "t"]), keys, ["channel", "t"], ["t"])
    return auc(scores, [*keys, "fold", "t"]).withColumnRenamed("fold", "subject")


def class_weights(fold: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, repeat, fold, y, weight): n / (classes * count) in the training part of each fold; 1 with one class."""
    own = [*keys, "repeat"]
    n = fold.groupBy(*own, "fold", "y").agg(F.count(F.lit(1)).alias("c"))
    folds = fold.select(*own, "fold").distinct()
    total = fold.groupBy(*own, "y").agg(F.count(F.lit(1)).alias("all"))
    train = folds.join(total, own).join(n, [*own, "fold", "y"], "left").select(*own, "fold", "y", (F.col("all") - F.coalesce("c", F.lit(0))).alias("m")).where("m > 0")
    w = Window.partitionBy(*own, "fold")
    classes = F.count(F.lit(1)).over(w)
    return train.select(*own, "fold", "y", F.when(classes == 1, F.lit(1.0)).otherwise(F.sum("m").over(w) / (classes * F.col("m"))).alias("weight"))


def standardise(train: DataFrame, apply: DataFrame, keys: Sequence[str]) -> DataFrame:
    """z-scores by the training rows' mean and population deviation; ``keys`` name a feature. A constant one is only centred."""
    moments = train.groupBy(*keys).agg(F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"))
    return apply.join(moments, list(keys)).withColumn("x", (F.col("x") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(F.lit(1.0))).drop("_m", "_s")


def anova_f(train: DataFrame, keys: Sequence[str], y: str = "y") -> DataFrame:
    """(keys, f): one-way F of each feature."""
    by_class = train.groupBy(*keys, y).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = Window.partitionBy(*keys)
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    parts = by_class.withColumn("between", F.col("n") * F.pow(F.col("m") - grand, 2)).withColumn("within", F.col("n") * F.col("v"))
    sums = parts.groupBy(*keys).agg(F.sum("between").alias("b"), F.sum("within").alias("w"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    usable = (F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("w") > 0)
    return sums.select(*keys, F.when(usable, (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"))


def select_percentile(f: DataFrame, keys: Sequence[str], feature: Sequence[str], p: float) -> DataFrame:
    """The top ``p`` percent of features of each group by F, at least one."""
    w = Window.partitionBy(*keys)
    keep = F.ceil(F.count(F.lit(1)).over(w) * F.lit(p / 100.0))
    return f.withColumn("_k", F.row_number().over(w.orderBy(F.col("f").desc_nulls_last(), *feature))).withColumn("_n", keep).where("_k <= _n").drop("_k", "_n")


def pooled_predictions(prediction: DataFrame, keys: Sequence[str], pooling: str = "last") -> DataFrame:
    """(keys, trial, y, p, yhat): the last repeat's decision value of a trial, or the mean of all."""
    if pooling == "last":
        last = F.max_by("score", F.struct("repeat", "fold"))
    else:
        last = F.avg("score")
    return prediction.groupBy(*keys, "trial", "y").agg(last.alias("p")).withColumn("yhat", (F.col("p") > 0).cast("int"))


def class_metrics(prediction: DataFrame, keys: Sequence[str], average: str = "binary") -> DataFrame:
    """accuracy, precision, recall, f1, balanced accuracy; nothing to divide by gives 0."""
    hit = lambda y, h: F.sum(((F.col("y") == y) & (F.col("yhat") == h)).cast("long"))
    c = prediction.groupBy(*keys).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = div(tp, tp + fp), div(tp, tp + fn), div(tn, tn + fn), div(tn, tn + fp)
    f1, f0, n1, n0 = div(2 * tp, 2 * tp + fp + fn), div(2 * tn, 2 * tn + fp + fn), tp + fn, tn + fp
    mean = (lambda a, b: div(a * n1 + b * n0, n1 + n0)) if average == "weighted" else (lambda a, b: a)
    return c.select(*keys, div(tp + tn, tp + fp + fn + tn).alias("accuracy"), mean(p1, p0).alias("precision"), mean(r1, r0).alias("recall"), mean(f1, f0).alias("f1"), ((r1 + r0) / 2).alias("balanced_accuracy"))


def confusion_matrix(prediction: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = prediction.groupBy(*keys, "y", "yhat").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "y")))


def roc_curve(prediction: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, fpr, tpr) at each distinct score."""
    at = prediction.groupBy(*keys, "score").agg(F.sum((F.col("y") == 1).cast("long")).alias("p"), F.sum((F.col("y") == 0).cast("long")).alias("n"))
    parts = [F.lit(0)] if not keys else [F.col(k) for k in keys]
    w, up = Window.partitionBy(*parts), Window.partitionBy(*parts).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: F.when(F.sum(c).over(w) > 0, F.sum(c).over(up) / F.sum(c).over(w))
    return at.select(*keys, F.col("score").alias("threshold"), share("n").alias("fpr"), share("p").alias("tpr"))


def fold_mean_sd(score: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation over folds, missing ones left out."""
    return score.groupBy(*keys).agg(F.avg("auc").alias("mean_auc"), F.stddev_pop("auc").alias("sd_auc"))


def peak(score: DataFrame, keys: Sequence[str], value: str = "score") -> DataFrame:
    """(keys, peak, t_peak): the highest value and its first time."""
    top = score.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max(F.struct(value, (-F.col("t")).alias("u"))).alias("m"))
    return top.select(*keys, F.col(f"m.{value}").alias("peak"), (-F.col("m.u")).alias("t_peak"))


def stack_comparisons(score: DataFrame, min_curves: int = 2, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """(keys, t, mean, sem, n): over the curves of a subject, where there are enough."""
    g = score.groupBy(*keys, "t").agg(F.avg("auc").alias("mean"), (F.stddev_samp("auc") / F.sqrt(F.count("auc"))).alias("sem"), F.count("auc").alias("n"))
    return g.where(F.col("n") >= min_curves)


def anchor_average(score: DataFrame, family: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """(keys, anchor, t, mean, sem, n): over the comparisons that an anchor takes part in; family: (anchor, cmp)."""
    return score.join(F.broadcast(family), "cmp").groupBy(*keys, "anchor", "t").agg(F.avg("auc").alias("mean"), (F.stddev_samp("auc") / F.sqrt(F.count("auc"))).alias("sem"), F.count("auc").alias("n"))


def grid_search(trial: DataFrame, fold: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, shrink, auc): the shrinkage with the best mean area over the folds; the smaller one on ties. ``grid`` has a few settings."""
    shrinks = sorted(r["shrink"] for r in grid.select("shrink").distinct().collect())  # a few numbers
    rows, own = folded_rows(trial, fold, keys), [*keys, "repeat"]
    weight = F.array(*[_slope(F.col("within") + F.lit(float(s))) for s in shrinks])
    weights = class_moments(rows, own, ["channel", "t"]).select(*own, "fold", "channel", "t", weight.alias("w"), ((F.col("m0") + F.col("m1")) / 2).alias("mid"))
    return best_setting(scored_settings(rows, weights, own, ["channel", "t"], len(shrinks)), keys, [(float(s),) for s in shrinks], "shrink double")


def config_sweep(trial: DataFrame, config: DataFrame, keys: Sequence[str], repeats: int = 1) -> DataFrame:
    """(n_folds, step, keys, t, mean_auc, sd_auc) for each setting (n_folds, step): bins of ``step`` samples, then the sliding area."""
    binned = trial.crossJoin(F.broadcast(config)).withColumn("t", F.floor(F.col("t") / F.col("step")).cast("int"))
    own = ["n_folds", "step", *keys]
    rows = binned.groupBy(*own, "trial", "y", "channel", "t").agg(F.avg("x").alias("x"))
    folds = stratified_folds(rows, own, F.col("n_folds"), repeats)
    return fold_mean_sd(sliding_auc(rows, folds, own), [*own, "t"])


def group_run(trial: DataFrame, subject_group: DataFrame, grp: str, k: int, repeats: int = 1) -> DataFrame:
    """(subject, auc, processed) for every subject of a group: the mean of the global model's areas."""
    members = subject_group.where(F.col("grp") == grp).select("subject")
    rows = trial.join(members, "subject")
    scores = global_decode(rows, stratified_folds(rows, ["subject"], k, repeats), ["subject"])
    mean = auc(scores, ["subject", "repeat", "fold"]).groupBy("subject").agg(F.avg("auc").alias("auc"))
    return members.join(mean, "subject", "left").withColumn("processed", F.col("auc").isNotNull())
