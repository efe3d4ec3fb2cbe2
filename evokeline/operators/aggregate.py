"""Averages, spectra and connectivity.

Everything is grouped aggregation with the subject, condition, channel or band as keys: one plan serves all subjects, and
partial aggregation runs before each shuffle. Small tables (bands, regions, frequencies) are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def evoked_mean(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over trials and how many there were."""
    return df.groupBy(*keys).agg(F.avg("x").alias("x"), F.count("x").alias("n_ave"))


def evoked_difference(df: DataFrame, a: str | int, b: str | int, keys: Sequence[str], condition: str = "condition") -> DataFrame:
    """Mean of condition ``a`` less mean of ``b``, in one pass."""
    side = lambda v: F.avg(F.when(F.col(condition) == v, F.col("x")))
    return df.where(F.col(condition).isin(a, b)).groupBy(*keys).agg((side(a) - side(b)).alias("x"))


def grand_average(df: DataFrame, keys: Sequence[str], subject: str = "subject") -> DataFrame:
    """Mean over subjects of each subject's mean."""
    own = df.groupBy(subject, *keys).agg(F.avg("x").alias("x"))
    return own.groupBy(*keys).agg(F.avg("x").alias("x"), F.count("x").alias("n_subjects"))


def fourier_table(spark, n: int, sfreq: float, fmin: float, fmax: float, n_tapers: int) -> DataFrame:
    """(t, tapers: taper, freq, c, s): sine tapers times cosine and sine, a row for each sample of an epoch."""
    freqs = [k * sfreq / n for k in range(n // 2 + 1) if fmin <= k * sfreq / n <= fmax]
    rows = []
    for t in range(n):
        own = []
        for k in range(1, n_tapers + 1):
            h = math.sqrt(2 / (n + 1)) * math.sin(math.pi * k * (t + 1) / (n + 1))
            own += [(k, f, h * math.cos(2 * math.pi * f * t / sfreq), -h * math.sin(2 * math.pi * f * t / sfreq)) for f in freqs]
        rows.append((t, own))
    return spark.createDataFrame(rows, "t int, waves array<struct<taper:int,freq:double,c:double,s:double>>")


def spectrum(df: DataFrame, keys: Sequence[str], n: int, sfreq: float, fmin: float = 0.0, fmax: float = 45.0, n_tapers: int = 3) -> DataFrame:
    """(keys, taper, freq, re, im): the tapered Fourier sums of each channel of each trial."""
    waves = fourier_table(df.sparkSession, n, sfreq, fmin, fmax, n_tapers)
    long = df.join(F.broadcast(waves), "t").select(*keys, "x", F.explode("waves").alias("w"))
    return long.groupBy(*keys, F.col("w.taper").alias("taper"), F.col("w.freq").alias("freq")).agg(F.sum(F.col("x") * F.col("w.c")).alias("re"), F.sum(F.col("x") * F.col("w.s")).alias("im"))


def psd(df: DataFrame, keys: Sequence[str], n: int, sfreq: float, fmin: float = 0.0, fmax: float = 45.0, n_tapers: int = 3) -> DataFrame:
    """Power by frequency: the mean of the tapers' squared sums."""
    spec = spectrum(df, keys, n, sfreq, fmin, fmax, n_tapers)
    return spec.groupBy(*keys, "freq").agg((F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.lit(float(sfreq))).alias("power"))


def slepian_tapers(n: int, half_width: float = 2.5, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` sequences of ``n`` samples with most of their energy within ``half_width`` / n of the rate, and that share.

    They are the last eigenvectors of a symmetric tridiagonal matrix, which splits into halves for even and odd ones. Even ones
    have a positive mean, odd ones start upwards.
    """
    t, w = np.arange(n), half_width / n
    whole = np.diag(((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * math.pi * w))
    off = t[1:] * (n - t[1:]) / 2
    whole[t[1:], t[:-1]] = whole[t[:-1], t[1:]] = off
    half = n // 2
    mirror = np.zeros((n, n))
    mirror[:half, :half], mirror[n - half :, :half] = np.eye(half), np.eye(half)[::-1]
    mirror[:half, n - half :], mirror[n - half :, n - half :] = np.eye(half), -np.eye(half)[::-1]
    mirror /= math.sqrt(2)
    if n % 2:
        mirror[half, half] = 1
    found = []
    for side in (slice(0, n - half), slice(n - half, n)):
        values, vectors = np.linalg.eigh(mirror[:, side].T @ whole @ mirror[:, side])
        found += [(v, mirror[:, side] @ x) for v, x in zip(values[::-1], vectors.T[::-1], strict=True)]
    tapers = np.array([x for _, x in sorted(found, key=lambda p: -p[0])[:k]])
    for j, x in enumerate(tapers):
        lead = x.sum() if j % 2 == 0 else ((n - 1 - 2 * t) * x).sum()
        tapers[j] = x if lead > 0 else -x
    lags = np.array([[x[: n - m] @ x[m:] for m in range(n)] for x in tapers])
    sinc = 2 * w * np.sinc(2 * w * t)
    return tapers, np.clip(lags @ np.where(t == 0, sinc, 2 * sinc), 0, 1)


#: Rounds of the adaptive weights.
ADAPTIVE = 12


def multitaper_psd(df: DataFrame, keys: Sequence[str], n: int, sfreq: float, fmin: float = 0.0, fmax: float = 45.0, half_width: float = 2.5, n_tapers: int = 4, rounds: int = ADAPTIVE) -> DataFrame:
    """(keys, freq, power): spectra over Slepian tapers, weighed at each frequency so that broad-band leakage counts little.

    A taper's weight is the share of the power that it should have there, given the last estimate and the series' mean square;
    the estimate starts from the first two tapers and goes ``rounds`` times round. Tapers are a row for each sample of an epoch,
    as the sine ones of ``psd``; an epoch's sums are one pass, the rounds are a fold over its few tapers. Missing samples add nothing.
    """
    tapers, shares = slepian_tapers(n, half_width, n_tapers)
    freqs = [k * sfreq / n for k in range(n // 2 + 1) if fmin <= k * sfreq / n <= fmax]
    rows = [(t, [(k, f, float(h[t]) * math.cos(2 * math.pi * f * t / sfreq), -float(h[t]) * math.sin(2 * math.pi * f * t / sfreq)) for k, h in enumerate(tapers) for f in freqs]) for t in range(n)]
    waves = df.sparkSession.createDataFrame(rows, "t int, waves array<struct<taper:int,freq:double,c:double,s:double>>")
    own = df.groupBy(*keys).agg(F.avg(F.col("x") * F.col("x")).alias("_level"))
    long = df.join(F.broadcast(waves), "t").select(*keys, "x", F.explode("waves").alias("w"))
    spec = long.groupBy(*keys, F.col("w.taper").alias("taper"), F.col("w.freq").alias("freq")).agg((F.pow(F.sum(F.col("x") * F.col("w.c")), 2) + F.pow(F.sum(F.col("x") * F.col("w.s")), 2)).alias("e"))
    each = spec.groupBy(*keys, "freq").agg(F.transform(F.array_sort(F.collect_list(F.struct("taper", "e"))), lambda s: s["e"]).alias("_e")).join(own, list(keys))
    share = [float(x) for x in shares]
    total = lambda parts: sum(parts[1:], parts[0])
    e = lambda k: F.get("_e", F.lit(k))

    def better(s):
        weight = [F.pow(math.sqrt(x) * s / (x * s + (1 - x) * F.col("_level") + 1e-300), 2) for x in share]
        return total([w * e(k) for k, w in enumerate(weight)]) / (total(weight) + 1e-300)

    start = (e(0) + e(1)) / 2 if len(share) > 1 else e(0)
    return each.select(*keys, "freq", (F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: better(s)) / F.lit(float(sfreq))).alias("power"))


def band_power(psd_: DataFrame, band: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over channels and bins from lo up to, but not with, the last bin at or below hi."""
    bins = psd_.select("freq").distinct()
    bounds = bins.join(F.broadcast(band), F.col("freq") <= F.col("hi")).groupBy("band", "lo").agg(F.max("freq").alias("bound"))
    inside = psd_.join(F.broadcast(bounds), (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("bound")))
    return inside.groupBy(*keys, "band").agg(F.avg("power").alias("power"))


def relative_power(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("relative", F.col("power") / F.sum("power").over(Window.partitionBy(*keys)))


def subject_band_table(df: DataFrame, bands: Sequence[str], value: str = "power") -> DataFrame:
    """Subjects as rows, bands as columns."""
    return df.groupBy("subject").pivot("band", list(bands)).agg(F.avg(value))


def cross_spectrum(spec: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, freq, ch_i, ch_j, re, im) of each pair of channels i > j, summed over tapers."""
    on = [*keys, "taper", "freq"]
    i, j = spec.withColumnsRenamed({"channel": "ch_i", "re": "ri", "im": "ii"}), spec.withColumnsRenamed({"channel": "ch_j", "re": "rj", "im": "ij"})
    both = i.join(j, on).where("ch_i > ch_j")
    return both.groupBy(*keys, "freq", "ch_i", "ch_j").agg(F.sum(F.col("ri") * F.col("rj") + F.col("ii") * F.col("ij")).alias("re"), F.sum(F.col("ii") * F.col("rj") - F.col("ri") * F.col("ij")).alias("im"))


def wpli2_debiased(cross: DataFrame, band: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The debiased squared weighted phase-lag index over trials, then its mean over the bins of each band."""
    im = F.col("im")
    sums = cross.groupBy(*keys, "ch_i", "ch_j", "freq").agg(F.sum(im).alias("s"), F.sum(F.abs(im)).alias("a"), F.sum(im * im).alias("q"))
    below = F.col("a") * F.col("a") - F.col("q")
    index = sums.withColumn("value", F.when(F.abs(below) > 1e-300, (F.col("s") * F.col("s") - F.col("q")) / below))
    inside = index.join(F.broadcast(band), (F.col("freq") >= F.col("lo")) & (F.col("freq") < F.col("hi")))
    return inside.groupBy(*keys, "band", "ch_i", "ch_j").agg(F.avg("value").alias("value"))


def symmetrise(df: DataFrame, i: str = "ch_i", j: str = "ch_j", value: str = "value") -> DataFrame:
    """Each pair in both orders."""
    rest = [c for c in df.columns if c not in (i, j, value)]
    return df.select(*rest, i, j, value).unionByName(df.select(*rest, F.col(j).alias(i), F.col(i).alias(j), value))


def roi_mean(conn: DataFrame, roi: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean over the channel pairs between two different regions, in both orders."""
    both = symmetrise(conn)
    a, b = roi.select(F.col("roi").alias("roi_a"), F.col("channel").alias("ch_i")), roi.select(F.col("roi").alias("roi_b"), F.col("channel").alias("ch_j"))
    return both.join(F.broadcast(a), "ch_i").join(F.broadcast(b), "ch_j").where("roi_a <> roi_b").groupBy(*keys, "roi_a", "roi_b").agg(F.avg("value").alias("value"))


def conn_subject_band(epoch: DataFrame, roi: DataFrame, band: DataFrame, n: int, sfreq: float, keys: Sequence[str] = ("subject", "event")) -> DataFrame:
    """Regional connectivity of every subject, event and band, in one plan."""
    spec = spectrum(epoch, [*keys, "trial", "channel"], n, sfreq, n_tapers=1, fmax=sfreq / 2)
    value = wpli2_debiased(cross_spectrum(spec, [*keys, "trial"]), band, keys)
    return roi_mean(value, roi, [*keys, "band"])


def average_over_events(conn: DataFrame, keys: Sequence[str] = ("subject", "ch_i", "ch_j")) -> DataFrame:
    return conn.groupBy(*keys).agg(F.avg("value").alias("value"))


def window_means(score: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean score in each named window, with both ends."""
    return score.join(F.broadcast(windows), F.col("t").between(F.col("t0"), F.col("t1"))).groupBy(*keys, "window").agg(F.avg("score").alias("score"))


def group_curve(score: DataFrame, by: Sequence[str] = ("grp", "t")) -> DataFrame:
    """Mean, standard error by the population deviation, and n."""
    return score.groupBy(*by).agg(F.avg("score").alias("mean"), (F.stddev_pop("score") / F.sqrt(F.count("score"))).alias("sem"), F.count("score").alias("n"))


def sample_sem(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Standard error by the sample deviation, missing values left out; null for fewer than two."""
    v = F.nanvl(F.col(value), F.lit(None))
    return df.groupBy(*keys).agg(F.when(F.count(v) > 1, F.stddev_samp(v) / F.sqrt(F.count(v))).alias("sem"), F.count(v).alias("n"))


def matrix_group_mean(tgm_score: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over folds, then over subjects, of each (t_train, t_test)."""
    own = tgm_score.groupBy(*keys, "subject", "t_train", "t_test").agg(F.avg("auc").alias("auc"))
    return own.groupBy(*keys, "t_train", "t_test").agg(F.avg("auc").alias("auc"), F.count("auc").alias("n"))


def crop_axis(score: DataFrame, t0: float, t1: float, fill: float = 0.5, keys: Sequence[str] = ("subject",), most: int | None = None) -> DataFrame:
    """Times in ms (seconds are taken where no time of a subject reaches 100), cropped; missing scores filled."""
    w = Window.partitionBy(*keys)
    ms = F.when(F.max(F.abs("t")).over(w) < 100, F.col("t") * 1000).otherwise(F.col("t")).cast("double")
    out = score.withColumn("t_ms", ms).where(F.col("t_ms").between(t0, t1)).withColumn("score", F.coalesce(F.nanvl("score", F.lit(None)), F.lit(fill)))
    return out.withColumn("_k", F.row_number().over(w.orderBy("t_ms"))).where(F.col("_k") <= most).drop("_k") if most else out


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, the farthest values within 1.5 ranges of the box, and n."""
    q = df.groupBy(*keys).agg(F.percentile(value, 0.25).alias("q1"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.75).alias("q3"), F.count(value).alias("n"))
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, list(keys)).where((F.col(value) >= lo) & (F.col(value) <= hi))
    return inside.groupBy(*keys, "q1", "median", "q3", "n").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def grid_pivot(sweep: DataFrame, value: str, rates: Sequence) -> DataFrame:
    """Fold counts as rows, rates as columns."""
    return sweep.groupBy("n_folds").pivot("rate", list(rates)).agg(F.avg(value))


def grid_summary(sweep: DataFrame) -> DataFrame:
    """Mean, deviation and its ratio over the grid, by rate, by fold count and in all, with the best and steadiest cell."""
    key = F.struct((-F.col("mean_auc")).alias("m"), "n_folds", "rate")
    steady = F.struct(F.col("sd_auc").alias("m"), "n_folds", "rate")
    out = sweep.groupingSets([["rate"], ["n_folds"], []], "rate", "n_folds").agg(F.avg("mean_auc").alias("mean"), F.stddev_pop("mean_auc").alias("sd"), F.min(key).alias("b"), F.min(steady).alias("s"))
    cell = lambda c: F.concat_ws("/", F.col(f"{c}.n_folds"), F.col(f"{c}.rate"))
    return out.select("rate", "n_folds", "mean", "sd", (F.col("sd") / F.col("mean")).alias("cv"), cell("b").alias("best"), cell("s").alias("steadiest"))


def top_settings(sweep: DataFrame, by: str, k: int = 5) -> DataFrame:
    return sweep.orderBy(F.col(by).desc(), "n_folds", "rate").limit(k)
