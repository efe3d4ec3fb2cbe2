"""Continuous signals and trials: channels, filters, epochs, rejection and ocular artefacts.

Samples are rows (keys, channel, sample or t, x). Windows and groups run within one channel or one time of one recording.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def bipolar_channel(df: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("subject", "sample")) -> DataFrame:
    """A derived channel for each row (derived, plus, minus) of ``pairs``, as a weighted sum: no self-join."""
    weights = pairs.select("derived", F.explode(F.array(F.struct(F.col("plus").alias("channel"), F.lit(1.0).alias("w")), F.struct(F.col("minus").alias("channel"), F.lit(-1.0).alias("w")))).alias("p")).select("derived", "p.*")
    both = df.join(F.broadcast(weights), "channel").groupBy(*keys, "derived").agg(F.sum(F.col("w") * F.col("x")).alias("x"), F.count_distinct("channel").alias("_n"))
    return both.where("_n = 2").select(*keys, F.col("derived").alias("channel"), "x")


def average_reference(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The mean over the channels of each time taken off; ``keys`` name one time of one trial."""
    return df.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy(*keys)))


def channel_roles(df: DataFrame, role: DataFrame, keep: Sequence[str] = ("eeg",)) -> DataFrame:
    """Channels renamed and typed by ``role`` (channel, new_name, kind); only kinds in ``keep`` stay."""
    named = df.join(F.broadcast(role.where(F.col("kind").isin(*keep))), "channel")
    return named.withColumn("channel", F.coalesce("new_name", F.col("channel").cast("string"))).drop("new_name")


def interpolate_bad(df: DataFrame, bad: DataFrame, position: DataFrame, power: float = 2.0, keys: Sequence[str] = ("subject", "trial", "t")) -> DataFrame:
    """Bad channels (subject, channel) replaced by the mean of good ones, weighed by inverse distance."""
    a, b = position.withColumnsRenamed({"channel": "target", "px": "ax", "py": "ay", "pz": "az"}), position
    distance = F.sqrt(F.pow(F.col("px") - F.col("ax"), 2) + F.pow(F.col("py") - F.col("ay"), 2) + F.pow(F.col("pz") - F.col("az"), 2))
    weights = a.join(b, F.col("target") != F.col("channel")).select("target", "channel", F.pow(distance, F.lit(-float(power))).alias("w"))  # channels squared
    good = df.join(bad, ["subject", "channel"], "left_anti")
    pairs = bad.withColumnRenamed("channel", "target").join(F.broadcast(weights), "target")
    filled = good.join(pairs, ["subject", "channel"]).groupBy(*keys, "target").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    return good.select(*keys, "channel", "x").unionByName(filled.withColumnRenamed("target", "channel").select(*keys, "channel", "x"))


def legendre_series(cosine: np.ndarray, stiffness: int, terms: int) -> np.ndarray:
    """The sum over n of (2 n + 1) / (n (n + 1))^stiffness P_n(cosine) / 4 pi, by the recurrence of the polynomials."""
    before, now, out = np.ones_like(cosine), cosine.copy(), np.zeros_like(cosine)
    for n in range(1, terms + 1):
        out += (2 * n + 1) / (n * (n + 1.0)) ** stiffness * now
        before, now = now, ((2 * n + 1) * cosine * now - n * before) / (n + 1)
    return out / (4 * math.pi)


def spline_weights(good: np.ndarray, bad: np.ndarray, stiffness: int = 4, terms: int = 50, smooth: float = 1e-5) -> np.ndarray:
    """Bad x good channels: the spherical spline through the good ones, read at the bad ones; rows of places, taken to the unit sphere."""
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    g, b, n = unit(good), unit(bad), len(good)
    system = np.ones((n + 1, n + 1))
    system[:n, :n] = legendre_series(np.clip(g @ g.T, -1, 1), stiffness, terms) + smooth * np.eye(n)
    system[n, n] = 0
    read = np.column_stack([legendre_series(np.clip(b @ g.T, -1, 1), stiffness, terms), np.ones(len(bad))])
    return (read @ np.linalg.pinv(system))[:, :n]


def set_weights(sets: DataFrame, position: DataFrame, stiffness: int = 4, terms: int = 50, smooth: float = 1e-5) -> DataFrame:
    """(_set, target, channel, w): the spline's weights for each distinct set ``_set`` of bad channels, each solved once."""
    places = {r["channel"]: (r["px"], r["py"], r["pz"]) for r in position.select("channel", "px", "py", "pz").collect()}  # channels
    names, kind = sorted(places), dict(position.dtypes)["channel"]

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for own in pdf["_set"]:
                out, rest = [c for c in names if c in set(own)], [c for c in names if c not in set(own)]
                if rest:
                    w = spline_weights(np.array([places[c] for c in rest], float), np.array([places[c] for c in out], float), stiffness, terms, smooth)
                    rows += [(list(own), t, c, float(w[i, j])) for i, t in enumerate(out) for j, c in enumerate(rest)]
            yield pd.DataFrame(rows, columns=["_set", "target", "channel", "w"])

    return sets.select("_set").distinct().mapInPandas(solved, f"_set array<{kind}>, target {kind}, channel {kind}, w double")


def interpolate_spline(df: DataFrame, bad: DataFrame, position: DataFrame, keys: Sequence[str] = ("subject", "trial", "t"), stiffness: int = 4, terms: int = 50, smooth: float = 1e-5) -> DataFrame:
    """Bad channels (subject, channel) read off a spherical spline through the subject's good ones; position: (channel, px, py, pz).

    Each distinct set of bad channels has its weights solved once, in one row; subjects get them by their set. A repaired value is a
    weighted sum: samples are joined by channel and added up, none is gathered. Channels without a place stay as they are and
    repair nothing; bad ones without a place go. Missing values of good channels count as zero. The montage is a small table.
    """
    sets = bad.join(F.broadcast(position.select("channel")), "channel").groupBy("subject").agg(F.array_sort(F.collect_set("channel")).alias("_set"))
    weights = set_weights(sets, position, stiffness, terms, smooth)
    good = df.join(bad.select("subject", "channel").distinct(), ["subject", "channel"], "left_anti")
    pairs = sets.join(weights, "_set").drop("_set")
    filled = good.join(pairs, ["subject", "channel"]).groupBy(*keys, "target").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return good.select(*keys, "channel", "x").unionByName(filled.withColumnRenamed("target", "channel").select(*keys, "channel", "x"))


def sinc_kernel(taps: int, low: float | None, high: float | None, sfreq: float) -> list[float]:
    """A windowed-sinc kernel (Hamming): low-pass at ``high`` less low-pass at ``low``, both in Hz."""
    half = taps // 2

    def low_pass(cut: float) -> list[float]:
        f = cut / sfreq
        h = [2 * f * (1.0 if k == 0 else math.sin(2 * math.pi * f * k) / (2 * math.pi * f * k)) * (0.54 + 0.46 * math.cos(math.pi * k / max(1, half))) for k in range(-half, half + 1)]
        return [x / sum(h) for x in h]

    top = low_pass(high) if high else [1.0 if k == 0 else 0.0 for k in range(-half, half + 1)]
    return [a - b for a, b in zip(top, low_pass(low), strict=True)] if low else top


def notch_kernel(taps: int, freqs: Sequence[float], width: float, sfreq: float) -> list[float]:
    """A centred kernel that takes out ``width`` Hz around each of some frequencies (mains and its harmonics)."""
    kernel = [1.0 if k == taps // 2 else 0.0 for k in range(2 * (taps // 2) + 1)]
    for f in freqs:
        band = sinc_kernel(taps, f - width / 2, f + width / 2, sfreq)
        kernel = [a - b for a, b in zip(kernel, band, strict=True)]
    return kernel


def fir_filter(df: DataFrame, keys: Sequence[str], kernel: Sequence[float], zero_phase: bool = True, order: str = "sample") -> DataFrame:
    """``x`` convolved with a centred kernel within each channel, forwards and (zero_phase) backwards; zeros where no sample is.

    Samples lie in chunks by their number, and those near a chunk's border also in the next one, so a recording of any
    length is many groups. Rows come sorted by group; the groups of a batch stand in one array, with zeros between them, and
    are convolved at once, whatever their number and the kernel's length. Columns other than the keys, the order and ``x`` go.
    """
    half, size = len(kernel) // 2, max(8192, 16 * len(kernel))
    reach = 2 * half if zero_phase else half
    at = F.col(order).cast("long")
    own = df.select(*keys, F.col(order), F.col("x").cast("double").alias("x"), F.explode(F.sequence(F.floor((at - reach) / size), F.floor((at + reach) / size))).alias("_chunk"))
    group, taps, types = [*keys, "_chunk"], np.asarray(kernel, float), dict(own.dtypes)

    def starts(pdf: pd.DataFrame) -> np.ndarray:
        before = pdf[group].shift()
        new = ((pdf[group] != before) & ~(pdf[group].isna() & before.isna())).any(axis=1).to_numpy()
        new[:1] = True
        return np.flatnonzero(new)

    def passed(pdf: pd.DataFrame) -> pd.DataFrame:
        first, place = starts(pdf), pdf[order].to_numpy(np.int64)
        low, high = place[first], place[np.append(first[1:], len(pdf)) - 1]
        width = high - low + 1 + 2 * half
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pdf))))
        cell = (np.cumsum(width) - width + half - low)[number] + place
        there, x = np.zeros(width.sum()), np.zeros(width.sum())
        there[cell], x[cell] = 1, pdf["x"].fillna(0.0)
        x = convolved(x, taps) * there
        x = convolved(x, taps[::-1]) if zero_phase else x
        core = place // size == pdf["_chunk"].to_numpy(np.int64)
        out = pdf.loc[core, [*keys, order]]
        out["x"] = x[cell[core]]
        return out

    def sorted_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf])
            pdf = pdf.reset_index(drop=True)
            if len(pdf):
                last = starts(pdf)[-1]  # it may go on in the next batch
                rest = pdf[last:]
                if last:
                    yield passed(pdf[:last].reset_index(drop=True))
        if rest is not None:
            yield passed(rest.reset_index(drop=True))

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*keys, order)) + ", x double"
    return own.repartition(*group).sortWithinPartitions(*group, order).mapInPandas(sorted_groups, schema)


def convolved(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """The sum over taps h(o) x(k + o - half), as long as ``x``; by transforms for long kernels."""
    flipped = taps[::-1]
    if len(taps) < 256:
        whole = np.convolve(x, flipped)
    else:
        n = 1 << (len(x) + len(taps) - 2).bit_length()
        whole = np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(flipped, n), n)
    return whole[len(taps) // 2 : len(taps) // 2 + len(x)]


def resample_bins(df: DataFrame, keys: Sequence[str], sfreq_in: float, sfreq_out: float, order: str = "sample") -> DataFrame:
    """Means of tumbling bins; nothing changes if the rate asked for isn't lower."""
    if sfreq_out >= sfreq_in:
        return df
    bin_ = F.floor(F.col(order) * F.lit(sfreq_out) / F.lit(sfreq_in)).cast("long")
    return df.groupBy(*keys, bin_.alias(order)).agg(F.avg("x").alias("x"))


def resampling_kernel(up: int, down: int, reach: int = 10) -> np.ndarray:
    """A centred low-pass (windowed sinc, Kaiser 5) at the lower of both Nyquist frequencies, for ``up`` samples between two; its phases sum to 1 on average."""
    half = reach * max(up, down)
    k = np.arange(-half, half + 1)
    h = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    return h * (up / h.sum())


def resample_poly(df: DataFrame, keys: Sequence[str], up: int, down: int, order: str = "sample", kernel: Sequence[float] | None = None, size: int = 8192) -> DataFrame:
    """``x`` at ``up / down`` of its rate, without aliases: the sum over samples of x(k) h(m * down - k * up) for each new sample m.

    New samples lie in chunks of ``size`` by their number, and a sample goes to each chunk that it reaches, so a recording of any
    length is many groups; in a chunk each phase of the kernel is one product. Samples that aren't there or have no value
    count as zero; a new sample exists where the one at or just before its time does. Doubled samples add up. The rates' common
    factor is taken out. Columns other than the keys, the order and ``x`` go.
    """
    common = math.gcd(up, down)
    up, down = up // common, down // common
    taps = np.asarray(resampling_kernel(up, down) if kernel is None else kernel, float)
    half = len(taps) // 2
    at = F.col(order).cast("long")
    lowest, highest = F.ceil((at * up - half) / down), F.floor((at * up + half) / down)
    # the sample also goes where new samples take it for the one before them
    last = F.greatest(highest, F.floor((at * up + up - 1) / down))
    first = F.least(lowest, F.ceil(at * up / down))
    own = df.select(*keys, at.alias(order), F.col("x").cast("double").alias("x"), F.explode(F.sequence(F.floor(first / size), F.floor(last / size))).alias("_chunk"))
    types = dict(own.dtypes)
    reach = half // up + 1

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        chunk, place = int(pdf["_chunk"].iloc[0]), pdf[order].to_numpy(np.int64)
        m = np.arange(chunk * size, (chunk + 1) * size)
        base, phase = np.floor_divide(m * down, up), np.mod(m * down, up)
        low = min(int(place.min()), int(base[0])) - reach
        x, there = np.zeros(max(int(place.max()), int(base[-1])) + reach - low + 1), np.zeros(max(int(place.max()), int(base[-1])) + reach - low + 1, bool)
        np.add.at(x, place - low, pdf["x"].fillna(0.0).to_numpy())
        there[place - low] = True
        y = np.zeros(size)
        for p in range(up):
            new = np.flatnonzero(phase == p)
            for j in range(-reach, reach + 1):  # sample base + j stands j * up - p after the new one
                tap = half + p - j * up
                if 0 <= tap < len(taps):
                    y[new] += taps[tap] * x[base[new] + j - low]
        kept = there[base - low]
        out = pd.DataFrame({order: m[kept], "x": y[kept]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, order, "x"]]

    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + f"`{order}` long, x double"
    return own.groupBy(*keys, "_chunk").applyInPandas(one, schema)  # a chunk and what reaches into it


def epoch_extract(recording: DataFrame, event: DataFrame, tmin: int, tmax: int, bucket: int | None = None) -> DataFrame:
    """Samples from onset + tmin to onset + tmax of each event, with ``t`` relative to the onset.

    An interval join as an equi-join: samples lie in buckets, events are repeated for the buckets that they touch.
    """
    width = bucket or max(1, tmax - tmin + 1)
    lo, hi = F.floor((F.col("onset") + tmin) / width), F.floor((F.col("onset") + tmax) / width)
    touched = event.select("*", F.explode(F.sequence(lo, hi)).alias("_bucket"))
    samples = recording.withColumn("_bucket", F.floor(F.col("sample") / width))
    joined = samples.join(touched, ["subject", "_bucket"]).where((F.col("sample") >= F.col("onset") + tmin) & (F.col("sample") <= F.col("onset") + tmax))
    return joined.withColumn("t", F.col("sample") - F.col("onset")).drop("_bucket")


def baseline_correct(df: DataFrame, keys: Sequence[str], b0: float | None, b1: float | None) -> DataFrame:
    """The mean over b0 <= t <= b1 taken off; None is the start or the end of the epoch."""
    inside = (F.lit(True) if b0 is None else F.col("t") >= b0) & (F.lit(True) if b1 is None else F.col("t") <= b1)
    return df.withColumn("x", F.col("x") - F.avg(F.when(inside, F.col("x"))).over(Window.partitionBy(*keys)))


def detrend(df: DataFrame, keys: Sequence[str], order: int) -> DataFrame:
    """The mean (0) or the line (1) over ``t`` taken off."""
    w = Window.partitionBy(*keys)
    if order == 0:
        return df.withColumn("x", F.col("x") - F.avg("x").over(w))
    slope = F.covar_pop("x", "t").over(w) / F.var_pop("t").over(w)
    fitted = df.withColumn("_slope", F.coalesce(slope, F.lit(0.0))).withColumn("_mx", F.avg("x").over(w)).withColumn("_mt", F.avg("t").over(w))
    return fitted.withColumn("x", F.col("x") - F.col("_mx") - F.col("_slope") * (F.col("t") - F.col("_mt"))).drop("_slope", "_mx", "_mt")


def peak_to_peak(df: DataFrame, keys: Sequence[str] = ("subject", "trial")) -> DataFrame:
    return df.groupBy(*keys, "channel").agg((F.max("x") - F.min("x")).alias("ptp"))


def reject_ptp(df: DataFrame, limits: DataFrame, keys: Sequence[str] = ("subject", "trial")) -> DataFrame:
    """Trials of which no channel's range exceeds its limit (channel, ptp_limit)."""
    bad = peak_to_peak(df, keys).join(F.broadcast(limits), "channel").where("ptp > ptp_limit").select(*keys).distinct()
    return df.join(bad, list(keys), "left_anti")


def drop_log(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("subject",), trial: str = "trial") -> DataFrame:
    """Trials before and after a rejection, and how many were dropped, by ``keys``."""
    n = before.groupBy(*keys).agg(F.count_distinct(trial).alias("n_before"))
    m = after.groupBy(*keys).agg(F.count_distinct(trial).alias("n_after"))
    return n.join(m, list(keys), "left").withColumn("n_after", F.coalesce("n_after", F.lit(0))).withColumn("n_dropped", F.col("n_before") - F.col("n_after"))


def tumbling_epochs(df: DataFrame, start: DataFrame, size_s: float = 10.0, n: int = 60, sfreq: float = 1.0, default_start: float = 60.0) -> DataFrame:
    """Adds ``epoch``, the number of the window after the subject's start (subject, t_start); rows outside go."""
    second = F.col("sample") / F.lit(float(sfreq))
    timed = df.join(start, "subject", "left").withColumn("epoch", F.floor((second - F.coalesce("t_start", F.lit(default_start))) / F.lit(float(size_s))))
    return timed.where((F.col("epoch") >= 0) & (F.col("epoch") < n)).drop("t_start")


def blink_detect(df: DataFrame, channel: str, threshold: float, refractory: int, min_count: int) -> DataFrame:
    """Local maxima over the threshold; those within ``refractory`` samples of the one before are one blink.

    (subject, blink, sample, peak) of subjects with at least ``min_count`` blinks; the highest sample, then the first.
    """
    w = Window.partitionBy("subject").orderBy("sample")
    own = df.where(F.col("channel") == channel)
    near = own.withColumn("_a", F.lag("x").over(w)).withColumn("_b", F.lead("x").over(w))
    peaks = near.where((F.col("x") > threshold) & (F.col("x") > F.coalesce("_a", F.lit(float("-inf")))) & (F.col("x") >= F.coalesce("_b", F.lit(float("-inf")))))
    gap = F.col("sample") - F.lag("sample").over(w)
    runs = peaks.withColumn("_new", F.when(gap <= refractory, 0).otherwise(1)).withColumn("blink", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.groupBy("subject", "blink").agg(F.max(F.struct("x", (-F.col("sample")).alias("s"))).alias("top")).select("subject", "blink", (-F.col("top.s")).alias("sample"), F.col("top.x").alias("peak"))
    return found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("subject"))).where(F.col("_n") >= min_count).drop("_n")


def _beside(df: DataFrame, eog: str, on: Sequence[str]) -> DataFrame:
    """Every channel's samples with the ocular channel's sample of the same time."""
    ocular = df.where(F.col("channel") == eog).select(*on, F.col("x").alias("eog"))
    return df.where(F.col("channel") != eog).join(ocular, list(on))


def eog_component_score(df: DataFrame, eog: str | int, z: float = 3.0, on: Sequence[str] = ("subject", "trial", "t")) -> DataFrame:
    """(subject, channel, score, z, bad): correlation with the ocular channel and whether it stands out."""
    scores = _beside(df, eog, on).groupBy("subject", "channel").agg(F.corr("x", "eog").alias("score"))
    w = Window.partitionBy("subject")
    scored = scores.withColumn("z", (F.col("score") - F.avg("score").over(w)) / F.stddev_pop("score").over(w))
    return scored.withColumn("bad", F.coalesce(F.abs("z") > z, F.lit(False)))


def eog_regress_out(df: DataFrame, eog: str | int, on: Sequence[str] = ("subject", "trial", "t")) -> DataFrame:
    """Each channel less its regression on the ocular channel."""
    both = _beside(df, eog, on)
    slope = both.groupBy("subject", "channel").agg(F.regr_slope("x", "eog").alias("_b"))
    return both.join(slope, ["subject", "channel"]).withColumn("x", F.col("x") - F.coalesce("_b", F.lit(0.0)) * F.col("eog")).drop("_b", "eog")


def auto_threshold(ptp: DataFrame, candidates: DataFrame, folds: int, keys: Sequence[str] = ("subject", "channel"), fold: Column | None = None) -> DataFrame:
    """(keys, threshold, cost): the candidate whose kept training trials' mean range is nearest the held-out median."""
    dealt = ptp.withColumn("fold", fold if fold is not None else F.pmod(F.col("trial"), F.lit(folds)))
    tests = dealt.groupBy(*keys, "fold").agg(F.percentile("ptp", 0.5).alias("middle")).withColumnRenamed("fold", "held")
    kept = dealt.crossJoin(F.broadcast(candidates)).where("ptp <= threshold").groupBy(*keys, "threshold", "fold").agg(F.sum("ptp").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = kept.groupBy(*keys, "threshold").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    trains = tests.join(whole, list(keys)).join(kept.withColumnRenamed("fold", "held"), [*keys, "threshold", "held"], "left")
    left_n = F.col("n_all") - F.coalesce("n", F.lit(0))
    cost = F.abs((F.col("s_all") - F.coalesce("s", F.lit(0.0))) / left_n - F.col("middle"))
    costs = trains.where(left_n > 0).groupBy(*keys, "threshold").agg(F.avg(cost).alias("cost"))
    return costs.groupBy(*keys).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "threshold")).alias("m")).select(*keys, F.col("m.threshold").alias("threshold"), F.col("m.cost").alias("cost"))


def consensus_reject(ptp: DataFrame, thresholds: DataFrame, consensus: float, keys: Sequence[str] = ("subject", "channel"), trial: Sequence[str] = ("subject", "trial")) -> DataFrame:
    """(trial keys, share_bad, dropped): whether a larger share of channels than ``consensus`` is above its threshold."""
    shares = ptp.join(thresholds, list(keys)).groupBy(*trial).agg(F.avg((F.col("ptp") > F.col("threshold")).cast("double")).alias("share_bad"))
    return shares.withColumn("dropped", F.col("share_bad") > consensus)


def rejection_grid(ptp: DataFrame, thresholds: DataFrame, n_interpolate: Sequence[int], consensus: Sequence[float], folds: int, keys: Sequence[str] = ("subject", "channel"), fold: Column | None = None) -> DataFrame:
    """(subject, n_interpolate, consensus, cost, n_kept): the setting that repairs and drops best, by cross-validation.

    A trial goes if a larger share of its channels than ``consensus`` is above the threshold; of the others the worst
    ``n_interpolate`` channels above it are repaired, the rest stay as they are. The cost of a fold is the distance of the
    mean range of what stays in the other folds from the fold's median, and a setting's cost the mean over channels and
    folds. Settings that keep nothing have none; ties go to the smaller values.
    """
    subject, trial = keys[0], "trial"
    dealt = ptp.withColumn("fold", fold if fold is not None else F.pmod(F.col(trial), F.lit(folds)))
    above = dealt.join(thresholds.select(*keys, "threshold"), list(keys)).withColumn("over", F.col("ptp") > F.col("threshold"))
    one = Window.partitionBy(subject, trial)
    ranked = above.withColumn("share", F.avg(F.col("over").cast("double")).over(one)).withColumn("worst", F.row_number().over(one.orderBy(F.col("over").desc(), F.col("ptp").desc(), keys[1])))
    settings = F.explode(F.array(*[F.struct(F.lit(n).alias("n_interpolate"), F.lit(float(c)).alias("consensus")) for n in n_interpolate for c in consensus])).alias("s")
    kept = ranked.select("*", settings).select("*", "s.*").where("share <= consensus and not (over and worst <= n_interpolate)")  # a few settings
    sums = kept.groupBy(*keys, "n_interpolate", "consensus", "fold").agg(F.sum("ptp").alias("s"), F.count(F.lit(1)).alias("n"))
    middle = dealt.groupBy(*keys, "fold").agg(F.percentile("ptp", 0.5).alias("middle"))
    whole = sums.groupBy(*keys, "n_interpolate", "consensus").agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    tests = whole.join(middle, list(keys)).join(sums, [*keys, "n_interpolate", "consensus", "fold"], "left")
    left = F.col("n_all") - F.coalesce("n", F.lit(0))
    costs = tests.where(left > 0).withColumn("cost", F.abs((F.col("s_all") - F.coalesce("s", F.lit(0.0))) / left - F.col("middle")))
    mean = costs.groupBy(subject, "n_interpolate", "consensus").agg(F.round(F.avg("cost"), 9).alias("cost"), F.sum(F.coalesce("n", F.lit(0))).alias("n_kept"))
    best = mean.groupBy(subject).agg(F.min(F.struct("cost", "n_interpolate", "consensus", "n_kept")).alias("m"))
    return best.select(subject, "m.n_interpolate", "m.consensus", "m.cost", "m.n_kept")


def spline_residual(df: DataFrame, position: DataFrame, keys: Sequence[str] = ("subject", "trial"), order: str = "t") -> DataFrame:
    """(keys, channel, residual): how far each channel of a trial is from what a spline through all others says there, as the root of
    the mean square over that of the others' prediction; a channel that differs from its neighbours stands out."""
    each = set_weights(position.select(F.array("channel").alias("_set")), position).drop("_set")
    said = df.join(F.broadcast(each), "channel").groupBy(*keys, order, "target").agg(F.sum(F.col("w") * F.col("x")).alias("_said"))  # channels squared
    both = df.join(said.withColumnRenamed("target", "channel"), [*keys, order, "channel"])
    off = F.sqrt(F.avg(F.pow(F.col("x") - F.col("_said"), 2)) / (F.avg(F.col("_said") * F.col("_said")) + 1e-300))
    return both.groupBy(*keys, "channel").agg(off.alias("residual"))


def repaired_ranges(df: DataFrame, ranked: DataFrame, position: DataFrame, n_interpolate: Sequence[int], subject: str) -> DataFrame:
    """(subject, trial, channel, n_interpolate, range): of each trial the ranges of channels that are repaired, for each number of repairs."""
    marked = ranked.where("over").select(subject, "trial", "channel", "worst", F.explode(F.array(*[F.lit(n) for n in n_interpolate])).alias("n_interpolate")).where("worst <= n_interpolate")
    sets = marked.groupBy(subject, "trial", "n_interpolate").agg(F.array_sort(F.collect_set("channel")).alias("_set"))
    pairs = sets.join(set_weights(sets, position), "_set").drop("_set")
    filled = df.join(pairs, [subject, "trial", "channel"]).groupBy(subject, "trial", "n_interpolate", "target", "t").agg(F.sum(F.col("w") * F.col("x")).alias("x"))
    return filled.groupBy(subject, "trial", F.col("target").alias("channel"), "n_interpolate").agg((F.max("x") - F.min("x")).alias("range"))


def repair_grid(df: DataFrame, thresholds: DataFrame, position: DataFrame, n_interpolate: Sequence[int], consensus: Sequence[float], folds: int, subject: str = "subject", fold: Column | None = None) -> DataFrame:
    """(subject, n_interpolate, consensus, cost, n_kept): as ``rejection_grid``, with the repairs made.

    Of a trial that stays, the worst ``n_interpolate`` channels above their threshold are read off a spherical spline through its
    other channels, and their new ranges count in the cost. Each distinct set of bad channels is solved once, whatever the
    number of trials and settings that have it. ``df``: (subject, trial, channel, t, x); thresholds: (subject, channel, threshold).
    """
    ptp = peak_to_peak(df, (subject, "trial"))
    dealt = ptp.withColumn("fold", fold if fold is not None else F.pmod(F.col("trial"), F.lit(folds)))
    one = Window.partitionBy(subject, "trial")
    above = dealt.join(thresholds.select(subject, "channel", "threshold"), [subject, "channel"]).withColumn("over", F.col("ptp") > F.col("threshold"))
    ranked = above.withColumn("share", F.avg(F.col("over").cast("double")).over(one)).withColumn("worst", F.row_number().over(one.orderBy(F.col("over").desc(), F.col("ptp").desc(), "channel")))
    repaired = repaired_ranges(df, ranked, position, n_interpolate, subject)
    settings = F.explode(F.array(*[F.struct(F.lit(n).alias("n_interpolate"), F.lit(float(c)).alias("consensus")) for n in n_interpolate for c in consensus])).alias("s")
    kept = ranked.select("*", settings).select("*", "s.*").where("share <= consensus")  # a few settings
    ranges = kept.join(repaired, [subject, "trial", "channel", "n_interpolate"], "left").withColumn("ptp", F.coalesce("range", "ptp"))
    own = [subject, "channel", "n_interpolate", "consensus"]
    sums = ranges.groupBy(*own, "fold").agg(F.sum("ptp").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = sums.groupBy(*own).agg(F.sum("s").alias("s_all"), F.sum("n").alias("n_all"))
    middle = dealt.groupBy(subject, "channel", "fold").agg(F.percentile("ptp", 0.5).alias("middle"))
    tests = whole.join(middle, [subject, "channel"]).join(sums, [*own, "fold"], "left")
    left = F.col("n_all") - F.coalesce("n", F.lit(0))
    costs = tests.where(left > 0).withColumn("cost", F.abs((F.col("s_all") - F.coalesce("s", F.lit(0.0))) / left - F.col("middle")))
    mean = costs.groupBy(subject, "n_interpolate", "consensus").agg(F.round(F.avg("cost"), 9).alias("cost"), F.sum(F.coalesce("n", F.lit(0))).alias("n_kept"))
    return mean.groupBy(subject).agg(F.min(F.struct("cost", "n_interpolate", "consensus", "n_kept")).alias("m")).select(subject, "m.n_interpolate", "m.consensus", "m.cost", "m.n_kept")


def split_good_window(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """Only samples lo..hi of the subjects in ``overrides`` (subject, lo, hi); others stay whole."""
    both = df.join(overrides, "subject", "left")
    return both.where("lo is null or sample between lo and hi").drop("lo", "hi")
