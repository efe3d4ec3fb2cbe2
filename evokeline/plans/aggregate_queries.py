"""Queries of the averaging, spectral and connectivity operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate as A
from . import views as V
from .registry import query, rounded

BANDS = [("low", 5.0, 20.0), ("mid", 10.0, 40.0), ("high", 20.0, 50.0)]
BAND_SQL = "band(band, lo, hi) AS (VALUES " + ", ".join(f"('{b}', {lo}e0, {hi}e0)" for b, lo, hi in BANDS) + ")"
ROI = [("front", 0), ("front", 1), ("front", 2), ("mid", 3), ("mid", 4), ("back", 5), ("back", 6), ("back", 7)]
ROI_SQL = "roi(roi, channel) AS (VALUES " + ", ".join(f"('{r}', {c})" for r, c in ROI) + ")"
#: 8 samples an epoch at 80 Hz.
N, RATE = 8, 80.0


def bands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BANDS, "band string, lo double, hi double")


def rois(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROI, "roi string, channel int")


def trials(spark: SparkSession, d: str) -> DataFrame:
    return V.trial_long(spark, d).withColumn("event", F.when(F.col("label") < 5, "old").otherwise("new"))


@query("evoked_mean", V.sql("trial_long", "SELECT subject, label, channel, t, round(avg(x), 6) + 0 AS x, count(x) AS n_ave FROM trial_long GROUP BY 1, 2, 3, 4"))
def _mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.evoked_mean(trials(spark, d), ["subject", "label", "channel", "t"]), "x")


@query("evoked_difference", V.sql("trial_long", "SELECT subject, channel, t, round(avg(CASE WHEN label < 5 THEN x END) - avg(CASE WHEN label >= 5 THEN x END), 6) + 0 AS x FROM trial_long GROUP BY 1, 2, 3"))
def _difference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.evoked_difference(trials(spark, d), "old", "new", ["subject", "channel", "t"], "event"), "x")


@query("grand_average", V.sql("trial_long", "SELECT label, channel, t, round(avg(x), 6) + 0 AS x, count(x) AS n_subjects FROM (SELECT subject, label, channel, t, avg(x) AS x FROM trial_long GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"))
def _grand(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.grand_average(trials(spark, d), ["label", "channel", "t"]), "x")


def spec_sql(tapers: int, keys: str) -> str:
    h = f"sqrt(2e0 / {N + 1}) * sin(pi() * k * (t + 1) / {N + 1})"
    return f", tl AS (SELECT *, CASE WHEN label < 5 THEN 'old' ELSE 'new' END AS event FROM trial_long), spec AS (SELECT {keys}, k AS taper, f * {RATE}e0 / {N} AS freq, sum(x * {h} * cos(2 * pi() * f * t / {N})) AS re, sum(-x * {h} * sin(2 * pi() * f * t / {N})) AS im FROM tl CROSS JOIN (SELECT unnest(range(1, {tapers + 1})) AS k) CROSS JOIN (SELECT unnest(range(0, {N // 2 + 1})) AS f) GROUP BY ALL)"


PSD_SQL = spec_sql(3, "subject, trial, channel") + f", psd AS (SELECT subject, trial, channel, freq, avg(re * re + im * im) / {RATE}e0 AS power FROM spec GROUP BY 1, 2, 3, 4)"


def psd(spark: SparkSession, d: str) -> DataFrame:
    return A.psd(trials(spark, d), ["subject", "trial", "channel"], N, RATE)


@query("psd", V.sql("trial_long", PSD_SQL + " SELECT subject, trial, channel, freq, round(power, 6) AS power FROM psd"))
def _psd(spark: SparkSession, d: str) -> DataFrame:
    return rounded(psd(spark, d), "power")


WIDTH, TAPERS = 2.0, 3


def taper_sql() -> str:
    """Adaptive spectra over Slepian tapers, which stand there as values: s{n} after the n-th round."""
    tapers, shares = A.slepian_tapers(N, WIDTH, TAPERS)
    values = ", ".join(f"({k}, {t}, {float(tapers[k, t])!r}::DOUBLE)" for k in range(TAPERS) for t in range(N))
    own, by = ", ".join(f"({k}, {float(x)!r}::DOUBLE)" for k, x in enumerate(shares)), "subject, trial, channel"
    out = f""", h(k, t, h) AS (VALUES {values}), sh(k, l) AS (VALUES {own}), lv AS (SELECT {by}, avg(x * x) AS v FROM trial_long GROUP BY ALL),
 ek AS (SELECT {by}, k, f * {RATE}e0 / {N} AS freq, pow(sum(x * h * cos(2 * pi() * f * t / {N})), 2) + pow(sum(x * h * sin(2 * pi() * f * t / {N})), 2) AS e FROM trial_long JOIN h USING (t) CROSS JOIN (SELECT unnest(range(0, {N // 2 + 1})) AS f) GROUP BY ALL),
 s0 AS (SELECT {by}, freq, avg(e) AS s FROM ek WHERE k < 2 GROUP BY ALL)"""
    for r in range(A.ADAPTIVE):
        out += f""", w{r} AS (SELECT {by}, freq, e, pow(sqrt(l) * s / (l * s + (1 - l) * v + 1e-300), 2) AS w FROM ek JOIN sh USING (k) JOIN lv USING ({by}) JOIN s{r} USING ({by}, freq)), s{r + 1} AS MATERIALIZED (SELECT {by}, freq, sum(w * e) / (sum(w) + 1e-300) AS s FROM w{r} GROUP BY ALL)"""
    return out + f" SELECT {by}, freq, round(s / {RATE}e0, 6) AS power FROM s{A.ADAPTIVE} WHERE freq <= 45"


@query("multitaper_psd", V.sql("trial_long", taper_sql()))
def _multitaper(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.multitaper_psd(trials(spark, d), ["subject", "trial", "channel"], N, RATE, half_width=WIDTH, n_tapers=TAPERS), "power")


POWER_SQL = PSD_SQL + ", " + BAND_SQL + ", bound AS (SELECT band, lo, max(freq) AS bound FROM band JOIN (SELECT DISTINCT freq FROM psd) ON freq <= hi GROUP BY 1, 2), bp AS (SELECT subject, trial, band, avg(power) * 1000 AS power FROM psd JOIN bound ON freq >= lo AND freq < bound GROUP BY 1, 2, 3)"


def power(spark: SparkSession, d: str) -> DataFrame:
    return A.band_power(psd(spark, d), bands(spark), ["subject", "trial"]).withColumn("power", F.col("power") * 1000)


@query("band_power", V.sql("trial_long", POWER_SQL + " SELECT subject, trial, band, round(power, 6) AS power FROM bp"))
def _power(spark: SparkSession, d: str) -> DataFrame:
    return rounded(power(spark, d), "power")


@query("relative_power", V.sql("trial_long", POWER_SQL + " SELECT subject, trial, band, round(power, 6) AS power, round(power / sum(power) OVER (PARTITION BY trial), 6) AS relative FROM bp"))
def _relative(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.relative_power(power(spark, d), ["trial"]), "power", "relative")


@query("subject_band_table", V.sql("trial_long", POWER_SQL + " SELECT subject, " + ", ".join(f"round(avg(CASE WHEN band = '{b}' THEN power END), 6) AS {b}" for b, _, _ in BANDS) + " FROM bp GROUP BY 1"))
def _bands(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.subject_band_table(power(spark, d), [b for b, _, _ in BANDS]), *[b for b, _, _ in BANDS])


CROSS_SQL = spec_sql(1, "subject, event, trial, channel") + ", cs AS (SELECT i.subject, i.event, i.trial, i.freq, i.channel AS ch_i, j.channel AS ch_j, sum(i.re * j.re + i.im * j.im) AS re, sum(i.im * j.re - i.re * j.im) AS im FROM spec i JOIN spec j ON i.trial = j.trial AND i.freq = j.freq AND i.taper = j.taper AND i.channel > j.channel GROUP BY ALL)"


def cross(spark: SparkSession, d: str) -> DataFrame:
    return A.cross_spectrum(A.spectrum(trials(spark, d), ["subject", "event", "trial", "channel"], N, RATE, n_tapers=1), ["subject", "event", "trial"])


@query("cross_spectrum", V.sql("trial_long", CROSS_SQL + " SELECT subject, event, trial, freq, ch_i, ch_j, round(re, 6) + 0 AS re, round(im, 6) + 0 AS im FROM cs"))
def _cross(spark: SparkSession, d: str) -> DataFrame:
    return rounded(cross(spark, d), "re", "im")


WPLI_SQL = CROSS_SQL + ", " + BAND_SQL + """, w AS (SELECT subject, event, ch_i, ch_j, freq, sum(im) AS s, sum(abs(im)) AS a, sum(im * im) AS q FROM cs GROUP BY ALL),
 wpli AS (SELECT subject, event, band, ch_i, ch_j, avg(CASE WHEN abs(a * a - q) > 1e-300 THEN (s * s - q) / (a * a - q) END) AS value FROM w JOIN band ON freq >= lo AND freq < hi GROUP BY ALL)"""


def wpli(spark: SparkSession, d: str) -> DataFrame:
    return A.wpli2_debiased(cross(spark, d), bands(spark), ["subject", "event"])


@query("wpli2_debiased", V.sql("trial_long", WPLI_SQL + " SELECT subject, event, band, ch_i, ch_j, round(value, 6) + 0 AS value FROM wpli"))
def _wpli(spark: SparkSession, d: str) -> DataFrame:
    return rounded(wpli(spark, d), "value")


@query("symmetrise", V.sql("pair_matrix", "SELECT subject, ch_i, ch_j, round(value, 6) + 0 AS value FROM pair_matrix UNION ALL SELECT subject, ch_j, ch_i, round(value, 6) + 0 FROM pair_matrix"))
def _both(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.symmetrise(V.pair_matrix(spark, d)), "value")


ROI_MEAN = "SELECT {k}, a.roi AS roi_a, b.roi AS roi_b, round(avg(value), 6) + 0 AS value FROM (SELECT {k}, ch_i, ch_j, value FROM {v} UNION ALL SELECT {k}, ch_j, ch_i, value FROM {v}) JOIN roi a ON a.channel = ch_i JOIN roi b ON b.channel = ch_j WHERE a.roi <> b.roi GROUP BY ALL"


@query("roi_mean", V.sql("pair_matrix", ", " + ROI_SQL + " " + ROI_MEAN.format(k="subject", v="pair_matrix")))
def _roi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.roi_mean(V.pair_matrix(spark, d), rois(spark), ["subject"]), "value")


@query("conn_subject_band", V.sql("trial_long", WPLI_SQL + ", " + ROI_SQL + " " + ROI_MEAN.format(k="subject, event, band", v="wpli")))
def _conn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.conn_subject_band(trials(spark, d), rois(spark), bands(spark), N, RATE), "value")


@query("average_over_events", V.sql("trial_long", WPLI_SQL + " SELECT subject, band, ch_i, ch_j, round(avg(value), 6) + 0 AS value FROM wpli GROUP BY ALL"))
def _events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.average_over_events(wpli(spark, d), ["subject", "band", "ch_i", "ch_j"]), "value")


WINDOWS = [("early", 1, 4), ("late", 4, 9), ("all", 1, 12)]
WINDOW_SQL = ', windows("window", t0, t1) AS (VALUES ' + ", ".join(map(str, WINDOWS)) + ")"


def windows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(WINDOWS, "window string, t0 int, t1 int")


@query("window_means", V.sql("score_matrix", WINDOW_SQL + ' SELECT grp, subject, "window", round(avg(score), 6) AS score FROM score_matrix JOIN windows ON t BETWEEN t0 AND t1 GROUP BY ALL'))
def _windows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.window_means(V.score_matrix(spark, d), windows(spark), ["grp", "subject"]), "score")


@query("group_curve", V.sql("score_matrix", "SELECT grp, t, round(avg(score), 6) AS mean, round(stddev_pop(score) / sqrt(count(score)), 6) AS sem, count(score) AS n FROM score_matrix GROUP BY 1, 2"))
def _curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.group_curve(V.score_matrix(spark, d)), "mean", "sem")


@query("sample_sem", V.sql("score_matrix", "SELECT grp, t, round(CASE WHEN count(v) > 1 THEN stddev_samp(v) / sqrt(count(v)) END, 6) AS sem, count(v) AS n FROM (SELECT grp, t, CASE WHEN subject % 7 > 0 THEN score END AS v FROM score_matrix) GROUP BY 1, 2"))
def _sem(spark: SparkSession, d: str) -> DataFrame:
    rows = V.score_matrix(spark, d).withColumn("v", F.when(F.col("subject") % 7 > 0, F.col("score")).otherwise(F.lit(float("nan"))))
    return rounded(A.sample_sem(rows, ["grp", "t"], "v"), "sem")


@query("matrix_group_mean", V.sql("trial_long", "SELECT t_train, t_test, round(avg(auc), 6) + 0 AS auc, count(auc) AS n FROM (SELECT subject, channel AS t_train, t AS t_test, avg(m) AS auc FROM (SELECT subject, label % 5 AS fold, channel, t, avg(x) AS m FROM trial_long GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"))
def _matrix(spark: SparkSession, d: str) -> DataFrame:
    folds = V.trial_long(spark, d).groupBy("subject", (F.col("label") % 5).alias("fold"), F.col("channel").alias("t_train"), F.col("t").alias("t_test")).agg(F.avg("x").alias("auc"))
    return rounded(A.matrix_group_mean(folds), "auc")


@query("crop_axis", V.sql("score_matrix", ", s AS (SELECT subject, CASE WHEN subject % 2 = 0 THEN t / 10e0 ELSE t * 100e0 END AS t, CASE WHEN t % 5 = 0 THEN NULL ELSE score END AS score FROM score_matrix), m AS (SELECT *, CASE WHEN max(abs(t)) OVER (PARTITION BY subject) < 100 THEN t * 1000 ELSE t END AS t_ms FROM s) SELECT subject, round(t_ms, 6) AS t_ms, round(coalesce(score, 0.5), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY t_ms) AS k FROM m WHERE t_ms BETWEEN 200 AND 900.5) WHERE k <= 6"))
def _crop(spark: SparkSession, d: str) -> DataFrame:
    rows = V.score_matrix(spark, d).select("subject", F.when(F.col("subject") % 2 == 0, F.col("t") / 10.0).otherwise(F.col("t") * 100.0).alias("t"), F.when(F.col("t") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("score")).alias("score"))
    return rounded(A.crop_axis(rows, 200, 900.5, most=6).select("subject", "t_ms", "score"), "t_ms", "score")


@query("box_summary", V.sql("score_matrix", ", q AS (SELECT grp, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3, count(score) AS n FROM score_matrix GROUP BY 1) SELECT grp, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, n, min(score) AS low, max(score) AS high FROM score_matrix JOIN q USING (grp) WHERE score BETWEEN q1 - 1.5e0 * (q3 - q1) AND q3 + 1.5e0 * (q3 - q1) GROUP BY ALL"))
def _box(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.box_summary(V.score_matrix(spark, d), ["grp"], "score"), "q1", "median", "q3")


SWEEP_SQL = ", sweep AS (SELECT cast(2 + subject % 4 AS INT) AS n_folds, cast(100 * (1 + t % 3) AS INT) AS rate, round(avg(score), 6) AS mean_auc, round(stddev_pop(score), 6) AS sd_auc FROM score_matrix GROUP BY 1, 2)"


def sweep(spark: SparkSession, d: str) -> DataFrame:
    cell = V.score_matrix(spark, d).groupBy((2 + F.col("subject") % 4).cast("int").alias("n_folds"), (100 * (1 + F.col("t") % 3)).cast("int").alias("rate"))
    return rounded(cell.agg(F.avg("score").alias("mean_auc"), F.stddev_pop("score").alias("sd_auc")), "mean_auc", "sd_auc")


@query("grid_pivot", V.sql("score_matrix", SWEEP_SQL + " SELECT n_folds, " + ", ".join(f'max(CASE WHEN rate = {r} THEN mean_auc END) AS "{r}"' for r in (100, 200, 300)) + " FROM sweep GROUP BY 1"))
def _pivot(spark: SparkSession, d: str) -> DataFrame:
    return A.grid_pivot(sweep(spark, d), "mean_auc", [100, 200, 300])


@query("grid_summary", V.sql("score_matrix", SWEEP_SQL + ", g AS (SELECT rate, n_folds, avg(mean_auc) AS mean, stddev_pop(mean_auc) AS sd, min(struct_pack(m := -mean_auc, f := n_folds, r := rate)) AS b, min(struct_pack(m := sd_auc, f := n_folds, r := rate)) AS s FROM sweep GROUP BY GROUPING SETS ((rate), (n_folds), ())) SELECT rate, n_folds, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd / mean, 6) AS cv, cast(b.f AS VARCHAR) || '/' || cast(b.r AS VARCHAR) AS best, cast(s.f AS VARCHAR) || '/' || cast(s.r AS VARCHAR) AS steadiest FROM g"))
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.grid_summary(sweep(spark, d)), "mean", "sd", "cv")


@query("grid_top", V.sql("score_matrix", SWEEP_SQL + " SELECT * FROM sweep ORDER BY mean_auc DESC, n_folds, rate LIMIT 5"))
def _top(spark: SparkSession, d: str) -> DataFrame:
    return A.top_settings(sweep(spark, d), "mean_auc")
