"""Queries of the signal operators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as K
from ..operators import signal as P
from . import views as V
from .registry import query, rounded

TRIAL = ["subject", "trial", "channel"]


def trials(spark: SparkSession, d: str) -> DataFrame:
    return V.trial_long(spark, d).drop("label")


@query("bipolar_channel", V.sql("cont_signal", "SELECT subject, sample, n.channel, round(sum(CASE WHEN c.channel = plus THEN x ELSE -x END), 6) + 0 AS x FROM cont_signal c JOIN (VALUES ('VEOG', 'a', 'b'), ('HEOG', 'b', 'a')) n(channel, plus, minus) ON c.channel IN (plus, minus) GROUP BY 1, 2, 3"))
def _bipolar(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("VEOG", "a", "b"), ("HEOG", "b", "a")], "derived string, plus string, minus string")
    return rounded(P.bipolar_channel(V.cont_signal(spark, d), pairs), "x")


@query("average_reference", V.sql("trial_long", "SELECT subject, trial, channel, t, round(x - avg(x) OVER (PARTITION BY trial, t), 6) + 0 AS x FROM trial_long"))
def _reference(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.average_reference(trials(spark, d), ["trial", "t"]), "x")


ROLES = [(0, "Fp1", "eeg"), (1, None, "eeg"), (2, "EOG1", "eog"), (3, "Oz", "eeg"), (4, "misc", "misc")]


@query("channel_roles", V.sql("trial_long", "SELECT subject, trial, coalesce(n, cast(t.channel AS VARCHAR)) AS channel, kind, t, round(x, 6) AS x FROM trial_long t JOIN (VALUES (0, 'Fp1', 'eeg'), (1, NULL, 'eeg'), (3, 'Oz', 'eeg')) r(channel, n, kind) ON r.channel = t.channel"))
def _roles(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.channel_roles(trials(spark, d), spark.createDataFrame(ROLES, "channel int, new_name string, kind string")).select("subject", "trial", "channel", "kind", "t", "x"), "x")


BAD = [(0, 2), (1, 5), (1, 6), (3, 0)]


@query("interpolate_bad", V.sql("trial_long", ", bad(subject, channel) AS (VALUES (0, 2), (1, 5), (1, 6), (3, 0)), good AS (SELECT subject, trial, t, channel, x FROM trial_long t WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.subject = t.subject AND b.channel = t.channel)), f AS (SELECT g.subject, g.trial, g.t, b.channel, sum(x * pow(sqrt(pow(g.channel - b.channel, 2) + pow(g.channel % 3 - b.channel % 3, 2)), -2e0)) / sum(pow(sqrt(pow(g.channel - b.channel, 2) + pow(g.channel % 3 - b.channel % 3, 2)), -2e0)) AS x FROM good g JOIN bad b ON g.subject = b.subject GROUP BY ALL) SELECT subject, trial, t, channel, round(x, 6) + 0 AS x FROM good UNION ALL SELECT subject, trial, t, channel, round(x, 6) + 0 FROM f"))
def _bad(spark: SparkSession, d: str) -> DataFrame:
    position = spark.createDataFrame([(c, float(c), float(c % 3), 0.0) for c in range(8)], "channel int, px double, py double, pz double")
    return rounded(P.interpolate_bad(trials(spark, d), spark.createDataFrame(BAD, "subject long, channel int"), position), "x")


def layout(c: int) -> tuple[float, float, float]:
    """Eight places on the upper half of a sphere."""
    turn, height = 2 * math.pi * c / 8, 0.1 + 0.1 * c
    return math.sqrt(1 - height * height) * math.cos(turn), math.sqrt(1 - height * height) * math.sin(turn), height


def spline_sql() -> str:
    """The weights of each bad channel's subject, as values."""
    rows = []
    for s in sorted({s for s, _ in BAD}):
        out = [c for k, c in BAD if k == s]
        rest = [c for c in range(8) if c not in out]
        w = P.spline_weights(np.array([layout(c) for c in rest]), np.array([layout(c) for c in out]))
        rows += [f"({s}, {t}, {c}, {float(w[i, j])!r}::DOUBLE)" for i, t in enumerate(out) for j, c in enumerate(rest)]
    return ", ".join(rows)


@query("interpolate_spline", V.sql("trial_long", f", w(subject, target, channel, w) AS (VALUES {spline_sql()}), f AS (SELECT t.subject, trial, t, target AS channel, sum(w * x) AS x FROM trial_long t JOIN w ON w.subject = t.subject AND w.channel = t.channel GROUP BY ALL) SELECT subject, trial, t, channel, round(x, 6) + 0 AS x FROM (SELECT subject, trial, t, channel, x FROM trial_long t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.subject = t.subject AND w.target = t.channel) UNION ALL SELECT * FROM f)"))
def _spline(spark: SparkSession, d: str) -> DataFrame:
    position = spark.createDataFrame([(c, *layout(c)) for c in range(8)], "channel int, px double, py double, pz double")
    return rounded(P.interpolate_spline(trials(spark, d), spark.createDataFrame(BAD, "subject long, channel int"), position), "x")


KERNEL = [0.1, 0.2, 0.4, 0.2, 0.1]
_K = "(VALUES " + ", ".join(f"({k - 2}, {h}e0)" for k, h in enumerate(KERNEL)) + ") k(o, h)"


@query("fir_filter", V.sql("cont_signal", f", one AS (SELECT c.subject, c.channel, c.sample, sum(h * n.x) AS x FROM cont_signal c CROSS JOIN {_K} JOIN cont_signal n ON n.subject = c.subject AND n.channel = c.channel AND n.sample = c.sample + o GROUP BY 1, 2, 3), two AS (SELECT c.subject, c.channel, c.sample, sum(h * n.x) AS x FROM one c CROSS JOIN {_K} JOIN one n ON n.subject = c.subject AND n.channel = c.channel AND n.sample = c.sample + o GROUP BY 1, 2, 3) SELECT subject, channel, sample, round(x, 6) + 0 AS x FROM two"))
def _fir(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.fir_filter(V.cont_signal(spark, d), ["subject", "channel"], KERNEL), "x")


#: Mains at 50 Hz and a band of 0.5 to 45 Hz at 250 samples a second, in kernels of 41 taps.
NOTCH, BAND = P.notch_kernel(41, [50.0, 100.0], 4.0, 250.0), P.sinc_kernel(41, 0.5, 45.0, 250.0)


def once_sql(name: str, source: str, kernel: list[float]) -> str:
    taps = ", ".join(f"({k - len(kernel) // 2}, {h!r}::DOUBLE)" for k, h in enumerate(kernel))
    return f", {name} AS (SELECT c.subject, c.channel, c.sample, sum(h * n.x) AS x FROM {source} c CROSS JOIN (VALUES {taps}) k(o, h) JOIN {source} n ON n.subject = c.subject AND n.channel = c.channel AND n.sample = c.sample + o GROUP BY 1, 2, 3)"


@query("notch_filter", V.sql("cont_signal", once_sql("one", "cont_signal", NOTCH) + once_sql("two", "one", NOTCH[::-1]) + once_sql("three", "two", BAND) + " SELECT subject, channel, sample, round(x, 6) + 0 AS x FROM three"))
def _notch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.fir_filter(P.fir_filter(V.cont_signal(spark, d), ["subject", "channel"], NOTCH), ["subject", "channel"], BAND, False), "x")


@query("resample_bins", V.sql("cont_signal", "SELECT subject, channel, cast(floor(sample * 100e0 / 250e0) AS BIGINT) AS sample, round(avg(x), 6) AS x FROM cont_signal GROUP BY 1, 2, 3"))
def _resample(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.resample_bins(V.cont_signal(spark, d), ["subject", "channel"], 250.0, 100.0), "x")


UP, DOWN = 2, 5


def poly_sql() -> str:
    """y: samples at UP / DOWN of the rate, each the sum over samples and taps that meet there."""
    h = P.resampling_kernel(UP, DOWN)
    taps = ", ".join(f"({k - len(h) // 2}, {float(v)!r}::DOUBLE)" for k, v in enumerate(h))
    return f", k(o, h) AS (VALUES {taps}), y AS (SELECT subject, channel, (sample * {UP} + o) // {DOWN} AS m, sum(h * x) AS x FROM cont_signal CROSS JOIN k WHERE (sample * {UP} + o) % {DOWN} = 0 GROUP BY 1, 2, 3)"


@query("resample_poly", V.sql("cont_signal", poly_sql() + f" SELECT y.subject, y.channel, m AS sample, round(y.x, 6) + 0 AS x FROM y JOIN cont_signal c ON c.subject = y.subject AND c.channel = y.channel AND c.sample = cast(floor(m * {DOWN} / {UP}) AS BIGINT)"))
def _poly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.resample_poly(V.cont_signal(spark, d), ["subject", "channel"], UP, DOWN), "x")


@query("epoch_extract", V.sql("cont_signal", "SELECT e.subject, e.event_id, channel, sample, sample - e.seq AS t, round(x, 6) AS x FROM event_seq e JOIN cont_signal c ON c.subject = e.subject AND c.sample BETWEEN e.seq - 2 AND e.seq + 5 WHERE code = 1"))
def _epochs(spark: SparkSession, d: str) -> DataFrame:
    event = V.event_seq(spark, d).where("code = 1").select("subject", "event_id", F.col("seq").alias("onset"))
    return rounded(P.epoch_extract(V.cont_signal(spark, d), event, -2, 5).select("subject", "event_id", "channel", "sample", "t", "x"), "x")


@query("baseline_correct", V.sql("trial_long", "SELECT subject, trial, channel, t, round(x - avg(CASE WHEN t <= 2 THEN x END) OVER (PARTITION BY trial, channel), 6) + 0 AS x FROM trial_long"))
def _baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.baseline_correct(trials(spark, d), TRIAL, None, 2), "x")


@query("detrend", V.sql("trial_long", ", f AS (SELECT trial, channel, regr_slope(x, t) AS b, regr_intercept(x, t) AS a FROM trial_long GROUP BY 1, 2) SELECT subject, trial, channel, t, round(x - a - b * t, 6) + 0 AS x FROM trial_long JOIN f USING (trial, channel)"))
def _detrend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.detrend(trials(spark, d), TRIAL, 1), "x")


LIMITS_SQL = ", ptp AS (SELECT subject, trial, channel, max(x) - min(x) AS ptp FROM trial_long GROUP BY ALL), bad AS (SELECT DISTINCT trial FROM ptp WHERE channel < 6 AND ptp > 0.55e0 + channel / 100e0)"


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, 0.55 + c / 100) for c in range(6)], "channel int, ptp_limit double")


@query("reject_ptp", V.sql("trial_long", LIMITS_SQL + " SELECT subject, trial, channel, t, round(x, 6) AS x FROM trial_long WHERE trial NOT IN (SELECT trial FROM bad)"))
def _reject(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.reject_ptp(trials(spark, d), limits(spark)).select("subject", "trial", "channel", "t", "x"), "x")


@query("drop_log", V.sql("trial_long", LIMITS_SQL + " SELECT subject, count(DISTINCT trial) AS n_before, count(DISTINCT CASE WHEN trial NOT IN (SELECT trial FROM bad) THEN trial END) AS n_after, count(DISTINCT CASE WHEN trial IN (SELECT trial FROM bad) THEN trial END) AS n_dropped FROM trial_long GROUP BY 1"))
def _log(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d)
    return P.drop_log(rows, P.reject_ptp(rows, limits(spark)))


@query("tumbling_epochs", V.sql("cont_signal", ", s AS (SELECT subject, min(seq) / 2e0 AS t_start FROM event_seq WHERE code = 1 AND subject % 5 > 0 GROUP BY 1), e AS (SELECT c.subject, channel, sample, x, floor((sample / 2e0 - coalesce(t_start, 6e0)) / 5e0) AS epoch FROM cont_signal c LEFT JOIN s USING (subject)) SELECT subject, channel, cast(epoch AS BIGINT) AS epoch, count(*) AS n, round(avg(x), 6) AS mean FROM e WHERE epoch >= 0 AND epoch < 6 GROUP BY 1, 2, 3"))
def _tumbling(spark: SparkSession, d: str) -> DataFrame:
    start = V.event_seq(spark, d).where("code = 1 and subject % 5 > 0").groupBy("subject").agg((F.min("seq") / 2).alias("t_start"))
    return rounded(P.tumbling_epochs(V.cont_signal(spark, d), start, 5.0, 6, 2.0, 6.0).groupBy("subject", "channel", "epoch").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean")), "mean")


@query("blink_detect", V.sql("cont_signal", """, n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b FROM cont_signal WHERE channel = 'a' WINDOW w AS (PARTITION BY subject ORDER BY sample)),
 p AS (SELECT *, sample - lag(sample) OVER (PARTITION BY subject ORDER BY sample) AS gap FROM n WHERE x > 60 AND x > coalesce(a, -1e300) AND x >= coalesce(b, -1e300)),
 r AS (SELECT *, sum(CASE WHEN gap <= 4 THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY sample) AS blink FROM p),
 f AS (SELECT subject, blink, row_number() OVER (PARTITION BY subject, blink ORDER BY x DESC, sample) AS k, sample, x FROM r)
 SELECT subject, cast(blink AS BIGINT) AS blink, sample, round(x, 6) AS peak FROM (SELECT *, count(*) OVER (PARTITION BY subject) AS m FROM f WHERE k = 1) WHERE m >= 5"""))
def _blink(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.blink_detect(V.cont_signal(spark, d), "a", 60.0, 4, 5), "peak")


SCORE_SQL = ", c AS (SELECT a.subject, a.channel, corr(a.x, b.x) AS score FROM trial_long a JOIN trial_long b ON a.trial = b.trial AND a.t = b.t AND b.channel = 0 WHERE a.channel <> 0 GROUP BY 1, 2), z AS (SELECT *, (score - avg(score) OVER (PARTITION BY subject)) / stddev_pop(score) OVER (PARTITION BY subject) AS z FROM c)"


@query("eog_component_score", V.sql("trial_long", SCORE_SQL + " SELECT subject, channel, round(score, 6) + 0 AS score, round(z, 6) + 0 AS z, abs(z) > 1.5 AS bad FROM z"))
def _eog(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.eog_component_score(trials(spark, d), 0, 1.5), "score", "z")


@query("eog_regress_out", V.sql("trial_long", ", b AS (SELECT a.subject, a.channel, regr_slope(a.x, b.x) AS b FROM trial_long a JOIN trial_long b ON a.trial = b.trial AND a.t = b.t AND b.channel = 0 WHERE a.channel <> 0 GROUP BY 1, 2) SELECT a.subject, a.trial, a.channel, a.t, round(a.x - s.b * o.x, 6) + 0 AS x FROM trial_long a JOIN b s ON s.subject = a.subject AND s.channel = a.channel JOIN trial_long o ON o.trial = a.trial AND o.t = a.t AND o.channel = 0"))
def _regress(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.eog_regress_out(trials(spark, d), 0).select("subject", "trial", "channel", "t", "x"), "x")


CANDIDATES = [0.3, 0.4, 0.5, 0.6]
AUTO_SQL = ", ptp AS (SELECT subject, trial, channel, max(x) - min(x) AS ptp, trial % 4 AS fold FROM trial_long GROUP BY ALL), cand(threshold) AS (VALUES " + ", ".join(f"({c}e0)" for c in CANDIDATES) + """),
 test AS (SELECT subject, channel, fold AS held, quantile_cont(ptp, 0.5) AS middle FROM ptp GROUP BY 1, 2, 3),
 cost AS (SELECT t.subject, t.channel, threshold, held, abs(avg(ptp) - any_value(middle)) AS c FROM test t CROSS JOIN cand JOIN ptp p ON p.subject = t.subject AND p.channel = t.channel AND p.fold <> held AND ptp <= threshold GROUP BY 1, 2, 3, 4),
 mean AS (SELECT subject, channel, threshold, round(avg(c), 9) AS cost FROM cost GROUP BY 1, 2, 3),
 best AS (SELECT subject, channel, threshold, cost FROM (SELECT *, row_number() OVER (PARTITION BY subject, channel ORDER BY cost, threshold) AS k FROM mean) WHERE k = 1)"""


@query("independent_components")
def _components(spark: SparkSession, d: str) -> DataFrame:
    """Trials without the components that go along with channel 0, as a stand-in for an ocular one."""
    rows = trials(spark, d)
    model = K.stored(K.fit_components(rows, most=4, rounds=8))
    bad = K.ocular_components(rows, model, 0, 1.2).where("bad")
    return rounded(K.without_components(rows, model, bad).select("subject", "trial", "channel", "t", "x"), "x")


@query("auto_threshold", V.sql("trial_long", AUTO_SQL + " SELECT p.subject, trial, round(avg(CASE WHEN ptp > threshold THEN 1e0 ELSE 0e0 END), 6) AS share_bad, avg(CASE WHEN ptp > threshold THEN 1e0 ELSE 0e0 END) > 0.4 AS dropped FROM ptp p JOIN best b ON b.subject = p.subject AND b.channel = p.channel GROUP BY 1, 2"))
def _auto(spark: SparkSession, d: str) -> DataFrame:
    ptp = P.peak_to_peak(trials(spark, d))
    best = P.auto_threshold(ptp, spark.createDataFrame([(c,) for c in CANDIDATES], "threshold double"), 4)
    return rounded(P.consensus_reject(ptp, best, 0.4), "share_bad")


REPAIR, CONSENSUS = [0, 1, 4], [0.2, 0.4, 0.7]
REJECT_SQL = AUTO_SQL + f""", ab AS (SELECT p.*, ptp > threshold AS over FROM ptp p JOIN best b ON b.subject = p.subject AND b.channel = p.channel),
 rk AS (SELECT *, avg(CASE WHEN over THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY subject, trial) AS share, row_number() OVER (PARTITION BY subject, trial ORDER BY over DESC, ptp DESC, channel) AS worst FROM ab),
 gr AS (SELECT n_interpolate, consensus FROM (VALUES {", ".join(f"({n})" for n in REPAIR)}) a(n_interpolate) CROSS JOIN (VALUES {", ".join(f"({c}e0)" for c in CONSENSUS)}) b(consensus)),
 kp AS (SELECT * FROM rk CROSS JOIN gr WHERE share <= consensus AND NOT (over AND worst <= n_interpolate)),
 co AS (SELECT t.subject, t.channel, n_interpolate, consensus, held, abs(avg(ptp) FILTER (WHERE fold <> held) - any_value(middle)) AS c, count(*) FILTER (WHERE fold = held) AS n FROM test t JOIN kp k ON k.subject = t.subject AND k.channel = t.channel GROUP BY ALL HAVING count(*) FILTER (WHERE fold <> held) > 0),
 me AS (SELECT subject, n_interpolate, consensus, round(avg(c), 9) AS cost, cast(sum(n) AS BIGINT) AS n_kept FROM co GROUP BY 1, 2, 3)"""


@query("rejection_grid", V.sql("trial_long", REJECT_SQL + " SELECT subject, n_interpolate, consensus, round(cost, 6) AS cost, n_kept FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY cost, n_interpolate, consensus) AS k FROM me) WHERE k = 1"))
def _grid(spark: SparkSession, d: str) -> DataFrame:
    ptp = P.peak_to_peak(trials(spark, d))
    best = P.auto_threshold(ptp, spark.createDataFrame([(c,) for c in CANDIDATES], "threshold double"), 4)
    return rounded(P.rejection_grid(ptp, best, REPAIR, CONSENSUS, 4), "cost")


@query("repair_grid")
def _repair(spark: SparkSession, d: str) -> DataFrame:
    rows = trials(spark, d)
    best = P.auto_threshold(P.peak_to_peak(rows), spark.createDataFrame([(c,) for c in CANDIDATES], "threshold double"), 4)
    position = spark.createDataFrame([(c, *layout(c)) for c in range(8)], "channel int, px double, py double, pz double")
    return rounded(P.repair_grid(rows, best, position, REPAIR, CONSENSUS, 4), "cost")


@query("split_good_window", V.sql("cont_signal", "SELECT c.subject, channel, sample, round(x, 6) AS x FROM cont_signal c LEFT JOIN (VALUES (3, 10, 20), (7, 1, 5)) o(subject, lo, hi) ON o.subject = c.subject WHERE lo IS NULL OR sample BETWEEN lo AND hi"))
def _good(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.split_good_window(V.cont_signal(spark, d), spark.createDataFrame([(3, 10, 20), (7, 1, 5)], "subject long, lo long, hi long")).select("subject", "channel", "sample", "x"), "x")
