"""Queries of the decoding operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import drawn_sql
from ..operators import decode as C
from . import views as V
from .registry import query, rounded

K, REPEATS = 5, 2
CONDITIONS = [("low", x) for x in range(5)] + [("high", x) for x in range(5, 10)] + [("two", 2), ("two", 3), ("seven", 7), ("seven", 8)]
COMPARISONS = [("all", "low", "high"), ("some", "two", "seven")]
COMPARE_SQL = ", cond(condition, label) AS (VALUES " + ", ".join(map(str, CONDITIONS)) + "), comp(cmp, neg, pos) AS (VALUES " + ", ".join(map(str, COMPARISONS)) + "), tr AS (SELECT cmp, subject, trial, channel, t, x, CASE WHEN condition = pos THEN 1 ELSE 0 END AS y FROM trial_long JOIN cond USING (label) JOIN comp ON condition IN (neg, pos))"


def compared(spark: SparkSession, d: str) -> DataFrame:
    condition = spark.createDataFrame(CONDITIONS, "condition string, label int")
    return C.build_comparison(V.trial_long(spark, d), condition, spark.createDataFrame(COMPARISONS, "name string, cond_neg string, cond_pos string")).select("cmp", "subject", "trial", "channel", "t", "x", "y")


def main(spark: SparkSession, d: str) -> DataFrame:
    """One comparison: label below 5 against the rest."""
    return V.trial_long(spark, d).select("subject", "trial", "channel", "t", "x", (F.col("label") >= 5).cast("int").alias("y"))


def folds(rows: DataFrame, repeats: int = REPEATS) -> DataFrame:
    return C.stratified_folds(rows, ["subject"], K, repeats)


MAIN_SQL = ", tr AS (SELECT subject, trial, channel, t, x, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM trial_long)"


def folds_sql(keys: str = "subject", k: str | int = K, repeats: int = REPEATS) -> str:
    return f", folds AS (SELECT {keys}, trial, y, repeat, cast((row_number() OVER (PARTITION BY {keys}, repeat, y ORDER BY {drawn_sql("'0.' || cast(repeat AS VARCHAR)", 'trial')}, trial) - 1) % {k} AS INT) AS fold FROM (SELECT DISTINCT {keys}, trial, y FROM tr) CROSS JOIN (SELECT unnest(range(0, {repeats})) AS repeat))"


def fit_sql(keys: str, feature: str, shrink: str = "0e0", rows: str = "tr") -> str:
    """fr: rows with their fold; wt: weights for each fold from the rows of the others. ``keys`` without the repeat."""
    own = ", ".join(f"r.{k.strip()}" for k in keys.split(","))
    return f""", fr AS (SELECT r.*, f.repeat, f.fold FROM {rows} r JOIN folds f USING ({keys}, trial)),
 st AS (SELECT {own}, r.repeat, g.fold, {", ".join("r." + x.strip() for x in feature.split(","))}, avg(x) FILTER (WHERE y = 0) AS m0, avg(x) FILTER (WHERE y = 1) AS m1, (coalesce(var_pop(x) FILTER (WHERE y = 0), 0) * count(*) FILTER (WHERE y = 0) + coalesce(var_pop(x) FILTER (WHERE y = 1), 0) * count(*) FILTER (WHERE y = 1)) / count(*) AS s2 FROM fr r JOIN (SELECT DISTINCT {keys}, repeat, fold FROM folds) g ON {" AND ".join(f"g.{k.strip()} = r.{k.strip()}" for k in keys.split(","))} AND g.repeat = r.repeat AND g.fold <> r.fold GROUP BY ALL),
 wt AS (SELECT *, CASE WHEN s2 + {shrink} > 1e-18 THEN (m1 - m0) / (s2 + {shrink}) ELSE 0 END AS w, (m0 + m1) / 2 AS mid FROM st WHERE m0 IS NOT NULL AND m1 IS NOT NULL)"""


def score_sql(keys: str, by: str = ", t", on: str = ", channel, t") -> str:
    return f", sc AS (SELECT {keys}, repeat, fold{by}, trial, y, sum(w * (x - mid)) AS score FROM fr JOIN wt USING ({keys}, repeat, fold{on}) GROUP BY ALL)"


def auc_sql(name: str, source: str, keys: str, score: str = "score") -> str:
    return f""", rk_{name} AS (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys}, {score}) - 1) / 2e0 AS r FROM {source} WHERE {score} IS NOT NULL),
 {name} AS (SELECT {keys}, CASE WHEN count(*) FILTER (WHERE y = 1) > 0 AND count(*) FILTER (WHERE y = 0) > 0 THEN (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2e0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) END AS auc FROM rk_{name} GROUP BY {keys})"""


SLIDE_SQL = MAIN_SQL + folds_sql() + fit_sql("subject", "channel, t") + score_sql("subject") + auc_sql("au", "sc", "subject, repeat, fold, t")


@query("build_comparison", V.sql("trial_long", COMPARE_SQL + " SELECT cmp, subject, trial, channel, t, round(x, 6) AS x, y FROM tr"))
def _comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(compared(spark, d), "x")


@query("label_encode", V.sql("trial_long", ", l AS (SELECT DISTINCT subject, trial, CASE WHEN label < 8 THEN 'c' || cast(label % 3 AS VARCHAR) ELSE 'one' END AS lab, label < 8 AS g FROM trial_long), c AS (SELECT *, dense_rank() OVER (PARTITION BY subject, g ORDER BY lab) - 1 AS y FROM l) SELECT subject, g, lab, trial, cast(y AS INT) AS y FROM c WHERE g"))
def _encode(spark: SparkSession, d: str) -> DataFrame:
    rows = V.trial_long(spark, d).select("subject", "trial", F.when(F.col("label") < 8, F.concat(F.lit("c"), (F.col("label") % 3).cast("string"))).otherwise("one").alias("lab"), (F.col("label") < 8).alias("g")).distinct()
    return C.label_encode(rows, ["subject", "g"], "lab").select("subject", "g", "lab", "trial", "y")


@query("class_guard", V.sql("trial_long", COMPARE_SQL + ", s AS (SELECT cmp, subject, y, count(DISTINCT trial) AS n FROM tr GROUP BY ALL) SELECT cmp, subject, cast(least(10, min(n)) AS INT) AS k FROM s GROUP BY 1, 2 HAVING least(10, min(n)) >= 2 AND count(*) >= 2"))
def _guard(spark: SparkSession, d: str) -> DataFrame:
    return C.class_guard(compared(spark, d), ["cmp", "subject"])


@query("stratified_folds", V.sql("trial_long", COMPARE_SQL + folds_sql("cmp, subject", K, 5) + " SELECT cmp, subject, trial, y, cast(repeat AS INT) AS repeat, fold FROM folds"))
def _folds(spark: SparkSession, d: str) -> DataFrame:
    return C.stratified_folds(compared(spark, d), ["cmp", "subject"], K, 5)


@query("group_folds", V.sql("trial_long", ", s AS (SELECT subject, label, count(DISTINCT trial) AS n FROM trial_long GROUP BY ALL) SELECT subject, label, n, cast((row_number() OVER (PARTITION BY subject ORDER BY n DESC, label) - 1) % 4 AS INT) AS fold FROM s"))
def _groups(spark: SparkSession, d: str) -> DataFrame:
    return C.group_folds(V.trial_long(spark, d), ["subject"], "label", 4)


LOSO_SQL = MAIN_SQL + ", folds AS (SELECT DISTINCT 0 AS one, subject AS fold, 0 AS repeat, trial FROM tr), tr1 AS (SELECT 0 AS one, * FROM tr)" + fit_sql("one", "channel, t", rows="tr1") + score_sql("one") + auc_sql("au", "sc", "one, fold, t")


@query("leave_one_subject_out", V.sql("trial_long", LOSO_SQL + " SELECT fold AS subject, t, round(auc, 6) AS auc FROM au"))
def _loso(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.leave_one_subject_out(main(spark, d).withColumn("one", F.lit(0)), ["one"]).drop("one"), "auc")


@query("class_weights", V.sql("trial_long", COMPARE_SQL + folds_sql("cmp, subject") + ", m AS (SELECT g.cmp, g.subject, g.repeat, g.fold, f.y, count(*) AS m FROM (SELECT DISTINCT cmp, subject, repeat, fold FROM folds) g JOIN folds f ON f.cmp = g.cmp AND f.subject = g.subject AND f.repeat = g.repeat AND f.fold <> g.fold GROUP BY ALL) SELECT cmp, subject, cast(repeat AS INT) AS repeat, fold, y, round(CASE WHEN count(*) OVER w = 1 THEN 1 ELSE sum(m) OVER w / (count(*) OVER w * m) END, 6) AS weight FROM m WINDOW w AS (PARTITION BY cmp, subject, repeat, fold)"))
def _weights(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.class_weights(C.stratified_folds(compared(spark, d), ["cmp", "subject"], K, REPEATS), ["cmp", "subject"]), "weight")


@query("standardise", V.sql("trial_long", ", m AS (SELECT subject, channel, t, avg(x) AS m, stddev_pop(x) AS s FROM trial_long WHERE trial % 3 > 0 GROUP BY ALL) SELECT subject, trial, channel, t, round((x - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) + 0 AS x FROM trial_long JOIN m USING (subject, channel, t)"))
def _standardise(spark: SparkSession, d: str) -> DataFrame:
    rows = V.trial_long(spark, d)
    return rounded(C.standardise(rows.where("trial % 3 > 0"), rows, ["subject", "channel", "t"]).select("subject", "trial", "channel", "t", "x"), "x")


F_SQL = ", c AS (SELECT subject, channel, t, label AS y, count(x) AS n, avg(x) AS m, var_pop(x) AS v FROM trial_long GROUP BY ALL), g AS (SELECT *, sum(n * m) OVER w / sum(n) OVER w AS gm FROM c WINDOW w AS (PARTITION BY subject, channel, t)), f AS (SELECT subject, channel, t, (sum(n * pow(m - gm, 2)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f FROM g GROUP BY 1, 2, 3)"


def anova(spark: SparkSession, d: str) -> DataFrame:
    return C.anova_f(V.trial_long(spark, d), ["subject", "channel", "t"], "label")


@query("anova_f", V.sql("trial_long", F_SQL + " SELECT subject, channel, t, round(f, 6) AS f FROM f"))
def _anova(spark: SparkSession, d: str) -> DataFrame:
    return rounded(anova(spark, d), "f")


@query("select_percentile", V.sql("trial_long", F_SQL + " SELECT subject, channel, t, round(f, 6) AS f FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY f DESC, channel, t) AS k, ceil(count(*) OVER (PARTITION BY subject) * 0.15e0) AS n FROM f) WHERE k <= n"))
def _percentile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.select_percentile(anova(spark, d), ["subject"], ["channel", "t"], 15), "f")


def rows_folds(spark: SparkSession, d: str, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    rows = main(spark, d)
    return rows, folds(rows, repeats)


@query("linear_scorer", V.sql("trial_long", SLIDE_SQL + " SELECT subject, cast(repeat AS INT) AS repeat, fold, t, trial, y, round(score, 6) + 0 AS score FROM sc"))
def _scorer(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d)
    return rounded(C.linear_scorer(C.folded_rows(rows, fold, ["subject"]), ["subject", "repeat"]).select("subject", "repeat", "fold", "t", "trial", "y", "score"), "score")


def gauss_jordan_sql(name: str, by: str, size: int) -> str:
    """{name}{size}: the solutions, at j = size, of systems of {size} equations in rows (by, i, j, v) of {name}0."""
    out = ""
    for k in range(size):
        at = lambda x, i, j: f"JOIN {name}{k} {x} ON " + " AND ".join(f"{x}.{c.strip()} = r.{c.strip()}" for c in by.split(",")) + f" AND {x}.i = {i} AND {x}.j = {j}"  # noqa: B023, E731
        own = ", ".join(f"r.{c.strip()}" for c in by.split(","))
        out += f", {name}{k + 1} AS MATERIALIZED (SELECT {own}, r.i, r.j, CASE WHEN r.i = {k} THEN r.v / p.v ELSE r.v - c.v * q.v / p.v END AS v FROM {name}{k} r {at('p', k, k)} {at('c', 'r.i', k)} {at('q', k, 'r.j')})"
    return out


LDA_SHRINK, CHANNELS = 0.1, 8


def lda_sql() -> str:
    """sl: each held-out trial's score by the full-covariance discriminant."""
    by = "subject, repeat, fold, t"
    own = "r.subject, r.repeat, g.fold, r.t"
    on = "g.subject = r.subject AND g.repeat = r.repeat AND g.fold <> r.fold"
    return f""", gf AS (SELECT DISTINCT subject, repeat, fold FROM folds),
 cm AS (SELECT {own}, r.channel, avg(x) AS m, avg(x) FILTER (WHERE y = 0) AS m0, avg(x) FILTER (WHERE y = 1) AS m1, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1 FROM fr r JOIN gf g ON {on} GROUP BY ALL),
 dv AS (SELECT {own}, r.trial, r.channel, r.x - CASE WHEN y = 1 THEN c.m1 ELSE c.m0 END AS d FROM fr r JOIN gf g ON {on} JOIN cm c ON c.subject = r.subject AND c.repeat = r.repeat AND c.fold = g.fold AND c.t = r.t AND c.channel = r.channel),
 sg AS (SELECT a.subject, a.repeat, a.fold, a.t, a.channel AS i, b.channel AS j, sum(a.d * b.d) / count(*) AS s FROM dv a JOIN dv b USING ({by}, trial) GROUP BY ALL),
 lv AS (SELECT {by}, avg(s) AS l FROM sg WHERE i = j GROUP BY ALL),
 e0 AS MATERIALIZED (SELECT {by}, i, j, {1 - LDA_SHRINK}e0 * s + CASE WHEN i = j THEN {LDA_SHRINK}e0 * l ELSE 0 END AS v FROM sg JOIN lv USING ({by}) UNION ALL SELECT {by}, channel, {CHANNELS}, m1 - m0 FROM cm){gauss_jordan_sql("e", by, CHANNELS)},
 sl AS (SELECT {by}, trial, y, sum(v * (x - (m0 + m1) / 2)) AS score FROM fr JOIN e{CHANNELS} USING ({by}) JOIN cm USING ({by}, channel) WHERE j = {CHANNELS} AND i = channel GROUP BY ALL)"""


LDA_SQL = MAIN_SQL + folds_sql("subject", K, 1) + ", fr AS (SELECT r.*, f.repeat, f.fold FROM tr r JOIN folds f USING (subject, trial))" + lda_sql()


@query("linear_scorer_lda", V.sql("trial_long", LDA_SQL + " SELECT subject, cast(repeat AS INT) AS repeat, fold, t, trial, y, round(score, 6) + 0 AS score FROM sl"))
def _lda(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.linear_scorer(C.folded_rows(rows, fold, ["subject"]), ["subject", "repeat"], "lda", shrink=LDA_SHRINK).select("subject", "repeat", "fold", "t", "trial", "y", "score"), "score")


def newton_sql(loss: str, steps: int) -> str:
    """sn: the scores of balanced linear models with a squared penalty, by full Newton steps; the constant is feature CHANNELS and has no penalty."""
    by, size = "subject, repeat, fold, t", CHANNELS + 1
    slope, curve = {"logistic": ("-1 / (1 + exp(m))", "1 / (1 + exp(m)) * (1 - 1 / (1 + exp(m)))"), "squared_hinge": ("-2 * greatest(0, 1 - m)", "CASE WHEN m < 1 THEN 2 ELSE 0 END")}[loss]
    out = f""", sca AS (SELECT r.subject, r.repeat, g.fold, r.t, r.channel, avg(x) AS m, CASE WHEN var_pop(x) > 1e-18 THEN sqrt(var_pop(x)) ELSE 1 END AS s, count(*) / (2e0 * count(*) FILTER (WHERE y = 0)) AS w0, count(*) / (2e0 * count(*) FILTER (WHERE y = 1)) AS w1 FROM fr r JOIN (SELECT DISTINCT subject, repeat, fold FROM folds) g ON g.subject = r.subject AND g.repeat = r.repeat AND g.fold <> r.fold GROUP BY ALL),
 zc AS (SELECT r.subject, r.repeat, s.fold, r.t, trial, y, r.channel AS i, s.fold <> r.fold AS trains, (x - m) / s AS z, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w FROM fr r JOIN sca s ON s.subject = r.subject AND s.repeat = r.repeat AND s.t = r.t AND s.channel = r.channel),
 zr AS MATERIALIZED (SELECT * FROM zc UNION ALL SELECT DISTINCT subject, repeat, fold, t, trial, y, {CHANNELS}, trains, 1e0, w FROM zc), tz AS MATERIALIZED (SELECT * FROM zr WHERE trains),
 b0 AS (SELECT DISTINCT {by}, i, 0e0 AS b FROM tz)"""
    for k in range(steps):
        out += f""", m{k} AS (SELECT {by}, trial, (2 * any_value(y) - 1) * sum(b * z) AS m, (2 * any_value(y) - 1) * any_value(w) AS u, any_value(w) AS w FROM tz JOIN b{k} USING ({by}, i) GROUP BY {by}, trial),
 d{k} AS MATERIALIZED (SELECT {by}, trial, u * ({slope}) AS sl, w * ({curve}) AS cu FROM m{k}),
 h{k} AS (SELECT a.subject, a.repeat, a.fold, a.t, a.i, c.i AS j, sum(cu * a.z * c.z) AS v FROM tz a JOIN tz c USING ({by}, trial) JOIN d{k} USING ({by}, trial) GROUP BY ALL),
 n{k}_0 AS MATERIALIZED (SELECT {by}, i, j, v + CASE WHEN i = j THEN 1e-9 + CASE WHEN i < {CHANNELS} THEN 1 ELSE 0 END ELSE 0 END AS v FROM h{k} UNION ALL SELECT {by}, i, {size}, sum(sl * z) + CASE WHEN i < {CHANNELS} THEN any_value(b) ELSE 0 END FROM tz JOIN d{k} USING ({by}, trial) JOIN b{k} USING ({by}, i) GROUP BY {by}, i){gauss_jordan_sql(f"n{k}_", by, size)},
 b{k + 1} AS MATERIALIZED (SELECT {by}, i, b - v AS b FROM b{k} JOIN n{k}_{size} USING ({by}, i) WHERE j = {size})"""
    return out + f", sn AS (SELECT {by}, trial, y, sum(b * z) AS score FROM zr JOIN b{steps} USING ({by}, i) WHERE NOT trains GROUP BY ALL)" + auc_sql("an", "sn", by) + " SELECT subject, cast(repeat AS INT) AS repeat, fold, t, round(auc, 6) AS auc FROM an"


ONE_REPEAT_SQL = MAIN_SQL + folds_sql("subject", K, 1) + ", fr AS (SELECT r.*, f.repeat, f.fold FROM tr r JOIN folds f USING (subject, trial))"


@query("linear_scorer_logreg", V.sql("trial_long", ONE_REPEAT_SQL + newton_sql("logistic", 7)))
def _logreg(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.sliding_auc(rows, fold, ["subject"], "logreg"), "auc")


@query("linear_scorer_forest")
def _forest(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.sliding_auc(rows, fold, ["subject"], "forest"), "auc")


@query("grid_search_linear")
def _linear_grid(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.grid_search_linear(rows, fold, [(c, p) for p in ("l2", "l1") for c in (0.01, 0.1, 1.0, 10.0, 100.0)], ["subject"]), "auc")


def logistic_sql() -> str:
    """sc: the scores of logistic regression after its steps; zr has the scaled rows, each once for each fold."""
    by = "subject, repeat, fold, t"
    out = """, sca AS (SELECT r.subject, r.repeat, g.fold, r.t, r.channel, avg(x) AS m, CASE WHEN var_pop(x) > 1e-18 THEN sqrt(var_pop(x)) ELSE 1 END AS s, count(*) / (2e0 * count(*) FILTER (WHERE y = 0)) AS w0, count(*) / (2e0 * count(*) FILTER (WHERE y = 1)) AS w1 FROM fr r JOIN (SELECT DISTINCT subject, repeat, fold FROM folds) g ON g.subject = r.subject AND g.repeat = r.repeat AND g.fold <> r.fold GROUP BY ALL),
 zc AS (SELECT r.subject, r.repeat, s.fold, r.t, trial, y, r.channel, s.fold <> r.fold AS trains, (x - m) / s AS z, CASE WHEN y = 1 THEN w1 ELSE w0 END AS w FROM fr r JOIN sca s ON s.subject = r.subject AND s.repeat = r.repeat AND s.t = r.t AND s.channel = r.channel),
 zr AS (SELECT * FROM zc UNION ALL SELECT DISTINCT subject, repeat, fold, t, trial, y, -1, trains, 1e0, w FROM zc),
 b0 AS (SELECT DISTINCT subject, repeat, fold, t, channel, 0e0 AS b FROM zr)"""
    for k in range(C.STEPS):
        out += f""", s{k} AS (SELECT {by}, trial, sum(b * z) AS score FROM zr JOIN b{k} USING ({by}, channel) WHERE trains GROUP BY ALL),
 g{k} AS (SELECT {by}, channel, sum(w * (1 / (1 + exp(-score)) - y) * z) AS g, sum(w / (1 + exp(-score)) * (1 - 1 / (1 + exp(-score))) * z * z) AS h FROM zr JOIN s{k} USING ({by}, trial) WHERE trains GROUP BY ALL),
 b{k + 1} AS MATERIALIZED (SELECT {by}, channel, b - {C.DAMPING}e0 * (g + CASE WHEN channel = -1 THEN 0 ELSE b / {C.PENALTY}e0 END) / (h + CASE WHEN channel = -1 THEN 0 ELSE 1 / {C.PENALTY}e0 END) AS b FROM b{k} JOIN g{k} USING ({by}, channel))"""
    return out + f", sc AS (SELECT {by}, trial, y, sum(b * z) AS score FROM zr JOIN b{C.STEPS} USING ({by}, channel) WHERE NOT trains GROUP BY ALL)"


LOGISTIC_SQL = MAIN_SQL + folds_sql("subject", K, 1) + ", fr AS (SELECT r.*, f.repeat, f.fold FROM tr r JOIN folds f USING (subject, trial))" + logistic_sql()


@query("linear_scorer_logistic", V.sql("trial_long", LOGISTIC_SQL + " SELECT subject, cast(repeat AS INT) AS repeat, fold, t, trial, y, round(score, 6) + 0 AS score FROM sc"))
def _logistic(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.linear_scorer(C.folded_rows(rows, fold, ["subject"]), ["subject", "repeat"], "logistic").select("subject", "repeat", "fold", "t", "trial", "y", "score"), "score")


@query("linear_scorer_svc", V.sql("trial_long", ONE_REPEAT_SQL + newton_sql("squared_hinge", 8)))
def _svc(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.sliding_auc(rows, fold, ["subject"], "linear_svc"), "auc")


@query("sliding_auc", V.sql("trial_long", SLIDE_SQL + " SELECT subject, t, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS sd_auc FROM au GROUP BY 1, 2"))
def _sliding(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d)
    return rounded(C.fold_mean_sd(C.sliding_auc(rows, fold, ["subject"]), ["subject", "t"]), "mean_auc", "sd_auc")


TGM_SQL = MAIN_SQL + folds_sql("subject", K, 1) + fit_sql("subject", "channel, t") + ", sc AS (SELECT fr.subject, fr.repeat, fr.fold, wt.t AS t_train, fr.t AS t_test, trial, y, sum(w * (x - mid)) AS score FROM fr JOIN wt ON wt.subject = fr.subject AND wt.repeat = fr.repeat AND wt.fold = fr.fold AND wt.channel = fr.channel GROUP BY ALL)" + auc_sql("au", "sc", "subject, repeat, fold, t_train, t_test")


def tgm(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return C.generalisation_matrix(rows, fold, ["subject"])


@query("generalisation_matrix", V.sql("trial_long", TGM_SQL + " SELECT subject, t_train, t_test, round(avg(auc), 6) AS auc FROM au GROUP BY 1, 2, 3"))
def _tgm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tgm(spark, d).groupBy("subject", "t_train", "t_test").agg(F.avg("auc").alias("auc")), "auc")


GLOBAL_SQL = MAIN_SQL + folds_sql() + fit_sql("subject", "channel, t") + score_sql("subject", "")


def whole(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d)
    return C.global_decode(rows, fold, ["subject"])


@query("global_decode", V.sql("trial_long", GLOBAL_SQL + " SELECT subject, cast(repeat AS INT) AS repeat, fold, trial, y, round(score, 6) + 0 AS score FROM sc"))
def _global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole(spark, d).select("subject", "repeat", "fold", "trial", "y", "score"), "score")


PIPE_PERCENT, PIPE_SHRINK = 25, 0.1
PIPE_GRID = [(10.0, 0.0), (25.0, 0.1), (50.0, 0.1), (100.0, 1.0)]


def pipe_sql(percent: float, shrink: float, name: str = "") -> str:
    """sp: scores of the pipeline; st: each feature's training rows outside a fold."""
    return f""", st{name} AS (SELECT r.subject, r.repeat, g.fold, r.channel, r.t, count(*) AS n, count(*) FILTER (WHERE y = 0) AS n0, count(*) FILTER (WHERE y = 1) AS n1, avg(x) AS m, avg(x) FILTER (WHERE y = 0) AS m0, avg(x) FILTER (WHERE y = 1) AS m1, var_pop(x) AS v, var_pop(x) FILTER (WHERE y = 0) AS v0, var_pop(x) FILTER (WHERE y = 1) AS v1 FROM fr r JOIN (SELECT DISTINCT subject, repeat, fold FROM folds) g ON g.subject = r.subject AND g.repeat = r.repeat AND g.fold <> r.fold GROUP BY ALL),
 fv{name} AS (SELECT *, (n0 * pow(m0 - m, 2) + n1 * pow(m1 - m, 2)) / ((n0 * v0 + n1 * v1) / (n - 2)) AS f, CASE WHEN v > 1e-18 THEN sqrt(v) ELSE 1 END AS sd FROM st{name} WHERE m0 IS NOT NULL AND m1 IS NOT NULL),
 sl{name} AS (SELECT *, (m1 - m0) / sd / ((v0 + v1) / 2 / (sd * sd) + {shrink}e0) / sd AS w, (m0 + m1) / 2 AS mid FROM (SELECT *, row_number() OVER (PARTITION BY subject, repeat, fold ORDER BY f DESC, channel, t) AS k, ceil(count(*) OVER (PARTITION BY subject, repeat, fold) * {percent / 100}e0) AS most FROM fv{name}) WHERE k <= most),
 sp{name} AS (SELECT subject, repeat, fold, trial, y, sum(w * (x - mid)) AS score FROM fr JOIN sl{name} USING (subject, repeat, fold, channel, t) GROUP BY ALL)"""


FOLDED_SQL = MAIN_SQL + folds_sql("subject", K, 1) + ", fr AS (SELECT r.*, f.repeat, f.fold FROM tr r JOIN folds f USING (subject, trial))"


@query("global_decode_pipeline", V.sql("trial_long", FOLDED_SQL + pipe_sql(PIPE_PERCENT, PIPE_SHRINK) + " SELECT subject, cast(repeat AS INT) AS repeat, fold, trial, y, round(score, 6) + 0 AS score FROM sp"))
def _pipeline(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.global_decode_pipeline(rows, fold, ["subject"], PIPE_PERCENT, PIPE_SHRINK).select("subject", "repeat", "fold", "trial", "y", "score"), "score")


@query("grid_search_pipeline", V.sql("trial_long", FOLDED_SQL + "".join(pipe_sql(p, s, f"_{k}") + auc_sql(f"au_{k}", f"sp_{k}", "subject, repeat, fold") for k, (p, s) in enumerate(PIPE_GRID)) + ", m AS (" + " UNION ALL ".join(f"SELECT subject, {k} AS k, {p}e0 AS percentile, {s}e0 AS shrink, round(avg(auc), 9) AS auc FROM au_{k} GROUP BY 1" for k, (p, s) in enumerate(PIPE_GRID)) + ") SELECT subject, percentile, shrink, round(auc, 6) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY auc DESC, k) AS o FROM m) WHERE o = 1"))
def _pipeline_grid(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.grid_search_pipeline(rows, fold, PIPE_GRID, ["subject"]), "auc")


@query("auc", V.sql("prediction", ", p AS (SELECT *, trial % 7 AS g FROM prediction)" + auc_sql("au", "p", "g") + " SELECT g, round(auc, 6) AS auc FROM au"))
def _auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.auc(V.prediction(spark, d).withColumn("g", F.col("trial") % 7), ["g"]), "auc")


@query("pooled_predictions", V.sql("trial_long", GLOBAL_SQL + " SELECT subject, trial, y, round(arg_max(score, repeat), 6) + 0 AS p, CASE WHEN arg_max(score, repeat) > 0 THEN 1 ELSE 0 END AS yhat, round(avg(score), 6) + 0 AS p_mean FROM sc GROUP BY 1, 2, 3"))
def _pooled(spark: SparkSession, d: str) -> DataFrame:
    scores = whole(spark, d)
    mean = C.pooled_predictions(scores, ["subject"], "mean").select("subject", "trial", F.col("p").alias("p_mean"))
    return rounded(C.pooled_predictions(scores, ["subject"]).join(mean, ["subject", "trial"]), "p", "p_mean")


METRICS = """, c AS (SELECT {k}, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp, count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn, count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM p GROUP BY 1),
 m AS (SELECT {k}, tp + fn AS n1, tn + fp AS n0, (tp + tn) / (tp + tn + fp + fn) AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, CASE WHEN 2 * tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END AS f0 FROM c)"""


@query("class_metrics", V.sql("prediction", ", p AS (SELECT trial % 7 AS g, y, yhat FROM prediction)" + METRICS.format(k="g") + " SELECT g, 'binary' AS average, round(accuracy, 6) AS accuracy, round(p1, 6) AS precision, round(r1, 6) AS recall, round(f1, 6) AS f1, round((r1 + r0) / 2, 6) AS balanced_accuracy FROM m UNION ALL SELECT g, 'weighted', round(accuracy, 6), round((p1 * n1 + p0 * n0) / (n1 + n0), 6), round((r1 * n1 + r0 * n0) / (n1 + n0), 6), round((f1 * n1 + f0 * n0) / (n1 + n0), 6), round((r1 + r0) / 2, 6) FROM m"))
def _metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = V.prediction(spark, d).withColumn("g", F.col("trial") % 7)
    both = [C.class_metrics(rows, ["g"], a).withColumn("average", F.lit(a)) for a in ("binary", "weighted")]
    return rounded(both[0].unionByName(both[1]), "accuracy", "precision", "recall", "f1", "balanced_accuracy")


@query("confusion_matrix", V.sql("prediction", "SELECT y, yhat, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM prediction GROUP BY 1, 2"))
def _confusion(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.confusion_matrix(V.prediction(spark, d)), "share")


@query("roc_curve", V.sql("prediction", ", a AS (SELECT trial % 3 AS g, score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM prediction GROUP BY 1, 2) SELECT g, score AS threshold, round(sum(n) OVER u / sum(n) OVER w, 6) AS fpr, round(sum(p) OVER u / sum(p) OVER w, 6) AS tpr FROM a WINDOW w AS (PARTITION BY g), u AS (PARTITION BY g ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
def _roc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.roc_curve(V.prediction(spark, d).withColumn("g", F.col("trial") % 3), ["g"]), "fpr", "tpr")


@query("fold_mean_sd", V.sql("trial_long", SLIDE_SQL + " SELECT subject, cast(repeat AS INT) AS repeat, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS sd_auc FROM au GROUP BY 1, 2"))
def _mean_sd(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d)
    return rounded(C.fold_mean_sd(C.sliding_auc(rows, fold, ["subject"]), ["subject", "repeat"]), "mean_auc", "sd_auc")


@query("peak", V.sql("score_matrix", "SELECT subject, score AS peak, t AS t_peak FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, t) AS k FROM score_matrix) WHERE k = 1"))
def _peak(spark: SparkSession, d: str) -> DataFrame:
    return C.peak(V.score_matrix(spark, d), ["subject"])


CURVES_SQL = COMPARE_SQL + folds_sql("cmp, subject", 3, 1) + fit_sql("cmp, subject", "channel, t") + score_sql("cmp, subject") + auc_sql("au", "sc", "cmp, subject, repeat, fold, t") + ", curve AS (SELECT cmp, subject, t, avg(auc) AS auc FROM au GROUP BY 1, 2, 3)"


def curves(spark: SparkSession, d: str) -> DataFrame:
    rows = compared(spark, d)
    fold = C.stratified_folds(rows, ["cmp", "subject"], 3, 1)
    return C.sliding_auc(rows, fold, ["cmp", "subject"]).groupBy("cmp", "subject", "t").agg(F.avg("auc").alias("auc"))


@query("stack_comparisons", V.sql("trial_long", CURVES_SQL + " SELECT subject, t, round(avg(auc), 6) AS mean, round(stddev_samp(auc) / sqrt(count(auc)), 6) AS sem, count(auc) AS n FROM curve GROUP BY 1, 2 HAVING count(auc) >= 2"))
def _stack(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.stack_comparisons(curves(spark, d)), "mean", "sem")


@query("anchor_average", V.sql("trial_long", CURVES_SQL + ", fam(anchor, cmp) AS (VALUES ('A', 'all'), ('A', 'some'), ('B', 'some')) SELECT subject, anchor, t, round(avg(auc), 6) AS mean, round(stddev_samp(auc) / sqrt(count(auc)), 6) AS sem, count(auc) AS n FROM curve JOIN fam USING (cmp) GROUP BY 1, 2, 3"))
def _anchor(spark: SparkSession, d: str) -> DataFrame:
    family = spark.createDataFrame([("A", "all"), ("A", "some"), ("B", "some")], "anchor string, cmp string")
    return rounded(C.anchor_average(curves(spark, d), family), "mean", "sem")


GRID = [0.0, 0.01, 0.1, 1.0]
GRID_SQL = MAIN_SQL + folds_sql("subject", K, 1) + fit_sql("subject", "channel, t") + ", grid(shrink) AS (VALUES " + ", ".join(f"({g}e0)" for g in GRID) + "), sc AS (SELECT subject, repeat, fold, shrink, trial, y, sum((m1 - m0) / (s2 + shrink) * (x - mid)) AS score FROM fr JOIN wt USING (subject, repeat, fold, channel, t) CROSS JOIN grid GROUP BY ALL)" + auc_sql("au", "sc", "subject, shrink, repeat, fold")


@query("grid_search", V.sql("trial_long", GRID_SQL + ", m AS (SELECT subject, shrink, round(avg(auc), 9) AS auc FROM au GROUP BY 1, 2) SELECT subject, shrink, round(auc, 6) AS auc FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY auc DESC, shrink) AS k FROM m) WHERE k = 1"))
def _grid(spark: SparkSession, d: str) -> DataFrame:
    rows, fold = rows_folds(spark, d, 1)
    return rounded(C.grid_search(rows, fold, spark.createDataFrame([(g,) for g in GRID], "shrink double"), ["subject"]), "auc")


CONFIG = [(2, 1), (5, 1), (2, 4), (5, 4)]
CONFIG_SQL = ", raw AS (SELECT subject, trial, channel, t, x, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM trial_long), cfg(n_folds, step) AS (VALUES " + ", ".join(map(str, CONFIG)) + "), tr AS (SELECT n_folds, step, subject, trial, y, channel, cast(t // step AS INT) AS t, avg(x) AS x FROM raw CROSS JOIN cfg GROUP BY ALL)" + folds_sql("n_folds, step, subject", "n_folds", 1) + fit_sql("n_folds, step, subject", "channel, t") + score_sql("n_folds, step, subject") + auc_sql("au", "sc", "n_folds, step, subject, repeat, fold, t")


@query("config_sweep", V.sql("trial_long", CONFIG_SQL + " SELECT n_folds, step, subject, t, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS sd_auc FROM au GROUP BY 1, 2, 3, 4"))
def _sweep(spark: SparkSession, d: str) -> DataFrame:
    return rounded(C.config_sweep(main(spark, d), spark.createDataFrame(CONFIG, "n_folds int, step int"), ["subject"]), "mean_auc", "sd_auc")


GROUP_SQL = ", mem(subject) AS (VALUES (0), (2), (4), (9)), tr AS (SELECT subject, trial, channel, t, x, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y FROM trial_long JOIN mem USING (subject))" + folds_sql("subject", K, 1) + fit_sql("subject", "channel, t") + score_sql("subject", "") + auc_sql("au", "sc", "subject, repeat, fold")


@query("group_run", V.sql("trial_long", GROUP_SQL + " SELECT cast(m.subject AS BIGINT) AS subject, round(avg(auc), 6) AS auc, avg(auc) IS NOT NULL AS processed FROM mem m LEFT JOIN au USING (subject) GROUP BY 1"))
def _run(spark: SparkSession, d: str) -> DataFrame:
    groups = spark.createDataFrame([(0, "g"), (1, "h"), (2, "g"), (3, "h"), (4, "g"), (9, "g")], "subject long, grp string")
    return rounded(C.group_run(main(spark, d), groups, "g", K), "auc")
