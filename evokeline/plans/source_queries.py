"""Queries of the sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import scratch
from ..sources import tables as S
from ..streaming import streams as R
from ..streaming.blinks import stream_blinks
from . import views as V
from .decode_queries import CURVES_SQL, curves
from .registry import query, rounded


@query("scan_trials", V.sql("trial_long", "SELECT CASE WHEN label < 5 THEN 'old' ELSE 'new' END AS condition, subject, trial, channel, t, round(x, 6) AS x FROM trial_long WHERE subject IN (1, 3) AND label < 5 AND channel IN (0, 2, 5)"))
def _trials(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "trials")
    rows = V.trial_long(spark, d).select("subject", "trial", "channel", "t", "x", F.when(F.col("label") < 5, "old").otherwise("new").alias("condition"), F.lit("LG").alias("protocol"))
    rows.repartition("subject").write.partitionBy("protocol", "subject").parquet(path)
    found = S.scan_trials(spark, path, [1, 3], ["old"], [0, 2, 5])
    return rounded(found.select("condition", F.col("subject").cast("long").alias("subject"), "trial", "channel", "t", "x"), "x")


@query("scan_csv_sheet", V.sql("event_seq", "SELECT subject, seq AS row_no, (seq - 1) % 5 + 1 AS idx, code AS trigger, round(value, 6) AS isi FROM event_seq"))
def _sheet(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "sheet")
    V.event_seq(spark, d).select("subject", F.col("seq").alias("row_no"), ((F.col("seq") - 1) % 5 + 1).alias("idx"), F.col("code").alias("trigger"), F.col("value").alias("isi")).write.csv(path, header=True)
    return rounded(S.scan_csv_sheet(spark, path, "subject long, row_no long, idx long, trigger int, isi double"), "isi")


VERSIONS = [("noise_rejected", 1), ("noise", 2), ("rejected", 3), ("plain", 4)]
CAND_SQL = ", cand AS (SELECT CASE WHEN code = 5 THEN 'Tp' ELSE '' END || 'S' || cast(subject AS VARCHAR) AS subject, 'f/' || cast(seq AS VARCHAR) AS path, CASE WHEN code = 1 AND subject % 3 = 0 THEN 'noise' WHEN code = 2 AND subject % 2 = 0 THEN 'rejected' WHEN code = 5 THEN 'noise_rejected' ELSE 'plain' END AS version FROM event_seq)"


@query("best_version", V.sql("event_seq", CAND_SQL + ", pr(version, rank) AS (VALUES " + ", ".join(map(str, VERSIONS)) + ") SELECT s AS subject, path, version FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY a, rank, path) AS k FROM (SELECT CASE WHEN starts_with(subject, 'Tp') THEN substring(subject, 3) ELSE subject END AS s, CASE WHEN starts_with(subject, 'Tp') THEN 1 ELSE 0 END AS a, path, version, rank FROM cand JOIN pr USING (version))) WHERE k = 1"))
def _best(spark: SparkSession, d: str) -> DataFrame:
    version = F.when(F.expr("code = 1 and subject % 3 = 0"), "noise").when(F.expr("code = 2 and subject % 2 = 0"), "rejected").when(F.col("code") == 5, "noise_rejected")
    rows = V.event_seq(spark, d).select(F.concat(F.when(F.col("code") == 5, "Tp").otherwise(""), F.lit("S"), F.col("subject").cast("string")).alias("subject"), F.concat(F.lit("f/"), F.col("seq").cast("string")).alias("path"), F.coalesce(version, F.lit("plain")).alias("version"))
    return S.best_version(rows, spark.createDataFrame(VERSIONS, "version string, rank int"))


PATH_SQL = ", paths AS (SELECT 'data/g' || cast(subject % 6 AS VARCHAR) || '/' || CASE WHEN code < 3 THEN 'PP' ELSE 'LG' END || '/' || CASE WHEN code = 4 THEN 'Subj_' ELSE 'p' END || 'T' || cast(subject AS VARCHAR) || '/res_' || cast(seq AS VARCHAR) || '.npz' AS path FROM event_seq)"


def paths(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.lit("data/g"), (F.col("subject") % 6).cast("string"), F.lit("/"), F.when(F.col("code") < 3, "PP").otherwise("LG"), F.lit("/"), F.when(F.col("code") == 4, "Subj_").otherwise("p"), F.lit("T"), F.col("subject").cast("string"), F.lit("/res_"), F.col("seq").cast("string"), F.lit(".npz")]
    return V.event_seq(spark, d).select(F.concat(*parts).alias("path"))


@query("catalog_results", V.sql("event_seq", PATH_SQL + ", p AS (SELECT path, string_split(path, '/') AS s FROM paths) SELECT path, s[2] AS grp, s[3] AS protocol, s[4] AS subject FROM p WHERE s[2] IN ('g0', 'g1', 'g4')"))
def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return S.catalog_results(paths(spark, d), spark.createDataFrame([(1, "g0"), (2, "g1"), (3, "g4"), (4, "g4")], "subject int, grp string")).select("path", "grp", "protocol", "subject")


@query("subject_from_path", V.sql("event_seq", PATH_SQL + ", ids(id) AS (VALUES ('T1'), ('T12'), ('T120'), ('T7')), m AS (SELECT path, max(struct_pack(n := length(id), i := id)) AS m FROM (SELECT DISTINCT path FROM paths) JOIN ids ON contains(path, id) GROUP BY 1) SELECT p.path, coalesce(m.m.i, nullif(regexp_extract(p.path, 'Subj_([A-Za-z0-9]+)', 1), ''), nullif(regexp_extract(p.path, '([^/]+)/[^/]*$', 1), '')) AS subject FROM paths p LEFT JOIN m ON m.path = p.path"))
def _subject(spark: SparkSession, d: str) -> DataFrame:
    return S.subject_from_path(paths(spark, d), spark.createDataFrame([("T1",), ("T12",), ("T120",), ("T7",)], "id string"))


@query("sink_summary", V.sql("trial_long", CURVES_SQL + " SELECT subject, " + ", ".join(f"round({f} FILTER (WHERE cmp = '{c}'), 6) AS {c}_{n}" for c in ("all", "some") for f, n in (("avg(auc)", "mean"), ("stddev_pop(auc)", "sd"), ("max(auc)", "peak"))) + " FROM curve GROUP BY 1"))
def _summary(spark: SparkSession, d: str) -> DataFrame:
    path, names = scratch(spark, "summary"), [f"{c}_{n}" for c in ("all", "some") for n in ("mean", "sd", "peak")]
    S.sink_summary(curves(spark, d), ["all", "some"], path)
    return rounded(S.scan_csv_sheet(spark, path, "subject long, " + ", ".join(f"{n} double" for n in names)), *names)


@query("sink_matrix", V.sql("pair_matrix", ", m AS (SELECT ch_i, ch_j, avg(value) AS v FROM (SELECT ch_i, ch_j, value FROM pair_matrix UNION ALL SELECT ch_j, ch_i, value FROM pair_matrix) GROUP BY 1, 2) SELECT ch_i, " + ", ".join(f'round(max(v) FILTER (WHERE ch_j = {c}), 6) + 0 AS "{c}"' for c in range(8)) + " FROM m GROUP BY 1"))
def _matrix(spark: SparkSession, d: str) -> DataFrame:
    pairs, path = V.pair_matrix(spark, d), scratch(spark, "matrix")
    both = pairs.select("ch_i", "ch_j", "value").unionAll(pairs.select("ch_j", "ch_i", "value")).groupBy("ch_i", "ch_j").agg(F.avg("value").alias("value"))
    S.sink_matrix(both, "ch_i", "ch_j", "value", path, list(range(8)))
    return rounded(spark.read.parquet(path), *map(str, range(8)))


@query("validate_axes", V.sql("score_matrix", ", a AS (SELECT DISTINCT subject, t FROM score_matrix WHERE NOT (subject % 9 = 2 AND t = 12) AND NOT (subject % 9 = 4 AND t % 2 = 1)), s AS (SELECT *, t - lag(t) OVER (PARTITION BY subject ORDER BY t) AS st FROM a), x AS (SELECT subject, count(*) AS n, string_agg(cast(t AS VARCHAR), ',' ORDER BY t) AS axis, cast(round(1000e0 / avg(st)) AS BIGINT) AS rate FROM s GROUP BY 1) SELECT subject, n, axis, rate, axis = (SELECT axis FROM x GROUP BY 1 ORDER BY count(*) DESC, axis LIMIT 1) AS valid FROM x"))
def _axes(spark: SparkSession, d: str) -> DataFrame:
    rows = V.score_matrix(spark, d).where("not (subject % 9 = 2 and t = 12) and not (subject % 9 = 4 and t % 2 = 1)")
    return S.validate_axes(rows, ["subject"], "t")


@query("update_bad_channels", V.sql("event_seq", ", pt AS (SELECT subject, CASE code WHEN 1 THEN 'PP' ELSE 'LG' END AS protocol, 'E' || cast(min(seq) AS VARCHAR) AS bad FROM event_seq GROUP BY 1, 2) SELECT subject, protocol, CASE WHEN subject % 3 = 0 AND protocol = 'PP' THEN 'E23,E125' ELSE bad END AS bad_chans FROM pt"))
def _bad(spark: SparkSession, d: str) -> DataFrame:
    sheet = V.event_seq(spark, d).groupBy("subject", F.when(F.col("code") == 1, "PP").otherwise("LG").alias("protocol")).agg(F.array(F.concat(F.lit("E"), F.min("seq").cast("string"))).alias("bad_chans"))
    updates = sheet.where("subject % 3 = 0 and protocol = 'PP'").select("subject", "protocol", F.array(F.lit("E23"), F.lit("E125")).alias("bad_chans"))
    return S.update_bad_channels(sheet, updates).select("subject", "protocol", F.array_join("bad_chans", ",").alias("bad_chans"))


@query("sink_group_json", V.sql("score_matrix", "SELECT grp, round(avg(score), 6) AS mean, count(*) AS n FROM score_matrix GROUP BY 1"))
def _json(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "json")
    S.sink_group_json(rounded(V.score_matrix(spark, d).groupBy("grp").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n")), "mean"), path)
    return spark.read.schema("grp string, mean double, n long").json(path)


def stream(spark: SparkSession, d: str) -> DataFrame:
    schema = V.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").select(F.col("user_id").alias("subject"), F.expr("cast(convert_timezone('UTC', current_timezone(), ts) as timestamp)").alias("ts"), "value")


def told(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.date_format(F.expr("convert_timezone(current_timezone(), 'UTC', cast(start as timestamp_ntz))"), "yyyy-MM-dd HH:mm:ss"))


WINDOW_SQL = "SELECT user_id AS subject, time_bucket(INTERVAL 6 HOURS, ts) AS s, value FROM events"
DONE = "s + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 30 SECONDS FROM events)"


@query("stream_tumbling_power", f"SELECT subject, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, round(avg(value * value), 6) AS power, count(*) AS n FROM ({WINDOW_SQL}) WHERE {DONE} GROUP BY 1, 2")
def _power(spark: SparkSession, d: str) -> DataFrame:
    return rounded(told(R.finished(R.stream_tumbling_power(stream(spark, d), size="6 hours"), scratch(spark, "power"))), "power")


@query("stream_reject_ptp", f"SELECT subject, strftime(s, '%Y-%m-%d %H:%M:%S') AS start, round(max(value) - min(value), 6) AS ptp, count(*) AS n FROM ({WINDOW_SQL}) WHERE {DONE} GROUP BY 1, 2 HAVING max(value) - min(value) <= 40")
def _ptp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(told(R.finished(R.stream_reject_ptp(stream(spark, d), 40.0, size="6 hours"), scratch(spark, "ptp"))), "ptp")


@query("stream_blink_sessions", "WITH h AS (SELECT user_id AS subject, ts, value, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events WHERE value > 60), g AS (SELECT *, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 12 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY ts) AS k FROM h) SELECT subject, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(max(value), 6) AS peak FROM g GROUP BY subject, k HAVING max(ts) + INTERVAL 12 HOURS <= (SELECT max(ts) - INTERVAL 30 SECONDS FROM h)")
def _blinks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(told(R.finished(R.stream_blink_sessions(stream(spark, d), 60.0, gap="12 hours"), scratch(spark, "blinks"))), "peak")


#: Refractory gap of blinks in microseconds, and how many a subject must have.
GAP, LEAST = 12 * 3600 * 1_000_000, 3
STREAMED_SQL = f"""WITH e AS (SELECT user_id AS subject, epoch_us(ts) AS s, value AS x FROM events), r AS (SELECT * FROM e WHERE s // 1000 <= (SELECT max(s) // 1000 - 30000 FROM e)),
 n AS (SELECT *, lag(x) OVER w AS a, lead(x) OVER w AS b, max(s) OVER (PARTITION BY subject) AS seen FROM r WINDOW w AS (PARTITION BY subject ORDER BY s)),
 p AS (SELECT *, s - lag(s) OVER (PARTITION BY subject ORDER BY s) AS gap FROM n WHERE x > 60 AND (a IS NULL OR x > a) AND x >= b),
 k AS (SELECT *, sum(CASE WHEN gap <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY subject ORDER BY s) AS blink FROM p),
 o AS (SELECT *, row_number() OVER (PARTITION BY subject, blink ORDER BY x DESC, s) AS place, max(s) OVER (PARTITION BY subject, blink) AS final FROM k),
 c AS (SELECT *, count(*) OVER (PARTITION BY subject) AS n FROM o WHERE place = 1 AND seen - final > {GAP})
SELECT subject, cast(blink AS BIGINT) AS blink, s AS sample, round(x, 6) AS peak FROM c WHERE n >= {LEAST}"""


@query("stream_blinks", STREAMED_SQL)
def _stream_blinks(spark: SparkSession, d: str) -> DataFrame:
    rows = stream(spark, d).withColumn("sample", F.unix_micros("ts"))
    found = R.finished(stream_blinks(rows, 60.0, GAP, LEAST), scratch(spark, "stream_blinks"))
    return rounded(found.withColumn("subject", F.col("subject").cast("long")), "peak")
