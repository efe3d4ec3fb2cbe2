"""What the library works on, as views of the given tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trials of a recording; more vectors are more subjects.
TRIALS = 100
CODES = {"purchase": 1, "click": 2, "view": 3, "signup": 4, "error": 5}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trial_long(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), "label", F.posexplode("embedding").alias("pos", "v"))
    return rows.select(F.expr(f"trial div {TRIALS}").alias("subject"), "trial", F.expr("cast(pos div 8 as int)").alias("channel"), (F.col("pos") % 8).cast("int").alias("t"), F.col("v").cast("double").alias("x"), "label")


def code_column() -> Column:
    return F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])[F.col("event_type")]


def event_seq(spark: SparkSession, d: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, d, "events").select(F.col("user_id").alias("subject"), seq.alias("seq"), "event_id", "ts", code_column().alias("code"), "value")


def event_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("subject"), "event_id", F.concat("event_type", F.lit("/"), (F.col("event_id") % 3).cast("string")).alias("name"))


def cont_signal(spark: SparkSession, d: str) -> DataFrame:
    rows = event_seq(spark, d)
    following = F.coalesce(F.lead("value").over(Window.partitionBy("subject").orderBy("seq")), F.lit(0.0))
    wide = rows.withColumn("following", following).select("subject", "seq", F.explode(F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("following"))).alias("channel", "x"))
    return wide.select("subject", "channel", F.col("seq").alias("sample"), "x")


def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("subject"), F.month("l_shipdate").alias("t")).agg((F.avg("l_discount") * 10).alias("score"))
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return line.join(place.select(F.col("s_suppkey").alias("subject"), F.col("r_name").alias("grp")), "subject").select("grp", "subject", "t", F.round("score", 9).alias("score"))


def pair_matrix(spark: SparkSession, d: str) -> DataFrame:
    x = trial_long(spark, d).groupBy("subject", "channel", "t").agg(F.avg("x").alias("x"))
    i, j = x.withColumnsRenamed({"channel": "ch_i", "x": "a"}), x.withColumnsRenamed({"channel": "ch_j", "x": "b"})
    return i.join(j, ["subject", "t"]).where("ch_i > ch_j").groupBy("subject", "ch_i", "ch_j").agg((F.sum(F.col("a") * F.col("b")) * 100).alias("value"))


def prediction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("doc_id").alias("trial"), F.col("quality").alias("y"), F.col("n_chars").cast("double").alias("score"))
    middle = rows.agg(F.percentile("score", 0.5).alias("middle"))
    return rows.crossJoin(F.broadcast(middle)).select("trial", "y", "score", F.when(F.col("score") > F.col("middle"), 1).otherwise(0).alias("yhat"))


def _case() -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items()) + " END"


VIEWS = {
    "trial_long": "trial_long AS (SELECT vec_id // 100 AS subject, vec_id AS trial, cast((i - 1) // 8 AS INT) AS channel, cast((i - 1) % 8 AS INT) AS t, cast(embedding[i] AS DOUBLE) AS x, label FROM (SELECT vec_id, embedding, label, unnest(range(1, 65)) AS i FROM embeddings))",
    "event_seq": f"event_seq AS (SELECT user_id AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, {_case()} AS code, value FROM events)",
    "event_names": "event_names AS (SELECT user_id AS subject, event_id, event_type || '/' || cast(event_id % 3 AS VARCHAR) AS name FROM events)",
    "score_matrix": "score_matrix AS (SELECT r_name AS grp, subject, t, round(score, 9) AS score FROM (SELECT l_suppkey AS subject, cast(month(l_shipdate) AS INT) AS t, avg(l_discount) * 10 AS score FROM lineitem GROUP BY 1, 2) JOIN supplier ON s_suppkey = subject JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "prediction": "prediction AS (SELECT doc_id AS trial, quality AS y, cast(n_chars AS DOUBLE) AS score, CASE WHEN n_chars > (SELECT quantile_cont(cast(n_chars AS DOUBLE), 0.5) FROM labels JOIN documents USING (doc_id)) THEN 1 ELSE 0 END AS yhat FROM labels JOIN documents USING (doc_id))",
}
VIEWS["cont_signal"] = VIEWS["event_seq"] + ", cont_signal AS (SELECT subject, 'a' AS channel, seq AS sample, value AS x FROM event_seq UNION ALL SELECT subject, 'b', seq, coalesce(lead(value) OVER (PARTITION BY subject ORDER BY seq), 0) FROM event_seq)"
VIEWS["pair_matrix"] = VIEWS["trial_long"] + ", pair_mean AS (SELECT subject, channel, t, avg(x) AS x FROM trial_long GROUP BY ALL), pair_matrix AS (SELECT i.subject, i.channel AS ch_i, j.channel AS ch_j, sum(i.x * j.x) * 100 AS value FROM pair_mean i JOIN pair_mean j ON i.subject = j.subject AND i.t = j.t AND i.channel > j.channel GROUP BY ALL)"


def sql(views: str, body: str) -> str:
    """``body`` with the named views before it; a body may go on with more of them after a comma."""
    seen, parts = set(), []
    for v in views.split():
        if VIEWS[v] not in seen:
            seen.add(VIEWS[v])
            parts.append(VIEWS[v])
    return "WITH " + ", ".join(parts) + (body if body.startswith(",") else " " + body)
