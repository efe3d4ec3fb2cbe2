"""Queries of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import events as E
from . import views as V
from .registry import query, rounded

DICT = [("purchase", 1), ("click", 2), ("view", 3), ("signup", 4)]
DICT_SQL = "event_dict(name, code) AS (VALUES " + ", ".join(f"('{n}', {c})" for n, c in DICT) + ")"


def event_dict(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICT, "name string, code int")


@query("find_events", V.sql("event_seq", "SELECT subject, seq, code FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY subject ORDER BY seq), 0) AS b FROM (SELECT subject, seq, code, CASE WHEN code = 5 THEN 0 ELSE code END AS v FROM event_seq)) WHERE v <> 0 AND v <> b"))
def _find(spark: SparkSession, d: str) -> DataFrame:
    rows = V.event_seq(spark, d).select("subject", "seq", "code", F.when(F.col("code") == 5, 0).otherwise(F.col("code")).alias("v"))
    return E.find_events(rows, ["subject"], "seq", "v").select("subject", "seq", "code")


STIM = [(1, "S  11", 1), (1, "T 99", 2), (2, "S  21", 1), (3, "Rest", 1), (4, "S 4", 1)]


@query("decode_codes", V.sql("event_seq", ", stim(code, name, place) AS (VALUES " + ", ".join(map(str, STIM)) + "), f AS (SELECT code, arg_min(name, place) AS name FROM stim GROUP BY 1) SELECT e.subject, e.seq, e.code, f.name, CASE WHEN f.name IN ('Rest', 'Code') THEN e.code WHEN regexp_replace(f.name, '[^0-9]', '', 'g') <> '' THEN cast(regexp_replace(f.name, '[^0-9]', '', 'g') AS INT) END AS number FROM event_seq e LEFT JOIN f USING (code)"))
def _decode(spark: SparkSession, d: str) -> DataFrame:
    stim = spark.createDataFrame(STIM, "code int, name string, place int")
    return E.decode_codes(V.event_seq(spark, d).select("subject", "seq", "code"), stim, ["Rest", "Code"]).select("subject", "seq", "code", "name", "number")


@query("drop_control_events", V.sql("event_names", "SELECT subject, event_id, name FROM event_names WHERE name NOT IN ('error/0', 'error/1', 'signup/2')"))
def _control(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("error/0",), ("error/1",), ("signup/2",)], "name string")
    return E.drop_control_events(V.event_names(spark, d), names).select("subject", "event_id", "name")


@query("recording_span", V.sql("cont_signal", ", s AS (SELECT subject, greatest(0, floor(min(seq) / 4e0) - 3) AS lo, floor(max(seq) / 4e0) + 3 AS hi FROM event_seq WHERE code = 1 GROUP BY 1) SELECT subject, channel, sample, round(x, 6) AS x FROM cont_signal JOIN s USING (subject) WHERE sample / 4e0 BETWEEN lo AND hi"))
def _span(spark: SparkSession, d: str) -> DataFrame:
    event = V.event_seq(spark, d).where("code = 1").select("subject", F.col("seq").alias("onset"))
    return rounded(E.recording_span(V.cont_signal(spark, d), event, 3, 4.0).select("subject", "channel", "sample", "x"), "x")


@query("tag_after_marker", V.sql("event_seq", "SELECT subject, seq, CASE WHEN code IN (2, 3) AND m = 1 THEN code + 1000 ELSE code END AS code FROM (SELECT *, max(CASE WHEN code = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY seq ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS m FROM event_seq)"))
def _tag(spark: SparkSession, d: str) -> DataFrame:
    return E.tag_after_marker(V.event_seq(spark, d).select("subject", "seq", "code"), [1], [2, 3], rows=5)


@query("claim_neighbour", V.sql("event_seq", """, k AS (SELECT subject, seq, code, CASE WHEN code = 2 THEN 'c' WHEN code = 3 THEN 'f' ELSE 'x' END AS kind FROM event_seq),
 p AS (SELECT *, lag(kind) OVER (PARTITION BY subject ORDER BY seq) AS prev FROM k),
 r AS (SELECT *, sum(CASE WHEN kind = 'x' OR prev IS NULL OR prev = kind OR prev = 'x' THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY seq) AS run FROM p),
 q AS (SELECT *, first_value(kind) OVER w AS head, lead(kind) OVER w AS nxt, lag(kind) OVER w AS bck FROM r WINDOW w AS (PARTITION BY subject, run ORDER BY seq))
 SELECT subject, seq, CASE WHEN kind = 'f' AND ((head = 'f' AND coalesce(nxt = 'c', false)) OR (head <> 'f' AND coalesce(bck = 'c', false))) THEN code + 2000 ELSE code END AS code FROM q"""))
def _claim(spark: SparkSession, d: str) -> DataFrame:
    return E.claim_neighbour(V.event_seq(spark, d).select("subject", "seq", "code"), [2], [3])


PLAY_SQL = ", playframe AS (SELECT subject, seq AS row_no, (seq - 1) % 10 + 1 AS idx, code AS trigger FROM event_seq)"


def playframe(spark: SparkSession, d: str) -> DataFrame:
    return V.event_seq(spark, d).select("subject", F.col("seq").alias("row_no"), ((F.col("seq") - 1) % 10 + 1).alias("idx"), F.col("code").alias("trigger"))


@query("block_number", V.sql("event_seq", PLAY_SQL + " SELECT *, cast(sum(CASE WHEN idx = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY row_no) AS BIGINT) AS block FROM playframe"))
def _block(spark: SparkSession, d: str) -> DataFrame:
    return E.block_number(playframe(spark, d))


@query("local_global_code", V.sql("event_seq", PLAY_SQL + """, b AS (SELECT *, sum(CASE WHEN idx = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY row_no) AS block, lag(trigger) OVER (PARTITION BY subject ORDER BY row_no) AS p FROM playframe),
 s AS (SELECT *, max(CASE WHEN idx = 5 THEN trigger END) OVER (PARTITION BY subject, block) AS std FROM b)
 SELECT subject, row_no, CASE WHEN row_no % 5 = 0 THEN CASE WHEN coalesce(trigger = p, false) THEN 10 ELSE 20 END + CASE WHEN coalesce(trigger = std, false) THEN 1 ELSE 2 END ELSE 0 END AS lg FROM s"""))
def _lg(spark: SparkSession, d: str) -> DataFrame:
    return E.local_global_code(playframe(spark, d)).select("subject", "row_no", "lg")


@query("zip_events", V.sql("event_seq", PLAY_SQL + ", e AS (SELECT subject, seq, event_id, row_number() OVER (PARTITION BY subject ORDER BY seq) AS i FROM event_seq WHERE code <> 5), p AS (SELECT subject, row_no, trigger, row_number() OVER (PARTITION BY subject ORDER BY row_no) AS i FROM playframe WHERE trigger <> 4) SELECT subject, seq, event_id, row_no, trigger FROM e JOIN p USING (subject, i)"))
def _zip(spark: SparkSession, d: str) -> DataFrame:
    event = V.event_seq(spark, d).where("code <> 5").select("subject", "seq", "event_id")
    return E.zip_events(event, playframe(spark, d).where("trigger <> 4").select("subject", "row_no", "trigger"))


SPECS = [("pay", "purchase/"), ("pay", "signup/1"), ("zero", "/0"), ("look", "view*"), ("any", "cli"), ("none", "missing/x")]
SPEC_SQL = ", spec(condition, spec) AS (VALUES " + ", ".join(map(str, SPECS)) + "), names AS (SELECT DISTINCT name FROM event_names), matched AS (SELECT DISTINCT condition, name FROM names JOIN spec ON name = spec OR (spec LIKE '%/' AND starts_with(name, spec)) OR (spec LIKE '%*' AND starts_with(name, left(spec, -1))) OR (spec LIKE '/%' AND ends_with(name, spec)) OR (spec NOT LIKE '%/' AND spec NOT LIKE '%*' AND spec NOT LIKE '/%' AND starts_with(name, spec) AND spec NOT IN (SELECT name FROM names)))"


def specs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SPECS, "condition string, spec string")


@query("match_conditions", V.sql("event_names", SPEC_SQL + " SELECT condition, name FROM matched"))
def _match(spark: SparkSession, d: str) -> DataFrame:
    return E.match_conditions(V.event_names(spark, d), specs(spark))


@query("expand_conditions", V.sql("event_names", SPEC_SQL + " SELECT subject, event_id, name, condition FROM event_names JOIN matched USING (name)"))
def _expand(spark: SparkSession, d: str) -> DataFrame:
    names = V.event_names(spark, d)
    return E.expand_conditions(names, E.match_conditions(names, specs(spark))).select("subject", "event_id", "name", "condition")


RULES = [("full", ["/k7/", "/k11/", "view/1"]), ("pay", ["purchase/1", "/k30/"]), ("look", ["view/", "/k50/"])]
PROTOCOL_SQL = ", proto AS (SELECT subject, CASE " + " ".join("WHEN " + " AND ".join(f"bool_or(contains(name, '{t}'))" for t in own) + f" THEN '{n}'" for n, own in RULES) + " ELSE 'other' END AS protocol FROM tagged GROUP BY 1)"
TAGGED_SQL = ", tagged AS (SELECT user_id AS subject, event_type || '/' || cast(event_id % 3 AS VARCHAR) || '/k' || regexp_extract(props, '[0-9]+') || '/' AS name FROM events)"


def tagged(spark: SparkSession, d: str) -> DataFrame:
    parts = [F.col("event_type"), F.lit("/"), (F.col("event_id") % 3).cast("string"), F.lit("/k"), F.regexp_extract("props", "[0-9]+", 0), F.lit("/")]
    return V.table(spark, d, "events").select(F.col("user_id").alias("subject"), F.concat(*parts).alias("name"))


@query("detect_protocol", V.sql("event_names", TAGGED_SQL + PROTOCOL_SQL + " SELECT * FROM proto"))
def _protocol(spark: SparkSession, d: str) -> DataFrame:
    return E.detect_protocol(tagged(spark, d), RULES, hint="other")


ADAPT = [("full", "a", "purchase/"), ("full", "b", "error/2/k3"), ("pay", "a", "purchase/0/k9"), ("pay", "b", "click/1"), ("look", "b", "view/2/k5"), ("other", "c", "error/")]


@query("adapt_conditions", V.sql("event_names", TAGGED_SQL + PROTOCOL_SQL + ", adapt(protocol, condition, spec) AS (VALUES " + ", ".join(map(str, ADAPT)) + ") SELECT subject, condition, spec FROM proto JOIN adapt USING (protocol) WHERE EXISTS (SELECT 1 FROM tagged e WHERE e.subject = proto.subject AND starts_with(e.name, spec))"))
def _adapt(spark: SparkSession, d: str) -> DataFrame:
    names = tagged(spark, d)
    return E.adapt_conditions(names, E.detect_protocol(names, RULES, hint="other"), spark.createDataFrame(ADAPT, "protocol string, condition string, spec string"))


COUNT_DICT = ["purchase/0", "purchase/1", "click/0", "absent/9"]


@query("event_counts", V.sql("event_names", ", names(name) AS (VALUES " + ", ".join(f"('{x}')" for x in COUNT_DICT) + "), c AS (SELECT s.subject, n.name, count(e.event_id) AS n FROM (SELECT DISTINCT subject FROM event_names) s CROSS JOIN names n LEFT JOIN event_names e ON e.subject = s.subject AND e.name = n.name GROUP BY 1, 2) SELECT subject, name, n, round(CASE WHEN sum(n) OVER (PARTITION BY subject) > 0 THEN 100e0 * n / sum(n) OVER (PARTITION BY subject) ELSE 0 END, 6) AS percent FROM c"))
def _counts(spark: SparkSession, d: str) -> DataFrame:
    return rounded(E.event_counts(V.event_names(spark, d), spark.createDataFrame([(x,) for x in COUNT_DICT], "name string")).select("subject", "name", "n", "percent"), "percent")


@query("event_table", V.sql("event_seq", ", " + DICT_SQL + " SELECT subject, row_number() OVER (PARTITION BY subject ORDER BY seq) - 1 AS \"index\", seq * 125 AS onset, 0 AS duration, code, coalesce(name, 'Unknown') AS name, round(seq * 125 / 500e0, 6) AS time_s FROM event_seq LEFT JOIN event_dict USING (code)"))
def _table(spark: SparkSession, d: str) -> DataFrame:
    event = V.event_seq(spark, d).select("subject", "seq", (F.col("seq") * 125).alias("onset"), "code")
    return rounded(E.event_table(event, event_dict(spark), 500.0), "time_s")


@query("compare_dict", V.sql("event_seq", ", " + DICT_SQL + ", o AS (SELECT event_type AS name, CASE WHEN event_type = 'view' THEN 9 ELSE min(length(event_type)) END AS observed FROM events GROUP BY 1) SELECT coalesce(o.name, e.name) AS name, cast(observed AS BIGINT) AS observed, code AS expected, observed IS NOT DISTINCT FROM code AS matched FROM o FULL JOIN event_dict e ON o.name = e.name"))
def _compare(spark: SparkSession, d: str) -> DataFrame:
    observed = V.table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.min(F.length("event_type")).alias("n")).select("name", F.when(F.col("name") == "view", 9).otherwise(F.col("n")).cast("long").alias("code"))
    return E.compare_dict(observed, event_dict(spark))


@query("resolve_group", V.sql("event_seq", "SELECT subject, count(*) AS n, coalesce(any_value(CASE WHEN subject % 4 < 3 THEN 'g' || cast(subject % 4 AS VARCHAR) END), 'unknown') AS grp FROM event_seq GROUP BY 1 HAVING coalesce(any_value(CASE WHEN subject % 4 < 3 THEN 'g' || cast(subject % 4 AS VARCHAR) END), 'unknown') IN ('g0', 'g2', 'unknown')"))
def _group(spark: SparkSession, d: str) -> DataFrame:
    counts = V.event_seq(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.where("subject % 4 < 3").select("subject", F.concat(F.lit("g"), (F.col("subject") % 4).cast("string")).alias("grp"))
    return E.resolve_group(counts, groups, allowed=["g0", "g2", "unknown"])


FAMILIES = [("purchase", "0", "F1"), ("purchase", "1", "F2"), ("view", "2", "F3")]


@query("event_family", V.sql("event_names", ", fam(head, number, family) AS (VALUES " + ", ".join(map(str, FAMILIES)) + ") SELECT subject, event_id, name, family, cast(len(string_split(name, '/')) AS INT) AS n_tags FROM event_names LEFT JOIN fam ON string_split(name, '/')[1] = head AND string_split(name, '/')[-1] = number"))
def _family(spark: SparkSession, d: str) -> DataFrame:
    return E.event_family(V.event_names(spark, d), spark.createDataFrame(FAMILIES, "head string, number string, family string")).select("subject", "event_id", "name", "family", F.size("tags").alias("n_tags"))
