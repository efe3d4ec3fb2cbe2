"""Reading and writing of trials, sheets, results and matrices, and choices between files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window


def scan_trials(spark: SparkSession, path: str, subjects: Sequence | None = None, conditions: Sequence | None = None, channels: Sequence | None = None) -> DataFrame:
    """Trials of a Parquet tree partitioned by protocol and subject; filters reach the partitions and the row groups."""
    df = spark.read.parquet(path)
    for column, wanted in (("subject", subjects), ("condition", conditions), ("channel", channels)):
        if wanted is not None:
            df = df.where(F.col(column).isin(*wanted))
    return df


def scan_csv_sheet(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True)


def best_version(candidates: DataFrame, priority: DataFrame, alias: str = "Tp") -> DataFrame:
    """(subject, path, version): the best version (version, rank) of each subject; ids with the prefix ``alias`` stand behind."""
    prefixed = F.col("subject").startswith(alias)
    plain = F.when(prefixed, F.expr(f"substring(subject, {len(alias) + 1})")).otherwise(F.col("subject"))
    ranked = candidates.join(F.broadcast(priority), "version").withColumn("_alias", prefixed.cast("int")).withColumn("subject", plain)
    first = F.row_number().over(Window.partitionBy("subject").orderBy("_alias", "rank", "path"))
    return ranked.withColumn("_k", first).where("_k = 1").select("subject", "path", "version")


def catalog_results(paths: DataFrame, subject_group: DataFrame) -> DataFrame:
    """(path, grp, protocol, subject) of result paths ``.../group/protocol/subject/...``; unknown groups are dropped."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)/[^/]*$", k)
    found = paths.select("path", part(1).alias("grp"), part(2).alias("protocol"), part(3).alias("subject"))
    return found.join(F.broadcast(subject_group.select("grp").distinct()), "grp", "left_semi")


def subject_from_path(df: DataFrame, ids: DataFrame, path_col: str = "path") -> DataFrame:
    """Adds ``subject``: the longest known id in the path, else a ``Subj_`` pattern, else the parent folder."""
    paths = df.select(path_col).distinct()
    lengths = [r["n"] for r in ids.select(F.length("id").alias("n")).distinct().collect()]  # ids have few lengths
    starts = F.sequence(F.lit(1), F.length(path_col))
    every = lambda n: F.transform(starts, lambda k: F.substring(F.col(path_col), k, F.lit(n)))
    parts = F.array_distinct(F.flatten(F.array(*map(every, lengths)))) if lengths else F.array().cast("array<string>")
    known = paths.select(path_col, F.explode(parts).alias("id")).join(ids.select("id").distinct(), "id").groupBy(path_col).agg(F.max(F.struct(F.length("id").alias("n"), "id")).alias("_m"))
    nothing = lambda x: F.when(x != "", x)
    pattern, parent = F.regexp_extract(path_col, r"Subj_([A-Za-z0-9]+)", 1), F.regexp_extract(path_col, r"([^/]+)/[^/]*$", 1)
    return df.join(known, path_col, "left").withColumn("subject", F.coalesce("_m.id", nothing(pattern), nothing(parent))).drop("_m")


def summary_table(scores: DataFrame, comparisons: Sequence[str]) -> DataFrame:
    """A row for each subject, with mean, deviation and peak of each comparison."""
    return scores.groupBy("subject").pivot("cmp", list(comparisons)).agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("sd"), F.max("auc").alias("peak"))


def sink_summary(scores: DataFrame, comparisons: Sequence[str], path: str) -> None:
    summary_table(scores, comparisons).write.mode("overwrite").csv(path, header=True)


def matrix_table(df: DataFrame, row: str, col: str, value: str, columns: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(col, list(columns)).agg(F.first(value))


def sink_matrix(df: DataFrame, row: str, col: str, value: str, path: str, columns: Sequence) -> None:
    """A square matrix as rows and columns, for given column values."""
    matrix_table(df, row, col, value, columns).write.mode("overwrite").parquet(path)


def validate_axes(df: DataFrame, keys: Sequence[str], axis_col: str, reference: DataFrame | None = None) -> DataFrame:
    """(keys, n, axis, rate, valid): whether an axis equals the reference, or else the most common one; rate from its step."""
    w = Window.partitionBy(*keys).orderBy(axis_col)
    step = df.select(*keys, axis_col).distinct().withColumn("_step", F.col(axis_col) - F.lag(axis_col).over(w))
    axes = step.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.concat_ws(",", F.array_sort(F.collect_list(axis_col)).cast("array<string>")).alias("axis"), F.round(F.lit(1000.0) / F.avg("_step")).cast("long").alias("rate"))
    if reference is None:
        reference = axes.groupBy("axis").agg(F.count(F.lit(1)).alias("_c")).orderBy(F.col("_c").desc(), "axis").limit(1).select("axis")
    return axes.join(F.broadcast(reference.select(F.col("axis").alias("_axis"))), F.col("axis") == F.col("_axis"), "left").withColumn("valid", F.col("_axis").isNotNull()).drop("_axis")


def update_bad_channels(patient: DataFrame, updates: DataFrame) -> DataFrame:
    """The sheet (subject, protocol, bad_chans) with the lists of ``updates`` in place of the old ones."""
    new = updates.select("subject", "protocol", F.col("bad_chans").alias("_new"))
    return patient.join(new, ["subject", "protocol"], "left").withColumn("bad_chans", F.coalesce("_new", "bad_chans")).drop("_new")


def sink_group_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
