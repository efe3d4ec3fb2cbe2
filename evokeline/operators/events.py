"""Event tables: onsets, names, re-coding by order, conditions and protocols.

Every function takes and gives DataFrames. ``keys`` are the columns of one recording; order within it is by window, so
recordings are independent and are dealt over the cluster by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _by(keys: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def find_events(df: DataFrame, keys: Sequence[str], order_col: str, value_col: str) -> DataFrame:
    """Rows where the value changes to something other than zero."""
    before = F.coalesce(F.lag(value_col).over(_by(keys, order_col)), F.lit(0))
    return df.withColumn("_before", before).where((F.col(value_col) != 0) & (F.col(value_col) != F.col("_before"))).drop("_before")


def decode_codes(event: DataFrame, stim_dict: DataFrame, passthrough: Sequence[str] = ()) -> DataFrame:
    """Adds ``name`` (the first of the dictionary's order) and ``number``, its digits; names in ``passthrough`` stay codes."""
    first = stim_dict.groupBy("code").agg(F.min_by("name", "place").alias("name"))
    digits = F.regexp_replace("name", "[^0-9]", "")
    number = F.when(F.col("name").isin(*passthrough) if passthrough else F.lit(False), F.col("code")).when(digits != "", digits.cast("int"))
    return event.join(F.broadcast(first), "code", "left").withColumn("number", number)


def drop_control_events(event: DataFrame, names: DataFrame) -> DataFrame:
    return event.join(F.broadcast(names), "name", "left_anti")


def recording_span(recording: DataFrame, event: DataFrame, pad_s: int = 3, sfreq: float = 1.0) -> DataFrame:
    """Samples from ``pad_s`` seconds before the first event to as long after the last, in whole seconds."""
    first, last = F.min("onset") / F.lit(float(sfreq)), F.max("onset") / F.lit(float(sfreq))
    span = event.groupBy("subject").agg(F.greatest(F.lit(0.0), F.floor(first) - pad_s).alias("_lo"), (F.floor(last) + pad_s).alias("_hi"))
    second = F.col("sample") / F.lit(float(sfreq))
    return recording.join(span, "subject").where((second >= F.col("_lo")) & (second <= F.col("_hi"))).drop("_lo", "_hi")


def tag_after_marker(event: DataFrame, markers: Sequence[int], targets: Sequence[int], rows: int = 42, add: int = 1000) -> DataFrame:
    """Targets with a marker among the ``rows`` rows before them get ``add``, once."""
    near = F.max(F.col("code").isin(*markers).cast("int")).over(_by(["subject"], "seq").rowsBetween(-rows, 0))
    return event.withColumn("code", F.when(F.col("code").isin(*targets) & (near == 1), F.col("code") + add).otherwise(F.col("code")))


def claim_neighbour(event: DataFrame, claimers: Sequence[int], claimed: Sequence[int], add: int = 2000) -> DataFrame:
    """Each claimer takes the free claimed row just before it, else the one just after it; taken rows get ``add``.

    On a maximal run of alternating rows all claimers turn the same way: back if the run starts with a claimed row.
    """
    w = _by(["subject"], "seq")
    kind = F.when(F.col("code").isin(*claimers), F.lit("c")).when(F.col("code").isin(*claimed), F.lit("f")).otherwise(F.lit("x"))
    marked = event.withColumn("_kind", kind).withColumn("_prev", F.lag("_kind").over(w))
    starts = (F.col("_kind") == "x") | F.col("_prev").isNull() | (F.col("_prev") == F.col("_kind")) | (F.col("_prev") == "x")
    runs = marked.withColumn("_run", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("subject", "_run").orderBy("seq")
    placed = runs.withColumn("_first", F.first("_kind").over(run)).withColumn("_next", F.lead("_kind").over(run)).withColumn("_back", F.lag("_kind").over(run))
    taken = (F.col("_kind") == "f") & F.when(F.col("_first") == "f", F.coalesce(F.col("_next") == "c", F.lit(False))).otherwise(F.coalesce(F.col("_back") == "c", F.lit(False)))
    return placed.withColumn("code", F.when(taken, F.col("code") + add).otherwise(F.col("code"))).drop("_kind", "_prev", "_run", "_first", "_next", "_back")


def block_number(playframe: DataFrame) -> DataFrame:
    """Adds ``block``, one more at each row whose index is 1."""
    return playframe.withColumn("block", F.sum(F.when(F.col("idx") == 1, 1).otherwise(0)).over(_by(["subject"], "row_no").rowsBetween(Window.unboundedPreceding, 0)))


def local_global_code(playframe: DataFrame, every: int = 5) -> DataFrame:
    """Adds ``lg``: on each last row of ``every``, 10 or 20 by the row before it, plus 1 or 2 by the block's standard; else 0."""
    rows = playframe if "block" in playframe.columns else block_number(playframe)
    before = F.lag("trigger").over(_by(["subject"], "row_no"))
    standard = F.max(F.when(F.col("idx") == every, F.col("trigger"))).over(Window.partitionBy("subject", "block"))
    code = F.when(F.coalesce(F.col("trigger") == before, F.lit(False)), 10).otherwise(20) + F.when(F.coalesce(F.col("trigger") == standard, F.lit(False)), 1).otherwise(2)
    return rows.withColumn("lg", F.when(F.col("row_no") % every == 0, code).otherwise(0))


def zip_events(event: DataFrame, playframe: DataFrame) -> DataFrame:
    """Row i of a subject's events beside row i of its log."""
    a = event.withColumn("_i", F.row_number().over(_by(["subject"], "seq")))
    b = playframe.withColumn("_i", F.row_number().over(_by(["subject"], "row_no")))
    return a.join(b, ["subject", "_i"]).drop("_i")


def match_conditions(event_names: DataFrame, condition_spec: DataFrame) -> DataFrame:
    """(condition, name) by specifier: ``P/`` and ``P*`` are starts, ``/S`` is an end, others are names or else starts."""
    spec = F.col("spec")
    start = F.when(spec.endswith("*"), F.expr("substring(spec, 1, length(spec) - 1)")).when(spec.endswith("/"), spec)
    names = event_names.select("name").distinct()
    exact = condition_spec.join(names, F.col("name") == spec, "left_semi").select("spec").distinct().withColumn("_exact", F.lit(True))
    specs = condition_spec.join(exact, "spec", "left").withColumn("_start", F.coalesce(start, F.when(F.col("_exact").isNull() & ~spec.startswith("/"), spec)))
    hit = (F.col("name") == spec) | F.col("name").startswith(F.col("_start")) | (spec.startswith("/") & F.col("name").endswith(spec))
    return names.join(F.broadcast(specs), hit).select("condition", "name").dropDuplicates()


def expand_conditions(trial: DataFrame, condition: DataFrame) -> DataFrame:
    """A row for each trial and each condition that holds its name."""
    return trial.join(F.broadcast(condition), "name")


def _has(text: str) -> Column:
    return F.bool_or(F.contains(F.col("name"), F.lit(text)))


def detect_protocol(event_names: DataFrame, rules: Sequence[tuple[str, Sequence[str]]], hint: str | None = None, default: str = "unknown") -> DataFrame:
    """(subject, protocol): the first rule all of whose tags occur in the subject's names, else the hint, else the default."""
    tags = sorted({t for _, own in rules for t in own})
    seen = event_names.groupBy("subject").agg(*[_has(t).alias(f"_{k}") for k, t in enumerate(tags)])
    chain = F.coalesce(*[F.when(F.expr(" and ".join(f"_{tags.index(t)}" for t in own)), F.lit(name)) for name, own in rules], F.lit(hint), F.lit(default))
    return seen.select("subject", chain.alias("protocol"))


def adapt_conditions(event_names: DataFrame, protocol: DataFrame, specs: DataFrame) -> DataFrame:
    """(subject, condition, spec) of the specs of a subject's protocol that match one of its names."""
    wanted = protocol.join(F.broadcast(specs), "protocol")
    names = event_names.select("subject", "name").distinct()
    hit = (wanted["subject"] == names["subject"]) & names["name"].startswith(wanted["spec"])
    return wanted.join(names, hit, "left_semi").select("subject", "condition", "spec")


def event_counts(event: DataFrame, event_dict: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Count and percent of each name of the dictionary for each recording, zeros included."""
    every = event.select(*keys).distinct().crossJoin(F.broadcast(event_dict.select("name").distinct()))
    n = event.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))
    both = every.join(n, [*keys, "name"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    whole = F.sum("n").over(Window.partitionBy(*keys))
    return both.withColumn("percent", F.when(whole > 0, F.lit(100.0) * F.col("n") / whole).otherwise(F.lit(0.0)))


def event_table(event: DataFrame, event_dict: DataFrame, sfreq: float) -> DataFrame:
    index = F.row_number().over(_by(["subject"], "seq")).cast("long") - 1
    named = event.join(F.broadcast(event_dict), "code", "left")
    return named.select("subject", index.alias("index"), F.col("onset"), F.lit(0).alias("duration"), "code", F.coalesce("name", F.lit("Unknown")).alias("name"), (F.col("onset") / F.lit(float(sfreq))).alias("time_s"))


def compare_dict(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, observed, expected, matched) for every name of either dictionary."""
    both = observed.select("name", F.col("code").alias("observed")).join(expected.select("name", F.col("code").alias("expected")), "name", "full_outer")
    return both.withColumn("matched", F.col("observed").eqNullSafe(F.col("expected")))


def resolve_group(df: DataFrame, subject_group: DataFrame, default: str = "unknown", allowed: Sequence[str] | None = None) -> DataFrame:
    out = df.join(subject_group, "subject", "left").withColumn("grp", F.coalesce("grp", F.lit(default)))
    return out.where(F.col("grp").isin(*allowed)) if allowed else out


def event_family(event_names: DataFrame, families: DataFrame) -> DataFrame:
    """Adds ``family`` and the name's tags; a family is known by its first tag and number."""
    tags = F.split("name", "/")
    split = event_names.select("*", tags.alias("tags")).withColumn("_head", F.element_at("tags", 1)).withColumn("_number", F.element_at("tags", -1))
    return split.join(F.broadcast(families.select(F.col("head").alias("_head"), F.col("number").alias("_number"), "family")), ["_head", "_number"], "left").drop("_head", "_number")
