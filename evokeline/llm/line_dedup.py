"""Operator 9: removal of lines that spread over many sites.

A line's spread is the number of distinct sites (``source``) whose documents hold it. One aggregation keeps a HyperLogLog
sketch of the sites for each line's hash; sketches merge, so a line that a third of all documents hold is reduced before
the shuffle. Far from the threshold the estimate decides. Lines within ``margin`` of it get their exact distinct count
from a second pass over just these lines.

A line of at least ``min_sites`` sites is boilerplate. Its first occurrence, by (doc_id, line), stays, so no content
leaves the corpus; all others go. Lines are compared without white space at their ends; blank lines are never removed.

The texts that lose lines get the lines' numbers by a join on (doc_id, hash of the text): these numbers are broadcast while
they are few, so that no text is shuffled; beyond, both sides are, and the runtime splits a key that many equal rows share.

Null texts are empty and stay null; texts without boilerplate stay as they are, byte for byte. A null site counts as no
site. Equal ids: rows are told apart by (doc_id, hash of the text), and equal rows share the first occurrence. An empty
table gives an empty table. Columns other than text and n_chars are kept; ``n_removed`` gets underscores while a column
has that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, checkpoint, documents, own_names, text_of

MIN_SITES = 10
MARGIN = 0.15
LOG2_REGISTERS = 11


def _lines(df: DataFrame) -> DataFrame:
    """A row for each line that isn't blank: doc_id, content, source, at (its number), line (its hash)."""
    split = F.posexplode(F.split(text_of(), "\n", -1)).alias("at", "raw")
    rows = df.select(F.col("doc_id").cast("long"), F.xxhash64(text_of()).alias("content"), F.col("source").cast("string"), split)
    return rows.select("doc_id", "content", "source", "at", F.trim("raw").alias("raw")).where("raw <> ''").select("doc_id", "content", "source", "at", F.xxhash64("raw").alias("line"))


def boilerplate(df: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """line, first (doc_id, content, at) of the lines on at least ``min_sites`` distinct sites."""
    lines = _lines(df)
    sketched = lines.groupBy("line").agg(F.hll_sketch_agg("source", LOG2_REGISTERS).alias("sites"), F.min(F.struct("doc_id", "content", "at")).alias("first"))
    spread = checkpoint(sketched.select("line", "first", F.hll_sketch_estimate("sites").alias("spread")).where(F.col("spread") >= min_sites * (1 - margin)))
    near = spread.where(F.col("spread") <= min_sites * (1 + margin))
    exact = lines.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count_distinct("source").alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("spread") > min_sites * (1 + margin))
    return sure.select("line", "first").union(near.join(exact, "line", "left_semi").select("line", "first"))


def without_boilerplate(df: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """``df`` with the lines that go cut out of ``text``, n_chars (if there) to match, and n_removed at the end."""
    found = boilerplate(df, min_sites, margin)
    hits = _lines(df).join(found, "line").where("not (doc_id <=> first.doc_id and content = first.content and at = first.at)")
    own, content, gone, text, removed = own_names(df, "own", "content", "gone", "kept", "n_removed")
    losses = checkpoint(hits.groupBy("doc_id", "content").agg(F.sort_array(F.collect_set("at")).alias(gone)).withColumnsRenamed({"doc_id": own, "content": content}))
    lines = losses.agg(F.sum(F.size(gone))).first()[0] or 0
    small = bounded(losses, 48 + 8 * lines // max(1, losses.count()))
    joined = df.join(small, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(text_of()) == F.col(content)), "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(gone, i)), "\n")
    out = joined.withColumn(text, F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    length = F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long")) if "n_chars" in df.columns else None
    columns = [F.col(text).alias(c) if c == "text" else length.alias(c) if c == "n_chars" else F.col(c) for c in df.columns]
    return out.select(*columns, F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(removed))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_boilerplate(documents(spark, sf_dir)).select("doc_id", "source", "text", "n_chars", "n_removed")


#: Exact counts instead of sketches: near the threshold the operator counts exactly too.
ORACLE = f"""
WITH lines AS (
  SELECT doc_id, source, i AS pos, trim(parts[i]) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)
), spread AS (
  SELECT line, min(struct_pack(d := doc_id, a := pos)) AS head FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}
), marked AS (
  SELECT l.doc_id, l.pos, s.line IS NOT NULL AND struct_pack(d := l.doc_id, a := l.pos) <> s.head AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line
), gone AS (
  SELECT doc_id, list(pos) FILTER (WHERE gone) AS ats, count(*) FILTER (WHERE gone) AS n FROM marked GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, d.source, g.n, CASE WHEN g.n = 0 THEN d.text ELSE
    coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.ats, i)), chr(10)), '') END AS text
  FROM documents d JOIN gone g USING (doc_id)
)
SELECT doc_id, source, text, cast(length(text) AS BIGINT) AS n_chars, cast(n AS BIGINT) AS n_removed FROM kept
"""
