"""Operator 6: one-permutation MinHash fingerprints, in DataFrame functions only.

The five-word shingles of a text are hashed once. The upper bits of a hash name one of 128 bins; sorting the hashes puts
a bin's smallest one first. An empty bin takes the value of another one, found by a probe sequence of its own that all
texts share and that visits every bin (optimal densification: each empty bin draws independently); it is hashed once more
with the bin, so texts of few shingles don't agree everywhere by the chance of one value. The low four bits of the bins are packed into eight longs, 128 hexadecimal digits.

Two fingerprints agree in a bin by chance with probability C = 1/16, so the share m of equal bins estimates the
resemblance as (m - C) / (1 - C), cut at 0 and 1.

The edited text of a document replaces its last half with the start of the next document's text, where documents follow
each other by descending doc_id and the first follows the last. Only neighbours meet: rows are dealt into blocks of
neighbours, a copy of each block's first row ends the block before, and a window over the block leads to the next row. The
blocks' bounds come from a range shuffle of the keys (doc_id, hash of the text) alone, so an id that many rows share is split;
a row finds its block by bisection. Texts are shuffled once.

Null texts are empty; a text with fewer than five words is one shingle, a text without words the empty one. Rows with
equal ids follow each other by the hash of their text; rows that are equal altogether are neighbours in one block. A single row is its own next document. An empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, partitions, text_of

SHINGLE = 5
BINS = 128
LOW_BITS = 4
#: Bins in a packed long.
PACK = 64 // LOW_BITS
#: Blocks of neighbours for each shuffle partition; the bounds of all blocks go through the driver.
BLOCKS = 4
#: Probes that are tried one by one before all of a bin's probes are listed.
FEW = 6


def words(text: str | Column) -> Column:
    """The words of a text between white space, in lower case."""
    spaced = F.translate(F.lower(text), "\t\n\r\f\x0b", "     ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def shingle_hashes(tokens: str, n: int = SHINGLE) -> Column:
    """The hash of each run of ``n`` words, from the words' hashes."""
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    runs = F.transform(F.sequence(F.lit(0), F.size("_hashed") - n), lambda i: F.xxhash64(*[F.get("_hashed", i + k) for k in range(n)]))
    return hashed, F.when(F.size("_hashed") >= n, runs).otherwise(F.array(F.xxhash64(F.array_join(tokens, " "))))


def _draws() -> tuple[Column, Column]:
    """For each bin the first probe and the odd step of the next ones, so a bin's probes visit all bins."""
    draw = random.Random(BINS)
    first, step = zip(*[(draw.randrange(BINS), 2 * draw.randrange(BINS // 2) + 1) for _ in range(BINS)], strict=True)
    return F.array(*map(F.lit, first)), F.array(*map(F.lit, step))


def fingerprint_columns(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``prefix``, the packed fingerprint of the column ``text`` as an array of longs."""
    df = df.withColumn("_words", words(text))
    hashed, runs = shingle_hashes("_words")
    df = df.withColumn("_hashed", hashed).withColumn("_sorted", F.sort_array(runs))
    shift = 64 - (BINS - 1).bit_length()
    of = lambda x: F.shiftrightunsigned(x, shift).cast("int")
    firsts = F.filter("_sorted", lambda x, i: (i == 0) | (of(x) != of(F.get("_sorted", i - 1))))
    df = df.withColumn("_firsts", firsts).withColumn("_bins", F.transform("_firsts", of)).drop("_words", "_hashed", "_sorted")
    every = F.sequence(F.lit(0), F.lit(BINS - 1))
    df = df.withColumn("_dense", F.transform(every, lambda b: F.get("_firsts", F.array_position("_bins", b).cast("int") - 1))).drop("_firsts", "_bins")
    first, step = _draws()
    probe = lambda b, k: F.get("_dense", (F.get(first, b) + F.get(step, b) * k).bitwiseAND(F.lit(BINS - 1)))
    last = lambda b: F.get(F.filter(F.transform(every, lambda k: probe(b, k)), lambda v: v.isNotNull()), F.lit(0))
    value = lambda b: F.coalesce(F.get("_dense", b), F.xxhash64(F.coalesce(*[probe(b, F.lit(k)) for k in range(FEW)], last(b)), b))
    df = df.withColumn("_values", F.transform(every, lambda b: value(b).bitwiseAND(F.lit((1 << LOW_BITS) - 1))))
    packed = [F.aggregate(F.slice("_values", 1 + at, PACK), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, LOW_BITS).bitwiseOR(x)) for at in range(0, BINS, PACK)]
    return df.withColumn(prefix, F.array(*packed)).drop("_dense", "_values")


def likeness(a: str, b: str) -> Column:
    """The estimated resemblance of two packed fingerprints."""
    equal_bits = F.lit(int("1" * PACK, 16))

    def differing(k: int) -> Column:
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(equal_bits))

    chance = 1 / (1 << LOW_BITS)
    share = 1 - reduce(lambda x, y: x + y, [differing(k) for k in range(BINS // PACK)]) / F.lit(float(BINS))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (share - chance) / (1 - chance)))


def hexadecimal(packed: str) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def neighbour_key(text: str = "text") -> Column:
    """What rows are in order of; ids that are null come first, so that they are last in descending order."""
    return F.struct(F.col("doc_id").isNotNull().alias("has"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64(text).alias("order"))


def bisected(bounds: list[Row], key: Column) -> Column:
    """How many of the ascending ``bounds`` aren't above ``key``."""
    table = F.array(*[F.struct(F.lit(b["has"]).alias("has"), F.lit(b["id"]).cast("long").alias("id"), F.lit(b["order"]).cast("long").alias("order")) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, n: F.when(F.get(table, at + n - 1) <= key, at + n).otherwise(at)) if bounds else F.lit(0)


def with_next(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text) dealt into blocks of neighbours, with ``ghost`` rows that end each block.

    Two rows for each block go through the driver: at most BLOCKS times the shuffle partitions.
    """
    keys = rows.select(neighbour_key().alias("key"))
    ranges = keys.repartitionByRange(partitions(rows) * BLOCKS, "key").groupBy(F.spark_partition_id().alias("part"))
    bounds = sorted(r["low"] for r in ranges.agg(F.min("key").alias("low")).collect())[1:]
    dealt = rows.withColumn("block", bisected(bounds, neighbour_key()))
    tops = sorted(((r["block"], r["top"]) for r in keys.select("key", bisected(bounds, F.col("key")).alias("block")).groupBy("block").agg(F.max("key").alias("top")).collect()), key=lambda x: x[0])
    if not tops:
        return dealt.withColumn("ghost", F.lit(False))
    follows = [(block, *tops[k - 1][1]) for k, (block, _) in enumerate(tops)]  # the next lower block; after the lowest the highest
    table = rows.sparkSession.createDataFrame(follows, "block int, has boolean, id long, order long")
    keyed = rows.withColumn("key", neighbour_key())
    joined = keyed.join(F.broadcast(table), (F.col("key.has") == F.col("has")) & (F.col("key.id") == F.col("id")) & (F.col("key.order") == F.col("order")))
    ghosts = joined.dropDuplicates(["block"]).select(*rows.columns, "block")
    return dealt.withColumn("ghost", F.lit(False)).union(ghosts.withColumn("ghost", F.lit(True)))


def edited_fingerprints(df: DataFrame) -> DataFrame:
    """The columns of the query, for all rows of ``df``."""
    rows = df.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    order = Window.partitionBy("block").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    both = with_next(rows).withColumn("following", F.lead("text").over(order)).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("following", F.lit("")), F.lit(1), half))
    both = both.withColumn("edited", edited).drop("following").withColumn("edited_sha256", F.sha2("edited", 256))
    both = fingerprint_columns(fingerprint_columns(both, "text", "own"), "edited", "other").drop("edited")
    both = both.withColumn("after", F.lead("own").over(order)).where("not ghost")
    return both.select("doc_id", "n_chars", "edited_sha256", hexadecimal("own").alias("fingerprint"), hexadecimal("other").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "after").alias("near_next"))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
