"""Operator 4: pack token sequences into as few bins as possible.

A text becomes the ids of its words and a closing id; only a longer one than the capacity is cut, into full pieces and a
rest. Packing needs no texts and no rows, only how many pieces there are of each length: at most ``capacity`` counts,
gathered by one aggregation. ``plan`` packs these counts:

* pieces above a half open a bin each; pieces above a third meet at most in pairs, so going down by length each takes
  the largest remaining partner that fits, a greedy matching;
* smaller pieces, longest first, go where the smallest gap that holds them remains (best fit), or open a bin.

Pieces of a length and bins with the same gap are runs of numbers, so a step places many at once and the plan has runs,
not rows: their number depends on the capacity, not on the table. A piece's number among those of its length comes from
a window over (length, salt) with the counts of the other salts before it, so a length that a third of all rows share
is still dealt over many tasks. The piece joins the run that holds its number.

Null texts are empty: one piece that holds the closing id. Repeated rows are packed one by one, empty tables give empty
tables, other columns are ignored. The texts pass through Python once, whole, in Arrow batches.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, documents, parts, text_of
from .tokens import forget_words, packed_ids

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
CLOSING_ID = 1
#: A length's rows are numbered in so many windows.
SALTS = 64


def pieces(df: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: int = 0, words: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece; with_ids (2 or 4) adds the ids as little-endian integers of so many bytes.

    A task keeps the ids of at most ``words`` bytes of words from slice to slice; fewer take longer and give the same.
    """
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    closing = CLOSING_ID.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * bool(with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            rows = []
            for doc, ids in zip(part.column(0).to_pylist(), packed_ids(part.column(1).to_pylist(), path, words), strict=True):
                ids += closing
                for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[i : i + 4 * capacity]
                    rows.append((doc, k, i // 4, len(own) // 4, zlib.crc32(own), narrow(own, with_ids)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in list(zip(zip(*rows, strict=True), kinds, strict=True))[: len(names)]], names)
        forget_words()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * bool(with_ids)
    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, schema)


def narrow(ids: bytes, width: int) -> bytes:
    """32-bit integers as integers of ``width`` bytes."""
    if width != 2:
        return ids
    whole = np.frombuffer(ids, "<u4")
    if whole.max(initial=0) >= 1 << 16:
        raise ValueError("the vocabulary's ids need four bytes")
    return whole.astype("<u2").tobytes()


class Gaps:
    """Open bins by gap, as runs (first bin, bins); the smallest gap that holds a length is found by bisection."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, bins: int) -> None:
        if gap not in self.runs:
            bisect.insort(self.sizes, gap)
            self.runs[gap] = []
        self.runs[gap].append((first, bins))

    def take(self, gap: int, most: int) -> tuple[int, int]:
        first, bins = self.runs[gap].pop()
        if bins > most:
            self.runs[gap].append((first + most, bins - most))
        if not self.runs[gap]:
            del self.runs[gap], self.sizes[bisect.bisect_left(self.sizes, gap)]
        return first, min(bins, most)

    def best(self, length: int) -> int | None:
        k = bisect.bisect_left(self.sizes, length)
        return self.sizes[k] if k < len(self.sizes) else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first number, pieces, first bin, offset): the pieces of a run go to bins one after another."""
    left, used, bins, runs, gaps = dict(counts), dict.fromkeys(counts, 0), 0, [], Gaps()

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted(x for x in counts if 3 * x > capacity)
    for length in reversed(large):
        while left[length]:
            k = bisect.bisect_right(large, min(length, capacity - length)) - 1
            while k >= 0 and left[large[k]] - (large[k] == length) <= 0:
                k -= 1
            partner = large[k] if k >= 0 else None
            n = left[length] if partner is None else left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, n, bins, 0)
            if partner is not None:
                put(partner, n, bins, length)
            if gap := capacity - length - (partner or 0):
                gaps.add(gap, bins, n)
            bins += n
    for length in sorted((x for x in counts if 3 * x <= capacity), reverse=True):
        while left[length]:
            gap = gaps.best(length)
            if gap is None:  # as many bins as these pieces fill
                each = capacity // length
                n = left[length] if left[length] < each else left[length] // each
                if left[length] < each:
                    for k in range(n):
                        put(length, 1, bins, k * length)
                    gaps.add(capacity - n * length, bins, 1)
                    bins += 1
                else:
                    for k in range(each):
                        put(length, n, bins, k * length)
                    if capacity - each * length:
                        gaps.add(capacity - each * length, bins, n)
                    bins += n
            else:
                first, n = gaps.take(gap, left[length])
                put(length, n, first, capacity - gap)
                if gap > length:
                    gaps.add(gap - length, first, n)
    return runs


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the columns of ``pieces``; a sequence's offsets are gapless from 0."""
    salted = cut.withColumn("salt", F.pmod(F.hash("doc_id", "piece"), F.lit(SALTS)))
    salted = checkpoint(salted)
    by_salt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))  # capacity * SALTS rows at most
    lengths = by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    runs = plan({r["length"]: r["n"] for r in lengths}, capacity)
    before = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("own", own).join(F.broadcast(before), ["length", "salt"]).withColumn("number", F.col("before") + F.col("own"))
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, number, _, first, offset in sorted(runs):
        by_length.setdefault(length, []).append((number, first, offset))
    rows = [(length, [x[0] for x in own], [x[1] for x in own], [x[2] for x in own]) for length, own in by_length.items()]
    table = cut.sparkSession.createDataFrame(rows, "length long, numbers array<long>, firsts array<long>, offsets array<long>")  # bounded by the capacity
    run = F.expr("size(filter(numbers, x -> x <= number)) - 1")
    placed = numbered.join(F.broadcast(table), "length").withColumn("run", run)
    return placed.select(*cut.columns, F.expr("firsts[run] + number - numbers[run]").alias("sequence_id"), F.expr("offsets[run]").alias("offset"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))
