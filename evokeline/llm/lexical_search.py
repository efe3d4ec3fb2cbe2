"""Operator 13: ranked lexical search through posting lists in blocks of similar documents.

A document is a vector over the terms of the items that are searched: its coordinate of a term is what the term adds to
a score. Rows lie in the order of a coarse signature of their vectors, and every ``SEGMENT`` rows are a segment, which a
task indexes at once. In a segment each term's posting list is clustered by similarity: its members join the pivot, one of their
own, that their vector (projected to ``DIMENSIONS`` random directions) has the largest cosine with. Runs of ``BLOCK`` members in
that order are the blocks. A block stores the coordinatewise maximum of its members' vectors, rounded up to two bytes
a coordinate, over its list's term and those that weigh no more: its product with an item's terms bounds the score of every
member that holds no heavier term of the item. The others are in the list of that term as well.

Items visit the blocks of their own terms. The task keeps each item's best rows so far; a block is skipped if, and only
if, its bound is below the lowest of ``most`` kept scores. Equal bounds are visited, as an equal score of a smaller id ranks
first. Whoever ranks is in a block of the list of its heaviest term of the item, and the bound of that block isn't below its
score, so no row is lost. Members of visited blocks are scored exactly, in 64-bit integers. The best rows of the tasks
meet in one ranking. No block or list is cut, and no document or term is left out.

Items are searched in groups that have at most ``TERMS`` different terms (or one item), each against all rows, so what a
task gets of them is bounded. Corpus counts (documents, terms, documents of a term) cover all rows.

Null and empty texts and those without a term are no documents, and items without one have no rows. Equal scores rank by ascending
id, rows without an id last; repeated rows rank one after another, and a repeated item has its rows as often as it stands
there. Empty tables give empty results. Other columns are ignored. Texts are read whole, in slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, documents, give_back, parts, text_of

#: How many rows of an item are ranked.
MOST = 50
#: Length normalisation in hundredths, saturation in tenths of the formula below.
SLOPE = 50
#: Different terms of items that are searched together, rows of a segment and of a block, directions of the clustering.
TERMS, SEGMENT, BLOCK, DIMENSIONS = 4096, 2048, 64, 32
SEED = 13
#: Largest number of a stored maximum.
STEPS = 65535
#: Bytes that are part of no term become spaces, capital letters small ones.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(texts: pa.Array) -> pa.Array:
    """Texts of small letters, their terms between spaces."""
    kind = np.int32 if pa.types.is_string(texts.type) else np.int64
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b""
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer((at - at[0]).astype(np.int64)), pa.py_buffer(data.translate(FOLD))])


def terms(text: str | None) -> list[str]:
    return (text or "").encode().translate(FOLD).decode().split(" ") if text else []


def vectors(df: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """doc_id, n (terms), near (a coarse signature), term (places in ``vocabulary``), tf of each row that has a term."""
    place = {t: k for k, t in enumerate(vocabulary)}
    names = ["doc_id", "n", "near", "term", "tf"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = directions(len(vocabulary), 16)
        for b in parts(batches):
            split = pc.split_pattern(folded(b.column(1)), " ")
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            own = np.array([place.get(w, -1) if w else -2 for w in words] or [0], np.int64)[coded.indices.to_numpy()]
            bounds = split.offsets.to_numpy()
            row = np.repeat(np.arange(len(b)), np.diff(bounds))
            n = np.bincount(row[own > -2], minlength=len(b))
            used = own >= 0
            pair, tf = np.unique(row[used] * max(1, len(vocabulary)) + own[used], return_counts=True)
            doc, term = np.divmod(pair, max(1, len(vocabulary)))
            near = signatures(doc, plane[term] * np.sqrt(tf)[:, None], len(b))
            ends = np.searchsorted(doc, np.arange(len(b) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(near), *lists], names)
            yield out.filter(pa.array(n > 0))

    schema = "doc_id long, n long, near long, term array<int>, tf array<int>"
    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(counted, schema)


def directions(n: int, dimensions: int) -> np.ndarray:
    """A random direction of each of ``n`` coordinates."""
    return np.random.default_rng(SEED).standard_normal((n, dimensions))


def signatures(row: np.ndarray, moved: np.ndarray, n: int) -> np.ndarray:
    """The signs of each row's sum: rows that are alike have alike signs."""
    sums = np.stack([np.bincount(row, m, n) for m in moved.T], axis=1) if len(row) else np.zeros((n, moved.shape[1]))
    return ((sums > 0).astype(np.int64) << np.arange(moved.shape[1] - 1, -1, -1)).sum(1)


def weights(df_of_term: Sequence[int], documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in df_of_term], np.int64)


class Segment:
    """The vectors of some rows, dense over the terms that they hold, and the blocks of each term's posting list."""

    def __init__(self, doc_id: np.ndarray, no_id: np.ndarray, n: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray, documents: int, length: int, block: int = BLOCK):
        self.doc_id, self.no_id = doc_id, no_id
        self.terms = np.unique(term)
        heavy = np.argsort(-weight[self.terms], kind="stable")
        self.column_of = np.full(len(weight), -1)
        self.column_of[self.terms[heavy]] = np.arange(len(heavy))  # heavy terms first
        self.terms, column = self.terms[heavy], self.column_of[term]
        m = 100 - SLOPE + (SLOPE * n * documents) // length
        adds = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
        self.adds = np.zeros((len(n), len(self.terms)), np.int64)
        self.adds[row, column] = adds
        self.step = max(1, -(-int(adds.max(initial=0)) // STEPS))
        self.rounded = (-(-self.adds // self.step)).astype(np.uint16)  # up
        self.cluster(row, column, block)

    def cluster(self, row: np.ndarray, column: np.ndarray, block: int) -> None:
        """Blocks of each list: ``members`` by ``bounds``, the column of the list and the maxima of the members' vectors."""
        moved = self.rounded.astype(np.float32) @ directions(self.rounded.shape[1], DIMENSIONS).astype(np.float32)
        size = np.sqrt((moved * moved).sum(1, keepdims=True))
        moved /= np.where(size > 0, size, 1)
        by = np.lexsort((row, column))
        members, lists = row[by], column[by]
        edges = np.searchsorted(lists, np.arange(len(self.terms) + 1))
        order, firsts, of = np.empty_like(members), [], []
        for k in range(len(self.terms)):
            own = members[edges[k] : edges[k + 1]]
            if len(own) > block:
                pivots = own[block // 2 :: block]
                own = own[np.argsort((moved[own] @ moved[pivots].T).argmax(1), kind="stable")]
            order[edges[k] : edges[k + 1]] = own
            firsts.append(np.arange(edges[k], edges[k + 1], block))
            of.append(np.full(len(firsts[-1]), k))
        self.members = order
        self.firsts = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
        self.of = np.concatenate(of) if of else np.zeros(0, np.int64)
        self.ends = np.append(self.firsts[1:], len(order)) if len(self.firsts) else self.firsts
        self.maxima = np.zeros((len(self.firsts), len(self.terms)), np.uint16)
        for k, (c, a, b) in enumerate(zip(self.of.tolist(), self.firsts.tolist(), self.ends.tolist(), strict=True)):
            np.max(self.rounded[order[a:b], c:], axis=0, out=self.maxima[k, c:])

    def bounds(self, wanted: np.ndarray) -> np.ndarray:
        """Blocks x items: no member without a heavier term of the item scores more; ``wanted`` is items x columns, 1 for an item's terms."""
        return (self.maxima.astype(np.float64) @ wanted.T.astype(np.float64)).astype(np.int64) * self.step

    def inside(self, blocks: np.ndarray) -> np.ndarray:
        """The rows that some blocks hold, once each."""
        held = np.zeros(len(self.doc_id), bool)
        for k in blocks:
            held[self.members[self.firsts[k] : self.ends[k]]] = True
        return np.flatnonzero(held)


class Best:
    """The best rows of one item so far: (score descending, id ascending, without an id last)."""

    def __init__(self, most: int):
        self.most, self.score, self.doc_id, self.no_id = most, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """The score below which nothing ranks any more."""
        return int(self.score[-1]) if len(self.score) == self.most else 1

    def add(self, score: np.ndarray, doc_id: np.ndarray, no_id: np.ndarray) -> None:
        own = score >= self.least()
        score, doc_id, no_id = (np.concatenate([a, b[own]]) for a, b in ((self.score, score), (self.doc_id, doc_id), (self.no_id, no_id)))
        first = np.lexsort((doc_id, no_id, -score))[: self.most]
        self.score, self.doc_id, self.no_id = score[first], doc_id[first], no_id[first]


def visit(segment: Segment, wanted: Sequence[np.ndarray], best: Sequence[Best], most: int) -> int:
    """Rank a segment's rows for each item (the places of its terms); gives how many blocks were skipped."""
    matrix = np.zeros((len(wanted), len(segment.terms)), np.uint8)
    for k, w in enumerate(wanted):
        own = segment.column_of[w]
        matrix[k, own[own >= 0]] = 1
    bounds = np.where(matrix.T[segment.of] == 1, segment.bounds(matrix), 0)
    skipped = 0
    for k, own in enumerate(best):
        columns = np.flatnonzero(matrix[k])
        order = np.flatnonzero(bounds[:, k] >= own.least())
        skipped += int(np.count_nonzero(matrix[k][segment.of])) - len(order)
        order = order[np.argsort(-bounds[order, k], kind="stable")]
        done = np.zeros(len(segment.doc_id), bool)
        at, step = 0, max(1, most // BLOCK)
        while at < len(order) and bounds[order[at], k] >= own.least():
            rows = segment.inside(order[at : at + step][bounds[order[at : at + step], k] >= own.least()])
            rows = rows[~done[rows]]
            done[rows] = True
            own.add(segment.adds[np.ix_(rows, columns)].sum(1), segment.doc_id[rows], segment.no_id[rows])
            at, step = at + step, 2 * step
        skipped += max(0, len(order) - at)
    return skipped


def ranked(rows: DataFrame, wanted: Sequence[np.ndarray], weight: np.ndarray, documents: int, length: int, most: int = MOST, segment: int = SEGMENT) -> DataFrame:
    """item (its place in ``wanted``), doc_id, score: each task's best rows for each item, from rows of ``vectors`` in the order of ``near``."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(most) for _ in wanted]
        for b in regrouped(batches, segment):
            ends = np.append(0, np.cumsum(pc.list_value_length(b.column("term")).to_numpy()))
            n = b.column("n").to_numpy()
            flat = [pc.list_flatten(b.column(c)).to_numpy().astype(np.int64) for c in ("term", "tf")]
            no_id = b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            own = Segment(b.column("doc_id").fill_null(0).to_numpy(), no_id, n, np.repeat(np.arange(len(n)), np.diff(ends)), *flat, weight, documents, length)
            visit(own, wanted, best, most)
        for k, own in enumerate(best):
            if len(own.score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own.score), k, np.int32)), pa.array(own.doc_id, mask=own.no_id), pa.array(own.score)], ["item", "doc_id", "score"])
        give_back()

    return rows.select("doc_id", "n", "term", "tf").mapInArrow(searched, "item int, doc_id long, score long")


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of some batches, ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        while len(b):
            part = b.slice(0, size - sum(map(len, held)))
            held.append(part)
            b = b.slice(len(part))
            if sum(map(len, held)) == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(items: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with their different terms, as many at once as have at most ``most`` of them together."""
    group, held = [], set()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        own = sorted(set(terms(r["text"])) - {""})
        if group and len(held | set(own)) > most:
            yield group
            group, held = [], set()
        if own:
            group.append((r["item_id"], own))
            held |= set(own)
    if group:
        yield group


def search(df: DataFrame, items: DataFrame, most: int = MOST, most_terms: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` rows of ``df`` that score highest for each row (item_id, text) of ``items``."""
    spark, found = df.sparkSession, []
    for group in _groups(items, most_terms):
        vocabulary = sorted({t for _, own in group for t in own})
        place = {t: k for k, t in enumerate(vocabulary)}
        rows = checkpoint(vectors(df, vocabulary))
        documents, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        counted = dict(rows.select(F.explode("term").alias("t")).groupBy("t").count().collect())  # as many as the group has terms
        weight = weights([counted.get(k, 0) for k in range(len(vocabulary))], documents)
        wanted = [np.array([place[t] for t in own], np.int64) for _, own in group]
        tasks = max(1, math.ceil(documents / (8 * SEGMENT)))
        near = rows.where(F.size("term") > 0).repartitionByRange(tasks, "near", F.xxhash64("doc_id", "n"), F.monotonically_increasing_id()).sortWithinPartitions("near")
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(group)], "item int, item_id long")
        place_of = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        best = ranked(near, wanted, weight, documents, length, most).withColumn("rank", F.row_number().over(place_of)).where(F.col("rank") <= most)
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # a row for each item of the group
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERM = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS term FROM documents),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), ln AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY 1),
 tot AS (SELECT count(*) AS nn, cast(sum(n) AS BIGINT) AS ll FROM ln), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 w AS (SELECT term, cast(floor(1000 * ln((2 * nn + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, tot),
 m AS (SELECT doc_id, {100 - SLOPE} + cast(({SLOPE} * n * nn) // ll AS BIGINT) AS m FROM ln, tot),
 q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, {_TERM})) AS term FROM benchmark),
 s AS (SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
 r AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {MOST}
"""
