"""Operator 3: SimHash groups by Golay-code fuzzy hashing.

A text's fingerprint has a bit set where over half of its shingles' 64-bit hashes have it. Fingerprints that differ in
two bits or fewer link, and a document's group is all that links reach.

The fingerprint is cut into segments of 23, 23 and 18 bits. Every 23-bit word is within three errors of exactly one word
of the Golay code; a segment's keys are the indices of the code words that it and its one-bit changes decode to, one to
six keys. Two segments that differ in at most two bits have a word between them at one bit from both, so they share a
key. With two errors over three segments, one segment is equal (pigeonhole) and the next has at most two errors: each
fingerprint gets the keys (equal segment, Golay index of the next segment), about 16 of 30 to 35 bits, and no link is
missed. Equal keys join, and the exact distance in the join's condition lets only links out.

Only distinct fingerprints are joined, so copies never meet in pairs: a copy group of any size is one row. Links between
distinct fingerprints become groups by alternating large and small stars, each round cut by a checkpoint.

Null and empty texts, and texts of white space, have fingerprint zero and link like any other. A text with fewer words
than a shingle is one shingle. Rows with equal ids stay separate rows; a null id never names a group unless the group has
no other. An empty table gives an empty table; other columns are ignored. Texts pass through Python once, whole, with
hashes counted in blocks, so memory doesn't grow with their length beyond the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, documents, parts, text_of

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 1 << 16
#: Lowest bit and length of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the (23, 12) Golay code.
GENERATOR = 0b101011100011


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode().lower().split()  # bytes: A-Z only, and white space 0x20, 0x09 to 0x0D
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        here = words[at : at + BLOCK + shingle - 1]
        parts = zip(*(here[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [words]
        hashes = np.array([digest(b" ".join(x), SEED) for x in parts], ">u8")
        counts += ones(hashes)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of some big-endian hashes have each bit set, from the highest on."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def majority(hashes: np.ndarray) -> np.uint64:
    """The fingerprint of hashes that are at hand."""
    counts = sum((ones(hashes[at : at + BLOCK].astype(">u8")) for at in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64))
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64)[0]


def fingerprints(df: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed long) of each row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            bits = np.fromiter((fingerprint(x.as_py(), shingle) for x in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(hashed, "doc_id long, bits long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each bit of a word, and the error of weight three or less by syndrome."""
    bits = []
    for k in range(23):
        x = 1 << k
        for top in range(22, 10, -1):
            if x >> top & 1:
                x ^= GENERATOR << (top - 11)
        bits.append(x)
    errors = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            syndrome = 0
            for p in places:
                syndrome ^= bits[p]
            errors[syndrome] = sum(1 << p for p in places)
    return np.array(bits, np.int64), errors


def decode(words: np.ndarray) -> np.ndarray:
    """The index (12 bits) of the code word nearest to each 23-bit word."""
    bits, errors = _golay()
    syndrome = np.zeros_like(words)
    for k in range(23):
        syndrome ^= (words >> k & 1) * bits[k]
    return (words ^ errors[syndrome]) >> 11


def segment_keys(words: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for the distinct indices of each segment and of its one-bit changes."""
    flips = np.array([0, *(1 << k for k in range(length))], np.int64)
    found = np.sort(decode(words[:, None] ^ flips), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bits = b.column(0).to_numpy(zero_copy_only=False)
        cut = [(bits >> low) & ((1 << n) - 1) for low, n in SEGMENTS]
        rows, keys = [], []
        for k in range(len(SEGMENTS)):
            after = (k + 1) % len(SEGMENTS)
            row, index = segment_keys(cut[after], SEGMENTS[after][1])
            rows.append(row)
            keys.append((k << 35) | (cut[k][row] << 12) | index)
        row = np.concatenate(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(bits[row])], ["key", "bits"])


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints ``bits`` of ``nodes`` at a distance of 1 to ``radius`` (2 at most)."""
    if radius > 2:
        raise ValueError("the keys find differences of up to two bits")
    keyed = nodes.select("bits").mapInArrow(_keys, "key long, bits long")
    a, b = keyed.withColumnRenamed("bits", "a"), keyed.withColumnRenamed("bits", "b")
    near = a.join(b, (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    return near.select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that links reach."""
    edges = checkpoint(edges)
    state = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select("u", "v", "m")
        edges = small.select(F.col("v").alias("x"), F.col("m").alias("y")).union(small.select("u", "m")).where("x <> y").select(F.greatest("x", "y").alias("b"), F.least("x", "y").alias("a")).select("a", "b").distinct()
        edges = checkpoint(edges)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("groups did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Adds component_id, the smallest doc_id of each row's group, to the rows (doc_id, bits) of ``fingerprints``."""
    marked = checkpoint(marked)
    nodes = marked.groupBy("bits").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes, radius))
    named = nodes.join(roots, nodes["bits"] == roots["node"], "left").select("bits", "first", F.coalesce("root", "bits").alias("root"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_bits = named.join(ids, "root").select(F.col("bits").alias("own"), "component_id")
    return marked.join(by_bits, marked["bits"] == by_bits["own"]).drop("own")


def hexadecimal(bits: str) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def near_duplicates(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of each row of ``df``."""
    return groups(fingerprints(df, shingle), radius).select("doc_id", hexadecimal("bits").alias("fingerprint"), "component_id")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
