"""Near copies by operator 3 and exact resemblance: groups of texts whose five-word shingles have a Jaccard index of 0.8 or more.

The Golay keys of operator 3 (``simhash.links``, here over five words) find the near copies whose fingerprints differ in
at most two bits, and the whole sets decide. Texts at 0.8 differ in about ten bits of 64 though, more than Golay keys reach with
selective keys, so a second search finds the links between the groups that are left. It misses none (prefix filter): with
the shingles of all texts in one common order, two sets that resemble by 0.8 share one of their first n - ceil(0.8 n) + 1
members. Those are the join keys. Any order is exact; this one puts shingles that a sample of texts holds often last, so that
passages which many texts share are no keys of texts that hold more than them.

A pair is first compared by sketches, one or two bits for each shingle: the parity of how many fall into a cell. Cells that differ
hold a shingle that only one of both has, so pairs with more of them than a resemblance of 0.8 allows are done, and only the
others need the whole sets. Nothing is lost by it.

Only distinct sets are nodes: a group of copies of any size is one. Every key's smallest node is first compared with all
others of the key; nodes outside the key's largest group then meet one of its members, another one in each key they share;
those of the largest group are done by then, and only what is still outside it meets the key's nodes of other groups. A large group of near copies thus costs its size and not its square, and still no pair that could join two
groups goes unseen. Shingles that the sample finds in many texts are hot keys: their nodes are dealt to ``SALTS`` parts, each
with a smallest node of its own, and these meet the key's smallest one.

Words are as in operator 3. Texts with fewer than five words are one shingle; null, empty and blank texts are one group. A row's
id orders a group and rows without one come last; equal rows are one node, of which one row stays. Empty tables give empty
ones. Other columns stay as they are, whatever their names: the operator's own get names that the table doesn't have.

What is still outside a key's largest group meets it in one of two ways, whichever is less work. Where few nodes share a key, the
pairs of each key are joined, and those with too few common keys for 0.8 go. Members of a large group whose pairs resemble by
just under 0.8 share so many keys that these rows are far more than the pairs: there all nodes outside a group are compared
by sketches with the group and each other, in blocks of ``SIDE`` by ``SIDE`` nodes inside a task, which returns the pairs that may
link. Both are exact; the second still compares with the square of such a group, but neither moves nor keeps its pairs.

Tables of keys, the largest ones, are written as compressed columns and deleted as soon as their step is over.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.session import forget, scratch
from . import simhash
from .common import bounded, checkpoint, let_go, own_names, parts, text_of

SHINGLE = 5
SEED = 42
#: Rows about that the order of shingles is learnt from, in how many of them a shingle is a common one, and how many are told apart.
SAMPLE, OFTEN, COMMON = 4000, 4, 100_000
#: How many sampled texts hold a hot key, and the parts of its nodes.
HOT, SALTS = 40, 32
#: Nodes on each side of a block, and how many comparisons of sketches in blocks take as long as one row of a join, or less.
SIDE, WORTH = 4096, 64
#: Words of sketches that are compared at once.
AT_ONCE = 1 << 20


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the runs of ``size`` words, ascending."""
    words = text.encode().lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = (mixed ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Of each cell of the low bits of a hash the parity of how many fall into it, as longs; two to four cells a shingle."""
    cells = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def first_keys(hashes: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The members of a set that one of 0.8 resemblance shares one of, in the common order."""
    n = len(hashes)
    often = np.zeros(n, np.int64)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        often = np.where(common[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, often))][: n - (4 * n + 4) // 5 + 1]


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _sets(texts: DataFrame) -> DataFrame:
    """node, hashes of each row of ``texts``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [shingles(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.select("text").mapInArrow(hashed, "node long, hashes array<long>")


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled texts hold, ascending, with their counts."""
    every = max(1, texts.count() // SAMPLE)
    seen = _sets(texts.where(F.pmod("text_hash", F.lit(every)) == 0)).dropDuplicates(["node"]).select(F.explode("hashes").alias("h"))
    rows = seen.groupBy("h").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).collect()
    common, counts = np.array([r["h"] for r in rows], np.int64).view(np.uint64), np.array([r["count"] for r in rows], np.int64)
    by = np.argsort(common)
    return common[by], counts[by]


def _marked(texts: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, text_hash, node, n (shingles), bits (the SimHash), sketch, keys of each row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            sets = [shingles(x.as_py()) for x in b.column(2)]
            lists = [pa.array([f(x) for x in sets], pa.list_(pa.int64())) for f in (sketch, lambda x: first_keys(x, common, counts).view(np.int64))]
            longs = [pa.array([f(x) for x in sets], pa.int64()) for f in (node_of, len, lambda x: int(simhash.majority(x).view(np.int64)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *longs, *lists], ["doc_id", "text_hash", "node", "n", "bits", "sketch", "keys"])

    return texts.select("doc_id", "text_hash", "text").mapInArrow(marked, "doc_id long, text_hash long, node long, n long, bits long, sketch array<long>, keys array<long>")


def _may_link(x: str, y: str) -> Column:
    """Whether two sets that first meet at the places ``x`` and ``y`` (size * 2^32 + place) can still resemble by 0.8."""
    size, at = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    ahead = F.least(size(x) - at(x), size(y) - at(y))
    return 9 * ahead >= 4 * (size(x) + size(y))


def _enough_keys() -> Column:
    """Whether two sets with so many ``shared`` keys can resemble by 0.8.

    Of the two last keys one isn't after the other; that set's keys are in the other set only as keys. So both have at most
    their shared keys in common and the members of that set behind its keys.
    """
    behind = lambda n: F.floor((4 * F.col(n) + 4) / 5) - 1
    return 9 * (F.col("shared") + F.greatest(behind("n_a"), behind("n_b"))) >= 4 * (F.col("n_a") + F.col("n_b"))


def _differing(x: str, y: str) -> Column:
    """How many cells of two sketches differ; the longer one is folded to the length of the other."""
    half = lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) / 2), F.slice(c, F.size(c) / 2 + 1, F.size(c) / 2), lambda u, v: u.bitwiseXOR(v))
    a, b = F.when(F.size(x) > F.size(y), half(x)).otherwise(F.col(x)), F.when(F.size(y) > F.size(x), half(y)).otherwise(F.col(y))
    return F.aggregate(F.zip_with(a, b, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, c: n + c)


def _verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets resemble by 0.8 or more."""
    side = lambda node, n, name: nodes.select(F.col("node").alias(node), F.col("n").alias(n), F.col("sketch").alias(name))
    sketched = pairs.distinct().join(side("b", "n_b", "y"), "b").join(side("a", "n_a", "x"), "a")
    close = (F.size("x") <= 2 * F.size("y")) & (F.size("y") <= 2 * F.size("x"))  # all that resemble by 0.8 are
    return _linked(sketched.where(close).where(9 * _differing("x", "y") <= F.col("n_a") + F.col("n_b")).select("a", "b"), texts, nodes)


def _linked(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of some distinct pairs whose whole sets resemble by 0.8 or more."""
    pairs = checkpoint(pairs)
    needed = checkpoint(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    one = checkpoint(nodes.select("node", "text_hash").join(bounded(needed, 24), "node", "left_semi").select("text_hash"))
    sets = _sets(texts.join(bounded(one, 24), "text_hash", "left_semi")).dropDuplicates(["node"])
    left, right = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    found = checkpoint(pairs.join(right, "b").join(left, "a").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))
    del pairs, needed, one, sets, left, right
    let_go(texts.sparkSession)
    return found


@contextmanager
def put_aside(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, which is deleted afterwards."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "keys")
    try:
        df.write.option("compression", "zstd").parquet(path)
        let_go(spark)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        forget(spark, path)


def alike(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of two sides (node, root, n, sketches of one length each) whose sketches leave a resemblance of 0.8 open.

    Nodes of one root are no pairs. ``same``: both sides are one, of which each pair counts once. The longer sketches are folded.
    """
    (a, root_a, n_a, x), (b, root_b, n_b, y) = left, right
    fold = lambda z: z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :]
    x, y = fold(x) if x.shape[1] > y.shape[1] else x, fold(y) if y.shape[1] > x.shape[1] else y
    rows, found = max(1, AT_ONCE // max(1, len(b))), []
    for at in range(0, len(a), rows):
        part = slice(at, at + rows)
        differing = np.zeros((len(a[part]), len(b)), np.int32)
        for k in range(x.shape[1]):
            differing += np.bitwise_count(x[part, k, None] ^ y[None, :, k])
        u, v = np.nonzero(9 * differing <= n_a[part, None] + n_b[None, :])
        u += at
        keep = root_a[u] != root_b[v]
        if same:
            keep &= u < v
        found.append((a[u[keep]], b[v[keep]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else a[:0] for k in (0, 1))


def _block_pairs(block: pa.Table) -> pa.Table:
    """a, b of the pairs of a block that may link: of its two sides, or of its only one."""
    block = block.combine_chunks()
    cells = block["sketch"].combine_chunks()
    lengths = cells.value_lengths().to_numpy()
    starts, words = cells.offsets.to_numpy()[:-1], cells.values.to_numpy()
    second = block["second"].to_numpy()
    numbers = [block[c].to_numpy() for c in ("node", "root", "n")]
    one_side = not second.any()

    def of(side: bool, length: int) -> tuple[np.ndarray, ...]:
        own = np.flatnonzero((second == side) & (lengths == length))
        return (*(x[own] for x in numbers), words[starts[own, None] + np.arange(length)].view(np.uint64))

    found = []
    for length in np.unique(lengths):
        for u, v in ((length, length), (length, 2 * length), (2 * length, length))[: 2 if one_side else 3]:
            left, right = of(False, u), of(not one_side, v)
            if len(left[0]) and len(right[0]):
                found.append(alike(left, right, one_side and u == v))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _in_blocks(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that may link of nodes (main, node, root, blocks) outside a group ``main`` (blocks[0] blocks) with its members (blocks[1]) and each other."""
    outside, number = F.col("root") != F.col("main"), F.pmod(F.xxhash64("node"), F.when(F.col("root") != F.col("main"), F.col("blocks.few")).otherwise(F.col("blocks.own")))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cell = lambda x, y, mixed, second: F.struct(x.alias("x"), y.alias("y"), F.lit(mixed).alias("mixed"), second.alias("second"))
    i = F.col("number")
    among = F.transform(upto("blocks.few"), lambda j: cell(F.least(i, j), F.greatest(i, j), False, i > j))
    to_group = F.transform(upto("blocks.own"), lambda k: cell(i, k, True, F.lit(False)))
    of_group = F.transform(upto("blocks.few"), lambda k: cell(k, i, True, F.lit(True)))
    dealt = shared.withColumn("number", number).withColumn("cell", F.explode(F.when(outside, F.concat(among, to_group)).otherwise(of_group)))
    blocks = dealt.select("main", "node", "root", "cell.*").join(nodes.select("node", "n", "sketch"), "node")
    return blocks.groupBy("main", "x", "y", "mixed").applyInArrow(_block_pairs, "a long, b long").distinct()


def _last_pairs(split: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links of what is outside a key's largest group; ``split`` has h, node, place, root, main of the keys of several groups."""
    spark = texts.sparkSession
    here = split.groupBy("h", "main").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("root") != F.col("main")).alias("few"))
    joined = here.groupBy("main").agg(F.sum(F.col("few") * (F.col("all") - (F.col("few") + 1) / 2)).alias("rows"))
    shared = checkpoint(split.select("main", "node", "root").distinct())
    sizes = shared.groupBy("main").agg(F.count_if(F.col("root") != F.col("main")).alias("few"), F.count_if(F.col("root") == F.col("main")).alias("own"))
    compared = F.col("few") * (F.col("own") + F.col("few") / 2)
    blocks = F.struct(*(F.ceil(F.col(c) / SIDE).alias(c) for c in ("few", "own")))
    dense = checkpoint(sizes.join(joined, "main").where(compared <= WORTH * F.col("rows")).select("main", blocks.alias("blocks")))
    pairs = checkpoint(_in_blocks(shared.join(bounded(dense, 32), "main"), nodes))
    rest = split.join(bounded(dense, 32), "main", "left_anti")
    few = rest.where("root <> main").select("h", F.col("node").alias("a"), F.col("place").alias("a_place"), F.col("root").alias("own"))
    meet = few.join(rest, "h").where("own <> root and (root = main or a < node)").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"), F.when(F.col("a") < F.col("node"), F.shiftright("a_place", 32)).otherwise(F.shiftright("place", 32)).alias("n_a"), F.when(F.col("a") < F.col("node"), F.shiftright("place", 32)).otherwise(F.shiftright("a_place", 32)).alias("n_b"))
    across = meet.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b")).where(_enough_keys())
    sparse = _verified(across.select("a", "b"), texts, nodes)
    found = checkpoint(sparse.union(_linked(pairs, texts, nodes)))
    del shared, dense, pairs, sparse
    let_go(spark)
    return found


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes with equal fingerprints, as stars, and with fingerprints that operator 3 links."""
    firsts = nodes.groupBy("bits").agg(F.min("node").alias("first"))
    same = nodes.select("bits", "node").join(firsts, "bits").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = simhash.links(firsts.select("bits"))
    ends = found.join(firsts.withColumnsRenamed({"bits": "a", "first": "u"}), "a").join(firsts.withColumnsRenamed({"bits": "b", "first": "v"}), "b")
    return same.union(ends.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")))


def _components(links: DataFrame) -> DataFrame:
    found = simhash.components(links)
    let_go(links.sparkSession)  # of the rounds
    return found


def roots(texts: DataFrame, marked: DataFrame, hot: DataFrame) -> DataFrame:
    """(node, root) for every node that links to another one; ``hot`` has the keys ``h`` of many texts."""
    nodes = marked.groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch"))
    nodes = checkpoint(nodes)
    links = _verified(_by_fingerprint(nodes), texts, nodes)
    found = _components(links)
    listed = marked.select("node", "n", "keys").dropDuplicates(["node"]).select("node", "n", F.posexplode("keys").alias("at", "h"))
    placed = listed.select("h", "node", F.shiftleft("n", 32).bitwiseOR(F.col("at").cast("long")).alias("place")).join(bounded(found, 24), "node", "left").select("h", "node", "place", F.coalesce("root", "node").alias("root"))
    salted = placed.join(F.broadcast(hot.withColumn("salts", F.lit(SALTS))), "h", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), "salts")).cast("int"))  # COMMON keys at most
    part = Window.partitionBy("h", "salt")
    met = salted.withColumn("top", F.min(F.struct("root", "node", "place")).over(part)).withColumn("last", F.max("root").over(part))
    met = met.where("top.root < last or salts is not null").select("h", "node", "place", "root", "top", F.col("salts").isNotNull().alias("hot"))
    del placed, salted
    with put_aside(met) as keys:
        tops = keys.where("hot").select("h", "top").distinct()  # SALTS for each hot key
        least = tops.groupBy("h").agg(F.min("top").alias("least"))
        stars = keys.select("root", "node", "place", "top").union(tops.join(least, "h").select("top.root", "top.node", "top.place", "least"))
        stars = stars.where(F.col("root") != F.col("top.root")).select("node", "place", "top.node", "top.place").toDF("b", "b_place", "a", "a_place").where(_may_link("a_place", "b_place"))
        links = checkpoint(links.union(_verified(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts, nodes)))
        found = _components(links)
        with put_aside(_split(keys, found)) as split:
            few = split.where("root <> main").select("h", F.col("node").alias("a"), F.col("place").alias("a_place"))
            member = split.where("root = main").groupBy("h").agg(F.min(F.struct(F.xxhash64("h", "node").alias("order"), "node", "place")).alias("one"))
            tries = few.join(member, "h").select("a", "a_place", F.col("one.node").alias("b"), F.col("one.place").alias("b_place")).where(_may_link("a_place", "b_place"))
            links = checkpoint(links.union(_verified(tries.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts, nodes)))
        found = _components(links)
        with put_aside(_split(keys, found)) as split:
            more = _last_pairs(split, texts, nodes)
    return found if more.isEmpty() else _components(links.union(more))


def _split(keys: DataFrame, found: DataFrame) -> DataFrame:
    """h, node, place, root, main (the largest group) of the keys that nodes of several groups share."""
    placed = keys.select("h", "node", "place").join(bounded(found, 24), "node", "left").select("h", "node", "place", F.coalesce("root", "node").alias("root"))
    sizes = checkpoint(placed.groupBy("h", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("h").agg(F.max(F.struct("size", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("h", "main"))
    return placed.join(bounded(sizes, 24), "h")


def grouped(df: DataFrame) -> DataFrame:
    """doc_id, text_hash, root (a name of the row's group) of each row of ``df``."""
    texts = _texts(df)
    common, counts = common_shingles(texts)
    hot = df.sparkSession.createDataFrame([(int(h),) for h in common[counts >= HOT].view(np.int64)], "h long")
    marked = checkpoint(_marked(texts, common, counts))
    return marked.select("doc_id", "text_hash", "node").join(roots(texts, marked, hot), "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))


def first_of_each(df: DataFrame) -> DataFrame:
    """One row of each group of near copies: that of the smallest id, rows without an id last."""
    rows = checkpoint(grouped(df).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("same")))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    own, own_hash = own_names(df, "own", "own_hash")
    told = rows.join(first, "root").select(F.col("doc_id").alias(own), F.col("text_hash").alias(own_hash), "same", is_first.alias("kept"))
    lost, twice = checkpoint(told.where("not kept").select(own, own_hash)), checkpoint(told.where("kept and same > 1").select(own, own_hash))
    on = (F.xxhash64(F.coalesce(df["text"], F.lit(""))) == F.col(own_hash)) & df["doc_id"].cast("long").eqNullSafe(F.col(own))
    rest = df.join(bounded(lost, 24), on, "left_anti")
    if twice.isEmpty():
        return rest
    repeated = rest.join(bounded(twice, 24), on).dropDuplicates([own, own_hash]).select(*[df[c] for c in df.columns])
    return rest.join(bounded(twice, 24), on, "left_anti").union(repeated)
