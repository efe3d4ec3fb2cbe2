import math
import random
import re
from collections import Counter

import numpy as np

from evokeline.llm import lexical_search as ls

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def one_by_one(docs, items, most=50):
    """Every document scored for every item."""
    counts = [(d, Counter(own)) for d, t in docs if (own := terms(t))]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if no_id else d, -s) for k, (s, no_id, d) in enumerate(sorted(scored)[:most])]
    return out


def check(spark, df, items, **options):
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in ls.search(df, queries, **options).collect()]
    want = one_by_one([(r["doc_id"], r["text"]) for r in df.collect()], items, options.get("most", 50))
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


def test_given_tables(spark, docs):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = check(spark, docs, items)
    assert len(got) > 40 * len(items)
    check(spark, docs, items[:12], most_terms=60)  # in several groups
    check(spark, docs, items[:3], most=3)


def test_odd_rows(spark, odd, none):
    items = [(1, "The same words"), (2, None), (3, "…!"), (4, "nowhere found"), (5, "ünïcödé 日本語 word İ"), (6, "WORD word Here"), (6, "here"), (None, "again")]
    check(spark, odd, items)
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert ls.search(none, queries).collect() == []
    assert ls.search(odd, queries.limit(0)).collect() == []
    assert ls.search(odd, queries).columns == ["item_id", "rank", "doc_id", "score"]


def test_ties_and_copies(spark):
    draw = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(draw.choices(words, weights=range(1, 41), k=draw.randrange(1, 12)))) for k in range(300)]
    rows += [(1000 + k, "w1 w2 w39") for k in range(120)] + rows[:20] + [(None, "w1 w2 w39")] * 3
    draw.shuffle(rows)
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"), [(k, " ".join(draw.sample(words, 6))) for k in range(20)] + [(99, "w1 w2"), (100, "w39")])


def test_terms_are_those_of_the_pattern():
    draw = random.Random(6)
    for _ in range(300):
        text = "".join(draw.choices("aZ09 é日😀\u0085 -_/:@[`{\x7f\0\nİß", k=30))
        assert [x for x in ls.terms(text) if x] == terms(text)


def segment(draw, n=400, terms_of=60, block=16):
    """Vectors of three kinds of rows, as a segment."""
    rows, cols, tfs = [], [], []
    for k in range(n):
        kind = k % 3
        for t in sorted({min(terms_of - 1, 20 * kind + int(draw.paretovariate(0.6)) - 1) for _ in range(12)}):
            rows.append(k)
            cols.append(t)
            tfs.append(draw.randrange(1, 6))
    n_terms = np.array([draw.randrange(20, 400) for _ in range(n)])
    weight = ls.weights(np.bincount(cols, minlength=terms_of + 3).tolist(), n)
    return ls.Segment(np.arange(n), np.zeros(n, bool), n_terms, np.array(rows), np.array(cols), np.array(tfs), weight, n, int(n_terms.sum()), block), terms_of


def test_bounds_hold_and_blocks_are_skipped():
    draw = random.Random(7)
    own, n = segment(draw)
    assert sorted(zip(own.members.tolist(), np.repeat(own.of, own.ends - own.firsts).tolist(), strict=True)) == sorted(zip(*map(np.ndarray.tolist, np.nonzero(own.adds)), strict=True))  # each posting once
    wanted = [np.array(sorted(draw.sample(range(n), 8))) for _ in range(30)]
    matrix = np.zeros((30, len(own.terms)), np.uint8)
    for k, w in enumerate(wanted):
        matrix[k, own.column_of[w][own.column_of[w] >= 0]] = 1
    bounds, scores = own.bounds(matrix), own.adds @ matrix.T.astype(np.int64)
    for k, (c, a, b) in enumerate(zip(own.of, own.firsts, own.ends, strict=True)):
        for r in own.members[a:b]:
            heaviest = (own.adds[r] > 0)[None, :] & (matrix == 1)
            first = np.where(heaviest.any(1), heaviest.argmax(1), -1)
            assert np.all(scores[r][first == c] <= bounds[k][first == c])
    best = [ls.Best(5) for _ in wanted]
    skipped = ls.visit(own, wanted, best, 5)
    for k, b in enumerate(best):
        order = np.lexsort((np.arange(len(scores)), -scores[:, k]))[:5]
        assert b.doc_id.tolist() == [int(r) for r in order if scores[r, k] > 0]
    assert skipped > 0.3 * sum(int(matrix[k][own.of].sum()) for k in range(30))


def test_blocks_hold_rows_that_are_alike():
    own, _ = segment(random.Random(9), n=900, block=32)
    kinds = [np.bincount(own.members[a:b] % 3, minlength=3) for a, b in zip(own.firsts, own.ends, strict=True) if b - a == 32]
    assert np.mean([k.max() / k.sum() for k in kinds]) > 0.8
