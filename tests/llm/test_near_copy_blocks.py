"""Dense groups of near copies in blocks, and what the stages leave in the shared folder."""

import os
import random

import pyarrow as pa
import pytest

import corpus_pipeline
from evokeline.llm import near_copies

from .test_near_copies import kept_ids, one_by_one, shingle_set


def dense():
    """Variants of one text that resemble each other by about 0.6 to 0.9, and a few texts of their own."""
    draw = random.Random(9)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base, texts = [word() for _ in range(120)], []
    for _ in range(60):
        own = list(base)
        for _ in range(draw.randrange(1, 5)):
            own[draw.randrange(len(own))] = word()
        texts.append(" ".join(own[: 120 - draw.randrange(12)]))
    return texts + [" ".join(word() for _ in range(30)) for _ in range(5)]


@pytest.mark.parametrize("worth", [0, 1 << 40])
def test_joined_and_in_blocks(spark, monkeypatch, worth):
    monkeypatch.setattr(near_copies, "WORTH", worth)
    monkeypatch.setattr(near_copies, "SIDE", 4)
    rows = list(enumerate(dense()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = one_by_one(rows)
    assert 5 < len(want) < 60
    assert kept_ids(corpus_pipeline.without_near_copies(spark, df, "")) == want
    assert not [x for x in os.listdir(spark.conf.get("spark.checkpoint.dir")) if x.startswith("keys-")]


def test_a_block_has_every_pair_that_links():
    sets = [near_copies.shingles(t) for t in dense()] + [near_copies.shingles("")]
    columns = {"node": range(len(sets)), "root": range(len(sets)), "n": [len(x) for x in sets], "sketch": [near_copies.sketch(x) for x in sets]}
    of = [shingle_set(t) for t in dense()]
    links = {(a, b) for a in range(len(of)) for b in range(a + 1, len(of)) if 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b])}
    side = lambda k: k % 2 == 1
    kinds = {"node": pa.int64(), "root": pa.int64(), "n": pa.int64(), "sketch": pa.list_(pa.int64())}
    for second in ([False] * len(sets), [side(k) for k in range(len(sets))]):
        block = pa.table({**{c: pa.array(list(columns[c]), kinds[c]) for c in columns}, "second": second})
        found = near_copies._block_pairs(block)
        pairs = list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))
        assert len(set(pairs)) == len(pairs)
        assert {(a, b) for a, b in links if not any(second) or side(a) != side(b)} <= set(pairs)


def test_toxicity_keeps_no_table_of_its_own(spark):
    sf, folder = "/root/testdata/sf0.001", spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    kept = corpus_pipeline.without_toxic(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)
    assert kept.count() and not [x for x in set(os.listdir(folder)) - before if x.startswith("toxicity")]
