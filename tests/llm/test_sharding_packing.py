import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evokeline.llm import packing, sharding
from evokeline.llm.tokens import packed_ids


def shards_one_by_one(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, start, out, slots = sum(sizes), 0, [], {}
    for (doc, text), size in zip(rows, sizes, strict=True):
        shard = n * (2 * start + size) // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((doc, size, zlib.crc32((text or "").encode()), shard, slots[shard]))
        start += size
    return out


def check_shards(df, n=16):
    got = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(df, n).collect()]
    want = shards_one_by_one([(r["doc_id"], r["text"]) for r in df.collect()], n)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_shards(docs, odd, none):
    check_shards(docs)
    check_shards(odd, 3)
    assert sharding.shard(none).count() == 0
    sizes = [r["s"] for r in sharding.shard(docs).groupBy("shard").sum("size").withColumnRenamed("sum(size)", "s").collect()]
    longest = max(len(r["text"].encode()) + 1 for r in docs.collect())
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * longest


PATH = public_tokenizers.path(packing.VOCABULARY)
TOKENIZER = Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t.'sS\x1c éÉİΣ<|endoftext|>")), max_size=40))
def test_ids_equal_the_library(text):
    assert np.frombuffer(packed_ids([text], PATH)[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def check_pack(df):
    rows = packing.pack(packing.pieces(df, with_ids=4)).collect()
    by_doc, bins = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        if len(texts[doc]) == 1:
            whole = b"".join(x[2] for x in sorted(own))
            assert np.frombuffer(whole, "<u4").tolist() == TOKENIZER.encode(texts[doc][0], add_special_tokens=False).ids + [1]
            assert [x[1] for x in sorted(own)] == [4096 * k for k in range(len(own))]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins), sum(r["length"] for r in rows), sum(2 * r["length"] > 4096 for r in rows)


def test_packing(docs, odd, none):
    n, tokens, large = check_pack(docs)
    assert n <= max(-(-tokens // 4096), large) + 1
    check_pack(odd)
    assert packing.pack(packing.pieces(none)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=20))
def test_plan(counts):
    seen, bins = dict.fromkeys(counts, 0), {}
    for length, first, n, bin_, offset in packing.plan(counts, 50):
        assert first == seen[length] and n > 0
        seen[length] += n
        for k in range(n):
            bins.setdefault(bin_ + k, []).append((offset, length))
    assert seen == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 50


def test_caches_are_bounded_by_bytes(monkeypatch):
    """Unbroken texts of a script without spaces leave nothing in the caches; many words leave at most their bounds."""
    from evokeline.llm import pieces, tokens

    draw = __import__("random").Random(1)
    unbroken = ["".join(map(chr, (draw.randrange(0x4E00, 0x9FA5) for _ in range(20_000)))) for _ in range(20)]
    words = [" ".join("".join(draw.choices("abcdeghé", k=9)) for _ in range(5000)) for _ in range(40)]
    own = pieces.Pieces(public_tokenizers.path(pieces.MODEL))
    own.words.most = 1 << 20
    caches = tokens.encoder(PATH)
    for x in caches:
        x.clear()
        x.held = 0
    monkeypatch.setattr(caches[0], "most", 1 << 20)
    size = lambda d: sum(__import__("sys").getsizeof(k) + __import__("sys").getsizeof(v) + 100 for k, v in d.items())
    for t in unbroken:
        packed_ids([t], PATH)
        own.encode(t)
    assert size(caches[0]) + size(caches[1]) + size(own.words) < 1 << 16
    for t in words:
        packed_ids([t], PATH)
        own.encode(t)
        assert size(caches[0]) < 4 << 20 and len(own.words) * 400 < 4 << 20


def test_session_stays_as_it_is(spark, odd):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    packing.pieces(odd).count()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))


def test_ids_of_dotted_capitals_and_marks():
    """Letters whose small form ends in a combining mark, before punctuation and alone."""
    draw = random.Random(12)
    texts = ["BELEDİYESİ.", "BELEDİYESİ, ve", "İ!", "İ/", "Bİ", "İİ;", "i̇.", "I\u0307."]
    signs = [*"aZiIİıéÉßŞğ.,;!/'-_() 0", "\u0307", "\u0301", "\u0327", "日", "😀", "\n", "\t"]
    texts += ["".join(draw.choices(signs, k=draw.randrange(1, 14))) for _ in range(20_000)]
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        got = packed_ids(part, PATH)
        for text, ids, want in zip(part, got, TOKENIZER.encode_batch(part, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want.ids, repr(text)
