import hashlib
import random
from itertools import combinations

import numpy as np
import xxhash

from evokeline.llm import line_dedup, minhash, simhash


def bits_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).encode().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_one_by_one(rows):
    bits = [bits_of(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if (bits[a] ^ bits[b]).bit_count() <= 2:
            root[find(b)] = find(a)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return [(doc, f"{bits[k]:016x}", least.get(find(k))) for k, (doc, _) in enumerate(rows)]


def check_groups(df):
    got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
    want = groups_one_by_one([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted(got, key=str) == sorted(want, key=str)


def test_groups(docs, odd, none):
    check_groups(docs)
    check_groups(odd)
    assert simhash.near_duplicates(none).count() == 0


def test_golay_code():
    draw = np.random.default_rng(1)
    words = draw.integers(0, 1 << 23, 3000)
    index = simhash.decode(words)
    assert index.min() >= 0 and index.max() < 4096
    same = simhash.decode((index << 11) ^ simhash._golay()[1][0])  # any word decodes to one index
    assert same.shape == index.shape
    row, key = simhash.segment_keys(words, 23)
    assert np.bincount(row).max() <= 6
    keys = {}
    for r, k in zip(row, key, strict=True):
        keys.setdefault(r, set()).add(k)
    for k in range(500):
        a, b = draw.choice(23, 2, replace=False)
        other = words[k] ^ (1 << int(a)) ^ (1 << int(b))
        assert keys[k] & set(simhash.segment_keys(np.array([other]), 23)[1])


def test_links_lose_none(spark):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(20)]
    values = {b ^ sum(1 << draw.randrange(64) for _ in range(draw.randrange(4))) & ((1 << 64) - 1) for b in base for _ in range(30)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long")).collect()}
    want = {(min(a, b), max(a, b)) for a, b in combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want and len(want) > 100


def test_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long")
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {roots[k] for k in range(1, 201)} == {0} and roots[501] == 500


def lines_one_by_one(rows, least):
    spread, first = {}, {}
    for doc, text, site in rows:
        for k, x in enumerate((text or "").split("\n")):
            if x.strip(" "):
                spread.setdefault(x.strip(" "), set()).add(site)
                first[x.strip(" ")] = min(first.get(x.strip(" "), (doc, k)), (doc, k))
    out = {}
    for doc, text, _ in rows:
        if text is not None:
            parts = text.split("\n")
            text = "\n".join(x for k, x in enumerate(parts) if len(spread.get(x.strip(" "), ())) < least or first[x.strip(" ")] == (doc, k))
        out[doc] = text
    return out


def test_lines(spark, docs, odd, none):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    for least in (2, 4):
        got = {r["doc_id"]: r["text"] for r in line_dedup.without_boilerplate(docs, least).collect()}
        assert got == lines_one_by_one(rows, least)
    out = line_dedup.without_boilerplate(odd, 1)
    assert out.columns == [*odd.columns, "n_removed_"] and out.where("n_removed <> 'clash' or _gone <> 'clash' or _text <> 'clash'").count() == 0
    assert out.count() == odd.count() and out.where("doc_id = 1").first()["text"] is None
    assert [r["text"] for r in line_dedup.without_boilerplate(odd.where("doc_id = 7"), 1).collect()] == ["a\n\nb"]
    assert line_dedup.without_boilerplate(none).count() == 0


def test_few_lines_lost(spark, monkeypatch):
    """The same rows whether the lines that go are broadcast or shuffled."""
    from evokeline.llm import common

    rows = [(k, f"own {k}\nshared line\nend {k % 3}", f"s{k % 5}") for k in range(40)] + [(None, "shared line\nx", "s1")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    a = sorted(map(str, line_dedup.without_boilerplate(df, 4).collect()))
    monkeypatch.setattr(common, "BROADCAST", -1)
    assert a == sorted(map(str, line_dedup.without_boilerplate(df, 4).collect()))
    assert sum("n_removed=1" in x or "n_removed=2" in x for x in a) == 40  # the rows without an id hold the first occurrence


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_fingerprints(docs, odd, none):
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in minhash.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (doc, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for name, other in (("near_edited", edited), ("near_next", after)):
            a, b = shingles(text), shingles(other)
            errors.append(r[name] - len(a & b) / len(a | b))
    assert np.sqrt(np.mean(np.square(errors))) < 0.06 and abs(np.mean(errors)) < 0.02
    by_text = {}
    for doc, text in rows:
        by_text.setdefault(text, set()).add(got[doc]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())
    strange = minhash.edited_fingerprints(odd).collect()
    assert len(strange) == odd.count() and all(0 <= r["near_next"] <= 1 for r in strange)
    assert minhash.edited_fingerprints(none).count() == 0
    assert sorted(minhash.with_next(odd.select("doc_id", minhash.text_of().alias("text"))).where("ghost").groupBy("block").count().select("count").distinct().collect()) == [(1,)]
    alone = minhash.edited_fingerprints(odd.where("doc_id = 4")).collect()
    assert alone[0]["near_next"] == 1.0


def test_neighbours_of_one_id(spark, monkeypatch):
    """Rows that share an id are dealt into blocks by their text, and still follow one order."""
    monkeypatch.setattr(minhash, "BLOCKS", 5)
    rows = [(7, f"text number {k} of many words that differ {k * k}") for k in range(300)] + [(None, f"none {k}") for k in range(60)] + [(k, f"other {k} words") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = minhash.with_next(df)
    assert dealt.where("not ghost").groupBy("block").count().count() > 12
    got = {r["edited_sha256"]: r["n_chars"] for r in minhash.edited_fingerprints(df).collect()}
    signed = lambda t: np.uint64(xxhash.xxh64_intdigest(t, 42)).view(np.int64)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    for k, (_, text) in enumerate(order):
        half = len(text) // 2
        edited = text[: len(text) - half] + order[(k + 1) % len(order)][1][:half]
        assert got[hashlib.sha256(edited.encode()).hexdigest()] == len(text)
