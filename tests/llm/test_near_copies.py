import random
from itertools import combinations

import corpus_pipeline
from evokeline.llm import near_copies


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def one_by_one(rows):
    """The smallest id (ids first, then none) of each group of texts linked by a Jaccard index of 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    least = {}
    for k, (doc, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), (True, 0)), (doc is None, doc or 0))
    return sorted(least.values())


def edited():
    """Near copies of several texts with up to four edited words, a chain of them, and texts around one common passage."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        for _ in range(6):
            own = list(base)
            for _ in range(draw.randrange(5)):
                own[draw.randrange(len(own))] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(150)]
    for k in range(15):
        texts.append(" ".join(chain[k * 4 : k * 4 + 90]))
        texts.append(" ".join([word() for _ in range(8 + k)] + passage))
    return texts


def kept_ids(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in df.collect())


def test_stage_equals_brute_force(spark):
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = one_by_one(list(enumerate(texts)))
    assert 12 < len(want) < len(texts) - 40
    assert kept_ids(corpus_pipeline.without_near_copies(spark, df, "")) == want


def test_hot_keys_are_dealt_out(spark, monkeypatch):
    """The same groups with every shared shingle a hot key in a few parts."""
    monkeypatch.setattr(near_copies, "HOT", 4)
    monkeypatch.setattr(near_copies, "SALTS", 3)
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert kept_ids(corpus_pipeline.without_near_copies(spark, df, "")) == one_by_one(list(enumerate(texts)))


def test_stage_on_a_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id % 2 = 0 or doc_id < 300")
    assert kept_ids(corpus_pipeline.without_near_copies(spark, df, "")) == one_by_one([(r["doc_id"], r["text"]) for r in df.collect()])


def test_one_row_of_each_group(spark, odd, none):
    kept = corpus_pipeline.without_near_copies(spark, odd, "")
    assert kept.columns == odd.columns
    assert kept_ids(kept) == one_by_one([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert corpus_pipeline.without_near_copies(spark, none, "").count() == 0
    rows = [(None, "a text without an id"), (None, "a text without an id"), (5, "held twice by one id here"), (5, "held twice by one id here"), (None, "held twice by one id here"), (5, "another text of the id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["text"] for r in corpus_pipeline.without_near_copies(spark, df, "").collect()) == ["a text without an id", "another text of the id", "held twice by one id here"]


def test_first_keys_order():
    hashes = near_copies.shingles("one two three four five six seven eight nine ten")
    assert len(hashes) == 6 and len(near_copies.first_keys(hashes, hashes[:0], hashes[:0])) == 2


def test_fingerprints_alone_lose_links(spark):
    """What the second search is for: operator 3's keys find part of the links of 0.8 or more."""
    texts = edited()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own = near_copies._texts(df)
    marked = near_copies._marked(own, *near_copies.common_shingles(own))
    found = near_copies._by_fingerprint(marked.dropDuplicates(["node"])).count()
    linked = sum(5 * len(a & b) >= 4 * len(a | b) for a, b in combinations([shingle_set(t) for t in texts], 2))
    assert 0 < found < linked


def test_sketches_lose_no_link():
    draw = random.Random(3)
    for size in (1, 3, 40, 300, 3000):
        for _ in range(20):
            a = {draw.getrandbits(64) for _ in range(size)}
            b = set(list(a)[draw.randrange(size // 5 + 1) :]) | {draw.getrandbits(64) for _ in range(draw.randrange(size // 4 + 1))}
            x, y = (near_copies.sketch(near_copies.np.array(sorted(s), "u8")) for s in (a, b))
            while len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while len(y) > len(x):
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
            assert sum(int(v).bit_count() for v in (x ^ y).view("u8")) <= len(a ^ b)
