import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from evokeline.llm import fill_middle as fm


def one_by_one(doc_id, text):
    """The row of a text by its list of units."""
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(df):
    got = fm.fill_middle(df).withColumn("back", fm.restored()).collect()
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((one_by_one(*r) for r in rows), key=str)
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)


def test_tables(docs, odd, none):
    check(docs)
    check(odd)
    assert fm.fill_middle(none).collect() == []


def test_odd_texts(spark):
    draw = random.Random(3)
    marks = ["<P>", "<S>", "<M>", "<", "P>", "a", "Z", "é", "日", "😀", "\0", "\n", " ", "0", "[", "`", "{", "@", "\x7f", "\u0080", "İ"]
    texts = ["".join(draw.choices(marks[3:] if k % 3 else marks, k=draw.randrange(40))) for k in range(600)] + ["x" * 100_000 + "é", "<" * 17, "😀" * 8]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZé日😀 \0<{"), max_size=30), min_size=1, max_size=6))
def test_units_end_where_the_pattern_ends_them(texts):
    data, bounds, units, points = fm.measured(pa.array(texts, pa.string()))
    assert data == "".join(texts).encode()
    want, at = [], 0
    for t in texts:
        for u in re.findall("[A-Za-z]+|[^A-Za-z]", t, re.DOTALL):
            at += len(u.encode())
            want.append(at)
    if want:
        assert units.after(np.arange(1, len(want) + 1)).tolist() == want
    assert units.before(np.arange(len(data) + 1)).tolist() == [sum(w <= k for w in want) for k in range(len(data) + 1)]
    assert np.diff(points.before(bounds)).tolist() == [len(t) for t in texts]


def test_every_form_is_used(docs):
    forms = {r["form"]: r["count"] for r in fm.fill_middle(docs).groupBy("form").count().collect()}
    assert set(forms) == {"plain", "psm", "spm"}
    assert {r["form"] for r in fm.fill_middle(docs, plain=0, suffix_first=100).where("n > 0").select("form").distinct().collect()} <= {"spm", "plain"}
