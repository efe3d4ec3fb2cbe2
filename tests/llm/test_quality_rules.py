import base64
import random
import re

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from evokeline.llm import quality_rules as qr

WORD = "[^\x20\x09-\x0d]+"


def base(text):
    """The counts of a text, plainly."""
    words = re.findall(WORD, text)
    lines, seen, twice = text.split("\n"), set(), 0
    for x in lines:
        twice += bool(re.search(WORD, x)) and x in seen
        seen.add(x)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    places = {}
    for k, w in enumerate(windows):
        places.setdefault(w, []).append(k)
    again = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(again)


def row(text):
    own = base(text)
    failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
    data, pack = text.encode(), zstandard.ZstdCompressor(level=3)

    def side(part):
        low, high = [(a, b) for start, a, b in qr.BANDS if len(part) >= start][-1]
        r = len(pack.compress(part)) / len(part)
        return -1 if r < low else int(r > high)

    bad = bool(data) and side(data) != 0
    cuts = [k for k in range(0, max(1, len(data)), 2048) if k == 0 or len(data) - k >= 512]
    parts = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
    if len(parts) > 1:
        bad = bad or sum(len(x) for x in parts if side(x)) > 0.25 * len(data)
    return (*own, failed, not failed and not bad)


def check(df):
    got = [(r["doc_id"], *(r[c] for c in (*qr.NAMES, "base_failed", "kept"))) for r in qr.judged(df).collect()]
    want = [(r["doc_id"], *row(r["text"] or "")) for r in df.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert qr.passing(df).columns == df.columns
    assert qr.passing(df).count() == sum(x[-1] for x in got)


def test_tables(docs, odd, none):
    check(docs)
    check(odd)
    assert qr.judged(none).collect() == [] and qr.passing(none).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab é日\t\n\x0b\x85 #|"), max_size=60))
def test_counts(text):
    assert qr.counts(text) == base(text)


def prose(n, draw):
    """Sentences of words that follow Zipf's law, with figures and names between them."""
    stems = ["".join(draw.choices("aeioulnrstdcmpbghvfk", k=draw.randrange(2, 9))) for _ in range(4000)]
    out = []
    while sum(map(len, out)) + len(out) < n:
        own = [stems[min(len(stems) - 1, int(draw.paretovariate(0.7)) - 1)] for _ in range(draw.randrange(5, 20))]
        out.append(own[0].capitalize() + " " + " ".join(own[1:]) + draw.choice([". ", ".\n", ", " + str(draw.randrange(3000)) + ". "]))
    return "".join(out)


def test_language_stays_and_the_rest_goes():
    draw, pack = random.Random(8), zstandard.ZstdCompressor(level=3)
    why = lambda t: qr.compressed(t, pack)[3]
    for n in (250, 700, 1500, 4000, 9000, 30_000, 120_000):
        text = prose(n, draw)
        assert why(text) == "", (n, qr.compressed(text, pack))
        secret = base64.b64encode(draw.randbytes(n)).decode()
        coded = " ".join(secret[k : k + 9] for k in range(0, len(secret), 9))
        if n >= 1500:
            assert why(coded) == "incompressible", (n, qr.compressed(coded, pack))
        if n >= 9000:
            assert why(text + coded[: len(text)]) == "incompressible"
        template = "".join(f"Row {k} of the table has no entry.\n" for k in range(n // 30))
        if n >= 700:
            assert why(template) == "repetitive", (n, qr.compressed(template, pack))
            if n >= 9000:
                assert why(text + template) == "repetitive"
    assert why("") == ""
