import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evokeline.llm import html_text, media, pieces, secret_scan, toxicity

PATH = public_tokenizers.path(pieces.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\nabé日<s>")), max_size=30))
def test_pieces_equal_the_library(text):
    ids, spans, decoded = pieces.model(PATH).encode(text)
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == LIBRARY.decode(want)
    data = text.encode()
    assert len(spans) == len(want) - 2
    if text:
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and (spans[1:, 0] == spans[:-1, 1]).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\nabé日<s>")), max_size=30), max_size=8))
def test_many_texts_as_one_by_one(texts):
    own = pieces.model(PATH)
    for got, text in zip(own.encode_all(pa.array(texts, pa.string())), texts, strict=True):
        want = own.encode(text)
        assert got[0] == want[0] and got[1].tolist() == want[1].tolist() and got[2] == want[2]


def test_spans_equal_the_library(docs):
    """The byte offsets of the library's own pieces."""
    own = pieces.model(PATH)
    for text in [r["text"] for r in docs.limit(60).collect()] + ["Ünïcödé 日本語 😀 ﬁ É", "a  b ▁ c", " lead"]:
        assert own.encode(text)[1].tolist() == [[p.begin, p.end] for p in LIBRARY.encode(text, return_type="proto").pieces]


def test_spans_lead_to_the_text():
    text = "The caffè  opens at 9"
    ids, spans, _ = pieces.model(PATH).encode(text)
    parts = [text.encode()[a:b].decode() for a, b in spans]
    assert "".join(parts) == text and parts[0] == "The"


def double_array(entries):
    """A compiled map of single-byte keys, laid out as the library lays it out."""
    texts, units = b"", [0] * 1024
    units[0] = 256 << 10
    for key, value in entries.items():
        node = 256 ^ key
        leaf = 512 ^ key  # each key's leaf has a place of its own
        units[node] = ((node ^ leaf) << 10) | 256 | key
        units[leaf] = (1 << 31) | len(texts)
        texts += value + b"\0"
    blob = np.array(units, "<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


def test_longest_prefix():
    table = pieces.CharacterMap(double_array({ord("A"): b"aa", ord("B"): b""}))
    assert table.longest(b"xA", 1) == (1, b"aa") and table.longest(b"B", 0) == (1, b"") and table.longest(b"C", 0) is None
    own = pieces.Pieces(PATH)
    own.map = table
    out, source = own.normalised("xA yB!")
    assert out.decode() == "▁xaa▁y!" and source[-1] == 6
    assert source.tolist() == [0, 0, 0, 0, 1, 1, 2, 2, 2, 3, 5, 6]


def test_piece_tables(docs, odd, none):
    for df in (docs, odd):
        want = []
        for r in df.collect():
            ids = LIBRARY.encode(r["text"] or "", add_bos=True, add_eos=True)
            want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
        got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.digests(df).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.digests(odd).count() == odd.count() and pieces.encode(none).count() == 0
    assert {r["doc_id"]: r["n_tokens"] for r in pieces.digests(odd).collect()}[1] == 2


def test_media_round_trip(odd, none):
    draw = random.Random(4)
    payloads = [media.payload(draw.randbytes(draw.choice([0, 1, 64, 4095, 4096, 4097, 30_000]))) for _ in range(30)] + [media.payload(b"\xff" * 700), media.payload(b"\0\xff" * 5000)]
    files = media.stored(payloads)
    assert [x for x, _ in media.read(files)] == payloads
    assert all(f[:4] == b"RIFF" and int.from_bytes(f[4:8], "little") == len(f) - 8 for f in files)
    rows = {r["doc_id"]: r for r in media.features(odd).collect()}
    assert rows[1]["payload_bytes"] == 64 and rows[3]["media_sha256"] == rows[4]["media_sha256"] and rows[5]["n_bytes"] == 150_000
    assert media.features(none).count() == 0 and media.clips(none).count() == 0
    clips = media.clips(odd).where("doc_id = 5").orderBy("clip").collect()
    assert clips[0]["start_s"] == 0 and all(a["end_frame"] == b["first_frame"] for a, b in zip(clips, clips[1:], strict=False))
    assert media.media(odd).where("media is null").count() == 0


def test_other_files(monkeypatch):
    """Frames with tables of their own are read side by side; frames of other kinds are refused."""
    import pytest

    payloads = [bytes(range(64)) * 3, b"abc" * 64, b"x" * 640]
    (first, second), other = media.stored(payloads[:2]), list(media.code_lengths())
    media.jpeg_head.cache_clear()
    monkeypatch.setattr(media, "code_lengths", lambda: [3, 3, 4, 4, 3, 3, 3, 3, 4])
    (third,) = media.stored(payloads[2:])
    monkeypatch.undo()
    media.jpeg_head.cache_clear()
    assert other == media.code_lengths() and [x for x, _ in media.read([first, third, second])] == [payloads[0], payloads[2], payloads[1]]
    for a, b in ((b"\xff\xc3", b"\xff\xc0"), (b"\xff\xdd\x00\x04\x00\x40", b"\xff\xdd\x00\x04\x00\x20")):
        with pytest.raises(ValueError, match="read"):
            media.read([first.replace(a, b)])


def test_features_by_hand(docs, odd):
    for df in (docs, odd):
        got = {(r["doc_id"], r["payload_sha256"]): r for r in media.features(df).collect()}
        for r in df.collect():
            data = (r["text"] or "").encode()
            padded = data + bytes(-len(data) % 64 or (0 if data else 64))
            row = got[r["doc_id"], hashlib.sha256(padded).hexdigest()]
            assert (row["n_bytes"], row["payload_bytes"], row["tail_crc32"]) == (len(data), len(padded), zlib.crc32(padded[-64:]))
            (film,) = media.stored([padded])
            assert (row["media_bytes"], row["media_sha256"]) == (len(film), hashlib.sha256(film).hexdigest())
            lines, (n, high) = len(padded) // 64, media.shape(len(padded) // 64)
            assert row["feature"].startswith(f"{n}x{high}:0.00-") and n * high >= lines and row["feature"].endswith(f"-{n / media.RATE:.2f}")


def test_shots():
    dark, light = np.full((6, 8, 64), 20, np.uint8), np.full((5, 8, 64), 200, np.uint8)
    assert media.shots(np.concatenate([dark, light])) == [(0, 6), (6, 11)]
    assert media.shots(dark[:1]) == [(0, 1)]


PAGE = '<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><div class="wrap"><article><h1>Title {k} &amp; more</h1><p>First\n  text {k}<br>goes on<p><b>Second</b> &eacute;t{k}<!-- x --><form><input> Send</form><div class="share">Share</div></article><aside>Side {k}</aside><section class="comments"><p>Nice {k}!</p></section></div><footer>&copy; {k}</footer>'


def test_pages(spark, none):
    rows = [(k, f"http://h.example/{k}", PAGE.replace("{k}", str(k))) for k in range(8)] + [(90, "x", None), (91, "http://one.example", "<p>plain <i>text</i></p>"), (92, None, "no markup & more"), (93, "http://h.example/z", "<div>" * 3000 + "deep"), (94, "http://h.example/y", "a < b <c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert len(got) == len(rows)
    for k in range(8):
        assert got[k]["text"] == f"Title {k} & more\nFirst text {k} goes on\nSecond ét{k}" and got[k]["n_chars"] == len(got[k]["text"])
    assert got[90]["text"] == "" and got[91]["text"] == "plain text" and got[92]["text"] == "no markup & more" and got[93]["text"] == "deep"
    assert html_text.extract(df.where("page_id < 0")).count() == 0


def test_pages_of_the_table(spark):
    import html

    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    for r in df.collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)


def tree(page):
    return html_text.Tree(html_text.parse(page))


def matched(a, b):
    """Simple tree matching, by its definition."""

    def score(x, y):
        if a.keys[x] != b.keys[y]:
            return 0
        c, d = a.children[x], b.children[y]
        best = [[0] * (len(d) + 1) for _ in range(len(c) + 1)]
        for i in range(len(c)):
            for k in range(len(d)):
                best[i + 1][k + 1] = max(best[i][k + 1], best[i + 1][k], best[i][k] + score(c[i], d[k]))
        return 1 + best[-1][-1]

    return score(0, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<div>", "</div>", "<ul>", "</ul>", "<p>", "x", "<div class=a>", "<section>", "</section>", "<li>"]), max_size=40), st.lists(st.sampled_from(["<div>", "</div>", "<ul>", "</ul>", "<p>", "x", "<div class=a>", "<section>", "</section>", "<li>"]), max_size=40))
def test_tree_matching(x, y):
    a, b = tree("".join(x)), tree("".join(y))
    m = html_text.Matching(a, b)
    pairs = m.pairs()
    assert m.score(a.shape[0], b.shape[0]) == len(pairs) == matched(a, b)
    partner = dict(pairs)
    assert len(set(partner.values())) == len(pairs) and all(a.keys[u] == b.keys[v] for u, v in pairs)
    assert all(u == 0 or partner[a.parent[u]] == b.parent[v] for u, v in pairs)
    assert [v for _, v in sorted(pairs)] == sorted(v for _, v in pairs)


def test_chain_scores_its_nodes():
    a = tree("<div><section><ul><table>x</table></ul></section></div>")
    m = html_text.Matching(a, a)
    assert m.score(a.shape[0], a.shape[0]) == 5 == len(m.pairs())


def neutral(k, long, body=""):
    """A page of a host whose names say nothing, with its main text."""
    draw = random.Random(k)
    words = lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))
    n = 60 if long else 3
    parts = [words(4), *(words(n) for _ in range(draw.randrange(1, 5))), words(n), words(n)]
    paragraphs = "".join(f"<p>{x}</p>" for x in parts[1:-2])
    page = '<html><body><div class="top"><a href=/>Home</a><a>Blog</a><a>Contact us</a></div><div class="left"><ul><li><a>One thing</a><li><a>Other thing</a></ul></div>'
    page += f'<div class="content"><h1>{parts[0]}</h1>{paragraphs}<div class="box"><p>We ship world wide.</p><p>Line two.</p><p>Line three</p></div><p class="social science">{parts[-2]}</p><div class="review-legal"><p>{parts[-1]}</p></div></div>'
    return page + '<div class="bottom">All rights reserved to nobody in particular, and to nobody else</div></body></html>', "\n".join(parts)


def test_pages_without_names_or_article(spark):
    pages = [neutral(k, k < 8) for k in range(16)]
    rows = [(k, f"http://{'long' if k < 8 else 'short'}.example/{k}", page) for k, (page, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 5):
        got = {r["page_id"]: r["text"] for r in html_text.extract(df.repartition(n)).collect()}
        assert [got[k] for k in range(16)] == [text for _, text in pages]


def test_copies_are_no_template(spark):
    """Copies of one article don't make it template, nor does one constant link make all links so."""
    article = lambda k: f"<h1>Title {k}</h1><div class=lead><p>Lead {k} with <a>a link {k}</a></p></div><p class=byline><a>Staff</a></p><section class=s>Body text number {k} goes on</section>"
    page = lambda k, n: f"<body><div class=x>Menu of the site</div><div class=y>{article(k)}</div><div class=z>Bottom {n}</div></body>"
    rows = [(n, "http://a.example/", page(k, n)) for n, k in enumerate([1, 1, 1, 2, 3, 4, 5])]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n, k in enumerate([1, 1, 1, 2, 3, 4, 5]):
        assert f"Lead {k} with a link {k}" in got[n] and f"Body text number {k} goes on" in got[n] and "Menu" not in got[n]


def numbered(k, name, tag="p", comments="comments-area"):
    """A post with its number in the classes, a paragraph named ``name``, and readers' comments."""
    draw = random.Random(k)
    words = lambda n: " ".join("".join(draw.choices("abcdefgh", k=5)) for _ in range(n))
    parts = [words(5), words(60), words(25), words(40)]
    inner = f'<h1>{parts[0]}</h1><p>{parts[1]}</p><{tag} class="{name}">{parts[2]}</{tag}><p>{parts[3]}</p>'
    said = "".join(f'<div class="c"><b>{words(1)}</b><p>{words(6)}</p></div>' for _ in range(draw.randrange(1, 4)))
    page = f'<html><body><div class="top">Home of all posts</div><article class="post-{17 * k} post"><div class="entry">{inner}</div></article><div class="{comments}">{said}</div><div class="bottom">All rights kept</div></body></html>'
    return page, "\n".join(parts)


def test_names_inside_an_article(spark):
    """Words of names take out nothing that says more than they do, and no paragraph; numbers of posts don't hide the wrapper."""
    more = ["share-price", "related work", "login-steps", "ad hoc", "menu of the day", "widget spec"]
    for tag, names in (("p", [*more, "comment", "side", "search", "notice"]), ("div", more)):
        rows, want = [], {}
        for h, name in enumerate(names):
            for k in range(6):
                page, want[h, k] = numbered(k, name, tag)
                rows.append((6 * h + k, f"http://h{h}.example/{k}", page))
        got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert {key: got[6 * key[0] + key[1]] for key in want} == want


def test_names_and_copies_of_columns(spark):
    """Columns that are named as the operator's own, and rows that repeat."""
    rows = [(k, "http://a.example/", neutral(k, True)[0], *["x"] * 6) for k in range(6)] + [(0, "http://a.example/", neutral(0, True)[0], *["x"] * 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, a string, b string, salt string, hot string, pages string")
    got = html_text.extract(df).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == sorted((k, neutral(k, True)[1]) for k in [*range(6), 0])


def test_deep_pages():
    for depth in (2, 300, 5000):
        page = "<div>x" * depth + "<nav>menu menu</nav>deep" + "</div>" * depth
        assert html_text.main_text(page, []).endswith("xdeep") and "menu" not in html_text.main_text(page, [])


def test_hot_hosts_without_broadcast(spark, monkeypatch):
    rows = [(k, "http://hot.example/" if k % 3 else None, neutral(k, False)[0]) for k in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    a = sorted(map(str, html_text.extract(df).collect()))
    monkeypatch.setattr(html_text, "BROADCAST", -1)
    monkeypatch.setattr(html_text, "SALTS", 4)
    assert a == sorted(map(str, html_text.extract(df).collect())) and len(a) == 30


def secrets_one_by_one(text):
    """The contract's base spans, by scanning with the patterns as they are written there."""
    found = []
    for kind, pattern, least in (
        (0, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
        (1, r"AKIA([A-Z0-9]+)", 12),
        (2, r"([0-9a-f]+)", 32),
    ):
        flags = re.IGNORECASE | re.ASCII if kind == 0 else re.ASCII
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text, flags) if len(m[2 if kind == 0 else 1]) >= least]
    return sorted(found)


def check_secrets(df, model):
    rows = sorted(secret_scan.scan(df, model).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["spans"]))
    texts = sorted((r["doc_id"] is None, r["doc_id"], r["text"] or "") for r in df.collect())
    assert len(rows) == len(texts)
    want = []
    for _, doc, text in texts:
        base = secrets_one_by_one(text)
        line = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((doc, *(sum(k == n for _, k, _ in base) for n in range(3)), hashlib.sha256(line.encode()).hexdigest(), line))
    got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"], ",".join(x for x in r["spans"].split(",") if not x.startswith("markov"))) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_secrets(spark, docs, odd, none):
    model = secret_scan.train(docs)
    check_secrets(docs, model)
    check_secrets(odd, model)
    found = {r["doc_id"]: r for r in secret_scan.scan(odd, secret_scan.train(odd)).collect()}
    assert found[8]["spans"] == "assign:2:28,access:30:50,hex:51:99" and found[1]["spans"] == ""
    clean = secret_scan.redact(odd, secret_scan.train(odd))
    assert clean.columns == odd.columns and clean.where("changed <> 'clash'").count() == 0
    clean = clean.where("doc_id = 8").first()
    assert clean["text"] == 'x [secret]" [secret] [secret]' and clean["n_chars"] == len(clean["text"])
    assert secret_scan.scan(none, secret_scan.train(none)).count() == 0
    assert secret_scan.base_spans("secret: token: abcdefghij") == [] and secret_scan.base_spans("to\u212aen=abcdefghij") == []


def test_toxicity(spark, odd, none):
    draw = random.Random(6)
    vocabulary = ["".join(draw.choices("abcdehilnorstu", k=draw.randrange(2, 9))) for _ in range(800)]

    def text(bad):
        words = draw.choices(vocabulary, k=draw.randrange(5, 120))
        return " ".join(words[:3] + ["zzbad" + draw.choice(["", "er", "ly"])] + words[3:]) if bad else " ".join(words)

    rows = [(k, text(k % 6 == 0), draw.choice(["en", "fr"])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 6 == 0)) for k, _, _ in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    out = toxicity.score(df, model).select("*", toxicity.held_out().alias("held")).collect()
    held = [r for r in out if r["held"]]
    right = [(r["toxic_score"] >= 0.3) == (r["doc_id"] % 6 == 0) for r in held]
    assert 150 < len(held) < 300 and sum(right) / len(right) > 0.95
    untrained = toxicity.fit([r[1] for r in rows if r[0] % 4], np.array([r[0] % 6 == 0 for r in rows if r[0] % 4], float), [r[2] for r in rows if r[0] % 4], epochs=0, steps=0)
    loss = lambda m: np.mean([np.log(max(1e-9, p if r[0] % 6 == 0 else 1 - p)) for r in rows if r[0] % 4 == 0 for p in [float(m.probabilities(toxicity.pooled(m, pa.array([r[1]])))[0])]])
    trained = toxicity.fit([r[1] for r in rows if r[0] % 4], np.array([r[0] % 6 == 0 for r in rows if r[0] % 4], float), [r[2] for r in rows if r[0] % 4])
    assert loss(trained) >= loss(untrained) - 0.02
    kept = {r["doc_id"] for r in toxicity.clean(df, model).collect()}
    assert sum(k % 6 == 0 for k in kept) < 15 and sum(k % 6 != 0 for k in kept) > 720
    scored = toxicity.score(odd, model)
    assert scored.where("toxic_score_ between 0 and 1 and toxic_score = 'clash'").count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.clean(odd, model).columns == odd.columns
    twice = df.union(df.select("doc_id", F.concat("text", F.lit(" more")).alias("text"), "lang"))
    first, again = toxicity.train(twice, labels), toxicity.train(twice.orderBy(F.rand(1)), labels)
    assert (first.out == again.out).all() and (first.embeddings == again.embeddings).all()
    flat = toxicity.train(df, labels.where("toxic = 0"))
    assert toxicity.score(df, flat).where("toxic_score > 0.01").count() == 0


def test_held_out_accuracy(spark):
    """Labelled rows that training doesn't see, of a given table: scores tell their labels apart, and better than the start does."""
    sf = "/root/testdata/sf0.1"
    df, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(df, labels)
    rows = toxicity.score(df.join(labels, "doc_id").where(toxicity.held_out()), model).select("toxic", "toxic_score").collect()
    toxic = [r["toxic_score"] for r in rows if r["toxic"]]
    clean = [r["toxic_score"] for r in rows if not r["toxic"]]
    hit, wrong = sum(s >= toxicity.CUT for s in toxic), sum(s >= toxicity.CUT for s in clean)
    assert len(toxic) > 100 and hit / len(toxic) >= 0.9 and hit / (hit + wrong) >= 0.93
    auc = np.mean([[(a > b) + (a == b) / 2 for b in clean] for a in toxic])
    assert auc > 0.96


def test_held_out_rule(spark):
    import zlib

    df = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h"))
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in df.collect())
