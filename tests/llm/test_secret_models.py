import random
import string

from evokeline.llm import secret_scan


def test_unlabelled_secrets_in_the_training_rows(spark):
    draw = random.Random(8)
    letters = string.ascii_letters + string.digits
    token = lambda n: "".join(draw.choices(letters, k=n))
    words = ["".join(draw.choice(x) for x in ("bdfglmnprst", "aeiou") * draw.randrange(2, 5)) for _ in range(300)]
    secrets = [token(n) for n in (24, 28, 32, 40, 64, 88, 400, 2000) for _ in range(3)]
    rows = [f'password = "{token(30)}" ' + " ".join(draw.choices(words, k=30)) for _ in range(150)]
    rows += [" ".join([*draw.choices(words, k=20), "_".join(draw.choices(words, k=5))]) for _ in range(150)]
    rows += [f"the token {x} " + " ".join(draw.choices(words, k=20)) for x in secrets]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    model = secret_scan.train(df)
    assert [x for x in secrets if x not in [r for t in rows for a, k, b in secret_scan.spans(t, model) if k == 3 for r in [t[a:b]]]] == []
    assert sum(k == 3 for t in rows for _, k, _ in secret_scan.spans(t, model)) == len(secrets)
    assert all("[secret]" in r["text"] for r in secret_scan.redact(df.where("doc_id >= 300"), model).collect())


LETTERS = string.ascii_letters + string.digits
WAYS = {"base62": LETTERS, "base64url": LETTERS + "-_", "lower": string.ascii_lowercase + string.digits, "base64": LETTERS + "+/", "base32": string.ascii_uppercase + "234567"}
ORDINARY = "getUserNameFromRequest internationalisation the_quick_brown_fox_jumps Content-Security-Policy-Report-Only AbstractSingletonProxyFactoryBean application/vnd/openxmlformats usr/local/lib/python3/dist-packages antidisestablishmentarianism MAX_CONNECTION_POOL_SIZE_DEFAULT src/main/java/com/example/service/UserServiceImpl Donaudampfschifffahrtsgesellschaft anticonstitutionnellement abcdefghijklmnopqrstuvwxyz".split()


def test_planted_tokens(docs):
    """Nine of ten tokens of each alphabet from 20 characters on are found; rulers and ordinary identifiers aren't."""
    model, draw = secret_scan.train(docs), random.Random(21)
    for letters in WAYS.values():
        for n in (20, 24, 40):
            tokens = ["".join(draw.choices(letters, k=n)) for _ in range(200)]
            assert sum(secret_scan.spans(f"see {t} here", model) == [(4, 3, 4 + n)] for t in tokens) >= 180
    for x in [*ORDINARY, "-" * 30, "=" * 64, "-=" * 20, "_" * 500, "0" * 40 + "x", "1234567890" * 3]:
        assert [k for _, k, _ in secret_scan.spans(f"see {x} here", model) if k == 3] == []


def test_sample_is_the_same_with_repeated_ids(spark):
    rows = [(None, f"text {k} with some Words{k % 7}OfLongNames{k}AndMore and token: abcdef{k:08x}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    models = [secret_scan.train(df.repartition(n), 40) for n in (1, 5)]
    assert models[0].least == models[1].least and (models[0].random == models[1].random).all()


def test_ordinary_tokens_stay(docs):
    """Of hundreds of identifiers that aren't secrets, UUIDs among them, one in a hundred is a span at most; a key behind a UUID is one."""
    import importlib
    import uuid

    model, draw = secret_scan.train(docs), random.Random(31)
    ids = [str(uuid.UUID(int=draw.getrandbits(128))) for _ in range(120)]
    tokens = ids + [x.upper() for x in ids[:30]] + [f"request_id={x}" for x in ids[:30]] + [x[:23] for x in ids[:30]] + [f"user/{x}/{y}" for x, y in zip(ids, ids[1:31], strict=False)]
    modules = ("ftplib", "imaplib", "optparse", "doctest", "pdb", "xmlrpc.client", "difflib", "tokenize", "locale")  # none that training takes names from
    names = sorted({n for m in modules for n in vars(importlib.import_module(m)) if len(n) > 5 and n.isascii()})
    while len(tokens) < 500:
        own = draw.choice("_-/").join(draw.choices(names, k=3))
        tokens += [own] * (len(own) >= 20)
    tokens += ["qwertyuiopasdfghjklzxcvbnm", "1234567890123456789012345", "2024-01-31/23-59-59_000123", "20240131235959000123"]
    wrong = [x for x in tokens if any(k == 3 for _, k, _ in secret_scan.spans(f"see {x} here", model))]
    assert len(wrong) <= len(tokens) // 100, wrong
    key = "".join(draw.choices(LETTERS, k=40))
    assert secret_scan.spans(f"{ids[0]}/{key}", model) == [(0, 3, 77)]
