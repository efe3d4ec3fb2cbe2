"""Operator 7: secrets by pattern and by character Markov models.

Three patterns find assignments to names of secrets, access keys and long hexadecimal runs. Beside them, first-order
Markov models of characters, of random strings and of ordinary identifiers, score every other long token by the
log-likelihood ratio; tokens above the threshold are spans of the kind ``markov``. The pattern spans always stay.

The models are trained from labelled samples. Random strings are those of ``ALPHABETS``, drawn evenly, and the values that
the patterns match in the corpus; each alphabet has a model, and a token's ratio is that of the best one, as a
model of all of them together would take lower-case letters with digits for words. Ordinary are the names of Python's standard
library, joined to long ones in the usual ways, and the other tokens of the corpus. These aren't labelled and may be secrets that no pattern
knows, so a long one joins the class only if its ratio for each pair of characters is nearer to that of the names than to
that of the random strings (by medians).

A token's ratio for each pair of characters varies the less the longer it is, so the threshold has a part that falls with
the root of the length. Its level is set so that of the long ordinary tokens in the sample ``FALSE`` are spans. Tokens of
fewer than ``DISTINCT`` different characters (rulers, runs) and those of digits and separators alone (dates, numbers) are never
spans. UUIDs are as random as keys, but they name rows and requests: a token is scored without them, if enough of it is left.

The corpus sample are about ``SAMPLE`` rows by a hash of id and text; of their tokens at most ``TOKENS`` of each kind, by hash and
of at most ``LONGEST`` characters, reach the driver. That is the one bounded sample: the same on every run, whatever the ids.
Scanning covers every whole text.

Null texts are empty and have no spans. Spans are in code points, end exclusive, by start and then by kind in the order
of ``KINDS``. Repeated rows give repeated results, empty tables empty ones (the models then have the alphabets and names
alone); other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import builtins
import hashlib
import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from random import Random
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, own_names, parts, text_of

KINDS = ("assign", "access", "hex", "markov")
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]{12,}"),
    "hex": re.compile(r"[0-9a-f]{32,}"),
}
#: Words one of which every match of ``assign`` holds; a search for one costs less than the pattern.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_VALUE = 8
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: Names of rows and requests, whole or cut off behind their third group.
UUID = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}(?:-[0-9A-Fa-f]{4}(?:-[0-9A-Fa-f]{1,12})?)?(?![0-9A-Fa-f])")
NUMBERS = re.compile(r"[0-9+/_=-]*")
#: Characters of a token from which on it is scored.
LONG = 20
ORDINARY = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Alphabets in which random strings are written.
UPPER, LOWER, DIGITS = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
ALPHABETS = {
    "hexadecimal": DIGITS + LOWER[:6], "upper hexadecimal": DIGITS + UPPER[:6], "base32": UPPER + DIGITS[2:8], "lower and digits": LOWER + DIGITS, "upper and digits": UPPER + DIGITS,
    "letters": UPPER + LOWER, "base62": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
#: Modules of the standard library whose names are ordinary identifiers.
MODULES = ("argparse", "ast", "asyncio", "calendar", "collections", "concurrent.futures", "configparser", "csv", "datetime", "decimal", "email.message", "errno", "http.client", "http.server", "inspect", "io", "json", "logging.handlers", "multiprocessing", "os", "pathlib", "pickle", "random", "shutil", "signal", "smtplib", "socket", "sqlite3", "ssl", "statistics", "string", "subprocess", "tarfile", "tempfile", "threading", "traceback", "types", "typing", "unittest.mock", "urllib.request", "uuid", "xml.dom.minidom", "zipfile")
SAMPLE, TOKENS, LONGEST = 4000, 20_000, 400
#: Random strings drawn for each alphabet, and long names made of the library's.
DRAWN, JOINED = 400, 6000
#: Share of long ordinary tokens that are spans all the same.
FALSE = 0.001
DISTINCT = 7
#: Pairs that the share of single characters counts as.
PRIOR = 10.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's place, end, value) of the pattern matches."""
    found = []
    low = text.lower()
    if any(x in low for x in NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in PATTERNS["assign"].finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in PATTERNS["access"].finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in PATTERNS["hex"].finditer(text)]
    return sorted(found)


def library_names() -> list[str]:
    """Names of modules, classes, functions and their members."""
    import importlib

    names = set(sys.stdlib_module_names) | set(dir(builtins))
    for module in MODULES:
        for name, value in vars(importlib.import_module(module)).items():
            names.add(name)
            if isinstance(value, type):
                names.update(vars(value))
    return sorted(x for x in (n.strip("_") for n in names) if len(x) > 3 and set(x) <= set(ALPHABET))


def joined(names: list[str], n: int) -> list[str]:
    """Long identifiers of two to five names each, as code and addresses write them."""
    draw, out = Random(n), []
    parts = sorted({w for x in names for w in re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", x) if len(w) > 1})
    while names and len(out) < n:
        own = draw.choices(parts if draw.random() < 0.7 else names, k=draw.randrange(2, 6))
        if draw.random() < 0.3:
            own.append(str(draw.randrange(2030)))
        kind = draw.randrange(7)
        text = "".join(x[:1].upper() + x[1:] for x in own) if kind < 2 else ("_", "-", "/", "_", "")[kind - 2].join(own)
        text = text.upper() if kind == 5 else text.lower() if kind == 6 else text[:1].lower() + text[1:] if kind == 0 else text
        if len(text) >= 20:
            out.append(text)
    keyboard = ["qwertyuiopasdfghjklzxcvbnm", "QWERTYUIOPASDFGHJKLZXCVBNM", "qwertyuiop" * 2, "asdfghjkl" * 3, "zxcvbnm" * 3, "1qaz2wsx3edc4rfv5tgb6yhn"]
    runs = [*keyboard, UPPER, LOWER, DIGITS * 3, UPPER + LOWER + DIGITS, DIGITS + LOWER + UPPER, LOWER + DIGITS, UPPER + DIGITS]
    return out + runs * (n // 100)


def transitions(tokens: list[str], alphabet: str = ALPHABET) -> np.ndarray:
    """Log-probability of a character after another; rare pairs lean on how common the character is."""
    place = {c: k for k, c in enumerate(ALPHABET)}
    counts = np.zeros((len(ALPHABET), len(ALPHABET)))
    for pair, n in Counter(x[k : k + 2] for x in tokens for k in range(len(x) - 1)).items():
        counts[place[pair[0]], place[pair[1]]] += n
    own = np.array([c in alphabet for c in ALPHABET])
    share = (counts.sum(0) + np.where(own, 0.5, 0.005)) / (counts.sum() + np.where(own, 0.5, 0.005).sum())
    return np.log((counts + PRIOR * share) / (counts.sum(1, keepdims=True) + PRIOR))


class Markov:
    """The log-likelihood ratio of a token, random string against ordinary identifier, by pairs of characters."""

    def __init__(self, random: list[str], ordinary: list[str]):
        draw, names = Random(DRAWN), library_names()
        drawn = {k: ["".join(draw.choices(a, k=draw.randrange(20, 65))) for _ in range(DRAWN)] for k, a in ALPHABETS.items()}
        fit = lambda x: min((len(a), k) for k, a in ALPHABETS.items() if set(x) <= set(a) or len(a) == 64)[1]
        for x in random:
            if len(x) > 1 and len(set(x)) >= DISTINCT:
                drawn[fit(x)].append(x)
        self.random = np.stack([transitions(drawn[k], a) for k, a in ALPHABETS.items()])
        made = joined(names, JOINED)
        short = [x for x in ordinary if len(x) < 20]
        self.against(names + made + short)
        middle = (median(self.rate(x) for own in drawn.values() for x in own) + median(map(self.rate, made))) / 2
        long = [x for x in ordinary if len(x) >= 20 and self.rate(x) <= middle]
        self.against(names + made + short + long)
        levels = sorted(self.level(x) for x in made + long)
        self.least = levels[min(len(levels) - 1, int((1 - FALSE) * len(levels)))]

    def against(self, ordinary: list[str]) -> None:
        gains = self.random - transitions(ordinary)
        self.gains = [dict(zip((a + b for a in ALPHABET for b in ALPHABET), g.ravel().tolist(), strict=True)) for g in gains]
        self.spread = float(np.std([x for t in ordinary[:: max(1, len(ordinary) // 2000)] for x in self.steps(t)]))

    def steps(self, token: str) -> list[float]:
        """What each pair adds to the ratio, by the likeliest of the random models."""
        pairs = [token[k : k + 2] for k in range(len(token) - 1)]
        return max(([g.get(x, 0.0) for x in pairs] for g in self.gains), key=sum)

    def ratio(self, token: str) -> float:
        return sum(self.steps(token))

    def rate(self, token: str) -> float:
        return self.ratio(token) / max(1, len(token) - 1)

    def level(self, token: str) -> float:
        """The rate less what ordinary tokens of this length reach by chance."""
        return self.rate(token) - 2 * self.spread / math.sqrt(max(1, len(token) - 1))

    def secret(self, token: str) -> bool:
        token = UUID.sub("", token)
        if len(token) < LONG or NUMBERS.fullmatch(token):
            return False
        return len(set(token)) >= DISTINCT and self.level(token) > self.least


def train(df: DataFrame, sample: int = SAMPLE) -> Markov:
    """Models from the tokens of about ``sample`` rows."""
    order = F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, df.count() // sample)))
    keep = re.compile(f"[^{re.escape(ALPHABET)}]")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            found = {}
            for text in b.column(0):
                text = text.as_py()
                inside = [x[3] for x in base_spans(text)]
                found |= dict.fromkeys((True, x) for v in inside if len(x := keep.sub("", v)) <= LONGEST)
                found |= dict.fromkeys((False, x) for x in ORDINARY.findall(text) if len(x) <= LONGEST and not any(x in v or v in x for v in inside))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.bool_()), pa.array([x for _, x in found], pa.string())], ["random", "token"])

    tokens = df.where(order == 0).select(text_of().alias("text")).mapInArrow(cut, "random boolean, token string").distinct()
    chosen = [tokens.where(c).orderBy(F.xxhash64("token"), "token").limit(TOKENS) for c in ("random", "not random")]
    rows = chosen[0].union(chosen[1]).collect()  # TOKENS of each at most, of LONGEST characters
    return Markov(sorted(r["token"] for r in rows if r["random"]), sorted(r["token"] for r in rows if not r["random"]))


def spans(text: str, model: Markov) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of all spans; a token that touches a pattern span isn't scored."""
    base = [x[:3] for x in base_spans(text)]
    added = []
    for m in TOKEN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, _, b in base) and model.secret(m[0]):
            added.append((m.start(), 3, m.end()))
    return sorted(base + added)


def written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan(df: DataFrame, model: Markov) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of each row."""
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            columns: list[list] = [[] for _ in names[1:]]
            for text in b.column(1):
                found = spans(text.as_py(), model)
                base = written([x for x in found if x[1] < 3])
                row = [*(sum(x[1] == k for x in found) for k in range(4)), hashlib.sha256(base.encode()).hexdigest(), written(found)]
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(scanned, schema)


def hidden(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with ``mark`` in place of each run of spans that overlap."""
    out, at = [], 0
    for start, _, end in found:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: Markov, mark: str = "[secret]") -> DataFrame:
    """``df`` with every span of ``text`` replaced by ``mark``; n_chars, if there, follows. Texts without one aren't sent back."""
    (changed,) = own_names(df, "changed")

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        found = ((x, spans(x, model)) for x in (t.as_py() or "" for t in texts))
        out = pa.array([hidden(x, own, mark) if own else None for x, own in found], pa.string())
        give_back()
        return out

    out = df.withColumn(changed, cleaned("text"))
    columns = {"text": F.coalesce(changed, "text")}
    if "n_chars" in df.columns:
        columns["n_chars"] = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length(F.coalesce(changed, "text"))).cast(df.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in df.columns])


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = documents(spark, sf_dir)
    return scan(df, train(df))
