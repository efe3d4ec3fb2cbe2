"""Operator 12: rules of quality, by counts of words and by bands of compression.

Counts say whether a text has enough words and doesn't say the same thing again and again (``base_failed``). Beside them,
zstandard compresses the whole UTF-8 text and each chunk of ``CHUNK`` bytes. The ratio of compressed to plain bytes is low
for text that repeats itself in ways that windows of words don't show (long templates, runs without spaces) and high for
text that isn't language (keys, encoded files). How much language compresses depends on how much of it there is, so
``BANDS`` has the limits by length, of whole texts and of chunks alike: they are wide, for languages and scripts of every
kind. A text is rejected if its own ratio is outside its band or if chunks with more than ``SHARE`` of its bytes are outside
theirs; a chunk at the end that is shorter than ``LEAST`` bytes belongs to the one before it. Texts of one chunk
have nothing but the whole.

Each row is judged by itself, so ties and repeated rows give equal results. A null or empty text has no words and fails.
Empty tables give empty ones. ``judged`` ignores columns beside ``doc_id`` and ``text``, ``passing`` keeps them, whatever
their names. Texts of any length are compressed whole, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, give_back, own_names, parts, text_of

#: From so many bytes on: the least and the greatest ratio that language has.
BANDS = ((0, 0.35, 1.10), (256, 0.30, 0.85), (1024, 0.25, 0.72), (4096, 0.20, 0.64), (16384, 0.15, 0.58))
LEVEL, CHUNK, LEAST, SHARE = 3, 2048, 512, 0.25
#: The least number of words, and the greatest share of them in windows that come again.
WORDS, REPEATED = 50, 0.5

WHITE, SYMBOLS = b"\t\n\x0b\x0c\r ", b"#*$%&|<>"
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Sequence[bytes], size: int = 3) -> int:
    """How many words stand in a window of ``size`` words that is found twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    own = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    window = own[:n]
    for k in range(1, size):  # numbers of windows so far, so the products stay small
        window = np.unique(window * len(ids) + own[k : k + n], return_inverse=True)[1]
    again = np.bincount(window)[window] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[size : size + n] -= again
    return int(np.count_nonzero(np.cumsum(edges)))


def counts(text: str) -> tuple[int, ...]:
    """``NAMES`` of a text."""
    data = text.encode()
    words = data.split()  # at the same bytes: space and 9 to 13
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(words), len(text) - len(data) + len(data.translate(None, WHITE)), len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def outside(n: int, ratio: float, bands: Sequence[tuple[int, float, float]] = BANDS) -> int:
    """-1 for a text of ``n`` bytes that repeats itself, 1 for one that isn't language, 0 for one in its band."""
    least, most = next((a, b) for start, a, b in reversed(bands) if n >= start)
    return -1 if ratio < least else int(ratio > most)


def compressed(text: str, packer: zstandard.ZstdCompressor, chunk: int = CHUNK, bands: Sequence[tuple[int, float, float]] = BANDS, share: float = SHARE) -> tuple[float, int, int, str]:
    """The whole text's ratio, the bytes of chunks below and above their band, and why the text is rejected, if it is."""
    data = memoryview(text.encode())
    if not data:
        return 0.0, 0, 0, ""
    ratio = lambda part: len(packer.compress(part)) / len(part)
    whole = ratio(data)
    side, low, high = outside(len(data), whole, bands), 0, 0
    starts = list(range(0, max(1, len(data) - LEAST + 1), chunk))
    if len(starts) > 1:
        for a, b in zip(starts, [*starts[1:], len(data)], strict=True):
            own = outside(b - a, ratio(data[a:b]), bands)
            low, high = low + (b - a) * (own < 0), high + (b - a) * (own > 0)
    bound = share * len(data)
    return whole, low, high, "repetitive" if side < 0 or low > bound else "incompressible" if side > 0 or high > bound else "mixed" if low + high > bound else ""


def judged(df: DataFrame, level: int = LEVEL, chunk: int = CHUNK, bands: Sequence[tuple[int, float, float]] = BANDS, share: float = SHARE) -> DataFrame:
    """doc_id, ``NAMES``, base_failed, ratio, low_bytes, high_bytes (of chunks outside their band), reason, kept of each row."""
    names = ["doc_id", *NAMES, "base_failed", "ratio", "low_bytes", "high_bytes", "reason", "kept"]

    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level)
        for b in parts(batches):
            rows = []
            for text in b.column(1):
                text = text.as_py()
                own = counts(text)
                failed = own[0] < WORDS or own[4] > REPEATED * own[0]
                ratio, low, high, reason = compressed(text, packer, chunk, bands, share)
                rows.append((*own, failed, ratio, low, high, reason, not failed and not reason))
            kinds = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in NAMES) + ", base_failed boolean, ratio double, low_bytes long, high_bytes long, reason string, kept boolean"
    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(ruled, schema)


def passing(df: DataFrame, level: int = LEVEL, chunk: int = CHUNK, bands: Sequence[tuple[int, float, float]] = BANDS, share: float = SHARE) -> DataFrame:
    """The rows of ``df`` that pass all rules, as they are."""
    (kept,) = own_names(df, "kept")

    @F.arrow_udf("boolean")
    def passes(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=level)
        out = []
        for text in texts:
            text = text.as_py() or ""
            own = counts(text)
            good = own[0] >= WORDS and own[4] <= REPEATED * own[0]
            out.append(good and not compressed(text, packer, chunk, bands, share)[3])
        give_back()
        return pa.array(out, pa.bool_())

    return df.withColumn(kept, passes("text")).where(kept).drop(kept)


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", *NAMES, "base_failed", "kept", "ratio", "reason")
