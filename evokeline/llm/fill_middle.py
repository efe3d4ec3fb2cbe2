"""Operator 11: fill-in-the-middle texts, cut between units by arithmetic on words of eight bytes.

A unit is a run of ASCII letters or any other code point. The UTF-8 bytes of a batch's texts are viewed as unsigned 64-bit
words, and one bit a byte marks the last byte of each unit, found for eight bytes at once: a byte ends a unit if the next
one continues no code point and isn't a letter after a letter. ``bitwise_count`` gives the units of each word and their
running sum those before it, so the end of a text's k-th unit is found by a search of that sum for its word and by a
select inside the word (running byte sums by one multiplication, compared with k at once). Nothing loops over bytes,
units or cuts. The texts stay one behind another as Arrow holds them; the last byte of each is marked, as a text ends
its last unit whatever comes next. Code points are counted in the same way.

Where a text is cut and in which form it is written depend on its id's digest alone, so every run gives the same rows.
Repeated rows give repeated results. A null or empty text is plain, an id that is null counts as an empty one. Texts that
hold a marker are plain, so the markers of an output are those that were put there, and ``restored`` can rely on them.
There are no ties. Empty tables give empty ones; columns beside ``doc_id`` and ``text`` are ignored. A text is handled
whole, in slices of ``common.BYTES_AT_ONCE`` or one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
SEED = 1
#: Of a hundred texts without markers so many stay plain, and of the others so many name the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
ONE, SEVEN, EIGHT, FULL = (np.uint64(x) for x in (1, 7, 8, 56))


def each(byte: int) -> np.uint64:
    """A word of eight times the same byte."""
    return np.uint64(int(ONES) * byte)


def continues(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that goes on with a code point: its two highest bits are 1 and 0."""
    return words & ~(words << ONE) & HIGH


def letters(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is an ASCII letter; sums of seven bits never reach the next byte."""
    low = (words | each(0x20)) & LOW
    return (low + each(0x80 - 0x61)) & ~(low + each(0x80 - 0x7B)) & ~words & HIGH


def following(marks: np.ndarray) -> np.ndarray:
    """The marks of the next byte, at each byte's place; after the last word there are none."""
    out = marks >> EIGHT
    out[:-1] |= marks[1:] << FULL
    return out


class Ranked:
    """Marks in words of eight bytes, with how many there are up to the end of each word."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.cumsum(np.bitwise_count(marks), dtype=np.int64)

    def before(self, at: np.ndarray) -> np.ndarray:
        """How many marks stand before each byte."""
        word, inside = at >> 3, (at & 7).astype(np.uint64)
        padded = np.append(self.marks, np.uint64(0))
        under = padded[word] & ((ONE << (inside * EIGHT)) - ONE)
        return np.append(0, self.upto)[word] + np.bitwise_count(under)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The byte after the k-th mark, k from 1."""
        word = np.searchsorted(self.upto, k)
        inside = (k - (self.upto[word] - np.bitwise_count(self.marks[word]))).astype(np.uint64)
        running = (self.marks[word] >> SEVEN) * ONES  # byte j: the marks up to it
        reached = (running + (np.uint64(0x80) - inside) * ONES) & HIGH
        return 8 * word + 9 - np.bitwise_count(reached).astype(np.int64)


def measured(texts: pa.Array) -> tuple[bytes, np.ndarray, Ranked, Ranked]:
    """The bytes of texts one behind another, where each begins and the last ends, and the marks of units and of code points."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if pa.types.is_string(texts.type) else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b""
    bounds = offsets - offsets[0]
    words = np.frombuffer(data + bytes(-len(data) % 8), "<u8").astype(np.uint64)
    inner, own = continues(words), letters(words)
    ends = HIGH & ~following(inner) & ~(own & following(own))
    ends[len(data) // 8 :] &= (ONE << np.uint64(8 * (len(data) % 8))) - ONE  # not the padding
    last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * EIGHT))
    starts = HIGH & ~inner
    starts[len(data) // 8 :] &= (ONE << np.uint64(8 * (len(data) % 8))) - ONE
    return data, bounds, Ranked(ends), Ranked(starts)


def draws(ids: pa.Array, seed: int) -> np.ndarray:
    """The four numbers of each id: the first digit groups of its digest."""
    digests = (hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).digest()[:16] for x in ids.to_pylist())
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def fill_middle(df: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output of each row."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            data, bounds, units, points = measured(b.column(1))
            h = draws(b.column(0), seed)
            before = units.before(bounds)
            n = np.diff(before)
            cuts = np.sort(np.stack([h[:, 0] % (n + 1), h[:, 1] % (n + 1)]), axis=0)
            ends = np.where(cuts > 0, units.after(np.maximum(1, before[:-1] + cuts)) if len(data) else 0, bounds[:-1])
            marked = pc.match_substring_regex(b.column(1), MARKER).to_numpy(zero_copy_only=False)
            is_plain = (n == 0) | marked | (h[:, 2] % 100 >= 100 - plain)
            form = np.where(is_plain, "plain", np.where(h[:, 3] % 100 < suffix_first, "spm", "psm"))
            chars = np.diff(points.before(np.stack([bounds[:-1], *ends])), axis=0)
            out = []
            for kind, start, one, two, end in zip(form.tolist(), bounds[:-1].tolist(), *ends.tolist(), bounds[1:].tolist(), strict=True):
                if kind == "plain":
                    out.append(data[start:end])
                elif kind == "psm":
                    out.append(b"".join((p, data[start:one], s, data[two:end], m, data[one:two])))
                else:
                    out.append(b"".join((s, data[two:end], p, data[start:one], m, data[one:two])))
            count = lambda x: pa.array(x, pa.int64(), mask=is_plain)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), count(chars[0]), count(chars[1]), pa.array(out, pa.binary()).cast(pa.string())], names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(written, schema)


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text of an output, in its first order and without markers."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))
    pieces = F.split(output, MARKER, -1)
    one, two, three = (F.get(pieces, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(documents(spark, sf_dir))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{SEED}:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
 d AS (SELECT *, len(u) AS n, cast('0x' || h[1:8] AS BIGINT) AS h1, cast('0x' || h[9:16] AS BIGINT) AS h2, cast('0x' || h[17:24] AS BIGINT) AS h3, cast('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM d),
 p AS (SELECT *, CASE WHEN a = 0 THEN '' ELSE array_to_string(u[1:a], '') END AS pre, CASE WHEN a = b THEN '' ELSE array_to_string(u[a + 1:b], '') END AS mid, CASE WHEN b = n THEN '' ELSE array_to_string(u[b + 1:n], '') END AS suf FROM c)
SELECT doc_id, cast(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN cast(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
