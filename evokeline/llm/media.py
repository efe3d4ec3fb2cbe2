"""Operator 10: AVI motion-JPEG columns.

``stored`` turns bytes into an AVI file of lossless JPEG frames (SOF3, 8-bit samples, first predictor): the bytes, with
zeros up to a multiple of 64, are the samples of a film 64 samples wide; each line is a restart interval. ``read`` walks
the RIFF chunks, finds the frames through the index, decodes them and gives the samples back, bit for bit. Frames of a
file have the same height, so the last may end with lines of zeros; the number of samples stands in the stream's data.

Restart intervals are independent, so all lines of a batch are coded and decoded side by side, one sample of each at a
time, by numpy. Huffman codes have three or four bits, by a rule on the number of the category.

``shots`` compares the histograms of consecutive frames. A cut is where the difference exceeds the mean of the
differences since the last cut by ``SPREAD`` standard deviations and a least amount; between cuts lie the clips, rows
with frames and seconds.

Null and empty texts are one line of zeros. Equal texts give equal files. Repeated rows give repeated results, empty
tables empty ones; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, text_of

WIDTH = 64
HEIGHT = 64
RATE = 25
BINS = 16
SPREAD, LEAST = 2.0, 0.25
#: Lines that are coded at once.
LINES = 1 << 14


def code_lengths() -> list[int]:
    """Bits of the code of each category 0 to 8: four for 0, 1 and 8, which are rare, else three."""
    return [4 if k < 2 or k == 8 else 3 for k in range(9)]


@lru_cache(maxsize=8)
def codes(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Canonical codes: (code, bits) by category, (category, bits) by the next four bits of the stream."""
    code, by_value, bits = 0, np.zeros(17, np.int64), np.zeros(17, np.int64)
    category, length, at = np.zeros(16, np.int64), np.full(16, 4, np.int64), 0
    for n, count in enumerate(counts[:4], 1):
        for v in values[at : at + count]:
            by_value[v], bits[v] = code, n
            category[code << (4 - n) : (code + 1) << (4 - n)] = v
            length[code << (4 - n) : (code + 1) << (4 - n)] = n
            code += 1
        at += count
        code <<= 1
    return by_value, bits, category, length


def table() -> tuple[bytes, bytes]:
    """Counts by length and categories by code, as a DHT segment has them."""
    own = code_lengths()
    return bytes([sum(x == n for x in own) for n in range(1, 17)]), bytes(sorted(range(9), key=lambda k: (own[k], k)))


def scans(samples: np.ndarray, heights: np.ndarray) -> list[bytes]:
    """The coded lines of each frame; ``samples``: lines x 64, ``heights``: lines of each frame."""
    by_value, bits, _, _ = codes(*table())
    lines = len(samples)
    x = samples.astype(np.int64)
    diff = np.diff(x, axis=1, prepend=128)
    size = np.zeros(513, np.int64)
    size[1:] = np.floor(np.log2(np.arange(1, 513))) + 1
    s = size[np.abs(diff)]
    value = (by_value[s] << s) | np.where(diff >= 0, diff, diff + (1 << s) - 1)
    n = bits[s] + s
    for _ in range(2):  # pairs, then fours: 48 bits at most
        value, n = (value[:, ::2] << n[:, 1::2]) | value[:, 1::2], n[:, ::2] + n[:, 1::2]
    ends = np.cumsum(n, axis=1)
    pad = -ends[:, -1] % 8
    value[:, -1] = (value[:, -1] << pad) | ((1 << pad) - 1)
    n[:, -1] += pad
    ends[:, -1] += pad
    length = ends[:, -1] // 8
    first = np.cumsum(length) - length
    start = first[:, None] * 8 + ends - n
    value = value << (56 - start % 8 - n)
    out = np.zeros(int(length.sum()) + 8)
    for k in range(7):
        out += np.bincount((start // 8 + k).ravel(), (value >> (48 - 8 * k) & 255).ravel(), len(out))
    data = out[: int(length.sum())].astype(np.uint8)
    stuffed = (data == 255).astype(np.int64)
    line_of = np.repeat(np.arange(lines), length)
    frame_of = np.repeat(np.arange(len(heights)), heights)
    tops = np.cumsum(heights) - heights
    in_frame = np.arange(lines) - tops[frame_of]
    marked = in_frame < heights[frame_of] - 1  # a marker follows
    whole = length + np.bincount(line_of, stuffed, lines).astype(np.int64) + 2 * marked
    begin = np.cumsum(whole) - whole
    before = np.cumsum(stuffed) - stuffed
    at = np.arange(len(data)) + before + 2 * (np.cumsum(marked) - marked)[line_of]
    final = np.zeros(int(whole.sum()), np.uint8)
    final[at] = data
    after = (begin + whole)[marked]
    final[after - 2], final[after - 1] = 255, 0xD0 + in_frame[marked] % 8
    blob, ends = final.tobytes(), np.append(begin, len(final))
    return [blob[ends[t] : ends[t + h]] for t, h in zip(tops, heights, strict=True)]


def unscanned(parts: list[bytes], tables: tuple[bytes, bytes], lines: int) -> np.ndarray:
    """The samples (lines x 64) of coded frames that share their tables."""
    _, _, category, bits = codes(*tables)
    data = np.frombuffer(b"".join(x + b"\xff\xd9" for x in parts), np.uint8)
    flag = data[:-1] == 255
    after = data[1:]
    marker = np.flatnonzero(flag & (after >= 0xD0) & (after <= 0xD9))
    drop = np.zeros(len(data), bool)
    drop[marker] = drop[marker + 1] = True
    drop[1:] |= flag & (after == 0)
    kept = np.cumsum(~drop)
    clean = np.concatenate([data[~drop], np.zeros(4, np.uint8)]).astype(np.int64)
    position = np.concatenate([[0], kept[marker[:-1] + 1]]) * 8 if len(marker) else np.zeros(0, np.int64)
    if len(position) != lines:
        raise ValueError(f"{lines} lines were expected, {len(position)} are there")
    diff = np.zeros((lines, WIDTH), np.int64)
    window = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    for k in range(WIDTH):
        w = (window[position >> 3] << (position & 7)) & 0xFFFFFF
        s = category[w >> 20]
        used = bits[w >> 20] + s
        extra = (w >> (24 - used)) & ((1 << s) - 1)
        diff[:, k] = np.where((s > 0) & (extra < (1 << np.maximum(s - 1, 0))), extra - (1 << s) + 1, extra)
        position += used
    return (128 + np.cumsum(diff, axis=1)).astype(np.uint8)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


@lru_cache(maxsize=256)
def jpeg_head(height: int) -> bytes:
    counts, values = table()
    return b"\xff\xd8" + segment(0xC3, struct.pack(">BHHBBBB", 8, height, WIDTH, 1, 1, 0x11, 0)) + segment(0xC4, b"\0" + counts + values) + segment(0xDD, struct.pack(">H", WIDTH)) + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def film(frames: list[bytes], height: int, n_samples: int) -> bytes:
    """An AVI file of JPEG frames."""
    n = len(frames)
    most = max(map(len, frames))
    head = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, WIDTH, height, 0, 0, 0, 0)
    stream = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    picture = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", head) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", picture) + chunk(b"strd", struct.pack("<Q", n_samples))))
    chunks = [chunk(b"00dc", x) for x in frames]
    at, index = 4, []
    for x, c in zip(frames, chunks, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(x)))
        at += len(c)
    body = b"AVI " + header + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", body)


def shape(lines: int) -> tuple[int, int]:
    """Frames and their height for so many lines."""
    n = -(-lines // HEIGHT)
    return n, -(-lines // n)


def stored(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of 64."""
    shapes = [shape(len(p) // WIDTH) for p in payloads]
    padded = b"".join(p + bytes(n * h * WIDTH - len(p)) for p, (n, h) in zip(payloads, shapes, strict=True))
    samples = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    coded = iter(scans(samples, np.repeat([h for _, h in shapes], [n for n, _ in shapes])))
    return [film([jpeg_head(h) + next(coded) + b"\xff\xd9" for _ in range(n)], h, len(p)) for p, (n, h) in zip(payloads, shapes, strict=True)]


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, first byte, end) of the chunks between two places."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield name, start + 8, min(start + 8 + size, end)
        start += 8 + size + size % 2


def frames_of(data: bytes) -> tuple[list[bytes], int]:
    """The frames that the index of an AVI file names, and the number of samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, n_samples = 0, b"", 0
    todo = [(12, len(data))]
    while todo:
        for name, first, end in chunks(data, *todo.pop()):
            if name == b"LIST":
                if data[first : first + 4] == b"movi":
                    movi = first
                else:
                    todo.append((first + 4, end))
            elif name == b"strd":
                n_samples = struct.unpack_from("<Q", data, first)[0]
            elif name == b"idx1":
                index = data[first:end]
    return [data[movi + at + 8 : movi + at + 8 + size] for _, _, at, size in struct.iter_unpack("<4sIII", index)], n_samples


def scan_of(frame: bytes) -> tuple[int, tuple[bytes, bytes], bytes]:
    """Height, Huffman table and coded lines of a lossless JPEG frame; frames of another kind than ``film`` takes are refused."""
    at, height, restart, tables = 2, 0, 0, (b"", b"")
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC3:
            bits, height, width, parts = struct.unpack_from(">BHHB", body)
            if (bits, width, parts) != (8, WIDTH, 1):
                raise ValueError(f"frames of {WIDTH} samples a line, of 8 bits and one component, are read")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC4:
            raise ValueError("only lossless frames (SOF3) are read")
        elif marker == 0xC4:
            tables = (body[1:17], body[17:])
            if any(tables[0][4:]):
                raise ValueError("codes of up to four bits are read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if restart != WIDTH or body[3] != 1:
                raise ValueError("lines that are restart intervals of the first predictor are read")
            return height, tables, frame[at:-2]


def read(files: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """Of each AVI file the stored bytes, and its frames (frame x line x sample). Every frame has its own Huffman table."""
    found = [frames_of(x) for x in files]
    parts = [scan_of(f) for frames, _ in found for f in frames]
    lines: list[np.ndarray] = [np.zeros((0, WIDTH), np.uint8)] * len(parts)
    for tables in dict.fromkeys(p[1] for p in parts):
        own = [k for k, p in enumerate(parts) if p[1] == tables]
        samples = unscanned([parts[k][2] for k in own], tables, sum(parts[k][0] for k in own))
        for k, x in zip(own, np.split(samples, np.cumsum([parts[k][0] for k in own])[:-1]), strict=True):
            lines[k] = x
    out, at = [], 0
    for frames, n in found:
        own = np.stack(lines[at : at + len(frames)]) if frames else np.zeros((0, 0, WIDTH), np.uint8)
        out.append((own.tobytes()[:n], own))
        at += len(frames)
    return out


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, end) of the clips between cuts."""
    n = len(frames)
    flat = (frames.reshape(n, -1) >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    share = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / max(1, flat.shape[1])
    change = np.abs(np.diff(share, axis=0)).sum(1)
    cuts, since = [0], []
    for k, x in enumerate(change, 1):
        if x > LEAST and (len(since) < 2 or x > np.mean(since) + SPREAD * np.std(since)):
            cuts.append(k)
            since = []
        else:
            since.append(x)
    return list(zip(cuts, [*cuts[1:], n], strict=True))


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH or (WIDTH if not text else 0))


def _blocks(b: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of some rows, about LINES lines or one row."""
    ids, texts, lines = [], [], 0
    for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
        data = text.as_py().encode()
        if texts and lines + len(data) // WIDTH > LINES:
            yield ids, texts
            ids, texts, lines = [], [], 0
        ids.append(doc)
        texts.append(data)
        lines += len(data) // WIDTH + 1
    if texts:
        yield ids, texts


def _mapped(df: DataFrame, schema: str, kinds: list, rows) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            for ids, texts in _blocks(b):
                out = [(doc, *row) for doc, each in zip(ids, rows(texts), strict=True) for row in each]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(made, schema)


def media(df: DataFrame) -> DataFrame:
    """doc_id, media: each text as an AVI file."""
    return _mapped(df, "doc_id long, media binary", [pa.int64(), pa.binary()], lambda texts: [[(x,)] for x in stored([payload(t) for t in texts])])


def clips(df: DataFrame) -> DataFrame:
    """doc_id, clip, first_frame, end_frame, start_s, end_s: the timed clips of each text's film."""

    def rows(texts: list[bytes]) -> list[list[tuple]]:
        return [[(k, a, z, a / RATE, z / RATE) for k, (a, z) in enumerate(shots(frames))] for _, frames in read(stored([payload(t) for t in texts]))]

    schema = "doc_id long, clip int, first_frame long, end_frame long, start_s double, end_s double"
    return _mapped(df, schema, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], rows)


def features(df: DataFrame) -> DataFrame:
    """The columns of the query: sizes and digests of what is stored and of what is read back, and the clips as text."""

    def rows(texts: list[bytes]) -> list[list[tuple]]:
        files = stored([payload(t) for t in texts])
        out = []
        for text, data, (back, frames) in zip(texts, files, read(files), strict=True):
            said = f"{len(frames)}x{frames.shape[1]}:" + ",".join(f"{a / RATE:.2f}-{z / RATE:.2f}" for a, z in shots(frames))
            out.append([(len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), said)])
        return out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return _mapped(df, schema, kinds, rows)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(documents(spark, sf_dir))
