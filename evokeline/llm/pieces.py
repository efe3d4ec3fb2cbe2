"""Operator 8: SentencePiece encoding that keeps offsets, and decoding.

A text is normalised by the model's compiled character map: at each place the longest prefix that the map's trie holds
is replaced, else one character is copied; the source byte of every normalised byte is recorded. Spaces become the
model's space mark, with one more at the start if the model asks for it. The pieces of the normalised text have byte
lengths, and their running sums lead through the recorded alignment back to byte spans of the original text.

Where no piece of the vocabulary continues beyond a space mark (checked when the model is loaded), the merges never
cross from one word to the next, so a text's pieces are its words' pieces one after another. Each Python worker keeps
the ids, lengths and surface of the words it saw lately; words that it lacks go through the library. Models without this
property are encoded text by text.

Null and empty texts have the begin and end ids only and decode to the empty text. A character outside the vocabulary
becomes one piece for each of its bytes, of which the first spans the character; in models without pieces for bytes it is
the unknown piece, which spans all such characters in a row. Repeated rows give repeated results,
empty tables empty ones; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, parts, text_of
from .tokens import RecentWords

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of words that a task keeps.
WORDS = 64 << 20


class CharacterMap:
    """The trie of a compiled map: a double array of 32-bit units, then the replacements, each with a zero at its end."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = array("I", blob[4 : 4 + n])
        self.texts = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The length of the longest prefix at ``at`` that the map holds, and its replacement."""
        if not self.units:
            return None
        found, node = None, 0
        step = lambda unit: (unit >> 10) << ((unit & 512) >> 6)
        node = step(self.units[0])
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[k]:
                break
            unit = self.units[node]
            node ^= step(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = (k + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found


class Pieces:
    """A model with what its words' pieces are."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        mark = SPACE.encode()
        self.bytes_of = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.encode() for p in proto.pieces]
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        by_word = self.prefix and self.escape and not self.squeeze and not any(crossing.search(p.piece) for p in proto.pieces)
        self.by_word = by_word and not self.map.units and any(p.type == 6 for p in proto.pieces)
        self.unknown = self.library.unk_id()
        self.mark = self.library.piece_to_id(SPACE)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.word_mark = mark
        self.words = RecentWords(self.word, WORDS, lambda x: 200 + sum(map(len, x)))

    def normalised(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised text and, for each of its bytes and for its end, the byte of ``text`` it comes from."""
        data, mark = text.encode(), self.word_mark if self.escape else b" "
        if not data:
            return b"", np.zeros(1, np.int64)
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            source = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(mark), 1))
            out = data.replace(b" ", mark)
        else:
            parts, places, at = [], [], 0
            while at < len(data):
                n, new = self.map.longest(data, at) or (0, b"")
                if not n:
                    n = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                    new = data[at : at + n]
                for byte in re.findall(rb"[ ]|[^ ]+", new):
                    if byte == b" " and self.squeeze and (not parts or parts[-1] == mark):
                        continue
                    parts.append(mark if byte == b" " else byte)
                    places += [at] * len(parts[-1])
                at += n
            while self.squeeze and parts and parts[-1] == mark:
                del places[len(places) - len(parts.pop()) :]
            out, source = b"".join(parts), np.array(places, np.int64)
        if self.prefix and out:
            out, source = mark + out, np.concatenate([np.zeros(len(mark), np.int64), source])
        return out, np.append(source, len(data))

    def word(self, word: str) -> tuple[bytes, bytes, bytes]:
        """Ids, lengths in normalised bytes and surface of a word behind a space mark."""
        return self.packed([self.mark] if not word else self.library.encode(word))

    def packed(self, ids: list[int], text: str = "") -> tuple[bytes, bytes, bytes]:
        """As ``word``; an unknown piece stands for what ``text`` has in its place, be it one character or more."""
        if self.unknown in ids:
            parts = [p.piece.encode() for p in self.library.encode(text, return_type="proto").pieces]
        else:
            parts = [self.bytes_of[k] for k in ids]
        return array("I", ids).tobytes(), array("I", map(len, parts)).tobytes(), b"".join(parts).replace(self.word_mark, b" ")

    def encode(self, text: str) -> tuple[bytes, np.ndarray, bytes]:
        """Ids with begin and end ids, byte spans of the pieces between them, and the decoded text."""
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        if not text:
            return begin + end, np.zeros((0, 2), np.int64), b""
        source = self.normalised(text)[1]
        if not self.by_word:
            own = [self.packed(self.library.encode(text), text)]
        elif SPACE in text or "  " in text or text[0] == " ":
            own = [self.words[x[1:]] for x in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
        else:
            own = list(map(self.words.__getitem__, text.split(" ")))
        self.words.trim()
        ids, lengths, surface = (b"".join(x) for x in zip(*own, strict=True))
        bounds = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.uint32).astype(np.int64))])
        spans = source[np.minimum(bounds, len(source) - 1)]
        if not self.by_word:
            surface = self.library.decode(array("I", ids).tolist()).encode()
        elif self.prefix:
            surface = surface[1:]
        return begin + ids + end, np.stack([spans[:-1], spans[1:]], 1), surface


    def encode_all(self, texts: pa.Array) -> Iterator[tuple[bytes, np.ndarray, bytes]]:
        """``encode`` of each text. Arrow splits those without runs of spaces into words and numbers the different ones."""
        values = texts.to_pylist()
        simple = [self.by_word and bool(t) and t[0] != " " and "  " not in t and SPACE not in t for t in values]
        split = pc.split_pattern(texts.filter(pa.array(simple, pa.bool_())).cast(pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        new = [w for w in words if w and w not in self.words]
        made = {w: self.words.put(w, self.packed(x)) for w, x in zip(new, self.library.encode(new, num_threads=1), strict=True)}
        own = [made.get(w) or self.words[w] for w in words]
        same = np.array([x[2] == b" " + w.encode() for x, w in zip(own, words, strict=True)], bool)
        place = coded.indices.to_numpy().astype(np.int64)
        ids, lengths = (np.frombuffer(b"".join(x[k] for x in own), np.uint32) for k in (0, 1))
        n = np.fromiter((len(x[0]) // 4 for x in own), np.int64, len(own))
        starts, count = np.cumsum(n) - n, n[place]
        ends = np.cumsum(count)
        pick = np.repeat(starts[place] - ends + count, count) + np.arange(count.sum())
        ids, lengths, word_ends = ids[pick], lengths[pick].astype(np.int64), split.offsets.to_numpy()
        bounds, at = np.concatenate([[0], ends])[word_ends], 0
        begin, end = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        for text, alone in zip(values, simple, strict=True):
            if not alone:
                yield self.encode(text)
                continue
            a, b = bounds[at : at + 2]
            data, source = text.encode(), self.normalised(text)[1]
            spans = source[np.minimum(np.concatenate([[0], np.cumsum(lengths[a:b])]), len(source) - 1)]
            if not same[place[word_ends[at] : word_ends[at + 1]]].all():
                data = b"".join(own[k][2] for k in place[word_ends[at] : word_ends[at + 1]])[1:]
            at += 1
            yield begin + ids[a:b].tobytes() + end, np.stack([spans[:-1], spans[1:]], 1), data
        self.words.trim()


@lru_cache(maxsize=2)
def model(path: str) -> Pieces:
    return Pieces(path)


def encode(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids and spans (little-endian 32- and 64-bit integers), decoded, for each row."""
    return _mapped(df, path, "doc_id long, ids binary, spans binary, decoded string", [pa.int64(), pa.binary(), pa.binary(), pa.string()], lambda ids, spans, decoded: (ids, spans.astype("<i8").tobytes(), decoded.decode()))


def digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, spans_crc32 for each row."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return _mapped(df, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long", kinds, lambda ids, spans, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), zlib.crc32(spans.astype("<i8").tobytes())))


def _mapped(df: DataFrame, path: str | None, schema: str, kinds: list, row) -> DataFrame:
    path = path or public_tokenizers.path(MODEL)
    names = [x.split()[0] for x in schema.split(", ")]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for b in parts(batches):
            rows = [(doc, *row(*found)) for doc, found in zip(b.column(0).to_pylist(), own.encode_all(b.column(1)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        own.words.trim(-1)

    return df.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(encoded, schema)


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
