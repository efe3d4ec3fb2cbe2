"""Token ids of whole texts, through a bounded cache of words.

The pre-tokenizer of the vocabulary never joins what white space divides, so the ids of a text are the ids of its
space-separated parts one after another. Arrow splits the texts at hand and numbers their different parts; each of these is
looked up once. A task keeps the ids of the words it saw lately as packed bytes.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import give_back


class RecentWords(dict):
    """Values that ``make`` gives, kept by key while they have at most ``most`` bytes or so; beyond, ``trim`` starts again.

    Keys of more than ``LONGEST`` characters (texts of scripts without spaces) are made anew each time, so what one text
    adds before ``trim`` is bounded by the text.
    """

    LONGEST = 64
    #: Bytes of an entry beside those of its key and its value.
    ENTRY = 200

    def __init__(self, make: Callable, most: int, weight: Callable = len):
        super().__init__()
        self.make, self.most, self.weight, self.held = make, most, weight, 0

    def __missing__(self, key):
        return self.put(key, self.make(key))

    def put(self, key, value):
        if len(key) <= self.LONGEST:
            self[key] = value
            self.held += self.ENTRY + (len(key) if key.isascii() else 4 * len(key)) + self.weight(value)
        return value

    def trim(self, most: int | None = None) -> None:
        """Start again beyond ``most`` bytes, or the own bound."""
        if self.held > (self.most if most is None else most):
            self.clear()
            self.held = 0


#: A run of Latin letters with ASCII marks after it: each is one unit of the pre-tokenizer. The dotted capital I (U+0130) is
#: none of them: in lower case it ends in a combining mark, which is one unit with marks that follow.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")
#: Bytes of words and of other parts and marks that a task keeps.
WORDS, OTHERS = 64 << 20, 8 << 20


@lru_cache(maxsize=2)
def encoder(path: str) -> tuple[RecentWords, RecentWords]:
    """The ids of words of letters, and of parts and marks that are something else."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    unit = tokenizer.model.tokenize
    level = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
    # the library's letter for each byte, read off from characters of two bytes and from ASCII
    letter = {b: level(chr(b))[0][0] for b in range(128)} | {}
    for point in range(0x80, 0x800):
        letter |= dict(zip(chr(point).encode(), level(chr(point))[0][0], strict=True))

    def whole(part: str) -> bytes:
        return array("I", tokenizer.encode(part, add_special_tokens=False).ids).tobytes()  # 4 bytes, little-endian, on the platforms of the library

    def word(letters: str) -> bytes:
        """The normalizer, the byte alphabet and the merges, without the machinery around them."""
        if not letters.isascii():
            letters = unicodedata.normalize("NFC", letters).lower()
            letters = letters.encode().decode("latin-1").translate(letter)
        return array("I", [x.id for x in unit(letters)]).tobytes()

    return RecentWords(word, WORDS), RecentWords(whole, OTHERS)


def packed_ids(texts: list[str], path: str, most: int | None = None) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers; afterwards at most ``most`` bytes of words (or WORDS) are kept."""
    words, others = encoder(path)
    spaced = pc.replace_substring(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), "\t", " ")
    split = pc.split_pattern(spaced, " ")
    coded = split.flatten().dictionary_encode()
    own = []
    for part in coded.dictionary.to_numpy(zero_copy_only=False):
        if m := PLAIN.fullmatch(part):
            ids = words[m[1].lower() if m[1].isascii() else m[1]]
            own.append(ids + others[m[2]] if m[2] else ids)
        else:
            own.append(others[part])
    place = coded.indices.to_numpy().astype(np.int64)
    lengths = np.fromiter(map(len, own), np.int64, len(own)) // 4
    starts, ids = np.cumsum(lengths) - lengths, np.frombuffer(b"".join(own), "<u4")
    n = lengths[place]
    ends = np.cumsum(n)
    packed = ids[np.repeat(starts[place] - ends + n, n) + np.arange(n.sum())]
    bounds = np.concatenate([[0], ends])[split.offsets.to_numpy()]
    words.trim(most)
    others.trim()
    return [packed[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def forget_words() -> None:
    """Let go of vocabulary and caches at a task's end, and give their memory back: its worker may serve other jobs for long."""
    encoder.cache_clear()
    give_back()
