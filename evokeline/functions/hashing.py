"""Random order and signs that any SQL engine reproduces, for ids of any type: digits of MD5."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that one digest gives.
SIGNS = 32


def drawn(seed: int | Column, unit: Column) -> Column:
    """A text by which an order is random: the digest of the id's text."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), unit.cast("string")))


def drawn_sql(seed: str | int, unit: str) -> str:
    return f"md5(concat_ws(':', cast({seed} AS VARCHAR), cast({unit} AS VARCHAR)))"


def signs(unit: object, seed: int, draws: Iterable[int]) -> np.ndarray:
    """The signs of an id in some draws, 1 or -1; draw 0 is what was observed."""
    out, words = [], {}
    for p in draws:
        k = p // SIGNS
        if k not in words:
            words[k] = int(hashlib.md5(f"{seed}:{k}:{unit}".encode()).hexdigest()[:8], 16)
        out.append(1 if p == 0 or not words[k] >> p % SIGNS & 1 else -1)
    return np.array(out, np.float64)


def sign_sql(unit: str, draw: str, seed: int = 0) -> str:
    word = f"cast('0x' || substr(md5('{seed}:' || cast({draw} // {SIGNS} AS VARCHAR) || ':' || cast({unit} AS VARCHAR)), 1, 8) AS BIGINT)"
    return f"(CASE WHEN {draw} = 0 THEN 1 ELSE 1 - 2 * (({word} >> cast({draw} % {SIGNS} AS INT)) & 1) END)"
