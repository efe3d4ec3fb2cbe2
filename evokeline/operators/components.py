"""Independent components of continuous or cut recordings, and ocular ones taken out.

Samples are vectors over channels, in the blocks of ``models``. One pass adds up the covariance, from which each key's whitening
comes; each round of the search adds up two nonlinear moments over the samples, an r x r matrix and r numbers, and turns
all directions at once. No task holds a recording, and what it holds doesn't grow with the samples.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import stored
from .models import ROWS, Keyed, arrow_schema, gram_parts, opened, table, unpacked
from .signal import eog_component_score

#: Rounds at most, and how far directions turn in the last one.
TURNS, STILL = 60, 1e-6
SEED = 0


def whitening(n: float, total: np.ndarray, gram: np.ndarray, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and r x d weights that give uncorrelated values of variance 1 along the directions with variance, largest first."""
    mean = total / n
    values, vectors = np.linalg.eigh(gram / n - np.outer(mean, mean))
    keep = np.flatnonzero(values > 1e-9 * max(values.max(), 1e-300))[::-1][:most]
    return mean, vectors[:, keep].T / np.sqrt(values[keep])[:, None]


def even(w: np.ndarray) -> np.ndarray:
    """The orthogonal matrix nearest to ``w``."""
    u, _, v = np.linalg.svd(w)
    return u @ v


def fit_components(df: DataFrame, keys: Sequence[str] = ("subject",), sample: Sequence[str] = ("trial", "t"), most: int | None = None, rounds: int = TURNS, rows: int = ROWS) -> DataFrame:
    """(keys, component, channel, unmix, mix, mean): a component's weights on channels, and its share in each.

    Fixed-point search for directions of least normal values (contrast: hyperbolic tangent), all directions at once. Components are
    numbered by the power that they have over all channels, the strongest first, and point to where their largest share is
    positive. Samples without all channels of their key are left out, as are directions without variance; ``most`` keeps
    the strongest directions. Keys that still turn after ``rounds`` rounds stay as they are then. Empty tables have none.
    """
    flat = df.select(*keys, F.struct(*sample).alias("trial"), F.lit(0).alias("y"), F.lit(0).alias("fold"), "channel", "x")
    k = Keyed(flat, keys, "channel", rows)

    def start(names: list, folds: list, sums: list[np.ndarray]) -> Iterator[tuple]:
        d, s = len(names), np.sum(sums, axis=0)
        mean, white = whitening(s[0], s[2 : 2 + d], unpacked(s[2 + 2 * d :], d), most)
        if len(white):
            turn = even(np.random.default_rng(SEED).normal(size=(len(white), len(white))))
            yield names, mean.tolist(), white.ravel().tolist(), turn.ravel().tolist(), float("inf")

    state = stored(k.total(k.summed(k.blocks, gram_parts), start, f"features array<{k.name}>, mean array<double>, white array<double>, turn array<double>, far double"))

    def parts(row: dict) -> Iterator[tuple]:
        x, _, _ = opened(row)
        mean, white, turn = (row[c].values.to_numpy() for c in ("mean", "white", "turn"))
        r = int(np.sqrt(len(turn)))
        z = (x - mean) @ white.reshape(r, -1).T
        g = np.tanh(z @ turn.reshape(r, r).T)
        yield (), [0], [np.concatenate([[len(x)], (g.T @ z).ravel(), (1 - g * g).sum(0)])]

    def gathered(names: list, folds: list, sums: list[np.ndarray]) -> Iterator[tuple]:
        yield (sums[0].tolist(),)

    kinds = arrow_schema(state.schema)

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                s, old = np.array(row["sums"]), np.array(row["turn"])
                r = int(np.sqrt(len(old)))
                old = old.reshape(r, r)
                new = even(s[1 : 1 + r * r].reshape(r, r) / s[0] - (s[1 + r * r :] / s[0])[:, None] * old)
                values = row | {"turn": new.ravel().tolist(), "far": float(np.max(np.abs(1 - np.abs((new * old).sum(1)))))}
                out.append([values[c] for c in kinds.names])
            yield table(out, kinds)

    done = None
    for _ in range(rounds):
        sums = k.total(k.summed(k.met(k.blocks, state), parts), gathered, "sums array<double>")
        state = stored(k.met(state, sums).mapInArrow(turned, state.schema))
        still = state.where(F.col("far") < STILL)
        done = still if done is None else done.unionByName(still)
        state = state.where(F.col("far") >= STILL)
        if state.isEmpty():
            break
    else:
        done = done.unionByName(state)
    schema = f"{k.schema}component int, channel {k.name}, unmix double, mix double, mean double"
    told, base = arrow_schema(schema), k.own

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                r = int(np.sqrt(len(row["turn"])))
                unmix = np.array(row["turn"]).reshape(r, r) @ np.array(row["white"]).reshape(r, -1)
                mix = np.linalg.pinv(unmix)
                order = np.argsort(-(mix * mix).sum(0), kind="stable")
                side = np.sign(mix[np.abs(mix).argmax(0), np.arange(r)])
                out += [(*(row[c] for c in base), j, c, float(side[o] * unmix[o, i]), float(side[o] * mix[i, o]), row["mean"][i]) for j, o in enumerate(order) for i, c in enumerate(row["features"])]
            yield table(out, told)

    return k.named(done.select(*base, "features", "mean", "white", "turn").mapInArrow(spread, schema))


def sources(df: DataFrame, model: DataFrame, keys: Sequence[str] = ("subject",), sample: Sequence[str] = ("trial", "t")) -> DataFrame:
    """(keys, sample, component, x): the components' values at each sample."""
    both = df.select(*keys, *sample, "channel", "x").join(model.select(*keys, "component", "channel", "unmix", "mean"), [*keys, "channel"])
    return both.groupBy(*keys, *sample, "component").agg(F.sum(F.col("unmix") * (F.col("x") - F.col("mean"))).alias("x"))


def ocular_components(df: DataFrame, model: DataFrame, eog: str | int, z: float = 3.0, keys: Sequence[str] = ("subject",), sample: Sequence[str] = ("trial", "t")) -> DataFrame:
    """(keys, component, score, z, bad): each component's correlation with the ocular channel, and whether it stands out, as for channels."""
    eye = df.where(F.col("channel") == eog).select(*keys, *sample, F.lit(-1).alias("channel"), "x")
    own = sources(df, model, keys, sample).withColumnRenamed("component", "channel").select(*keys, *sample, "channel", "x")
    return eog_component_score(own.unionByName(eye), -1, z, [*keys, *sample]).withColumnRenamed("channel", "component")


def without_components(df: DataFrame, model: DataFrame, bad: DataFrame, keys: Sequence[str] = ("subject",), sample: Sequence[str] = ("trial", "t")) -> DataFrame:
    """``df`` less the share of the components in ``bad`` (keys, component) in each channel; other channels and samples stay."""
    out = model.join(bad.select(*keys, "component").distinct(), [*keys, "component"], "left_semi")
    share = sources(df, out, keys, sample).withColumnRenamed("x", "_s").join(out.select(*keys, "component", "channel", "mix"), [*keys, "component"])
    taken = share.groupBy(*keys, *sample, "channel").agg(F.sum(F.col("mix") * F.col("_s")).alias("_taken"))
    return df.join(taken, [*keys, *sample, "channel"], "left").withColumn("x", F.col("x") - F.coalesce("_taken", F.lit(0.0))).drop("_taken")
