"""Logistic regression by damped diagonal steps: what it moves and keeps, and trials that lack channels or have some twice."""

import glob
import os
import random
from collections import defaultdict
from math import exp, sqrt

import pytest

from evokeline.operators import decode
from evokeline.plans.library import QUERIES

D = "/root/testdata/sf0.001"


def shuffled(spark):
    """Bytes written by shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    every = sc.statusStore().executorList(False)
    return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))


def test_disk_is_a_few_times_the_input(spark):
    """Rows aren't repeated for folds, nor moved once a step."""
    size = lambda top: sum(os.path.getsize(f) for f in glob.glob(f"{top}/**", recursive=True) if os.path.isfile(f))
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    moved, kept = shuffled(spark), size(top)
    assert QUERIES["linear_scorer_logistic"](spark, D).count() == 4000
    assert shuffled(spark) - moved + size(top) - kept < 10 * os.path.getsize(f"{D}/embeddings.parquet")


def brute(rows, folds):
    """One step after the other over lists, for each subject, time and fold; the constant's weight is that of the first channel."""
    groups, out = defaultdict(list), {}
    for subject, trial, channel, t, x, y in rows:
        groups[subject, t].append((trial, folds[subject, trial], channel, x, y))
    for (subject, t), items in groups.items():
        for f in sorted({i[1] for i in items}):
            scale = {}
            for c in sorted({i[2] for i in items}):
                known = [(x, y) for _, own, channel, x, y in items if own != f and channel == c and x is not None]
                n1, n = sum(y for _, y in known), len(known)
                if 0 < n1 < n:
                    mean = sum(x for x, _ in known) / n
                    scale[c] = mean, sqrt(sum((x - mean) ** 2 for x, _ in known) / n), (n / (2 * (n - n1)), n / (2 * n1))
            z, first = defaultdict(list), {}
            for trial, own, c, x, y in items:
                if c in scale:
                    mean, sd, weight = scale[c]
                    first[trial, own, y] = min(first.get((trial, own, y), (c, weight[y])), (c, weight[y]))
                    if x is not None:
                        z[trial, own].append((c, (x - mean) / sd, weight[y], y))
            for (trial, own, y), (_, weight) in first.items():
                z[trial, own].append((None, 1.0, weight, y))
            beta = dict.fromkeys([*scale, None], 0.0)
            for _ in range(decode.STEPS):
                g, h = defaultdict(float), defaultdict(float)
                for (_, own), entries in z.items():
                    p = 1 / (1 + exp(-sum(beta[c] * v for c, v, _, _ in entries)))
                    for c, v, w, y in entries if own != f else ():
                        g[c] += w * (p - y) * v
                        h[c] += w * p * (1 - p) * v * v
                ridge = {c: 0.0 if c is None else 1 / decode.PENALTY for c in beta}
                beta = {c: b - decode.DAMPING * (g[c] + ridge[c] * b) / (h[c] + ridge[c]) for c, b in beta.items()}
            for (trial, own), entries in z.items():
                if own == f:
                    out[subject, f, t, trial] = sum(beta[c] * v for c, v, _, _ in entries)
    return out


@pytest.mark.parametrize("rows", [4096, 13])
def test_trials_that_are_not_whole(spark, rows):
    draw, made = random.Random(5), []
    for subject in ("a", "b"):
        for trial in range(60):
            for t in range(2):
                for c in ("p", "q", "r", "s")[: 3 + (subject == "b")]:
                    for _ in range(draw.choices((0, 1, 2), (1, 8, 1))[0]):
                        made.append((subject, f"n{trial}", c, t, None if draw.random() < 0.05 else draw.gauss(0.5 * (trial % 2), 1), trial % 2))
    df = spark.createDataFrame(made, "subject string, trial string, channel string, t int, x double, y int")
    fold = decode.stratified_folds(df, ["subject"], 5, 1).cache()
    want = brute(made, {(r["subject"], r["trial"]): r["fold"] for r in fold.collect()})
    got = decode.logistic(decode.folded_rows(df, fold, ["subject"]), ["subject", "repeat"], rows=rows)
    assert dict(got.dtypes)["y"] == "int"
    got = {(r["subject"], r["fold"], r["t"], r["trial"]): r["score"] for r in got.collect()}
    assert set(got) == set(want) and len(want) > 230
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-9
