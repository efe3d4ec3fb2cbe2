import numpy as np
import pytest
from pyspark.sql import functions as F

from evokeline.operators import components as K

N = 1500


def planted(seed):
    """Sources of known shapes mixed into channels: (sources, channels, mixing)."""
    draw, t = np.random.default_rng(seed), np.arange(N)
    blink = np.zeros(N)
    for at in draw.choice(N - 30, 25, replace=False):
        blink[at : at + 20] += np.hanning(20) * 8
    own = np.stack([blink, np.sign(np.sin(t / 13.0)) + 0.05 * draw.normal(size=N), draw.laplace(size=N), draw.uniform(-1.7, 1.7, N)])
    mix = draw.normal(size=(6, 4)) + np.eye(6, 4)
    return own, mix @ own + 5.0, mix


def rows_of(spark, parts):
    rows = [(s, 0, t, f"ch{c}", float(x[c, t])) for s, x in parts.items() for c in range(len(x)) for t in range(x.shape[1])]
    return spark.createDataFrame(rows, "subject string, trial int, t int, channel string, x double")


@pytest.mark.parametrize("rows", [4096, 400])
def test_components_are_the_planted_sources(spark, rows):
    made = {s: planted(k) for k, s in enumerate(("a", "b"))}
    df = rows_of(spark, {s: x for s, (_, x, _) in made.items()})
    model = K.fit_components(df, rows=rows)
    model = K.stored(model)
    found = K.sources(df, model).collect()
    for s, (own, _, _) in made.items():
        got = np.zeros((4, N))
        for r in found:
            if r["subject"] == s:
                got[r["component"], r["t"]] = r["x"]
        alike = np.abs(np.corrcoef(own, got)[:4, 4:])
        assert sorted(alike.argmax(1)) == [0, 1, 2, 3] and alike.max(1).min() > 0.95
        assert np.allclose(got.var(1), 1)


def test_ocular_components_go(spark):
    own, x, mix = planted(3)
    eye = own[0] + 0.1 * np.random.default_rng(4).normal(size=N)
    df = rows_of(spark, {"a": x})
    watched = df.unionByName(df.where("channel = 'ch0'").withColumn("channel", F.lit("eog")).drop("x").join(spark.createDataFrame([(t, float(v)) for t, v in enumerate(eye)], "t int, x double"), "t"))
    model = K.stored(K.fit_components(df))
    scores = K.ocular_components(watched, model, "eog", z=1.2).collect()
    bad = [r for r in scores if r["bad"]]
    assert len(bad) == 1 and abs(bad[0]["score"]) > 0.95 and all(abs(r["score"]) < 0.3 for r in scores if not r["bad"])
    clean = K.without_components(watched, model, spark.createDataFrame([("a", bad[0]["component"])], "subject string, component int"))
    got, want = np.zeros((6, N)), mix[:, 1:] @ own[1:] + 5.0
    for r in clean.where("channel <> 'eog'").collect():
        got[int(r["channel"][2:]), r["t"]] = r["x"]
    off = lambda v: v - v.mean(1, keepdims=True)
    assert np.abs(off(got) - off(want)).std() < 0.15 * own[0].std()
    assert clean.where("channel = 'eog'").agg(F.sum("x")).first()[0] == pytest.approx(eye.sum())
    assert K.without_components(df, model, spark.createDataFrame([], "subject string, component int")).count() == df.count()


def test_nothing_to_unmix(spark):
    df = rows_of(spark, {"a": planted(1)[1][:, :50]})
    assert K.fit_components(df.limit(0)).collect() == []
    assert K.fit_components(df.withColumn("x", F.lit(2.0))).collect() == []
    flat = K.fit_components(df.withColumn("x", F.when(F.col("channel") == "ch5", 1.0).otherwise(F.col("x"))), most=2)
    assert flat.select("component").distinct().count() == 2
