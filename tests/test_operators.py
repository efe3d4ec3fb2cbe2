"""Hand-made cases and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evokeline.functions.distributions import normal_cdf, rank_sum_null, signed_rank_null, t_sf
from evokeline.functions.hashing import drawn, signs
from evokeline.operators import aggregate, decode, events, signal, stats


def codes(spark, runs):
    return spark.createDataFrame([(s, k, c) for s, run in runs.items() for k, c in enumerate(run)], "subject int, seq int, code int")


def by_subject(df):
    out = {}
    for r in df.orderBy("subject", "seq").collect():
        out.setdefault(r["subject"], []).append(r["code"])
    return out


def test_marker_window(spark):
    got = by_subject(events.tag_after_marker(codes(spark, {1: [1] + [9] * 41 + [2, 2], 2: [1, 1, 2], 3: [2, 1]}), [1], [2]))
    assert got[1][-2:] == [1002, 2] and got[2][-1] == 1002 and got[3] == [2, 1]


def claimed_one_by_one(run):
    run = list(run)
    for k, c in enumerate(run):
        if c == 2:
            if k and run[k - 1] == 3:
                run[k - 1] = 2003
            elif k + 1 < len(run) and run[k + 1] == 3:
                run[k + 1] = 2003
    return run


def test_claims_equal_the_sequential_rule(spark):
    draw = random.Random(5)
    runs = {s: [draw.choice([2, 3, 9]) for _ in range(draw.randrange(1, 12))] for s in range(400)}
    got = by_subject(events.claim_neighbour(codes(spark, runs), [2], [3]))
    assert got == {s: claimed_one_by_one(r) for s, r in runs.items()}


def test_local_global(spark):
    rows = []
    for block, (std, fifth) in enumerate([(1, 1), (2, 5)]):
        rows += [(1, 10 * block + k, k, fifth if k in (5, 10) else std) for k in range(1, 11)]
    df = spark.createDataFrame(rows, "subject int, row_no int, idx int, trigger int")
    got = {r["row_no"]: r["lg"] for r in events.local_global_code(df).collect()}
    assert got[5] == 11 and got[15] == 21 and got[10] == 11 and got[20] == 21 and got[4] == 0


@pytest.mark.parametrize("n", [0, 1, 5])
def test_auc_of_scores(spark, n):
    draw = random.Random(n)
    rows = [(g, draw.randrange(2), float(draw.randrange(4))) for g in range(n) for _ in range(9)]
    got = {r["g"]: r["auc"] for r in decode.auc(spark.createDataFrame(rows, "g int, y int, s double"), ["g"], "y", "s").collect()}
    for g in range(n):
        p, q = ([s for k, y, s in rows if k == g and y == c] for c in (1, 0))
        want = sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)) if p and q else None
        assert got[g] == want or abs(got[g] - want) < 1e-12


def test_auc_degenerate(spark):
    df = spark.createDataFrame([("c", 0, 1.0), ("c", 1, 1.0), ("o", 1, 1.0), ("o", 1, 2.0)], "g string, y int, s double")
    assert {r["g"]: r["auc"] for r in decode.auc(df, ["g"], "y", "s").collect()} == {"c": 0.5, "o": None}


def test_planted_effect(spark):
    draw = random.Random(3)
    rows = [(0, k, c, t, draw.gauss(0, 1) + 4 * (t == 6) * (k % 2), k % 2) for k in range(40) for c in range(2) for t in range(10)]
    df = spark.createDataFrame(rows, "subject int, trial int, channel int, t int, x double, y int")
    fold = decode.stratified_folds(df, ["subject"], 5, 2)
    for kind in ("dlda", "logistic", "logreg", "linear_svc"):
        mean = decode.fold_mean_sd(decode.sliding_auc(df, fold, ["subject"], kind), ["t"]).orderBy(F.desc("mean_auc")).first()
        assert mean["t"] == 6 and mean["mean_auc"] > 0.95
    tgm = decode.generalisation_matrix(df, fold, ["subject"]).groupBy("t_train", "t_test").agg(F.avg("auc").alias("a")).orderBy(F.desc("a")).first()
    assert (tgm["t_train"], tgm["t_test"]) == (6, 6)


def test_folds_hold_each_trial_once(spark):
    df = spark.createDataFrame([(0, k, int(k % 3 == 0)) for k in range(31)], "subject int, trial int, y int")
    folds = decode.stratified_folds(df, ["subject"], 4, 3)
    assert folds.groupBy("repeat", "trial").count().where("count <> 1").count() == 0
    sizes = folds.groupBy("repeat", "y", "fold").count().groupBy("repeat", "y").agg((F.max("count") - F.min("count")).alias("d"))
    assert sizes.agg(F.max("d")).first()[0] <= 1


def test_bh(spark):
    df = spark.createDataFrame([(k, p) for k, p in enumerate([0.01, 0.02, 0.03, 0.04, None])], "k int, p double")
    got = [r["p_fdr"] for r in stats.fdr_bh(df, [], "p").orderBy("k").collect()]
    assert all(abs(x - 0.04) < 1e-12 for x in got[:4]) and got[4] is None


def test_signed_rank_rules(spark):
    rows = [("a", x) for x in (-1.0, 2.0, 3.0, 0.0, 0.0)] + [("z", 0.0)] * 3 + [("n", 1.0), ("n", None)]
    got = {r["k"]: (r["stat"], r["p"]) for r in stats.wilcoxon_1samp(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 0.0).collect()}
    assert got["a"][0] == 5.0 and got["z"] == (0.0, 1.0) and got["n"] == (None, None)


def test_null_distributions():
    below = dict(signed_rank_null(5))[3]
    assert [round(8 * x) for x in below] == [1, 2, 3, 5, 6, 7, 8]
    u = {(a, b): p for a, b, p in rank_sum_null(3)}[2, 2]
    assert [round(6 * x) for x in u] == [1, 2, 4, 5, 6]


def test_t_tail():
    for t, df, p in ((0.0, 3, 0.5), (1.0, 1, 0.25), (2.228138852, 10, 0.025), (-1.0, 1, 0.75)):
        assert abs(t_sf(t, df) - p) < 1e-8


def test_normal_cdf(spark):
    for r in spark.range(-30, 31).select((F.col("id") / 8).alias("z")).withColumn("p", normal_cdf(F.col("z"))).collect():
        assert abs(r["p"] - 0.5 * (1 + math.erf(r["z"] / math.sqrt(2)))) < 2e-7


def test_signs_look_random(spark):
    flips = np.stack([signs(f"S{k:02}", 0, range(2001)) for k in range(30)])
    assert (flips[:, 0] == 1).all() and set(flips.ravel()) == {1.0, -1.0}
    z = flips[:, 1:].sum(0) / math.sqrt(30)
    assert 0.93 < z.std() < 1.07 and (abs(z) > 1.96).mean() < 0.07
    assert (signs(5, 0, range(99)) == signs("5", 0, range(99))).all() and (signs(5, 1, range(99)) != signs(5, 0, range(99))).any()
    assert spark.range(100_000).select(drawn(0, F.col("id")).alias("m")).distinct().count() == 100_000


def test_runs_and_masses(spark):
    t = spark.createDataFrame([(k, v) for k, v in enumerate([0.0, 0.0, 2.0, 3.0, 2.0, 0.0, 0.0, 4.0, -3.0])], "t int, tval double")
    got = [(r["t_start"], r["t_end"], r["mass"]) for r in stats.islands(t, [], "t", "tval", 1.0, "two-sided").orderBy("t_start").collect()]
    assert got == [(2, 4, 7.0), (7, 7, 4.0), (8, 8, -3.0)]


def test_band_leaves_the_last_bin_out(spark):
    psd = spark.createDataFrame([(1, k / 2, float(k)) for k in range(1, 11)], "s int, freq double, power double")
    got = aggregate.band_power(psd, spark.createDataFrame([("b", 0.5, 4.0)], "band string, lo double, hi double"), ["s"]).first()
    assert got["power"] == sum(range(1, 8)) / 7


def test_average_reference_sums_to_zero(spark):
    df = spark.createDataFrame([(1, t, c, float(c * t + c)) for t in range(3) for c in range(4)], "trial int, t int, channel int, x double")
    r = signal.average_reference(df, ["trial", "t"]).groupBy("trial", "t").agg(F.abs(F.sum("x")).alias("s")).agg(F.max("s")).first()
    assert r[0] < 1e-12


def test_empty_tables(spark):
    none = spark.createDataFrame([], "subject int, trial int, channel int, t int, x double, y int")
    assert decode.sliding_auc(none, decode.stratified_folds(none, ["subject"], 5, 1), ["subject"]).count() == 0
    assert signal.reject_ptp(none, spark.createDataFrame([(0, 1.0)], "channel int, ptp_limit double")).count() == 0
    assert stats.cluster_permutation(none.withColumnRenamed("x", "score"), ["channel"], "t", 0.0, 5).count() == 0


def test_matrix_clusters(spark):
    """A shape that winds, and neighbours by a list; p against a plain count of flips."""
    snake = [(0, b) for b in range(9)] + [(1, 8), (2, 8)] + [(2, b) for b in range(8)] + [(3, 0), (4, 0)]
    level = dict.fromkeys(snake, 2.0) | {(0, 11): 3.0, (4, 5): -2.0, (4, 6): -2.0, (3, 5): 0.1}
    draw = random.Random(1)
    rows = [(f"S{k:02}", a, b, v + draw.gauss(0, 1)) for (a, b), v in level.items() for k in range(8)]
    df = spark.createDataFrame(rows, "subject string, a int, b int, score double")
    got = stats.cluster_matrix(df, [], ["a", "b"], 0.0, 40, 1.5).collect()
    cells = sorted(level)
    d = np.array([[r[3] for r in rows if (r[1], r[2]) == c] for c in cells])

    def clusters(flip):
        x = d * np.array([signs(f"S{k:02}", 0, [flip])[0] for k in range(8)])
        tval = x.mean(1) / (x.std(1, ddof=1) / math.sqrt(8))
        todo, found = {c: v for c, v in zip(cells, tval) if abs(v) > 1.5}, []
        while todo:
            group, front = {}, [min(todo)]
            while front:
                c = front.pop()
                if c in todo and (not group or todo[c] * next(iter(group.values())) > 0):
                    group[c] = todo.pop(c)
                    front += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
            found.append(group)
        return found

    null = [max((abs(sum(g.values())) for g in clusters(k)), default=0.0) for k in range(1, 41)]
    want = {c: (len(g), sum(g.values()), (1 + sum(m >= abs(sum(g.values())) - 1e-9 for m in null)) / 41) for g in clusters(0) for c in g}
    assert {(r["a"], r["b"]) for r in got} == set(want)
    for r in got:
        n, mass, p = want[r["a"], r["b"]]
        assert r["n"] == n and abs(r["mass"] - mass) < 1e-6 and abs(r["p"] - p) < 1e-9
    line = df.where("a = 0").withColumn("place", (F.col("b") * 7) % 12)
    one = stats.cluster_matrix(line, [], ["place"], 0.0, 10, 1.5, adjacency=[(b * 7 % 12, (b + 1) * 7 % 12) for b in range(8)]).select("cluster").distinct().count()
    assert one == len([g for g in clusters(0) if any(c[0] == 0 for c in g)])


def test_neighbours_and_clusters_by_arrays():
    """Random maps with holes against a plain flood fill."""
    draw = np.random.default_rng(4)
    for _ in range(40):
        places = np.array([(a, b) for a in range(-3, 9) for b in range(7) if draw.random() < 0.8])
        places = places[draw.permutation(len(places))]
        side = draw.integers(-1, 2, len(places))
        at, want = {tuple(p): k for k, p in enumerate(places.tolist())}, list(range(len(places)))
        for k in range(len(places)):
            if side[k] and want[k] == k:
                front = [k]
                while front:
                    i = front.pop()
                    want[i] = k
                    a, b = places[i].tolist()
                    front += [j for c in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)) if (j := at.get(c)) is not None and side[j] == side[k] and want[j] == j and j > k]
        assert stats.joined(len(places), *stats.neighbours(places), side).tolist() == want


def test_a_large_matrix_of_flips():
    """A map of 801 x 801 cells takes well under a second a flip."""
    import time

    draw = np.random.default_rng(5)
    places = np.stack(np.meshgrid(np.arange(801), np.arange(801), indexing="ij"), -1).reshape(-1, 2)
    smooth = draw.normal(size=(801, 801)).cumsum(0).cumsum(1)
    smooth = smooth / smooth.std()
    largest = stats.largest_mass(0.8, "two-sided")(places)
    began = time.process_time()
    for k in range(3):
        assert largest(np.roll(smooth, 100 * k, 0).ravel() + draw.normal(size=len(places)) * 0.3) > 0
    assert (time.process_time() - began) / 3 < 3


def test_units_of_a_point_in_several_rows(spark):
    draw = random.Random(3)
    rows = [(f"S{s:03}", t, 0.5 + draw.gauss(0.1, 1) if draw.random() < 0.9 else None) for s in range(60) for t in range(4)]
    df = spark.createDataFrame(rows, "subject string, t int, score double")
    for stat in stats.STATISTICS:
        one, more = ({(r["t"], r["block"]): r["maps"] for r in stats.flipped(df, [], ["t"], "subject", "score", 0.5, 40, 0, stat, units=n).collect()} for n in (2048, 7))
        assert one.keys() == more.keys() and all(np.allclose(one[k], more[k]) for k in one)
        d = np.array([[v for _, t, v in rows if t == k] for k in range(4)], float) - 0.5
        flips = np.stack([signs(f"S{s:03}", 0, range(41)) for s in range(60)])
        if stat == "t":
            x = d[:, :, None] * flips[None]
            n = np.count_nonzero(~np.isnan(d), axis=1)[:, None]
            want = np.nanmean(x, axis=1) / (np.nanstd(x, axis=1, ddof=1) / np.sqrt(n))
            assert np.allclose([sum((one[t, b] for b in range(3)), []) for t in range(4)], want)


def test_text_ids(spark):
    """Subjects and trials with text ids go through everything that draws at random."""
    draw = random.Random(2)
    rows = [(f"S{s:02}", t, 0.5 + draw.gauss(0.2, 1)) for s in range(8) for t in range(6)]
    df = spark.createDataFrame(rows, "subject string, t int, score double")
    for out in (stats.cluster_permutation(df, [], "t", 0.5, 20, 0.5), stats.tfce(df, [], "t", mu=0.5, n_perm=20), stats.permutation_ttest(df, [], ["t"], 20, value="score", mu=0.5)):
        assert all(0 < r["p"] <= 1 for r in out.collect())
    assert {s: stats.cluster_permutation(df, [], "t", 0.5, 20, 0.5, stat=s).count() > 0 for s in stats.STATISTICS} == dict.fromkeys(stats.STATISTICS, True)
    trials = spark.createDataFrame([("A", f"tr-{k}", k % 2) for k in range(20)], "subject string, trial string, y int")
    assert {r["count"] for r in decode.stratified_folds(trials, ["subject"], 4, 2).groupBy("repeat", "y", "fold").count().collect()} == {2, 3}


def test_long_kernels(spark):
    """Chunks with borders give what one convolution of the whole recording gives, samples missing at the ends and inside."""
    draw = random.Random(4)
    x = {k: draw.gauss(0, 1) for k in range(-50, 30_000) if k % 9000}
    df = spark.createDataFrame([(1, k, v) for k, v in x.items()], "subject int, sample long, x double")
    kernel = [draw.gauss(0, 0.05) for _ in range(301)]
    got = {r["sample"]: r["x"] for r in signal.fir_filter(df, ["subject"], kernel).collect()}
    assert set(got) == set(x)
    pad = np.zeros(31_000)
    there = np.zeros(31_000)
    for k, v in x.items():
        pad[k + 500], there[k + 500] = v, 1
    first = np.convolve(pad, kernel[::-1], "same") * there
    want = np.convolve(first, kernel, "same")
    assert max(abs(got[k] - want[k + 500]) for k in x) < 1e-9


def test_notch_takes_out_the_mains():
    kernel = np.array(signal.notch_kernel(501, [50.0], 4.0, 500.0))
    gain = lambda f: abs(sum(h * np.exp(2j * np.pi * f * k / 500) for k, h in enumerate(kernel)))
    assert gain(50) < 0.02 and gain(20) > 0.98 and gain(100) > 0.98


def test_a_session_without_a_shared_folder():
    """On one machine a session gets a folder of its own; on a cluster it is told to name one."""
    from types import SimpleNamespace

    from evokeline.functions import session

    without = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: other), sparkContext=SimpleNamespace(master=master))
    folder = session.shared(without("local[4]"))
    assert folder == session.shared(without("local[*]")) and session.scratch(without("local"), "x").startswith(f"{folder}/x-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared(without(master))


def test_corpus_import_errors_surface(tmp_path):
    """Only a missing corpus package is passed over; an error inside it isn't."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for broken in (False, True):
        copy = tmp_path / str(broken)
        shutil.copytree(f"{root}/evokeline", copy / "evokeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        shutil.copy(f"{root}/__spark_entry__.py", copy)
        if broken:
            os.makedirs(copy / "evokeline" / "llm")
            (copy / "evokeline" / "llm" / "__init__.py").write_text("")
            (copy / "evokeline" / "llm" / "queries.py").write_text("import no_such_module_at_all\n")
            (copy / "corpus_pipeline.py").write_text("from evokeline.llm import queries\n")
        done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=copy, capture_output=True, text=True, timeout=120)
        assert (done.returncode == 0) == (not broken)


def test_shapiro_wilk(spark):
    """Published examples, sizes of every branch, and values that have no statistic."""
    from statistics import NormalDist

    from evokeline.functions.distributions import probit

    p = spark.range(1, 2000).select((F.col("id") / 2000.0).alias("p")).select("p", probit(F.col("p")).alias("z")).collect()
    assert max(abs(r["z"] - NormalDist().inv_cdf(r["p"])) for r in p) < 1e-12
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [("weights", float(v)) for v in weights] + [("weights", None), ("weights", float("nan"))] + [("three", v) for v in (1.0, 2.0, 4.0)] + [("same", 1.0)] * 9 + [("two", 1.0), ("two", 2.0)]
    rows += [("normal", NormalDist().inv_cdf((k + 0.5) / 200)) for k in range(200)] + [("skewed", math.exp(2 * NormalDist().inv_cdf((k + 0.5) / 60))) for k in range(60)] + [("five", v) for v in (1.0, 2.0, 3.0, 4.0, 20.0)]
    got = {r["k"]: (r["n"], r["w"], r["p"]) for r in stats.shapiro_wilk(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["weights"][0] == 11 and abs(got["weights"][1] - 0.78881) < 1e-4 and abs(got["weights"][2] - 0.006704) < 1e-4
    assert abs(got["three"][1] - 0.96429) < 1e-4 and abs(got["three"][2] - 0.63689) < 1e-4
    assert got["same"][1:] == (None, None) and got["two"][1:] == (None, None)
    assert got["normal"][2] > 0.99 and got["skewed"][2] < 1e-6 and 0 < got["five"][2] < 0.05
    choice = {r["k"]: r["test"] for r in stats.adaptive_test(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", 0.0).collect()}
    assert choice["normal"] == "ttest" and choice["skewed"] == "wilcoxon" and choice["two"] == "ttest" and choice["weights"] == "wilcoxon"


def tone(df, hz, rate):
    """The amplitude of a frequency in the middle of a recording."""
    x = np.array([r["x"] for r in df.orderBy("sample").collect()])[60:-60]
    k = np.arange(len(x))
    return 2 * abs(np.mean(x * np.hanning(len(x)) * 2 * np.exp(-2j * np.pi * hz * k / rate)))


def test_resampling_has_no_aliases(spark):
    rows = [("s", k, math.sin(2 * math.pi * 10 * k / 250) + math.sin(2 * math.pi * 80 * k / 250)) for k in range(2500)]
    df = spark.createDataFrame(rows, "subject string, sample long, x double")
    out = signal.resample_poly(df, ["subject"], 100, 250)
    assert out.count() == 1000
    assert abs(tone(out, 10, 100) - 1) < 0.02 and tone(out, 20, 100) < 0.01  # 80 Hz would show at 20
    assert tone(signal.resample_bins(df, ["subject"], 250.0, 100.0), 20, 100) > 0.05
    up = signal.resample_poly(df.where("sample < 600"), ["subject"], 3, 1)
    assert abs(tone(up, 10, 750) - 1) < 0.02 and up.count() == 1800
    gap = df.where("sample < 100 or sample >= 1000").withColumn("sample", F.col("sample") - 50)
    whole, chunked = ({r["sample"]: r["x"] for r in signal.resample_poly(gap, ["subject"], 2, 5, size=n).collect()} for n in (8192, 17))
    assert whole.keys() == chunked.keys() and all(abs(whole[k] - chunked[k]) < 1e-9 for k in whole)
    h = signal.resampling_kernel(2, 5)
    x = {r["sample"]: r["x"] for r in gap.collect()}
    assert set(whole) == {m for m in range(-100, 1100) if (m * 5) // 2 in x}
    for m in list(whole)[::37]:
        assert abs(whole[m] - sum(v * h[len(h) // 2 + m * 5 - k * 2] for k, v in x.items() if abs(m * 5 - k * 2) <= len(h) // 2)) < 1e-9
    assert signal.resample_poly(df.limit(0), ["subject"], 2, 5).count() == 0


def test_splines_read_low_harmonics(spark):
    """Smooth fields on the sphere come back at repaired channels; subjects with one set share its weights."""
    draw = np.random.default_rng(6)
    at = draw.normal(size=(60, 3))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    fields = [lambda p: 1 + 0 * p[0], lambda p: p[0] + 2 * p[2], lambda p: p[0] * p[1] + 0.5 * (3 * p[2] ** 2 - 1)]
    rows = [(s, f, 0, f"c{c:02d}", float(field(at[c]))) for s in range(3) for f, field in enumerate(fields) for c in range(60)]
    df = spark.createDataFrame(rows, "subject int, trial int, t int, channel string, x double")
    bad = spark.createDataFrame([(0, "c03"), (0, "c40"), (1, "c03"), (1, "c40"), (1, "c03"), (2, "c07"), (2, "nowhere")], "subject int, channel string")
    spoilt = df.join(bad.distinct().withColumn("b", F.lit(1)), ["subject", "channel"], "left").withColumn("x", F.when(F.col("b") == 1, 99.0).otherwise(F.col("x"))).drop("b")
    position = spark.createDataFrame([(f"c{c:02d}", *(3 * at[c]).tolist()) for c in range(60)], "channel string, px double, py double, pz double")
    got = {(r["subject"], r["trial"], r["channel"]): r["x"] for r in signal.interpolate_spline(spoilt, bad, position).collect()}
    assert len(got) == len(rows)
    assert max(abs(got[s, f, c] - x) for s, f, _, c, x in rows) < 0.02
    assert all(abs(got[s, 0, c] - 1) < 1e-6 for s in range(3) for c in ("c03", "c40", "c07"))


def test_slepian_tapers_and_adaptive_spectra(spark):
    """Orthonormal tapers of nearly all their energy in the band; a strong tone leaks less than with sine tapers."""
    for n, width, k in ((64, 2.5, 4), (101, 4.0, 7), (600, 2.5, 4)):
        tapers, shares = aggregate.slepian_tapers(n, width, k)
        assert np.abs(tapers @ tapers.T - np.eye(k)).max() < 1e-9 and np.all(np.diff(shares) <= 1e-12) and shares[0] > 0.999
        t = np.arange(n)
        kernel = np.where(t[:, None] == t, 2 * width / n, np.sin(2 * np.pi * width / n * (t[:, None] - t)) / np.where(t[:, None] == t, 1, np.pi * (t[:, None] - t)))
        assert np.abs(kernel @ tapers.T - tapers.T * shares).max() < 1e-8  # eigenvectors of the band's own kernel
    draw, n = np.random.default_rng(7), 128
    x = draw.normal(size=(200, n))
    rows = [(k, t, float(v)) for k, own in enumerate(x) for t, v in enumerate(own)]
    white = aggregate.multitaper_psd(spark.createDataFrame(rows, "trial int, t int, x double"), ["trial"], n, 128.0, 5.0, 60.0).agg(F.avg("power")).first()[0]
    assert abs(white - 1 / 128) < 0.05 / 128
    tone = spark.createDataFrame([(0, t, 100 * math.sin(2 * math.pi * 10.3 * t / 128) + 0.001 * float(draw.normal())) for t in range(n)], "trial int, t int, x double")
    far = {f.__name__: f(tone, ["trial"], n, 128.0, 30.0, 60.0).agg(F.avg("power")).first()[0] for f in (aggregate.psd, aggregate.multitaper_psd)}
    assert far["multitaper_psd"] < far["psd"] / 3
    assert aggregate.multitaper_psd(tone.limit(0), ["trial"], n, 128.0).count() == 0


def test_repairs_in_the_grid(spark):
    """Planted bad channels stand out, are repaired, and the chosen setting is the one of a plain search."""
    draw = np.random.default_rng(8)
    at = draw.normal(size=(12, 3))
    at /= np.linalg.norm(at, axis=1, keepdims=True)
    x = np.einsum("kpt,cp->kct", draw.normal(size=(24, 3, 20)), at) + 0.05 * draw.normal(size=(24, 12, 20))
    for k in range(24):
        x[k, k % 2 + 3] += 30 * draw.normal(size=20)  # one bad channel in each trial
    x[7] += 40 * draw.normal(size=(12, 20))  # and a trial that is bad all over
    rows = [(1, k, c, t, float(x[k, c, t])) for k in range(24) for c in range(12) for t in range(20)]
    df = spark.createDataFrame(rows, "subject int, trial int, channel int, t int, x double")
    position = spark.createDataFrame([(c, *at[c].tolist()) for c in range(12)], "channel int, px double, py double, pz double")
    limits = spark.createDataFrame([(1, c, 12.0) for c in range(12)], "subject int, channel int, threshold double")
    off = np.zeros((24, 12))
    for r in signal.spline_residual(df, position).collect():
        off[r["trial"], r["channel"]] = r["residual"]
    assert all(off[k].argmax() == k % 2 + 3 for k in range(24) if k != 7)
    want, ptp = [], np.ptp(x, axis=2)
    for n in (0, 1, 3):
        for share in (0.3, 1.0):
            fixed, kept = ptp.copy(), (ptp > 12).mean(1) <= share
            for k in range(24):
                bad = sorted(np.flatnonzero(ptp[k] > 12), key=lambda c: (-ptp[k, c], c))[:n]
                if bad:
                    rest = [c for c in range(12) if c not in bad]
                    fixed[k, sorted(bad)] = np.ptp(signal.spline_weights(at[rest], at[sorted(bad)]) @ x[k, rest], axis=1)
            cost = [abs(fixed[kept & (np.arange(24) % 4 != f), c].mean() - np.median(ptp[np.arange(24) % 4 == f, c])) for f in range(4) for c in range(12)]
            want.append((round(float(np.mean(cost)), 6), n, share, int(kept.sum()) * 12))
    got = signal.repair_grid(df, limits, position, [0, 1, 3], [0.3, 1.0], 4).first()
    assert (round(got["cost"], 6), got["n_interpolate"], got["consensus"], got["n_kept"]) == min(want)
    assert got["n_interpolate"] > 0
