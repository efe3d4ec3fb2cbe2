"""Tests against chance and between groups, false discovery rates, permutation and cluster statistics.

A test is a grouped aggregate over ``keys`` (subject, group, time, ...). Ranks are windows within a key.

Sign flips of units (subjects) are matrix products: a point's values stand in rows of at most ``UNITS`` units as arrays, and
a block of flips is the product with the units' signs; the products of a point's rows are added up. No observation is repeated
for a flip. What a flip leads to (the largest statistic, the largest cluster) is worked out for each block of flips with all
points of a key at hand, in numpy: clusters are joined by arrays of neighbours, not cell by cell.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.distributions import normal_cdf, polynomial, probit, rank_sum_null, signed_rank_null, t_tail, tail
from ..functions.hashing import signs
from ..functions.session import cut


def _missing(value: str) -> Column:
    return F.bool_or(F.col(value).isNull() | F.isnan(F.col(value).cast("double")))


def ttest_1samp(df: DataFrame, keys: Sequence[str], value: str, mu: float, alternative: str = "two-sided", exact: bool = True) -> DataFrame:
    """(keys, n, stat, p): one-sample t; a missing value makes both null, as does a constant sample."""
    m = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"), _missing(value).alias("miss"))
    stat = F.when(~F.col("miss") & (F.col("s") > 0), (F.col("m") - mu) / (F.col("s") / F.sqrt("n")))
    out = m.select(*keys, "n", stat.alias("stat"))
    p = t_tail(alternative)(F.col("stat"), (F.col("n") - 1).cast("double")) if exact else tail(F.col("stat"), alternative)
    return out.withColumn("p", p)


def signed_ranks(df: DataFrame, keys: Sequence[str], value: str, mu: float) -> DataFrame:
    """(keys, n, w, mean, sd, ties, zeros, n_all, miss) of the differences from ``mu``: mid-ranks of those that aren't zero."""
    w = Window.partitionBy(*keys, "_z").orderBy("_a")
    d = df.withColumn("_d", F.col(value) - F.lit(float(mu))).withColumn("_z", F.coalesce(F.col("_d") == 0, F.lit(True))).withColumn("_a", F.round(F.abs("_d"), 12))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_z", "_a"))
    r = d.withColumn("_t", same).withColumn("_r", F.rank().over(w) + (F.col("_t") - 1) / 2.0)
    used = ~F.col("_z")
    g = r.groupBy(*keys).agg(
        F.sum(used.cast("long")).alias("n"), F.coalesce(F.sum(F.when(used & (F.col("_d") > 0), F.col("_r"))), F.lit(0.0)).alias("w"),
        F.coalesce(F.sum(F.when(used, F.col("_t") * F.col("_t") - 1)), F.lit(0)).alias("ties"),
        F.sum((F.col("_z") & (F.col("_d") == 0)).cast("long")).alias("zeros"), F.count(F.lit(1)).alias("n_all"), F.avg("_d").alias("mean_d"), _missing(value).alias("miss"),
    )
    n = F.col("n")
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - F.col("ties") / 48.0
    return g.withColumn("mean", n * (n + 1) / 4.0).withColumn("sd", F.sqrt(variance))


def wilcoxon_1samp(df: DataFrame, keys: Sequence[str], value: str, mu: float, alternative: str = "two-sided", method: str = "approx", most: int = 50) -> DataFrame:
    """(keys, stat, p): W+ and its p. Zeros are dropped; all zero gives (0, 1); a missing value gives nulls.

    ``exact`` uses the null distribution for up to ``most`` differences without zeros and ties, and the normal one beyond.
    """
    r = signed_ranks(df, keys, value, mu)
    p = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(tail((F.col("w") - F.col("mean")) / F.col("sd"), alternative))
    if method == "exact":
        table = df.sparkSession.createDataFrame(signed_rank_null(most), "n long, below array<double>")
        r = r.join(F.broadcast(table), "n", "left")
        w = F.col("w").cast("int")
        less, greater = F.get("below", w), F.lit(1.0) - F.coalesce(F.get("below", w - 1), F.lit(0.0))
        exact = {"less": less, "greater": greater, "two-sided": F.least(F.lit(1.0), 2 * F.least(less, greater))}[alternative]
        p = F.when((F.col("zeros") == 0) & (F.col("ties") == 0) & F.col("below").isNotNull(), exact).otherwise(p)
    return r.select(*keys, F.when(~F.col("miss"), F.col("w")).alias("stat"), F.when(~F.col("miss"), p).alias("p"))


def wilcoxon_z(df: DataFrame, keys: Sequence[str], value: str, mu: float = 0.0) -> DataFrame:
    """(keys, z): the normalised signed rank; with fewer than three differences, mean * sqrt(n)."""
    r = signed_ranks(df, keys, value, mu)
    return r.select(*keys, F.when(F.col("n") < 3, F.col("mean_d") * F.sqrt("n_all")).otherwise((F.col("w") - F.col("mean")) / F.col("sd")).alias("z"))


def wilcoxon_paired(conn: DataFrame, a: str, b: str, protocol: str = "protocol") -> DataFrame:
    """(ch_i, ch_j, stat, p) of each pair's difference between two protocols over subjects: the smaller rank sum."""
    side = lambda v: F.max(F.when(F.col(protocol) == v, F.col("value")))
    diff = conn.where(F.col(protocol).isin(a, b)).groupBy("subject", "ch_i", "ch_j").agg(side(a).alias("_x"), side(b).alias("_y")).where("_x is not null and _y is not null").withColumn("d", F.col("_x") - F.col("_y"))
    r = signed_ranks(diff, ["ch_i", "ch_j"], "d", 0.0)
    p = F.when(F.col("n") == 0, F.lit(1.0)).otherwise(tail((F.col("w") - F.col("mean")) / F.col("sd"), "two-sided"))
    return r.select("ch_i", "ch_j", F.least("w", 2 * F.col("mean") - F.col("w")).alias("stat"), p.alias("p"))


def mann_whitney_pairs(df: DataFrame, grp: str, value: str, keys: Sequence[str] = (), exact: int = 0) -> DataFrame:
    """Every pair of groups: n, means, deviations, U of the first and two-sided p.

    Normal with ties and continuity; ``exact`` > 0 uses the null distribution for groups of up to so many without ties.
    """
    names = df.select(*keys, grp).distinct()
    pairs = names.withColumnRenamed(grp, "g1").join(names.withColumnRenamed(grp, "g2"), list(keys)) if keys else names.withColumnRenamed(grp, "g1").crossJoin(names.withColumnRenamed(grp, "g2"))
    pairs = pairs.where("g1 < g2")  # groups, not rows
    sided = pairs.withColumn(grp, F.explode(F.array("g1", "g2")))
    both = df.join(sided, [*keys, grp]).where(F.col(value).isNotNull()).withColumn("_one", F.col(grp) == F.col("g1"))
    own = [*keys, "g1", "g2"]
    same = F.count(F.lit(1)).over(Window.partitionBy(*own, value))
    ranked = both.withColumn("_t", same).withColumn("_r", F.rank().over(Window.partitionBy(*own).orderBy(value)) + (F.col("_t") - 1) / 2.0)
    of = lambda f, one: f(F.when(F.col("_one") == one, F.col(value)))
    g = ranked.groupBy(*own).agg(
        of(F.count, True).alias("n1"), of(F.count, False).alias("n2"), of(F.avg, True).alias("mean1"), of(F.avg, False).alias("mean2"), of(F.stddev_pop, True).alias("sd1"), of(F.stddev_pop, False).alias("sd2"),
        F.sum(F.when(F.col("_one"), F.col("_r"))).alias("r1"), F.sum(F.col("_t") * F.col("_t") - 1).alias("ties"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    g = g.where("n1 > 0 and n2 > 0").withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2.0)
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.greatest("u", n1 * n2 - F.col("u")) - n1 * n2 / 2.0 - 0.5) / sd
    p = F.when(sd > 0, F.least(F.lit(1.0), 2 * (F.lit(1.0) - normal_cdf(z)))).otherwise(F.lit(1.0))
    if exact:
        table = df.sparkSession.createDataFrame(rank_sum_null(exact), "n1 long, n2 long, below array<double>")
        g = g.join(F.broadcast(table), ["n1", "n2"], "left")
        low = F.least("u", n1 * n2 - F.col("u")).cast("int")
        p = F.when((F.col("ties") == 0) & F.col("below").isNotNull(), F.least(F.lit(1.0), 2 * F.get("below", low))).otherwise(p)
    return g.select(*own, "n1", "n2", "mean1", "mean2", "sd1", "sd2", "u", p.alias("p"))


def fdr_bh(df: DataFrame, keys: Sequence[str], p: str, alpha: float = 0.05, harmonic: bool = False) -> DataFrame:
    """Adds p_fdr and sig within each group; missing p-values stay missing and don't count."""
    parts = [F.col(k) for k in keys] if keys else [F.lit(0)]
    v = F.nanvl(F.col(p).cast("double"), F.lit(None))
    d = df.withColumn("_p", v).withColumn("_use", v.isNotNull())
    w = Window.partitionBy(*parts, "_use")
    n = F.count(F.lit(1)).over(w)
    d = d.withColumn("_n", n).withColumn("_k", F.row_number().over(w.orderBy("_p")))
    factor = F.aggregate(F.sequence(F.lit(1), F.col("_n").cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k) if harmonic else F.lit(1.0)
    d = d.withColumn("_q", F.col("_p") * F.col("_n") / F.col("_k") * factor)
    d = d.withColumn("p_fdr", F.when(F.col("_use"), F.least(F.lit(1.0), F.min("_q").over(w.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)))))
    return d.withColumn("sig", F.coalesce(F.col("p_fdr") < alpha, F.lit(False))).drop("_p", "_use", "_n", "_k", "_q")


def fdr_by(df: DataFrame, keys: Sequence[str], p: str, alpha: float = 0.05) -> DataFrame:
    """As fdr_bh, times the harmonic number of the group's size."""
    return fdr_bh(df, keys, p, alpha, harmonic=True)


def jarque_bera(value: str) -> tuple[Column, Column]:
    """The statistic and its p (chi-squared with two degrees: exp(-x / 2))."""
    n, s, k = F.count(value), F.skewness(value), F.kurtosis(value)
    stat = n / 6.0 * (s * s + k * k / 4.0)
    return stat, F.exp(-stat / 2)


# Fixed values of Royston's approximation (AS R94): the two outer coefficients by 1 / sqrt(n), and mean and deviation of the
# transformed statistic by n (up to 11) and by log n.
OUTER = ((0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
SMALL_LIMIT, SMALL_MEAN, SMALL_SD = (-2.273, 0.459), (0.5440, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)
#: Values up to which the approximation holds.
MOST_VALUES = 5000


def shapiro_wilk(df: DataFrame, keys: Sequence[str], value: str, most: int | None = MOST_VALUES) -> DataFrame:
    """(keys, n, w, p): the Shapiro-Wilk statistic by Royston's coefficients and transform, for 3 to ``most`` values (None: any number); else, and for constant ones, null.

    The expected normal order statistics are columns of the ranks, and a group's sums give the statistic: missing values don't count.
    """
    own = [F.col(k) for k in keys] if keys else [F.lit(0)]
    by = Window.partitionBy(*own)
    known = df.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias("_x")).where("_x is not null")
    ranked = known.withColumn("_i", F.row_number().over(by.orderBy("_x"))).withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_d", F.col("_x") - F.avg("_x").over(by))
    at = ranked.withColumn("_m", probit((F.col("_i") - 0.375) / (F.col("_n") + 0.25)))
    edge = lambda place, c: F.max(F.when(F.col("_i") == place, F.col(c)))
    n = F.col("_n")
    g = at.groupBy(*keys).agg(
        F.max("_n").alias("n"), F.sum(F.col("_m") * F.col("_m")).alias("_q"), F.sum(F.col("_m") * F.col("_x")).alias("_mx"), F.sum(F.col("_d") * F.col("_d")).alias("_ss"),
        edge(n, "_m").alias("_m1"), edge(n - 1, "_m").alias("_m2"), (edge(n, "_x") - edge(F.lit(1), "_x")).alias("_r1"), (edge(n - 1, "_x") - edge(F.lit(2), "_x")).alias("_r2"),
    )
    w, p = _royston()
    held = F.lit(True) if most is None else F.col("n") <= most
    g = g.withColumn("w", F.when((F.col("n") >= 3) & held & (F.col("_ss") > 1e-300), F.least(F.lit(1.0), w)))
    return g.select(*keys, "n", "w", p.alias("p"))


def _royston() -> tuple[Column, Column]:
    """W from n, the sums _q, _mx, _ss and the outer order statistics, and p from W."""
    n, q = F.col("n"), F.col("_q")
    u, m1, m2 = 1 / F.sqrt(n), F.col("_m1"), F.col("_m2")
    a1 = F.when(n == 3, F.lit(0.5**0.5)).otherwise(m1 / F.sqrt(q) + polynomial(OUTER[0], u))
    a2 = m2 / F.sqrt(q) + polynomial(OUTER[1], u)
    rest = F.col("_mx") - m1 * F.col("_r1")
    few = F.sqrt((q - 2 * m1 * m1) / (1 - 2 * a1 * a1))
    many = F.sqrt((q - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
    b = a1 * F.col("_r1") + F.when(n == 3, F.lit(0.0)).when(n <= 5, rest / few).otherwise(a2 * F.col("_r2") + (rest - m2 * F.col("_r2")) / many)
    y, log_n, w = F.log(F.greatest(F.lit(1e-300), 1 - F.col("w"))), F.log(n.cast("double")), F.col("w")
    small = -F.log(polynomial(SMALL_LIMIT, n) - y)
    z = F.when(n <= 11, (small - polynomial(SMALL_MEAN, n)) / F.exp(polynomial(SMALL_SD, n))).otherwise((y - polynomial(LARGE_MEAN, log_n)) / F.exp(polynomial(LARGE_SD, log_n)))
    three = F.greatest(F.lit(0.0), 6 / F.lit(np.pi) * (F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75)))))
    p = F.when(w.isNull(), F.lit(None)).when(n == 3, three).when((n <= 11) & (y >= polynomial(SMALL_LIMIT, n)), F.lit(0.0)).otherwise(1 - normal_cdf(z))
    return b * b / F.col("_ss"), p


def normality(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, ks, ad, jb, jb_p, normal): distances of the standardised values from the normal distribution."""
    w = Window.partitionBy(*keys)
    z = df.where(F.col(value).isNotNull()).withColumn("_z", (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w))
    r = z.withColumn("_i", F.row_number().over(w.orderBy("_z"))).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_f", F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), normal_cdf(F.col("_z")))))
    i, n, f = F.col("_i"), F.col("_n"), F.col("_f")
    back = F.row_number().over(w.orderBy(F.col("_z").desc()))
    r = r.withColumn("_j", back)
    term = (2 * i - 1) * F.log(f) + (2 * F.col("_j") - 1) * F.log(1 - f)
    stat, p = jarque_bera(value)
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.greatest(i / n - f, f - (i - 1) / n)).alias("ks"), F.sum(term).alias("_s"), stat.alias("jb"), p.alias("jb_p"))
    return g.select(*keys, "n", "ks", (-F.col("n") - F.col("_s") / F.col("n")).alias("ad"), "jb", "jb_p", (F.col("jb_p") > 0.05).alias("normal"))


def adaptive_test(df: DataFrame, keys: Sequence[str], value: str, mu: float, alternative: str = "two-sided", exact: bool = True, normal: str = "shapiro", most: int | None = MOST_VALUES) -> DataFrame:
    """(keys, test, stat, p): t for small samples, for many zeros and for normal ones, else the signed rank.

    ``normal`` tells what normal ones are: those of a Shapiro-Wilk p above 0.05 (``shapiro``; of more than ``most`` values by
    the other rule), or of a Jarque-Bera p above it (``jb``).
    """
    _, jb = jarque_bera(value)
    shape = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg((F.col(value) == mu).cast("double")).alias("_zeros"), jb.alias("_p"))
    if normal == "shapiro":
        shape = shape.join(shapiro_wilk(df, keys, value, most).select(*keys, F.col("p").alias("_sw")), list(keys), "left").withColumn("_p", F.coalesce("_sw", "_p"))
    use_t = (F.col("_n") < 5) | (F.col("_zeros") > 0.5) | (F.col("_p") > 0.05)
    t = ttest_1samp(df, keys, value, mu, alternative, exact).select(*keys, F.col("stat").alias("_ts"), F.col("p").alias("_tp"))
    w = wilcoxon_1samp(df, keys, value, mu, alternative).select(*keys, F.col("stat").alias("_ws"), F.col("p").alias("_wp"))
    both = shape.join(t, list(keys)).join(w, list(keys))
    return both.select(*keys, F.when(use_t, "ttest").otherwise("wilcoxon").alias("test"), F.when(use_t, F.col("_ts")).otherwise(F.col("_ws")).alias("stat"), F.when(use_t, F.col("_tp")).otherwise(F.col("_wp")).alias("p"))


def pointwise_fdr(df: DataFrame, keys: Sequence[str], point: Sequence[str], value: str, mu: float, test: str = "wilcoxon", alternative: str = "greater", alpha: float = 0.05) -> DataFrame:
    """A test for each point, then false discovery rates over the points of each key."""
    run = {"ttest": ttest_1samp, "wilcoxon": wilcoxon_1samp, "adaptive": adaptive_test}[test]
    return fdr_bh(run(df, [*keys, *point], value, mu, alternative), keys, "p", alpha)


#: Flips that are worked out at once.
BLOCK = 16


def t_value(n: Column, square: Column, signed: Column) -> Column:
    """One-sample t of flipped values from their number, the sum of squares and the flipped sum; not a number for fewer than two and for constant ones."""
    variance = (square - signed * signed / n) / (n - 1)
    return F.when((n > 1) & (variance > 1e-18), signed / n / F.sqrt(variance / n)).otherwise(F.lit(float("nan")))


def mean_value(n: Column, square: Column, signed: Column) -> Column:
    return F.when(n > 0, signed / n).otherwise(F.lit(float("nan")))


def rank_z(n: Column, square: Column, signed: Column) -> Column:
    """The normalised signed rank of flipped signed ranks: flips leave the ranks as they are."""
    return F.when(square > 0, signed / F.sqrt(square)).otherwise(F.lit(float("nan")))


def mid_ranks(d: DataFrame, own: Sequence[str], value: str) -> DataFrame:
    """``value`` as signed mid-ranks among those of the same point; zeros and missing ones are missing."""
    kept = d.withColumn("_a", F.when(F.col(value) != 0, F.round(F.abs(value), 12)))
    same = Window.partitionBy(*own, "_a")
    rank = F.rank().over(Window.partitionBy(*own).orderBy(F.col("_a").asc_nulls_last())) + (F.count(F.lit(1)).over(same) - 1) / 2.0
    return kept.withColumn(value, F.when(F.col("_a").isNotNull(), F.signum(value) * rank)).drop("_a")


#: Statistics: what becomes of the values before flips, and the statistic as a column from (number, sum of squares, flipped sum).
Statistic = str | tuple[Callable, Callable]
STATISTICS: dict[str, tuple[Callable, Callable]] = {"t": (lambda d, own, value: d, t_value), "mean": (lambda d, own, value: d, mean_value), "wilcoxon": (mid_ranks, rank_z)}
#: Units of a row, and bytes of signs that a task keeps.
UNITS, KEPT = 2048, 32 << 20


class Signs:
    """The signs of units in all flips, as bits; those of the last list of units also as numbers."""

    def __init__(self, seed: int, n: int):
        self.seed, self.n, self.words, self.last = seed, n, {}, (None, None)

    def of(self, names: list[str]) -> np.ndarray:
        """Units x flips, 1 or -1; flip 0 is what was observed."""
        if self.last[0] != names:
            if len(self.words) * self.n // 8 > KEPT:
                self.words.clear()
            for u in names:
                if u not in self.words:
                    self.words[u] = np.packbits(signs(u, self.seed, range(self.n)) < 0)
            bits = np.unpackbits(np.stack([self.words[u] for u in names]), axis=1, count=self.n)
            self.last = names, 1.0 - 2.0 * bits
        return self.last[1]


def flipped(df: DataFrame, keys: Sequence[str], point: Sequence[str], unit: str, value: str, mu: float, n_perm: int, seed: int, stat: Statistic = "t", units: int = UNITS) -> DataFrame:
    """(keys, point, block, maps): the statistic of each point under the flips of each block; flip 0 is what was observed.

    Signs depend on the unit's text alone, so ids may be numbers or text. A row holds at most about ``units`` units of a
    point; where a point has more, the sums of its rows meet before the statistic.
    """
    before, statistic = STATISTICS[stat] if isinstance(stat, str) else stat
    own = [*keys, *point]
    d = df.select(*own, F.col(unit).cast("string").alias("_unit"), F.nanvl((F.col(value) - F.lit(float(mu))).cast("double"), F.lit(None)).alias("_d"))
    d = before(d, own, "_d")
    counts = d.groupBy(*own).agg(F.ceil(F.count(F.lit(1)) / units).alias("_rows"))
    many = (counts.agg(F.max("_rows")).first()[0] or 0) > 1
    if many:
        d = d.join(counts, own).withColumn("_part", F.pmod(F.xxhash64("_unit"), "_rows"))
    vectors = d.groupBy(*own, *(["_part"] if many else [])).agg(F.array_sort(F.collect_list(F.struct("_unit", "_d"))).alias("_v"))
    blocks = range(0, n_perm + 1, BLOCK)
    types = dict(vectors.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in own) + ", block int, n long, square double, signed array<double>"

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Signs(seed, n_perm + 1)
        for b in batches:
            flat = b.column(b.schema.get_field_index("_v"))
            ends, inner = flat.offsets.to_numpy(), flat.values
            names, values = inner.field(0), inner.field(1).to_numpy(zero_copy_only=False)
            sums, n, square = [], [], []
            for at, end in zip(ends[:-1], ends[1:], strict=True):
                x = values[at:end]
                n.append(int(np.count_nonzero(~np.isnan(x))))
                square.append(float(np.nansum(x * x)))
                sums.append(np.nan_to_num(x) @ known.of(names.slice(at, end - at).to_pylist()))
            columns = [b.column(b.schema.get_field_index(c)) for c in own]
            for k, first in enumerate(blocks):
                parts = [pa.array([k] * len(b), pa.int32()), pa.array(n, pa.int64()), pa.array(square, pa.float64()), pa.array([x[first : first + BLOCK] for x in sums], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*columns, *parts], [*own, "block", "n", "square", "signed"])

    sums = vectors.mapInArrow(mapped, schema)
    if many:
        total = [F.sum(F.get("signed", F.lit(k))).alias(f"_s{k}") for k in range(BLOCK)]
        whole = sums.groupBy(*own, "block").agg(F.sum("n").alias("n"), F.sum("square").alias("square"), *total)
        sums = whole.withColumn("signed", F.filter(F.array(*[f"_s{k}" for k in range(BLOCK)]), lambda x: x.isNotNull()))
    return sums.select(*own, "block", F.transform("signed", lambda x: statistic(F.col("n"), F.col("square"), x)).alias("maps"))


def _largest(maps: DataFrame, keys: Sequence[str], point: Sequence[str], prepare: Callable) -> DataFrame:
    """(keys, null): for each key the sorted largest values of its flips, that of the observed one left out.

    ``prepare`` gets the points' places (rows) and gives what finds the largest from one value for each; a task has one block of
    flips of one key.
    """
    types, place = dict(maps.dtypes), list(point)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place)
        places, values = pdf[place].to_numpy(), np.stack(pdf["maps"])
        first, largest = int(pdf["block"].iloc[0]) * BLOCK, prepare(places)
        found = [(first + k, largest(values[:, k])) for k in range(values.shape[1]) if first + k]
        out = pd.DataFrame({"m": [round(m, 9) for _, m in found if m is not None]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "m"]]

    schema = "".join(f"`{k}` {types[k]}, " for k in keys) + "m double"
    each = maps.groupBy(*keys, "block").applyInPandas(one, schema)
    return each.groupBy(*keys).agg(F.array_sort(F.collect_list("m")).alias("null"))  # one number a flip


def _against(seen: DataFrame, null: DataFrame, keys: Sequence[str], value: str, n_perm: int) -> DataFrame:
    """``seen`` with p: the share of flips, the observed one among them, whose largest value isn't below."""
    above = F.coalesce(F.size(F.filter("null", lambda m: m >= F.round(F.abs(F.col(value)), 9))), F.lit(0))
    return seen.join(null, list(keys), "left").withColumn("p", (above + 1) / (n_perm + 1.0)).drop("null")


def _keyed(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A table without keys gets one that is the same everywhere."""
    return (df, list(keys)) if keys else (df.withColumn("_all", F.lit(0)), ["_all"])


def _observed(maps: DataFrame, keys: Sequence[str], point: Sequence[str]) -> DataFrame:
    stat = F.get("maps", F.lit(0))
    return maps.where("block = 0").select(*keys, *point, F.when(~F.isnan(stat), stat).alias("tval"))


def permutation_ttest(df: DataFrame, keys: Sequence[str], point: Sequence[str], n_perm: int = 1000, seed: int = 0, unit: str = "subject", value: str = "value", mu: float = 0.0, stat: Statistic = "t") -> DataFrame:
    """(keys, point, t, p): against the largest absolute statistic over all points of each flip; the observed one counts."""
    df, own = _keyed(df, keys)
    maps = cut(flipped(df, own, point, unit, value, mu, n_perm, seed, stat))
    null = _largest(maps, own, point, lambda places: lambda v: float(np.nanmax(np.abs(v))) if not np.isnan(v).all() else None)
    seen = _against(_observed(maps, own, point), null, own, "tval", n_perm)
    return seen.select(*keys, *point, F.col("tval").alias("t"), F.when(F.col("tval").isNotNull(), F.col("p")).alias("p"))


def islands(t: DataFrame, keys: Sequence[str], point: str, stat: str, threshold: float, alternative: str) -> DataFrame:
    """(keys, cluster, t_start, t_end, n, mass): runs of consecutive points beyond the threshold, on one side each."""
    side = F.when(F.col(stat) > threshold, F.lit(1)) if alternative != "less" else F.lit(None).cast("int")
    if alternative in ("two-sided", "less"):
        side = F.coalesce(side, F.when(F.col(stat) < -threshold, F.lit(-1)))
    beyond = t.withColumn("_side", side).where(F.col("_side").isNotNull())
    run = F.col(point) - F.row_number().over(Window.partitionBy(*keys, "_side").orderBy(point))
    g = beyond.withColumn("_run", run).groupBy(*keys, "_side", "_run").agg(F.min(point).alias("t_start"), F.max(point).alias("t_end"), F.count(F.lit(1)).alias("n"), F.sum(stat).alias("mass"))
    return g.withColumn("cluster", F.row_number().over(Window.partitionBy(*keys).orderBy("t_start")).cast("long")).drop("_side", "_run")


def tfce_map(t: DataFrame, keys: Sequence[str], point: str, start: float = 0.1, step: float = 0.1, e: float = 0.5, h: float = 2.0) -> DataFrame:
    """(keys, point, tfce): the sum over heights below tval of extent^e * height^h * step, on the positive side."""
    levels = t.where(F.col("tval") >= start).withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("tval") - start) / step + 1e-9).cast("int"))))
    run = F.col(point) - F.row_number().over(Window.partitionBy(*keys, "_k").orderBy(point))
    marked = levels.withColumn("_run", run)
    extent = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_k", "_run"))
    share = F.pow(extent.cast("double"), F.lit(e)) * F.pow(F.lit(start) + F.col("_k") * step, F.lit(h)) * step
    return marked.withColumn("_s", share).groupBy(*keys, point).agg(F.sum("_s").alias("tfce"))


def neighbours(places: np.ndarray, adjacency: Sequence[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of cells that touch: a step apart on one axis of whole numbers, or by ``adjacency``, pairs of places of one axis."""
    if adjacency is not None:
        order = np.argsort(places[:, 0], kind="stable")
        place = places[order, 0]
        pairs = np.array(list(adjacency)).reshape(-1, 2)
        at = np.minimum(np.searchsorted(place, pairs), len(place) - 1)
        known = (place[at] == pairs).all(1)
        return order[at[known, 0]], order[at[known, 1]]
    ranks, stride, strides = np.zeros(len(places), np.int64), 1, []
    for axis in range(places.shape[1]):
        values, own = np.unique(places[:, axis], return_inverse=True)
        apart = np.cumsum(np.minimum(np.diff(values, prepend=values[:1]), 2))  # a gap is a step of two
        ranks += apart[own].astype(np.int64) * stride
        strides.append(stride)
        stride *= int(apart[-1]) + 2
    order = np.argsort(ranks)
    ranked = ranks[order]
    pairs = []
    for step in strides:
        at = np.minimum(np.searchsorted(ranked, ranks + step), len(ranked) - 1)
        met = ranked[at] == ranks + step
        pairs.append((np.flatnonzero(met), order[at[met]]))
    return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))


def joined(n: int, a: np.ndarray, b: np.ndarray, side: np.ndarray) -> np.ndarray:
    """A name for the cluster of each of ``n`` cells, its first cell: neighbours (a, b) on one side (1 or -1; 0 is none) belong together.

    All pairs that are still apart at once hang the later root on the earlier one, then every cell goes to its root.
    """
    root = np.arange(n)
    own = (side[a] == side[b]) & (side[a] != 0)
    a, b = a[own], b[own]
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _sides(values: np.ndarray, threshold: float, alternative: str) -> np.ndarray:
    v = np.nan_to_num(values)
    return np.where((v > threshold) & (alternative != "less"), 1, np.where((v < -threshold) & (alternative != "greater"), -1, 0))


def largest_mass(threshold: float, alternative: str, adjacency: Sequence[tuple[int, int]] | None = None) -> Callable:
    """For ``_largest``: the largest absolute mass of a map's clusters, none without any."""

    def prepare(places: np.ndarray) -> Callable:
        a, b = neighbours(places, adjacency)

        def largest(values: np.ndarray) -> float | None:
            side = _sides(values, threshold, alternative)
            beyond = np.flatnonzero(side)
            if not len(beyond):
                return None
            return float(np.abs(np.bincount(joined(len(values), a, b, side)[beyond], values[beyond])).max())

        return largest

    return prepare


def cluster_permutation(df: DataFrame, keys: Sequence[str], point: str, mu: float, n_perm: int = 1024, threshold: float = 1.7, alternative: str = "two-sided", stat: Statistic = "t", seed: int = 0, unit: str = "subject", value: str = "score") -> DataFrame:
    """(keys, cluster, t_start, t_end, n, mass, p): each run's mass against the largest mass of each flip.

    ``point`` is a gapless integer axis. Flips without any run count as mass 0; the observed map counts too.
    """
    df, own = _keyed(df, keys)
    maps = cut(flipped(df, own, [point], unit, value, mu, n_perm, seed, stat))
    null = _largest(maps, own, [point], largest_mass(threshold, alternative))
    runs = islands(_observed(maps, own, [point]), own, point, "tval", threshold, alternative)
    return _against(runs, null, own, "mass", n_perm).select(*keys, "cluster", "t_start", "t_end", "n", "mass", "p")


def cluster_matrix(df: DataFrame, keys: Sequence[str], axes: Sequence[str], mu: float, n_perm: int = 1024, threshold: float = 1.7, alternative: str = "two-sided", stat: Statistic = "t", seed: int = 0, unit: str = "subject", value: str = "score", adjacency: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """(keys, axes, stat, cluster, n, mass, p) of each cell beyond the threshold: its cluster, named by the first cell's rank in the map.

    ``axes`` are one or two axes of whole numbers, in which neighbours are a step apart, or one axis whose neighbours
    ``adjacency`` names (channels). A task holds one map's cells for a block of flips.
    """
    df, own = _keyed(df, keys)
    maps = cut(flipped(df, own, axes, unit, value, mu, n_perm, seed, stat))
    null = _largest(maps, own, axes, largest_mass(threshold, alternative, adjacency))
    seen, place, types = _observed(maps, own, axes), list(axes), dict(maps.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place).reset_index(drop=True)
        side = _sides(pdf["tval"].to_numpy(float), threshold, alternative)
        pdf = pdf[side != 0].reset_index(drop=True)
        pdf["cluster"] = joined(len(pdf), *neighbours(pdf[place].to_numpy(), adjacency), side[side != 0]).astype("int64") if len(pdf) else 0
        pdf["n"] = pdf.groupby("cluster")["cluster"].transform("size").astype("int64")
        pdf["mass"] = pdf.groupby("cluster")["tval"].transform("sum").astype(float)
        return pdf[[*own, *place, "tval", "cluster", "n", "mass"]]

    schema = ", ".join(f"`{c}` {types[c]}" for c in (*own, *place)) + ", tval double, cluster long, n long, mass double"
    found = _against(seen.groupBy(*own).applyInPandas(one, schema), null, own, "mass", n_perm)
    return found.select(*keys, *axes, F.col("tval").alias("stat"), "cluster", "n", "mass", "p")


def enhanced(places: np.ndarray, values: np.ndarray, start: float, step: float, e: float, h: float) -> np.ndarray:
    """The sum over heights below each value of extent^e * height^h * step, on the positive side of one axis."""
    out, axis = np.zeros(len(values)), places[:, 0]
    v = np.nan_to_num(values)
    for k in range(int(np.floor((v.max(initial=0) - start) / step + 1e-9)) + 1 if v.max(initial=0) >= start else 0):
        over = np.flatnonzero((v >= start) & (np.floor((v - start) / step + 1e-9) >= k))
        run = np.cumsum(np.diff(axis[over], prepend=axis[over][:1] - 1) != 1)
        extent = np.bincount(run)[run]
        out[over] += extent.astype(float) ** e * (start + k * step) ** h * step
    return out


def tfce(df: DataFrame, keys: Sequence[str], point: str, start: float = 0.1, step: float = 0.1, mu: float = 0.0, n_perm: int = 200, seed: int = 0, unit: str = "subject", value: str = "score", stat: Statistic = "t", e: float = 0.5, h: float = 2.0) -> DataFrame:
    """(keys, point, tfce, p): the enhanced map against the largest enhanced value of each flip; points at 0 are left out."""
    df, own = _keyed(df, keys)
    maps = cut(flipped(df, own, [point], unit, value, mu, n_perm, seed, stat))
    null = _largest(maps, own, [point], lambda places: lambda v: float(enhanced(places, v, start, step, e, h).max(initial=0)) or None)
    seen = tfce_map(_observed(maps, own, [point]), own, point, start, step, e, h)
    return _against(seen, null, own, "tfce", n_perm).select(*keys, point, "tfce", "p")


def global_vs_chance(df: DataFrame, grp: str, value: str, mu: float, test: str = "wilcoxon") -> DataFrame:
    """(grp, n, mean, stat, p) of each group's values against chance, one-sided."""
    run = {"ttest": ttest_1samp, "wilcoxon": wilcoxon_1samp}[test](df, [grp], value, mu, "greater").select(grp, "stat", "p")
    return df.groupBy(grp).agg(F.count(value).alias("n"), F.avg(value).alias("mean")).join(run, grp)


def significance_stars(df: DataFrame, p: str) -> DataFrame:
    return df.withColumn("stars", F.when(F.col(p) < 0.001, "***").when(F.col(p) < 0.01, "**").when(F.col(p) < 0.05, "*").otherwise(""))


def cluster_p_map(points: DataFrame, cluster: DataFrame, default: float = 1.0, keys: Sequence[str] = (), point: str = "t") -> DataFrame:
    """(keys, point, p): the smallest p of the clusters that hold the point."""
    points, own = _keyed(points, keys)
    c = _keyed(cluster, keys)[0].select(*[F.col(k).alias(f"_{k}") for k in own], "t_start", "t_end", F.col("p").alias("_p"))
    hit = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_{k}") for k in own], F.col(point).between(F.col("t_start"), F.col("t_end")))
    return points.join(c, hit, "left").groupBy(*own, point).agg(F.coalesce(F.min("_p"), F.lit(default)).alias("p")).select(*keys, point, "p")


def combined_mask(points: DataFrame, cluster: DataFrame, alpha: float = 0.05, keys: Sequence[str] = (), point: str = "t") -> DataFrame:
    """(keys, point, sig): whether any cluster with p below alpha holds the point."""
    return cluster_p_map(points, cluster, 1.0, keys, point).select(*keys, point, (F.col("p") < alpha).alias("sig"))


def percent_significant(point_stat: DataFrame, keys: Sequence[str]) -> DataFrame:
    return point_stat.groupBy(*keys).agg((F.avg(F.col("sig").cast("int")) * 100).alias("percent"), F.sum(F.col("sig").cast("int")).alias("n_sig"))


def proportion_above(df: DataFrame, grp: str, value: str, limit: float) -> DataFrame:
    """(grp, n, n_above, share): how many subjects' values are above the limit."""
    g = df.groupBy(grp).agg(F.count(value).alias("n"), F.count_if(F.col(value) > limit).alias("n_above"))
    return g.withColumn("share", F.when(F.col("n") > 0, F.col("n_above") / F.col("n")))


def peak_pair(curve: DataFrame, keys: Sequence[str], min_gap_ms: float = 80.0, value: str = "score", t: str = "t_ms") -> DataFrame:
    """(keys, t1, peak1, t2, peak2): the highest local peak after 0 ms, and the highest at least ``min_gap_ms`` away from it."""
    w = Window.partitionBy(*keys).orderBy(t)
    local = curve.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).where((F.col(t) > 0) & (F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")))
    top = lambda v, u: F.max(F.struct(F.col(v).alias("v"), (-F.col(u)).alias("u")))
    first = local.groupBy(*keys).agg(top(value, t).alias("m")).select(*keys, (-F.col("m.u")).alias("t1"), F.col("m.v").alias("peak1"))
    rest = local.join(first, list(keys)).where(F.abs(F.col(t) - F.col("t1")) >= min_gap_ms).groupBy(*keys).agg(top(value, t).alias("m")).select(*keys, (-F.col("m.u")).alias("t2"), F.col("m.v").alias("peak2"))
    return first.join(rest, list(keys), "left")


def window_vs_chance(score: DataFrame, windows: DataFrame, subject_group: DataFrame | None, mu: float = 0.5) -> DataFrame:
    """(grp, window, stat, p): each group's window means against chance, two-sided."""
    rows = score.join(subject_group, "subject") if subject_group is not None else score
    means = rows.join(F.broadcast(windows), F.col("t").between(F.col("t0"), F.col("t1"))).groupBy("grp", "subject", "window").agg(F.avg("score").alias("score"))
    return wilcoxon_1samp(means, ["grp", "window"], "score", mu, "two-sided")


def matrix_fdr(tgm_score: DataFrame, keys: Sequence[str], alternative: str = "two-sided", value: str = "auc", mu: float = 0.5) -> DataFrame:
    """The signed-rank test at each (t_train, t_test), then false discovery rates over the matrix."""
    return pointwise_fdr(tgm_score, keys, ["t_train", "t_test"], value, mu, "wilcoxon", alternative)


def robust_limits(df: DataFrame, keys: Sequence[str], value: str, mu: float, q: float = 0.98) -> DataFrame:
    """(keys, low, high): chance less and plus the quantile of the distance from chance."""
    g = df.groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - mu), q).alias("r"))
    return g.select(*keys, (mu - F.col("r")).alias("low"), (mu + F.col("r")).alias("high"))


def label_summary(df: DataFrame, keys: Sequence[str], y: str) -> DataFrame:
    """(keys, y, n, percent) of each class."""
    n = df.groupBy(*keys, y).agg(F.count(F.lit(1)).alias("n"))
    parts = [F.col(k) for k in keys] if keys else [F.lit(0)]
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*parts)))


def islands_2d(t: DataFrame, keys: Sequence[str], a: str, b: str, stat: str, threshold: float, rounds: int = 40) -> DataFrame:
    """(keys, cluster, n, mass): components of a matrix's cells beyond the threshold, side by side and of one sign.

    Labels spread to the smallest neighbour, then jump to their label's label, so long shapes take few rounds; each round
    is cut by a checkpoint. A cluster is named by its smallest cell, a * 2^31 + b.
    """
    cells = t.where(F.abs(stat) > threshold).select(*keys, F.signum(stat).cast("int").alias("_side"), (F.col(a).cast("long") * F.lit(1 << 31) + F.col(b)).alias("_id"), F.col(stat).alias("_stat"))
    own = [*keys, "_side"]
    labels = cut(cells.withColumn("_label", F.col("_id")))
    last = None
    for _ in range(rounds):
        offers = labels.select(*own, F.explode(F.array(F.col("_id"), *[F.col("_id") + d for d in (1, -1, 1 << 31, -(1 << 31))])).alias("_id"), F.col("_label").alias("_offer"))
        least = labels.join(offers, [*own, "_id"]).groupBy(*own, "_id", "_stat").agg(F.min("_offer").alias("_label"))
        jump = least.select(*own, F.col("_id").alias("_label"), F.col("_label").alias("_next"))
        labels = cut(least.join(jump, [*own, "_label"]).select(*own, "_id", "_stat", F.least("_label", "_next").alias("_label")))
        now = labels.agg(F.sum(F.col("_label").cast("decimal(38,0)"))).first()[0]
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("clusters did not settle")
    return labels.groupBy(*own, "_label").agg(F.count(F.lit(1)).alias("n"), F.sum("_stat").alias("mass")).select(*keys, F.col("_label").alias("cluster"), "n", "mass")
