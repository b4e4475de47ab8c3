"""Resampling, paired tests, rank agreement and rater reliability.

Tables are reduced to a row for each cluster first; draws and sign permutations are then matrix work inside tasks
(`resampling`), the same for every group and metric.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from axisgauge.functions.lineage import cut
from axisgauge.functions.numeric import average_rank, safe_corr, spearman
from axisgauge.functions.quantiles import aggregated
from axisgauge.operators import absorption, concordance, ranks
from axisgauge.operators.resampling import draws, drawn_sums, sign_flips

__all__ = ["draws", "drawn_sums"]

#: Bootstrap replicates and sign permutations.
REPLICATES, PERMUTATIONS = 10_000, 100_000


def bootstrap_means(rows: DataFrame, by: list[str], metrics: list[str], stratum: str, cluster: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """by, metric, estimate, ci_lower, ci_upper, n: stratified cluster bootstrap of means of cluster means; nulls are
    left out of each draw's mean, and a group without values has n 0 and nulls."""
    means = cut(rows.groupBy(*by, stratum, cluster).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics]))
    each = drawn_sums(means, by, metrics, stratum, cluster, replicates, seed).select(*by, *[F.try_divide(F.col(m), F.col(f"{m}_w")).alias(m) for m in metrics])
    limits = [F.percentile(m, F.array(F.lit(0.025), F.lit(0.975))).alias(f"{m}_q") for m in metrics]
    found = means.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"{m}_n") for m in metrics]).join(each.groupBy(*by).agg(*limits), by) if by else (
        means.agg(*[F.avg(m).alias(m) for m in metrics], *[F.count(m).alias(f"{m}_n") for m in metrics]).crossJoin(F.broadcast(each.agg(*limits)))  # one row each
    )
    rows_of = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("estimate"), F.get(f"{m}_q", 0).alias("ci_lower"), F.get(f"{m}_q", 1).alias("ci_upper"), F.col(f"{m}_n").alias("n")) for m in metrics])
    return found.select(*by, F.inline(rows_of))


def bootstrap_ratio(rows: DataFrame, by: list[str], metric: str, cluster: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Row-weighted, unstratified: each draw is a ratio of sums over clusters."""
    sums = cut(rows.where(F.col(metric).isNotNull()).groupBy(*by, cluster).agg(F.sum(metric).alias("s"), F.count(F.lit(1)).alias("k")).withColumn("_all", F.lit("all")))
    each = drawn_sums(sums, by, ["s", "k"], "_all", cluster, replicates, seed).select(*by, F.try_divide("s", "k").alias("m"))
    ci = each.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("ci_lower"), F.percentile("m", F.lit(0.975)).alias("ci_upper"))
    return sums.groupBy(*by).agg((F.sum("s") / F.sum("k")).alias("estimate")).join(ci, by)


def bootstrap_pearson(rows: DataFrame, x: str, y: str, cluster: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """One row: Pearson correlation and its interval, from six sums for each cluster."""
    p = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    X, Y = F.col(x), F.col(y)
    sums = cut(p.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(X).alias("sx"), F.sum(Y).alias("sy"), F.sum(X * X).alias("sxx"), F.sum(Y * Y).alias("syy"), F.sum(X * Y).alias("sxy")).withColumn("_all", F.lit("all")))
    each = drawn_sums(sums, [], ["n", "sx", "sy", "sxx", "syy", "sxy"], "_all", cluster, replicates, seed)
    r = F.expr("try_divide(sxy - sx * sy / n, sqrt(greatest(sxx - sx * sx / n, 0D) * greatest(syy - sy * sy / n, 0D)))")
    ci = each.select(r.alias("r")).agg(F.percentile("r", F.lit(0.025)).alias("ci_lower"), F.percentile("r", F.lit(0.975)).alias("ci_upper"))
    return p.agg(safe_corr(x, y).alias("estimate"), F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(ci))  # one row each


def paired_differences(rows: DataFrame, by: list[str], model: str, unit: str, value: str) -> DataFrame:
    """For all pairs of models in a group, their difference on each unit that both have."""
    left = rows.select(*by, unit, F.col(model).alias("model_a"), F.col(value).alias("va"))
    right = rows.select(*by, unit, F.col(model).alias("model_b"), F.col(value).alias("vb"))
    return left.join(right, [*by, unit]).where("model_a < model_b").withColumn("difference", F.col("va") - F.col("vb")).drop("va", "vb")


def paired_summary(pairs: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "model_a", "model_b"]
    spread = F.stddev_samp("difference")
    return aggregated(cut(pairs), keys, [F.avg("difference").alias("mean_difference"), F.when(spread > 0, F.avg("difference") / spread).alias("dz"), F.count("difference").alias("n")], {"median_difference": ("difference", 0.5)})


def normal_tail(z: Column) -> Column:
    """Two-sided p value of a standard normal, by the error function's rational approximation (Abramowitz and Stegun
    7.1.26; absolute error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(z.isNotNull(), F.least(poly * F.exp(-x * x), F.lit(1.0)))


def wilcoxon(pairs: DataFrame, keys: list[str], value: str = "difference", zeros: str = "split") -> DataFrame:
    """Signed-rank statistic and two-sided p by the normal approximation with ties. zeros 'split' gives half of the
    zeros' ranks to each side and p 1 if nothing differs; 'drop' leaves zeros out and gives null then."""
    d = pairs.where(F.col(value).isNotNull())
    d = (d.where(F.col(value) != 0) if zeros == "drop" else d).withColumn("_abs", F.abs(F.col(value)))
    r = average_rank(d, "_abs", keys, "_r")
    tied = r.groupBy(*keys, "_abs").agg(F.count(F.lit(1)).alias("_t")).groupBy(*keys).agg(F.sum(F.when(F.col("_abs") > 0, F.pow("_t", F.lit(3)) - F.col("_t")).otherwise(0)).alias("ties"))
    s = r.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col(value) == 0).cast("double").alias("z"),
        F.sum(F.when(F.col(value) > 0, F.col("_r")).otherwise(0.0)).alias("plus"), F.sum(F.when(F.col(value) < 0, F.col("_r")).otherwise(0.0)).alias("minus"), F.sum(F.when(F.col(value) == 0, F.col("_r")).otherwise(0.0)).alias("zero"),
    )
    s = s.join(tied, keys).withColumn("statistic", F.least(F.col("plus"), F.col("minus")) + F.col("zero") / 2)
    mean = F.expr("n * (n + 1) / 4")
    var = F.expr("(n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1)) / 24 - ties / 48")
    p = F.when((F.col("n") == F.col("z")) | (var <= 0), F.lit(None if zeros == "drop" else 1.0).cast("double")).otherwise(normal_tail((F.col("statistic") - mean) / F.sqrt(F.when(var > 0, var))))
    return s.select(*keys, "statistic", p.alias("p_value"))


def holm(rows: DataFrame, family: list[str], p: str = "p_value", name: str = "p_holm") -> DataFrame:
    """Step-down adjustment inside each family, running maximum held at 1; null p values stay out."""
    w = Window.partitionBy(*family, F.col(p).isNull())
    m, rank = F.count(p).over(w), F.row_number().over(w.orderBy(p, *[c for c in rows.columns if c not in (p, *family)][:3]))
    step = rows.withColumn("_q", (m - rank + 1) * F.col(p)).withColumn("_k", rank)
    return step.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.max("_q").over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))).drop("_q", "_k")


def sign_flip(rows: DataFrame, by: list[str], item: str, value: str, replicates: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """Paired permutation p: share of hash-signed means at least as far from 0 as the observed one, plus one for it."""
    d = cut(rows.where(F.col(value).isNotNull()).select(*by, item, F.col(value).cast("double").alias("d")))
    observed = d.groupBy(*by).agg(F.avg("d").alias("mean"), F.count(F.lit(1)).alias("n"))
    flips = sign_flips(d, by, item, "d", replicates, seed).select(*by, "first", F.posexplode("sums").alias("k", "s")).where(F.col("first") + F.col("k") < replicates)
    both = flips.join(observed, by) if by else flips.crossJoin(F.broadcast(observed))  # one row
    hits = both.groupBy(*by, "mean").agg(F.count_if(F.abs(F.col("s") / F.col("n")) >= F.abs("mean") - 1e-15).alias("hits"))
    return hits.select(*by, "mean", ((F.col("hits") + 1) / F.lit(replicates + 1.0)).alias("p_value"))


def rank_agreement(rows: DataFrame, by: list[str], item: str, x: str, y: str) -> DataFrame:
    """Kendall's tau-b, ranking flips and number of pairs of any number of items in a group."""
    return concordance.rank_agreement(rows.where(F.col(item).isNotNull()), by, x, y)


def cohen_kappa(a: Column, b: Column) -> list[Column]:
    """Aggregates over complete pairs of booleans: n, raw agreement, kappa (null if expected agreement is 1)."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    agree, expected = F.avg(x * y + (1 - x) * (1 - y)), F.avg(x) * F.avg(y) + (1 - F.avg(x)) * (1 - F.avg(y))
    return [F.count(x).alias("n"), agree.alias("raw_agreement"), F.when(expected < 1, (agree - expected) / F.when(expected < 1, 1 - expected)).alias("kappa")]


def confusion(truth: Column, said: Column) -> list[Column]:
    both = truth.isNotNull() & said.isNotNull()
    tp, tn, fp, fn = (F.count_if(both & c) for c in (truth & said, ~truth & ~said, ~truth & said, truth & ~said))
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1")]


def icc(rows: DataFrame, by: list[str], item: str, rater: str, value: str) -> DataFrame:
    """ICC(A,1) and ICC(A,k) over the items that all of the group's raters have rated."""
    r = rows.where(F.col(value).isNotNull()).select(*by, item, rater, F.col(value).cast("double").alias("v"))
    k = r.groupBy(*by).agg(F.countDistinct(rater).alias("k"))
    complete = r.join(r.groupBy(*by, item).agg(F.countDistinct(rater).alias("own")), [*by, item]).join(k, by).where("own = k")
    g = complete.groupBy(*by).agg(F.avg("v").alias("m"), F.sum(F.col("v") ** 2).alias("ss"), F.max("k").alias("k"), F.countDistinct(item).alias("n"))
    si = complete.groupBy(*by, item).agg(F.avg("v").alias("im")).groupBy(*by).agg(F.sum(F.col("im") ** 2).alias("si"))
    sr = complete.groupBy(*by, rater).agg(F.avg("v").alias("rm")).groupBy(*by).agg(F.sum(F.col("rm") ** 2).alias("sr"))
    j = g.join(si, by).join(sr, by).where("n > 1 and k > 1")
    j = j.selectExpr(*by, "n", "k", "k * (si - n * m * m) / (n - 1) msr", "n * (sr - k * m * m) / (k - 1) msc", "(ss - k * si - n * sr + n * k * m * m) / ((n - 1) * (k - 1)) mse")
    return j.selectExpr(*by, "n", "k", "try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n) icc_a1", "try_divide(msr - mse, msr + (msc - mse) / n) icc_ak")


def krippendorff(rows: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """Alpha for interval ratings, over items with two ratings or more."""
    v = F.col(value).cast("double")
    u = rows.where(F.col(value).isNotNull()).withColumn("_v", v).withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*by, item))).where("_k > 1")
    observed = u.groupBy(*by, item).agg((2 * (F.count(F.lit(1)) * F.sum(F.col("_v") ** 2) - F.sum("_v") ** 2) / (F.count(F.lit(1)) - 1)).alias("d")).groupBy(*by).agg(F.sum("d").alias("d"))
    expected = u.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (2 * F.var_samp("_v")).alias("e"))
    return observed.join(expected, by).select(*by, "n", F.when(F.col("e") > 0, 1 - F.col("d") / F.col("n") / F.when(F.col("e") > 0, F.col("e"))).alias("alpha"))


def fleiss(rows: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """Kappa of binary ratings over items with two ratings or more."""
    i = rows.where(F.col(value).isNotNull()).groupBy(*by, item).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col(value).cast("int") == 1).alias("a")).where("k > 1")
    g = i.groupBy(*by).agg(F.avg(F.expr("(a * (a - 1) + (k - a) * (k - a - 1)) / (k * (k - 1))")).alias("p"), (F.sum("a") / F.sum("k")).alias("q"), F.count(F.lit(1)).alias("items"))
    return g.selectExpr(*by, "items", "try_divide(p - q * q - (1 - q) * (1 - q), 1 - q * q - (1 - q) * (1 - q)) fleiss_kappa")


def bootstrap_spearman(rows: DataFrame, by: list[str], pairs: list[tuple[str, str]], stratum: str, cluster: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """by, x, y, estimate, ci_lower, ci_upper: rank correlations whose replicates draw whole clusters inside strata and
    rank their rows anew, each counted as often as it was drawn. All pairs of columns share the draws and the ranks."""
    names = sorted({c for p in pairs for c in p})
    held = cut(rows.select(*by, stratum, cluster, *names).dropna(subset=names))
    each = ranks.replicate_correlations(held, by, names, pairs, stratum, cluster, replicates, seed)
    again = F.when(F.col("replicate") > 0, F.col("r"))
    return each.groupBy(*by, "x", "y").agg(F.max(F.when(F.col("replicate") == 0, F.col("r"))).alias("estimate"), F.percentile(again, F.lit(0.025)).alias("ci_lower"), F.percentile(again, F.lit(0.975)).alias("ci_upper"))


def hypotheses(rows: DataFrame, replicates: int = REPLICATES) -> DataFrame:
    """rows by scenario, model and encoder (ice, drift, separation): H1, interior errors exceed those over all seven points,
    of which two are 0 by construction (supported if so in every scenario); H2, separation goes against error and drift
    (supported if the interval lies below 0); H5, error and drift go together but differ (interval above 0, below 0.8)."""
    h1 = rows.withColumn("difference", F.col("ice") - F.col("ice") * (5.0 / 7.0))
    every = h1.groupBy("encoder_id", "model_id").agg(F.bool_and(F.col("difference") > 0).alias("supported"))
    h1 = bootstrap_means(h1, ["encoder_id", "model_id"], ["difference"], "style_axis", "scenario_id", replicates).join(every, ["encoder_id", "model_id"])
    ranks = bootstrap_spearman(rows, ["encoder_id"], [("separation", "ice"), ("separation", "drift"), ("ice", "drift")], "style_axis", "scenario_id", replicates)
    second = F.col("x") == "separation"
    ranks = ranks.withColumn("supported", F.when(second, F.col("ci_upper") < 0).otherwise((F.col("ci_lower") > 0) & (F.col("estimate") < 0.8)))
    one = h1.select(F.lit("H1").alias("hypothesis"), "encoder_id", "model_id", F.lit("interior minus all points").alias("test"), "estimate", "ci_lower", "ci_upper", "supported")
    return one.unionByName(ranks.select(F.when(second, "H2").otherwise("H5").alias("hypothesis"), "encoder_id", F.lit(None).cast("string").alias("model_id"), F.concat_ws(" vs ", "x", "y").alias("test"), "estimate", "ci_lower", "ci_upper", "supported"))


def scale_regression(rows: DataFrame, registry: DataFrame, metrics: list[str], predictors: list[str], family: str, replicates: int = REPLICATES, seed: int = 1) -> DataFrame:
    """Slope, R2 and rank correlation of model means on the log of model sizes, over all models and over one family, by
    encoder; the slope's interval draws scenarios for all models alike. Fewer than three models, or equal sizes: no row.
    registry: model_id, family_version and the predictors, a row for each model."""
    keys = ["scope", "encoder_id", "metric", "predictor"]
    logs = F.array(*[F.struct(F.lit(p).alias("predictor"), F.ln(F.col(p).cast("double")).alias("x")) for p in predictors])
    sizes = registry.select("model_id", F.explode(F.array_compact(F.array(F.lit("all_models"), F.when(F.col("family_version") == family, F.lit(family))))).alias("scope"), logs.alias("l")).select("model_id", "scope", F.inline("l"))

    def fits(means: DataFrame, by: list[str]) -> DataFrame:
        return means.join(F.broadcast(sizes), "model_id").where("y is not null").groupBy(*keys, *by)  # a few rows for each model

    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("y")) for m in metrics])
    means = rows.groupBy("encoder_id", "model_id").agg(*[F.avg(m).alias(m) for m in metrics]).select("encoder_id", "model_id", F.inline(values))
    found = fits(means, []).agg(F.count(F.lit(1)).alias("models"), F.stddev_pop("x").alias("spread"), F.regr_slope("y", "x").alias("slope"), F.regr_r2("y", "x").alias("r2")).where("models >= 3 and spread > 1e-12").drop("spread")
    rho = spearman(means.join(F.broadcast(sizes), "model_id").where("y is not null"), "x", "y", keys, "spearman")
    drawn = drawn_sums(rows, ["encoder_id", "model_id"], metrics, "style_axis", "scenario_id", replicates, seed)
    again = drawn.select("encoder_id", "model_id", "replicate", *[F.try_divide(F.col(m), F.col(f"{m}_w")).alias(m) for m in metrics]).select("encoder_id", "model_id", "replicate", F.inline(values))
    slopes = fits(again, ["replicate"]).agg(F.regr_slope("y", "x").alias("b")).groupBy(*keys).agg(F.percentile("b", F.lit(0.025)).alias("ci_lower"), F.percentile("b", F.lit(0.975)).alias("ci_upper"))
    return found.join(rho, keys, "left").join(slopes, keys, "left")


def fixed_effect_residual(rows: DataFrame, value: str, absorbed: str, effects: list[str], name: str) -> DataFrame:
    """rows with `name`: the residual of value on fixed effects of `absorbed` and of the columns `effects`, each with any number
    of levels. Rows without the value keep a null."""
    return absorption.absorbed(rows, {name: F.col(value)}, [absorbed, *effects])


def line_residual(rows: DataFrame, y: str, x: str, name: str) -> DataFrame:
    """rows with the residual of y on a constant and x; null where either is."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    fit = rows.where(both).agg(F.regr_slope(y, x).alias("_s"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"))  # one row
    return rows.crossJoin(F.broadcast(fit)).withColumn(name, F.when(both, F.col(y) - F.col("_my") - F.coalesce("_s", F.lit(0.0)) * (F.col(x) - F.col("_mx")))).drop("_s", "_mx", "_my")


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail by the series of the lower incomplete gamma function, or its continued fraction for large x."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return 1 - scale * total
    b = z + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d, c = 1 / (step * d + b), b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def clustered_ols(rows: DataFrame, y: str, terms: dict[str, Column], cluster: str, absorb: list[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(term, estimate, std_error, z), and figures of the fit: n, clusters, R2, the LM statistic for unequal variances with
    its degrees of freedom and p value, and the design's condition number. Errors are robust to clusters, with the factor
    G / (G - 1) * (n - 1) / (n - k). Sums of products are matrices that tasks add up in numpy; systems of as many rows as terms
    are solved on the driver, with the least norm where terms depend on each other. Factors with many levels go in `absorb`:
    y and all terms are replaced by their residuals on them (there is no intercept then, and R2 is that within the factors);
    k then counts their levels as well, less one for each factor after the first."""
    values = {"_y": F.col(y), **{f"_x{k}": c for k, c in enumerate(terms.values(), 1)}}
    d, levels = rows.select(cluster, *(absorb or []), *[c.cast("double").alias(n) for n, c in values.items()]).dropna(subset=list(values)), 0
    if absorb:
        d = cut(d)
        one = d.agg(*[F.countDistinct(F.coalesce(F.col(f).cast("string"), F.lit("\0"))).alias(f"c{i}") for i, f in enumerate(absorb)]).first()
        levels = sum(one) - len(absorb) + 1
        d = absorption.absorbed(d, {n: F.col(n) for n in values}, absorb)
    names = [*([] if absorb else ["intercept"]), *terms]
    ones = [] if absorb else [F.lit(1.0)]
    d = cut(d.select(cluster, F.array(*ones, *[F.col(n) for n in values if n != "_y"]).alias("x"), F.col("_y").alias("y")))
    p, n = len(names), d.count()
    if not n:
        raise ValueError("no complete rows")
    whole = absorption.gram(d.select(F.concat("x", F.array("y")).alias("v")), "v")
    xx, xy = whole[:p, :p], whole[:p, p]
    inverse = np.linalg.pinv(xx, hermitian=True)
    beta = inverse @ xy
    scores = cut(absorption.cluster_scores(d, cluster, beta))
    meat, g = absorption.gram(scores, "s"), scores.count()
    squares = absorption.gram(d, "x", "y", of=absorption.squared_residuals(beta))
    q, qq = squares[:p, p], squares[p, p]
    two = d.agg(F.var_pop("y").alias("v"), F.avg("y").alias("m")).first()
    tss, rss = (two["v"] * n, float(q[0])) if not absorb else (float(whole[p, p]), float(whole[p, p] - xy @ beta))
    rank = int(np.linalg.matrix_rank(xx, hermitian=True)) + levels
    factor = g / (g - 1) * (n - 1) / (n - rank) if g > 1 and n > rank else math.nan
    error = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * factor, 0))
    spread = qq - rss**2 / n
    lm = n * (float(q @ inverse @ q) - rss**2 / n) / spread if spread > 0 else 0.0
    if absorb:
        lm = math.nan  # needs an intercept among the terms
    eigen = np.linalg.eigvalsh(xx)
    figures = {"n": float(n), "clusters": float(g), "r2": 1 - rss / tss if tss else math.nan, "lm": lm, "lm_df": float(max(p - 1, 1)), "lm_p": math.nan if absorb else chi_square_tail(lm, max(p - 1, 1)), "condition_number": float(np.sqrt(eigen[-1] / eigen[0])) if eigen[0] > 0 else math.inf}
    out = [(t, float(b), float(v), float(b / v) if v > 0 else None) for t, b, v in zip(names, beta, error, strict=True)]
    return rows.sparkSession.createDataFrame(out, "term string, estimate double, std_error double, z double"), figures
