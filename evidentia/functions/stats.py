"""Statistics as column expressions; the incomplete beta function as an Arrow function."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_position, range_of, running_sums


def group_moments(df: DataFrame, keys: list[str], group: Column, value: Column, control: str, disease: str) -> DataFrame:
    """Counts, means and sample variances of ``value`` in two groups per key."""
    out = [f(F.when(group == g, value)).alias(f"{n}_{k}") for k, g in (("control", control), ("disease", disease)) for n, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))]
    return df.groupBy(*keys).agg(*out)


def welch(df: DataFrame) -> DataFrame:
    """Adds t and the Welch-Satterthwaite degrees of freedom; both null where a group has one value.

    Where both variances are zero, t is infinite with one degree of freedom if the means differ, else null.
    """
    a, b = F.col("var_disease") / F.col("n_disease"), F.col("var_control") / F.col("n_control")
    usable = (F.col("n_disease") > 1) & (F.col("n_control") > 1)
    apart = F.col("mean_disease") - F.col("mean_control")
    flat = F.when(apart != 0, F.signum(apart) * F.lit(float("inf")))
    t = F.when(a + b > 0, apart / F.sqrt(a + b)).otherwise(flat)
    dof = F.pow(a + b, F.lit(2.0)) / (F.pow(a, F.lit(2.0)) / (F.col("n_disease") - 1) + F.pow(b, F.lit(2.0)) / (F.col("n_control") - 1))
    return df.withColumns({"t": F.when(usable, t), "dof": F.when(usable, F.when(a + b > 0, dof).otherwise(F.when(apart != 0, F.lit(1.0))))})


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function for positive numbers, by Stirling's series above 10."""
    x = np.array(x, float)
    shift = np.zeros_like(x)
    for _ in range(10):
        low = x < 10
        shift[low] += np.log(x[low])
        x[low] += 1
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r * (1 / 1188 - r * 691 / 360360))))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + series - shift


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz method), over whole arrays."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = (x >= 1).astype(float)
    inside = np.flatnonzero((x > 0) & (x < 1))
    a, b, x = a[inside], b[inside], x[inside]
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) + b * np.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)) / a
        tiny = 1e-300
        away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
        c, d = np.ones_like(x), 1 / away(1 - (a + b) * x / (a + 1))
        total = d.copy()
        todo = np.ones(len(x), bool)
        for m in range(1, 2000):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / away(1 + step * d)
                c = away(1 + step / c)
                total = np.where(todo, total * c * d, total)
            todo &= np.abs(c * d - 1) >= 1e-15
            if not todo.any():
                break
    out[inside] = np.where(flip, 1 - front * total, front * total)
    return out


def two_sided_ps(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p values of t; 0 for an infinite t, 1 where t or the degrees of freedom are no numbers."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    out = np.ones(np.broadcast(t, dof).shape)
    fine = np.isfinite(t) & np.isfinite(dof) & (dof > 0)
    out[np.isinf(t) & np.isfinite(dof)] = 0.0
    # x is next to 1 for small t, where 1 - x keeps the digits
    square = t[fine] ** 2
    out[fine] = np.where(square < dof[fine], 1 - incomplete_beta(0.5, dof[fine] / 2, square / (dof[fine] + square)), incomplete_beta(dof[fine] / 2, 0.5, dof[fine] / (dof[fine] + square)))
    return out


def two_sided_p(t: float, dof: float) -> float:
    return float(two_sided_ps(np.array([t], float), np.array([dof], float))[0])


def with_p(df: DataFrame, t: str = "t", dof: str = "dof", out: str = "p") -> DataFrame:
    """Adds the two-sided p value of t; 1 where t is undefined. Built-in functions have no incomplete beta, so batches go through Arrow, whole arrays at a time."""

    @F.pandas_udf("double")
    def p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for ts, ds in batches:
            yield pd.Series(two_sided_ps(ts.to_numpy(float, na_value=np.nan), ds.to_numpy(float, na_value=np.nan)))

    return df.withColumn(out, p(F.col(t), F.col(dof)))


def bh_adjusted(df: DataFrame, p: str, key: str, out: str, within: list[str] | None = None) -> DataFrame:
    """Benjamini-Hochberg adjustment of ``p`` in each group of ``within``: the smallest p * m / rank from a row on, 1 at most.

    Ranks and the running least are taken range by range, so no group lies in one task. Null p values count as 1.
    """
    within = within or []
    rows = df.withColumn("_p", F.coalesce(p, F.lit(1.0)))
    n = rows.groupBy(*within).agg(F.count("*").alias("_m"))
    rows = global_position(rows, "_p", [F.col("_p"), F.col(key)], "_rank", within=within)
    rows = rows.join(n, within) if within else rows.crossJoin(F.broadcast(n))  # one row
    rows = rows.withColumn("_raw", F.col("_p") * F.col("_m") / F.col("_rank")).withColumn("_part", range_of(rows, "_p"))
    after = Window.partitionBy(*within or [F.lit(0)]).orderBy("_part").rowsBetween(1, Window.unboundedFollowing)
    least = rows.groupBy(*within, "_part").agg(F.min("_raw").alias("_low")).select(*within, "_part", F.min("_low").over(after).alias("_later"))  # RANGES rows a group
    own = Window.partitionBy(*within, "_part").orderBy("_rank").rowsBetween(0, Window.unboundedFollowing)
    met = rows.join(least, [*within, "_part"]).withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(own), F.coalesce("_later", F.lit(1.0))))
    return met.drop("_p", "_m", "_rank", "_raw", "_part", "_later")


def zscore(value: Column, mean: Column, sd: Column) -> Column:
    """0 where the deviation is zero, null or not a number."""
    return F.when(sd.isNull() | F.isnan(sd) | (sd == 0), F.lit(0.0)).otherwise((value - mean) / sd)


def holdout(n: Column, valid: float, test: float) -> tuple[Column, Column]:
    """(rows for valid, rows for test) held out of n: the shares rounded half to even; from three rows on a positive share
    holds out one row at least; one row at least is left, valid giving way before test."""
    size = lambda share: F.greatest(F.bround(n * F.lit(float(share)), 0).cast("long"), F.when((n >= 3) & F.lit(share > 0), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    most = F.greatest(n - 1, F.lit(0)).cast("long")
    n_test, n_valid = size(test), size(valid)
    n_valid_left = F.greatest(F.lit(0).cast("long"), F.least(n_valid, most - n_test))
    return n_valid_left, F.least(n_test, most)


def auroc(df: DataFrame, score: str, label: str, within: list[str]) -> DataFrame:
    """Area under the ROC curve per group, ties at their mean rank, from the counts of each distinct score; null where a group has one label only."""
    steps = df.groupBy(*within, score).agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count("*").alias("rows"))
    ranked = running_sums(steps, within, score, ["rows"])
    n1, n = F.sum("hits").cast("double"), F.sum("rows").cast("double")
    mean_rank = F.col("_run_rows") - (F.col("rows") - 1) / F.lit(2.0)
    area = (F.sum(F.col("hits") * mean_rank) - n1 * (n1 + 1) / 2) / (n1 * (n - n1))
    return ranked.groupBy(*within).agg(F.when((n1 > 0) & (n1 < n), area).alias("auroc"), n.cast("long").alias("n"))


def average_precision(df: DataFrame, score: str, label: str, within: list[str]) -> DataFrame:
    """Sum of precision times the gain of recall, one step per distinct score; null where a group has no hit."""
    steps = df.groupBy(*within, score).agg(F.sum(F.col(label).cast("long")).alias("hits"), F.count("*").alias("rows"))
    ranked = running_sums(steps, within, score, ["hits", "rows"], ascending=False)
    total = F.sum(F.col("_run_hits") / F.col("_run_rows") * F.col("hits"))
    return ranked.groupBy(*within).agg(F.when(F.sum("hits") > 0, total / F.sum("hits")).alias("average_precision"))


def link_metrics(df: DataFrame, score: str, label: str, relation: str) -> DataFrame:
    """One row: binary cross-entropy of logits, micro and macro AUROC and average precision, and the numbers of positives and negatives."""
    logit, y = F.col(score).cast("double"), F.col(label).cast("double")
    loss = F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))
    own = df.agg(F.avg(loss).alias("loss"), F.sum(F.col(label).cast("long")).alias("num_pos"), F.sum((1 - F.col(label)).cast("long")).alias("num_neg"))
    micro = auroc(df.withColumn("_all", F.lit(0)), score, label, ["_all"]).select(F.col("auroc").alias("micro_auroc"))
    micro_p = average_precision(df.withColumn("_all", F.lit(0)), score, label, ["_all"]).select(F.col("average_precision").alias("micro_auprc"))
    macro = auroc(df, score, label, [relation]).agg(F.avg("auroc").alias("macro_auroc"))
    macro_p = average_precision(df, score, label, [relation]).agg(F.avg("average_precision").alias("macro_auprc"))
    return own.crossJoin(F.broadcast(micro)).crossJoin(F.broadcast(micro_p)).crossJoin(F.broadcast(macro)).crossJoin(F.broadcast(macro_p))  # one row each
