"""Statistics as aggregations and windows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def average_rank(value: str, *keys: str) -> Column:
    """Rank from 1, shared by ties."""
    order = W.partitionBy(*keys).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2.0


def auroc(rows: DataFrame, keys: list[str], score: str, target: str) -> DataFrame:
    """Area under the curve by counts of each different score, so no group is sorted by rows; null with fewer than two of either class."""
    counts = rows.groupBy(*keys, score).agg(F.sum(F.col(target).cast("long")).alias("p"), F.sum(1 - F.col(target).cast("long")).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy(*keys).orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = counts.withColumn("_w", F.col("p") * (below + F.col("q") / 2.0))
    out = won.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("_w").alias("_w"))
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") >= 2) & (F.col("n_neg") >= 2), F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("auroc"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ranked = rows.withColumns({"_x": average_rank(x, *keys), "_y": average_rank(y, *keys)})
    return ranked.groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"), F.count(F.lit(1)).alias("n"))


def adjust(rows: DataFrame, p: str, id_: str, method: str = "bh") -> DataFrame:
    """Adjusted p values over a table of tests (one row a tested pair of clusters, bounded by their number): BH from the largest down, Holm from the smallest up."""
    up = W.partitionBy().orderBy(p, id_)
    ranked = rows.withColumns({"_r": F.row_number().over(up), "_m": F.count(F.lit(1)).over(W.partitionBy())})
    if method == "bh":
        value = F.min(F.col(p) * F.col("_m") / F.col("_r")).over(W.partitionBy().orderBy(F.col("_r").desc()).rowsBetween(W.unboundedPreceding, 0))
    else:
        value = F.max(F.col(p) * (F.col("_m") - F.col("_r") + 1)).over(W.partitionBy().orderBy("_r").rowsBetween(W.unboundedPreceding, 0))
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), value)).drop("_r", "_m")


def yates(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of a 2 x 2 table with Yates' correction."""
    n = a + b + c + d
    out = F.lit(0.0)
    for seen, row, col in ((a, a + b, a + c), (b, a + b, b + d), (c, c + d, a + c), (d, c + d, b + d)):
        e = row * col / n
        gap = F.greatest(F.abs(seen - e) - 0.5, F.lit(0.0))
        out = out + F.when(e > 0, gap * gap / e).otherwise(0.0)
    return out


def least_expected(a: Column, b: Column, c: Column, d: Column) -> Column:
    n = a + b + c + d
    return F.least((a + b) * (a + c) / n, (a + b) * (b + d) / n, (c + d) * (a + c) / n, (c + d) * (b + d) / n)


def association_p(*cells: str) -> Column:
    """The tail of chi-square (first column) with one degree, or Fisher's exact test where the expected count (second) is below five. Built when called: a session must be there."""

    @F.pandas_udf("double")
    def p(chi2: pd.Series, expected: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        from math import erfc, sqrt

        from vigil.functions.models import fisher_two_sided

        return pd.Series([erfc(sqrt(x / 2)) if e >= 5 else fisher_two_sided(*map(int, t)) for x, e, *t in zip(chi2, expected, a, b, c, d, strict=True)], dtype=float)

    return p(*cells)


def resample(id_: Column, replicate: Column, n: int) -> Column:
    """A row number drawn with replacement by arithmetic on the row's place and the replicate."""
    return ((id_ * 7919 + replicate * 104729 + id_ * replicate * 31 + 12345) % 1000003) % n
