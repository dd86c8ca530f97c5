"""Operators on a long signal (episode_id, t, service, value): filling, scaling, windows, splits. Missing is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SERIES = ("episode_id", "service")


def filled(value: str = "value", keys=SERIES) -> Column:
    """The last known value, or before the first known one the next."""
    order = W.partitionBy(*keys).orderBy("t")
    back = F.last(value, True).over(order.rowsBetween(W.unboundedPreceding, 0))
    return F.coalesce(back, F.first(value, True).over(order.rowsBetween(0, W.unboundedFollowing)))


def ordered_mean(value: str = "value", order: str = "t") -> Column:
    """The mean of a few known values, added from the last step to the first in every run, so that what ties with a bound stays on one side of it."""
    known = F.sort_array(F.filter(F.collect_list(F.struct(order, value)), lambda s: s[value].isNotNull()), False)
    return F.aggregate(known, F.lit(0.0), lambda s, x: s + x[value]) / F.nullif(F.size(known), F.lit(0))


def half_away(value: Column, digits: int) -> Column:
    """value rounded in binary, halves away from zero, as the SQL's engine does; round() of Spark goes by the decimal digits."""
    scaled = value * F.lit(10.0**digits)
    whole = F.rint(scaled)
    return F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole) / F.lit(10.0**digits)


def cascade(signal: DataFrame, train: Column, group: str) -> DataFrame:
    """Fill by the episode's median, the training median of (group, service), the training median of the service, then 0."""
    own = F.median("value").over(W.partitionBy(*SERIES))
    known = signal.where(train)
    by_group = known.groupBy(group, "service").agg(F.median("value").alias("_g"))
    by_service = known.groupBy("service").agg(F.median("value").alias("_s"))
    out = signal.withColumn("_e", own).join(by_group, [group, "service"], "left").join(by_service, "service", "left")
    return out.withColumn("value", F.coalesce("value", "_e", "_g", "_s", F.lit(0.0))).drop("_e", "_g", "_s")


def scaler(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of the known values; 1 for a deviation of nothing or a single value, 0 and 1 for no value."""
    n, mean, std = F.count("value"), F.avg("value"), F.stddev_pop("value")
    return signal.groupBy(*keys).agg(F.coalesce(mean, F.lit(0.0)).alias("mean"), F.when((n < 2) | (std <= 1e-12), 1.0).otherwise(std).alias("scale"), n.alias("n"))


def scaled(signal: DataFrame, fitted: DataFrame, keys: list[str], zero_after: bool = False) -> DataFrame:
    """(value - mean) / scale, missing values at the mean, or at zero after scaling, which is the same place."""
    out = signal.join(fitted, keys)
    z = (F.col("value") - F.col("mean")) / F.col("scale")
    return out.withColumn("value", F.coalesce(z, F.lit(0.0)) if zero_after else (F.coalesce("value", "mean") - F.col("mean")) / F.col("scale"))


def instance_norm(signal: DataFrame, normal: Column, keys: list[str]) -> DataFrame:
    """By the mean and deviation of an episode's normal steps, where there are two or more such steps."""
    fit = signal.where(normal).groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.countDistinct("t").alias("_n"))
    z = (F.col("value") - F.col("_m")) / (F.col("_s") + 1e-6)
    return signal.join(fit, keys, "left").withColumn("value", F.when(F.col("_n") >= 2, z).otherwise(F.col("value"))).drop("_m", "_s", "_n")


def window_of(signal: DataFrame, k: int, place: str = "last") -> DataFrame:
    """k steps of each series: the last, first or middle ones, numbered from 0; fewer are padded with zeros before them."""
    order = W.partitionBy(*SERIES).orderBy("t")
    size = W.partitionBy(*SERIES)
    ranked = signal.withColumn("_i", F.row_number().over(order) - 1).withColumn("_n", F.count(F.lit(1)).over(size))
    start = {"last": F.greatest(F.col("_n") - k, F.lit(0)), "first": F.lit(0), "middle": F.greatest(F.floor((F.col("_n") - k) / 2), F.lit(0))}[place]
    pad = F.greatest(F.lit(k) - F.col("_n"), F.lit(0))
    picked = ranked.withColumn("_k", F.col("_i") - start + pad).where((F.col("_k") < k) & (F.col("_i") >= start))
    frame = ranked.select(*SERIES).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    found = picked.select(*SERIES, F.col("_k").cast("int").alias("k"), "value")
    return frame.join(found, [*SERIES, "k"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def causal_conv(value: Column, weights: list[float], dilation: int, order) -> Column:
    """A dilated convolution that looks back only; what lies before the start is 0."""
    out = F.lit(0.0)
    for i, w in enumerate(weights):
        out = out + w * F.coalesce(F.lag(value, i * dilation).over(order) if i else value, F.lit(0.0))
    return out


def bridge(left: DataFrame, right: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """Sequence left, `gap` linear steps, then right, along t. Rows: keys, t, value, part."""
    if gap < 0:
        raise ValueError("a negative gap")
    end = left.groupBy(*keys).agg(F.max("t").alias("_t"), F.max_by("value", "t").alias("_a"))
    begin = right.groupBy(*keys).agg(F.min("t").alias("_f"), F.min_by("value", "t").alias("_b"))
    both = end.join(begin, keys)
    out = left.select(*keys, "t", "value", F.lit("a").alias("part"))
    if gap:
        steps = both.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(gap))))
        value = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_i") / (gap + 1)
        out = out.unionByName(steps.select(*keys, (F.col("_t") + F.col("_i")).alias("t"), value.alias("value"), F.lit("bridge").alias("part")))
    moved = right.join(both, keys).select(*keys, (F.col("t") - F.col("_f") + F.col("_t") + gap + 1).alias("t"), "value", F.lit("b").alias("part"))
    return out.unionByName(moved)


def clip(signal: DataFrame, envelope: DataFrame, keys: list[str]) -> DataFrame:
    """Values kept inside [p01, p99], with a mark for those that were not."""
    out = signal.join(envelope, keys)
    outside = (F.col("value") > F.col("p99")) | (F.col("value") < F.col("p01"))
    return out.withColumn("clipped", F.coalesce(outside, F.lit(False))).withColumn("value", F.when(F.col("value").isNotNull(), F.greatest(F.least("value", "p99"), "p01")))


def temporal_split(n: Column, rank: Column, train: float, val: float) -> Column:
    """By order over all rows; counts are rounded half to even."""
    a, b = F.bround(n * train, 0), F.bround(n * val, 0)
    return F.when(rank <= a, "train").when(rank <= a + b, "val").otherwise("test")


def stratified_split(n: Column, rank: Column, train: float, val: float, least_val: int, least_test: int) -> Column:
    """By order inside a group, with least sizes of the later parts as far as the group allows."""
    test = F.least(F.lit(least_test), F.greatest(F.lit(0), n - 1))
    low = F.least(F.lit(least_val), F.greatest(F.lit(0), n - 1 - test))
    a = F.greatest(F.lit(1), F.bround(n * train, 0).cast("int"))
    b = F.greatest(low, F.bround(n * val, 0).cast("int"))
    short = test - (n - a - b)
    a2 = F.when(short > 0, F.greatest(F.lit(1), a - short)).otherwise(a)
    b2 = F.when(n - a2 - b < test, F.greatest(F.lit(0), n - a2 - test)).otherwise(b)
    return F.when(rank <= a2, "train").when(rank <= a2 + b2, "val").otherwise("test")


def regime(ts: Column, before: Column, until: Column) -> Column:
    """Half-open phases: normal, injection, recovery."""
    return F.when(ts < before, "normal").when(ts < until, "injection").otherwise("recovery")


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that a row breaks, joined by ';'. A missing ratio breaks none."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()])), ";")
