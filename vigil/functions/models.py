"""Numerical kernels in numpy, and the models around them."""

from __future__ import annotations

from math import lgamma, log
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators import vectors as V

EULER = 0.5772156649015329


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a penalised logistic regression with balanced classes; the first is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    share = np.where(y == 1, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    penalty = np.diag([1e-9] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def auroc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the curve with ties shared; not a number with fewer than two of either class."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    if pos < 2 or neg < 2:
        return float("nan")
    rank = pd.Series(score).rank().to_numpy()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * neg))


def one_vs_rest(pdf: pd.DataFrame) -> pd.DataFrame:
    target = int(pdf["target"].iloc[0])
    pdf = pdf.sort_values("vec_id")
    x, y = np.stack(pdf["embedding"].to_list()), (pdf["label"] == target).to_numpy(int)
    train = pdf["train"].to_numpy(bool)
    if len(set(y[train])) < 2:
        score = np.full((~train).sum(), 0.5)
    else:
        w = logistic(x[train], y[train])
        score = w[0] + x[~train] @ w[1:]
    test = y[~train]
    return pd.DataFrame({"target": [target], "auroc": [auroc(score, test)], "n_pos": [int(test.sum())], "n_neg": [int((1 - test).sum())]})


def mahalanobis_fit(rows: DataFrame, key: str, vector: str, shrink: float = 0.05) -> tuple[dict, np.ndarray]:
    """Class means and the inverse of the tied covariance of the classes' residuals: (1-s) cov + s diag, with jitter. Only k x d and d x d numbers come to the driver."""
    centres = V.centroids(rows, key, vector)
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    resid = rows.join(centres, key).join(sizes, key, "left_semi").select(F.zip_with(vector, "centroid", lambda a, b: a - b).alias("r"))

    def moments(frames):
        total, n = None, 0
        for f in frames:
            if len(f):
                r = np.stack(f["r"].to_list())
                total = r.T @ r if total is None else total + r.T @ r
                n += len(r)
        if n:
            yield pd.DataFrame({"n": [n], "m": [total.ravel().tolist()]})

    parts = resid.mapInPandas(moments, "n long, m array<double>")
    cells = parts.select("n", F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("i").collect()
    d = int(len(cells) ** 0.5)
    cov = np.array([c.x for c in cells]).reshape(d, d) / max(cells[0].n - 1, 1)
    cov = (1 - shrink) * cov + shrink * np.diag(np.diag(cov))
    cov += 1e-6 * np.trace(cov) / d * np.eye(d)
    return {r[key]: np.array(r.centroid) for r in centres.orderBy(key).collect()}, np.linalg.pinv(cov)


def mahalanobis_scores(rows: DataFrame, means: dict, precision: np.ndarray, id_: str, vector: str) -> DataFrame:
    keys, centres = list(means), np.stack(list(means.values()))

    def run(frames):
        for f in frames:
            if not len(f):
                continue
            gap = np.stack(f[vector].to_list())[:, None, :] - centres[None]
            d2 = np.einsum("nkd,de,nke->nk", gap, precision, gap)
            unknown = 1 - np.exp(-d2.min(axis=1) / (2 * centres.shape[1]))
            yield pd.DataFrame({id_: f[id_], "best": [keys[i] for i in d2.argmin(axis=1)], "d2": d2.min(axis=1).round(6), "unknown": unknown.round(6)})

    return rows.select(id_, vector).mapInPandas(run, f"{id_} long, best int, d2 double, unknown double")


def weibull(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a Weibull distribution from 0 by maximum likelihood, by bisection on the shape."""
    x = np.maximum(np.asarray(x, float), 1e-12)
    if np.ptp(x) < 1e-12:
        return 50.0, float(x.mean())
    y = x / x.max()
    mean_log = np.log(y).mean()
    lo, hi = 1e-3, 500.0
    for _ in range(200):
        k = (lo + hi) / 2
        p = y**k
        if (p * np.log(y)).sum() / p.sum() - 1 / k - mean_log > 0:
            hi = k
        else:
            lo = k
    k = (lo + hi) / 2
    return k, float(x.max() * (y**k).mean() ** (1 / k))


def weibull_tails(distances: DataFrame, key: str, tail: int) -> DataFrame:
    """A Weibull fit to the `tail` largest distances of each class; small classes use their three largest, classes of one row ones."""
    from pyspark.sql import Window as W

    order = W.partitionBy(key).orderBy(F.col("distance").desc())
    top = distances.withColumn("_n", F.row_number().over(order)).withColumn("_k", F.count(F.lit(1)).over(W.partitionBy(key)))
    top = top.where(F.col("_n") <= F.when(F.col("_k") < tail, 3).otherwise(tail))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["distance"].to_numpy() if len(pdf) > 1 else np.ones(3)
        k, scale = weibull(x)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "shape": [k], "scale": [scale]})

    return top.select(key, "distance").groupBy(key).applyInPandas(fit, f"{key} int, shape double, scale double")


def openmax(rows: DataFrame, centres: DataFrame, tails: DataFrame, id_: str, key: str, vector: str) -> DataFrame:
    """Probabilities of the best class and of none: the recognition of a class is the upper tail of its Weibull at the distance to its mean."""
    packed = centres.join(tails, key).agg(F.collect_list(F.struct(F.col(key).alias("k"), "centroid", "shape", "scale")).alias("_c"))

    def recognition(c: Column) -> Column:
        return F.exp(-F.pow(F.sqrt(V.squared_distance(F.col(vector), c["centroid"])) / c["scale"], c["shape"]))

    scored = rows.join(F.broadcast(packed)).withColumn("_r", F.transform("_c", lambda c: F.struct(recognition(c).alias("r"), (-c["k"]).alias("k"))))
    best, total = F.array_max("_r"), F.aggregate("_r", F.lit(0.0), lambda s, r: s + r["r"])
    out = scored.select(id_, best.alias("b"), total.alias("s"))
    known = F.when(F.col("s") > 0, F.col("b.r") / F.col("s") * F.col("b.r")).otherwise(0.0)
    return out.select(id_, (-F.col("b.k")).alias("best"), F.round(known, 6).alias("known"), F.round(1 - F.col("b.r"), 6).alias("unknown"))


def gathered(rows: DataFrame, leaders: np.ndarray, vector: str) -> DataFrame:
    """leader, n, total (the sum of the vectors) and square (of their squared lengths) of the rows nearest to each leader, summed in each partition first."""

    def run(frames):
        k, dim = leaders.shape
        n, total, square = np.zeros(k, int), np.zeros((k, dim)), np.zeros(k)
        for f in frames:
            if len(f):
                x = np.stack(f[vector].to_list())
                at = ((x**2).sum(axis=1)[:, None] - 2 * x @ leaders.T + (leaders**2).sum(axis=1)[None]).argmin(axis=1)
                n += np.bincount(at, minlength=k)
                np.add.at(total, at, x)
                square += np.bincount(at, (x**2).sum(axis=1), minlength=k)
        some = np.flatnonzero(n)
        if not len(some):  # a partition without rows, whose empty column of vectors has no Arrow form
            return
        yield pd.DataFrame({"leader": some, "n": n[some], "total": list(total[some]), "square": square[some]})

    parts = rows.select(vector).mapInPandas(run, "leader long, n long, total array<double>, square double")
    whole = parts.groupBy("leader").agg(F.sum("n").alias("n"), F.sum("square").alias("square"))
    cells = parts.select("leader", F.posexplode("total").alias("i", "x")).groupBy("leader", "i").agg(F.sum("x").alias("x"))
    packed = cells.groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("total"))
    return whole.join(packed, "leader")


def _between(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))


def linkage_labels(x: np.ndarray, ks, weight: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """Average-linkage clusters at each size, by Lance and Williams' update of a distance matrix. weight: how many rows each point stands for."""
    n, d = len(x), _between(x)
    np.fill_diagonal(d, np.inf)
    size, member, out = np.ones(n) if weight is None else weight.astype(float), [[i] for i in range(n)], {}
    alive = list(range(n))
    while len(alive) > 1:
        if len(alive) in ks:
            labels = np.empty(n, int)
            for c, i in enumerate(alive):
                labels[member[i]] = c
            out[len(alive)] = labels
        sub = d[np.ix_(alive, alive)]
        i, j = np.unravel_index(sub.argmin(), sub.shape)
        a, b = alive[min(i, j)], alive[max(i, j)]
        d[a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[:, a] = d[a]
        d[a, a] = np.inf
        size[a] += size[b]
        member[a] += member[b]
        alive.remove(b)
    return out


def silhouette(x: np.ndarray, labels: np.ndarray, weight: np.ndarray | None = None) -> float:
    if len(set(labels)) < 2:
        return -1.0
    w = np.ones(len(x)) if weight is None else weight
    d, names = _between(x), np.unique(labels)
    total = np.stack([(d[:, labels == c] * w[labels == c]).sum(axis=1) for c in names], axis=1)
    size = np.array([w[labels == c].sum() for c in names])
    own, rows = np.searchsorted(names, labels), np.arange(len(x))
    a = np.where(size[own] > 1, total[rows, own] / np.maximum(size[own] - 1, 1), 0)
    other = total / size
    other[rows, own] = np.inf
    b = other.min(axis=1)
    return float(np.average(np.where(size[own] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-12), 0), weights=w))


def inertia(n: np.ndarray, total: np.ndarray, square: np.ndarray, labels: np.ndarray) -> float:
    """The sum of squares around the means of clusters, from the sizes, sums and squared lengths of their parts."""
    return float(sum(square[labels == c].sum() - (total[labels == c].sum(axis=0) ** 2).sum() / n[labels == c].sum() for c in set(labels)))


def cluster_table(groups: pd.DataFrame, ks, references: int = 3, seed: int = 42) -> pd.DataFrame:
    """Silhouette and gap of each k, and the k of the first largest silhouette. groups: n, total, square."""
    groups = groups.sort_values("leader")
    n, total, square = groups["n"].to_numpy(float), np.stack(groups["total"].to_list()), groups["square"].to_numpy()
    x = total / n[:, None]
    ks = [k for k in ks if 2 <= k <= len(x) - 1]
    labels, rng = linkage_labels(x, set(ks), n), np.random.default_rng(seed)
    draws = [(y, linkage_labels(y, set(ks))) for y in (rng.uniform(x.min(axis=0), x.max(axis=0), x.shape) for _ in range(references))]
    rows, ones = [], np.ones(len(x))
    for k in ks:
        logs = np.array([log(max(inertia(ones, y, (y**2).sum(axis=1), found[k]) * n.sum() / len(x), 1e-10)) for y, found in draws])
        gap = logs.mean() - log(max(inertia(n, total, square, labels[k]), 1e-10))
        rows.append((k, silhouette(x, labels[k], n), gap, logs.std() * (1 + 1 / references) ** 0.5))
    out = pd.DataFrame(rows, columns=["k", "silhouette", "gap", "gap_se"])
    return out.assign(k=out["k"].astype("int32"), chosen=out.index == out["silhouette"].idxmax()).round(6)


def digamma(n: np.ndarray) -> np.ndarray:
    """At whole numbers from 1."""
    n = np.asarray(n, int)
    harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, n.max() + 1))])
    return harmonic[n - 1] - EULER


def mutual_information(x: np.ndarray, y: np.ndarray, k: int = 3) -> float:
    """Nearest-neighbour estimate with the largest-coordinate distance; never below 0, and 0 for fewer than k + 2 rows."""
    x, y = np.atleast_2d(np.asarray(x, float).T).T, np.atleast_2d(np.asarray(y, float).T).T
    n = len(x)
    if n < k + 2:
        return 0.0
    dx = np.abs(x[:, None] - x[None]).max(axis=2)
    dy = np.abs(y[:, None] - y[None]).max(axis=2)
    eps = np.sort(np.maximum(dx, dy), axis=1)[:, k][:, None]
    nx, ny = (dx <= eps).sum(axis=1) - 1, (dy <= eps).sum(axis=1) - 1
    return float(max(0.0, digamma(np.array([k]))[0] + digamma(np.array([n]))[0] - (digamma(nx + 1) + digamma(ny + 1)).mean()))


def transfer_entropy(source: np.ndarray, target: np.ndarray, k: int = 3, lag: int = 1) -> float:
    """What the source's past adds to the target's own about the target's next value."""
    if len(target) - lag < k + 2:
        return 0.0
    now, own, other = target[lag:], target[:-lag], source[:-lag]
    return max(0.0, mutual_information(now, np.column_stack([other, own]), k) - mutual_information(now, own, k))


def permutation_p(observed: float, drawn: np.ndarray) -> float:
    return float((1 + (np.asarray(drawn) >= observed).sum()) / (1 + len(drawn)))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the chances of all tables with these margins that are no likelier than this one."""
    r, s, n = a + b, a + c, a + b + c + d

    def chance(x: int) -> float:
        return lgamma(r + 1) - lgamma(x + 1) - lgamma(r - x + 1) + lgamma(n - r + 1) - lgamma(s - x + 1) - lgamma(n - r - s + x + 1) - (lgamma(n + 1) - lgamma(s + 1) - lgamma(n - s + 1))

    here = chance(a)
    return float(min(1.0, sum(np.exp(p) for x in range(max(0, r + s - n), min(r, s) + 1) if (p := chance(x)) <= here + 1e-7)))


def bca(stat: float, boot: np.ndarray, jack: np.ndarray, alpha: float = 0.05) -> tuple[float, float]:
    """Bias-corrected and accelerated bounds, or plain percentiles where the share below the estimate is 0 or 1."""
    share = float((boot < stat).mean())
    if share in (0.0, 1.0):
        return float(np.quantile(boot, alpha / 2)), float(np.quantile(boot, 1 - alpha / 2))
    normal = NormalDist()
    z0, gap = normal.inv_cdf(share), jack.mean() - jack
    low = 6 * (gap**2).sum() ** 1.5
    a = (gap**3).sum() / low if low else 0.0
    bounds = [normal.cdf(z0 + (z0 + normal.inv_cdf(q)) / (1 - a * (z0 + normal.inv_cdf(q)))) for q in (alpha / 2, 1 - alpha / 2)]
    return float(np.quantile(boot, bounds[0])), float(np.quantile(boot, bounds[1]))
