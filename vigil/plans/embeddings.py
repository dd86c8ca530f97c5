"""Queries over vectors and classes."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.functions import models as M
from vigil.operators import vectors as V
from vigil.plans.graph import rounded
from vigil.plans.registry import query
from vigil.sources.adapters import table

CENTRES = """x AS (SELECT vec_id, label, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) g(i)), cen AS (SELECT label, i, avg(v) AS m FROM x GROUP BY ALL)"""


def _emb(spark, d):
    return table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


@query(f"WITH {CENTRES} SELECT label, (i - 1)::INT AS i, round(m, 6) AS m FROM cen")
def centroid(spark, d):
    return V.centroids(_emb(spark, d), "label", "embedding").select("label", F.posexplode("centroid").alias("i", "m")).withColumn("m", F.round("m", 6))


@query(f"""WITH {CENTRES}, n AS (SELECT label, sqrt(sum(m * m)) AS n FROM cen GROUP BY ALL), c AS (SELECT x.vec_id, x.label, 1 - sum(v * m) / (any_value(n) + 1e-10) AS d FROM x JOIN cen USING (label, i) JOIN n ON n.label = x.label GROUP BY ALL)
SELECT label, round(avg(d), 6) AS distance FROM c GROUP BY ALL""")
def cosine_to_centroid(spark, d):
    rows = _emb(spark, d)
    both = rows.join(V.centroids(rows, "label", "embedding"), "label")
    dist = 1 - V.dot(F.col("embedding"), F.col("centroid")) / (F.sqrt(V.dot(F.col("centroid"), F.col("centroid"))) + 1e-10)
    return both.groupBy("label").agg(F.round(F.avg(dist), 6).alias("distance"))


@query("SELECT * FROM (WITH " + CENTRES + ", dd AS (SELECT vec_id, cen.label AS k, sum((v - m) * (v - m)) AS d FROM x JOIN cen USING (i) GROUP BY ALL) SELECT vec_id, arg_min(k, {'d': d, 'k': k}) AS assigned, round(sqrt(min(d)), 6) AS distance FROM dd GROUP BY ALL)")
def nearest_centroid(spark, d):
    rows = _emb(spark, d)
    return V.nearest(rows, V.centroids(rows, "label", "embedding"), "label", "embedding").select("vec_id", "assigned", F.round("distance", 6).alias("distance"))


@query(f"WITH {CENTRES} SELECT label, round(sum((v - m) * (v - m)), 5) AS inertia FROM x JOIN cen USING (label, i) GROUP BY ALL")
def inertia(spark, d):
    rows = _emb(spark, d)
    both = rows.join(V.centroids(rows, "label", "embedding"), "label")
    return both.groupBy("label").agg(F.round(F.sum(V.squared_distance(F.col("embedding"), F.col("centroid"))), 5).alias("inertia"))


def _pairs(spark, d):
    """Each row whose id is divisible by 20, against all rows."""
    every = _emb(spark, d).select("vec_id", "label", "embedding")
    rows = every.where("vec_id % 20 = 0")
    other = every.select(F.col("vec_id").alias("other"), F.col("label").alias("other_label"), F.col("embedding").alias("e"))
    return rows.join(other, F.col("vec_id") != F.col("other")).withColumn("d", V.cosine_distance(F.col("embedding"), F.col("e")))


PAIRS = """p AS (SELECT a.vec_id, b.vec_id AS other, a.label, b.label AS other_label, 1 - greatest(-1, least(1, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"""


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), other) AS n FROM p WHERE label <> other_label) SELECT vec_id, other, round(d, 6) AS d FROM r WHERE n <= 3")
def hard_negatives(spark, d):
    order = W.partitionBy("vec_id").orderBy(F.round("d", 9), "other")
    return _pairs(spark, d).where("label <> other_label").withColumn("n", F.row_number().over(order)).where("n <= 3").select("vec_id", "other", F.round("d", 6).alias("d"))


@query(f"WITH {PAIRS}, m AS (SELECT vec_id, max(d) AS pos FROM p WHERE label = other_label GROUP BY ALL) SELECT p.vec_id, count(*) AS n FROM p JOIN m USING (vec_id) WHERE label <> other_label AND d > pos - 0.2 AND d < pos GROUP BY ALL")
def semi_hard_negatives(spark, d):
    pairs = _pairs(spark, d)
    far = pairs.where("label = other_label").groupBy("vec_id").agg(F.max("d").alias("pos"))
    return pairs.join(far, "vec_id").where("label <> other_label AND d > pos - 0.2D AND d < pos").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {PAIRS} SELECT round(avg(CASE WHEN label = other_label THEN d * d ELSE greatest(0.5 - d, 0) * greatest(0.5 - d, 0) END), 6) AS loss, count(*) AS n FROM p")
def contrastive_loss(spark, d):
    hinge = F.greatest(0.5 - F.col("d"), F.lit(0.0))
    return _pairs(spark, d).agg(F.round(F.avg(F.when(F.col("label") == F.col("other_label"), F.col("d") * F.col("d")).otherwise(hinge * hinge)), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT * FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 500) SELECT round(greatest(median(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ** 2)))), 1e-8), 6) AS sigma FROM w a JOIN w b ON a.vec_id < b.vec_id")
def pairwise_sigma_median(spark, d):
    """The kernel width over a window's rows, of which 500 at most are drawn, by the hash of their id."""
    rows = _emb(spark, d).select("vec_id", "embedding").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(500)
    other = rows.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e"))
    return rows.join(other, F.col("vec_id") < F.col("other")).agg(F.round(F.greatest(F.median(F.sqrt(V.squared_distance(F.col("embedding"), F.col("e")))), F.lit(1e-8)), 6).alias("sigma"))


@query(f"""WITH {CENTRES}, u AS (SELECT vec_id, label, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS u FROM x), s AS (SELECT label, i, sum(u) AS s, count(*) AS n FROM u GROUP BY ALL),
q AS (SELECT u.vec_id, u.label, s.label AS k, any_value(n) AS n, sum(u * s) AS dot FROM u JOIN s USING (i) GROUP BY ALL),
ab AS (SELECT vec_id, label, max(CASE WHEN k = label AND n > 1 THEN (n - dot) / (n - 1) END) AS a, min(CASE WHEN k <> label THEN 1 - dot / n END) AS b FROM q GROUP BY ALL)
SELECT label, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY ALL""")
def silhouette_cosine(spark, d):
    return V.cosine_silhouette(_emb(spark, d), "label", "vec_id", "embedding").groupBy("label").agg(F.round(F.avg("silhouette"), 6).alias("silhouette"))


_RNG = np.random.default_rng(42)
WEIGHTS, SHIFTS = _RNG.standard_normal((8, 4)).round(6).tolist(), (_RNG.random(8) * 2 * np.pi).round(6).tolist()
_PHI = ", ".join(f"sqrt(0.25) * cos({' + '.join(f'embedding[{i + 1}]::DOUBLE * ({w})' for i, w in enumerate(ws))} + {b})" for ws, b in zip(WEIGHTS, SHIFTS, strict=True))


def _phi(spark, d):
    return _emb(spark, d).withColumn("phi", V.fourier(F.slice("embedding", 1, 4), WEIGHTS, SHIFTS))


@query(f"WITH f AS (SELECT vec_id, unnest(range(0, 8))::INT AS i, unnest([{_PHI}]) AS x FROM embeddings) SELECT vec_id, i, round(x, 6) + 0.0 AS x FROM f")
def rff_features(spark, d):
    return _phi(spark, d).select("vec_id", F.posexplode("phi").alias("i", "x")).withColumn("x", F.round("x", 6) + 0.0)


@query(f"WITH f AS (SELECT label, unnest(range(0, 8)) AS i, unnest([{_PHI}]) AS x FROM embeddings), m AS (SELECT i, avg(x) FILTER (WHERE label = 0) AS p, avg(x) FILTER (WHERE label <> 0) AS q FROM f GROUP BY ALL) SELECT round(sum((p - q) * (p - q)), 8) AS mmd2 FROM m")
def mmd_rff(spark, d):
    return V.mmd2(_phi(spark, d).withColumn("ref", F.col("label") == 0), "ref").withColumn("mmd2", F.round("mmd2", 8))


@query()
def mahalanobis_ood(spark, d):
    """Open-set scores by the distance to class means under a tied, shrunk covariance. The d x d moments are summed by Spark."""
    rows = _emb(spark, d)
    means, precision = M.mahalanobis_fit(rows, "label", "embedding")
    return M.mahalanobis_scores(rows, means, precision, "vec_id", "embedding")


@query()
def openmax_proba(spark, d):
    """Known and unknown probabilities from Weibull tails of the distances to class means."""
    rows = _emb(spark, d)
    centres = V.centroids(rows, "label", "embedding")
    both = rows.join(centres, "label").select("label", F.sqrt(V.squared_distance(F.col("embedding"), F.col("centroid"))).alias("distance"))
    return M.openmax(rows, centres, M.weibull_tails(both, "label", 20), "vec_id", "label", "embedding")


@query()
def agglomerative_k(spark, d):
    """Average-linkage clusters for each k with silhouettes and gaps. Every row belongs to the nearest of at most 400 leaders, whose exact sizes and sums are clustered; with fewer rows each is its own."""
    rows = _emb(spark, d).select("vec_id", "embedding")
    leaders = np.stack([r.embedding for r in rows.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(400).collect()])
    groups = M.gathered(rows, leaders, "embedding")
    return groups.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: M.cluster_table(pdf, range(2, 13)), "k int, silhouette double, gap double, gap_se double, chosen boolean")


@query()
def ovr_logreg_auroc(spark, d):
    """One-vs-rest logistic regression with balanced weights, trained on four fifths, and its area under the curve for each class."""
    rows = _emb(spark, d).withColumn("train", F.col("vec_id") % 5 != 0)
    classes = rows.select("label").distinct()
    spread = rows.join(F.broadcast(classes.select(F.col("label").alias("target"))))
    return spread.groupBy("target").applyInPandas(lambda pdf: M.one_vs_rest(pdf), "target int, auroc double, n_pos int, n_neg int")


@query("""WITH x AS (SELECT vec_id, label, vec_id % 8 AS bin, i, embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) g(i)), u AS (SELECT vec_id, label, bin, i, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM x),
own AS (SELECT label, i, avg(v) AS m FROM u WHERE bin < 2 AND label % 4 <> 3 GROUP BY ALL), whole AS (SELECT i, avg(v) AS m FROM u WHERE bin < 2 AND label % 4 <> 3 GROUP BY ALL),
c AS (SELECT l.label, w.i, coalesce(o.m, w.m) AS m FROM (SELECT DISTINCT label FROM u) l CROSS JOIN whole w LEFT JOIN own o ON o.label = l.label AND o.i = w.i), n AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY ALL),
d AS (SELECT u.label, u.bin, u.vec_id, 1 - sum(v * m) / any_value(n) AS d FROM u JOIN c USING (label, i) JOIN n ON n.label = u.label GROUP BY ALL)
SELECT label, bin::INT AS bin, round(avg(d), 6) AS score FROM d GROUP BY ALL""")
def semantic_anomaly_score(spark, d):
    """The mean cosine distance of each service's lines (by bin) to its baseline centroid, that of its first quarter of bins, or to the whole baseline's where it has none (here every fourth service)."""
    rows = _emb(spark, d).withColumn("bin", (F.col("vec_id") % 8).cast("int")).withColumn("u", V.unit(F.col("embedding")))
    base = rows.where("bin < 2 AND label % 4 <> 3")
    own, whole = V.centroids(base, "label", "u"), V.centroids(base.withColumn("all", F.lit(1)), "all", "u").select(F.col("centroid").alias("whole"))
    both = rows.join(F.broadcast(own), "label", "left").join(F.broadcast(whole)).withColumn("c", F.coalesce("centroid", "whole"))
    distance = 1 - V.dot(F.col("u"), F.col("c")) / F.sqrt(V.dot(F.col("c"), F.col("c")))
    return both.groupBy("label", "bin").agg(F.round(F.avg(distance), 6).alias("score"))
