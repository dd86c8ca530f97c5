"""Mining and statistics."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.functions import models as M
from vigil.functions import statistics as S
from vigil.plans.graph import rounded
from vigil.plans.registry import query
from vigil.sources.adapters import SIGNAL, seconds, signal, table

EPISODES = """ep AS (SELECT o_orderkey AS episode_id, epoch_us(o_orderdate) / 1e6 AS t0, (o_custkey % 5)::INT AS cluster FROM orders)"""


def _episodes(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("episode_id"), seconds("o_orderdate").alias("t0"), (F.col("o_custkey") % 5).cast("int").alias("cluster"))


@query(f"""WITH {EPISODES}, n AS (SELECT cluster AS source, lead(cluster) OVER w AS target, lead(t0) OVER w - t0 AS gap FROM ep WINDOW w AS (ORDER BY t0, episode_id))
SELECT source, target, count(*) AS support, round(avg(gap), 3) AS delta_t_mean, round(stddev_pop(gap), 3) AS delta_t_std FROM n WHERE gap BETWEEN 0 AND 172800 GROUP BY ALL HAVING count(*) >= 3""")
def temporal_relations(spark, d):
    """Transitions between consecutive episodes. Neighbours are found inside day partitions; only each day's ends meet across days."""
    rows = _episodes(spark, d).withColumn("day", F.floor(F.col("t0") / 86400))
    order = W.partitionBy("day").orderBy("t0", "episode_id")
    inside = rows.withColumns({"target": F.lead("cluster").over(order), "next": F.lead("t0").over(order)})
    days = rows.groupBy("day").agg(F.min(F.struct("t0", "episode_id", "cluster")).alias("first"))
    across = days.withColumn("head", F.lead("first").over(W.orderBy("day"))).select("day", "head")  # one row a day
    pairs = inside.join(F.broadcast(across), "day").select(F.col("cluster").alias("source"), F.coalesce("target", "head.cluster").alias("target"), (F.coalesce("next", "head.t0") - F.col("t0")).alias("gap"))
    found = pairs.where("gap BETWEEN 0 AND 172800").groupBy("source", "target").agg(F.count(F.lit(1)).alias("support"), F.round(F.avg("gap"), 3).alias("delta_t_mean"), F.round(F.stddev_pop("gap"), 3).alias("delta_t_std"))
    return found.where("support >= 3")


PRESENCE = """pr AS (SELECT DISTINCT o_custkey AS scenario, month(o_orderdate)::INT AS cluster FROM orders), nn AS (SELECT count(DISTINCT scenario) AS n FROM pr), k AS (SELECT cluster, count(*) AS k FROM pr GROUP BY ALL),
t AS (SELECT x.cluster AS c1, y.cluster AS c2, count(*) AS a FROM pr x JOIN pr y ON x.scenario = y.scenario AND x.cluster < y.cluster GROUP BY ALL HAVING count(*) >= 2),
tab AS (SELECT c1, c2, a, p.k - a AS b, q.k - a AS c, n - p.k - q.k + a AS d FROM t JOIN k p ON p.cluster = c1 JOIN k q ON q.cluster = c2, nn)"""


def _tables(spark, d):
    pr = table(spark, d, "orders").select(F.col("o_custkey").alias("scenario"), F.month("o_orderdate").cast("int").alias("cluster")).distinct()
    n = pr.agg(F.countDistinct("scenario").alias("n"))
    k = pr.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"))
    pairs = pr.select("scenario", F.col("cluster").alias("c1")).join(pr.select("scenario", F.col("cluster").alias("c2")), "scenario").where("c1 < c2")
    t = pairs.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("a")).where("a >= 2")
    t = t.join(k.select(F.col("cluster").alias("c1"), F.col("k").alias("p")), "c1").join(k.select(F.col("cluster").alias("c2"), F.col("k").alias("q")), "c2").join(F.broadcast(n))
    return t.select("c1", "c2", "a", (F.col("p") - F.col("a")).alias("b"), (F.col("q") - F.col("a")).alias("c"), (F.col("n") - F.col("p") - F.col("q") + F.col("a")).alias("d"))


def _cell(o, r, s):
    return f"CASE WHEN ({r}) * ({s}) > 0 THEN greatest(abs({o} - ({r}) * ({s}) / (a + b + c + d)) - 0.5, 0) ** 2 / (({r}) * ({s}) / (a + b + c + d)) ELSE 0 END"


@query(f"WITH {PRESENCE} SELECT c1, c2, a, b, c, d, round({_cell('a', 'a + b', 'a + c')} + {_cell('b', 'a + b', 'b + d')} + {_cell('c', 'c + d', 'a + c')} + {_cell('d', 'c + d', 'b + d')}, 6) AS chi2 FROM tab")
def cooccurrence_chi2(spark, d):
    return _tables(spark, d).withColumn("chi2", F.round(S.yates(*[F.col(c) for c in "abcd"]), 6))


@query()
def cooccurrence_relations(spark, d):
    """Pairs with p values (chi-square or Fisher) and their BH adjustment."""
    cells = [F.col(c) for c in "abcd"]
    rows = _tables(spark, d).withColumns({"chi2": S.yates(*cells), "expected": S.least_expected(*cells)})
    rows = rows.withColumn("p", S.association_p("chi2", "expected", "a", "b", "c", "d")).withColumn("id", F.col("c1") * 100 + F.col("c2"))
    return rounded(S.adjust(rows, "p", "id", "bh"), "chi2", "expected", "p", "p_adjusted")


@query("SELECT least(a, b) AS c1, greatest(a, b) AS c2, count(*) AS n FROM (SELECT (l_partkey % 7)::INT AS a, (l_suppkey % 7)::INT AS b FROM lineitem) GROUP BY ALL")
def composite_cooccurrence(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_partkey") % 7).cast("int").alias("a"), (F.col("l_suppkey") % 7).cast("int").alias("b"))
    return rows.groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.count(F.lit(1)).alias("n"))


TESTS = "tests AS (SELECT c_custkey AS id, (c_custkey * 37 % 997) / 2000.0::DOUBLE AS p FROM customer)"


def _tests(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 37 % 997 / 2000.0).cast("double").alias("p"))


@query(f"WITH {TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM tests) SELECT id, p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM r")
def bh_adjust(spark, d):
    return S.adjust(_tests(spark, d), "p", "id", "bh").withColumn("p_adjusted", F.round("p_adjusted", 9))


@query(f"WITH {TESTS}, r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM tests) SELECT id, p, round(least(1, max(p * (m - r + 1)) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING)), 9) AS p_adjusted FROM r")
def holm_adjust(spark, d):
    return S.adjust(_tests(spark, d), "p", "id", "holm").withColumn("p_adjusted", F.round("p_adjusted", 9))


def active_pairs(spark, d):
    """(cluster, src, dst): the weeks in which a supplier delivers a brand."""
    joined = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.weekofyear("l_shipdate").alias("cluster"), F.col("l_suppkey").alias("src"), F.col("p_brand").alias("dst")).distinct()


@query("""WITH e AS (SELECT DISTINCT week(l_shipdate)::INT AS cluster, l_suppkey AS src, p_brand AS dst FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT cluster) AS n FROM e)
SELECT src, dst, count(*) AS k FROM e, n GROUP BY src, dst, n HAVING count(*) <= 0.5 * n""")
def specificity_filter(spark, d):
    """Pairs seen in at most half of the active clusters."""
    rows = active_pairs(spark, d)
    n = rows.agg(F.countDistinct("cluster").alias("n"))
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).where("k <= 0.5 * n").drop("n")


COUNTS = "cc AS (SELECT (user_id % 10)::INT AS cluster, event_type AS scenario, count(*) AS n FROM events GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, scenario) AS r, sum(n) OVER (PARTITION BY cluster) AS total FROM cc)"


def _counts(spark, d):
    counts = table(spark, d, "events").groupBy((F.col("user_id") % 10).cast("int").alias("cluster"), F.col("event_type").alias("scenario")).agg(F.count(F.lit(1)).alias("n"))
    own = W.partitionBy("cluster")
    return counts.withColumns({"r": F.row_number().over(own.orderBy(F.col("n").desc(), "scenario")), "total": F.sum("n").over(own)})


@query(f"WITH {COUNTS} SELECT cluster, round(n / total, 4) AS purity FROM rk WHERE r = 1")
def cluster_purity(spark, d):
    return _counts(spark, d).where("r = 1").select("cluster", F.round(F.col("n") / F.col("total"), 4).alias("purity"))


@query(f"WITH {COUNTS} SELECT cluster, scenario, n FROM rk WHERE r <= 2")
def dominant_scenario(spark, d):
    return _counts(spark, d).where("r <= 2").select("cluster", "scenario", "n")


SCORES = "sc AS (SELECT d.source AS type, d.n_chars AS score, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
AUC = "SELECT type, sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg, CASE WHEN sum(y) >= 2 AND sum(1 - y) >= 2 THEN round((sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) END AS auroc FROM (SELECT *, rank() OVER (PARTITION BY type ORDER BY score) + (count(*) OVER (PARTITION BY type, score) - 1) / 2 AS rk FROM sc) GROUP BY ALL"


def _scores(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("type"), F.col("n_chars").alias("score"), F.col("quality").alias("y"))


@query(f"WITH {SCORES} {AUC}")
def auroc_per_type(spark, d):
    return rounded(S.auroc(_scores(spark, d), ["type"], "score", "y"), "auroc")


KSTAR = "ks AS (SELECT (c_nationkey % 6)::INT AS cluster, (c_custkey % 5)::INT AS k, round(avg(c_acctbal), 2) AS auroc FROM customer GROUP BY ALL)"


@query(f"WITH {KSTAR}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY auroc DESC, k) AS r FROM ks) SELECT cluster, k, auroc FROM r WHERE r = 1")
def k_star_select(spark, d):
    """The horizon with the best score of each cluster, the smaller one of equal ones."""
    rows = table(spark, d, "customer").groupBy((F.col("c_nationkey") % 6).cast("int").alias("cluster"), (F.col("c_custkey") % 5).cast("int").alias("k")).agg(F.round(F.avg("c_acctbal"), 2).alias("auroc"))
    order = W.partitionBy("cluster").orderBy(F.col("auroc").desc(), "k")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


RHO = "SELECT g, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT g, rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2 AS ry FROM z) GROUP BY ALL"


@query("WITH z AS (SELECT p_brand AS g, p_retailprice AS x, p_size AS y FROM part) " + RHO)
def spearman_features(spark, d):
    rows = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_retailprice").alias("x"), F.col("p_size").alias("y"))
    return rounded(S.spearman(rows, ["g"], "x", "y"), "rho")


@query("WITH z AS (SELECT a.i * 100 + b.i AS g, a.v AS x, b.v AS y FROM (SELECT vec_id, unnest(range(1, 9)) AS i, unnest(embedding[1:8])::DOUBLE AS v FROM embeddings) a JOIN (SELECT vec_id, unnest(range(1, 9)) AS i, unnest(embedding[1:8])::DOUBLE AS v FROM embeddings) b ON a.vec_id = b.vec_id AND a.i < b.i) SELECT (g // 100)::INT AS f1, (g % 100)::INT AS f2, rho FROM (" + RHO + ") WHERE abs(rho) > 0.05")
def redundancy_pairs(spark, d):
    """Pairs of features whose rank correlation is above a bound."""
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 8)).alias("i", "v")).select("vec_id", (F.col("i") + 1).alias("i"), F.col("v").cast("double").alias("v"))
    pairs = cells.select("vec_id", F.col("i").alias("f1"), F.col("v").alias("x")).join(cells.select("vec_id", F.col("i").alias("f2"), F.col("v").alias("y")), "vec_id").where("f1 < f2")
    return rounded(S.spearman(pairs, ["f1", "f2"], "x", "y"), "rho").where("abs(rho) > 0.05D").drop("n")


@query("SELECT s_nationkey, (1 + sum((s_acctbal >= 5000)::INT))::BIGINT AS above, round((1 + sum((s_acctbal >= 5000)::INT)) / (1 + count(*)), 6) AS p FROM supplier GROUP BY ALL")
def permutation_pvalue(spark, d):
    above = 1 + F.sum((F.col("s_acctbal") >= 5000).cast("int"))
    return table(spark, d, "supplier").groupBy("s_nationkey").agg(above.alias("above"), F.round(above / (1 + F.count(F.lit(1))), 6).alias("p"))


@query("""WITH x AS (SELECT n_nationkey AS i, avg(c_acctbal) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), b AS (SELECT r, avg(v) AS m FROM (SELECT r, ((g.i * 7919 + r * 104729 + g.i * r * 31 + 12345) % 1000003) % 25 AS j FROM range(0, 25) g(i), range(0, 200) h(r)) d JOIN x ON x.i = d.j GROUP BY ALL)
SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b""")
def bootstrap_percentile_ci(spark, d):
    """Percentile interval of a mean over 25 nations by 200 resamples."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("j")).agg(F.avg("c_acctbal").alias("v"))
    draws = spark.range(25).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("r")).withColumn("j", S.resample(F.col("i"), F.col("r"), 25))
    means = draws.join(c, "j").groupBy("r").agg(F.avg("v").alias("m"))
    return means.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


@query("WITH g AS (SELECT k, gap, s FROM (VALUES (2, 0.1::DOUBLE, 0.02::DOUBLE), (3, 0.5, 0.03), (4, 0.51, 0.05), (5, 0.4, 0.02)) v(k, gap, s)) SELECT min(k) AS k FROM (SELECT k, gap >= lead(gap) OVER (ORDER BY k) - lead(s) OVER (ORDER BY k) AS ok FROM g) WHERE ok")
def gap_tibshirani_rule(spark, d):
    g = spark.createDataFrame([(2, 0.1, 0.02), (3, 0.5, 0.03), (4, 0.51, 0.05), (5, 0.4, 0.02)], "k int, gap double, s double")
    order = W.partitionBy().orderBy("k")
    return g.withColumn("ok", F.col("gap") >= F.lead("gap").over(order) - F.lead("s").over(order)).where("ok").agg(F.min("k").alias("k"))


@query(f"""WITH {SCORES}, s AS (SELECT score AS threshold, avg(y::DOUBLE) FILTER (WHERE true) AS z FROM sc GROUP BY ALL), n AS (SELECT sum(y) AS p, sum(1 - y) AS q FROM sc),
t AS (SELECT score AS threshold, sum(y) AS y, sum(1 - y) AS x FROM sc GROUP BY ALL), c AS (SELECT threshold, sum(y) OVER w / any_value(p) OVER () AS tpr, sum(x) OVER w / any_value(q) OVER () AS fpr FROM t, n WINDOW w AS (ORDER BY threshold DESC))
SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM c ORDER BY round(tpr - fpr, 9) DESC, threshold DESC LIMIT 1""")
def youden_threshold(spark, d):
    """The threshold with the largest true-positive rate less the false-positive rate, over the different scores."""
    t = _scores(spark, d).groupBy(F.col("score").alias("threshold")).agg(F.sum("y").alias("y"), F.sum(1 - F.col("y")).alias("x"))
    up = W.partitionBy().orderBy(F.col("threshold").desc()).rowsBetween(W.unboundedPreceding, 0)
    c = t.select("threshold", (F.sum("y").over(up) / F.sum("y").over(W.partitionBy())).alias("tpr"), (F.sum("x").over(up) / F.sum("x").over(W.partitionBy())).alias("fpr"))
    return rounded(c.orderBy(F.round(F.col("tpr") - F.col("fpr"), 9).desc(), F.col("threshold").desc()).limit(1), "tpr", "fpr")


@query(f"""WITH {COUNTS}, t AS (SELECT sum(n) AS t FROM cc), a AS (SELECT cluster, sum(n) AS n FROM cc GROUP BY ALL), b AS (SELECT scenario, sum(n) AS n FROM cc GROUP BY ALL),
mi AS (SELECT sum(cc.n / t * ln(cc.n * t / (a.n * b.n))) AS mi FROM cc JOIN a USING (cluster) JOIN b USING (scenario), t), h AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM a, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hb)
SELECT round(mi / ((ha + hb) / 2), 6) AS nmi FROM mi, h""")
def cluster_nmi(spark, d):
    """Normalised mutual information of clusters and scenarios."""
    cc = _counts(spark, d).select("cluster", "scenario", "n").withColumn("t", F.sum("n").over(W.partitionBy()))
    full = cc.withColumns({"a": F.sum("n").over(W.partitionBy("cluster")), "b": F.sum("n").over(W.partitionBy("scenario"))})
    mi = full.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("mi"))

    def entropy(key, name):
        return cc.groupBy(key, "t").agg(F.sum("n").alias("k")).agg((-F.sum(F.col("k") / F.col("t") * F.log(F.col("k") / F.col("t")))).alias(name))

    return mi.join(entropy("cluster", "ha")).join(entropy("scenario", "hb")).select(F.round(F.col("mi") / ((F.col("ha") + F.col("hb")) / 2), 6).alias("nmi"))


@query(f"WITH {SIGNAL}, s AS (SELECT service, avg(value) AS m, stddev_pop(value) AS sd FROM signal WHERE t < 15 GROUP BY ALL) SELECT episode_id, t, service FROM signal JOIN s USING (service) WHERE abs(value - m) > 2.5 * sd")
def zscore_alerts(spark, d):
    rows = signal(spark, d)
    fit = rows.where("t < 15").groupBy("service").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return rows.join(fit, "service").where("abs(value - m) > 2.5D * sd").select("episode_id", "t", "service")


def _series(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    wide = pdf.pivot_table(index="t", columns="service", values="value", aggfunc="mean").sort_index().fillna(0.0)
    return {c: wide[c].to_numpy() for c in wide.columns}


@query()
def ksg_mi(spark, d):
    """Mutual information of each pair of services in each group of ten episodes."""

    def run(pdf):
        s = _series(pdf)
        names = sorted(s)
        return pd.DataFrame([(int(pdf["g"].iloc[0]), a, b, round(M.mutual_information(s[a], s[b]), 6)) for i, a in enumerate(names) for b in names[i + 1 :]], columns=["g", "a", "b", "mi"])

    return signal(spark, d).withColumn("g", (F.col("episode_id") % 10).cast("int")).groupBy("g").applyInPandas(run, "g int, a string, b string, mi double")


@query()
def transfer_entropy(spark, d):
    """Transfer entropy of each ordered pair of services with permutation p values, and their BH adjustment."""

    def run(pdf):
        s, g = _series(pdf), int(pdf["g"].iloc[0])
        rng, out = np.random.default_rng(42 + g), []
        for a in sorted(s):
            for b in sorted(s):
                if a != b:
                    te = M.transfer_entropy(s[a], s[b])
                    p = M.permutation_p(te, np.array([M.transfer_entropy(rng.permutation(s[a]), s[b]) for _ in range(20)]))
                    out.append((g, a, b, round(te, 6), p))
        return pd.DataFrame(out, columns=["g", "source", "target", "te", "p"])

    found = signal(spark, d).withColumn("g", (F.col("episode_id") % 4).cast("int")).groupBy("g").applyInPandas(run, "g int, source string, target string, te double, p double")
    return S.adjust(found.withColumn("id", F.concat_ws(":", "g", "source", "target")), "p", "id", "bh").drop("id")
