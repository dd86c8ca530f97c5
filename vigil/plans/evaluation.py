"""Evaluation of alerts and scores, resampled intervals, and selections. Events are predictions: value / 100 is a probability, an error event a positive."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigil.functions import statistics as S
from vigil.plans.graph import rounded
from vigil.plans.registry import query
from vigil.sources.adapters import seconds, table

AL = "al AS (SELECT event_id, user_id AS episode_id, event_type AS cluster, epoch_us(ts) / 1e6 AS ts, value, (event_type = 'error')::INT AS y FROM events)"


def _alerts(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("episode_id"), F.col("event_type").alias("cluster"), seconds("ts").alias("ts"), "value", (F.col("event_type") == "error").cast("int").alias("y"))


@query(f"""WITH {AL}, c AS (SELECT i, sum((value >= 5 * i AND y = 1)::INT) AS tp, sum((value >= 5 * i AND y = 0)::INT) AS fp, sum(y) AS p, sum(1 - y) AS n FROM al, range(1, 20) g(i) GROUP BY i)
SELECT i::INT AS step, tp::BIGINT AS tp, fp::BIGINT AS fp, round(tp / p, 6) AS tpr, round(fp / n, 6) AS fpr, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision_ FROM c""")
def threshold_sweep(spark, d):
    """Rates at the thresholds 0.05, 0.10 ... 0.95 (step x 0.05). Rows are counted once by the last threshold that they reach; sums over the 20 steps follow."""
    step = F.greatest(F.lit(0), F.least(F.lit(19), F.floor(F.col("value") / 5))).cast("int")
    counts = _alerts(spark, d).groupBy(step.alias("step")).agg(F.sum("y").alias("y"), F.sum(1 - F.col("y")).alias("x"))
    full = spark.range(20).select(F.col("id").cast("int").alias("step")).join(F.broadcast(counts), "step", "left")
    down = W.partitionBy().orderBy(F.col("step").desc()).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy()
    c = full.select("step", F.coalesce(F.sum("y").over(down), F.lit(0)).alias("tp"), F.coalesce(F.sum("x").over(down), F.lit(0)).alias("fp"), F.sum("y").over(whole).alias("p"), F.sum("x").over(whole).alias("n")).where("step > 0")
    ratio = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    return rounded(c.select("step", "tp", "fp", (F.col("tp") / F.col("p")).alias("tpr"), (F.col("fp") / F.col("n")).alias("fpr"), ratio.alias("precision_")), "tpr", "fpr", "precision_")


@query(f"""WITH {AL}, e AS (SELECT episode_id, min(ts) FILTER (WHERE cluster = 'purchase') AS t0, count(*) AS k FROM al GROUP BY ALL),
a AS (SELECT h.t, e.episode_id, any_value(t0) AS t0, min(ts) FILTER (WHERE value >= h.t) AS first, sum((value >= h.t)::INT) AS n, sum((value >= h.t AND y = 1)::INT) AS hit FROM e JOIN al USING (episode_id), (VALUES (50), (70), (90)) h(t) GROUP BY h.t, e.episode_id)
SELECT t::INT AS threshold, count(*) AS episodes, round(avg((first <= t0)::INT) FILTER (WHERE t0 IS NOT NULL), 6) AS detection, round(sum(hit) / sum(n), 6) AS correct, round(avg((first IS NOT NULL)::INT) FILTER (WHERE t0 IS NULL), 6) AS false_alarm, round(avg(t0 - first) FILTER (WHERE first <= t0), 3) AS lead_s FROM a GROUP BY t""")
def alert_metrics(spark, d):
    """For three thresholds: the share of episodes with an alert by their injection (the first purchase), of alerts for the right cluster, of quiet episodes with an alert, and the mean lead. Events are folded per episode before the thresholds meet."""
    rows = _alerts(spark, d)
    levels = (50, 70, 90)
    per = [F.struct(F.lit(t).alias("t"), F.min(F.when(F.col("value") >= t, F.col("ts"))).alias("first"), F.sum((F.col("value") >= t).cast("int")).alias("n"), F.sum(((F.col("value") >= t) & (F.col("y") == 1)).cast("int")).alias("hit")) for t in levels]
    folded = rows.groupBy("episode_id").agg(F.min(F.when(F.col("cluster") == "purchase", F.col("ts"))).alias("t0"), F.array(*per).alias("per"))
    a = folded.select("t0", F.explode("per").alias("x")).select("t0", "x.*")
    early = F.col("first") <= F.col("t0")
    return a.groupBy(F.col("t").cast("int").alias("threshold")).agg(
        F.count(F.lit(1)).alias("episodes"),
        F.round(F.avg(F.when(F.col("t0").isNotNull() & F.col("first").isNotNull(), early.cast("int"))), 6).alias("detection"),
        F.round(F.sum("hit") / F.sum("n"), 6).alias("correct"),
        F.round(F.avg(F.when(F.col("t0").isNull(), F.col("first").isNotNull().cast("int"))), 6).alias("false_alarm"),
        F.round(F.avg(F.when(early, F.col("t0") - F.col("first"))), 3).alias("lead_s"),
    )


@query(f"WITH {AL} SELECT episode_id, event_id, (row_number() OVER w)::INT AS place, round(value / 100, 6) AS probability FROM al WHERE value >= 80 WINDOW w AS (PARTITION BY episode_id ORDER BY value DESC, event_id) QUALIFY row_number() OVER w <= 5")
def alerts_ranked(spark, d):
    """The alerts of each episode by probability, the five likeliest."""
    order = W.partitionBy("episode_id").orderBy(F.col("value").desc(), "event_id")
    rows = _alerts(spark, d).where("value >= 80").withColumn("place", F.row_number().over(order))
    return rows.where("place <= 5").select("episode_id", "event_id", "place", F.round(F.col("value") / 100, 6).alias("probability"))


IMPORTANCE = "im AS (SELECT o_custkey % 8 AS cluster, 'f' || l_linenumber AS feature, avg(l_discount) - 0.05 AS importance FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)"


@query(f"WITH {IMPORTANCE} SELECT cluster::INT AS cluster, feature, round(importance, 6) AS importance FROM im WHERE abs(importance) > 1e-9 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY round(abs(importance), 9) DESC, feature) <= 5")
def top_features(spark, d):
    """The five features of each cluster with the largest importance, none of it without."""
    both = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = both.groupBy((F.col("o_custkey") % 8).cast("int").alias("cluster"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("feature")).agg((F.avg("l_discount") - 0.05).alias("importance"))
    order = W.partitionBy("cluster").orderBy(F.round(F.abs("importance"), 9).desc(), "feature")
    return rounded(rows.where(F.abs("importance") > 1e-9).withColumn("n", F.row_number().over(order)).where("n <= 5").drop("n"), "importance")


@query("SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best, round(list_max(embedding)::DOUBLE, 6) AS score FROM embeddings")
def argmax_class(spark, d):
    rows = table(spark, d, "embeddings")
    most = F.array_max("embedding")
    return rows.select("vec_id", (F.array_position("embedding", most) - 1).cast("int").alias("best"), F.round(most.cast("double"), 6).alias("score"))


@query("""WITH z AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: exp(x::DOUBLE)) AS e, exp(-abs(embedding[5]::DOUBLE)) AS known FROM embeddings)
SELECT vec_id, round(known * e[1] / list_sum(e), 6) AS p1, round(known * e[2] / list_sum(e), 6) AS p2, round(known * e[3] / list_sum(e), 6) AS p3, round(known * e[4] / list_sum(e), 6) AS p4, round(1 - known, 6) AS unknown FROM z""")
def softmax_known(spark, d):
    """Softmax of four logits times the chance that the class is a known one."""
    e = F.transform(F.slice("embedding", 1, 4), lambda x: F.exp(x.cast("double")))
    rows = table(spark, d, "embeddings").select("vec_id", e.alias("e"), F.exp(-F.abs(F.col("embedding")[4].cast("double"))).alias("known"))
    total = F.aggregate("e", F.lit(0.0), lambda s, x: s + x)
    return rows.select("vec_id", *[F.round(F.col("known") * F.col("e")[k] / total, 6).alias(f"p{k + 1}") for k in range(4)], F.round(1 - F.col("known"), 6).alias("unknown"))


@query("SELECT event_type AS cluster, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(event_id::VARCHAR || '-42'), event_id) <= 20")
def subsample_clusters(spark, d):
    """At most 20 rows of each cluster without replacement, by the hash of id and seed; hashes under the cluster's share are kept before any are sorted."""
    rows = table(spark, d, "events").select(F.col("event_type").alias("cluster"), "event_id", F.md5(F.concat(F.col("event_id").cast("string"), F.lit("-42"))).alias("h"))
    least = rows.groupBy("cluster", F.substring("h", 1, 2).alias("head")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("cluster").orderBy("head").rowsBetween(W.unboundedPreceding, -1))
    heads = least.withColumn("before", F.coalesce(before, F.lit(0))).where("before < 20").select("cluster", "head")
    some = rows.withColumn("head", F.substring("h", 1, 2)).join(F.broadcast(heads), ["cluster", "head"])
    return some.withColumn("n", F.row_number().over(W.partitionBy("cluster").orderBy("h", "event_id"))).where("n <= 20").select("cluster", "event_id")


DRAWS = "dr AS (SELECT r, ((g.i * 7919 + r * 104729 + g.i * r * 31 + 12345) % 1000003) % 25 AS j FROM range(0, 25) g(i), range(0, 200) h(r))"
NATIONS = "na AS (SELECT n_nationkey::BIGINT AS j, avg(c_acctbal) AS score, (n_nationkey % 2)::INT AS y FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def _draws(spark):
    """200 resamples of 25 numbers, by arithmetic."""
    return spark.range(25).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("r")).select("r", S.resample(F.col("i"), F.col("r"), 25).alias("j"))


def _nations(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("j")).agg(F.avg("c_acctbal").alias("score")).withColumn("y", (F.col("j") % 2).cast("int"))


def _bounds(rows, value):
    return [F.round(F.percentile(value, F.lit(q)), 6).alias(n) for n, q in (("low", 0.025), ("high", 0.975))]


@query(f"WITH {DRAWS}, {NATIONS}, b AS (SELECT r, avg((score > 4500)::INT) AS m FROM dr JOIN na USING (j) GROUP BY r) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM b")
def bootstrap_proportion_ci(spark, d):
    """Percentile interval of a proportion over 200 resamples."""
    means = _draws(spark).join(_nations(spark, d), "j").groupBy("r").agg(F.avg((F.col("score") > 4500).cast("int")).alias("m"))
    return means.agg(*_bounds(means, "m"))


@query(f"""WITH {DRAWS}, {NATIONS}, x AS (SELECT r, score, y FROM dr JOIN na USING (j)), k AS (SELECT *, rank() OVER (PARTITION BY r ORDER BY score) + (count(*) OVER (PARTITION BY r, score) - 1) / 2 AS rk FROM x),
b AS (SELECT r, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS a FROM k GROUP BY r HAVING sum(y) > 0 AND sum(1 - y) > 0)
SELECT round(quantile_cont(a, 0.025), 6) AS low, round(quantile_cont(a, 0.975), 6) AS high, count(*) AS n_effective FROM b""")
def bootstrap_auroc_ci(spark, d):
    """Percentile interval of the area under the curve; resamples of one class are passed over."""
    x = _draws(spark).join(_nations(spark, d), "j").groupBy("r", "score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    below = F.coalesce(F.sum("q").over(W.partitionBy("r").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    won = x.withColumn("w", F.col("p") * (below + F.col("q") / 2.0)).groupBy("r").agg((F.sum("w") / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("a")).where("a IS NOT NULL")
    return won.agg(*_bounds(won, "a"), F.count(F.lit(1)).alias("n_effective"))


HORIZONS = "hz AS (SELECT c_nationkey::BIGINT AS j, (c_custkey % 5)::INT AS k, avg(c_acctbal) AS auroc FROM customer GROUP BY ALL)"


@query(f"""WITH {DRAWS}, {HORIZONS}, m AS (SELECT r, k, avg(auroc) AS a FROM dr JOIN hz USING (j) GROUP BY ALL), best AS (SELECT r, k FROM m QUALIFY row_number() OVER (PARTITION BY r ORDER BY round(a, 9) DESC, k) = 1)
SELECT k, count(*) AS n, round(count(*) / 200, 6) AS share, row_number() OVER (ORDER BY count(*) DESC, k) = 1 AS mode FROM best GROUP BY k""")
def k_stability(spark, d):
    """How often each horizon is the best over the resamples, and the one that is so most often."""
    hz = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("j"), (F.col("c_custkey") % 5).cast("int").alias("k")).agg(F.avg("c_acctbal").alias("auroc"))
    m = _draws(spark).join(hz, "j").groupBy("r", "k").agg(F.avg("auroc").alias("a"))
    best = m.groupBy("r").agg(F.max(F.struct(F.round("a", 9).alias("a"), (-F.col("k")).alias("k"))).alias("b")).groupBy((-F.col("b.k")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    most = best.agg(F.max(F.struct("n", (-F.col("k")).alias("k"))).alias("m"))
    return best.join(F.broadcast(most)).select("k", "n", F.round(F.col("n") / 200, 6).alias("share"), (F.col("k") == -F.col("m.k")).alias("mode"))


@query("""WITH f AS (SELECT DISTINCT event_type AS fold FROM events), n AS (SELECT event_type AS scenario, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL)
SELECT fold, sum(n) FILTER (WHERE scenario <> fold)::BIGINT AS n_train, sum(n) FILTER (WHERE scenario = fold)::BIGINT AS n_test, round(sum(n * mean) FILTER (WHERE scenario <> fold) / sum(n) FILTER (WHERE scenario <> fold), 6) AS train_mean FROM f, n GROUP BY fold""")
def leave_one_out_folds(spark, d):
    """One fold for each scenario: sizes of both parts and the training mean, from the scenarios' own sums."""
    n = table(spark, d, "events").groupBy(F.col("event_type").alias("scenario")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"))
    whole = n.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    return n.join(F.broadcast(whole)).select(F.col("scenario").alias("fold"), (F.col("all_n") - F.col("n")).alias("n_train"), F.col("n").alias("n_test"), F.round((F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n")), 6).alias("train_mean"))


@query("""WITH a AS (SELECT event_id, event_type AS scenario, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS k, user_id FROM events), b AS (SELECT user_id, event_type AS scenario, value, row_number() OVER (PARTITION BY event_type, user_id ORDER BY md5(event_id::VARCHAR), event_id) AS k FROM events)
SELECT a.event_id, b.value AS label FROM a JOIN b USING (scenario, user_id, k)""")
def stratified_permutation(spark, d):
    """Labels dealt anew inside each stratum (scenario and user): the k-th id takes the label of the k-th hash."""
    rows = table(spark, d, "events").select("event_id", F.col("event_type").alias("scenario"), "user_id", "value")
    own = W.partitionBy("scenario", "user_id")
    a = rows.select("event_id", "scenario", "user_id", F.row_number().over(own.orderBy("event_id")).alias("k"))
    b = rows.select("scenario", "user_id", F.col("value").alias("label"), F.row_number().over(own.orderBy(F.md5(F.col("event_id").cast("string")), "event_id")).alias("k"))
    return a.join(b, ["scenario", "user_id", "k"]).select("event_id", "label")


PAIRED = "pd AS (SELECT n_regionkey AS region, n_nationkey AS id, round(avg(c_acctbal), 4) - round(avg(s_acctbal), 4) AS diff FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)"


def _paired(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.round(F.avg("c_acctbal"), 4).alias("a"))
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.round(F.avg("s_acctbal"), 4).alias("b"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))
    return n.join(c, "id").join(s, "id").select("region", "id", (F.col("a") - F.col("b")).alias("diff"))


@query(f"WITH {PAIRED} SELECT region::INT AS region, count(*) AS n, round(avg(diff), 4) AS mean, CASE WHEN count(*) > 1 THEN round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) END AS t FROM pd GROUP BY ALL")
def paired_t(spark, d):
    """The statistic of a paired one-sided t-test in each region."""
    n = F.count(F.lit(1))
    t = F.when(n > 1, F.avg("diff") / (F.stddev_samp("diff") / F.sqrt(n)))
    return _paired(spark, d).groupBy(F.col("region").cast("int").alias("region")).agg(n.alias("n"), F.round(F.avg("diff"), 4).alias("mean"), F.round(t, 6).alias("t"))


@query(f"""WITH {PAIRED}, r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2 AS rk FROM pd WHERE diff <> 0)
SELECT count(*) AS n, round(sum(CASE WHEN diff > 0 THEN rk ELSE 0 END), 3) AS w_plus, round(sum(CASE WHEN diff < 0 THEN rk ELSE 0 END), 3) AS w_minus, round((least(sum(CASE WHEN diff > 0 THEN rk ELSE 0 END), sum(CASE WHEN diff < 0 THEN rk ELSE 0 END)) - count(*) * (count(*) + 1) / 4) / sqrt(count(*) * (count(*) + 1) * (2 * count(*) + 1) / 24), 6) AS z FROM r""")
def wilcoxon_signed_rank(spark, d):
    """Signed rank sums of paired differences, one row a nation, and their normal approximation."""
    r = _paired(spark, d).where("diff <> 0").withColumn("m", F.abs("diff")).withColumn("rk", S.average_rank("m"))
    plus, minus, n = F.sum(F.when(F.col("diff") > 0, F.col("rk")).otherwise(0.0)), F.sum(F.when(F.col("diff") < 0, F.col("rk")).otherwise(0.0)), F.count(F.lit(1))
    z = (F.least(plus, minus) - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return r.agg(n.alias("n"), F.round(plus, 3).alias("w_plus"), F.round(minus, 3).alias("w_minus"), F.round(z, 6).alias("z"))


@query("""WITH sc AS (SELECT d.source AS type, d.n_chars AS score, quality AS y FROM documents d JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT *, rank() OVER (PARTITION BY type ORDER BY score) + (count(*) OVER (PARTITION BY type, score) - 1) / 2 AS rk FROM sc),
a AS (SELECT type, sum(y) AS p, sum(1 - y) AS q, (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS a FROM k GROUP BY type HAVING sum(y) >= 2 AND sum(1 - y) >= 2)
SELECT type, round(a, 6) AS auroc, round(sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (q - 1) * (2 * a * a / (1 + a) - a * a)) / (p * q)), 6) AS se FROM a""")
def auroc_power(spark, d):
    """The standard error of each type's area under the curve by Hanley and McNeil's formula."""
    from vigil.plans.mining import _scores

    a, p, q = F.col("auroc"), F.col("n_pos"), F.col("n_neg")
    se = F.sqrt((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (q - 1) * (2 * a * a / (1 + a) - a * a)) / (p * q))
    return rounded(S.auroc(_scores(spark, d), ["type"], "score", "y").where("auroc IS NOT NULL").select("type", "auroc", se.alias("se")), "auroc", "se")


@query(f"""WITH {AL}, s AS (SELECT cluster, avg(value) AS m, stddev_pop(value) AS sd FROM al GROUP BY ALL), x AS (SELECT cluster, abs(value - m) > sd AS drift, value >= 70 AS alert FROM al JOIN s USING (cluster))
SELECT cluster, round(avg(drift::INT), 6) AS drift_rate, round(avg(alert::INT), 6) AS alert_rate, round(avg((drift AND alert)::INT), 6) AS overlap FROM x GROUP BY ALL""")
def drift_alert_overlap(spark, d):
    """How often drift and alerts fall together in each cluster."""
    rows = _alerts(spark, d)
    fit = rows.groupBy("cluster").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    x = rows.join(F.broadcast(fit), "cluster").select("cluster", (F.abs(F.col("value") - F.col("m")) > F.col("sd")).alias("drift"), (F.col("value") >= 70).alias("alert"))
    return x.groupBy("cluster").agg(*[F.round(F.avg(c.cast("int")), 6).alias(n) for n, c in (("drift_rate", F.col("drift")), ("alert_rate", F.col("alert")), ("overlap", F.col("drift") & F.col("alert")))])
