"""Knowledge-graph queries over triples (s, p, o, o_num). Closures double the paths' length each round until nothing changes, so cycles end."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.graph import reach
from vigil.plans.registry import query
from vigil.sources.adapters import table


def triples(spark, d) -> DataFrame:
    """Regions are classes, nations their subclasses, suppliers things of these; a nation causes the next of its region."""
    nation, supplier = table(spark, d, "nation"), table(spark, d, "supplier")

    def name(kind, key):
        return F.concat(F.lit(kind), F.col(key).cast("string"))

    none = F.lit(None).cast("double")
    parts = [
        nation.select(name("n", "n_nationkey").alias("s"), F.lit("subClassOf").alias("p"), name("r", "n_regionkey").alias("o"), none.alias("o_num")),
        table(spark, d, "region").select(name("r", "r_regionkey"), F.lit("subClassOf"), F.lit("Anomaly"), none),
        supplier.select(name("s", "s_suppkey"), F.lit("type"), name("n", "s_nationkey"), none),
        supplier.select(name("s", "s_suppkey"), F.lit("weight"), F.lit(None).cast("string"), (F.col("s_acctbal") / 10000).alias("o_num")),
        nation.where("n_nationkey < 20").select(name("n", "n_nationkey"), F.lit("causes"), F.concat(F.lit("n"), (F.col("n_nationkey") + 5).cast("string")), none),
        nation.where("n_nationkey % 5 = 2").select(name("n", "n_nationkey"), F.lit("affects"), name("svc", "n_regionkey"), none),
        nation.select(name("n", "n_nationkey"), F.lit("leadTime"), F.lit(None).cast("string"), F.col("n_nationkey") * 30.0),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


TRIPLES = """tr AS (SELECT 'n' || n_nationkey AS s, 'subClassOf' AS p, 'r' || n_regionkey AS o, NULL::DOUBLE AS o_num FROM nation UNION ALL SELECT 'r' || r_regionkey, 'subClassOf', 'Anomaly', NULL FROM region
UNION ALL SELECT 's' || s_suppkey, 'type', 'n' || s_nationkey, NULL FROM supplier UNION ALL SELECT 's' || s_suppkey, 'weight', NULL, s_acctbal / 10000 FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'causes', 'n' || (n_nationkey + 5), NULL FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'n' || n_nationkey, 'affects', 'svc' || n_regionkey, NULL FROM nation WHERE n_nationkey % 5 = 2
UNION ALL SELECT 'n' || n_nationkey, 'leadTime', NULL, n_nationkey * 30.0::DOUBLE FROM nation)"""
SUB = "sub(s, o, d) AS (SELECT s, o, 1 FROM tr WHERE p = 'subClassOf' UNION SELECT x.s, t.o, x.d + 1 FROM sub x JOIN tr t ON t.s = x.o AND t.p = 'subClassOf' WHERE x.d < 60)"
CAUSE = "cau(s, o, d) AS (SELECT s, o, 1 FROM tr WHERE p = 'causes' UNION SELECT x.s, t.o, x.d + 1 FROM cau x JOIN tr t ON t.s = x.o AND t.p = 'causes' WHERE x.d < 60)"


def closure(facts: DataFrame, predicate: str) -> DataFrame:
    """All pairs that a predicate reaches, with the least number of steps. The edges are those of a catalogue of classes."""
    return reach(facts.where(F.col("p") == predicate).select(F.col("s").alias("a"), F.col("o").alias("b"))).select(F.col("a").alias("s"), F.col("b").alias("o"), "d")


@query(f"WITH RECURSIVE {TRIPLES}, {SUB} SELECT s, o, min(d)::INT AS d FROM sub GROUP BY s, o")
def kg_subclass_closure(spark, d):
    return closure(triples(spark, d), "subClassOf")


@query(f"WITH RECURSIVE {TRIPLES}, {SUB} SELECT DISTINCT tr.s AS item FROM tr JOIN (SELECT DISTINCT s, o FROM sub) x ON x.s = tr.o WHERE p = 'type' AND x.o = 'r3'")
def kg_all_composites(spark, d):
    """Things whose class is below a given one."""
    facts = triples(spark, d)
    below = closure(facts, "subClassOf").where("o = 'r3'").select(F.col("s").alias("o"))
    return facts.where("p = 'type'").join(below, "o", "left_semi").select(F.col("s").alias("item")).distinct()


@query(f"WITH RECURSIVE {TRIPLES}, {CAUSE} SELECT DISTINCT o AS downstream FROM cau WHERE s = 'n2'")
def kg_downstream_memory(spark, d):
    return closure(triples(spark, d), "causes").where("s = 'n2'").select(F.col("o").alias("downstream")).distinct()


@query(f"WITH RECURSIVE {TRIPLES}, {CAUSE} SELECT cau.s AS cause, tr.o AS service FROM (SELECT DISTINCT s, o FROM cau) cau JOIN tr ON tr.s = cau.o AND tr.p = 'affects'")
def kg_services_cascading(spark, d):
    facts = triples(spark, d)
    return closure(facts, "causes").select(F.col("s").alias("cause"), F.col("o").alias("s")).join(facts.where("p = 'affects'").select("s", F.col("o").alias("service")), "s").drop("s")


@query(f"WITH {TRIPLES} SELECT s AS item, round(o_num, 6) AS weight FROM tr WHERE p = 'weight' AND o_num > 0.2")
def kg_heavy_features(spark, d):
    return triples(spark, d).where("p = 'weight' AND o_num > 0.2D").select(F.col("s").alias("item"), F.round("o_num", 6).alias("weight"))


@query(f"WITH RECURSIVE {TRIPLES}, {SUB} SELECT DISTINCT t.s AS item, l.o_num AS lead_s FROM tr t JOIN tr l ON l.s = t.o AND l.p = 'leadTime' WHERE t.p = 'type' AND l.o_num <= 300 AND t.o IN (SELECT s FROM sub WHERE o = 'Anomaly')")
def kg_fast_precursors(spark, d):
    facts = triples(spark, d)
    lead = facts.where("p = 'leadTime' AND o_num <= 300").select(F.col("s").alias("o"), F.col("o_num").alias("lead_s"))
    below = closure(facts, "subClassOf").where("o = 'Anomaly'").select(F.col("s").alias("o"))
    return facts.where("p = 'type'").select("s", "o").join(lead, "o").join(below, "o", "left_semi").select(F.col("s").alias("item"), "lead_s").distinct()


@query("""WITH e AS (SELECT DISTINCT week(l_shipdate)::INT AS cluster, l_suppkey AS src, p_brand AS dst FROM lineitem JOIN part ON l_partkey = p_partkey), n AS (SELECT count(DISTINCT cluster) AS n FROM e), ok AS (SELECT src, dst FROM e, n GROUP BY src, dst, n HAVING count(*) <= 0.5 * n)
SELECT DISTINCT 'c' || cluster AS s, 'propagatesThrough' AS p, dst AS o FROM e JOIN ok USING (src, dst)""")
def kg_propagation(spark, d):
    from vigil.plans.mining import active_pairs, specificity_filter

    rows = active_pairs(spark, d)
    kept = rows.join(specificity_filter(spark, d), ["src", "dst"], "left_semi")
    return kept.select(F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("s"), F.lit("propagatesThrough").alias("p"), F.col("dst").alias("o")).distinct()


@query(f"""WITH RECURSIVE {TRIPLES}, {SUB}, {CAUSE}, ty AS (SELECT DISTINCT tr.s, 'type' AS p, x.o FROM tr JOIN sub x ON x.s = tr.o WHERE p = 'type' UNION SELECT s, 'type', o FROM tr WHERE p = 'type'),
f AS (SELECT DISTINCT s, 'causes' AS p, o FROM cau UNION SELECT DISTINCT o, 'causedBy', s FROM cau UNION SELECT * FROM ty UNION SELECT DISTINCT s, 'subClassOf', o FROM sub)
SELECT p, count(*) AS n FROM f GROUP BY ALL""")
def kg_rule_closure(spark, d):
    """Counts of entailed triples: transitive subclasses and causes, the inverse of causes, and types along subclasses."""
    facts = triples(spark, d)
    sub, cause = closure(facts, "subClassOf"), closure(facts, "causes")
    types = facts.where("p = 'type'").select("s", "o")
    wider = types.join(sub.select(F.col("s").alias("o"), F.col("o").alias("up")), "o").select("s", F.col("up").alias("o"))
    parts = [types.union(wider).distinct().withColumn("p", F.lit("type")), cause.select("s", "o").withColumn("p", F.lit("causes")), cause.select(F.col("o").alias("s"), F.col("s").alias("o")).withColumn("p", F.lit("causedBy")), sub.select("s", "o").withColumn("p", F.lit("subClassOf"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
