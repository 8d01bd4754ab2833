"""Window uses on their own, over ``embeddings``, ``orders`` and sweep rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestor.operators import inference as N
from attestor.operators import mediation as M
from attestor.operators import ordering as O
from attestor.operators import registry as R
from attestor.workload.catalog import dense_features, query, r6, table
from attestor.workload.mediation_queries import MED, rows as mediation_rows
from attestor.workload.probing_queries import DENSE
from attestor.workload.sweep_tables import DUPLICATED, SWEEP, sweep, with_duplicate_point


@query(
    "e1_average_ranks",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS rank FROM lineitem",
)
def e1(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return O.average_ranks(rows, by=["l_returnflag"], score="l_quantity").drop("l_quantity")


@query(
    "e2_running_positives",
    """SELECT DISTINCT o_orderstatus, o_totalprice, (sum((o_orderpriority = '1-URGENT')::INT) OVER w)::BIGINT AS n_positive, count(*) OVER w AS n_rows FROM orders
    WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC RANGE UNBOUNDED PRECEDING)""",
)
def e2(spark, sf):
    rows = table(spark, sf, "orders").withColumn("y", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    return O.running_positives(rows, by=["o_orderstatus"], score="o_totalprice", positive="y")


@query(
    "e3_reverse_running_minimum",
    """WITH t AS (SELECT c_custkey, (c_custkey * 31 % 997 + 1) / 1000.0::DOUBLE AS p FROM customer),
    k AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS r, count(*) OVER () AS m FROM t)
    SELECT c_custkey, round(least(1, min(p * m / r) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS p_adjusted FROM k""",
)
def e3(spark, sf):
    tests = table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") * 31 % 997 + 1) / F.lit(1000.0)).alias("p"))
    return N.adjust_fdr(tests).select("c_custkey", r6(F.col("p_adjusted"), "p_adjusted"))


@query(
    "e4_adjacent_sign_change",
    "WITH " + MED + """, g AS (SELECT round(-0.9 + 0.05 * i, 2)::DOUBLE AS rho FROM (SELECT unnest(range(0, 37)) AS i)),
    cv AS (SELECT locus, rho, beta * (delta - rho * s2 / (s1 * sqrt(1 - rho * rho))) AS y FROM s, g),
    st AS (SELECT *, lead(y) OVER (PARTITION BY locus ORDER BY rho) AS y1 FROM cv)
    SELECT locus, count(*) FILTER (sign(y1) <> sign(y)) AS n_changes FROM st GROUP BY locus""",
)
def e4(spark, sf):
    curve = M.sensitivity_curve(M.mediation(mediation_rows(spark, sf), keys=["locus"], n_rep=10), keys=["locus"])
    following = F.lead("acme_at_rho").over(Window.partitionBy("locus").orderBy("rho"))
    steps = curve.withColumn("_next", following)
    return steps.groupBy("locus").agg(
        F.count_if(F.signum("_next") != F.signum("acme_at_rho")).alias("n_changes")
    )


@query(
    "e5_first_of_identical_points",
    "WITH " + SWEEP + "," + DUPLICATED + " SELECT model, min_positives FROM (SELECT DISTINCT model, min_positives FROM dup) WHERE min_positives <> 20",
)
def e5(spark, sf):
    marks = R.fingerprint_points(with_duplicate_point(sweep(spark, sf)))
    return marks.where(F.col("duplicate_of").isNull()).select("model", "min_positives")


@query(
    "e6_boundary_rows",
    """SELECT conv_id, count(*) AS n_inner FROM (SELECT conv_id, turn, min(turn) OVER w AS a, max(turn) OVER w AS b FROM conversations WINDOW w AS (PARTITION BY conv_id))
    WHERE turn <> a AND turn <> b GROUP BY 1""",
)
def e6(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn")
    edges = turns.groupBy("conv_id").agg(F.min("turn").alias("a"), F.max("turn").alias("b"))
    inner = turns.join(edges, "conv_id").where((F.col("turn") != F.col("a")) & (F.col("turn") != F.col("b")))
    return inner.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_inner"))


@query(
    "e1_feature_ranks",
    "WITH " + DENSE + "z AS (SELECT 1) SELECT unit_id, feature_idx, rank() OVER (PARTITION BY feature_idx ORDER BY act) + (count(*) OVER (PARTITION BY feature_idx, act) - 1) / 2.0::DOUBLE AS rank FROM feats",
)
def e1_features(spark, sf):
    return O.average_ranks(dense_features(spark, sf), by=["feature_idx"], score="act").select("unit_id", "feature_idx", "rank")
