"""Registry, annotation and verdict queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestor.functions import prompts as PR
from attestor.functions import stats as ST
from attestor.operators import agreement as G
from attestor.operators import inspect as I
from attestor.operators import registry as R
from attestor.session import fresh_path, tasks_for
from attestor.sources import results as RES
from attestor.workload.catalog import query, r6, table
from attestor.workload.sweep_tables import REGISTRY, SWEEP, claimed_registry, registry, sweep

JUDGE = """
j AS (SELECT e.user_id AS feature_idx, ['confirmed', 'plausible', 'spurious', 'unverifiable'][event_id % 4 + 1] AS status,
   ['low', 'medium', 'high'][floor(value)::BIGINT % 3 + 1] AS confidence, event_id, event_type FROM events e),
ra AS (SELECT event_id AS feature_idx, status AS status_a, confidence AS confidence_a,
   CASE WHEN event_id % 7 < 4 THEN status ELSE ['spurious', 'plausible', 'confirmed', 'unverifiable'][floor(event_id / 3)::BIGINT % 4 + 1] END AS status_b,
   ['low', 'medium', 'high'][event_id % 3 + 1] AS confidence_b, event_type FROM j),
co AS (SELECT *, CASE confidence_a WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS ca, CASE confidence_b WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS cb FROM ra),
res AS (SELECT *, CASE WHEN status_a = status_b OR ca > cb THEN status_a WHEN cb > ca THEN status_b END AS resolved_label FROM co)
"""


def judgments(spark, sf):
    status = F.element_at(F.array(*[F.lit(s) for s in ST.STATUSES]), (F.col("event_id") % 4 + 1).cast("int"))
    confidence = F.element_at(F.array(*[F.lit(c) for c in ("low", "medium", "high")]), (F.floor("value") % 3 + 1).cast("int"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("feature_idx"), status.alias("status"), confidence.alias("confidence"), "event_id", "event_type"
    )


def rated(spark, sf):
    other = F.array(*[F.lit(s) for s in ("spurious", "plausible", "confirmed", "unverifiable")])
    second = F.element_at(other, (F.floor(F.col("event_id") / 3) % 4 + 1).cast("int"))
    levels = F.array(*[F.lit(c) for c in ("low", "medium", "high")])
    return judgments(spark, sf).select(
        F.col("event_id").alias("feature_idx"),
        F.col("status").alias("status_a"),
        F.col("confidence").alias("confidence_a"),
        F.when(F.col("event_id") % 7 < 4, F.col("status")).otherwise(second).alias("status_b"),
        F.element_at(levels, (F.col("event_id") % 3 + 1).cast("int")).alias("confidence_b"),
        "event_type",
    )


@query("d33_consensus", "WITH " + JUDGE + " SELECT feature_idx, resolved_label FROM res")
def d33(spark, sf):
    return G.consensus(rated(spark, sf)).select("feature_idx", "resolved_label")


@query("b14_ordinal_codes", "WITH " + JUDGE + """ SELECT status, confidence, CASE status WHEN 'spurious' THEN 0 WHEN 'plausible' THEN 1 WHEN 'confirmed' THEN 2 END AS status_code,
   CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 END AS confidence_code, count(*) AS n FROM j GROUP BY ALL""")
def b14(spark, sf):
    return judgments(spark, sf).groupBy("status", "confidence").agg(F.count(F.lit(1)).alias("n")).select(
        "status", "confidence", ST.status_ordinal(F.col("status")).alias("status_code"),
        ST.confidence_rank(F.col("confidence")).alias("confidence_code"), "n",
    )


def agreement_sql(source: str, key: str) -> str:
    return f"""
    o AS (SELECT *, CASE status_a WHEN 'spurious' THEN 0 WHEN 'plausible' THEN 1 WHEN 'confirmed' THEN 2 END AS oa,
            CASE status_b WHEN 'spurious' THEN 0 WHEN 'plausible' THEN 1 WHEN 'confirmed' THEN 2 END AS ob FROM {source}),
    tot AS (SELECT {key}, count(*) AS n_items, avg((status_a = status_b)::INT) AS pa, count(*) FILTER (oa IS NULL OR ob IS NULL) AS n_unv,
            avg(CASE WHEN oa IS NOT NULL AND ob IS NOT NULL THEN (oa = ob)::INT END) AS pos, count(resolved_label) AS n_resolved,
            sum(abs(oa - ob)) AS obs FROM o GROUP BY ALL),
    ons AS (SELECT {key}, oa, ob FROM o WHERE oa IS NOT NULL AND ob IS NOT NULL),
    ma AS (SELECT {key}, oa, count(*) AS na FROM ons GROUP BY ALL), mb AS (SELECT {key}, ob, count(*) AS nb FROM ons GROUP BY ALL),
    ex AS (SELECT {key}, sum(abs(oa - ob) * na * nb::DOUBLE) AS e FROM ma JOIN mb USING ({key}) GROUP BY ALL),
    nn AS (SELECT {key}, count(*) AS n FROM ons GROUP BY ALL),
    agr AS (SELECT {key}, n_items, round(pa, 6) AS percent_agreement, n_unv AS n_unverifiable_by_either, round(pos, 6) AS percent_agreement_on_scale,
       round(1 - obs / (e / n), 6) + 0.0 AS weighted_kappa, n_resolved, n_items - n_resolved AS n_excluded FROM tot JOIN ex USING ({key}) JOIN nn USING ({key}))"""


def _agreement(df, key):
    six = ("percent_agreement", "percent_agreement_on_scale", "weighted_kappa")
    return df.select(key, "n_items", "n_unverifiable_by_either", "n_resolved", "n_excluded", *[r6(F.col(c), c) for c in six])


@query("d34_agreement", "WITH " + JUDGE + "," + agreement_sql("res", "event_type") + " SELECT * FROM agr")
def d34(spark, sf):
    return _agreement(G.agreement(rated(spark, sf), keys=["event_type"]), "event_type")


@query(
    "d35_judge_consistency",
    "WITH " + JUDGE + """, c AS (SELECT feature_idx, status, count(*) AS n FROM j GROUP BY ALL)
    SELECT feature_idx, status AS modal_status, round(n / sum(n) OVER (PARTITION BY feature_idx), 6) AS consistency,
      (sum(n) OVER (PARTITION BY feature_idx))::BIGINT AS n_repeats FROM c QUALIFY row_number() OVER (PARTITION BY feature_idx ORDER BY n DESC, status) = 1""",
)
def d35(spark, sf):
    return G.judge_consistency(judgments(spark, sf)).select("feature_idx", "modal_status", r6(F.col("consistency"), "consistency"), "n_repeats")


@query(
    "d35_calibration",
    "WITH " + JUDGE + "," + REGISTRY + """, c AS (SELECT feature_idx, status, count(*) AS n FROM j GROUP BY ALL),
    m AS (SELECT feature_idx, status, n / sum(n) OVER (PARTITION BY feature_idx) AS cons FROM c QUALIFY row_number() OVER (PARTITION BY feature_idx ORDER BY n DESC, status) = 1)
    SELECT count(r.status) AS n_scored, count(*) FILTER (m.status = r.status) AS n_correct, round(avg((m.status = r.status)::INT), 6) + 0.0 AS accuracy,
      round(avg(cons), 6) AS mean_consistency FROM m LEFT JOIN registry r USING (feature_idx)""",
)
def d35_calibration(spark, sf):
    out = G.calibration(G.judge_consistency(judgments(spark, sf)), registry(spark, sf))
    return out.select("n_scored", "n_correct", r6(F.col("accuracy"), "accuracy"), r6(F.col("mean_consistency"), "mean_consistency"))


def _sheets(spark, sf):
    rows = rated(spark, sf)
    a = rows.select("feature_idx", F.col("status_a").alias("status"), F.col("confidence_a").alias("confidence"))
    b = rows.select("feature_idx", F.col("status_b").alias("status"), F.col("confidence_b").alias("confidence"))
    names = F.array(*[F.lit(s) for s in ST.STATUSES])
    key = rows.select(
        "feature_idx",
        F.element_at(names, (F.floor(F.col("feature_idx") / 2) % 4 + 1).cast("int")).alias("status"),
        (F.col("feature_idx") % 500 == 0).alias("is_trap"),
    )
    return a, b, key


KEYED = """, keyed AS (SELECT *, ['confirmed', 'plausible', 'spurious', 'unverifiable'][floor(feature_idx / 2)::BIGINT % 4 + 1] AS prior FROM res),
  stacked AS (SELECT 'a_vs_b' AS comparison, status_a, status_b, resolved_label FROM keyed
    UNION ALL SELECT 'prior_vs_consensus', prior, resolved_label, CASE WHEN prior = resolved_label THEN prior END FROM keyed WHERE resolved_label IS NOT NULL
    UNION ALL SELECT 'verifier_vs_consensus', status_a, resolved_label, CASE WHEN status_a = resolved_label THEN status_a END FROM keyed WHERE resolved_label IS NOT NULL)"""


@query("d36_agreement_report", "WITH " + JUDGE + KEYED + "," + agreement_sql("stacked", "comparison") + " SELECT * FROM agr")
def d36(spark, sf):
    a, b, key = _sheets(spark, sf)
    verifier = a.select("feature_idx", F.col("status").alias("modal_status"))
    return _agreement(G.agreement_report(a, b, key, verifier), "comparison")


@query(
    "c17_annotator_traps",
    "WITH " + JUDGE + KEYED + " SELECT feature_idx, prior AS true_status, status_a = prior AS a_correct, status_b = prior AS b_correct FROM keyed WHERE feature_idx % 500 = 0",
)
def c17(spark, sf):
    a, b, key = _sheets(spark, sf)
    return G.trap_results(G.pair_annotators(a, b, key))


@query(
    "a27_completed_sheet",
    """SELECT event_id AS feature_idx, CASE WHEN lower(trim(event_type)) NOT IN ('view', 'click', 'purchase') THEN 'unknown status'
      WHEN value < 5 THEN 'empty justification' END AS problem FROM events""",
)
def a27(spark, sf):
    codes = {"view": "confirmed", "click": "plausible", "purchase": "spurious"}
    status = F.lit("other")
    for name, code in codes.items():
        status = F.when(F.col("event_type") == name, F.lit(f" {code.upper()} ")).otherwise(status)
    sheet = table(spark, sf, "events").select(
        F.col("event_id").alias("feature_idx"),
        status.alias("status"),
        F.lit(" High ").alias("confidence"),
        F.when(F.col("value") < 5, F.lit("  ")).otherwise(F.lit("seen in the record")).alias("justification"),
    )
    valid, bad = G.split_completed(sheet)
    return valid.select("feature_idx", F.lit(None).cast("string").alias("problem")).unionByName(bad.select("feature_idx", "problem"))


@query("a26_blind_sheet", "WITH " + REGISTRY + """, c AS (SELECT l_suppkey AS feature_idx, string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag) AS claimed FROM lineitem GROUP BY 1)
   SELECT feature_idx, claimed, claimed_concept, '' AS evidence, '' AS status, '' AS confidence, '' AS justification FROM registry JOIN c USING (feature_idx)""")
def a26(spark, sf):
    claimed = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("feature_idx")).agg(
        F.array_sort(F.collect_set("l_returnflag")).alias("claimed")
    )
    rows = registry(spark, sf).drop("status").join(claimed, "feature_idx").withColumn("evidence", F.array().cast("array<string>"))
    return R.blind_sheet(rows)


@query("a26_sheet_round_trip", "WITH " + REGISTRY + " SELECT feature_idx::INT AS feature_idx, status, claimed_concept AS justification FROM registry")
def a26_round_trip(spark, sf):
    path = fresh_path(spark, "sheet")
    rows = registry(spark, sf)
    RES.write_sheet(rows.select("feature_idx", "status", F.lit("high").alias("confidence"), F.col("claimed_concept").alias("justification")), path)
    return RES.read_sheet(spark, path).select("feature_idx", "status", "justification")


@query(
    "a24_partitioned_report",
    "WITH " + SWEEP + " SELECT model, min_positives, count(*) AS n_rows, round(sum(single_feature_auroc), 4) AS total FROM sweep GROUP BY ALL",
)
def a24(spark, sf):
    path = fresh_path(spark, "report")
    rows = sweep(spark, sf)
    RES.write_report(rows, path)
    RES.write_report(rows.where(F.col("model") == "A"), path)  # rerun of one model replaces only its rows
    return RES.read_report(spark, path).groupBy("model", F.col("min_positives").cast("int").alias("min_positives")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("single_feature_auroc"), 4).alias("total")
    )


@query(
    "a22_registry_round_trip",
    "WITH " + REGISTRY + " SELECT feature_idx::INT AS feature_idx, status, claimed_concept FROM registry",
)
def a22(spark, sf):
    path = fresh_path(spark, "registry")
    RES.write_json(registry(spark, sf), path)
    return RES.read_registry(spark, path).select("feature_idx", "status", "claimed_concept")


@query(
    "a23_registry_append",
    "WITH " + REGISTRY + """ SELECT feature_idx, status FROM registry WHERE status <> 'pending' UNION ALL
    SELECT DISTINCT l_suppkey, 'new' FROM lineitem WHERE l_suppkey NOT IN (SELECT feature_idx FROM registry WHERE status <> 'pending')""",
)
def a23(spark, sf):
    known = registry(spark, sf).where(F.col("status") != "pending").select("feature_idx", "status")
    incoming = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("feature_idx"), F.lit("new").alias("status")).distinct()
    return R.append_new(known, incoming)


@query(
    "a25_verdict_evidence",
    "WITH " + JUDGE + """, m AS (SELECT event_id // 20 AS feature_idx, round(avg((status = 'confirmed')::INT), 4) AS match_rate, string_agg(event_id, ',' ORDER BY event_id) AS windows FROM j GROUP BY 1)
    SELECT feature_idx, match_rate, windows FROM m""",
)
def a25(spark, sf):
    path = fresh_path(spark, "evidence")
    # twenty evidence rows per feature, as in a top-k list
    verdicts = judgments(spark, sf).groupBy(F.floor(F.col("event_id") / 20).alias("feature_idx")).agg(
        F.avg((F.col("status") == "confirmed").cast("int")).alias("match_rate"),
        F.array_sort(F.collect_list("event_id")).alias("evidence"),
    )
    RES.write_evidence(verdicts, path)
    back = spark.read.schema("feature_idx BIGINT, match_rate DOUBLE, evidence ARRAY<BIGINT>").json(path)
    return back.select("feature_idx", "match_rate", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ",").alias("windows"))


@query(
    "c21_field_differences",
    """WITH a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 100 <> 0),
    b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 37 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 101 <> 0),
    ta AS (SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS v FROM a UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM a),
    tb AS (SELECT o_orderkey, 'o_orderstatus' AS field, o_orderstatus AS v FROM b UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM b)
    SELECT o_orderkey, field, ta.v AS baseline, tb.v AS rerun, CASE WHEN tb.v IS NULL THEN 'missing from rerun' WHEN ta.v IS NULL THEN 'missing from baseline' ELSE 'differs' END AS problem
    FROM ta FULL JOIN tb USING (o_orderkey, field) WHERE ta.v IS DISTINCT FROM tb.v""",
)
def c21(spark, sf):
    orders = table(spark, sf, "orders")
    fields = ["o_orderstatus", "o_orderpriority"]
    a = orders.where(F.col("o_orderkey") % 100 != 0)
    b = orders.where(F.col("o_orderkey") % 101 != 0).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 37 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    )
    return R.field_differences(a, b, keys=["o_orderkey"], fields=fields)


FRESH_SQL_POINTS = [10, 100, 150, 20, 200, 300, 50]


def fresh_sql(n: int, floor: float) -> str:
    steps, taken = [], "SELECT feature_idx FROM registry WHERE status <> 'pending'"
    for p in FRESH_SQL_POINTS:
        steps.append(f"""f{p} AS (SELECT {p} AS min_positives, best_feature_idx AS feature_idx, concept_id, single_feature_auroc FROM (
          SELECT best_feature_idx, concept_id, single_feature_auroc FROM sweep WHERE min_positives = {p} AND single_feature_auroc >= {floor}
            AND best_feature_idx NOT IN ({taken}) QUALIFY row_number() OVER (PARTITION BY best_feature_idx ORDER BY single_feature_auroc DESC, concept_id DESC) = 1)
          ORDER BY single_feature_auroc DESC, best_feature_idx LIMIT {n})""")
        taken += f" UNION ALL SELECT feature_idx FROM f{p}"
    union = " UNION ALL ".join(f"SELECT * FROM f{p}" for p in FRESH_SQL_POINTS)
    return "WITH " + SWEEP + "," + REGISTRY + "," + ",".join(steps) + f" SELECT min_positives, feature_idx, concept_id, round(single_feature_auroc, 6) AS single_feature_auroc FROM ({union})"


@query("f4_fresh_candidates", fresh_sql(2, 0.6))
def f4(spark, sf):
    known = registry(spark, sf).where(F.col("status") != "pending")
    out = I.fresh_candidates(sweep(spark, sf), known, per_point=2, min_auroc=0.6)
    return out.select("min_positives", "feature_idx", "concept_id", r6(F.col("single_feature_auroc"), "single_feature_auroc"))


@query(
    "c18_unregistered_candidates",
    "WITH " + REGISTRY + " SELECT DISTINCT l_suppkey AS feature_idx FROM lineitem WHERE l_suppkey NOT IN (SELECT feature_idx FROM registry WHERE status IN ('confirmed', 'spurious'))",
)
def c18(spark, sf):
    known = registry(spark, sf).where(F.col("status").isin("confirmed", "spurious"))
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("feature_idx")).distinct().join(known, "feature_idx", "left_anti")


PACKETS = """
st AS (SELECT feature_idx, status, row_number() OVER (PARTITION BY status ORDER BY md5('7:' || feature_idx), feature_idx) AS o FROM registry),
sh AS (SELECT feature_idx, status FROM st WHERE status = 'unverifiable' OR (status IN ('confirmed', 'plausible', 'spurious') AND o <= 4)),
tr AS (SELECT min(feature_idx) AS feature_idx FROM sh WHERE status IN ('confirmed', 'spurious') GROUP BY status),
rs AS (SELECT feature_idx, status, row_number() OVER (ORDER BY md5('7:rest:' || feature_idx), feature_idx) AS o FROM registry WHERE feature_idx NOT IN (SELECT feature_idx FROM sh)),
pk AS (SELECT feature_idx, status, 'shared' AS packet, feature_idx IN (SELECT feature_idx FROM tr) AS is_trap FROM sh
  UNION ALL SELECT feature_idx, status, CASE WHEN o <= 5 THEN 'expansion_a' ELSE 'expansion_b' END, false FROM rs WHERE o <= 10)"""


def _packets(spark, sf):
    return R.annotator_packets(registry(spark, sf), shared_per_status=4, expansion_per_annotator=5, seed="7")


@query("f7_annotator_packets", "WITH " + REGISTRY + "," + PACKETS + " SELECT * FROM pk")
def f7(spark, sf):
    return _packets(spark, sf)


@query(
    "f8_merged_packets",
    "WITH " + REGISTRY + "," + PACKETS + " SELECT feature_idx, status, is_trap, row_number() OVER (ORDER BY md5('7:merge:' || feature_idx), feature_idx) AS position FROM pk",
)
def f8(spark, sf):
    packets = _packets(spark, sf)
    out = R.merge_packets(packets, packets.select("feature_idx", "status", "is_trap"), seed="7")
    return out.select("feature_idx", "status", "is_trap", "position")


@query("f11_verification_targets", "WITH " + REGISTRY + " SELECT feature_idx FROM registry WHERE status <> 'pending' AND feature_idx IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
def f11(spark, sf):
    entries = registry(spark, sf).withColumn("status", F.when(F.col("status") != "pending", F.col("status")))
    wanted = table(spark, sf, "lineitem").where(F.col("l_quantity") > 49).select(F.col("l_suppkey").alias("feature_idx"))
    return R.verification_targets(entries, mode="calibrate", feature_ids=wanted).select("feature_idx")


@query(
    "b26_feature_annotations",
    """SELECT l_orderkey AS feature_idx, string_agg(l_partkey || ' ' || p_name || ' (auroc=' || printf('%.3f', 0.5::DOUBLE + l_quantity / 100) || ')', '; '
      ORDER BY l_quantity DESC, l_partkey || ' ' || p_name || ' (auroc=' || printf('%.3f', 0.5::DOUBLE + l_quantity / 100) || ')') AS annotations
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""",
)
def b26(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("best_feature_idx"),
        F.col("l_partkey").alias("concept_id"),
        (F.lit(0.5) + F.col("l_quantity") / 100).alias("single_feature_auroc"),
    )
    named = rows.join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("concept_name")), "concept_id"
    )
    out = I.annotations_by_feature(named)
    return out.select("feature_idx", F.array_join("annotations", "; ").alias("annotations"))


@query(
    "b19_judge_prompts",
    """WITH l AS (SELECT conv_id AS feature_idx, turn, '[record ' || conv_id || '/' || turn || '] ' || text || ' | said by = ' ||
        CASE WHEN turn % 3 = 0 THEN 'NONE' ELSE role || ' (turn ' || turn || ')' END AS line FROM conversations),
    b AS (SELECT feature_idx, string_agg(line, chr(10) ORDER BY turn, line) AS block FROM l GROUP BY 1)
    SELECT feature_idx, md5('R' || chr(10) || 'CLAIM:' || chr(10) || 'conversation ' || feature_idx || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || block || chr(10)) AS digest FROM b""",
)
def b19(spark, sf):
    rows = table(spark, sf, "conversations")
    none = F.array().cast("array<string>")
    ids = F.when(F.col("turn") % 3 == 0, none).otherwise(F.array("role"))
    names = F.when(F.col("turn") % 3 == 0, none).otherwise(F.array(F.concat(F.lit("turn "), F.col("turn"))))
    lines = rows.select(
        F.col("conv_id").alias("feature_idx"),
        F.col("turn").alias("rank"),
        PR.record_line(F.concat("conv_id", F.lit("/"), "turn"), F.col("text"), ids, names, caption="said by").alias("line"),
    )
    claims = rows.select(F.col("conv_id").alias("feature_idx")).distinct()
    out = PR.assemble_prompts(claims, lines, claim=F.concat(F.lit("conversation "), F.col("feature_idx")), rules="R", top_k=None)  # every turn
    return out.select("feature_idx", F.md5("prompt").alias("digest"))


@query(
    "b19_text_prompts",
    """WITH l AS (SELECT doc_id // 10 AS feature_idx, doc_id, '[text ' || doc_id || '] labels on record = ' || CASE WHEN lang = 'fr' THEN 'NONE' ELSE lang || ', ' || source END
        || chr(10) || '| ' || text AS line FROM documents),
    b AS (SELECT feature_idx, string_agg(line, chr(10) ORDER BY doc_id) AS block FROM l GROUP BY 1)
    SELECT feature_idx, md5('R' || chr(10) || 'CLAIM:' || chr(10) || 'feature ' || feature_idx || chr(10) || chr(10) || 'EVIDENCE:' || chr(10) || block || chr(10)) AS digest FROM b""",
)
def b19_text(spark, sf):
    docs = table(spark, sf, "documents").withColumn("feature_idx", F.floor(F.col("doc_id") / 10))
    listed = F.when(F.col("lang") == "fr", F.array().cast("array<string>")).otherwise(F.array("lang", "source"))
    lines = docs.select(
        "feature_idx", F.col("doc_id").alias("rank"), PR.text_line(F.col("doc_id").cast("string"), listed, F.col("text")).alias("line")
    )
    claims = docs.select("feature_idx").distinct()
    out = PR.assemble_prompts(claims, lines, claim=F.concat(F.lit("feature "), F.col("feature_idx")), rules="R", top_k=None)  # every text
    return out.select("feature_idx", F.md5("prompt").alias("digest"))


@query(
    "b20_verdict_parsing",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'confirmed' WHEN 'click' THEN 'plausible' END AS status,
     CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN NULL WHEN 'purchase' THEN 'not a JSON object' WHEN 'error' THEN 'missing keys: confidence'
       ELSE 'unknown status' END AS problem FROM events""",
)
def b20(spark, sf):
    good = '{"status": "%s", "confidence": "high", "reasoning": "k"}'
    kind = F.col("event_type")
    response = (
        F.when(kind == "view", F.lit("```json\n" + good % "confirmed" + "\n```"))
        .when(kind == "click", F.lit("  " + good % "plausible" + "\n"))
        .when(kind == "purchase", F.concat(F.lit("I think "), F.col("props")))
        .when(kind == "error", F.lit('{"status": "spurious", "reasoning": "k"}'))
        .otherwise(F.lit(good % "maybe"))
    )
    rows = table(spark, sf, "events").select("event_id", response.alias("response"))
    return PR.parse_verdicts(rows).select("event_id", "status", "problem")


def strongest_lines(lines):
    """``feature_idx, unit_id, act``: nearly as many groups as lines, so they are dealt out before they are grouped."""
    rows = lines.select(F.col("l_suppkey").alias("feature_idx"), F.col("l_orderkey").alias("unit_id"), "l_quantity")
    rows = rows.repartition(tasks_for(rows), "feature_idx", "unit_id")
    return rows.groupBy("feature_idx", "unit_id").agg(F.max("l_quantity").alias("act"))


@query(
    "f10_candidate_evidence",
    """WITH claims AS (SELECT l_suppkey AS feature_idx, count(DISTINCT l_returnflag) AS n_claims FROM lineitem GROUP BY 1),
    fx AS (SELECT l_suppkey AS feature_idx, l_orderkey AS unit_id, max(l_quantity) AS act FROM lineitem GROUP BY ALL)
    SELECT feature_idx, unit_id, act, (row_number() OVER w)::INT AS rank, n_claims FROM fx JOIN claims USING (feature_idx)
    WINDOW w AS (PARTITION BY feature_idx ORDER BY act DESC, unit_id) QUALIFY row_number() OVER w <= 5""",
)
def f10(spark, sf):
    lines = table(spark, sf, "lineitem")
    features = strongest_lines(lines)
    units = table(spark, sf, "orders").select(F.col("o_orderkey").alias("unit_id"))
    report = lines.select(
        F.col("l_suppkey").alias("best_feature_idx"), F.col("l_returnflag").alias("concept_id")
    )
    out = I.candidate_evidence(features, units, report, k=5)
    return out.select("feature_idx", "unit_id", "act", "rank", F.size("claimed").cast("bigint").alias("n_claims"))


@query(
    "g5_concatenated_models",
    "SELECT l_returnflag AS model, count(*) AS n FROM lineitem GROUP BY 1",
)
def g5(spark, sf):
    rows = sweep(spark, sf)
    every = [rows.where(F.col("model") == m) for m in ("A", "N", "R")]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("d5_claims_per_feature", "SELECT l_suppkey AS feature_idx, count(DISTINCT l_partkey) AS n_claims FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def d5_claims(spark, sf):
    return claimed_registry(spark, sf).groupBy("feature_idx").agg(F.count(F.lit(1)).alias("n_claims"))
