"""Hypotheses, evaluation, retention, access and promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.codes import group_and_price
from claimweave.operators.governance import AccessPolicy, access_violations, promotable, retention_violations
from claimweave.operators.investigate import (
    check_critiques,
    checked_hypotheses,
    investigation_runs,
    promote,
    synthesize,
)
from claimweave.operators.metrics import evaluate, prediction_key
from claimweave.operators.scale import split_checked
from claimweave.plans.bindings import EVENTS_SQL, choose, choose_sql, events, table, text_id
from claimweave.plans.registry import query
from claimweave.plans.rules import SEGMENT_CODE, group_sql, price_sql

# Fixed values of the binding: category and proposed code of each event type.
CATEGORY = {
    "purchase": "missed_diagnosis",
    "view": "missed_charge",
    "signup": "drg_discrepancy",
    "click": "documentation_gap",
    "error": "payment_variance",
}


def hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hypothesis per event about the case of its user."""
    k, whole, kind = F.col("k"), F.col("whole"), F.col("event_type")
    none = F.array().cast("array<string>")
    codes = (
        F.when((kind == "purchase") & (k < 50), F.array(F.lit("L89.154")))
        .when(kind == "purchase", F.array(F.lit("L89.213"), F.lit("L89.213")))
        .when((kind == "view") & (k < 70), F.array(F.lit("ROOM-ICU")))
        .otherwise(none)
    )
    return events(spark, sf_dir).select(
        F.col("user_id").alias("packet_id"),
        F.when(k == 77, F.lit(-1)).otherwise(F.col("user_id")).alias("encounter_id"),
        text_id("H-", "event_id").alias("hypothesis_id"),
        F.col("event_id").alias("input_order"),
        choose(kind, CATEGORY).alias("category"),
        F.concat(F.lit("Pattern of "), kind).alias("hypothesis"),
        F.when(k == 33, none).otherwise(F.array(text_id("EV-", whole))).alias("evidence_ids"),
        F.when(k < 5, F.array(text_id("EV-", k))).otherwise(none).alias("contradicting_evidence_ids"),
        F.when(k < 20, F.array(text_id("AS-", k))).otherwise(none).alias("assertion_ids"),
        codes.alias("candidate_codes"),
        F.when(k >= 90, F.array(F.lit("stage"), F.lit("site"))).otherwise(none).alias("missing_information"),
        (k / F.lit(100.0)).alias("confidence_evidence"),
        F.lit(0.8).alias("confidence_semantic"),
        (F.lit(1.0) - k / F.lit(200.0)).alias("confidence_financial"),
        (whole - F.lit(1)).alias("materiality_cents"),
    )


def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("packet_id"),
        F.col("c_custkey").alias("packet_encounter_id"),
        F.when(F.col("c_nationkey") < 20, "DEMO-292").alias("drg"),
        F.array(choose(F.col("c_mktsegment"), SEGMENT_CODE, "Z00")).alias("diagnoses"),
        F.array().cast("array<string>").alias("procedures"),
        F.array().cast("array<string>").alias("charges"),
    )


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type") != "view").select(
        F.col("user_id").alias("packet_id"), text_id("EV-", "whole").alias("evidence_id")
    )


def _assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter(F.col("event_type") == "error").select(
        F.col("user_id").alias("packet_id"), text_id("AS-", F.col("whole")).alias("assertion_id")
    )


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked_hypotheses(
        hypotheses(spark, sf_dir), _packets(spark, sf_dir), _evidence(spark, sf_dir), _assertions(spark, sf_dir)
    )


_HYPOTHESES_SQL = f"""{EVENTS_SQL},
hyp AS (SELECT *, {choose_sql("event_type", CATEGORY)} AS category, CASE WHEN k = 77 THEN -1 ELSE user_id END AS encounter_id,
    CASE WHEN k = 33 THEN NULL ELSE whole END AS cited, CASE WHEN k < 5 THEN k END AS counter,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN k < 50 THEN ['L89.154'] ELSE ['L89.213', 'L89.213'] END
      WHEN event_type = 'view' AND k < 70 THEN ['ROOM-ICU'] ELSE CAST([] AS VARCHAR[]) END AS codes,
    k / 100.0::DOUBLE AS ev_conf, 1.0::DOUBLE - k / 200.0::DOUBLE AS fin_conf FROM ev),
packets AS (SELECT c_custkey AS packet_id, CASE WHEN c_nationkey < 20 THEN 'DEMO-292' END AS drg,
    [{choose_sql("c_mktsegment", SEGMENT_CODE, "'Z00'")}] AS diagnoses FROM customer),
evidence AS (SELECT DISTINCT user_id, whole AS e FROM ev WHERE event_type <> 'view'),
known_assertions AS (SELECT DISTINCT user_id, whole AS a FROM ev WHERE event_type = 'error'),
checked AS (SELECT h.*, p.drg, p.diagnoses, concat_ws('|',
    CASE WHEN cited IS NULL AND category <> 'payment_variance' THEN 'no_evidence' END,
    CASE WHEN cited = counter THEN 'overlap' END,
    CASE WHEN whole < 1 THEN 'negative_materiality' END,
    CASE WHEN p.packet_id IS NULL OR encounter_id <> h.user_id THEN 'encounter_mismatch' END,
    CASE WHEN (cited IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.user_id = h.user_id AND e.e = cited))
      OR (counter IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.user_id = h.user_id AND e.e = counter)) THEN 'unknown_evidence' END,
    CASE WHEN k < 20 AND NOT EXISTS (SELECT 1 FROM known_assertions a WHERE a.user_id = h.user_id AND a.a = k) THEN 'unknown_assertion' END,
    CASE WHEN category = 'drg_discrepancy' AND p.drg IS NULL THEN 'drg_discrepancy_without_drg' END) AS violations
  FROM hyp h LEFT JOIN packets p ON h.user_id = p.packet_id)"""


@query(
    "hypothesis_checks",
    f"WITH {_HYPOTHESES_SQL} SELECT 'H-' || event_id AS hypothesis_id, violations FROM checked WHERE violations <> ''",
)
def hypothesis_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = split_checked(_checked(spark, sf_dir))
    return rejects.select("hypothesis_id", F.concat_ws("|", "violations").alias("violations"))


@query(
    "rejected_hypotheses",
    f"""WITH {_HYPOTHESES_SQL} SELECT user_id AS packet_id, count(*) FILTER (violations = '') AS accepted_count,
      count(*) FILTER (violations <> '') AS rejected_count FROM checked GROUP BY user_id""",
)
def rejected_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return investigation_runs(_checked(spark, sf_dir))


@query(
    "hypothesis_promotion",
    f"""WITH {_HYPOTHESES_SQL}, ok AS (SELECT *, CASE WHEN event_type = 'purchase' AND NOT list_contains(diagnoses, codes[1])
        THEN list_append(diagnoses, codes[1]) ELSE diagnoses END AS after, len(codes) > 0 AS has_change FROM checked WHERE violations = '')
    SELECT 'H-' || event_id AS hypothesis_id, 'AGENT-' || upper(category) AS rule_id,
      CASE category WHEN 'missed_diagnosis' THEN 'coding_review' WHEN 'missed_charge' THEN 'charge_review'
        WHEN 'drg_discrepancy' THEN 'coding_review' WHEN 'documentation_gap' THEN 'cdi_query' ELSE 'charge_review' END AS disposition,
      least(ev_conf, 0.8::DOUBLE, fin_conf) AS confidence,
      'Pattern of ' || event_type || CASE WHEN k >= 90 THEN ' Missing information: stage; site' ELSE '' END AS rationale,
      {group_sql("diagnoses")} AS current_drg, {group_sql("after")} AS simulated_drg,
      CASE WHEN has_change THEN {price_sql("after")} - {price_sql("diagnoses")} END AS estimated_impact_cents,
      CASE WHEN has_change THEN 'estimated' ELSE 'not_applicable' END AS impact_status FROM ok""",
)
def hypothesis_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted hypotheses as findings, simulated against the claim of their packet."""
    ok, _ = split_checked(_checked(spark, sf_dir))
    findings = promote(ok, _packets(spark, sf_dir), lambda claim: group_and_price(claim["diagnoses"]))
    return findings.select(
        "hypothesis_id",
        "rule_id",
        "disposition",
        "confidence",
        "rationale",
        "current_drg",
        "simulated_drg",
        "estimated_impact_cents",
        "impact_status",
    )


def critiques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but errors criticises its own hypothesis; some name others."""
    k = F.col("k")
    return events(spark, sf_dir).filter(F.col("event_type") != "error").select(
        F.col("user_id").alias("packet_id"),
        "event_id",
        F.when(k == 50, F.lit("H-none")).when(k == 51, text_id("H-", "user_id")).otherwise(text_id("H-", "event_id")).alias("hypothesis_id"),
        (k >= 30).alias("supported"),
        F.when(k < 10, F.array(text_id("EV-", "k"))).otherwise(F.array().cast("array<string>")).alias("counterevidence_ids"),
    )


@query(
    "opportunity_synthesis",
    f"""WITH {_HYPOTHESES_SQL}, named AS (SELECT user_id AS packet, CASE WHEN k = 51 THEN user_id ELSE event_id END AS named_id
      FROM ev WHERE event_type <> 'error' AND k >= 30 AND k <> 50),
    supported AS (SELECT DISTINCT ev.event_id FROM named JOIN ev ON ev.event_id = named_id AND ev.user_id = packet)
    SELECT 'H-' || event_id AS hypothesis_id, encounter_id, category FROM (
      SELECT *, row_number() OVER (PARTITION BY encounter_id, category, array_to_string(codes, ',')
        ORDER BY fin_conf DESC, ev_conf DESC, event_id) AS rn FROM hyp WHERE event_id IN (SELECT event_id FROM supported)) WHERE rn = 1""",
)
def opportunity_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesize(hypotheses(spark, sf_dir), critiques(spark, sf_dir)).select("hypothesis_id", "encounter_id", "category")


@query(
    "critique_checks",
    f"""WITH {_HYPOTHESES_SQL},
    crit AS (SELECT user_id, event_id, k, CASE WHEN k = 50 THEN -1 WHEN k = 51 THEN user_id ELSE event_id END AS h FROM ev WHERE event_type <> 'error'),
    flagged AS (SELECT *, count(*) OVER (PARTITION BY user_id, h) > 1 AS repeated,
      NOT EXISTS (SELECT 1 FROM ev e WHERE e.event_id = h AND e.user_id = c.user_id) AS missing,
      bool_or(k < 10 AND NOT EXISTS (SELECT 1 FROM evidence x WHERE x.user_id = c.user_id AND x.e = k))
        OVER (PARTITION BY user_id, h) AS unknown FROM crit c)
    SELECT event_id, concat_ws('|', CASE WHEN missing THEN 'unknown_hypothesis' END, CASE WHEN repeated THEN 'duplicate_critique' END,
      CASE WHEN unknown THEN 'unknown_evidence' END) AS violations FROM flagged WHERE missing OR repeated OR unknown""",
)
def critique_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = check_critiques(critiques(spark, sf_dir), hypotheses(spark, sf_dir), _evidence(spark, sf_dir))
    return rejects.select("event_id", F.concat_ws("|", "violations").alias("violations"))


# --- evaluation ------------------------------------------------------------------


@query(
    "evaluation_metrics",
    """WITH expected AS (SELECT DISTINCT source, doc_id FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0),
    predicted AS (SELECT DISTINCT source, doc_id FROM documents WHERE n_chars BETWEEN 300 AND 20000),
    sides AS (SELECT coalesce(e.source, p.source) AS source, e.doc_id IS NOT NULL AS e, p.doc_id IS NOT NULL AS p
      FROM expected e FULL JOIN predicted p ON e.source = p.source AND e.doc_id = p.doc_id),
    counts AS (SELECT source, count(*) FILTER (e AND p) AS true_positives, count(*) FILTER (p AND NOT e) AS false_positives,
      count(*) FILTER (e AND NOT p) AS false_negatives FROM sides GROUP BY source),
    scored AS (SELECT *, CASE WHEN true_positives + false_positives = 0 THEN 1.0 ELSE true_positives::DOUBLE / (true_positives + false_positives) END AS precision,
      CASE WHEN true_positives + false_negatives = 0 THEN 1.0 ELSE true_positives::DOUBLE / (true_positives + false_negatives) END AS recall FROM counts)
    SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0::DOUBLE * precision * recall / (precision + recall) END AS f1 FROM scored""",
)
def evaluation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A length rule that predicts good documents, against the labels, per source."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = (
        table(spark, sf_dir, "labels")
        .join(documents.select("doc_id", "source"), "doc_id")
        .withColumn("valid", (F.col("quality") == 1) & (F.col("toxic") == 0))
    )
    predictions = documents.filter(F.col("n_chars").between(300, 20_000))
    return evaluate(labels, predictions, ["source", "doc_id"], ["source"])


@query(
    "opportunity_evaluation",
    f"""WITH {_HYPOTHESES_SQL},
    expected AS (SELECT DISTINCT c_custkey AS encounter_id, 'missed_diagnosis' AS category, 'L89.154' AS key FROM customer WHERE c_acctbal > 0),
    predicted AS (SELECT DISTINCT encounter_id, category, CASE WHEN len(codes) > 0 THEN codes[1] ELSE 'H-' || event_id END AS key FROM hyp),
    sides AS (SELECT coalesce(e.category, p.category) AS category, e.key IS NOT NULL AS e, p.key IS NOT NULL AS p
      FROM expected e FULL JOIN predicted p ON e.encounter_id = p.encounter_id AND e.category = p.category AND e.key = p.key)
    SELECT category, count(*) FILTER (e AND p) AS true_positives, count(*) FILTER (p AND NOT e) AS false_positives,
      count(*) FILTER (e AND NOT p) AS false_negatives FROM sides GROUP BY category""",
)
def opportunity_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").alias("encounter_id"),
            F.lit("missed_diagnosis").alias("category"),
            F.lit("L89.154").alias("key"),
            (F.col("c_acctbal") > 0).alias("valid"),
        )
    )
    predictions = hypotheses(spark, sf_dir).withColumn("key", prediction_key(F.col("candidate_codes"), F.col("hypothesis_id")))
    scored = evaluate(labels, predictions, ["encounter_id", "category", "key"], ["category"])
    return scored.select("category", "true_positives", "false_positives", "false_negatives")


# --- governance ------------------------------------------------------------------


@query("retention_violations", "SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def retention_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns kept as derived artifacts although they are raw user input."""
    artifacts = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("contains_raw_input"))
    return retention_violations(artifacts).select("conv_id", "turn")


_PROVIDERS = ("purchase", "view", "signup", "click")


@query(
    "access_violations",
    f"""WITH {EVENTS_SQL} SELECT event_id, CASE WHEN event_type = 'error' THEN 'provider_not_allowlisted' WHEN k < 5 THEN 'not_deidentified'
      WHEN k < 10 THEN 'retention_enabled' WHEN k < 15 THEN 'telemetry_enabled' WHEN whole * 10000 > 250000 THEN 'input_too_large' END AS reason
    FROM ev WHERE event_type = 'error' OR k < 15 OR whole * 10000 > 250000""",
)
def access_violations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    requests = events(spark, sf_dir).select(
        "event_id",
        F.col("event_type").alias("provider"),
        (k >= 5).alias("deidentified"),
        (k >= 10).alias("zero_retention"),
        (k < 15).alias("telemetry_enabled"),
        (F.col("whole") * 10_000).alias("input_characters"),
    )
    return access_violations(requests, AccessPolicy(_PROVIDERS)).select("event_id", "reason")


@query(
    "promotable_patterns",
    """WITH measured AS (SELECT source, count(*) FILTER (quality = 1) AS good, count(*) AS n,
        max(CASE WHEN quality = 1 THEN lang ELSE '' END) AS reviewer FROM labels JOIN documents USING (doc_id) GROUP BY source)
    SELECT source, good::DOUBLE / n AS evaluation_precision,
      CASE WHEN source = 'src3' THEN 'no_reviewer' WHEN good::DOUBLE / n < 0.5::DOUBLE THEN 'precision_too_low'
        WHEN n < 5 THEN 'no_rule' ELSE 'promoted' END AS outcome FROM measured""",
)
def promotable_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources proposed as rules, by the share of their labelled documents that are good."""
    measured = (
        table(spark, sf_dir, "labels")
        .join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
        .groupBy("source")
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count(F.lit(1)).alias("n"))
    )
    proposals = measured.select(
        "source",
        F.when(F.col("source") != "src3", F.lit("reviewer-1")).alias("reviewer_id"),
        (F.col("good") / F.col("n")).alias("evaluation_precision"),
        F.when(F.col("n") >= 5, F.concat(F.lit("source="), "source")).alias("proposed_rule"),
    )
    ok, refused = promotable(proposals, min_precision=0.5)
    columns = ["source", "evaluation_precision"]
    return ok.select(*columns, F.lit("promoted").alias("outcome")).unionByName(
        refused.select(*columns, F.col("reason").alias("outcome"))
    )
