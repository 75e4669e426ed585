"""References, overlaps, budgets, grounding, lineage and money checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.checks import (
    DOCUMENT_LIMITS,
    budget_usage,
    check_assertions,
    check_budget,
    check_locators,
    checked_grounding,
    duplicates,
    overlap,
    unknown_references,
)
from claimweave.operators.financial import check_denials, check_lines, check_remittances, denied_amounts
from claimweave.plans.bindings import EVENTS_SQL, cents, events, table, text_id
from claimweave.plans.registry import query


@query(
    "reference_integrity",
    f"""WITH {EVENTS_SQL}, cited AS (SELECT event_id, k * 20 AS reference FROM ev UNION ALL SELECT event_id, event_id FROM ev)
    SELECT event_id, reference FROM cited WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = reference)""",
)
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents an event cites that do not exist."""
    cited = F.array(F.col("k") * 20, F.col("event_id"))
    return unknown_references(
        events(spark, sf_dir), ["event_id"], cited, table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"]
    )


@query(
    "evidence_overlap",
    f"""WITH {EVENTS_SQL} SELECT event_id, k, user_id, whole FROM ev
    WHERE whole IN (k, user_id) OR whole + 1 IN (k, user_id)""",
)
def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    supporting, contradicting = F.array("k", "user_id"), F.array(F.col("whole"), F.col("whole") + 1)
    return events(spark, sf_dir).filter(overlap(supporting, contradicting)).select("event_id", "k", "user_id", "whole")


@query(
    "size_budgets",
    """WITH usage AS (SELECT lang, count(*) AS items, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS characters
      FROM documents GROUP BY lang)
    SELECT *, concat_ws('|', CASE WHEN items > 200 THEN 'max_items' END, CASE WHEN longest > 200000 THEN 'max_characters' END,
      CASE WHEN characters > 1000000 THEN 'max_total_characters' END) AS violations FROM usage
    WHERE items > 200 OR longest > 200000 OR characters > 1000000""",
)
def size_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages whose documents exceed the limits of one bundle."""
    usage = budget_usage(table(spark, sf_dir, "documents"), ["lang"], "text")
    _, rejects = check_budget(usage, DOCUMENT_LIMITS)
    return rejects.withColumn("violations", F.concat_ws("|", "violations"))


@query(
    "conversation_budgets",
    """WITH usage AS (SELECT conv_id, count(*) AS items, max(length(text)) AS longest, CAST(sum(length(text)) AS BIGINT) AS characters
      FROM conversations GROUP BY conv_id)
    SELECT *, concat_ws('|', CASE WHEN items > 4 THEN 'max_items' END, CASE WHEN longest > 300 THEN 'max_characters' END,
      CASE WHEN characters > 900 THEN 'max_total_characters' END) AS violations FROM usage
    WHERE items > 4 OR longest > 300 OR characters > 900""",
)
def conversation_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = budget_usage(table(spark, sf_dir, "conversations"), ["conv_id"], "text")
    _, rejects = check_budget(usage, {"max_items": 4, "max_characters": 300, "max_total_characters": 900})
    return rejects.withColumn("violations", F.concat_ws("|", "violations"))


@query(
    "uniqueness",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "evidence_grounding",
    """WITH evidence AS (
      SELECT 'D-' || doc_id AS evidence_id, doc_id, lang AS author_role, substr(text, CAST(length(text) // 3 AS BIGINT) + 1) AS excerpt
      FROM documents
      UNION ALL SELECT 'B-' || item_id, item_id, 'en', text FROM benchmark
      UNION ALL SELECT 'C-' || conv_id || '-' || turn, conv_id, role, text FROM conversations)
    SELECT evidence_id, concat_ws('|', CASE WHEN d.doc_id IS NULL THEN 'unknown_document' END,
      CASE WHEN d.doc_id IS NOT NULL AND e.author_role <> d.lang THEN 'metadata_changed' END,
      CASE WHEN d.doc_id IS NOT NULL AND NOT contains(d.text, e.excerpt) THEN 'not_an_excerpt' END) AS violations
    FROM evidence e LEFT JOIN documents d ON e.doc_id = d.doc_id""",
)
def evidence_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts (the rest of a text from its first third on, whole passages, whole turns) against the whole document they cite."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("document_id"), F.col("lang").alias("author_role"), F.lit("2026-01-01").alias("recorded_at"), "text"
    )
    stamp = F.lit("2026-01-01").alias("recorded_at")
    third = F.floor(F.length("text") / 3) + 1
    quoted = documents.select(
        text_id("D-", "document_id").alias("evidence_id"),
        "document_id",
        "author_role",
        stamp,
        F.substr(F.col("text"), third.cast("int")).alias("text"),
    )
    passages = table(spark, sf_dir, "benchmark").select(
        text_id("B-", "item_id").alias("evidence_id"),
        F.col("item_id").alias("document_id"),
        F.lit("en").alias("author_role"),
        stamp,
        "text",
    )
    turns = table(spark, sf_dir, "conversations").select(
        text_id("C-", "conv_id", "turn").alias("evidence_id"),
        F.col("conv_id").alias("document_id"),
        F.col("role").alias("author_role"),
        stamp,
        "text",
    )
    checked = checked_grounding(quoted.unionByName(passages).unionByName(turns), documents, [])
    return checked.select("evidence_id", F.concat_ws("|", "violations").alias("violations"))


@query(
    "subject_resolution",
    f"""WITH {EVENTS_SQL},
    assertions AS (SELECT user_id AS case_id, event_id, event_type || '-' || k AS assertion_id,
        CASE event_type WHEN 'purchase' THEN 'BUILDING' WHEN 'view' THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS subject_id,
        CASE WHEN k <> 10 THEN 'ev-' || whole END AS cited, 'ev-' || k AS counter FROM ev),
    entities AS (SELECT DISTINCT c_custkey AS case_id, c_mktsegment AS subject_id FROM customer),
    evidence AS (SELECT DISTINCT user_id AS case_id, 'ev-' || whole AS evidence_id FROM ev WHERE event_type = 'purchase'),
    flagged AS (SELECT a.*, count(*) OVER (PARTITION BY case_id, assertion_id) > 1 AS repeated,
      NOT EXISTS (SELECT 1 FROM entities e WHERE e.case_id = a.case_id AND e.subject_id = a.subject_id) AS unknown_subject,
      (cited IS NOT NULL AND NOT EXISTS (SELECT 1 FROM evidence e WHERE e.case_id = a.case_id AND e.evidence_id = a.cited))
        OR NOT EXISTS (SELECT 1 FROM evidence e WHERE e.case_id = a.case_id AND e.evidence_id = a.counter) AS missing
      FROM assertions a),
    spread AS (SELECT *, bool_or(missing) OVER (PARTITION BY case_id, assertion_id) AS unknown_evidence FROM flagged)
    SELECT event_id, concat_ws('|', CASE WHEN repeated THEN 'duplicate_id' END, CASE WHEN unknown_subject THEN 'unknown_subject' END,
      CASE WHEN cited IS NULL THEN 'no_evidence' END, CASE WHEN cited = counter THEN 'overlap' END,
      CASE WHEN unknown_evidence THEN 'unknown_evidence' END) AS violations FROM spread
    WHERE repeated OR unknown_subject OR cited IS NULL OR cited = counter OR unknown_evidence""",
)
def subject_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions without a subject or evidence in their case, and repeated ids."""
    source = events(spark, sf_dir)
    kind = F.col("event_type")
    none = F.array().cast("array<string>")
    assertions = source.select(
        F.col("user_id").alias("case_id"),
        "event_id",
        text_id("", "event_type", "k").alias("assertion_id"),
        F.when(kind == "purchase", "BUILDING").when(kind == "view", "MACHINERY").otherwise("HOUSEHOLD").alias("subject_id"),
        F.when(F.col("k") != 10, F.array(text_id("ev-", "whole"))).otherwise(none).alias("evidence_ids"),
        F.array(text_id("ev-", "k")).alias("contradicting_evidence_ids"),
    )
    entities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("entity_id"))
    evidence = source.filter(kind == "purchase").select(F.col("user_id").alias("case_id"), text_id("ev-", "whole").alias("evidence_id"))
    _, rejects = check_assertions(assertions, entities, evidence)
    return rejects.select("event_id", F.concat_ws("|", "violations").alias("violations"))


@query(
    "locator_provenance",
    f"""WITH {EVENTS_SQL}, located AS (SELECT event_id, user_id, CASE WHEN k < 80 THEN CASE WHEN k < 40 THEN 'BUILDING' ELSE 'MACHINERY' END END AS adapter
      FROM ev)
    SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'locator_without_provenance' ELSE 'locator_mismatch' END AS violation
    FROM located LEFT JOIN (SELECT * FROM customer WHERE c_nationkey < 20) c ON user_id = c_custkey
    WHERE adapter IS NOT NULL AND (c_custkey IS NULL OR c_mktsegment <> adapter)""",
)
def locator_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence locators against the adapter that ingested their case."""
    k = F.col("k")
    locator = F.struct(
        F.when(k < 40, "BUILDING").otherwise("MACHINERY").alias("adapter_id"), F.lit("1.0.0").alias("adapter_version")
    )
    evidence = events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("case_id"), F.when(k < 80, locator).alias("source_locator")
    )
    provenance = table(spark, sf_dir, "customer").filter(F.col("c_nationkey") < 20).select(
        F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("adapter_id"), F.lit("1.0.0").alias("adapter_version")
    )
    _, rejects = check_locators(evidence, provenance, ["case_id"])
    return rejects.select("event_id", F.col("violations")[0].alias("violation"))


# --- money -----------------------------------------------------------------------



def claim_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("claim_id"),
        text_id("L-", "l_linenumber").alias("line_id"),
        F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("code"),
        (F.col("l_quantity") - 1).cast("bigint").alias("units"),
        cents(F.col("l_extendedprice")).alias("charged_amount_cents"),
        (cents(F.col("l_extendedprice")) - F.lit(200_000)).alias("allowed_amount_cents"),
        F.when(F.col("l_linestatus") == "F", "final").otherwise("").alias("status"),
    )


@query(
    "financial_checks",
    """WITH lines AS (SELECT l_orderkey AS claim_id, 'L-' || l_linenumber AS line_id, CAST(l_quantity - 1 AS BIGINT) AS units,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS charged, l_linestatus, l_partkey FROM lineitem),
    flagged AS (SELECT *, count(*) OVER (PARTITION BY claim_id, line_id) > 1 AS repeated FROM lines)
    SELECT claim_id, line_id, l_partkey, concat_ws('|', CASE WHEN repeated THEN 'duplicate_line' END,
      CASE WHEN l_linestatus <> 'F' THEN 'blank_field' END, CASE WHEN units <= 0 THEN 'units_not_positive' END,
      CASE WHEN charged < 200000 THEN 'negative_allowed' END) AS violations FROM flagged
    WHERE repeated OR l_linestatus <> 'F' OR units <= 0 OR charged < 200000""",
)
def financial_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = check_lines(claim_lines(spark, sf_dir), "claim_id")
    return rejects.select(
        "claim_id",
        "line_id",
        F.substring("code", 3, 20).cast("bigint").alias("l_partkey"),
        F.concat_ws("|", "violations").alias("violations"),
    )


def denials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines as denials; ledger numbers beyond the claim are unknown lines."""
    returned = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    return returned.select(
        F.col("l_orderkey").alias("claim_id"),
        text_id("DN-", "l_partkey", "l_suppkey", "l_linenumber").alias("denial_id"),
        F.array(text_id("L-", "l_linenumber"), text_id("L-", (F.col("l_linenumber") % 3) + 1)).alias("line_ids"),
        F.when(F.col("l_discount") > 0, cents(F.col("l_extendedprice")) - F.lit(150_000)).alias("amount_cents"),
    )


@query(
    "denial_checks",
    """WITH denials AS (SELECT DISTINCT l_orderkey AS claim_id, 'DN-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS denial_id,
        l_linenumber AS a, l_linenumber % 3 + 1 AS b,
        CASE WHEN l_discount > 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) - 150000 END AS amount
      FROM lineitem WHERE l_returnflag = 'R'),
    flagged AS (SELECT *, NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = claim_id AND l_linenumber = b) AS unknown FROM denials)
    SELECT claim_id, denial_id, concat_ws('|', CASE WHEN a = b THEN 'duplicate_lines' END, CASE WHEN unknown THEN 'unknown_line' END,
      CASE WHEN amount < 0 THEN 'negative_amount' END) AS violations FROM flagged
    WHERE a = b OR unknown OR coalesce(amount < 0, FALSE)""",
)
def denial_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = claim_lines(spark, sf_dir)
    _, rejects = check_denials(denials(spark, sf_dir).distinct(), lines, "claim_id")
    return rejects.select("claim_id", "denial_id", F.concat_ws("|", "violations").alias("violations"))


@query(
    "remittance_checks",
    """SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice < 20000 THEN 'negative_payment' END,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'duplicate_denials' END) AS violations FROM orders
    WHERE o_totalprice < 20000 OR o_orderpriority = '1-URGENT'""",
)
def remittance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as remittances net of a fixed fee; urgent ones name a denial twice."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    remittances = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (cents(F.col("o_totalprice")) - F.lit(2_000_000)).alias("paid_amount_cents"),
        F.lit(0).alias("adjustment_amount_cents"),
        F.when(urgent, F.array(F.lit("d"), F.lit("d"))).otherwise(F.array(F.lit("d"))).alias("denial_ids"),
    )
    _, rejects = check_remittances(remittances)
    return rejects.select("o_orderkey", F.concat_ws("|", "violations").alias("violations"))


@query(
    "denied_amounts",
    """SELECT l_orderkey AS claim_id, CAST(sum(coalesce(CASE WHEN l_discount > 0
        THEN CAST(round(l_extendedprice * 100) AS BIGINT) - 150000 END, 0)) AS BIGINT) AS denied_amount_cents, count(*) AS denials
    FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey""",
)
def denied_amounts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denied_amounts(denials(spark, sf_dir), "claim_id")
