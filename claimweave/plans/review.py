"""Findings, tiers, consolidation, budget and the reviewer's queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.automation import (
    HUMAN_TIERS,
    best_per_key,
    check_plan,
    draft,
    human_items,
    plan_metrics,
    select_for_review,
)
from claimweave.operators.metrics import automation_summary, display_amount, display_percent, search_queue, unresolved
from claimweave.plans.bindings import (
    AUTOMATION_ID_SQL,
    EVENT_ITEMS_SQL,
    ORDER_FINDINGS_SQL,
    ORDER_ITEMS_SQL,
    POLICY,
    SELECTION_SQL,
    event_items,
    item_automation_id,
    order_findings,
    order_items,
    stored_items,
    table,
)
from claimweave.plans.registry import query

_FINDING_COLUMNS = (
    "l_orderkey, p_type, finding_id, disposition, confidence, contradicted, baseline_cents, simulated_cents, "
    "current_drg, simulated_drg, estimated_impact_cents, impact_status, line_count"
)


@query("omitted_charge_findings", f"WITH {ORDER_FINDINGS_SQL} SELECT {_FINDING_COLUMNS} FROM order_findings")
def omitted_charge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_findings(spark, sf_dir).select(*_FINDING_COLUMNS.split(", "))


@query(
    "tier_classification",
    f"""WITH {ORDER_ITEMS_SQL} SELECT finding_id, tier, reason_code, queue, recommended_action,
    estimated_review_seconds FROM items""",
)
def tier_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select(
        "finding_id", "tier", "reason_code", "queue", "recommended_action", "estimated_review_seconds"
    )


@query("priority_scores", f"WITH {ORDER_ITEMS_SQL} SELECT finding_id, tier, priority_score FROM items")
def priority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_items(spark, sf_dir).select("finding_id", "tier", "priority_score")


@query(
    "duplicate_consolidation",
    f"""WITH {EVENT_ITEMS_SQL} SELECT finding_id, fingerprint, tier, reason_code, queue, recommended_action,
    priority_score, duplicate_of, copies, {AUTOMATION_ID_SQL} AS automation_id FROM items""",
)
def duplicate_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_items(spark, sf_dir).select(
        "finding_id",
        "fingerprint",
        "tier",
        "reason_code",
        "queue",
        "recommended_action",
        "priority_score",
        "duplicate_of",
        "copies",
        item_automation_id().alias("automation_id"),
    )


@query(
    "review_budget",
    f"""WITH {SELECTION_SQL} SELECT user_id, finding_id, tier, priority_score, estimated_review_seconds, selected
    FROM selection""",
)
def review_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_for_review(stored_items(spark, sf_dir), "user_id", POLICY).select(
        "user_id", "finding_id", "tier", "priority_score", "estimated_review_seconds", "selected"
    )


@query(
    "plan_metrics",
    f"""WITH {SELECTION_SQL},
    counts AS (SELECT user_id, count(*) AS input_findings, count(*) FILTER (duplicate_of IS NULL) AS consolidated_findings,
        count(*) FILTER (tier = 'suppressed') AS suppressed, count(*) FILTER (tier = 'needs_enrichment') AS needs_enrichment,
        count(*) FILTER (tier = 'auto_routed') AS auto_routed, count(*) FILTER (tier = 'quick_confirm') AS quick_confirm,
        count(*) FILTER (tier = 'focused_review') AS focused_review, count(*) FILTER (tier = 'escalated') AS escalated
      FROM items GROUP BY user_id),
    review AS (SELECT user_id, count(*) FILTER (selected) AS review_now, count(*) FILTER (NOT selected) AS deferred,
        CAST(sum(CASE WHEN selected THEN estimated_review_seconds ELSE 0 END) AS BIGINT) AS estimated_review_seconds
      FROM selection GROUP BY user_id)
    SELECT counts.*, coalesce(review_now, 0) AS review_now, coalesce(deferred, 0) AS deferred,
      coalesce(estimated_review_seconds, 0) AS estimated_review_seconds
    FROM counts LEFT JOIN review USING (user_id)""",
)
def plan_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stored_items(spark, sf_dir)
    return plan_metrics(items, select_for_review(items, "user_id", POLICY), "user_id")


@query(
    "human_queue",
    f"""WITH {ORDER_ITEMS_SQL} SELECT l_orderkey, finding_id, tier, priority_score FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY priority_score DESC, finding_id) AS rn
      FROM items WHERE tier IN ('quick_confirm', 'focused_review', 'escalated')) WHERE rn = 1""",
)
def human_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most urgent human item of every encounter."""
    human = human_items(order_items(spark, sf_dir)).select("l_orderkey", "finding_id", "tier", "priority_score")
    return best_per_key(human, ["l_orderkey"], [F.desc("priority_score"), F.asc("finding_id")], "finding_id")


@query(
    "finding_drafts",
    f"""WITH {ORDER_ITEMS_SQL} SELECT finding_id,
      CASE WHEN tier IN ('suppressed', 'needs_enrichment') THEN NULL WHEN disposition = 'cdi_query' THEN 'cdi_query'
        ELSE 'workflow_note' END AS draft_kind,
      CASE WHEN tier IN ('suppressed', 'needs_enrichment') THEN NULL WHEN disposition = 'cdi_query' THEN NULL
        ELSE recommended_action END AS draft_action,
      CASE WHEN tier IN ('suppressed', 'needs_enrichment') THEN NULL WHEN disposition = 'cdi_query' THEN TRUE
        ELSE tier = 'focused_review' END AS editable,
      CASE WHEN tier IN ('suppressed', 'needs_enrichment') OR disposition = 'cdi_query' THEN NULL ELSE rationale END AS note,
      estimated_impact_cents / 100.0::DOUBLE AS impact_display,
      CAST(floor(confidence * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS confidence_percent
    FROM items""",
)
def finding_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = order_items(spark, sf_dir).withColumn(
        "_draft", draft(F.col("tier"), F.col("disposition"), F.col("rationale"), F.col("recommended_action"))
    )
    return items.select(
        "finding_id",
        F.col("_draft.kind").alias("draft_kind"),
        F.col("_draft.action").alias("draft_action"),
        F.col("_draft.editable").alias("editable"),
        F.when(F.col("_draft.kind") == "workflow_note", F.col("_draft.body")).alias("note"),
        display_amount(F.col("estimated_impact_cents")).alias("impact_display"),
        display_percent(F.col("confidence")).alias("confidence_percent"),
    )


@query(
    "plan_checks",
    f"""WITH {SELECTION_SQL}, broken AS (SELECT *, CASE WHEN k = 60 AND tier = 'auto_routed' THEN 'none' ELSE queue END AS q2,
        CASE WHEN k = 61 THEN NULL ELSE recommended_action END AS a2 FROM items)
    SELECT user_id, finding_id, 'human_tier_without_action' AS violation FROM broken
      WHERE tier IN ('quick_confirm', 'focused_review', 'escalated') AND a2 IS NULL
    UNION ALL SELECT user_id, finding_id, 'route_without_queue' FROM broken
      WHERE tier = 'auto_routed' AND (a2 IS NULL OR q2 = 'none')
    UNION ALL SELECT i.user_id, i.finding_id, 'unknown_primary' FROM items i
      WHERE k >= 98 AND duplicate_of IS NOT NULL AND NOT EXISTS (
        SELECT 1 FROM items p WHERE p.user_id = i.user_id AND p.finding_id = i.duplicate_of || '-x')""",
)
def plan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan cross-checks on items in which some queues, actions and primaries were damaged."""
    items = stored_items(spark, sf_dir)
    selection = select_for_review(items, "user_id", POLICY)
    damaged = items.withColumns(
        {
            "queue": F.when((F.col("k") == 60) & (F.col("tier") == "auto_routed"), F.lit("none")).otherwise(F.col("queue")),
            "recommended_action": F.when(F.col("k") != 61, F.col("recommended_action")),
            "duplicate_of": F.when(F.col("k") >= 98, F.concat("duplicate_of", F.lit("-x"))).otherwise(F.col("duplicate_of")),
        }
    )
    return check_plan(damaged, selection, "user_id")


@query(
    "queue_search",
    f"""WITH {ORDER_ITEMS_SQL} SELECT finding_id, title, priority_score FROM items
    WHERE tier IN ('quick_confirm', 'focused_review', 'escalated')
      AND contains(lower(title || ' ' || case_id || ' ' || queue), 'type large case-1')
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority = '1-URGENT')""",
)
def queue_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open human items that match a text; urgent orders count as decided."""
    outcome = F.when(F.col("tier").isin(*HUMAN_TIERS), "human_exception").otherwise(F.col("tier"))
    items = order_items(spark, sf_dir).withColumn("outcome", outcome)
    decided = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority") == "1-URGENT")
        .select(F.col("o_orderkey").alias("l_orderkey"))
    )
    found = search_queue(
        items,
        decided,
        outcome="human_exception",
        query="TYPE Large CASE-1",
        fields=["title", "case_id", "queue"],
        key="l_orderkey",
    )
    return found.select("finding_id", "title", "priority_score")


@query(
    "unresolved_work",
    f"""WITH {ORDER_ITEMS_SQL} SELECT finding_id, tier FROM items WHERE NOT EXISTS (
      SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderpriority IN ('1-URGENT', '2-HIGH'))""",
)
def unresolved_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = (
        table(spark, sf_dir, "orders")
        .filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
        .select(F.col("o_orderkey").alias("l_orderkey"))
    )
    return unresolved(order_items(spark, sf_dir), decided, "l_orderkey").select("finding_id", "tier")


@query(
    "automation_summary",
    f"""WITH {ORDER_ITEMS_SQL}, worst AS (SELECT l_orderkey, max(CASE WHEN tier IN ('quick_confirm', 'focused_review', 'escalated')
        THEN 3 WHEN tier = 'auto_routed' THEN 2 ELSE 1 END) AS level FROM items GROUP BY l_orderkey)
    SELECT count(*) AS scanned, count(*) FILTER (level IS NULL) AS clean, count(*) FILTER (level = 2) AS auto_routed,
      count(*) FILTER (level = 1) AS suppressed, count(*) FILTER (level = 3) AS human,
      round(100.0::DOUBLE * (count(*) - count(*) FILTER (level = 3)) / count(*), 1) AS no_touch_percent
    FROM orders LEFT JOIN worst ON o_orderkey = l_orderkey""",
)
def automation_summary_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    encounters = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return automation_summary(encounters, order_items(spark, sf_dir), "l_orderkey")
