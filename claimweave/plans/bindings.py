"""The test tables read as encounters, claims, findings and requests.

Each view exists twice: as a DataFrame and as the SQL the twins are built on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.functions.canonical import canonical_hash, short_id
from claimweave.operators.automation import Policy, automation_id, classify, consolidate, semantic_fingerprint
from claimweave.session import materialize

POLICY = Policy()
AS_OF = "2026-01-01T00:00:00Z"
TENANT = "tenant-a"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("bigint")


def text_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def choose(column: Column, table: dict[str, str], default: str | None = None) -> Column:
    result = F.lit(default)
    for key, value in table.items():
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result


def choose_sql(column: str, table: dict[str, str], default: str = "NULL") -> str:
    branches = " ".join(f"WHEN '{key}' THEN '{value}'" for key, value in table.items())
    return f"CASE {column} {branches} ELSE {default} END"


# --- claim lines -----------------------------------------------------------------


def charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order and part type: cents, lines, billed and disputed flags."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_extendedprice", "l_linestatus", "l_returnflag"
    )
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return lines.join(part, "l_partkey").groupBy("l_orderkey", "p_type").agg(
        F.sum(cents(F.col("l_extendedprice"))).alias("type_cents"),
        F.count(F.lit(1)).alias("line_count"),
        F.bool_or(F.col("l_linestatus") == "F").alias("billed"),
        F.bool_or(F.col("l_returnflag") == "R").alias("contradicted"),
    )


CHARGES_SQL = """charges AS (
  SELECT l_orderkey, p_type, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS type_cents,
         count(*) AS line_count, bool_or(l_linestatus = 'F') AS billed, bool_or(l_returnflag = 'R') AS contradicted
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_type)"""

# Fixed values of the binding: how each part type is routed.
TYPE_DISPOSITION = {
    "LARGE": "coding_review",
    "STANDARD": "charge_review",
    "ECONOMY": "cdi_query",
    "SMALL": "compliance_review",
    "MEDIUM": "insufficient_evidence",
    "PROMO": "no_opportunity",
}


def band(amount: Column) -> Column:
    return F.when(amount < 5_000_000, F.lit("BAND-1")).when(amount < 15_000_000, F.lit("BAND-2")).otherwise(F.lit("BAND-3"))


def _band_sql(amount: str) -> str:
    return f"CASE WHEN {amount} < 5000000 THEN 'BAND-1' WHEN {amount} < 15000000 THEN 'BAND-2' ELSE 'BAND-3' END"


def order_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services an order documents without billing them, priced against its billed baseline.

    The lines shrink to one row per order and part type before the window, whose
    groups are therefore bounded by the number of part types.
    """
    per_order = Window.partitionBy("l_orderkey")
    billed = F.when(F.col("billed"), F.col("type_cents")).otherwise(F.lit(0))
    omitted = (
        charges(spark, sf_dir)
        .withColumn("baseline_cents", F.sum(billed).over(per_order))
        .filter(~F.col("billed"))
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus"
    )
    joined = omitted.join(orders, "l_orderkey")
    case_id = text_id("CASE-", "l_orderkey")
    digest = canonical_hash(
        case_id=case_id,
        change=F.create_map(F.lit("add_charges"), F.array("p_type")),
        package_id=F.lit("charge-rules"),
        package_version=F.lit("1.0.0"),
        rule_id=F.lit("CHARGE-OMITTED"),
    )
    unknown = F.col("o_orderstatus") == "P"
    simulated = F.col("baseline_cents") + F.col("type_cents")
    return joined.select(
        "l_orderkey",
        "o_custkey",
        "p_type",
        case_id.alias("case_id"),
        short_id("finding", digest, 16).alias("finding_id"),
        F.concat(F.lit("Undocumented charge of type "), "p_type").alias("title"),
        F.concat(F.lit("Lines of type "), "p_type", F.lit(" were delivered and not billed.")).alias("rationale"),
        choose(F.col("p_type"), TYPE_DISPOSITION).alias("disposition"),
        F.when(F.col("line_count") == 1, F.lit(0.92)).when(F.col("line_count") == 2, F.lit(0.94)).otherwise(F.lit(0.97)).alias("confidence"),
        (~F.col("p_type").isin("ECONOMY", "MEDIUM") & ((F.col("p_type") != "PROMO") | (F.col("line_count") >= 2))).alias("has_change"),
        "contradicted",
        "baseline_cents",
        simulated.alias("simulated_cents"),
        band(F.col("baseline_cents")).alias("current_drg"),
        band(simulated).alias("simulated_drg"),
        F.when(~unknown, F.col("type_cents")).alias("estimated_impact_cents"),
        F.when(unknown, F.lit("unavailable")).otherwise(F.lit("estimated")).alias("impact_status"),
        (F.col("line_count") + 0).alias("line_count"),
    )


ORDER_FINDINGS_SQL = f"""{CHARGES_SQL},
omitted AS (
  SELECT *, CAST(sum(CASE WHEN billed THEN type_cents ELSE 0 END) OVER (PARTITION BY l_orderkey) AS BIGINT) AS baseline_cents
  FROM charges),
order_findings AS (
  SELECT l_orderkey, o_custkey, p_type, 'CASE-' || l_orderkey AS case_id,
    'finding-' || substr(sha256('{{"case_id":"CASE-' || l_orderkey || '","change":{{"add_charges":["' || p_type
      || '"]}},"package_id":"charge-rules","package_version":"1.0.0","rule_id":"CHARGE-OMITTED"}}'), 1, 16) AS finding_id,
    'Undocumented charge of type ' || p_type AS title,
    'Lines of type ' || p_type || ' were delivered and not billed.' AS rationale,
    {choose_sql("p_type", TYPE_DISPOSITION)} AS disposition,
    CASE WHEN line_count = 1 THEN 0.92 WHEN line_count = 2 THEN 0.94 ELSE 0.97 END::DOUBLE AS confidence,
    p_type NOT IN ('ECONOMY', 'MEDIUM') AND (p_type <> 'PROMO' OR line_count >= 2) AS has_change,
    contradicted, baseline_cents, baseline_cents + type_cents AS simulated_cents,
    {_band_sql("baseline_cents")} AS current_drg, {_band_sql("(baseline_cents + type_cents)")} AS simulated_drg,
    CASE WHEN o_orderstatus <> 'P' THEN type_cents END AS estimated_impact_cents,
    CASE WHEN o_orderstatus = 'P' THEN 'unavailable' ELSE 'estimated' END AS impact_status, line_count
  FROM omitted JOIN orders ON l_orderkey = o_orderkey WHERE NOT billed)"""


# --- findings out of events ------------------------------------------------------

# Fixed values of the binding: how each event type is routed.
EVENT_DISPOSITION = {
    "purchase": "charge_review",
    "view": "cdi_query",
    "signup": "coding_review",
    "click": "no_opportunity",
    "error": "insufficient_evidence",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enriched(table(spark, sf_dir, "events"))


def enriched(source: DataFrame) -> DataFrame:
    """Events with the number ``k`` of their properties and the whole part of their value."""
    return source.select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.floor("value").alias("whole"),
        "props",
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS BIGINT) AS k,
         CAST(floor(value) AS BIGINT) AS whole, props FROM events)"""


def event_findings(source: DataFrame) -> DataFrame:
    """One finding per event; equal ones (fingerprint) occur several times per user."""
    none = F.array().cast("array<string>")
    kind, k, whole = F.col("event_type"), F.col("k"), F.col("whole")
    case_id = text_id("CASE-", "user_id")
    change = kind.isin("purchase", "signup") | ((kind == "click") & (k >= 50))
    unknown = k.between(90, 94)
    impact = F.when(~unknown, F.when(k >= 95, -whole * 10_000).otherwise(whole * 10_000))
    rows = enriched(source).select(
        "event_id",
        "user_id",
        "event_type",
        "k",
        case_id.alias("case_id"),
        short_id("finding", canonical_hash(case_id=case_id, event_id=F.col("event_id")), 16).alias("finding_id"),
        F.concat(F.lit("RULE-"), F.upper(kind)).alias("rule_id"),
        F.concat(F.lit("Review of "), kind).alias("title"),
        F.lit("Observed behaviour differs from the claim.").alias("rationale"),
        F.lit("event-rules").alias("rule_package_id"),
        F.lit("1.0.0").alias("rule_package_version"),
        F.lit("bands-1").alias("grouper_version"),
        F.when(F.col("value") >= 200, F.lit("compliance_review")).otherwise(choose(kind, EVENT_DISPOSITION)).alias("disposition"),
        F.get(F.array(F.lit(0.9), F.lit(0.94), F.lit(0.96), F.lit(0.99)), (k % 4).cast("int")).alias("confidence"),
        change.alias("has_change"),
        (k < 5).alias("contradicted"),
        F.lit("GROUP-A").alias("current_drg"),
        F.when((F.col("value") >= 20) & change, F.lit("GROUP-B")).otherwise(F.lit("GROUP-A")).alias("simulated_drg"),
        impact.alias("estimated_impact_cents"),
        F.when(unknown, F.lit("unavailable")).otherwise(F.lit("estimated")).alias("impact_status"),
        F.lit(True).alias("requires_human_review"),
        F.when(change, F.create_map(F.lit("add_charges"), F.array(kind)))
        .otherwise(F.create_map().cast("map<string,array<string>>"))
        .alias("proposed_change"),
        F.array(text_id("subject-", "user_id")).alias("subject_ids"),
        F.array(F.concat(F.lit("evidence-"), kind, F.lit("-"), whole.cast("string"))).alias("evidence_ids"),
        F.when(k < 5, F.array(text_id("counter-", "k"))).otherwise(none).alias("contradicting_evidence_ids"),
    )
    scope = canonical_hash(case_id=F.col("case_id"), tenant_id=F.lit(TENANT))
    return rows.withColumn("fingerprint", semantic_fingerprint(scope))


EVENT_FINDINGS_SQL = f"""{EVENTS_SQL},
event_base AS (
  SELECT *, 'CASE-' || user_id AS case_id,
    event_type IN ('purchase', 'signup') OR (event_type = 'click' AND k >= 50) AS has_change,
    CASE WHEN value >= 200 THEN 'compliance_review' ELSE {choose_sql("event_type", EVENT_DISPOSITION)} END AS disposition,
    CASE k % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.94 WHEN 2 THEN 0.96 ELSE 0.99 END::DOUBLE AS confidence,
    k < 5 AS contradicted,
    CASE WHEN k BETWEEN 90 AND 94 THEN NULL WHEN k >= 95 THEN -whole * 10000 ELSE whole * 10000 END AS estimated_impact_cents,
    CASE WHEN k BETWEEN 90 AND 94 THEN 'unavailable' ELSE 'estimated' END AS impact_status
  FROM ev),
event_findings AS (
  SELECT event_id, user_id, event_type, k, case_id,
    'finding-' || substr(sha256('{{"case_id":"' || case_id || '","event_id":' || event_id || '}}'), 1, 16) AS finding_id,
    'Review of ' || event_type AS title, 'Observed behaviour differs from the claim.' AS rationale,
    'RULE-' || upper(event_type) AS rule_id, disposition, confidence, has_change, contradicted, impact_status,
    'GROUP-A' AS current_drg, CASE WHEN value >= 20 AND has_change THEN 'GROUP-B' ELSE 'GROUP-A' END AS simulated_drg,
    estimated_impact_cents, TRUE AS requires_human_review,
    sha256('{{"confidence":' || confidence || ',"contradicting_evidence_ids":['
      || CASE WHEN contradicted THEN '"counter-' || k || '"' ELSE '' END
      || '],"current_drg":"GROUP-A","disposition":"' || disposition || '","estimated_impact_cents":'
      || coalesce(CAST(estimated_impact_cents AS VARCHAR), 'null')
      || ',"evidence_ids":["evidence-' || event_type || '-' || whole || '"],"grouper_version":"bands-1","impact_status":"'
      || impact_status || '","proposed_change":' || CASE WHEN has_change THEN '{{"add_charges":["' || event_type || '"]}}' ELSE '{{}}' END
      || ',"rationale":"Observed behaviour differs from the claim.","rule_id":"RULE-' || upper(event_type)
      || '","rule_package_id":"event-rules","rule_package_version":"1.0.0","scope_hash":"'
      || sha256('{{"case_id":"' || case_id || '","tenant_id":"{TENANT}"}}') || '","simulated_drg":"'
      || CASE WHEN value >= 20 AND has_change THEN 'GROUP-B' ELSE 'GROUP-A' END
      || '","subject_ids":["subject-' || user_id || '"],"title":"Review of ' || event_type || '"}}') AS fingerprint
  FROM event_base)"""


# --- classified items ------------------------------------------------------------


def classify_sql(source: str, target: str) -> str:
    """CTEs that add the automation columns to the rows of ``source``."""
    return f"""{target}_tiers AS (
  SELECT *, CASE
    WHEN contradicted THEN 'escalated/contradictory_evidence'
    WHEN disposition = 'compliance_review' OR coalesce(estimated_impact_cents < 0, FALSE) THEN 'escalated/compliance_sensitive'
    WHEN disposition = 'no_opportunity' AND NOT has_change THEN 'suppressed/no_actionable_change'
    WHEN disposition = 'no_opportunity' THEN 'escalated/inconsistent_finding'
    WHEN disposition = 'insufficient_evidence' THEN 'needs_enrichment/insufficient_evidence'
    WHEN estimated_impact_cents IS NULL OR impact_status = 'unavailable' THEN 'escalated/unknown_impact'
    WHEN disposition = 'cdi_query' THEN 'focused_review/documentation_query'
    WHEN current_drg <> simulated_drg AND confidence >= 0.95::DOUBLE THEN 'quick_confirm/material_drg_change'
    WHEN current_drg = simulated_drg AND confidence >= 0.93::DOUBLE AND abs(estimated_impact_cents) <= 250000
      THEN 'auto_routed/routine_operational_route'
    ELSE 'focused_review/lower_confidence' END AS verdict
  FROM {source}),
{target}_routed AS (
  SELECT *, split_part(verdict, '/', 1) AS tier, split_part(verdict, '/', 2) AS reason_code,
    CASE disposition WHEN 'coding_review' THEN 'coding' WHEN 'cdi_query' THEN 'cdi' WHEN 'charge_review' THEN 'charge'
      WHEN 'compliance_review' THEN 'compliance' ELSE 'none' END AS base_queue
  FROM {target}_tiers),
{target}_queued AS (
  SELECT *, CASE WHEN reason_code IN ('compliance_sensitive', 'inconsistent_finding')
        OR (reason_code = 'contradictory_evidence' AND base_queue = 'none') THEN 'compliance'
      WHEN tier IN ('suppressed', 'needs_enrichment') THEN 'none' ELSE base_queue END AS queue
  FROM {target}_routed),
{target} AS (
  SELECT * EXCLUDE (verdict, base_queue),
    CASE queue WHEN 'none' THEN NULL WHEN 'charge' THEN 'route_to_charge_review' ELSE 'route_to_' || queue END AS recommended_action,
    CAST(CASE tier WHEN 'quick_confirm' THEN 30 WHEN 'focused_review' THEN 180 WHEN 'escalated' THEN 240 ELSE 0 END AS BIGINT)
      AS estimated_review_seconds,
    CAST(CASE tier WHEN 'suppressed' THEN 0 WHEN 'needs_enrichment' THEN 5000 WHEN 'auto_routed' THEN 10000
        WHEN 'quick_confirm' THEN 30000 WHEN 'focused_review' THEN 40000 ELSE 50000 END
      + trunc(confidence * 10000)
      + CASE WHEN estimated_impact_cents IS NULL THEN 5000 ELSE least(abs(estimated_impact_cents) // 100, 10000) END AS BIGINT)
      AS priority_score
  FROM {target}_queued)"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(order_findings(spark, sf_dir), POLICY)


ORDER_ITEMS_SQL = ORDER_FINDINGS_SQL + ",\n" + classify_sql("order_findings", "items")

#: Columns of an item that later steps read.
ITEM_COLUMNS = [
    "user_id",
    "event_id",
    "event_type",
    "k",
    "case_id",
    "finding_id",
    "title",
    "tier",
    "reason_code",
    "queue",
    "recommended_action",
    "allowed_actions",
    "priority_score",
    "estimated_review_seconds",
    "fingerprint",
]

#: Those that decisions read.
DECISION_COLUMNS = [
    "user_id",
    "event_id",
    "event_type",
    "k",
    "finding_id",
    "tier",
    "reason_code",
    "allowed_actions",
    "priority_score",
    "estimated_review_seconds",
    "fingerprint",
]


def event_items(spark: SparkSession, sf_dir: str, columns: list[str] = ITEM_COLUMNS) -> DataFrame:
    """Classified event findings with duplicates consolidated; the plan is the user."""
    classified = materialize(classified_events(table(spark, sf_dir, "events")).select(*columns), "classified")
    return consolidate(classified, ["user_id", "fingerprint"])


def classified_events(source: DataFrame) -> DataFrame:
    return classify(event_findings(source), POLICY).select(*ITEM_COLUMNS)


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The item table, written once for the steps that read it several times."""
    return materialize(event_items(spark, sf_dir), "items")


EVENT_ITEMS_SQL = (
    EVENT_FINDINGS_SQL
    + ",\n"
    + classify_sql("event_findings", "classified")
    + """,
ranked AS (
  SELECT *, row_number() OVER w AS rn, first_value(finding_id) OVER w AS primary_id,
         count(*) OVER (PARTITION BY user_id, fingerprint) AS group_size
  FROM classified WINDOW w AS (PARTITION BY user_id, fingerprint ORDER BY priority_score DESC, finding_id)),
items AS (
  SELECT user_id, event_id, event_type, k, case_id, finding_id, title, fingerprint,
    CASE WHEN rn = 1 THEN tier ELSE 'suppressed' END AS tier,
    CASE WHEN rn = 1 THEN reason_code ELSE 'exact_duplicate' END AS reason_code,
    CASE WHEN rn = 1 THEN queue ELSE 'none' END AS queue,
    CASE WHEN rn = 1 THEN recommended_action END AS recommended_action,
    CASE WHEN rn = 1 THEN priority_score ELSE 0 END AS priority_score,
    CASE WHEN rn = 1 THEN estimated_review_seconds ELSE 0 END AS estimated_review_seconds,
    CASE WHEN rn > 1 THEN primary_id END AS duplicate_of,
    CASE WHEN rn = 1 THEN group_size ELSE 1 END AS copies
  FROM ranked)"""
)

SELECTION_SQL = (
    EVENT_ITEMS_SQL
    + """,
walk AS (
  SELECT user_id, list({'id': finding_id, 's': estimated_review_seconds,
      'x': reason_code IN ('contradictory_evidence', 'compliance_sensitive', 'unknown_impact')}
      ORDER BY priority_score DESC, finding_id) AS items
  FROM items WHERE tier IN ('quick_confirm', 'focused_review', 'escalated') GROUP BY user_id),
folded AS (
  SELECT user_id, list_reduce(items,
      lambda acc, x: CASE WHEN x.x OR (acc.n < 25 AND acc.s + x.s <= 1800)
        THEN {'n': acc.n + 1, 's': acc.s + x.s, 'taken': list_append(acc.taken, x.id)} ELSE acc END,
      {'n': CAST(0 AS BIGINT), 's': CAST(0 AS BIGINT), 'taken': CAST([] AS VARCHAR[])}) AS state
  FROM walk),
selection AS (
  SELECT i.*, list_contains(f.state.taken, i.finding_id) AS selected
  FROM items i JOIN folded f USING (user_id) WHERE tier IN ('quick_confirm', 'focused_review', 'escalated'))"""
)


def item_automation_id() -> Column:
    scope = canonical_hash(case_id=F.col("case_id"), tenant_id=F.lit(TENANT))
    return automation_id(F.col("finding_id"), F.col("fingerprint"), scope, POLICY, F.col("tier"))


POLICY_JSON = (
    '{"auto_route_confidence":0.93,"auto_route_max_impact_cents":250000,"max_review_cases":25,'
    '"max_review_seconds":1800,"policy_id":"exception-orchestration","quick_confirm_confidence":0.95,"version":"1.0.0"}'
)
AUTOMATION_ID_SQL = f"""'automation-' || substr(sha256('{{"artifact_scope_hash":"'
  || sha256('{{"case_id":"' || case_id || '","tenant_id":"{TENANT}"}}') || '","finding_id":"' || finding_id
  || '","fingerprint":"' || fingerprint || '","policy_hash":"' || sha256('{POLICY_JSON}') || '","tier":"' || tier || '"}}'), 1, 20)"""
