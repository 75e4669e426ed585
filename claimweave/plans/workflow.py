"""Packets, hash checks, chains, the routing outbox and reviewer decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.canonical import canonical_hash
from claimweave.operators.automation import DISMISS, HUMAN_TIERS, select_for_review
from claimweave.operators.chains import append_chain
from claimweave.operators.decisions import DECISION_FIELDS, ROLE_ACTIONS, admit, admitted, decision_feedback, resolve, roles_permit
from claimweave.operators.outbox import mark_delivered, new_tasks, pending, route_tasks
from claimweave.operators.packets import (
    PERMITTED_ACTIONS,
    build_packets,
    check_findings,
    packet_digest,
    verify_chain,
    verify_hash,
)
from claimweave.operators.scale import previous_in_chain
from claimweave.plans.bindings import (
    AS_OF,
    AUTOMATION_ID_SQL,
    DECISION_COLUMNS,
    EVENT_ITEMS_SQL,
    EVENTS_SQL,
    ORDER_FINDINGS_SQL,
    POLICY,
    SELECTION_SQL,
    TENANT,
    choose,
    event_items,
    events,
    item_automation_id,
    order_findings,
    stored_items,
    table,
    text_id,
)
from claimweave.plans.graph import FINGERPRINT_SQL
from claimweave.plans.registry import query
from claimweave.session import materialize

# --- packets ---------------------------------------------------------------------


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One review packet per order."""
    cases = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_orderstatus",
        F.lit(TENANT).alias("tenant_id"),
        F.lit("ws").alias("workspace_id"),
        canonical_hash(o_custkey=F.col("o_custkey"), o_orderkey=F.col("o_orderkey"), o_orderstatus=F.col("o_orderstatus")).alias("case_hash"),
    )
    findings = order_findings(spark, sf_dir).select(
        F.col("l_orderkey").alias("o_orderkey"),
        canonical_hash(
            disposition=F.col("disposition"),
            estimated_impact_cents=F.col("estimated_impact_cents"),
            finding_id=F.col("finding_id"),
        ).alias("finding_hash"),
        (F.col("disposition") != "no_opportunity").alias("requires_human_review"),
        F.lit("bands-1").alias("grouper_version"),
    )
    return build_packets(
        cases, findings, case="o_orderkey", as_of=AS_OF, engine_version="0.7.0", rule_package_hash="0" * 64
    )


_PACKETS_SQL = f"""{ORDER_FINDINGS_SQL},
digests AS (SELECT l_orderkey, disposition <> 'no_opportunity' AS human,
    sha256('{{"disposition":"' || disposition || '","estimated_impact_cents":' || coalesce(CAST(estimated_impact_cents AS VARCHAR), 'null')
      || ',"finding_id":"' || finding_id || '"}}') AS d FROM order_findings),
summary AS (SELECT l_orderkey, count(*) AS finding_count, {FINGERPRINT_SQL} AS findings_hash, bool_or(human) AS human
  FROM digests GROUP BY l_orderkey),
joined AS (SELECT o_orderkey, o_orderstatus, coalesce(finding_count, 0) AS finding_count, findings_hash, coalesce(human, FALSE) AS human,
    sha256('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}}') AS case_hash
  FROM orders LEFT JOIN summary ON l_orderkey = o_orderkey),
recorded AS (SELECT *, sha256('{{"audit_schema_version":"1.0.0","case_hash":"' || case_hash || '","case_id":"' || o_orderkey
    || '","engine_version":"0.7.0","evaluated_at":"{AS_OF}","findings_hash":' || coalesce('"' || findings_hash || '"', 'null')
    || ',"rule_package_hash":"{"0" * 64}"}}') AS record_hash FROM joined),
packets AS (SELECT *, 'packet-' || substr(sha256('{{"case_id":"' || o_orderkey || '","record_hash":"' || record_hash
    || '","tenant_id":"{TENANT}","workspace_id":"ws"}}'), 1, 20) AS packet_id FROM recorded),
hashed AS (SELECT *, sha256('{{"case_hash":"' || case_hash || '","claim_mutation_allowed":false,"environment":"development","finding_count":' || finding_count
    || ',"findings_hash":' || coalesce('"' || findings_hash || '"', 'null')
    || ',"grouper_versions":[' || CASE WHEN finding_count > 0 THEN '"bands-1"' ELSE '' END || '],"human_review_required":' || CAST(human AS VARCHAR)
    || ',"packet_id":"' || packet_id || '","permitted_actions":["{'","'.join(PERMITTED_ACTIONS)}"],"record_hash":"' || record_hash
    || '","tenant_id":"{TENANT}","workspace_id":"ws"}}') AS packet_hash
  FROM packets)"""


@query(
    "packet_hashes",
    f"""WITH {_PACKETS_SQL} SELECT o_orderkey, packet_id, record_hash, packet_hash, finding_count, human AS human_review_required
    FROM hashed""",
)
def packet_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(spark, sf_dir).select(
        "o_orderkey", "packet_id", "record_hash", "packet_hash", "finding_count", "human_review_required"
    )


@query(
    "hash_verification",
    """SELECT o_orderkey, o_orderstatus <> 'P' AS intact FROM orders""",
)
def hash_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of open orders had their review flag flipped after hashing."""
    flipped = F.when(F.col("o_orderstatus") == "P", ~F.col("human_review_required")).otherwise(F.col("human_review_required"))
    tampered = packets(spark, sf_dir).withColumn("human_review_required", flipped)
    return verify_hash(tampered, "packet_hash", packet_digest()).select("o_orderkey", "intact")


@query(
    "packet_checks",
    f"""WITH {ORDER_FINDINGS_SQL} SELECT finding_id, concat_ws('|', CASE WHEN impact_status = 'unavailable' THEN 'impact_status_mismatch' END,
      CASE WHEN has_change AND disposition = 'no_opportunity' THEN 'change_without_review' END) AS violations FROM order_findings
    WHERE impact_status = 'unavailable' OR (has_change AND disposition = 'no_opportunity')""",
)
def packet_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings whose unavailable impact was filled in, and changes that skip review."""
    damaged = order_findings(spark, sf_dir).withColumns(
        {
            "estimated_impact_cents": F.coalesce("estimated_impact_cents", F.lit(0)),
            "requires_human_review": F.col("disposition") != "no_opportunity",
        }
    )
    checked = damaged.withColumn("violations", check_findings()).filter(F.size("violations") > 0)
    return checked.select("finding_id", F.concat_ws("|", "violations").alias("violations"))


# --- chains ----------------------------------------------------------------------


def _record_hash() -> Column:
    return canonical_hash(event_id=F.col("event_id"), event_type=F.col("event_type"))


@query(
    "chain_verify",
    f"""WITH {EVENTS_SQL}, hashed AS (SELECT *, sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}') AS h FROM ev),
    linked AS (SELECT *, lag(h) OVER (PARTITION BY user_id ORDER BY event_id) AS expected FROM hashed)
    SELECT user_id, count(*) AS records, count(*) FILTER (k = 42 AND expected IS NOT NULL) AS broken_links,
      count(*) FILTER (k = 43) AS altered_records, arg_max(h, event_id) AS last_hash,
      count(*) FILTER ((k = 42 AND expected IS NOT NULL) OR k = 43) = 0 AS intact
    FROM linked GROUP BY user_id""",
)
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log per user in which some links and some records were altered."""
    hashed = events(spark, sf_dir).select("user_id", "event_id", "event_type", "k", _record_hash().alias("record_hash"))
    log = previous_in_chain(hashed, ["user_id"], "event_id", "record_hash", "previous_hash")
    damaged = log.withColumns(
        {
            "previous_hash": F.when(F.col("k") != 42, F.col("previous_hash")),
            "event_type": F.when(F.col("k") == 43, F.lit("altered")).otherwise(F.col("event_type")),
        }
    )
    return verify_chain(damaged, ["user_id"], "event_id", "record_hash", "previous_hash", _record_hash())


CHAIN_FOLD_SQL = """list_reduce(contents, lambda acc, c: sha256('{"content_hash":"' || c || '","previous_hash":'
  || CASE WHEN acc = 'null' THEN 'null' ELSE '"' || acc || '"' END || '}'), 'null')"""


@query(
    "chain_append",
    f"""WITH contents AS (SELECT user_id, count(*) AS records,
        list(sha256('{{"event_id":' || event_id || ',"event_type":"' || event_type || '"}}') ORDER BY event_id) AS contents
      FROM events GROUP BY user_id)
    SELECT user_id, records, {CHAIN_FOLD_SQL} AS last_hash FROM contents""",
)
def chain_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest at the end of every user's chain."""
    rows = events(spark, sf_dir).select("user_id", "event_id", _record_hash().alias("content_hash"))
    chained = append_chain(rows, ["user_id"], "event_id", "content_hash")
    return chained.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("records"), F.max_by("record_hash", "event_id").alias("last_hash")
    )


# --- outbox ----------------------------------------------------------------------


def tasks_of(items: DataFrame) -> DataFrame:
    """Route tasks of classified items; the packet is the user."""
    scoped = items.withColumns(
        {
            "automation_id": item_automation_id(),
            "tenant_id": F.lit(TENANT),
            "workspace_id": F.lit("ws"),
            "packet_id": text_id("packet-", "user_id"),
        }
    )
    tasks, _ = route_tasks(scoped, AS_OF)
    return tasks


_TASK_SELECT = f"""SELECT user_id, event_id, k, finding_id, queue, recommended_action AS action, {AUTOMATION_ID_SQL} AS automation_id"""


def tasks_sql(source: str) -> str:
    return f"""keyed AS ({_TASK_SELECT} FROM {source} WHERE tier = 'auto_routed'),
tasks AS (SELECT *, 'route-' || substr(sha256('{{"action":"' || action || '","automation_id":"' || automation_id || '","finding_id":"'
    || finding_id || '","packet_id":"packet-' || user_id || '","queue":"' || queue
    || '","tenant_id":"{TENANT}","workspace_id":"ws"}}'), 1, 20) AS route_id FROM keyed)"""


@query(
    "outbox_enqueue",
    f"""WITH {EVENT_ITEMS_SQL}, {tasks_sql("items")} SELECT route_id, automation_id, finding_id, queue, action FROM tasks WHERE k >= 30""",
)
def outbox_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks not stored by an earlier run (which saw the low-numbered items) although given twice."""
    items = stored_items(spark, sf_dir)
    earlier = tasks_of(items.filter(F.col("k") < 30))
    again = tasks_of(items)
    return new_tasks(again.unionByName(again), earlier).select("route_id", "automation_id", "finding_id", "queue", "action")


@query(
    "outbox_pending",
    f"""WITH {EVENT_ITEMS_SQL}, {tasks_sql("items")} SELECT route_id, queue FROM tasks WHERE k >= 60""",
)
def outbox_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = stored_items(spark, sf_dir)
    delivered = tasks_of(items.filter(F.col("k") < 60))
    return pending(tasks_of(items), delivered).select("route_id", "queue")


@query(
    "delivery_rejects",
    f"""WITH {EVENT_ITEMS_SQL}, {tasks_sql("items")}
    SELECT route_id, event_id * 2 + 1 AS sequence, 'already_delivered' AS violation FROM tasks WHERE k < 50
    UNION ALL SELECT 'lost-' || event_id, event_id * 2, 'unknown_task' FROM items WHERE tier = 'escalated'""",
)
def delivery_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries reported twice and deliveries of tasks that were never enqueued."""
    items = stored_items(spark, sf_dir)
    tasks = tasks_of(items)
    sequence = items.select("finding_id", "event_id", "k")
    known = tasks.join(sequence, "finding_id").filter(F.col("k") < 50)
    scope = ["tenant_id", "workspace_id", "route_id"]
    twice = known.select(*scope, F.explode(F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1)).alias("sequence"))
    lost = items.filter(F.col("tier") == "escalated").select(
        F.lit(TENANT).alias("tenant_id"), F.lit("ws").alias("workspace_id"), text_id("lost-", "event_id").alias("route_id"), (F.col("event_id") * 2).alias("sequence")
    )
    _, rejects = mark_delivered(twice.unionByName(lost), tasks)
    return rejects.select("route_id", "sequence", F.col("violations")[0].alias("violation"))


# --- decisions -------------------------------------------------------------------

_ROLES = (["admin"], ["coder"], ["cdi_specialist"], ["charge_reviewer"], ["compliance_reviewer"], ["read_only", "admin"])
_EVENT_ACTION = {"purchase": "route_to_charge_review", "view": "route_to_cdi", "signup": "route_to_coding"}


def decision_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the items that decisions read, written once."""
    return materialize(event_items(spark, sf_dir, DECISION_COLUMNS).drop("fingerprint", "copies"), "items")


def listed_items(items: DataFrame) -> DataFrame:
    """Items as their plan lists them; those for people with their place in the review budget."""
    listed = items.select(
        F.col("user_id").alias("packet_id"),
        "finding_id",
        "tier",
        "reason_code",
        "priority_score",
        "estimated_review_seconds",
        "allowed_actions",
        F.col("finding_id").alias("item_finding_hash"),
        F.when(F.col("k") == 26, "x").otherwise(F.col("finding_id")).alias("packet_finding_hash"),
    )
    others = listed.filter(~F.col("tier").isin(*HUMAN_TIERS)).withColumn("selected", F.lit(None).cast("boolean"))
    chosen = select_for_review(listed, "packet_id", POLICY).unionByName(others)
    return chosen.drop("reason_code", "priority_score", "estimated_review_seconds")


def decision_requests(items: DataFrame) -> DataFrame:
    """Two attempts per event at a decision on its (consolidated) finding."""
    k, attempt = F.col("k"), F.col("attempt")
    attempts = items.withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1))))
    target = F.coalesce("duplicate_of", "finding_id")
    dismissal = k % 5 == 0
    roles = F.get(F.array(*[F.array(*[F.lit(r) for r in roles]) for roles in _ROLES]), (k % 6).cast("int"))
    return attempts.select(
        (F.col("event_id") * 2 + attempt).alias("sequence"),
        F.col("user_id").alias("packet_id"),
        F.when(k == 27, "finding-none").otherwise(target).alias("finding_id"),
        F.when(dismissal, DISMISS).otherwise(choose(F.col("event_type"), _EVENT_ACTION, "route_to_compliance")).alias("action"),
        F.when(k == 22, "bogus")
        .when(dismissal, F.when(k == 20, "evidence_confirmed").otherwise("duplicate"))
        .otherwise(F.when(k == 21, "duplicate").otherwise("evidence_confirmed"))
        .alias("reason_code"),
        F.when(k == 23, "  ").when((attempt == 1) & (k % 2 == 1), "reviewed again").otherwise("reviewed").alias("reason"),
        F.concat(F.lit("reviewer-"), (k % 3).cast("string")).alias("actor_id"),
        roles.alias("actor_roles"),
        F.when(k == 24, "other").otherwise(TENANT).alias("tenant_id"),
        F.lit("ws").alias("workspace_id"),
        F.when(k == 25, " ").otherwise(F.concat(F.lit("key-"), target, F.lit("-"), (k % 3).cast("string"))).alias("idempotency_key"),
    )


def decision_packets(items: DataFrame) -> DataFrame:
    """Packet and plan of every user; a few are damaged in one way each."""
    user = F.col("packet_id")
    everything = F.array(*[F.lit(a) for a in PERMITTED_ACTIONS])
    return items.select(F.col("user_id").alias("packet_id")).distinct().select(
        "packet_id",
        (user != 7).alias("packet_intact"),
        (user != 8).alias("plan_intact"),
        F.lit(TENANT).alias("packet_tenant"),
        F.lit("ws").alias("packet_workspace"),
        F.when(user == 9, "other").otherwise(TENANT).alias("plan_tenant"),
        F.lit("ws").alias("plan_workspace"),
        text_id("ph-", "packet_id").alias("packet_hash"),
        text_id("pl-", "packet_id").alias("plan_hash"),
        F.when(user == 10, "x").otherwise(text_id("ph-", "packet_id")).alias("plan_packet_hash"),
        (user == 11).alias("claim_mutation_allowed"),
        F.when(user == 12, F.array(F.lit(DISMISS))).otherwise(everything).alias("permitted_actions"),
    )


def admitted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The requests that pass every check, stored for the matching that follows."""
    items = decision_items(spark, sf_dir)
    passed = admitted(decision_requests(items), decision_packets(items), listed_items(items))
    return materialize(passed.select(*DECISION_FIELDS), "admitted")


_DECISIONS_SQL = (
    SELECTION_SQL
    + f""",
plan AS (SELECT i.*, coalesce(s.selected, FALSE) AS selected, i.tier IN ('quick_confirm', 'focused_review', 'escalated') AS human
  FROM items i LEFT JOIN selection s USING (finding_id)),
requests AS (SELECT event_id * 2 + attempt AS sequence, user_id AS packet_id, k, attempt,
    CASE WHEN k = 27 THEN 'finding-none' ELSE coalesce(duplicate_of, finding_id) END AS finding_id,
    CASE WHEN k % 5 = 0 THEN 'dismiss_with_reason' WHEN event_type = 'purchase' THEN 'route_to_charge_review'
      WHEN event_type = 'view' THEN 'route_to_cdi' WHEN event_type = 'signup' THEN 'route_to_coding' ELSE 'route_to_compliance' END AS action,
    CASE WHEN k = 22 THEN 'bogus' WHEN k % 5 = 0 THEN CASE WHEN k = 20 THEN 'evidence_confirmed' ELSE 'duplicate' END
      WHEN k = 21 THEN 'duplicate' ELSE 'evidence_confirmed' END AS reason_code,
    CASE WHEN k = 23 THEN '  ' WHEN attempt = 1 AND k % 2 = 1 THEN 'reviewed again' ELSE 'reviewed' END AS reason,
    'key-' || coalesce(duplicate_of, finding_id) || '-' || k % 3 AS idempotency_key
  FROM items, (VALUES (0), (1)) a(attempt)),
permitted AS (SELECT r.*, CASE k % 6 WHEN 0 THEN TRUE WHEN 5 THEN TRUE
    WHEN 1 THEN action IN ('route_to_coding', 'route_to_cdi', 'dismiss_with_reason')
    WHEN 2 THEN action IN ('route_to_cdi', 'route_to_coding', 'dismiss_with_reason')
    WHEN 3 THEN action IN ('route_to_charge_review', 'route_to_compliance', 'dismiss_with_reason')
    ELSE action IN ('route_to_compliance', 'dismiss_with_reason') END AS role_ok FROM requests r),
admission AS (SELECT r.*, CASE
    WHEN packet_id = 7 THEN 'packet_integrity' WHEN packet_id = 8 THEN 'plan_integrity' WHEN r.k = 24 THEN 'reviewer_scope'
    WHEN packet_id = 9 THEN 'plan_scope' WHEN packet_id = 10 THEN 'other_packet' WHEN packet_id = 11 THEN 'mutation_control'
    WHEN packet_id = 12 AND action <> 'dismiss_with_reason' THEN 'action_not_permitted'
    WHEN p.finding_id IS NULL THEN 'unknown_finding' WHEN p.k = 26 THEN 'finding_changed' WHEN NOT p.human THEN 'tier_not_eligible'
    WHEN NOT p.selected THEN 'not_selected'
    WHEN action NOT IN (coalesce(p.recommended_action, ''), 'dismiss_with_reason') OR p.recommended_action IS NULL THEN 'action_not_allowed'
    WHEN NOT role_ok THEN 'role' WHEN r.reason_code = 'bogus' THEN 'unknown_reason_code'
    WHEN (action = 'dismiss_with_reason') = (r.reason_code = 'evidence_confirmed') THEN 'reason_code_mismatch'
    WHEN r.k = 23 THEN 'reason_text' WHEN r.k = 25 THEN 'idempotency_key' END AS reject_reason
  FROM permitted r LEFT JOIN plan p ON p.user_id = r.packet_id AND p.finding_id = r.finding_id),
ordered AS (SELECT *, row_number() OVER (PARTITION BY packet_id, finding_id ORDER BY sequence) AS rn,
    first_value(idempotency_key) OVER w AS won_key, first_value(action || reason_code || reason || k % 3 || '/' || k % 6) OVER w AS won_fields
  FROM admission WHERE reject_reason IS NULL WINDOW w AS (PARTITION BY packet_id, finding_id ORDER BY sequence)),
statuses AS (SELECT *, CASE WHEN rn = 1 THEN 'accepted' WHEN idempotency_key = won_key THEN
    CASE WHEN action || reason_code || reason || k % 3 || '/' || k % 6 = won_fields THEN 'replayed' ELSE 'conflict' END ELSE 'terminal' END AS status FROM ordered)"""
)


@query("decision_admission", f"WITH {_DECISIONS_SQL} SELECT sequence, finding_id, reject_reason FROM admission")
def decision_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = decision_items(spark, sf_dir)
    checked = admit(decision_requests(items), decision_packets(items), listed_items(items))
    return checked.select("sequence", "finding_id", "reject_reason")


def resolved_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(admitted_requests(spark, sf_dir))


@query("terminal_decisions", f"WITH {_DECISIONS_SQL} SELECT sequence, finding_id, status FROM statuses")
def terminal_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved_decisions(spark, sf_dir).select("sequence", "finding_id", "status")


@query(
    "decision_feedback",
    f"""WITH {_DECISIONS_SQL} SELECT packet_id, count(*) AS total_decisions, count(*) FILTER (action <> 'dismiss_with_reason') AS accepted,
      count(*) FILTER (action = 'dismiss_with_reason') AS dismissed,
      count(*) FILTER (action <> 'dismiss_with_reason')::DOUBLE / count(*) AS acceptance_rate,
      count(*) FILTER (reason_code = 'evidence_confirmed') AS evidence_confirmed,
      count(*) FILTER (reason_code = 'documentation_not_supported') AS documentation_not_supported,
      count(*) FILTER (reason_code = 'duplicate') AS duplicate, count(*) FILTER (reason_code = 'already_corrected') AS already_corrected,
      count(*) FILTER (reason_code = 'other_governed') AS other_governed
    FROM statuses WHERE status = 'accepted' GROUP BY packet_id""",
)
def decision_feedback_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = resolved_decisions(spark, sf_dir).filter(F.col("status") == "accepted")
    return decision_feedback(accepted, ["packet_id"])


_PERMITTED_SQL = " OR ".join(
    f"(role = '{role}' AND action IN ({', '.join(repr(a) for a in actions)}))" for role, actions in ROLE_ACTIONS.items() if actions
)


@query(
    "role_actions",
    f"""WITH {EVENTS_SQL}, asked AS (SELECT event_id, CASE k % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'coder' WHEN 2 THEN 'cdi_specialist'
        WHEN 3 THEN 'charge_reviewer' WHEN 4 THEN 'compliance_reviewer' ELSE 'read_only' END AS role,
      CASE event_type WHEN 'purchase' THEN 'route_to_charge_review' WHEN 'view' THEN 'route_to_cdi' WHEN 'signup' THEN 'route_to_coding'
        WHEN 'click' THEN 'route_to_compliance' ELSE 'dismiss_with_reason' END AS action FROM ev)
    SELECT event_id, role, action, {_PERMITTED_SQL} AS permitted FROM asked""",
)
def role_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a role may perform the action it asks for."""
    names = F.array(*[F.lit(name) for name in ("admin", "coder", "cdi_specialist", "charge_reviewer", "compliance_reviewer", "read_only")])
    asked = events(spark, sf_dir).select(
        "event_id",
        F.get(names, (F.col("k") % 6).cast("int")).alias("role"),
        choose(F.col("event_type"), {**_EVENT_ACTION, "click": "route_to_compliance"}, DISMISS).alias("action"),
    )
    return asked.withColumn("permitted", roles_permit(F.array("role"), F.col("action")))
