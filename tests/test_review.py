import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from claimweave.operators.automation import Policy, classify, consolidate, draft, plan_metrics, select_for_review, semantic_fingerprint
from claimweave.operators.metrics import evaluate
from claimweave.operators.rules import evaluate_rules, nest_lineage, reproduction_findings

CLASSES = {"Part": None, "Monitor": "Part", "Pump": "Part", "Syringe": "Pump"}


def then(disposition, change):
    return {"disposition": disposition, "requires_human_review": True, "proposed_change": change, "rationale": "Read the log."}


PUMPS = {"subject_types": ["Pump"], "include_subtypes": True}
PACKAGE = {
    "package_id": "pump-rules",
    "version": "0.4.0",
    "status": "approved-for-demo",
    "rules": [
        {
            "rule_id": "alarms-while-stopped",
            "title": "A stopped pump raised alarms",
            "applies_to": PUMPS,
            "when": {"not": {"any": [{"field": "attributes.alarms", "op": "lte", "value": 4}, {"field": "confidence", "op": "lte", "value": 0.9}]}},
            "case_conditions": [{"not": {"field": "claim.charges", "op": "contains", "value": "PUMP-DAY"}}, {"field": "metadata.ward", "op": "eq", "value": "W2"}],
            "then": then("coding_review", {"remove_diagnoses": ["A41.9"], "add_diagnoses": ["L89.154"]}),
        },
        {
            "rule_id": "log-lacks-rate",
            "title": "The pump log names no rate",
            "applies_to": PUMPS,
            "when": {"all": [{"field": "attributes.rate", "op": "exists", "value": False}, {"field": "status", "op": "ne", "value": "historical"}]},
            "then": then("cdi_query", {}),
        },
    ],
}


def case_tables(spark, *, alarms=9, rate=3, confidence=0.98, subject="u1", diagnoses=("A41.9",), charges=("ROOM-BOARD",), drg="DEMO-292", allowed=1_000_000):
    body = json.dumps({"alarms": alarms} | ({} if rate is None else {"rate": rate}))
    assertions = spark.createDataFrame(
        [("C1", "AS-001", subject, "pump", "present", "explicit", confidence, body, ["EV-1"], [])],
        "case_id string, assertion_id string, subject_id string, concept string, status string, documentation_status string, "
        "confidence double, attributes string, evidence_ids array<string>, contradicting_evidence_ids array<string>",
    ).withColumn("attributes", F.parse_json("attributes"))
    entities = spark.createDataFrame(
        [("C1", "u1", "Syringe", "u", "{}"), ("C1", "p1", "Monitor", "p", "{}")],
        "case_id string, entity_id string, entity_type string, label string, properties string",
    ).withColumn("properties", F.parse_json("properties"))
    cases = spark.createDataFrame(
        [("C1", list(diagnoses), [], list(charges), drg, allowed, '{"ward": "W2"}')],
        "case_id string, diagnoses array<string>, procedures array<string>, charges array<string>, drg string, "
        "allowed_amount_cents bigint, metadata string",
    ).withColumn("metadata", F.parse_json("metadata"))
    return assertions, entities, cases


def findings_of(spark, package=PACKAGE, **changes):
    findings, _ = evaluate_rules(*case_tables(spark, **changes), package, CLASSES)
    return findings.collect()


def test_a_change_is_found_and_priced(spark):
    (row,) = findings_of(spark)
    assert (row.rule_id, row.current_drg, row.simulated_drg, row.estimated_impact_cents) == ("alarms-while-stopped", "DEMO-292", "DEMO-290", 842_000)
    assert row.finding_id.startswith("finding-") and len(row.finding_id) == len("finding-") + 16
    assert row.proposed_change == {"add_diagnoses": ["L89.154"], "remove_diagnoses": ["A41.9"]}


def test_case_conditions_leave_only_the_reproduction_finding(spark):
    assert findings_of(spark, charges=("PUMP-DAY",)) == [] == findings_of(spark, alarms=4)
    (row,) = reproduction_findings(case_tables(spark, diagnoses=("A41.9", "L89.154"))[2]).collect()
    assert (row.rule_id, row.current_drg, row.estimated_impact_cents) == ("SYSTEM-DRG-REPRODUCTION", "DEMO-290", 842_000)


def test_unknown_payment_gives_no_impact(spark):
    (row,) = reproduction_findings(case_tables(spark, drg="DEMO-290", allowed=None)[2]).collect()
    assert row.estimated_impact_cents is None and row.impact_status == "unavailable"


def test_an_absent_attribute_asks_the_clinician(spark):
    (row,) = findings_of(spark, rate=None, confidence=0.82)
    assert (row.rule_id, row.disposition, row.estimated_impact_cents) == ("log-lacks-rate", "cdi_query", 0)


def test_scope(spark):
    assert findings_of(spark, subject="p1") == []
    exact = [{**known, "applies_to": {**PUMPS, "include_subtypes": False}} for known in PACKAGE["rules"]]
    assert findings_of(spark, {**PACKAGE, "rules": exact}) == []
    with pytest.raises(ValueError, match="unknown classes"):
        bad = [{**PACKAGE["rules"][0], "applies_to": {"subject_types": ["Nothing"], "include_subtypes": True}}]
        findings_of(spark, {**PACKAGE, "rules": bad})
    with pytest.raises(ValueError, match="not executable"):
        findings_of(spark, {**PACKAGE, "status": "draft"})


def test_lineage_is_ordered_and_bounded(spark):
    assertions, entities, cases = case_tables(spark)
    more = assertions.withColumns({"assertion_id": F.lit("AS-000"), "evidence_ids": F.array(F.lit("EV-0"), F.lit("EV-1"))})
    stronger = assertions.withColumns({"assertion_id": F.lit("AS-009"), "confidence": F.lit(0.99), "evidence_ids": F.array(F.lit("EV-9"))})
    findings, lineage = evaluate_rules(assertions.unionByName(more).unionByName(stronger), entities, cases, PACKAGE, CLASSES)
    nested, rejects = nest_lineage(findings, lineage)
    (row,) = nested.collect()
    assert row.assertion_ids == ["AS-009", "AS-000", "AS-001"]
    assert row.evidence_ids == ["EV-9", "EV-0", "EV-1"]
    assert row.subject_ids == ["u1"] and row.contradicting_evidence_ids == []
    assert row.confidence == 0.99 and rejects.count() == 0
    assert nest_lineage(findings, lineage, max_items=2)[1].head().violations == ["lineage_over_budget"]


BASE = {
    "plan": "P",
    "finding_id": "f1",
    "disposition": "coding_review",
    "has_change": True,
    "contradicted": False,
    "confidence": 0.98,
    "current_drg": "DEMO-292",
    "simulated_drg": "DEMO-290",
    "estimated_impact_cents": 842_000,
    "impact_status": "estimated",
}
SCHEMA = (
    "plan string, finding_id string, disposition string, has_change boolean, contradicted boolean, confidence double, "
    "current_drg string, simulated_drg string, estimated_impact_cents bigint, impact_status string"
)


def classified(spark, *rows, policy=Policy()):
    data = [tuple({**BASE, **row}.values()) for row in rows]
    return classify(spark.createDataFrame(data, SCHEMA), policy)


@pytest.mark.parametrize(
    "change, tier, reason, queue, seconds",
    [
        ({}, "quick_confirm", "material_drg_change", "coding", 30),
        ({"contradicted": True}, "escalated", "contradictory_evidence", "coding", 240),
        ({"contradicted": True, "disposition": "no_opportunity"}, "escalated", "contradictory_evidence", "compliance", 240),
        ({"estimated_impact_cents": -1}, "escalated", "compliance_sensitive", "compliance", 240),
        ({"estimated_impact_cents": None, "impact_status": "unavailable"}, "escalated", "unknown_impact", "coding", 240),
        ({"estimated_impact_cents": None, "impact_status": "not_applicable"}, "escalated", "unknown_impact", "coding", 240),
        ({"disposition": "no_opportunity", "has_change": False}, "suppressed", "no_actionable_change", "none", 0),
        ({"disposition": "no_opportunity"}, "escalated", "inconsistent_finding", "compliance", 240),
        ({"disposition": "insufficient_evidence"}, "needs_enrichment", "insufficient_evidence", "none", 0),
        ({"disposition": "cdi_query"}, "focused_review", "documentation_query", "cdi", 180),
        ({"simulated_drg": "DEMO-292", "estimated_impact_cents": 100_000}, "auto_routed", "routine_operational_route", "coding", 0),
        ({"confidence": 0.5}, "focused_review", "lower_confidence", "coding", 180),
    ],
)
def test_tier_cascade(spark, change, tier, reason, queue, seconds):
    row = classified(spark, change).head()
    assert (row.tier, row.reason_code, row.queue, row.estimated_review_seconds) == (tier, reason, queue, seconds)


def test_priority_and_actions(spark):
    row = classified(spark, {}).head()
    assert row.priority_score == 30_000 + 9_800 + 8_420
    assert row.allowed_actions == ["route_to_coding", "dismiss_with_reason"]
    note = classified(spark, {"disposition": "cdi_query"}).select(
        draft(F.col("tier"), F.col("disposition"), F.lit("why"), F.col("recommended_action")).alias("d")
    )
    assert note.head().d.kind == "cdi_query"


def test_fingerprint_changes_with_one_cent(spark):
    df = spark.createDataFrame(
        [(i, cents) for i, cents in enumerate([842_000, 842_000, 842_001])], "finding_id int, estimated_impact_cents bigint"
    )
    fixed = {name: F.lit("x") for name in ("current_drg", "disposition", "grouper_version", "impact_status", "rationale", "rule_id",
                                           "rule_package_id", "rule_package_version", "simulated_drg", "title")}
    arrays = {name: F.array(F.lit("b"), F.lit("a")) for name in ("contradicting_evidence_ids", "evidence_ids", "subject_ids")}
    full = df.withColumns({**fixed, **arrays, "confidence": F.lit(0.9), "proposed_change": F.create_map(F.lit("k"), F.array(F.lit("v")))})
    a, b, c = [r[0] for r in full.orderBy("finding_id").select(semantic_fingerprint(F.lit("s"))).collect()]
    assert a == b != c


def test_duplicates_are_consolidated_in_any_order(spark):
    rows = [{"finding_id": f} for f in ("b", "a", "c")]
    for order in (rows, rows[::-1]):
        items = consolidate(classified(spark, *order).withColumn("fingerprint", F.lit("same")), ["plan", "fingerprint"])
        found = {r.finding_id: r for r in items.collect()}
        assert found["a"].duplicate_of is None and found["a"].copies == 3
        assert found["b"].duplicate_of == found["c"].duplicate_of == "a"
        assert found["b"].tier == "suppressed" and found["b"].reason_code == "exact_duplicate"


def test_budget_defers_and_exempt_items_ignore_it(spark):
    policy = replace(Policy(), max_review_cases=1, max_review_seconds=30)
    items = consolidate(classified(spark, {}, {"finding_id": "f2", "estimated_impact_cents": 800_000}).withColumn("fingerprint", F.col("finding_id")), ["plan", "fingerprint"])
    chosen = select_for_review(items, "plan", policy)
    assert {r.finding_id: r.selected for r in chosen.collect()} == {"f1": True, "f2": False}
    metrics = plan_metrics(items, chosen, "plan").head()
    assert (metrics.review_now, metrics.deferred, metrics.estimated_review_seconds, metrics.quick_confirm, metrics.escalated) == (1, 1, 30, 2, 0)
    exempt = classified(spark, {"contradicted": True}, {"finding_id": "f2", "contradicted": True})
    assert all(r.selected for r in select_for_review(exempt, "plan", policy).collect())


def brute_force_budget(items, policy):
    taken, seconds, chosen = 0, 0, set()
    for item in sorted(items, key=lambda i: (-i["priority_score"], i["finding_id"])):
        exempt = item["reason_code"] in ("contradictory_evidence", "compliance_sensitive", "unknown_impact")
        if exempt or (taken < policy.max_review_cases and seconds + item["estimated_review_seconds"] <= policy.max_review_seconds):
            taken, seconds = taken + 1, seconds + item["estimated_review_seconds"]
            chosen.add(item["finding_id"])
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_budget_equals_a_walk_over_the_whole_plan(spark, seed):
    rng = random.Random(seed)
    kinds = [("quick_confirm", "material_drg_change", 30), ("focused_review", "lower_confidence", 180),
             ("escalated", "inconsistent_finding", 240), ("escalated", "unknown_impact", 240)]
    weights = [[6, 4, 2, 0.2], [1, 1, 1, 0], [3, 3, 3, 1], [10, 1, 1, 0.05]][seed]
    rows = []
    for i in range(3_000):
        tier, reason, seconds = rng.choices(kinds, weights)[0]
        plan = "hot" if rng.random() < 0.6 else f"p{rng.randrange(20)}"
        rows.append((plan, f"f{i:05d}", tier, reason, rng.randrange(40), seconds))
    policy = Policy(max_review_cases=rng.choice([3, 25]), max_review_seconds=rng.choice([500, 1_800]))
    df = spark.createDataFrame(rows, "plan string, finding_id string, tier string, reason_code string, priority_score bigint, estimated_review_seconds bigint")
    got = {r.finding_id for r in select_for_review(df, "plan", policy).filter("selected").collect()}
    want = set()
    for plan in {r[0] for r in rows}:
        want |= brute_force_budget([dict(zip(df.columns, r)) for r in rows if r[0] == plan], policy)
    assert got == want


def test_evaluation_counts(spark):
    labels = spark.createDataFrame([("E1", "missed_charge", "97597", True), ("E1", "missed_charge", "x", False)], "e string, c string, k string, valid boolean")
    predictions = spark.createDataFrame([("E1", "missed_charge", "97597"), ("E1", "missed_charge", "other")], "e string, c string, k string")
    row = evaluate(labels, predictions, ["e", "c", "k"]).head()
    assert (row.true_positives, row.false_positives, row.false_negatives, row.precision, row.recall) == (1, 1, 0, 0.5, 1.0)
    empty = evaluate(labels.limit(0), predictions.limit(0), ["e", "c", "k"]).head()
    assert (empty.precision, empty.recall) == (1.0, 1.0)
