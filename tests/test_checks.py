import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from claimweave.functions.codes import group_and_price
from claimweave.operators.attach import attach_children, attach_claims, collect_codes, dedup_or_conflict
from claimweave.operators.automation import check_plan
from claimweave.operators.checks import budget_usage, check_assertions, check_budget, check_grounding, check_interval, matching_definitions, unknown_names
from claimweave.operators.financial import check_denials, check_lines, check_remittances, denied_amounts
from claimweave.operators.governance import AccessPolicy, RetentionPolicy, access_violations, promotable, retention_violations
from claimweave.operators.investigate import promote, synthesize, validate_hypotheses
from claimweave.operators.metrics import automation_summary, display_amount, display_percent, search_queue, unresolved
from claimweave.operators.ontology import Ontology, check_definition, check_entities, check_relations, class_closure, crosswalk, merge_graph, reach_root
from claimweave.operators.packets import check_findings, check_identifiers
from claimweave.plans import QUERIES

CLASS = "class_id string, parent string, abstract boolean, value_set string"
RELATION = "relation_id string, domain array<string>, range array<string>, requires_evidence boolean"


@pytest.fixture(scope="module")
def ontology(spark):
    classes = spark.createDataFrame(
        [("Entity", None, True, None), ("Patient", "Entity", False, None), ("Wound", "Entity", False, None),
         ("PressureInjury", "Wound", False, None), ("Stage", "Entity", False, "stages")],
        CLASS,
    )
    relations = spark.createDataFrame([("hasWound", ["Patient"], ["Wound"], True)], RELATION)
    return Ontology(classes, relations, spark.createDataFrame([("stages", "4")], "value_set string, value string"))


def test_closure_is_reflexive_and_transitive(ontology):
    got = {(r.class_id, r.ancestor): r.depth for r in class_closure(ontology.classes).collect()}
    assert got[("PressureInjury", "PressureInjury")] == 0 and got[("PressureInjury", "Entity")] == 2
    assert ("Wound", "PressureInjury") not in got


def test_definition_faults_and_cycles(spark, ontology):
    assert check_definition(ontology).count() == 0
    rows = [("a", "b", False, None), ("b", "c", False, None), ("c", "a", False, None), ("d", "a", False, "none"), ("e", "zzz", False, None), ("f", "e", False, None)]
    bad = Ontology(spark.createDataFrame(rows, CLASS), spark.createDataFrame([("r", ["a"], ["q"], False)], RELATION), ontology.value_sets)
    assert {(r.item, r.violation) for r in check_definition(bad).collect()} == {
        ("a", "hierarchy_cycle"), ("b", "hierarchy_cycle"), ("c", "hierarchy_cycle"), ("d", "hierarchy_cycle"),
        ("d", "unknown_value_set"), ("e", "unknown_parent"), ("r", "unknown_class"),
    }
    deep = spark.createDataFrame([(f"n{i}", f"n{i - 1}" if i else None, False, None) for i in range(200)], CLASS)
    assert reach_root(deep)[1].count() == 0


def test_graph_checks(spark, ontology):
    entities = spark.createDataFrame(
        [("C", "p", "Patient", None), ("C", "w", "PressureInjury", None), ("C", "s", "Stage", "5"), ("C", "e", "Entity", None), ("C", "x", "Alien", None)],
        "case_id string, entity_id string, entity_type string, value string",
    )
    bad = {r.entity_id: r.violations for r in check_entities(entities, ontology)[1].collect()}
    assert bad == {"s": ["value_not_in_set"], "e": ["abstract_class"], "x": ["unknown_class"]}
    relations = spark.createDataFrame(
        [("C", "ok", "hasWound", "p", "w", ["E1"], []), ("C", "back", "hasWound", "w", "p", ["E1"], []), ("C", "bare", "hasWound", "p", "w", [], []),
         ("C", "both", "hasWound", "p", "w", ["E1"], ["E1"]), ("C", "gone", "hasWound", "p", "w", ["E9"], []), ("C", "odd", "likes", "p", "q", ["E1"], [])],
        "case_id string, relation_id string, predicate string, source_id string, target_id string, evidence_ids array<string>, contradicting_evidence_ids array<string>",
    )
    evidence = spark.createDataFrame([("C", "E1")], "case_id string, evidence_id string")
    ok, rejects = check_relations(relations, entities, evidence, ontology, class_closure(ontology.classes))
    assert [r.relation_id for r in ok.collect()] == ["ok"]
    assert {r.relation_id: r.violations for r in rejects.collect()} == {
        "back": ["invalid_source", "invalid_target"], "bare": ["requires_evidence"], "both": ["overlap"],
        "gone": ["unknown_evidence"], "odd": ["unknown_endpoint", "unknown_predicate"],
    }


def test_merge_and_crosswalk(spark):
    a = spark.createDataFrame([("C", "1"), ("C", "2")], "case_id string, entity_id string")
    ok, collisions = merge_graph([a, a.filter("entity_id = '2'")], ["case_id", "entity_id"])
    assert [r.entity_id for r in ok.collect()] == ["1"] and collisions.head().copies == 2
    codes = spark.createDataFrame([("s", "A"), ("s", "B")], "system string, code string")
    mapping = spark.createDataFrame([("s", "A", "t", "X", "equal", "1")], "system string, code string, target_system string, target_code string, equivalence string, mapping_version string")
    good, bad = crosswalk(codes, mapping, "t")
    assert good.head().target_code == "X" and bad.head().violations == ["no_governed_mapping"]
    assert crosswalk(codes, mapping, "other")[0].count() == 0


def test_grounding(spark):
    documents = spark.createDataFrame([("E", "D1", "physician", "t1", "Stage 4 pressure injury. Present.")], "encounter_id string, document_id string, author_role string, recorded_at string, text string")
    rows = [("E", "ok", "D1", "physician", "t1", "pressure injury"), ("E", "case", "D1", "physician", "t1", "Pressure"), ("E", "role", "D1", "nurse", "t1", "Stage 4"),
            ("E", "gone", "D9", "physician", "t1", "x"), ("F", "other", "D1", "physician", "t1", "Stage 4")]
    evidence = spark.createDataFrame(rows, "encounter_id string, evidence_id string, document_id string, author_role string, recorded_at string, text string")
    ok, rejects = check_grounding(evidence, documents, ["encounter_id"])
    assert [r.evidence_id for r in ok.collect()] == ["ok"]
    assert {r.evidence_id: r.violations for r in rejects.collect()} == {
        "case": ["not_an_excerpt"], "role": ["metadata_changed"], "gone": ["unknown_document"], "other": ["unknown_document"]}


def test_assertion_lineage_partitions_the_input(spark):
    rows = [("C", "a1", "s", ["E1"], []), ("C", "a2", "zzz", ["E1"], []), ("C", "a3", "s", [], []), ("C", "a4", "s", ["E1"], ["E1"]), ("C", "a5", "s", ["E7"], []), ("C", "a6", "s", ["E1"], []), ("C", "a6", "s", ["E1"], [])]
    assertions = spark.createDataFrame(rows, "case_id string, assertion_id string, subject_id string, evidence_ids array<string>, contradicting_evidence_ids array<string>")
    entities = spark.createDataFrame([("C", "s")], "case_id string, entity_id string")
    evidence = spark.createDataFrame([("C", "E1")], "case_id string, evidence_id string")
    ok, rejects = check_assertions(assertions, entities, evidence)
    assert [r.assertion_id for r in ok.collect()] == ["a1"] and ok.count() + rejects.count() == len(rows)
    assert {r.assertion_id: r.violations[0] for r in rejects.collect()} == {
        "a2": "unknown_subject", "a3": "no_evidence", "a4": "overlap", "a5": "unknown_evidence", "a6": "duplicate_id"}


def test_budgets_intervals_names_and_gates(spark):
    docs = spark.createDataFrame([("b1", "x" * 5), ("b1", "x"), ("b2", "x")], "bundle string, text string")
    _, rejects = check_budget(budget_usage(docs, ["bundle"], "text"), {"max_items": 1, "max_characters": 4, "max_total_characters": 5})
    assert rejects.head().violations == ["max_items", "max_characters", "max_total_characters"]
    stays = spark.createDataFrame([("2026-06-01T10:00:00+02:00", "2026-06-01T08:30:00+00:00"), ("2026-06-01T10:00:00+00:00", "2026-06-01T11:00:00+02:00")], "a string, b string")
    assert check_interval(stays, F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))[1].count() == 1
    assert stays.select(unknown_names(F.array(F.lit("z"), F.lit("b")), F.array(F.lit("b")))).head()[0] == ["z"]
    runs = spark.createDataFrame([("o", "1", "d", "approved"), ("o", "1", "x", "approved"), ("o", "2", "d", "draft")], "ontology_id string, version string, digest string, status string")
    definitions = spark.createDataFrame([("o", "1", "d", "approved")], "ontology_id string, version string, digest string, status string")
    ok, bad = matching_definitions(runs, definitions)
    assert ok.count() == 1 and sorted(v for r in bad.collect() for v in r.violations) == ["digest_mismatch", "not_executable", "unknown_definition"]


def test_attachments(spark):
    parents = spark.createDataFrame([("E1",), ("E2",), ("E3",)], "e string")
    notes = spark.createDataFrame([("E1", "d1"), ("E1", "d1"), ("E2", "d1"), ("E9", "d1")], "e string, d string")
    ok, rejects = attach_children(parents, notes, "e", "d")
    assert ok.collect() == [("E2", "d1")] and sorted(r.violations[0] for r in rejects.collect()) == ["duplicate_id", "duplicate_id", "unknown_parent"]
    claims = spark.createDataFrame([("E1", 1), ("E2", 2), ("E2", 3)], "e string, amount int")
    good, bad = attach_claims(parents, claims, "e")
    assert good.collect() == [("E1", 1)]
    assert {r.e: r.violations for r in bad.collect()} == {"E2": ["multiple_claims"], "E3": ["missing_claim"]}
    codes = spark.createDataFrame([("E1", "B", 1), ("E1", "A", 2), ("E1", "B", 3)], "e string, code string, n long")
    assert collect_codes(codes.repartition(3), "e", "code", "n", "codes").head().codes == ["B", "A"]
    rows = spark.createDataFrame([("k1", "x", None)] * 50 + [("k2", "x", "1"), ("k2", "x", "2"), ("k3", None, "1"), ("k3", "y", "1")], "k string, a string, b string")
    kept, conflicts = dedup_or_conflict(rows.repartition(5), ["k"])
    assert kept.collect() == [("k1", "x", None)] and sorted(r.k for r in conflicts.collect()) == ["k2", "k3"]


def test_money(spark):
    lines = spark.createDataFrame([("C", "L1", "97597", 1, 10_000, None, "submitted"), ("C", "L2", "x", 0, 5, None, "s"), ("C", "L3", "x", 1, 5, -1, "s")],
                                  "claim string, line_id string, code string, units long, charged_amount_cents long, allowed_amount_cents long, status string")
    assert {r.line_id: r.violations for r in check_lines(lines, "claim")[1].collect()} == {"L2": ["units_not_positive"], "L3": ["negative_allowed"]}
    denials = spark.createDataFrame([("C", "D1", ["L1"], 4_000), ("C", "D2", ["L9"], None), ("C", "D3", ["L1", "L1"], 1)], "claim string, denial_id string, line_ids array<string>, amount_cents long")
    ok, bad = check_denials(denials, lines, "claim")
    assert denied_amounts(ok, "claim").head().denied_amount_cents == 4_000
    assert {r.denial_id: r.violations for r in bad.collect()} == {"D2": ["unknown_line"], "D3": ["duplicate_lines"]}
    remits = spark.createDataFrame([(1, 0, ["a", "zzz"]), (-1, 0, [])], "paid_amount_cents long, adjustment_amount_cents long, denial_ids array<string>")
    assert check_remittances(remits)[1].count() == 1


HYPOTHESIS = (
    "packet_id string, encounter_id string, hypothesis_id string, input_order long, category string, hypothesis string, evidence_ids array<string>, "
    "contradicting_evidence_ids array<string>, assertion_ids array<string>, candidate_codes array<string>, missing_information array<string>, "
    "confidence_evidence double, confidence_semantic double, confidence_financial double, materiality_cents long"
)


def hypothesis(n, category="missed_diagnosis", codes=("L89.154",), evidence=("E1",), missing=(), financial=0.9, encounter="ENC"):
    return ("P", encounter, f"H{n}", n, category, "Text.", list(evidence), [], [], list(codes), list(missing), 0.8, 0.7, financial, 1)


def test_promotion_and_validation(spark):
    rows = [hypothesis(1), hypothesis(2, "documentation_gap", (), missing=("a", "b")), hypothesis(3, evidence=("E9",)), hypothesis(4, "drg_discrepancy"), hypothesis(5, encounter="X"),
            hypothesis(6, "payment_variance", (), ())]
    frame = spark.createDataFrame(rows, HYPOTHESIS)
    packets = spark.createDataFrame([("P", "ENC", None, ["A41.9"], [], [])], "packet_id string, packet_encounter_id string, drg string, diagnoses array<string>, procedures array<string>, charges array<string>")
    evidence = spark.createDataFrame([("P", "E1")], "packet_id string, evidence_id string")
    assertions = spark.createDataFrame([("P", "A1")], "packet_id string, assertion_id string")
    ok, rejects = validate_hypotheses(frame, packets, evidence, assertions, extra=[("too_late", lambda: F.col("input_order") > 5)])
    assert {r.hypothesis_id: r.violations for r in rejects.collect()} == {
        "H3": ["unknown_evidence"], "H4": ["drg_discrepancy_without_drg"], "H5": ["encounter_mismatch"], "H6": ["too_late"]}
    found = {r.hypothesis_id: r for r in promote(ok, packets, lambda claim: group_and_price(claim["diagnoses"])).collect()}
    assert (found["H1"].estimated_impact_cents, found["H1"].confidence, found["H1"].simulated_drg) == (842_000, 0.7, "DEMO-290")
    assert (found["H2"].estimated_impact_cents, found["H2"].impact_status, found["H2"].disposition) == (None, "not_applicable", "cdi_query")
    assert found["H2"].rationale == "Text. Missing information: a; b"


def test_synthesis_keeps_the_best_duplicate(spark):
    frame = spark.createDataFrame([hypothesis(1, financial=0.4), hypothesis(2, financial=0.9), hypothesis(3, codes=("X",)), hypothesis(4, codes=("Y",))], HYPOTHESIS)
    critiques = spark.createDataFrame([("P", "H1", True), ("P", "H2", True), ("P", "H3", False), ("Q", "H3", True)], "packet_id string, hypothesis_id string, supported boolean")
    assert [r.hypothesis_id for r in synthesize(frame, critiques).collect()] == ["H2"]


def test_governance(spark):
    artifacts = spark.createDataFrame([(1, True), (2, False)], "id int, contains_raw_input boolean")
    assert retention_violations(artifacts).count() == 1
    assert retention_violations(artifacts, RetentionPolicy(raw_input_retained=True)).count() == 0
    rows = [("ok", True, True, False, 10), ("evil", False, True, False, 10), ("ok", False, True, False, 10), ("ok", True, True, True, 10), ("ok", True, True, False, 300_000)]
    requests = spark.createDataFrame(rows, "provider string, deidentified boolean, zero_retention boolean, telemetry_enabled boolean, input_characters long")
    assert sorted(r.reason for r in access_violations(requests, AccessPolicy(["ok"])).collect()) == ["input_too_large", "not_deidentified", "provider_not_allowlisted", "telemetry_enabled"]
    proposals = spark.createDataFrame([("a", 0.95, "r"), (" ", 0.99, "r"), ("a", 0.94, "r"), ("a", 0.99, "")], "reviewer_id string, evaluation_precision double, proposed_rule string")
    ok, refused = promotable(proposals)
    assert ok.count() == 1 and sorted(r.reason for r in refused.collect()) == ["no_reviewer", "no_rule", "precision_too_low"]
    ids = spark.createDataFrame([("tenant-a",), ("bad tenant",), (None,)], "tenant_id string")
    assert check_identifiers(ids, ["tenant_id"])[1].count() == 2


def test_finding_and_plan_checks(spark):
    findings = spark.createDataFrame([("estimated", None, True, True), ("unavailable", 5, False, True), ("estimated", 5, True, False), ("not_applicable", None, False, False)],
                                     "impact_status string, estimated_impact_cents long, has_change boolean, requires_human_review boolean")
    got = [r[0] for r in findings.select(check_findings()).collect()]
    assert got == [["impact_status_mismatch"], ["impact_status_mismatch"], ["change_without_review"], []]
    items = spark.createDataFrame([("P", "f1", "suppressed", "none", None, ["x"], None), ("P", "f2", "focused_review", "cdi", "route_to_cdi", ["dismiss"], None), ("P", "f3", "auto_routed", "none", "route_to_cdi", [], "f9")],
                                  "plan string, finding_id string, tier string, queue string, recommended_action string, allowed_actions array<string>, duplicate_of string")
    chosen = spark.createDataFrame([("P", "f2", True), ("P", "f2", False), ("P", "zz", True)], "plan string, finding_id string, selected boolean")
    assert {(r.finding_id, r.violation) for r in check_plan(items, chosen, "plan").collect()} == {
        ("f1", "actions_on_automatic_tier"), ("f2", "human_tier_without_action"), ("f2", "now_and_deferred"), ("f3", "route_without_queue"), ("f3", "unknown_primary"), ("zz", "unknown_item")}


def test_queue_and_summary(spark):
    items = spark.createDataFrame([("f1", "Omitted Wound", "human_exception", "focused_review", "E1"), ("f2", "wound care", "human_exception", "escalated", "E1"), ("f3", "wound", "auto_routed", "auto_routed", "E2")],
                                  "id string, title string, outcome string, tier string, e string")
    decided = spark.createDataFrame([("f2",)], "id string")
    find = lambda outcome, text: sorted(r.id for r in search_queue(items, decided, outcome=outcome, query=text, fields=["title", "e"], key="id").collect())
    assert find("human_exception", "WOUND") == ["f1"] and find("all", "wound") == ["f1", "f2", "f3"] and find("auto_routed", "e2") == ["f3"]
    assert sorted(r.id for r in unresolved(items, decided, "id").collect()) == ["f1", "f3"]
    encounters = spark.createDataFrame([("E1",), ("E2",), ("E3",), ("E4",)], "e string")
    row = automation_summary(encounters, items, "e").head()
    assert (row.scanned, row.clean, row.auto_routed, row.suppressed, row.human, row.no_touch_percent) == (4, 2, 1, 0, 1, 75.0)
    shown = encounters.limit(1).select(display_amount(F.lit(842_000)), display_percent(F.lit(0.985))).head()
    assert tuple(shown) == (8_420.0, 99)


def test_contract(spark):
    queries, twins = contract.queries(), contract.oracle_sql()
    assert set(twins) <= set(queries) and set(QUERIES) - set(twins) == {"folder_inventory"}
    row = contract.entry(spark).groupBy().count().head()
    assert row[0] == 1_841
    found = queries["omitted_charge_findings"](spark, "/root/testdata/sf0.001").agg(
        F.countDistinct("l_orderkey"), F.sum(F.col("simulated_cents") - F.col("baseline_cents")), F.count_if("contradicted")
    )
    assert tuple(found.head()) == (1_116, 11_411_440_160, 675)
