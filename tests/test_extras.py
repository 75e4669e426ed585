import pytest

from claimweave.operators.checks import check_locators
from claimweave.operators.ontology import structural_rows
from claimweave.operators.profile import approximate_profile
from claimweave.operators.rules import rule_package_gate


def test_approximate_profile_counts_missing_cells(spark):
    df = spark.createDataFrame([(str(i % 50), "" if i % 4 else "x") for i in range(1_000)], "a string, b string")
    got = {r.column_name: (r.missing, r.distinct_values) for r in approximate_profile(df, "t", ["a", "b"]).collect()}
    assert got["b"] == (750, 1) and got["a"][0] == 0 and 45 <= got["a"][1] <= 55


def test_template_rows_are_repeated_for_every_case(spark):
    cases = spark.createDataFrame([("C1",), ("C2",)], "case_id string")
    rows = structural_rows(cases, [{"entity_id": "root:patient", "entity_type": "Patient"}, {"entity_id": "root:claim", "entity_type": "Claim"}])
    assert sorted((r.case_id, r.entity_id) for r in rows.collect()) == [
        ("C1", "root:claim"), ("C1", "root:patient"), ("C2", "root:claim"), ("C2", "root:patient")]


def test_packages_bound_to_another_definition_are_refused():
    rule_package_gate({"ontology": {"digest": "d"}}, "d")
    with pytest.raises(ValueError, match="incompatible"):
        rule_package_gate({"ontology": {"digest": "d"}}, "other")


def test_locators_need_matching_provenance(spark):
    located = "case_id string, evidence_id string, source_locator struct<adapter_id: string, adapter_version: string>"
    evidence = spark.createDataFrame([("C", "ok", ("a", "1")), ("C", "old", ("a", "0")), ("D", "none", ("a", "1")), ("D", "free", None)], located)
    provenance = spark.createDataFrame([("C", "a", "1")], "case_id string, adapter_id string, adapter_version string")
    ok, rejects = check_locators(evidence, provenance, ["case_id"])
    assert sorted(r.evidence_id for r in ok.collect()) == ["free", "ok"]
    assert {r.evidence_id: r.violations for r in rejects.collect()} == {"old": ["locator_mismatch"], "none": ["locator_without_provenance"]}
