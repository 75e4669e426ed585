"""Declarative rules over assertions and claims: findings and their lineage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions.canonical import canonical_hash, short_id
from claimweave.functions.codes import (
    COLLECTIONS,
    DEMO_GROUPER_VERSION,
    DEMO_PRICE_RULES,
    PriceRule,
    apply_change,
    group_and_price,
)
from claimweave.functions.conditions import Resolver, Typed, compile_condition, variant_path

ENGINE_VERSION = "0.7.0"

#: Statuses under which a package may run.
EXECUTABLE = ("approved", "approved-for-demo")

_ASSERTION_FIELDS = {
    "assertion_id": "string",
    "subject_id": "string",
    "concept": "string",
    "status": "string",
    "documentation_status": "string",
    "confidence": "number",
}
_SUBJECT_FIELDS = {"entity_id": "string", "entity_type": "string", "label": "string"}


def assertion_resolver(path: str) -> Typed | None:
    """Fields a rule may read: the assertion, its open attributes and its subject."""
    if path in _ASSERTION_FIELDS:
        return Typed(F.col(path), _ASSERTION_FIELDS[path])
    head, _, rest = path.partition(".")
    if head == "attributes":
        return variant_path(F.col("attributes"), rest) if rest else Typed(F.col("attributes"), "variant")
    if head == "subject" and rest in _SUBJECT_FIELDS:
        return Typed(F.col(f"_subject_{rest}"), _SUBJECT_FIELDS[rest])
    if head == "subject" and rest.startswith("properties."):
        return variant_path(F.col("_subject_properties"), rest.removeprefix("properties."))
    return None


def case_resolver(path: str) -> Typed | None:
    """Fields a case condition may read: the claim's codes and group, and the metadata."""
    head, _, rest = path.partition(".")
    if head == "claim" and rest in COLLECTIONS:
        return Typed(F.col(rest), "array")
    if path == "claim.drg":
        return Typed(F.col("drg"), "string")
    if head == "metadata" and rest:
        return variant_path(F.col("metadata"), rest)
    return None


def matching_rules(predicates: Sequence[Column], name: str = "rule_index") -> Column:
    """Positions of the rules whose predicate holds: one pass over the rows for all rules."""
    return F.array_compact(
        F.array(*[F.when(predicate, F.lit(index)) for index, predicate in enumerate(predicates)])
    ).alias(name)


def _subtypes(classes: Mapping[str, str | None], wanted: Sequence[str], include: bool) -> list[str]:
    """Class names in scope; the hierarchy is bounded configuration."""
    if not include:
        return list(wanted)

    def lineage(name: str | None) -> list[str]:
        seen: list[str] = []
        while name is not None and name not in seen:
            seen.append(name)
            name = classes.get(name)
        return seen

    return [name for name in classes if set(lineage(name)) & set(wanted)]


def _change_list(change: Mapping[str, Sequence[str]], key: str) -> Column:
    return F.array(*[F.lit(code) for code in change.get(key, ())]).cast("array<string>")


def _actions(package: Mapping[str, Any]) -> Column:
    """Action of every rule as a constant array, addressed by the rule's position."""
    rows = []
    for rule in package["rules"]:
        then = rule["then"]
        change = then.get("proposed_change", {})
        entries = [part for key in sorted(change) for part in (F.lit(key), F.array(*[F.lit(c) for c in change[key]]))]
        rows.append(
            F.struct(
                F.lit(rule["rule_id"]).alias("rule_id"),
                F.lit(rule["title"]).alias("title"),
                F.lit(then["disposition"]).alias("disposition"),
                F.lit(then["requires_human_review"]).alias("requires_human_review"),
                F.lit(then["rationale"]).alias("rationale"),
                (F.create_map(*entries) if entries else F.create_map().cast("map<string,array<string>>")).alias(
                    "proposed_change"
                ),
                *[
                    _change_list(change, f"{verb}_{name}").alias(f"{verb}_{name}")
                    for name in COLLECTIONS
                    for verb in ("add", "remove")
                ],
            )
        )
    return F.array(*rows)


def match_assertions(
    assertions: DataFrame, entities: DataFrame, package: Mapping[str, Any], classes: Mapping[str, str | None]
) -> DataFrame:
    """One row per (assertion, rule) whose scope and condition both hold."""
    if package["status"] not in EXECUTABLE:
        raise ValueError(f"rule package status {package['status']!r} is not executable")
    subject = entities.select(
        "case_id",
        F.col("entity_id").alias("subject_id"),
        F.col("entity_id").alias("_subject_entity_id"),
        F.col("entity_type").alias("_subject_entity_type"),
        F.col("label").alias("_subject_label"),
        F.col("properties").alias("_subject_properties"),
    )
    predicates = []
    for rule in package["rules"]:
        scope = rule["applies_to"]
        unknown = set(scope["subject_types"]) - set(classes)
        if unknown:
            raise ValueError(f"rule {rule['rule_id']} scopes unknown classes: {sorted(unknown)}")
        names = _subtypes(classes, scope["subject_types"], scope["include_subtypes"])
        in_scope = F.coalesce(F.col("_subject_entity_type").isin(*names), F.lit(False))
        predicates.append(in_scope & compile_condition(rule["when"], assertion_resolver))
    joined = assertions.join(subject, ["case_id", "subject_id"])
    return (
        joined.withColumn("rule_index", F.explode(matching_rules(predicates)))
        .drop(*[name for name in joined.columns if name.startswith("_subject_")])
    )


def evaluate_rules(
    assertions: DataFrame,
    entities: DataFrame,
    cases: DataFrame,
    package: Mapping[str, Any],
    classes: Mapping[str, str | None],
    price_rules: Sequence[PriceRule] = DEMO_PRICE_RULES,
    grouper_version: str = DEMO_GROUPER_VERSION,
) -> tuple[DataFrame, DataFrame]:
    """``(findings, lineage)``: one finding per case and rule with at least one match.

    ``cases`` holds one row per case: ``case_id, diagnoses, procedures, charges,
    drg, metadata``.  Cited ids come as ``lineage`` rows in first-seen order over
    matches sorted by falling confidence; see :func:`nest_lineage` for arrays.
    """
    matched = match_assertions(assertions, entities, package, classes)
    grouped = matched.groupBy("case_id", "rule_index").agg(
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("matched_assertions")
    )
    joined = grouped.join(cases, "case_id")
    allowed = F.lit(False)
    for index, rule in enumerate(package["rules"]):
        holds = F.lit(True)
        for condition in rule.get("case_conditions", ()):
            holds = holds & compile_condition(condition, case_resolver)
        allowed = allowed | ((F.col("rule_index") == index) & holds)
    action = F.get(_actions(package), F.col("rule_index"))
    kept = joined.filter(allowed).withColumn("_action", action)
    baseline = group_and_price(F.col("diagnoses"), price_rules, grouper_version)
    changed = apply_change(F.col("diagnoses"), F.col("_action.add_diagnoses"), F.col("_action.remove_diagnoses"))
    simulated = group_and_price(changed, price_rules, grouper_version)
    digest = canonical_hash(
        case_id=F.col("case_id"),
        change=F.col("_action.proposed_change"),
        package_id=F.lit(package["package_id"]),
        package_version=F.lit(package["version"]),
        rule_id=F.col("_action.rule_id"),
    )
    findings = (
        kept.withColumn("_base", baseline)
        .withColumn("_sim", simulated)
        .select(
            "case_id",
            short_id("finding", digest, 16).alias("finding_id"),
            F.col("_action.rule_id").alias("rule_id"),
            F.lit(package["package_id"]).alias("rule_package_id"),
            F.lit(package["version"]).alias("rule_package_version"),
            F.col("_action.title").alias("title"),
            F.col("_action.disposition").alias("disposition"),
            "confidence",
            F.col("_action.proposed_change").alias("proposed_change"),
            F.col("_action.rationale").alias("rationale"),
            F.col("_action.requires_human_review").alias("requires_human_review"),
            F.col("drg").alias("submitted_drg"),
            F.col("_base.group").alias("current_drg"),
            F.col("_sim.group").alias("simulated_drg"),
            (F.col("_sim.cents") - F.col("_base.cents")).alias("estimated_impact_cents"),
            F.lit("estimated").alias("impact_status"),
            F.col("_base.version").alias("grouper_version"),
            "matched_assertions",
            "rule_index",
        )
    )
    return findings.drop("rule_index"), _lineage(matched, findings)


def _cited_items(kind: str, name: str) -> Column:
    return F.transform(
        F.coalesce(name, F.array().cast("array<string>")),
        lambda item, position: F.struct(
            F.lit(kind).alias("kind"), item.alias("item_id"), position.alias("position")
        ),
    )


def _lineage(matched: DataFrame, findings: DataFrame) -> DataFrame:
    """``(finding_id, kind, item_id, first_confidence, first_assertion, first_position)``.

    The first place an id is cited at is a ``min`` aggregate, so repeats vanish
    before the shuffle and no list of a case's assertions is ever built.
    """
    cited = F.concat(
        F.array(
            F.struct(F.lit("assertion").alias("kind"), F.col("assertion_id").alias("item_id"), F.lit(0).alias("position")),
            F.struct(F.lit("subject").alias("kind"), F.col("subject_id").alias("item_id"), F.lit(0).alias("position")),
        ),
        _cited_items("evidence", "evidence_ids"),
        _cited_items("contradicting", "contradicting_evidence_ids"),
    )
    items = matched.select("case_id", "rule_index", "confidence", "assertion_id", F.explode(cited).alias("_cited"))
    first = items.groupBy("case_id", "rule_index", "_cited.kind", "_cited.item_id").agg(
        F.min(F.struct((-F.col("confidence")).alias("c"), F.col("assertion_id").alias("a"), F.col("_cited.position").alias("p"))).alias(
            "_first"
        )
    )
    return first.join(findings.select("case_id", "rule_index", "finding_id"), ["case_id", "rule_index"]).select(
        "finding_id", "kind", "item_id", "_first"
    )


def nest_lineage(findings: DataFrame, lineage: DataFrame, max_items: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """Findings with their four id arrays; those citing more than ``max_items`` are rejects.

    The bound is the case budget of the data model (a case beyond it is refused
    as a whole), so it is counted before anything is gathered.
    """
    counts = lineage.groupBy("finding_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    over = counts.filter(F.col("n") > max_items).select("finding_id").distinct()
    rejects = findings.join(over, "finding_id", "left_semi").withColumn(
        "violations", F.array(F.lit("lineage_over_budget"))
    )
    ok = findings.join(over, "finding_id", "left_anti")
    small = lineage.join(over, "finding_id", "left_anti")
    names = {
        "subject": "subject_ids",
        "assertion": "assertion_ids",
        "evidence": "evidence_ids",
        "contradicting": "contradicting_evidence_ids",
    }
    arrays = small.groupBy("finding_id").agg(
        *[
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_first", "item_id")))),
                lambda pair: pair["item_id"],
            ).alias(name)
            for kind, name in names.items()
        ]
    )
    nested = ok.join(arrays, "finding_id", "left")
    for name in names.values():
        nested = nested.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return nested, rejects


def reproduction_findings(
    cases: DataFrame,
    price_rules: Sequence[PriceRule] = DEMO_PRICE_RULES,
    grouper_version: str = DEMO_GROUPER_VERSION,
) -> DataFrame:
    """Submitted groups that the coded claim does not reproduce; unknown payment gives no impact."""
    grouped = cases.withColumn("_base", group_and_price(F.col("diagnoses"), price_rules, grouper_version))
    return reproduction_rows(
        grouped, F.col("_base.group"), F.col("_base.cents"), F.col("_base.version"), F.col("allowed_amount_cents")
    )


def reproduction_rows(cases: DataFrame, group: Column, cents: Column, version: Column, allowed: Column) -> DataFrame:
    """The same check for any classifier: ``drg`` is the submitted group."""
    digest = canonical_hash(
        case_id=F.col("case_id"),
        check=F.lit("drg-reproduction"),
        grouper_version=version,
        reproduced_drg=group,
        submitted_drg=F.col("drg"),
    )
    return cases.filter(F.col("drg").isNotNull() & (F.col("drg") != group)).select(
        "case_id",
        short_id("finding", digest, 16).alias("finding_id"),
        F.lit("SYSTEM-DRG-REPRODUCTION").alias("rule_id"),
        F.lit("deterministic-system-checks").alias("rule_package_id"),
        F.lit(ENGINE_VERSION).alias("rule_package_version"),
        F.lit("Submitted group does not follow from the coded claim").alias("title"),
        F.lit("coding_review").alias("disposition"),
        F.lit(1.0).alias("confidence"),
        F.create_map(F.lit("replace_drg"), F.array(group)).alias("proposed_change"),
        F.lit("Check grouper version, claim inputs, sequencing and the submitted group first.").alias("rationale"),
        F.lit(True).alias("requires_human_review"),
        F.col("drg").alias("submitted_drg"),
        group.alias("current_drg"),
        group.alias("simulated_drg"),
        (cents - allowed).alias("estimated_impact_cents"),
        F.when(allowed.isNull(), F.lit("unavailable")).otherwise(F.lit("estimated")).alias("impact_status"),
        version.alias("grouper_version"),
    )


def rule_package_gate(package: Mapping[str, Any], digest: str) -> None:
    """Refuse a package bound to another definition."""
    if package["ontology"]["digest"] != digest:
        raise ValueError("incompatible ontology definition for rule package")


def evaluate_flat(df: DataFrame, rules: Sequence[Mapping[str, Any]], resolve: Resolver) -> DataFrame:
    """Rules whose fields are plain columns of one table: one row per (row, rule) match."""
    predicates = [compile_condition(rule["when"], resolve) for rule in rules]
    names = F.array(*[F.lit(rule["rule_id"]) for rule in rules])
    matched = df.withColumn("rule_index", F.explode(matching_rules(predicates)))
    return matched.withColumn("rule_id", F.get(names, F.col("rule_index"))).drop("rule_index")
