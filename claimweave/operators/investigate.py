"""Externally produced hypotheses: checks, critique synthesis, promotion to findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.functions.canonical import canonical_hash, short_id
from claimweave.functions.codes import apply_change
from claimweave.operators.checks import duplicates, overlap, unknown_references
from claimweave.operators.scale import first_per_group, reasons, split_checked

# What each hypothesis category proposes, and how it is routed.  The titles are free.
CHANGE_KEY = {
    "missed_diagnosis": "add_diagnoses",
    "coding_specificity": "add_diagnoses",
    "missed_procedure": "add_procedures",
    "missed_charge": "add_charges",
}
DISPOSITION = {
    "missed_diagnosis": "coding_review",
    "missed_procedure": "coding_review",
    "missed_charge": "charge_review",
    "coding_specificity": "coding_review",
    "drg_discrepancy": "coding_review",
    "documentation_gap": "cdi_query",
    "denial_risk": "coding_review",
    "payment_variance": "charge_review",
    "unsupported_billing": "compliance_review",
}
TITLE = {
    "missed_diagnosis": "Diagnosis documented, not on the claim",
    "missed_procedure": "Procedure documented, not on the claim",
    "missed_charge": "Service documented, not charged",
    "coding_specificity": "Code less exact than the record",
    "drg_discrepancy": "Claim group differs from the record",
    "documentation_gap": "Record incomplete",
    "denial_risk": "Payer may deny",
    "payment_variance": "Payment differs from the contract",
    "unsupported_billing": "Billed without support in the record",
}


def category_lookup(category: Column, table: dict[str, str]) -> Column:
    entries = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.try_element_at(entries, category)


def title_of(category: Column) -> Column:
    return category_lookup(category, TITLE)


def structural_violations() -> Column:
    """Checks that need the hypothesis row alone."""
    return reasons(
        blank_field=text.is_blank(F.col("hypothesis_id"))
        | text.is_blank(F.col("encounter_id"))
        | text.is_blank(F.col("hypothesis")),
        no_evidence=(F.size("evidence_ids") == 0) & (F.col("category") != "payment_variance"),
        overlap=overlap(F.col("evidence_ids"), F.col("contradicting_evidence_ids")),
        negative_materiality=F.col("materiality_cents") < 0,
    )


def validate_hypotheses(
    hypotheses: DataFrame,
    packets: DataFrame,
    evidence: DataFrame,
    assertions: DataFrame,
    extra: Sequence[tuple[str, Callable[[], Column]]] = (),
) -> tuple[DataFrame, DataFrame]:
    return split_checked(checked_hypotheses(hypotheses, packets, evidence, assertions, extra))


def checked_hypotheses(
    hypotheses: DataFrame,
    packets: DataFrame,
    evidence: DataFrame,
    assertions: DataFrame,
    extra: Sequence[tuple[str, Callable[[], Column]]] = (),
) -> DataFrame:
    """Hypotheses with the ``violations`` against their packet; every failing check is listed.

    ``packets``: ``packet_id, packet_encounter_id, drg``; ``evidence`` and
    ``assertions`` are keyed by ``packet_id``.  ``extra`` adds named checks.
    """
    key = ["packet_id", "hypothesis_id"]
    repeated = duplicates(hypotheses, key).select(*key, F.lit(True).alias("_repeated"))
    cited = F.concat("evidence_ids", "contradicting_evidence_ids")

    def flag(references: Column, target: DataFrame, column: str, name: str) -> DataFrame:
        return (
            unknown_references(hypotheses, key, references, target, [column], scope=["packet_id"])
            .select(*key, F.lit(True).alias(name))
            .distinct()
        )

    joined = (
        hypotheses.join(packets.select("packet_id", "packet_encounter_id", "drg"), "packet_id", "left")
        .join(repeated, key, "left")
        .join(flag(cited, evidence, "evidence_id", "_no_evidence"), key, "left")
        .join(flag(F.col("assertion_ids"), assertions, "assertion_id", "_no_assertion"), key, "left")
    )
    return joined.withColumn(
        "violations",
        F.concat(
            structural_violations(),
            reasons(
                duplicate_id=F.col("_repeated"),
                encounter_mismatch=~F.col("encounter_id").eqNullSafe(F.col("packet_encounter_id")),
                unknown_evidence=F.col("_no_evidence"),
                unknown_assertion=F.col("_no_assertion"),
                drg_discrepancy_without_drg=(F.col("category") == "drg_discrepancy")
                & text.is_blank(F.col("drg")),
                **{name: check() for name, check in extra},
            ),
        ),
    ).drop("_repeated", "_no_evidence", "_no_assertion", "packet_encounter_id", "drg")


def check_critiques(critiques: DataFrame, hypotheses: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Known hypothesis, one critique each, known counter-evidence."""
    key = ["packet_id", "hypothesis_id"]
    repeated = duplicates(critiques, key).select(*key, F.lit(True).alias("_repeated"))
    known = hypotheses.select(*key, F.lit(True).alias("_known")).distinct()
    unknown = (
        unknown_references(critiques, key, F.col("counterevidence_ids"), evidence, ["evidence_id"], scope=["packet_id"])
        .select(*key, F.lit(True).alias("_unknown"))
        .distinct()
    )
    joined = critiques.join(known, key, "left").join(repeated, key, "left").join(unknown, key, "left")
    checked = joined.withColumn(
        "violations",
        reasons(
            unknown_hypothesis=F.col("_known").isNull(),
            duplicate_critique=F.col("_repeated"),
            unknown_evidence=F.col("_unknown"),
        ),
    ).drop("_known", "_repeated", "_unknown")
    return split_checked(checked)


def synthesize(hypotheses: DataFrame, critiques: DataFrame) -> DataFrame:
    """Supported hypotheses, the best one per encounter, category and code list.

    Best is the highest financial, then evidence confidence, then input order.
    """
    # Hypothesis ids are unique within a packet only.
    supported = critiques.filter("supported").select("packet_id", "hypothesis_id").distinct()
    kept = hypotheses.join(supported, ["packet_id", "hypothesis_id"], "left_semi")
    keyed = kept.withColumn("_codes", F.concat_ws(",", "candidate_codes"))
    order = [F.desc("confidence_financial"), F.desc("confidence_evidence"), F.asc("input_order")]
    return first_per_group(keyed, ["encounter_id", "category", "_codes"], order, "hypothesis_id").drop("_codes")


def promote(hypotheses: DataFrame, cases: DataFrame, price: Callable[[Column], Column]) -> DataFrame:
    """Findings from validated hypotheses, simulated against the case's claim.

    ``cases``: ``packet_id, diagnoses, procedures, charges, drg``.  ``price`` maps
    the changed claim ``struct(diagnoses, procedures, charges)`` to
    ``struct(group, cents, version)``.  Without candidate codes nothing is
    simulated: the impact stays null and counts as not applicable.
    """
    joined = hypotheses.join(cases, "packet_id")
    change_key = F.when(F.size("candidate_codes") > 0, category_lookup(F.col("category"), CHANGE_KEY))

    def changed(name: str) -> Column:
        added = F.when(change_key == f"add_{name}", F.col("candidate_codes")).otherwise(F.array().cast("array<string>"))
        return apply_change(F.col(name), added)

    claim = F.struct("diagnoses", "procedures", "charges")
    simulated = F.struct(*[changed(name).alias(name) for name in ("diagnoses", "procedures", "charges")])
    priced = joined.withColumns({"_base": price(claim), "_change_key": change_key}).withColumn(
        "_sim", F.when(F.col("_change_key").isNotNull(), price(simulated)).otherwise(F.col("_base"))
    )
    has_change = F.col("_change_key").isNotNull()
    confidence = F.least("confidence_evidence", "confidence_semantic", "confidence_financial")
    missing = F.concat_ws("; ", "missing_information")
    digest = canonical_hash(
        packet_id=F.col("packet_id"),
        grouper_version=F.col("_base.version"),
        hypothesis=F.struct(
            "candidate_codes", "category", "encounter_id", "evidence_ids", "hypothesis", "hypothesis_id", "missing_information"
        ),
    )
    return priced.select(
        "packet_id",
        "encounter_id",
        "hypothesis_id",
        short_id("finding-agent", digest, 16).alias("finding_id"),
        F.concat(F.lit("AGENT-"), F.upper("category")).alias("rule_id"),
        title_of(F.col("category")).alias("title"),
        category_lookup(F.col("category"), DISPOSITION).alias("disposition"),
        confidence.alias("confidence"),
        F.when(has_change, F.create_map(F.col("_change_key"), F.col("candidate_codes")))
        .otherwise(F.create_map().cast("map<string,array<string>>"))
        .alias("proposed_change"),
        F.when(missing != "", F.concat("hypothesis", F.lit(" Missing information: "), missing))
        .otherwise(F.col("hypothesis"))
        .alias("rationale"),
        F.lit(True).alias("requires_human_review"),
        F.col("drg").alias("submitted_drg"),
        F.col("_base.group").alias("current_drg"),
        F.col("_sim.group").alias("simulated_drg"),
        F.when(has_change, F.col("_sim.cents") - F.col("_base.cents")).alias("estimated_impact_cents"),
        F.when(has_change, F.lit("estimated")).otherwise(F.lit("not_applicable")).alias("impact_status"),
        F.col("_base.version").alias("grouper_version"),
    )


def investigation_runs(checked: DataFrame) -> DataFrame:
    """Accepted and rejected hypotheses per packet."""
    accepted = F.size("violations") == 0
    return checked.groupBy("packet_id").agg(
        F.count_if(accepted).alias("accepted_count"), F.count_if(~accepted).alias("rejected_count")
    )
