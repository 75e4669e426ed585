"""Admission of reviewer decisions: cascade, idempotency and one terminal decision per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.operators.automation import DISMISS, HUMAN_TIERS
from claimweave.operators.scale import first_reason
from claimweave.session import cut_lineage

# What each reviewer role may do, and the reason codes.
ROLE_ACTIONS = {
    "coder": ("route_to_coding", "route_to_cdi", DISMISS),
    "cdi_specialist": ("route_to_cdi", "route_to_coding", DISMISS),
    "charge_reviewer": ("route_to_charge_review", "route_to_compliance", DISMISS),
    "compliance_reviewer": ("route_to_compliance", DISMISS),
    "admin": ("route_to_coding", "route_to_cdi", "route_to_charge_review", "route_to_compliance", DISMISS),
    "read_only": (),
}
REASON_CODES = (
    "evidence_confirmed",
    "documentation_not_supported",
    "duplicate",
    "already_corrected",
    "other_governed",
)
#: Fields that make two requests with one idempotency key the same request.
REQUEST_FIELDS = (
    "packet_id",
    "finding_id",
    "action",
    "reason_code",
    "reason",
    "actor_id",
    "actor_roles",
    "packet_hash",
    "plan_hash",
)
KEY = ["tenant_id", "workspace_id", "idempotency_key"]
FINDING = ["tenant_id", "workspace_id", "packet_id", "finding_id"]
#: All that the matching reads of a request.
DECISION_FIELDS = list(dict.fromkeys(["sequence", *KEY, *FINDING, *REQUEST_FIELDS]))


def roles_permit(roles: Column, action: Column) -> Column:
    """Any of the roles allows the action."""
    pairs = [f"{role}:{name}" for role, actions in ROLE_ACTIONS.items() for name in actions]
    allowed = F.array(*[F.lit(pair) for pair in pairs])
    return F.exists(roles, lambda role: F.array_contains(allowed, F.concat(role, F.lit(":"), action)))


def _blank_or_longer(value: Column, limit: int) -> Column:
    """Null, blank or of more than ``limit`` characters once stripped; most texts need no strip at their end."""
    blank = F.length(F.ltrim(value, F.lit(text.WHITESPACE))) == 0
    return value.isNull() | blank | ((F.length(value) > limit) & (F.length(text.strip(value)) > limit))


def _checks() -> dict[str, tuple[str, Column]]:
    """The checks of the cascade in order, each with the side that it reads (``both``: a request and another side)."""
    dismissal = F.col("action") == DISMISS
    confirmed = F.col("reason_code") == "evidence_confirmed"
    return {
        "packet_integrity": ("packets", ~F.coalesce("packet_intact", F.lit(False))),
        "plan_integrity": ("packets", ~F.coalesce("plan_intact", F.lit(False))),
        "reviewer_scope": (
            "both",
            ~(
                F.col("tenant_id").eqNullSafe(F.col("packet_tenant"))
                & F.col("workspace_id").eqNullSafe(F.col("packet_workspace"))
            ),
        ),
        "plan_scope": (
            "packets",
            ~(
                F.col("plan_tenant").eqNullSafe(F.col("packet_tenant"))
                & F.col("plan_workspace").eqNullSafe(F.col("packet_workspace"))
            ),
        ),
        "other_packet": ("packets", ~F.col("plan_packet_hash").eqNullSafe(F.col("packet_hash"))),
        "mutation_control": ("packets", ~F.col("claim_mutation_allowed").eqNullSafe(F.lit(False))),
        "action_not_permitted": ("both", ~F.array_contains("permitted_actions", F.col("action"))),
        "unknown_finding": ("items", F.col("tier").isNull()),
        "finding_changed": ("items", ~F.col("item_finding_hash").eqNullSafe(F.col("packet_finding_hash"))),
        "tier_not_eligible": ("items", ~F.col("tier").isin(*HUMAN_TIERS)),
        "not_selected": ("items", ~F.coalesce("selected", F.lit(False))),
        "action_not_allowed": ("both", ~F.array_contains("allowed_actions", F.col("action"))),
        "role": ("requests", ~F.coalesce(roles_permit(F.col("actor_roles"), F.col("action")), F.lit(False))),
        "unknown_reason_code": ("requests", ~F.coalesce(F.col("reason_code").isin(*REASON_CODES), F.lit(False))),
        "reason_code_mismatch": ("requests", dismissal == confirmed),
        "reason_text": ("requests", _blank_or_longer(F.col("reason"), 1000)),
        "idempotency_key": ("requests", _blank_or_longer(F.col("idempotency_key"), 128)),
    }


def admit(requests: DataFrame, packets: DataFrame, items: DataFrame) -> DataFrame:
    """Requests with ``reject_reason``: the first check of the cascade that fails, or null.

    ``packets``: one row per packet with its plan (``packet_intact, plan_intact,
    packet_tenant, packet_workspace, plan_tenant, plan_workspace, plan_packet_hash,
    packet_hash, plan_hash, claim_mutation_allowed, permitted_actions``).
    ``items``: ``packet_id, finding_id, tier, selected, allowed_actions,
    item_finding_hash, packet_finding_hash``.
    """
    joined = requests.join(packets, "packet_id", "left").join(items, ["packet_id", "finding_id"], "left")
    return joined.withColumn("reject_reason", first_reason(**{name: check for name, (_, check) in _checks().items()}))


def admitted(requests: DataFrame, packets: DataFrame, items: DataFrame) -> DataFrame:
    """The requests of :func:`admit` without a ``reject_reason``.

    A request is admitted when no check fails, whatever their order.  A check that reads one side therefore filters that
    side before the joins, which see only requests, packets and items that may still be admitted.
    """

    def passing(df: DataFrame, side: str) -> DataFrame:
        for _, check in filter(lambda found: found[0] == side, _checks().values()):
            df = df.filter(~F.coalesce(check, F.lit(False)))
        return df

    listed, known = passing(items, "items"), passing(packets, "packets")
    joined = passing(requests, "requests").join(listed, ["packet_id", "finding_id"]).join(known, "packet_id")
    return passing(joined, "both")


def resolve(admitted: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``status`` of admitted requests in order of ``sequence``, after the decisions in ``stored``.

    ``accepted`` when neither the idempotency key nor the finding was taken by an
    earlier accepted request; ``replayed`` or ``conflict`` when the key was taken
    by an equal or a different request; ``terminal`` when the finding already has
    a decision.  ``stored`` holds the accepted requests of earlier batches with their columns; all of them come first,
    so batches of growing sequence give the outcome of one batch over all requests.

    Requests that meet a stored key or finding leave before the matching, which only sees new groups.  Accepting in order
    is a greedy matching of keys and findings:
    each round accepts the requests that come first on both sides and drops
    those that share a side with them, which gives the sequential outcome.  The first pending request is always
    accepted, so rounds end by themselves.
    Rounds are checkpointed and only their emptiness reaches the driver.
    """
    pending = admitted.select("sequence", *dict.fromkeys(KEY + FINDING))
    if stored is not None:
        pending = pending.join(stored.select(*KEY), KEY, "left_anti").join(stored.select(*FINDING), FINDING, "left_anti")
        pending = cut_lineage(pending)
    accepted = None
    while True:
        first = F.min(F.struct("sequence", *[name for name in FINDING if name not in KEY])).alias("_first")
        of_key = pending.groupBy(*KEY).agg(first).select(*KEY, "_first.*")
        of_finding = pending.groupBy(*FINDING).agg(F.min("sequence").alias("_by_finding"))
        won = of_key.join(of_finding, FINDING).filter(F.col("sequence") == F.col("_by_finding")).select(*pending.columns)
        won = cut_lineage(won)
        accepted = won if accepted is None else accepted.unionByName(won)
        pending = cut_lineage(
            pending.join(won.select(*KEY), KEY, "left_anti").join(won.select(*FINDING), FINDING, "left_anti")
        )
        if pending.isEmpty():
            break
    winners = admitted.join(accepted.select("sequence"), "sequence", "left_semi")
    request = F.struct(*REQUEST_FIELDS).alias("_request")
    keyed = winners.select(*KEY, F.col("sequence").alias("_sequence"), request, F.lit(False).alias("_stored"))
    if stored is not None:
        keyed = keyed.unionByName(stored.select(*KEY, F.col("sequence").alias("_sequence"), request, F.lit(True).alias("_stored")))
    joined = admitted.join(keyed, KEY, "left")
    same = F.col("_request").eqNullSafe(F.struct(*REQUEST_FIELDS))
    earlier = F.coalesce(F.col("_stored") | (F.col("_sequence") < F.col("sequence")), F.lit(False))
    status = (
        F.when(~F.col("_stored") & (F.col("_sequence") == F.col("sequence")), F.lit("accepted"))
        .when(earlier & same, F.lit("replayed"))
        .when(earlier, F.lit("conflict"))
        .otherwise(F.lit("terminal"))
    )
    return joined.withColumn("status", status).drop("_request", "_stored").withColumnRenamed("_sequence", "resolved_by")


def decision_feedback(decisions: DataFrame, by: list[str]) -> DataFrame:
    """Accepted, dismissed and reason counts per group; the rate is null without decisions."""
    accepted = F.count_if(F.col("action") != DISMISS)
    return (
        decisions.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total_decisions"),
            accepted.alias("accepted"),
            *[F.count_if(F.col("reason_code") == code).alias(code) for code in REASON_CODES],
        )
        .withColumn("dismissed", F.col("total_decisions") - F.col("accepted"))
        .withColumn("acceptance_rate", F.try_divide(F.col("accepted"), F.col("total_decisions")))
    )
