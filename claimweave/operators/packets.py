"""Review packets, audit records and integrity checks by recomputed digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.functions.canonical import canonical_hash, multiset_fingerprint, row_digest, short_id
from claimweave.operators.scale import SEGMENT_ROWS, previous_in_chain, reasons, split_checked

PACKET_SCHEMA = "3.0.0"
AUDIT_SCHEMA = "1.0.0"
# Actions a packet permits, and environments a packet may name.
PERMITTED_ACTIONS = (
    "route_to_coding",
    "route_to_cdi",
    "route_to_charge_review",
    "route_to_compliance",
    "dismiss_with_reason",
)
ENVIRONMENTS = ("development", "synthetic", "validation", "production")


def finding_summary(findings: DataFrame, case: str) -> DataFrame:
    """Per case: number of findings, digest of them all, review flag, grouper versions.

    The digest is order-insensitive and combines map-side, so a case with very
    many findings needs no list of them.
    """
    return findings.groupBy(case).agg(
        F.count(F.lit(1)).alias("finding_count"),
        multiset_fingerprint(F.col("finding_hash")).alias("findings_hash"),
        F.bool_or("requires_human_review").alias("human_review_required"),
        F.array_sort(F.collect_set("grouper_version")).alias("grouper_versions"),
    )


def build_packets(
    cases: DataFrame,
    findings: DataFrame,
    *,
    case: str,
    as_of: str,
    engine_version: str,
    rule_package_hash: str,
    environment: str = "development",
) -> DataFrame:
    """One packet row per case with its record, packet id and packet digest.

    ``cases`` holds ``case``, ``tenant_id``, ``workspace_id`` and ``case_hash``.
    """
    if environment not in ENVIRONMENTS:
        raise ValueError(f"unsupported packet environment: {environment!r}")
    joined = cases.join(finding_summary(findings, case), case, "left").na.fill({"finding_count": 0})
    joined = joined.withColumn("human_review_required", F.coalesce("human_review_required", F.lit(False)))
    joined = joined.withColumn("grouper_versions", F.coalesce("grouper_versions", F.array().cast("array<string>")))
    record = canonical_hash(
        audit_schema_version=F.lit(AUDIT_SCHEMA),
        case_hash=F.col("case_hash"),
        case_id=F.col(case).cast("string"),
        engine_version=F.lit(engine_version),
        evaluated_at=F.lit(as_of),
        findings_hash=F.col("findings_hash"),
        rule_package_hash=F.lit(rule_package_hash),
    )
    identity = canonical_hash(
        case_id=F.col(case).cast("string"),
        record_hash=F.col("record_hash"),
        tenant_id=F.col("tenant_id"),
        workspace_id=F.col("workspace_id"),
    )
    built = (
        joined.withColumn("record_hash", record)
        .withColumn("packet_id", short_id("packet", identity, 20))
        .withColumn("environment", F.lit(environment))
        .withColumn("claim_mutation_allowed", F.lit(False))
        .withColumn("permitted_actions", F.array(*[F.lit(a) for a in PERMITTED_ACTIONS]))
    )
    return built.withColumn("packet_hash", packet_digest())


#: Columns of a packet that its digest covers: all but the digest itself.
PACKET_FIELDS = (
    "case_hash",
    "claim_mutation_allowed",
    "environment",
    "finding_count",
    "findings_hash",
    "grouper_versions",
    "human_review_required",
    "packet_id",
    "permitted_actions",
    "record_hash",
    "tenant_id",
    "workspace_id",
)


def packet_digest() -> Column:
    """Digest over the whole packet row, itself excluded."""
    return canonical_hash(**{name: F.col(name) for name in PACKET_FIELDS})


def digest_tree(rows: DataFrame, by: Sequence[str], key: str, columns: Sequence[str], leaves: int = 256) -> DataFrame:
    """``(*by, leaf, row_count, fingerprint)``: digests of the rows of every group by ranges of their hashed key.

    A leaf covers the rows whose key falls into it, so an altered row shows in one leaf.  Sums combine before the
    shuffle: a group with a third of all rows costs ``leaves`` rows per task.
    """
    leaf = F.pmod(F.xxhash64(key), F.lit(leaves)).cast("int").alias("leaf")
    digested = rows.select(*by, leaf, row_digest(rows, list(columns)).alias("_digest"))
    return digested.groupBy(*by, "leaf").agg(F.count(F.lit(1)).alias("row_count"), multiset_fingerprint(F.col("_digest")).alias("fingerprint"))


def tree_roots(tree: DataFrame, by: Sequence[str], name: str = "root") -> DataFrame:
    """One digest per group over its leaves, at most ``leaves`` of ``digest_tree`` of them."""
    leaf = canonical_hash(leaf=F.col("leaf"), row_count=F.col("row_count"), fingerprint=F.col("fingerprint"))
    return tree.select(*by, leaf.alias("_digest")).groupBy(*by).agg(multiset_fingerprint(F.col("_digest")).alias(name))


def altered_rows(original: DataFrame, now: DataFrame, by: Sequence[str], key: str, columns: Sequence[str]) -> DataFrame:
    """``(*by, key, change)``: keys whose rows were ``altered``, ``removed`` or ``added`` since ``original``.

    Every row is digested once and the copies of a digest are counted on both sides, before and after one shuffle, so a
    key with several rows is compared by all of them.  Groups whose roots (``tree_roots``) agree with stored ones can be left out by the caller.
    """

    def digested(df: DataFrame, was: int) -> DataFrame:
        digest = F.unhex(row_digest(df, list(columns))).alias("_digest")
        return df.select(*by, key, digest, F.lit(was).alias("_was"), F.lit(1 - was).alias("_is"))

    both = digested(original, 1).unionByName(digested(now, 0))
    copies = both.groupBy(*by, key, "_digest").agg(F.sum("_was").alias("_was"), F.sum("_is").alias("_is"))
    keys = copies.groupBy(*by, key).agg(
        F.max("_was").alias("_was"), F.max("_is").alias("_is"), F.bool_or(F.col("_was") != F.col("_is")).alias("_differs")
    )
    change = F.when(F.col("_is") == 0, "removed").when(F.col("_was") == 0, "added").otherwise("altered")
    return keys.filter("_differs").select(*by, key, change.alias("change"))


def check_identifiers(df: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Tenant-style identifiers: 1 to 128 characters of a safe alphabet."""
    checked = df.withColumn(
        "violations", reasons(**{f"bad_{name}": ~F.coalesce(F.col(name).rlike(text.IDENTIFIER), F.lit(False)) for name in names})
    )
    return split_checked(checked)


def verify_hash(df: DataFrame, claimed: str, recomputed: Column, name: str = "intact") -> DataFrame:
    return df.withColumn(name, F.coalesce(F.col(claimed) == recomputed, F.lit(False)))


def check_findings() -> Column:
    """Violations of a finding row: impact status against estimate, change against review."""
    estimated = F.col("impact_status") == "estimated"
    return reasons(
        impact_status_mismatch=estimated != F.col("estimated_impact_cents").isNotNull(),
        change_without_review=F.col("has_change") & ~F.col("requires_human_review"),
    )


def verify_chain(
    df: DataFrame,
    keys: Sequence[str],
    sequence: str,
    record_hash: str,
    previous_hash: str,
    recomputed: Column,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Per chain: rows, broken links and altered records, and whether all is intact."""
    linked = previous_in_chain(df, keys, sequence, record_hash, "_expected", segment_rows)
    link_ok = F.col(previous_hash).eqNullSafe(F.col("_expected"))
    body_ok = F.coalesce(F.col(record_hash) == recomputed, F.lit(False))
    return (
        linked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("records"),
            F.count_if(~link_ok).alias("broken_links"),
            F.count_if(~body_ok).alias("altered_records"),
            F.max_by(record_hash, sequence).alias("last_hash"),
        )
        .withColumn("intact", (F.col("broken_links") == 0) & (F.col("altered_records") == 0))
    )
