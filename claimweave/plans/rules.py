"""Declarative rules, grouping and pricing over events, customers and claim lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.codes import apply_change, group_and_price
from claimweave.functions.conditions import Typed
from claimweave.operators.attach import collect_codes
from claimweave.operators.rules import evaluate_flat, evaluate_rules, match_assertions, reproduction_findings
from claimweave.plans.bindings import cents, choose, events, table, text_id
from claimweave.plans.registry import query

# Fixed values of the binding: classes of the assertion subjects and the rules.
CLASSES = {
    "Item": None,
    "Therapy": "Item",
    "Infusion": "Therapy",
    "Dialysis": "Therapy",
    "Equipment": "Item",
}
SUBJECT_CLASS = {
    "purchase": "Infusion",
    "view": "Dialysis",
    "signup": "Therapy",
    "click": "Equipment",
    "error": "Equipment",
}
SEGMENT_CODE = {
    "BUILDING": "L89.154",
    "MACHINERY": "L89.213",
    "HOUSEHOLD": "A41.9",
    "FURNITURE": "L97.4",
    "AUTOMOBILE": "I10",
}
PACKAGE = {
    "package_id": "event-rules",
    "version": "2.0.0",
    "status": "approved",
    "rules": [
        {
            "rule_id": "LOW-DOSE-RUN",
            "title": "Therapy ran at a low dose or was noted with doubt on a claim with a foot code",
            "applies_to": {"subject_types": ["Infusion", "Dialysis"], "include_subtypes": False},
            "when": {
                "any": [
                    {"all": [{"field": "attributes.k", "op": "lte", "value": 12}, {"field": "concept", "op": "ne", "value": "view"}]},
                    {"field": "confidence", "op": "lte", "value": 0.76},
                ]
            },
            "case_conditions": [{"field": "claim.diagnoses", "op": "contains", "value": "L97.4"}],
            "then": {
                "disposition": "coding_review",
                "requires_human_review": True,
                "proposed_change": {"remove_diagnoses": ["L97.4"], "add_diagnoses": ["L89.154"]},
                "rationale": "Compare the dose log with the code.",
            },
        },
        {
            "rule_id": "LATE-NOTE",
            "title": "Therapy known from late notes only",
            "applies_to": {"subject_types": ["Therapy"], "include_subtypes": True},
            "when": {"not": {"any": [{"field": "attributes.k", "op": "gte", "value": 95}, {"field": "documentation_status", "op": "eq", "value": "explicit"}]}},
            "then": {
                "disposition": "cdi_query",
                "requires_human_review": True,
                "proposed_change": {},
                "rationale": "Look up the shift report.",
            },
        },
        {
            "rule_id": "EQUIPMENT-REPLACED",
            "title": "Equipment replaced on a claim that still lists sepsis",
            "applies_to": {"subject_types": ["Equipment"], "include_subtypes": True},
            "when": {"not": {"any": [{"field": "attributes.k", "op": "lte", "value": 80}, {"field": "attributes.k", "op": "eq", "value": 99}]}},
            "case_conditions": [
                {"field": "claim.diagnoses", "op": "contains", "value": "A41.9"},
                {"field": "metadata.nation", "op": "gte", "value": 5},
            ],
            "then": {
                "disposition": "coding_review",
                "requires_human_review": True,
                "proposed_change": {"remove_diagnoses": ["A41.9"], "add_diagnoses": ["L89.213"]},
                "rationale": "Replace the code.",
            },
        },
    ],
}


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as assertions of a case (the user)."""
    k, whole = F.col("k"), F.col("whole")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("case_id"),
        text_id("AS-", "event_id").alias("assertion_id"),
        text_id("S-", "event_type").alias("subject_id"),
        F.col("event_type").alias("concept"),
        F.lit("present").alias("status"),
        F.when(k < 60, "explicit").when(k < 80, "inferred").when(k < 90, "conflicted").otherwise("absent").alias("documentation_status"),
        (F.lit(1.0) - k / F.lit(400.0)).alias("confidence"),
        F.parse_json("props").alias("attributes"),
        F.array(text_id("EV-", "event_type", whole)).alias("evidence_ids"),
        F.when(k < 5, F.array(text_id("CO-", whole))).otherwise(F.array().cast("array<string>")).alias("contradicting_evidence_ids"),
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subject per case and concept."""
    kind = F.col("event_type")
    return (
        events(spark, sf_dir)
        .select(F.col("user_id").alias("case_id"), "event_type")
        .distinct()
        .select(
            "case_id",
            text_id("S-", "event_type").alias("entity_id"),
            choose(kind, SUBJECT_CLASS).alias("entity_type"),
            kind.alias("label"),
            F.parse_json(F.lit("{}")).alias("properties"),
        )
    )


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases whose claim carries the code of their segment."""
    none = F.array().cast("array<string>")
    nation = F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("case_id"),
        F.array(choose(F.col("c_mktsegment"), SEGMENT_CODE, "Z00")).alias("diagnoses"),
        none.alias("procedures"),
        none.alias("charges"),
        F.when(nation < 8, "DEMO-290").when(nation < 16, "DEMO-292").when(nation < 22, "DEMO-291").alias("drg"),
        F.when(nation != 3, cents(F.abs("c_acctbal"))).alias("allowed_amount_cents"),
        F.parse_json(F.concat(F.lit('{"nation":'), nation.cast("string"), F.lit("}"))).alias("metadata"),
    )


_GROUP_SQL = "CASE WHEN list_contains({d}, 'L89.154') THEN '{a}' WHEN len(list_filter({d}, lambda x: starts_with(x, 'L89'))) > 0 THEN '{b}' ELSE '{c}' END"


def group_sql(diagnoses: str) -> str:
    return _GROUP_SQL.format(d=diagnoses, a="DEMO-290", b="DEMO-291", c="DEMO-292")


def price_sql(diagnoses: str) -> str:
    return f"CAST({_GROUP_SQL.format(d=diagnoses, a='1842000', b='1280000', c='1000000')} AS BIGINT)"


_CASES_SQL = """assertions AS (
  SELECT user_id AS case_id, 'AS-' || event_id AS assertion_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k,
    CAST(floor(value) AS BIGINT) AS whole,
    CASE WHEN CAST(props->>'$.k' AS BIGINT) < 60 THEN 'explicit' WHEN CAST(props->>'$.k' AS BIGINT) < 80 THEN 'inferred'
      WHEN CAST(props->>'$.k' AS BIGINT) < 90 THEN 'conflicted' ELSE 'absent' END AS documentation_status,
    1.0::DOUBLE - CAST(props->>'$.k' AS BIGINT) / 400.0::DOUBLE AS confidence
  FROM events),
cases AS (
  SELECT c_custkey AS case_id, c_nationkey AS nation,
    [CASE c_mktsegment WHEN 'BUILDING' THEN 'L89.154' WHEN 'MACHINERY' THEN 'L89.213' WHEN 'HOUSEHOLD' THEN 'A41.9'
      WHEN 'FURNITURE' THEN 'L97.4' WHEN 'AUTOMOBILE' THEN 'I10' ELSE 'Z00' END] AS diagnoses,
    CASE WHEN c_nationkey < 8 THEN 'DEMO-290' WHEN c_nationkey < 16 THEN 'DEMO-292' WHEN c_nationkey < 22 THEN 'DEMO-291' END AS drg,
    CASE WHEN c_nationkey <> 3 THEN CAST(round(abs(c_acctbal) * 100) AS BIGINT) END AS allowed_amount_cents
  FROM customer),
matched AS (
  SELECT a.*, r.rule_id FROM assertions a JOIN (VALUES ('LOW-DOSE-RUN'), ('LATE-NOTE'), ('EQUIPMENT-REPLACED')) r(rule_id) ON
    CASE r.rule_id
      WHEN 'LOW-DOSE-RUN' THEN event_type IN ('purchase', 'view') AND ((k <= 12 AND event_type <> 'view') OR confidence <= 0.76::DOUBLE)
      WHEN 'LATE-NOTE' THEN event_type IN ('purchase', 'view', 'signup') AND NOT (k >= 95 OR documentation_status = 'explicit')
      ELSE event_type IN ('click', 'error') AND NOT (k <= 80 OR k = 99) END),
grouped AS (SELECT case_id, rule_id, max(confidence) AS confidence, count(*) AS matched_assertions FROM matched GROUP BY ALL),
kept AS (
  SELECT g.*, c.diagnoses, c.drg,
    CASE rule_id WHEN 'LOW-DOSE-RUN' THEN list_concat(list_filter(diagnoses, lambda x: x <> 'L97.4'), ['L89.154'])
      WHEN 'EQUIPMENT-REPLACED' THEN list_concat(list_filter(diagnoses, lambda x: x <> 'A41.9'), ['L89.213'])
      ELSE diagnoses END AS changed,
    CASE rule_id WHEN 'LOW-DOSE-RUN' THEN '{"add_diagnoses":["L89.154"],"remove_diagnoses":["L97.4"]}'
      WHEN 'EQUIPMENT-REPLACED' THEN '{"add_diagnoses":["L89.213"],"remove_diagnoses":["A41.9"]}' ELSE '{}' END AS change
  FROM grouped g JOIN cases c USING (case_id)
  WHERE CASE rule_id WHEN 'LOW-DOSE-RUN' THEN list_contains(diagnoses, 'L97.4')
    WHEN 'EQUIPMENT-REPLACED' THEN list_contains(diagnoses, 'A41.9') AND nation >= 5 ELSE TRUE END),
findings AS (
  SELECT case_id, rule_id, confidence, matched_assertions, drg AS submitted_drg, diagnoses, changed,
    'finding-' || substr(sha256('{"case_id":' || case_id || ',"change":' || change
      || ',"package_id":"event-rules","package_version":"2.0.0","rule_id":"' || rule_id || '"}'), 1, 16) AS finding_id
  FROM kept)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return evaluate_rules(assertions(spark, sf_dir), subjects(spark, sf_dir), cases(spark, sf_dir), PACKAGE, CLASSES)


@query(
    "rule_findings",
    f"""WITH {_CASES_SQL} SELECT case_id, finding_id, rule_id, confidence, matched_assertions, submitted_drg,
      {group_sql("diagnoses")} AS current_drg, {group_sql("changed")} AS simulated_drg,
      {price_sql("changed")} - {price_sql("diagnoses")} AS estimated_impact_cents FROM findings""",
)
def rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = _evaluated(spark, sf_dir)
    return findings.select(
        "case_id",
        "finding_id",
        "rule_id",
        "confidence",
        "matched_assertions",
        "submitted_drg",
        "current_drg",
        "simulated_drg",
        "estimated_impact_cents",
    )


@query(
    "rule_lineage",
    f"""WITH {_CASES_SQL}, cited AS (
      SELECT case_id, rule_id, confidence, assertion_id, 'assertion' AS kind, assertion_id AS item_id FROM matched
      UNION ALL SELECT case_id, rule_id, confidence, assertion_id, 'subject', 'S-' || event_type FROM matched
      UNION ALL SELECT case_id, rule_id, confidence, assertion_id, 'evidence', 'EV-' || event_type || '-' || whole FROM matched
      UNION ALL SELECT case_id, rule_id, confidence, assertion_id, 'contradicting', 'CO-' || whole FROM matched WHERE k < 5),
    firsts AS (SELECT *, row_number() OVER (PARTITION BY case_id, rule_id, kind, item_id ORDER BY confidence DESC, assertion_id) AS rn
      FROM cited)
    SELECT finding_id, kind, item_id, assertion_id AS first_assertion_id
    FROM firsts JOIN findings USING (case_id, rule_id) WHERE rn = 1""",
)
def rule_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited ids of every finding, each with the assertion that cites it first."""
    _, lineage = _evaluated(spark, sf_dir)
    return lineage.select("finding_id", "kind", "item_id", F.col("_first.a").alias("first_assertion_id"))


_SCOPES = ((["Therapy"], True), (["Therapy"], False), (["Item"], True), (["Equipment", "Infusion"], False))


@query(
    "rule_scoped_findings",
    """WITH typed AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'Infusion' WHEN 'view' THEN 'Dialysis'
        WHEN 'signup' THEN 'Therapy' ELSE 'Equipment' END AS class FROM events)
    SELECT user_id, scope, count(*) AS matches FROM typed JOIN (VALUES (0), (1), (2), (3)) s(scope) ON CASE scope
      WHEN 0 THEN class IN ('Therapy', 'Infusion', 'Dialysis') WHEN 1 THEN class = 'Therapy' WHEN 2 THEN TRUE
      ELSE class IN ('Equipment', 'Infusion') END
    GROUP BY user_id, scope""",
)
def rule_scoped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions in scope of each class list, with and without subtypes."""
    package = {
        **PACKAGE,
        "rules": [
            {**PACKAGE["rules"][0], "rule_id": str(i), "applies_to": {"subject_types": names, "include_subtypes": deep},
             "when": {"field": "status", "op": "eq", "value": "present"}}
            for i, (names, deep) in enumerate(_SCOPES)
        ],
    }
    matched = match_assertions(assertions(spark, sf_dir), subjects(spark, sf_dir), package, CLASSES)
    return matched.groupBy(F.col("case_id").alias("user_id"), F.col("rule_index").alias("scope")).agg(
        F.count(F.lit(1)).alias("matches")
    )


_LINE_RULES = [
    {"rule_id": "not-returned", "when": {"not": {"field": "flag", "op": "eq", "value": "R"}}},
    {"rule_id": "differs", "when": {"field": "flag", "op": "ne", "value": "R"}},
    {"rule_id": "unknown-flag", "when": {"field": "flag", "op": "exists", "value": False}},
    {"rule_id": "lacks-letter", "when": {"field": "flag", "op": "not_contains", "value": "A"}},
    {
        "rule_id": "large-or-cheap",
        "when": {
            "any": [
                {"field": "quantity", "op": "gte", "value": 45},
                {"all": [{"field": "quantity", "op": "lte", "value": 2}, {"not": {"field": "flag", "op": "exists", "value": True}}]},
            ]
        },
    },
    {"rule_id": "mismatch", "when": {"not": {"field": "quantity", "op": "eq", "value": "17"}}},
]


@query(
    "negated_rules",
    """WITH lines AS (SELECT l_orderkey, nullif(l_returnflag, 'N') AS flag, l_quantity AS q FROM lineitem)
    SELECT rule_id, l_orderkey, count(*) AS matches FROM lines JOIN (VALUES ('not-returned'), ('differs'), ('unknown-flag'),
      ('lacks-letter'), ('large-or-cheap'), ('mismatch')) r(rule_id) ON CASE rule_id
        WHEN 'not-returned' THEN NOT coalesce(flag = 'R', FALSE) WHEN 'differs' THEN coalesce(flag <> 'R', FALSE)
        WHEN 'unknown-flag' THEN flag IS NULL WHEN 'lacks-letter' THEN coalesce(NOT contains(flag, 'A'), FALSE)
        WHEN 'large-or-cheap' THEN q >= 45 OR (q <= 2 AND flag IS NULL) ELSE TRUE END
    GROUP BY rule_id, l_orderkey""",
)
def negated_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-valued conditions over a column that is often absent."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("flag"), F.col("l_quantity").alias("quantity")
    )
    kinds = {"flag": "string", "quantity": "number"}
    matched = evaluate_flat(lines, _LINE_RULES, lambda path: Typed(F.col(path), kinds[path]))
    return matched.groupBy("rule_id", "l_orderkey").agg(F.count(F.lit(1)).alias("matches"))


# Fixed values of the binding: the diagnosis code of each part type.
TYPE_CODE = {
    "LARGE": "L89.154",
    "STANDARD": "A41.9",
    "ECONOMY": "I10",
    "SMALL": "L89.213",
    "MEDIUM": "E11.9",
    "PROMO": "L97.4",
}


def coded_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the distinct diagnosis codes of their finished lines, first seen first."""
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_linestatus") == "F").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), choose(F.col("p_type"), TYPE_CODE).alias("code"))
    return collect_codes(lines.join(part, "l_partkey"), "l_orderkey", "code", "l_linenumber", "diagnoses")


_CLAIMS_SQL = """claims AS (
  SELECT l_orderkey, list(code ORDER BY first_row, code) AS diagnoses FROM (
    SELECT l_orderkey, CASE p_type WHEN 'LARGE' THEN 'L89.154' WHEN 'STANDARD' THEN 'A41.9' WHEN 'ECONOMY' THEN 'I10'
        WHEN 'SMALL' THEN 'L89.213' WHEN 'MEDIUM' THEN 'E11.9' WHEN 'PROMO' THEN 'L97.4' END AS code, min(l_linenumber) AS first_row
    FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY l_orderkey)"""


@query(
    "group_and_price",
    f"""WITH {_CLAIMS_SQL} SELECT l_orderkey, array_to_string(diagnoses, '|') AS diagnoses, {group_sql("diagnoses")} AS drg,
      {price_sql("diagnoses")} AS cents FROM claims""",
)
def group_and_price_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = coded_claims(spark, sf_dir).withColumn("_g", group_and_price(F.col("diagnoses")))
    return priced.select(
        "l_orderkey",
        F.concat_ws("|", "diagnoses").alias("diagnoses"),
        F.col("_g.group").alias("drg"),
        F.col("_g.cents").alias("cents"),
    )


@query(
    "group_reproduction",
    f"""WITH {_CASES_SQL} SELECT case_id, drg AS submitted_drg, {group_sql("diagnoses")} AS current_drg,
      {price_sql("diagnoses")} - allowed_amount_cents AS estimated_impact_cents,
      CASE WHEN allowed_amount_cents IS NULL THEN 'unavailable' ELSE 'estimated' END AS impact_status,
      'finding-' || substr(sha256('{{"case_id":' || case_id || ',"check":"drg-reproduction","grouper_version":"demo-0.2-not-for-billing","reproduced_drg":"'
        || {group_sql("diagnoses")} || '","submitted_drg":"' || drg || '"}}'), 1, 16) AS finding_id
    FROM cases WHERE drg IS NOT NULL AND drg <> {group_sql("diagnoses")}""",
)
def group_reproduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reproduction_findings(cases(spark, sf_dir)).select(
        "case_id", "submitted_drg", "current_drg", "estimated_impact_cents", "impact_status", "finding_id"
    )


def _codes(*codes: str) -> Column:
    return F.array(*[F.lit(code) for code in codes])


@query(
    "whatif_impact",
    f"""WITH {_CLAIMS_SQL}, changed AS (SELECT *, list_filter(diagnoses, lambda x: x <> 'A41.9') AS kept FROM claims),
    simulated AS (SELECT *, CASE WHEN list_contains(kept, 'L89.154') THEN kept ELSE list_concat(kept, ['L89.154']) END AS after
      FROM changed)
    SELECT l_orderkey, array_to_string(after, '|') AS simulated_codes, {group_sql("diagnoses")} AS current_drg,
      {group_sql("after")} AS simulated_drg, {price_sql("after")} - {price_sql("diagnoses")} AS impact_cents FROM simulated""",
)
def whatif_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price difference when one code is removed and another added."""
    claims = coded_claims(spark, sf_dir)
    after = apply_change(F.col("diagnoses"), _codes("L89.154", "L89.154"), _codes("A41.9"))
    simulated = claims.withColumn("_after", after).withColumns(
        {"_base": group_and_price(F.col("diagnoses")), "_sim": group_and_price(F.col("_after"))}
    )
    return simulated.select(
        "l_orderkey",
        F.concat_ws("|", "_after").alias("simulated_codes"),
        F.col("_base.group").alias("current_drg"),
        F.col("_sim.group").alias("simulated_drg"),
        (F.col("_sim.cents") - F.col("_base.cents")).alias("impact_cents"),
    )
