"""Run a declarative mapping: resources in, normalized case tables and rejects out."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from claimweave.functions import text
from claimweave.functions.canonical import canonical_json, multiset_fingerprint, row_digest
from claimweave.functions.conditions import row_filter
from claimweave.functions.transforms import (
    Compiled,
    compile_expr,
    optional_string,
    referenced_fields,
    required_datetime,
    required_string,
)
from claimweave.operators.attach import attach_children, attach_collections, collect_codes, dedup_or_conflict
from claimweave.operators.profile import schema_fingerprint
from claimweave.operators.scale import count_per_key, reasons
from claimweave.session import materialize

RUNTIME_VERSION = "1.0.0"
EXECUTABLE = ("approved", "approved-for-demo")
OUTPUTS = ("cases", "documents", "claims", "structured")


def _errors(columns: Mapping[str, Compiled]) -> Column:
    return F.array_compact(
        F.array(
            *[
                F.when(item.error.isNotNull(), F.concat(F.lit(f"{name} "), item.error))
                for name, item in columns.items()
            ]
        )
    )


def project_rows(
    df: DataFrame, columns: Mapping[str, Compiled], keep: Sequence[str] = ("_row_number",)
) -> tuple[DataFrame, DataFrame]:
    """Evaluate compiled expressions; rows with errors become rejects with all of them."""
    return _split(_projected(df, columns, keep))


def _projected(df: DataFrame, columns: Mapping[str, Compiled], keep: Sequence[str]) -> DataFrame:
    kept = [name for name in keep if name in df.columns]
    values = [item.value.alias(name) for name, item in columns.items()]
    return df.select(*kept, *values, _errors(columns).alias("violations"))


def _split(projected: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        projected.filter(F.size("violations") == 0).drop("violations"),
        projected.filter(F.size("violations") > 0),
    )


def _staged_rows(df: DataFrame, columns: Mapping[str, Compiled], name: str) -> tuple[DataFrame, DataFrame]:
    """Like :func:`project_rows`, with the projected resource written once.

    Several outputs and checks read the rows of a resource; they then scan the
    stored columns they need and evaluate no expression again.
    """
    return _split(materialize(_projected(df, columns, ("_row_number",)), f"mapping-{name}"))


def _open_map(fields: Mapping[str, Mapping[str, Any]]) -> Compiled:
    """An open map of expressions as a variant; any failing entry fails the row."""
    compiled = {name: compile_expr(expression) for name, expression in fields.items()}
    body = canonical_json(**{name: item.value for name, item in compiled.items()}) if compiled else F.lit("{}")
    error = F.coalesce(F.lit(None).cast("string"), *[item.error for item in compiled.values()])
    names = frozenset().union(*[item.fields for item in compiled.values()])
    return Compiled(F.parse_json(body), error, names)


def _constant(value: Any, kind: str) -> Compiled:
    return Compiled(F.lit(value).cast(kind), F.lit(None).cast("string"), frozenset())


def mapping_fields(mapping: Mapping[str, Any]) -> list[tuple[str, str, str]]:
    """``(resource, location, field)`` of everything a mapping reads."""
    out: list[tuple[str, str, str]] = []

    def visit(resource: str, location: str, value: Any) -> None:
        if isinstance(value, Mapping):
            if "op" in value and "field" in value:
                out.append((resource, location, value["field"]))
            elif "field" in value or "template" in value:
                out.extend((resource, location, field) for field in sorted(referenced_fields(value)))
            else:
                for name, item in value.items():
                    visit(resource, f"{location}.{name}", item)
        elif isinstance(value, list):
            for index, item in enumerate(value):
                visit(resource, f"{location}[{index}]", item)

    visit(mapping["encounter"]["resource"], "encounter", mapping["encounter"])
    for index, binding in enumerate(mapping.get("documents", ())):
        visit(binding["resource"], f"documents[{index}]", binding)
    claim = dict(mapping["claim"])
    for name in ("diagnoses", "procedures", "charges"):
        binding = claim.pop(name, None)
        if binding:
            visit(binding["resource"], f"claim.{name}", binding)
    visit(claim["resource"], "claim", claim)
    for projection in mapping.get("structured_projections", ()):
        location = f"projection.{projection['projection_id']}"
        visit(projection["resource"], location, projection)
        for field in projection["evidence"].get("field_names", ()):
            out.append((projection["resource"], f"{location}.evidence.field_names", field))
    return out


def check_mapping(
    spark: SparkSession,
    mapping: Mapping[str, Any],
    profiles: DataFrame,
    classes: DataFrame,
    relations: DataFrame,
    artifact_of: Mapping[str, str],
) -> DataFrame:
    """All faults of a mapping against profiled columns and the ontology, as rows."""
    fields = spark.createDataFrame(
        [(artifact_of[resource], location, field) for resource, location, field in mapping_fields(mapping)],
        "artifact string, location string, column_name string",
    )
    unknown_fields = fields.join(profiles.select("artifact", "column_name"), ["artifact", "column_name"], "left_anti").select(
        "location", F.concat(F.lit("unknown field "), "column_name").alias("error")
    )
    resources = spark.createDataFrame(list(artifact_of.items()), "resource string, artifact string")
    unknown_artifacts = resources.join(profiles.select("artifact").distinct(), "artifact", "left_anti").select(
        F.col("resource").alias("location"), F.concat(F.lit("unknown artifact "), "artifact").alias("error")
    )
    used_classes, used_relations = [("", "")], [("", "")]
    for projection in mapping.get("structured_projections", ()):
        name = projection["projection_id"]
        used_classes += [(name, entity["entity_type"]) for entity in projection.get("entities", ())]
        used_relations += [(name, relation["predicate"]) for relation in projection.get("relations", ())]
    class_rows = spark.createDataFrame(used_classes, "location string, class_id string").filter("location <> ''")
    relation_rows = spark.createDataFrame(used_relations, "location string, relation_id string").filter("location <> ''")
    class_faults = (
        class_rows.join(classes.select("class_id", "abstract", F.lit(True).alias("_known")), "class_id", "left")
        .withColumn(
            "error",
            F.when(F.col("_known").isNull(), F.concat(F.lit("unknown class "), "class_id")).when(
                F.col("abstract"), F.concat(F.lit("abstract class "), "class_id")
            ),
        )
        .filter(F.col("error").isNotNull())
        .select("location", "error")
    )
    relation_faults = relation_rows.join(relations.select("relation_id"), "relation_id", "left_anti").select(
        "location", F.concat(F.lit("unknown relation "), "relation_id").alias("error")
    )
    return unknown_fields.unionByName(unknown_artifacts).unionByName(class_faults).unionByName(relation_faults)


def _rejects(resource: str, df: DataFrame) -> DataFrame:
    row = F.col("_row_number") if "_row_number" in df.columns else F.lit(None)
    return df.select(F.lit(resource).alias("resource"), row.cast("bigint").alias("row_number"), "violations")


def run_mapping(
    resources: Mapping[str, DataFrame],
    mapping: Mapping[str, Any],
    *,
    as_of: str,
    outputs: Sequence[str] = OUTPUTS,
    unread: Mapping[str, DataFrame] | None = None,
    profiles: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Tables ``cases, documents, claims, evidence, entities, relations, assertions`` and ``rejects``.

    Every table is keyed by ``encounter_id``.  A row that fails, or whose parent
    failed, appears in ``rejects``.  ``outputs`` names the parts to build (the
    four structured tables are ``structured``); resources of other parts are not
    read.  ``unread`` holds what the readers of the resources rejected; it joins the rejects.  ``profiles`` are the columns of
    the resources as profiled now: a mapping that was written for others is refused.

    With all parts every table is written once, in the shared folder; its row count and fingerprint are observed while it is
    written.  ``report`` lists them next to the counts of the inputs, and ``reject_report`` counts
    the rejects by resource and reason.
    """
    if mapping["status"] not in EXECUTABLE:
        raise ValueError("mapping must be approved before it runs")
    if profiles is not None:
        now = schema_fingerprint(profiles).head()["fingerprint"]
        if now != mapping["source_schema_fingerprint"]:
            raise ValueError(f"schema drift: mapped {mapping['source_schema_fingerprint']}, profiled {now}")
    cases, rejects = _encounters(resources, mapping, as_of)
    known = cases.select("encounter_id")
    tables = {"cases": cases}
    if "documents" in outputs:
        tables["documents"], found = _documents(resources, mapping, known)
        rejects += found
    if "claims" in outputs:
        tables["claims"], found = _claims(resources, mapping, known)
        rejects += found
    if "structured" in outputs:
        structured, found = _projections(resources, mapping, known)
        tables |= structured
        rejects += found
    rejects += [_rejects(name, df) for name, df in (unread or {}).items()]
    tables["rejects"] = reduce(lambda a, b: a.unionByName(b), rejects)
    if set(outputs) == set(OUTPUTS):
        return account(resources, tables)
    return tables


def account(inputs: Mapping[str, DataFrame], tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of a run, each written once with its metrics observed on the way, ``report`` and ``reject_report``."""
    stored, metrics = {}, []
    for name, table in tables.items():
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        # An observed metric computes its expressions anew in every sum, so the digest is a column first.
        digested = table.withColumn("_digest", row_digest(table, table.columns))
        observed = digested.observe(seen, F.count(F.lit(1)).alias("rows"), multiset_fingerprint(F.col("_digest")).alias("fingerprint"))
        stored[name] = materialize(observed.drop("_digest"), f"run-{name}")
        metrics.append(("output", name, seen.get["rows"], seen.get["fingerprint"]))
    spark = stored["rejects"].sparkSession
    written = spark.createDataFrame(metrics, "side string, table_name string, rows bigint, fingerprint string")
    stored["report"] = run_report(inputs).withColumn("fingerprint", F.lit(None).cast("string")).unionByName(written)
    # A violation is a reason, or an expression and its reason, each with a value after it.
    reason = F.regexp_replace(F.col("violation"), r"(?<=[a-z_]) (?=[A-Z0-9]).*$|:.*$", "")
    found = stored["rejects"].select("resource", F.explode("violations").alias("violation"))
    stored["reject_report"] = found.groupBy("resource", reason.alias("reason")).agg(F.count(F.lit(1)).alias("rows"))
    return stored


def _encounters(resources, mapping, as_of) -> tuple[DataFrame, list[DataFrame]]:
    binding = mapping["encounter"]
    source = row_filter(resources[binding["resource"]], binding.get("where", ()))
    columns = {name: required_string(binding[name]) for name in ("case_id", "patient_id", "encounter_id")}
    columns |= {name: required_datetime(binding[name]) for name in ("admitted_at", "discharged_at")}
    columns["metadata"] = _open_map(binding.get("metadata", {}))
    rows, bad = _staged_rows(source, columns, "encounters")
    repeated = count_per_key(rows, ["encounter_id"]).filter("_count > 1").select("encounter_id", F.lit(True).alias("_repeated"))
    checked = rows.join(repeated, "encounter_id", "left").withColumn(
        "violations",
        reasons(
            duplicate_encounter=F.col("_repeated"),
            admission_after_discharge=text.instant(F.col("admitted_at")) > text.instant(F.col("discharged_at")),
        ),
    )
    ok = checked.filter(F.size("violations") == 0).drop("violations", "_repeated", "_row_number")
    provenance = F.struct(
        F.lit(mapping["adapter_id"]).alias("adapter_id"),
        F.lit(mapping["version"]).alias("adapter_version"),
        F.lit(mapping["source_schema_fingerprint"]).alias("source_schema_fingerprint"),
        F.lit(as_of).alias("transformed_at"),
        F.lit(RUNTIME_VERSION).alias("runtime_version"),
    )
    name = binding["resource"]
    return (
        ok.withColumn("ingestion_provenance", provenance),
        [_rejects(name, bad), _rejects(name, checked.filter(F.size("violations") > 0))],
    )


def _documents(resources, mapping, known) -> tuple[DataFrame, list[DataFrame]]:
    parts, rejects = [], []
    for binding in mapping.get("documents", ()):
        source = row_filter(resources[binding["resource"]], binding.get("where", ()))
        columns = {name: required_string(binding[name]) for name in ("encounter_id", "document_id", "author_role")}
        columns["recorded_at"] = required_datetime(binding["recorded_at"])
        columns["text"] = required_string(binding["text"])
        rows, bad = _staged_rows(source, columns, "documents")
        parts.append(rows)
        rejects.append(_rejects(binding["resource"], bad))
    if not parts:
        empty = known.select("encounter_id", *[F.lit("").alias(c) for c in ("document_id", "author_role", "recorded_at", "text")])
        return empty.filter(F.lit(False)), rejects
    ok, bad = attach_children(known, reduce(lambda a, b: a.unionByName(b), parts), "encounter_id", "document_id")
    rejects.append(_rejects("documents", bad))
    return ok.drop("_row_number"), rejects


def _claims(resources, mapping, known) -> tuple[DataFrame, list[DataFrame]]:
    binding = mapping["claim"]
    source = row_filter(resources[binding["resource"]], binding.get("where", ()))
    columns = {"encounter_id": required_string(binding["encounter_id"])}
    columns["drg"] = optional_string(binding["drg"]) if "drg" in binding else _constant(None, "string")
    if "allowed_amount_cents" in binding:
        amount = compile_expr(binding["allowed_amount_cents"])
        negative = F.when(amount.value < 0, F.lit("negative_amount"))
        columns["allowed_amount_cents"] = Compiled(amount.value, F.coalesce(amount.error, negative), amount.fields)
    else:
        columns["allowed_amount_cents"] = _constant(None, "bigint")
    rows, bad = _staged_rows(source, columns, "claims")
    rejects = [_rejects(binding["resource"], bad)]
    counts = count_per_key(rows, ["encounter_id"], "_claims")
    parents = known.withColumn("_known", F.lit(True))
    checked = (
        rows.join(parents, "encounter_id", "left")
        .join(counts, "encounter_id", "left")
        .withColumn(
            "violations", reasons(unknown_encounter=F.col("_known").isNull(), multiple_claims=F.col("_claims") > 1)
        )
    )
    rejects.append(_rejects(binding["resource"], checked.filter(F.size("violations") > 0)))
    missing = known.join(rows.select("encounter_id"), "encounter_id", "left_anti").select(
        F.array(F.concat(F.lit("missing_claim "), "encounter_id")).alias("violations")
    )
    rejects.append(_rejects("encounters", missing))
    claims = checked.filter(F.size("violations") == 0).drop("violations", "_known", "_claims", "_row_number")
    collections = {}
    for name in ("diagnoses", "procedures", "charges"):
        part = binding.get(name)
        if not part:
            claims = claims.withColumn(name, F.array().cast("array<string>"))
            continue
        codes, bad = _staged_rows(
            row_filter(resources[part["resource"]], part.get("where", ())),
            {"encounter_id": required_string(part["encounter_id"]), "value": required_string(part["value"])},
            name,
        )
        orphan = codes.join(known, "encounter_id", "left_anti").withColumn("violations", F.array(F.lit("unknown_encounter")))
        rejects += [_rejects(part["resource"], bad), _rejects(part["resource"], orphan)]
        collections[name] = collect_codes(codes, "encounter_id", "value", "_row_number", name)
    return attach_collections(claims, collections, "encounter_id"), rejects


def _projections(resources, mapping, known) -> tuple[dict[str, DataFrame], list[DataFrame]]:
    """Evidence, entities, relations and assertions of all structured projections."""
    parts: dict[str, list[DataFrame]] = {"evidence": [], "entities": [], "relations": [], "assertions": []}
    rejects: list[DataFrame] = []
    for projection in mapping.get("structured_projections", ()):
        resource = projection["resource"]
        source = row_filter(resources[resource], projection.get("where", ()))
        compiled = _projection_columns(projection)
        rows, bad = _staged_rows(source, compiled, "structured")
        orphan = rows.join(known, "encounter_id", "left_anti").withColumn("violations", F.array(F.lit("unknown_encounter")))
        rejects += [_rejects(resource, bad), _rejects(resource, orphan)]
        rows = rows.join(known, "encounter_id", "left_semi")
        locator = F.struct(
            F.lit(mapping["adapter_id"]).alias("adapter_id"),
            F.lit(mapping["version"]).alias("adapter_version"),
            F.lit(resource).alias("resource"),
            F.lit(mapping["resources"][resource]["path"]).alias("path"),
            F.col("_row_number").alias("row_number"),
            F.col("source_record_id").alias("source_record_id"),
            F.array(*[F.lit(name) for name in projection["evidence"].get("field_names", ())]).alias("field_names"),
        )
        parts["evidence"].append(
            rows.select("encounter_id", "evidence_id", "document_id", "author_role", "recorded_at", "text", locator.alias("source_locator"))
        )
        for kind in ("entities", "relations", "assertions"):
            count = len(projection.get(kind, ()))
            if count:
                structs = F.array(*[_item(kind, projection, index) for index in range(count)])
                parts[kind].append(rows.select("encounter_id", F.explode(structs).alias("_item")).select("encounter_id", "_item.*"))
    tables = {}
    keys = {"evidence": "evidence_id", "entities": "entity_id", "relations": "relation_id", "assertions": "assertion_id"}
    for kind, found in parts.items():
        if not found:
            continue
        ok, conflicts = dedup_or_conflict(reduce(lambda a, b: a.unionByName(b), found), ["encounter_id", keys[kind]])
        tables[kind] = ok
        rejects.append(_rejects(kind, conflicts))
    return tables, rejects


def _projection_columns(projection: Mapping[str, Any]) -> dict[str, Compiled]:
    evidence = projection["evidence"]
    columns = {
        "encounter_id": required_string(projection["encounter_id"]),
        "source_record_id": required_string(projection["source_record_id"]),
        **{name: required_string(evidence[name]) for name in ("evidence_id", "document_id", "author_role", "text")},
        "recorded_at": required_datetime(evidence["recorded_at"]),
    }
    for index, entity in enumerate(projection.get("entities", ())):
        columns[f"e{index}_entity_id"] = required_string(entity["entity_id"])
        columns[f"e{index}_label"] = required_string(entity["label"])
        columns[f"e{index}_properties"] = _open_map(entity.get("properties", {}))
    for index, relation in enumerate(projection.get("relations", ())):
        for name in ("relation_id", "source_id", "target_id"):
            columns[f"r{index}_{name}"] = required_string(relation[name])
    for index, assertion in enumerate(projection.get("assertions", ())):
        columns[f"a{index}_assertion_id"] = required_string(assertion["assertion_id"])
        columns[f"a{index}_subject_id"] = required_string(assertion["subject_id"])
        columns[f"a{index}_attributes"] = _open_map(assertion.get("attributes", {}))
    return columns


def _item(kind: str, projection: Mapping[str, Any], index: int) -> Column:
    spec = projection[kind][index]
    none = F.array().cast("array<string>")
    if kind == "entities":
        return F.struct(
            F.col(f"e{index}_entity_id").alias("entity_id"),
            F.lit(spec["entity_type"]).alias("entity_type"),
            F.col(f"e{index}_label").alias("label"),
            F.to_json(f"e{index}_properties").alias("properties"),
        )
    fixed = [F.lit(spec[name]).alias(name) for name in ("documentation_status",)] + [
        F.lit(float(spec["confidence"])).alias("confidence")
    ]
    if kind == "relations":
        cited = F.array("evidence_id") if spec.get("cite_evidence") else none
        return F.struct(
            F.col(f"r{index}_relation_id").alias("relation_id"),
            F.lit(spec["predicate"]).alias("predicate"),
            F.col(f"r{index}_source_id").alias("source_id"),
            F.col(f"r{index}_target_id").alias("target_id"),
            F.lit(spec["assertion_status"]).alias("assertion_status"),
            *fixed,
            cited.alias("evidence_ids"),
            none.alias("contradicting_evidence_ids"),
        )
    return F.struct(
        F.col(f"a{index}_assertion_id").alias("assertion_id"),
        F.col(f"a{index}_subject_id").alias("subject_id"),
        F.lit(spec["concept"]).alias("concept"),
        F.lit(spec["status"]).alias("status"),
        *fixed,
        F.to_json(f"a{index}_attributes").alias("attributes"),
        F.array("evidence_id").alias("evidence_ids"),
        none.alias("contradicting_evidence_ids"),
    )


def run_report(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """Row counts of the input resources; of columnar files only the footers are read."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit("input").alias("side"), F.lit(name).alias("table_name"), "rows")
        for name, table in sorted(inputs.items())
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
