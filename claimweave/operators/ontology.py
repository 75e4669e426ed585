"""Class hierarchy, instance graph checks and graph merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.functions.canonical import canonical_hash
from claimweave.operators.checks import overlap, unknown_references
from claimweave.operators.scale import reasons, split_checked, split_rejects
from claimweave.session import cut_lineage, materialize


@dataclass(frozen=True)
class Ontology:
    """Definition tables: class, relation and value set rows, and the template graph."""

    classes: DataFrame
    relations: DataFrame
    value_sets: DataFrame


def class_closure(classes: DataFrame) -> DataFrame:
    """Reflexive, transitive ``(class_id, ancestor, depth)`` of a single-parent hierarchy of any depth.

    One join of the frontier with the parent table per level, until a level finds no new ancestor, so
    a cycle ends the loop as well.  Every level is stored in the shared folder.
    """
    parent = classes.select(F.col("class_id").alias("ancestor"), F.col("parent").alias("_parent"))
    frontier = classes.select("class_id", F.col("class_id").alias("ancestor"), F.lit(0).cast("bigint").alias("depth"))
    closure = frontier = materialize(frontier, "closure-level")
    while True:
        frontier = (
            frontier.join(parent, "ancestor")
            .filter(F.col("_parent").isNotNull())
            .select("class_id", F.col("_parent").alias("ancestor"), (F.col("depth") + 1).alias("depth"))
            .join(closure.select("class_id", "ancestor"), ["class_id", "ancestor"], "left_anti")
        )
        frontier = materialize(frontier, "closure-level")
        if frontier.isEmpty():
            return closure.groupBy("class_id", "ancestor").agg(F.min("depth").alias("depth"))
        closure = closure.unionByName(frontier)


def reach_root(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rooted, cyclic)`` classes by pointer doubling: log2(depth) joins.

    Every round settles the classes of the next depths.  When a round settles none, those that
    still point somewhere sit on or below a cycle.  Every round is checkpointed.
    """
    known = classes.select(F.col("class_id").alias("parent")).distinct()
    pointers = classes.select("class_id", "parent").join(known.withColumn("_known", F.lit(True)), "parent", "left")
    pointers = pointers.select("class_id", F.when(F.col("_known"), F.col("parent")).alias("pointer"))
    open_before = None
    while (still_open := pointers.filter(F.col("pointer").isNotNull()).count()) != open_before and still_open:
        open_before = still_open
        ahead = pointers.select(F.col("class_id").alias("pointer"), F.col("pointer").alias("_next"))
        pointers = cut_lineage(pointers.join(ahead, "pointer", "left").select("class_id", F.col("_next").alias("pointer")))
    rooted = pointers.filter(F.col("pointer").isNull()).select("class_id")
    return rooted, pointers.filter(F.col("pointer").isNotNull()).select("class_id")


def check_definition(ontology: Ontology) -> DataFrame:
    """Faults of a definition as ``(item, violation)`` rows."""
    classes = ontology.classes
    known = classes.select("class_id").distinct()
    unknown_parent = (
        classes.filter(F.col("parent").isNotNull())
        .join(known.withColumnRenamed("class_id", "parent"), "parent", "left_anti")
        .select(F.col("class_id").alias("item"), F.lit("unknown_parent").alias("violation"))
    )
    unknown_set = (
        classes.filter(F.col("value_set").isNotNull())
        .join(ontology.value_sets.select("value_set").distinct(), "value_set", "left_anti")
        .select(F.col("class_id").alias("item"), F.lit("unknown_value_set").alias("violation"))
    )
    ends = ontology.relations.select(
        F.col("relation_id").alias("item"), F.explode(F.concat("domain", "range")).alias("class_id")
    )
    unknown_class = (
        ends.join(known, "class_id", "left_anti")
        .select("item", F.lit("unknown_class").alias("violation"))
        .distinct()
    )
    _, cyclic = reach_root(classes)
    cycle = cyclic.select(F.col("class_id").alias("item"), F.lit("hierarchy_cycle").alias("violation"))
    return unknown_parent.unionByName(unknown_set).unionByName(unknown_class).unionByName(cycle)


def check_entities(entities: DataFrame, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """Class known and concrete; ``value`` inside the class's value set when it has one."""
    definition = ontology.classes.select(
        F.col("class_id").alias("entity_type"),
        F.col("abstract").alias("_abstract"),
        F.col("value_set").alias("_set"),
        F.lit(True).alias("_class"),
    )
    allowed = ontology.value_sets.select(
        F.col("value_set").alias("_set"), F.col("value"), F.lit(True).alias("_allowed")
    ).distinct()
    joined = entities.join(definition, "entity_type", "left").join(allowed, ["_set", "value"], "left")
    checked = joined.withColumn(
        "violations",
        reasons(
            unknown_class=F.col("_class").isNull(),
            abstract_class=F.col("_abstract"),
            value_not_in_set=F.col("_set").isNotNull() & F.col("_allowed").isNull(),
        ),
    ).drop("_abstract", "_set", "_class", "_allowed")
    return split_checked(checked)


def check_relations(
    relations: DataFrame,
    entities: DataFrame,
    evidence: DataFrame,
    ontology: Ontology,
    closure: DataFrame,
    scope: Sequence[str] = ("case_id",),
) -> tuple[DataFrame, DataFrame]:
    return split_checked(checked_relations(relations, entities, evidence, ontology, closure, scope))


def checked_relations(
    relations: DataFrame,
    entities: DataFrame,
    evidence: DataFrame,
    ontology: Ontology,
    closure: DataFrame,
    scope: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Known predicate, endpoint classes within domain and range, and evidence rules.

    A relation end is fine when its class has any allowed class among its
    ancestors; the allowed classes and the closure are joined as tables, so
    neither the graph nor the hierarchy is ever held by one task.
    """
    scope = list(scope)
    key = [*scope, "relation_id"]
    definition = ontology.relations.select(F.col("relation_id").alias("predicate"), "requires_evidence", F.lit(True).alias("_predicate"))
    types = entities.select(*scope, "entity_id", "entity_type")
    # The lists of a relation become flags first, so the joins carry no lists that the caller does not select.
    flagged = relations.withColumns(
        {"_bare": F.size("evidence_ids") == 0, "_overlap": overlap(F.col("evidence_ids"), F.col("contradicting_evidence_ids"))}
    )
    typed = (
        flagged.join(
            types.withColumnsRenamed({"entity_id": "source_id", "entity_type": "_source_type"}), [*scope, "source_id"], "left"
        )
        .join(types.withColumnsRenamed({"entity_id": "target_id", "entity_type": "_target_type"}), [*scope, "target_id"], "left")
        .join(definition, "predicate", "left")
    )

    def permitted(side: str, type_column: str, flag: str) -> DataFrame:
        allowed = ontology.relations.select(F.col("relation_id").alias("predicate"), F.explode(side).alias("ancestor"))
        return (
            allowed.join(closure.select("class_id", "ancestor"), "ancestor")
            .select("predicate", F.col("class_id").alias(type_column), F.lit(True).alias(flag))
            .distinct()
        )

    typed = typed.join(permitted("domain", "_source_type", "_in_domain"), ["predicate", "_source_type"], "left").join(
        permitted("range", "_target_type", "_in_range"), ["predicate", "_target_type"], "left"
    )
    cited = F.concat("evidence_ids", "contradicting_evidence_ids")
    unknown = (
        unknown_references(relations, key, cited, evidence, ["evidence_id"], scope=scope)
        .select(*key, F.lit(True).alias("_unknown"))
        .distinct()
    )
    return typed.join(unknown, key, "left").withColumn(
        "violations",
        reasons(
            unknown_endpoint=F.col("_source_type").isNull() | F.col("_target_type").isNull(),
            unknown_predicate=F.col("_predicate").isNull(),
            invalid_source=F.col("_predicate") & F.col("_source_type").isNotNull() & F.col("_in_domain").isNull(),
            invalid_target=F.col("_predicate") & F.col("_target_type").isNotNull() & F.col("_in_range").isNull(),
            requires_evidence=F.col("requires_evidence") & F.col("_bare"),
            overlap=F.col("_overlap"),
            unknown_evidence=F.col("_unknown"),
        ),
    ).drop("_bare", "_overlap", "_source_type", "_target_type", "_predicate", "_in_domain", "_in_range", "_unknown", "requires_evidence")


def structural_rows(cases: DataFrame, template: Sequence[Mapping[str, object]], case: str = "case_id") -> DataFrame:
    """The template rows (a handful of literals) repeated for every case."""
    rows = F.array(
        *[F.struct(*[F.lit(value).alias(name) for name, value in row.items()]) for row in template]
    )
    return cases.select(case, F.explode(rows).alias("_row")).select(case, "_row.*")


def merge_graph(fragments: Sequence[DataFrame], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Union of graph fragments; ids that occur in more than one row are collisions."""
    merged = fragments[0]
    for fragment in fragments[1:]:
        merged = merged.unionByName(fragment)
    copies = merged.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    unique = copies.filter(F.col("copies") == 1).select(*keys)
    return merged.join(unique, list(keys), "left_semi"), copies.filter(F.col("copies") > 1)


def definition_digest(classes: DataFrame, relations: DataFrame) -> DataFrame:
    """Digest of a definition: rows and lists in order, labels and sources of it aside.

    A definition is a bounded configuration (tens of classes), hence the sorted
    list; tables of data use the order-insensitive fingerprint instead.
    """
    class_rows = F.array_sort(F.collect_list(F.struct("class_id", "parent", "abstract", "value_set")))
    relation_rows = F.array_sort(
        F.collect_list(
            F.struct("relation_id", F.array_sort("domain").alias("domain"), F.array_sort("range").alias("range"), "requires_evidence")
        )
    )
    parts = classes.agg(canonical_hash(classes=class_rows).alias("part")).unionByName(
        relations.agg(canonical_hash(relations=relation_rows).alias("part"))
    )
    return parts.agg(F.sha2(F.concat_ws(":", F.array_sort(F.collect_list("part"))), 256).alias("digest"))


def crosswalk(df: DataFrame, mapping: DataFrame, target_system: str) -> tuple[DataFrame, DataFrame]:
    """Translate codes through a governed map; codes without a mapping fail closed."""
    governed = mapping.filter(F.col("target_system") == target_system).select(
        "system", "code", "target_code", "equivalence", "mapping_version"
    )
    joined = df.join(governed, ["system", "code"], "left")
    return split_rejects(joined, reasons(no_governed_mapping=F.col("mapping_version").isNull()))
