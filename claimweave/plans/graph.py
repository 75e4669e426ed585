"""Hierarchies and instance graphs over regions, nations, customers, suppliers and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.canonical import dataset_fingerprint
from claimweave.operators.ontology import (
    Ontology,
    check_definition,
    check_entities,
    checked_relations,
    class_closure,
    crosswalk,
    definition_digest,
    merge_graph,
    structural_rows,
)
from claimweave.plans.bindings import table, text_id
from claimweave.plans.registry import query
from claimweave.session import materialize


def class_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity > region > nation > customer or supplier."""
    none = F.lit(None).cast("string")

    def level(df: DataFrame, class_id: Column, parent: Column, abstract: bool) -> DataFrame:
        return df.select(class_id.alias("class_id"), parent.alias("parent"), F.lit(abstract).alias("abstract"), none.alias("value_set"))

    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = level(spark.range(1), F.lit("Entity"), none, True)
    regions = level(region, text_id("R-", "r_regionkey"), F.lit("Entity"), True)
    nations = level(nation, text_id("N-", "n_nationkey"), text_id("R-", "n_regionkey"), False)
    customers = level(table(spark, sf_dir, "customer"), text_id("C-", "c_custkey"), text_id("N-", "c_nationkey"), False)
    suppliers = level(table(spark, sf_dir, "supplier"), text_id("S-", "s_suppkey"), text_id("N-", "s_nationkey"), False)
    return root.unionByName(regions).unionByName(nations).unionByName(customers).unionByName(suppliers)


_TREE_SQL = """tree AS (
  SELECT 'Entity' AS class_id, NULL AS parent
  UNION ALL SELECT 'R-' || r_regionkey, 'Entity' FROM region
  UNION ALL SELECT 'N-' || n_nationkey, 'R-' || n_regionkey FROM nation
  UNION ALL SELECT 'C-' || c_custkey, 'N-' || c_nationkey FROM customer
  UNION ALL SELECT 'S-' || s_suppkey, 'N-' || s_nationkey FROM supplier)"""


@query(
    "class_closure",
    f"""WITH RECURSIVE {_TREE_SQL},
    up AS (SELECT class_id, class_id AS ancestor, CAST(0 AS BIGINT) AS depth FROM tree
      UNION ALL SELECT up.class_id, tree.parent, up.depth + 1 FROM up JOIN tree ON up.ancestor = tree.class_id WHERE tree.parent IS NOT NULL)
    SELECT class_id, ancestor, depth FROM up""",
)
def class_closure_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_closure(class_tree(spark, sf_dir))


def _relations(spark: SparkSession) -> DataFrame:
    rows = [
        ("supplies", ["R-1", "R-2"], ["R-1", "R-3"], True),
        ("returns", ["Entity"], ["R-2"], False),
    ]
    return spark.createDataFrame(rows, "relation_id string, domain array<string>, range array<string>, requires_evidence boolean")


@query(
    "relation_domain_range",
    """WITH rels AS (
      SELECT DISTINCT l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || l_returnflag || l_linestatus AS relation_id,
        CASE WHEN l_returnflag = 'R' THEN 'returns' WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'audits' ELSE 'supplies' END AS predicate,
        s.s_nationkey AS s_nation, c.c_nationkey AS c_nation, l_linenumber = 7 AS bare, o_orderstatus = 'F' AS known,
        sn.n_regionkey AS s_region, cn.n_regionkey AS c_region
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier s ON l_suppkey = s_suppkey
        JOIN customer c ON o_custkey = c_custkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey
        JOIN nation cn ON c.c_nationkey = cn.n_nationkey),
    checked AS (SELECT relation_id, predicate, concat_ws('|',
      CASE WHEN predicate = 'audits' THEN 'unknown_predicate' END,
      CASE WHEN predicate = 'supplies' AND s_region NOT IN (1, 2) THEN 'invalid_source' END,
      CASE WHEN (predicate = 'supplies' AND c_region NOT IN (1, 3)) OR (predicate = 'returns' AND c_region <> 2) THEN 'invalid_target' END,
      CASE WHEN predicate = 'supplies' AND bare THEN 'requires_evidence' END,
      CASE WHEN NOT bare AND NOT known THEN 'unknown_evidence' END) AS violations FROM rels)
    SELECT relation_id, predicate, violations FROM checked""",
)
def relation_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as relations from supplier to customer, checked against classes and evidence."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    none = F.array().cast("array<string>")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    predicate = F.when(flag == "R", "returns").when((status == "F") & (flag == "A"), "audits").otherwise("supplies").alias("predicate")
    # Equal relations are found by their numbers, before identifiers are spelled out.
    distinct = lines.join(orders, "l_orderkey").select(*keys, F.concat(flag, status).alias("code"), predicate, "o_custkey").distinct()
    relations = distinct.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in keys], "code").alias("relation_id"),
        "predicate",
        text_id("S-", "l_suppkey").alias("source_id"),
        text_id("C-", "o_custkey").alias("target_id"),
        F.when(F.col("l_linenumber") == 7, none).otherwise(F.array(text_id("O-", "l_orderkey"))).alias("evidence_ids"),
        none.alias("contradicting_evidence_ids"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        text_id("S-", "s_suppkey").alias("entity_id"), text_id("N-", "s_nationkey").alias("entity_type")
    )
    customers = table(spark, sf_dir, "customer").select(
        text_id("C-", "c_custkey").alias("entity_id"), text_id("N-", "c_nationkey").alias("entity_type")
    )
    evidence = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select(text_id("O-", "o_orderkey").alias("evidence_id"))
    classes = materialize(class_tree(spark, sf_dir).filter(~F.col("class_id").rlike("^[CS]-")), "classes")
    closure = materialize(class_closure(classes), "closure")
    ontology = Ontology(classes, _relations(spark), spark.createDataFrame([], "value_set string, value string"))
    checked = checked_relations(relations, suppliers.unionByName(customers), evidence, ontology, closure, scope=[])
    return checked.select("relation_id", "predicate", F.concat_ws("|", "violations").alias("violations"))


@query(
    "graph_entity_checks",
    """SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'unknown_class' WHEN p_type = 'PROMO' THEN 'abstract_class'
      ELSE 'value_not_in_set' END AS violation FROM part
    WHERE p_type IN ('ECONOMY', 'PROMO') OR (p_type IN ('LARGE', 'SMALL') AND p_size > 25)""",
)
def graph_entity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as entities of their type: unknown and abstract types, sizes outside the value set."""
    parts = table(spark, sf_dir, "part")
    kind = F.col("p_type")
    classes = (
        parts.filter(kind != "ECONOMY")
        .select(kind)
        .distinct()
        .select(
            kind.alias("class_id"),
            F.lit(None).cast("string").alias("parent"),
            (kind == "PROMO").alias("abstract"),
            F.when(kind.isin("LARGE", "SMALL"), "sizes").alias("value_set"),
        )
    )
    sizes = parts.filter(F.col("p_size") <= 25).select(F.lit("sizes").alias("value_set"), F.col("p_size").cast("string").alias("value")).distinct()
    entities = parts.select("p_partkey", kind.alias("entity_type"), F.col("p_size").cast("string").alias("value"))
    _, rejects = check_entities(entities, Ontology(classes, _relations(spark), sizes))
    return rejects.select("p_partkey", F.col("violations")[0].alias("violation"))


@query(
    "definition_checks",
    f"""WITH RECURSIVE {_TREE_SQL},
    damaged AS (SELECT class_id, CASE WHEN class_id = 'R-0' THEN 'N-0' ELSE parent END AS parent FROM tree WHERE class_id <> 'R-4'),
    down AS (SELECT class_id FROM damaged WHERE parent IS NULL OR parent NOT IN (SELECT class_id FROM damaged)
      UNION ALL SELECT d.class_id FROM damaged d JOIN down ON d.parent = down.class_id)
    SELECT class_id AS item, 'unknown_parent' AS violation FROM damaged WHERE parent = 'R-4'
    UNION ALL SELECT class_id, 'unknown_value_set' FROM damaged WHERE class_id LIKE 'S-%'
    UNION ALL SELECT class_id, 'hierarchy_cycle' FROM damaged WHERE class_id NOT IN (SELECT class_id FROM down)
    UNION ALL SELECT 'covers', 'unknown_class'""",
)
def definition_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hierarchy with a removed region, a cycle, an unknown value set and an unknown class."""
    damaged = (
        class_tree(spark, sf_dir)
        .filter(F.col("class_id") != "R-4")
        .withColumn("parent", F.when(F.col("class_id") == "R-0", F.lit("N-0")).otherwise(F.col("parent")))
        .withColumn("value_set", F.when(F.startswith("class_id", F.lit("S-")), F.lit("absent")))
    )
    relations = spark.createDataFrame(
        [("covers", ["Entity"], ["R-4"], False)],
        "relation_id string, domain array<string>, range array<string>, requires_evidence boolean",
    )
    return check_definition(Ontology(damaged, relations, spark.createDataFrame([("known", "1")], "value_set string, value string")))


@query(
    "graph_merge",
    """WITH parts AS (
      SELECT c_nationkey AS case_id, 'E-' || CAST(floor(c_acctbal / 10) AS BIGINT) AS entity_id FROM customer
      UNION ALL SELECT s_nationkey, 'E-' || CAST(floor(s_acctbal / 10) AS BIGINT) FROM supplier
      UNION ALL SELECT n_nationkey, e FROM nation, (VALUES ('root:patient'), ('root:encounter'), ('root:claim')) t(e))
    SELECT case_id, entity_id, count(*) AS copies FROM parts GROUP BY ALL""",
)
def graph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template entities and two fragments per nation; ids used twice are collisions."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id"))
    template = [{"entity_id": f"root:{name}"} for name in ("patient", "encounter", "claim")]
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("case_id"), text_id("E-", F.floor(F.col("c_acctbal") / 10)).alias("entity_id")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("case_id"), text_id("E-", F.floor(F.col("s_acctbal") / 10)).alias("entity_id")
    )
    ok, collisions = merge_graph([structural_rows(nations, template), customers, suppliers], ["case_id", "entity_id"])
    return ok.withColumn("copies", F.lit(1).cast("bigint")).unionByName(collisions)


_WORDS_SQL = ", ".join(
    f"CAST(sum(CAST('0x' || substr(d, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8)
)
FINGERPRINT_SQL = f"sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_WORDS_SQL}))"


@query(
    "dataset_fingerprint",
    f"""WITH digests AS (SELECT o_orderpriority, sha256('{{"o_custkey":' || o_custkey || ',"o_orderdate":"'
        || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '","o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus
        || '"}}') AS d FROM orders)
    SELECT o_orderpriority, count(*) AS row_count, {FINGERPRINT_SQL} AS fingerprint FROM digests GROUP BY o_orderpriority""",
)
def dataset_fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-insensitive fingerprint of the orders of each priority."""
    return dataset_fingerprint(
        table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"], ["o_orderpriority"]
    )


@query(
    "definition_digest",
    """WITH c AS (SELECT DISTINCT p_type FROM part),
    classes AS (SELECT sha256('{"classes":[' || string_agg('{"class_id":"' || p_type || '","parent":null,"abstract":'
        || CASE WHEN p_type = 'PROMO' THEN 'true' ELSE 'false' END || ',"value_set":null}', ',' ORDER BY p_type) || ']}') AS d FROM c),
    r AS (SELECT DISTINCT p_brand, list_sort(list(DISTINCT p_type)) AS types FROM part GROUP BY p_brand),
    relations AS (SELECT sha256('{"relations":[' || string_agg('{"relation_id":"' || p_brand || '","domain":["'
        || array_to_string(types, '","') || '"],"range":["' || array_to_string(types, '","') || '"],"requires_evidence":true}', ','
        ORDER BY p_brand) || ']}') AS d FROM r)
    SELECT sha256(least(classes.d, relations.d) || ':' || greatest(classes.d, relations.d)) AS digest FROM classes, relations""",
)
def definition_digest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of a definition whose classes are part types and whose relations are brands."""
    parts = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    kind = F.col("p_type")
    classes = parts.select(kind).distinct().select(
        kind.alias("class_id"),
        F.lit(None).cast("string").alias("parent"),
        (kind == "PROMO").alias("abstract"),
        F.lit(None).cast("string").alias("value_set"),
    )
    types = F.array_sort(F.collect_set("p_type"))
    relations = parts.groupBy(F.col("p_brand").alias("relation_id")).agg(types.alias("domain")).select(
        "relation_id", "domain", F.col("domain").alias("range"), F.lit(True).alias("requires_evidence")
    )
    return definition_digest(classes, relations)


@query(
    "code_crosswalk",
    """SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN 'T-' || lower(p_type) END AS target_code,
      CASE WHEN p_type = 'PROMO' THEN 'no_governed_mapping' ELSE '' END AS violations FROM part""",
)
def code_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types translated through a map that has no entry for one of them."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lit("local").alias("system"), F.col("p_type").alias("code"))
    mapping = (
        parts.filter(F.col("code") != "PROMO")
        .select("system", "code")
        .distinct()
        .select(
            "system",
            "code",
            F.lit("target").alias("target_system"),
            F.concat(F.lit("T-"), F.lower("code")).alias("target_code"),
            F.lit("equivalent").alias("equivalence"),
            F.lit("1").alias("mapping_version"),
        )
    )
    ok, rejects = crosswalk(parts, mapping, "target")
    columns = ["p_partkey", "target_code"]
    return ok.select(*columns, F.lit("").alias("violations")).unionByName(
        rejects.select(*columns, F.concat_ws("|", "violations").alias("violations"))
    )
