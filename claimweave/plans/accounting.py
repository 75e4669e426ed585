"""Nothing is lost unseen: mixed headers, reader rejects, run accounting, gates, tampering and later batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.checks import matching_definitions
from claimweave.operators.decisions import resolve
from claimweave.operators.mapping import run_mapping
from claimweave.operators.packets import PACKET_FIELDS, altered_rows, packet_digest, verify_hash
from claimweave.plans.bindings import AS_OF, table
from claimweave.plans.ingest import _KNOWN_SQL, MAPPING, mapping_resources
from claimweave.plans.registry import query
from claimweave.plans.workflow import _DECISIONS_SQL, admitted_requests, packets
from claimweave.session import materialize, scratch_path
from claimweave.sources.files import Readers, read_csv_checked


@query(
    "scan_mixed_headers",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE o_orderstatus END AS status,
      CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN o_orderpriority END AS priority,
      CASE o_orderkey % 4 WHEN 1 THEN o_clerk END AS clerk,
      CASE o_orderkey % 4 WHEN 3 THEN 'duplicate_header' END AS violation
    FROM (SELECT *, 'clerk, ' || o_custkey AS o_clerk FROM orders)
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'headers of unusable files' WHERE (SELECT count(*) FROM orders WHERE o_orderkey % 4 = 3) > 0""",
)
def scan_mixed_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in files of four layouts, one of them unusable: rows by name, and rejects that add up."""
    path = scratch_path(spark, "mixed-headers")
    key, status, priority = F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")
    clerk = F.concat(F.lit("clerk, "), F.col("o_custkey").cast("string")).alias("clerk")
    layouts = [(key, status, priority), (priority, clerk, key, status), (status, key), ()]
    orders = table(spark, sf_dir, "orders")
    for number, columns in enumerate(layouts):
        if number == 3:  # a name twice
            columns = [F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("key,key")]
        part = orders.filter(F.col("o_orderkey") % 4 == number).select(*columns)
        part.write.option("header", True).option("sep", "," if number < 3 else "\t").csv(f"{path}/layout-{number}")
    rows, rejects = read_csv_checked(spark, f"{path}/*", multi_line=False)
    absent = F.lit(None).cast("string")
    good = rows.select(F.col("key").cast("bigint").alias("o_orderkey"), "status", "priority", "clerk", absent.alias("violation"))
    body = rejects.filter("_row_number > 0")
    number = F.regexp_extract("_corrupt_record", r"^(\d+)", 1).try_cast("bigint")
    bad = body.select(number.alias("o_orderkey"), *[absent.alias(c) for c in ("status", "priority", "clerk")], F.col("violations")[0].alias("violation"))
    heads = rejects.filter("_row_number = 0").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    head = heads.select(F.lit(None).cast("bigint").alias("o_orderkey"), *[absent.alias(c) for c in ("status", "priority", "clerk")], F.lit("headers of unusable files").alias("violation"))
    return good.unionByName(bad).unionByName(head)


@query(
    "scan_rejects",
    """SELECT 'orders' AS resource, CASE WHEN o_orderkey % 7 = 0 THEN 'too_many_cells' ELSE 'read' END AS outcome, count(*) AS rows
    FROM orders GROUP BY ALL
    UNION ALL SELECT 'customers', CASE WHEN c_custkey % 5 = 0 THEN 'not_an_object' ELSE 'read' END, count(*) FROM customer GROUP BY ALL
    UNION ALL SELECT 'suppliers', CASE WHEN s_nationkey % 6 = 0 THEN 'not_an_object' ELSE 'read' END,
      CASE WHEN s_nationkey % 6 = 0 THEN count(DISTINCT s_nationkey) ELSE count(*) END FROM supplier GROUP BY s_nationkey % 6 = 0""",
)
def scan_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reader hands on what it could not read: long records, lines that are no object, broken documents."""
    root = scratch_path(spark, "rejects")
    orders = table(spark, sf_dir, "orders")
    cells = F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus")
    lines = F.when(F.col("o_orderkey") % 7 == 0, F.concat(cells, F.lit(",more"))).otherwise(cells)
    orders.select(lines.alias("key,status")).write.option("header", True).option("sep", "\t").csv(f"{root}/orders")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    line = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("no object "), F.col("c_custkey").cast("string")))
    customers.select(F.coalesce(line, F.to_json(F.struct("c_custkey", "c_name"))).alias("value")).write.text(f"{root}/customers")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # A document per nation; a supplier has one nation, so its rows are as many as the scale gives a nation.
    whole = suppliers.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("s_suppkey", "s_nationkey"))).alias("value"))
    broken = F.when(F.col("s_nationkey") % 6 == 0, F.concat(F.lit("["), F.col("value"))).otherwise(F.col("value"))
    whole.select("s_nationkey", broken.alias("value")).write.partitionBy("s_nationkey").text(f"{root}/suppliers")
    formats = {"orders": "csv", "customers": "jsonl", "suppliers": "json"}
    rows, rejects = Readers().read_all(spark, root, {name: {"path": name, "format": fmt} for name, fmt in formats.items()})
    parts = [df.select(F.lit(name).alias("resource"), F.lit("read").alias("outcome")) for name, df in rows.items()]
    parts += [df.select(F.lit(name).alias("resource"), F.col("violations")[0].alias("outcome")) for name, df in rejects.items()]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.groupBy("resource", "outcome").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "run_accounting",
    f"""WITH {_KNOWN_SQL}, acts AS (SELECT user_id, event_type, props->>'$.k' AS k, user_id IN (SELECT o_orderkey FROM known) AS ok,
        event_type = 'error' AS bad FROM events),
    found AS (
      SELECT 'encounters' AS resource, 'admission_after_discharge' AS reason, count(*) AS rows FROM orders
        WHERE o_orderpriority <> '5-LOW' AND o_orderdate > TIMESTAMP '2000-01-01'
      UNION ALL SELECT 'documents', 'unknown_parent', count(*) FROM documents WHERE doc_id NOT IN (SELECT o_orderkey FROM known)
      UNION ALL SELECT 'claims', 'unknown_encounter', count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM known)
      UNION ALL SELECT 'encounters', 'missing_claim', count(*) FROM known WHERE o_orderstatus = 'P'
      UNION ALL SELECT 'charges', 'unknown_encounter', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_linestatus = 'F' AND l_orderkey NOT IN (SELECT o_orderkey FROM known)
      UNION ALL SELECT 'activity', 'unknown_encounter', count(*) FROM acts WHERE NOT bad AND NOT ok
      UNION ALL SELECT 'activity', 'e0_properties unmapped', count(*) FROM acts WHERE bad
      UNION ALL SELECT 'evidence', 'conflicting_rows', count(*) FROM
        (SELECT user_id, event_type, k FROM acts WHERE ok AND NOT bad GROUP BY ALL HAVING count(*) > 1))
    SELECT * FROM found WHERE rows > 0""",
)
def run_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects of a whole mapping run by resource and reason."""
    return run_mapping(mapping_resources(spark, sf_dir), MAPPING, as_of=AS_OF)["reject_report"]


@query(
    "status_gates",
    """SELECT c_custkey, concat_ws('|', CASE WHEN c_custkey % 3 = 0 THEN 'not_executable' END,
      CASE WHEN c_nationkey % 5 = 4 THEN 'unknown_definition' END,
      CASE WHEN c_nationkey % 5 = 1 THEN 'definition_not_executable' END,
      CASE WHEN c_nationkey % 5 <> 4 AND c_custkey % 4 = 0 THEN 'digest_mismatch' END) AS violations FROM customer""",
)
def status_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of drafts, on unknown, retired or changed definitions are refused."""
    nation = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("n")).distinct().filter("n <> 4")
    name = F.concat(F.lit("onto-"), F.col("n").cast("string"))
    definitions = nation.select(
        name.alias("ontology_id"), F.lit("1").alias("version"), F.sha2(name, 256).alias("digest"), F.when(F.col("n") == 1, "retired").otherwise("approved").alias("status")
    )
    bound = F.concat(F.lit("onto-"), (F.col("c_nationkey") % 5).cast("string"))
    runs = table(spark, sf_dir, "customer").select(
        "c_custkey",
        bound.alias("ontology_id"),
        F.lit("1").alias("version"),
        F.when(F.col("c_custkey") % 4 == 0, "changed").otherwise(F.sha2(bound, 256)).alias("digest"),
        F.when(F.col("c_custkey") % 3 == 0, "draft").otherwise("approved").alias("status"),
    )
    ok, refused = matching_definitions(runs, definitions)
    accepted = ok.select("c_custkey", F.lit("").alias("violations"))
    return accepted.unionByName(refused.select("c_custkey", F.concat_ws("|", "violations").alias("violations")))


_ALTERED = dict(enumerate(PACKET_FIELDS, 1))


@query(
    "packet_tampering",
    f"""SELECT o_orderkey, [{", ".join(repr(n) for n in ("nothing", *PACKET_FIELDS))}][1 + CAST(o_orderkey % {len(PACKET_FIELDS) + 1} AS INTEGER)] AS altered,
      o_orderkey % {len(PACKET_FIELDS) + 1} = 0 AS intact FROM orders""",
)
def packet_tampering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each column of a packet altered in some packets: the digest covers them all."""
    built = packets(spark, sf_dir)
    which = (F.col("o_orderkey") % (len(_ALTERED) + 1)).cast("int")
    changed = {}
    for number, name in _ALTERED.items():
        kind = built.schema[name].dataType.simpleString()
        old = F.col(name)
        other = {
            "boolean": ~old,
            "bigint": old + 1,
            "string": F.concat(F.coalesce(old, F.lit("")), F.lit("x")),
            "array<string>": F.concat(old, F.array(F.lit("x"))),
        }[kind]
        changed[name] = F.when(which == number, other).otherwise(old)
    names = F.array(F.lit("nothing"), *[F.lit(n) for n in PACKET_FIELDS])
    verified = verify_hash(built.withColumns(changed), "packet_hash", packet_digest())
    return verified.select("o_orderkey", F.get(names, which).alias("altered"), "intact")


_LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag"]


@query(
    "plan_tampering",
    """WITH lines AS (SELECT l_orderkey % 50 AS plan_id, l_orderkey * 10 + l_linenumber AS item, l_partkey,
      concat_ws('/', l_partkey, l_quantity, l_returnflag) AS body FROM lineitem),
    was AS (SELECT plan_id, item, list_sort(list(body)) AS b FROM lines GROUP BY ALL),
    rest AS (SELECT plan_id, item, list_sort(list(CASE WHEN l_partkey % 491 = 0 THEN body || 'x' ELSE body END)) AS b
      FROM lines WHERE l_partkey % 499 <> 0 GROUP BY plan_id, item
      UNION ALL SELECT plan_id, -item, list_sort(list(body)) FROM lines WHERE l_partkey % 487 = 0 GROUP BY plan_id, item)
    SELECT plan_id, item, CASE WHEN rest.b IS NULL THEN 'removed' WHEN was.b IS NULL THEN 'added' ELSE 'altered' END AS change
    FROM was FULL JOIN rest USING (plan_id, item) WHERE was.b IS DISTINCT FROM rest.b""",
)
def plan_tampering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of plans that were altered, removed or added, found by the digests of their rows."""
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("plan_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item"), *_LINE_COLUMNS
    )
    altered = F.when(F.col("l_partkey") % 491 == 0, F.concat("l_returnflag", F.lit("x"))).otherwise(F.col("l_returnflag"))
    now = lines.filter(F.col("l_partkey") % 499 != 0).withColumn("l_returnflag", altered)
    added = lines.filter(F.col("l_partkey") % 487 == 0).withColumn("item", -F.col("item"))
    return altered_rows(lines, now.unionByName(added), ["plan_id"], "item", ["item", *_LINE_COLUMNS])


@query("decisions_second_batch", f"WITH {_DECISIONS_SQL} SELECT sequence, finding_id, status FROM statuses")
def decisions_second_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in two batches, the second against the stored decisions of the first: the outcome of one batch."""
    admitted = admitted_requests(spark, sf_dir)
    middle = admitted.agg(F.percentile_approx("sequence", 0.5)).first()[0] or 0
    first = materialize(resolve(admitted.filter(F.col("sequence") <= middle)), "first-batch")
    stored = first.filter(F.col("status") == "accepted").select(*admitted.columns)
    second = resolve(admitted.filter(F.col("sequence") > middle), stored)
    columns = ["sequence", "finding_id", "status"]
    return first.select(*columns).unionByName(second.select(*columns))
