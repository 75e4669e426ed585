"""Steps whose tasks, shuffles or keys must not grow faster than the input."""

import hashlib
import random

import pandas as pd
from pyspark.sql import functions as F

from claimweave.llm import curriculum
from claimweave.llm.queries import QUERIES as CORPUS
from claimweave.operators import decisions, mapping
from claimweave.operators.automation import DISMISS
from claimweave.operators.decisions import admit, admitted
from claimweave.operators.ontology import Ontology, checked_relations
from claimweave.operators.packets import altered_rows
from claimweave.operators.profile import profile
from claimweave.plans import QUERIES, accounting, bindings, ingest, workflow
from claimweave.session import cut_lineage, materialize
from claimweave.sources.inventory import IngestPolicy, content_digests, inventory
from claimweave.streaming.jobs import DecisionLog

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_altered_rows_takes_every_row_once(spark):
    rows = spark.range(3000).select(F.lit(1).alias("plan"), F.col("id").alias("item"), F.lit("x").alias("a"))
    rows = rows.unionByName(spark.createDataFrame([(1, None, "n"), (1, 7, "x"), (1, 8, "second")], "plan int, item bigint, a string"))
    now = rows.withColumn("a", F.when(F.col("item") >= 1000, "y").otherwise(F.col("a"))).filter("a <> 'second'")
    changed = altered_rows(rows, now, ["plan"], "item", ["item", "a"])
    assert {(r.item, r.change) for r in changed.collect()} == {(i, "altered") for i in [8, *range(1000, 3000)]}
    # Digests of both sides are shuffled once and no row is joined back to its leaf.
    assert "Join" not in plan_of(changed)


def test_delimited_files_grow_in_number(spark, tmp_path, monkeypatch):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    lines.repartition(7).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(ingest, "scratch_path", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        row = QUERIES["scan_row_numbers"](spark, str(tmp_path)).head()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert (row.rows_read, row.highest_sum, row.gaps) == (lines.count(), lines.count(), 0)
    assert len(list((tmp_path / "lineitem-csv").glob("part-*.csv"))) >= 7


def test_profile_shuffles_narrow_keys(spark):
    texts = ["a", "a", "", None, "x" * 15, "x" * 16, "x" * 16, "x" * 17, "y" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    found = profile(df, "f")
    assert {tuple(r)[1:] for r in found.collect()} == {("n", "integer", 0, 9, 9), ("t", "string", 2, 5, 9)}
    assert "hashpartitioning(at" in plan_of(found) and "hashpartitioning(column_name" not in plan_of(found)
    open_map = df.select(F.parse_json(F.when(F.col("n") < 4, F.lit("1")).when(F.col("n") < 6, F.lit("true")).otherwise(F.lit('"1"'))).alias("v"), "n")
    assert {tuple(r)[1:] for r in profile(open_map, "f").collect()} == {("v", "boolean,integer,string", 0, 3, 9), ("n", "integer", 0, 9, 9)}


def test_mix_is_sorted_by_training_time(spark):
    mixed = curriculum.mix(spark.read.parquet(f"{SF}/documents.parquet"))
    parts = [[(r.positions[0] if r.positions else 2.0, r.doc_id) for r in part] for part in mixed.rdd.glom().collect()]
    rows = [row for part in parts for row in part]
    assert rows == sorted(rows) and len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    first = [r.first_position for r in CORPUS["op3_curriculum_mix"](spark, SF).collect()]
    assert [p for p in first if p is not None] == sorted(p for p in first if p is not None)


def test_relation_checks_join_without_lists(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    relations = empty("relation_id string, predicate string, source_id string, target_id string, evidence_ids array<string>, contradicting_evidence_ids array<string>")
    definition = Ontology(empty("class_id string"), empty("relation_id string, domain array<string>, range array<string>, requires_evidence boolean"), empty("value_set string"))
    checked = checked_relations(relations, empty("entity_id string, entity_type string"), empty("evidence_id string"), definition, empty("class_id string, ancestor string"), scope=[])
    spark.conf.set("spark.sql.optimizer.excludedRules", "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation,org.apache.spark.sql.catalyst.optimizer.PropagateEmptyRelation")
    try:
        lines = checked.select("relation_id", "violations")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.optimizer.excludedRules")
    # Above the joins the lists are flags.
    first_join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("evidence_ids" in line for line in lines[: first_join + 1])


class Calls:
    """State of one packet in memory, with the number of its calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def getValueState(self, name, *schemas):
        return self

    getMapState = getListState = getValueState

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.map

    def getValue(self, key):
        self.calls += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.map[key] = value


def requests(low, high, content="c"):
    rows = [(i, f"f{i}", f"{content}{i}", None) for i in range(low, high)]
    return pd.DataFrame(rows, columns=["sequence", "finding_id", "content_hash", "expected_previous"])


def decided(log, *batches):
    handle = Calls()
    log.init(handle)
    out = pd.concat([frame for batch in batches for frame in log.handleInputRows(("p",), iter([batch]), None)])
    return handle.calls, out.drop(columns="packet_id").astype(object).where(out.drop(columns="packet_id").notna(), None).values.tolist()


def test_decision_log_calls_its_state_per_batch():
    batches = (requests(10, 60), requests(0, 70), requests(5, 8, "other"))
    calls, whole = decided(DecisionLog(), *batches)
    assert calls <= 6 and [row[2] for row in whole].count("accepted") == 70
    assert [row[2] for row in whole].count("replayed") == 50 and [row[2] for row in whole].count("terminal") == 3
    odd = pd.DataFrame([(1, None, None, None), (2, None, None, None), (2, "f", None, None)], columns=batches[0].columns)
    assert [row[2] for row in decided(DecisionLog(), odd, odd)[1]] == ["accepted", "accepted", "replayed", "replayed", "replayed", "replayed"]
    # Findings beyond those that lie with the tail are known as well.
    assert decided(DecisionLog(listed=7), *batches)[1] == whole


def test_digests_are_computed_once_per_row(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(mapping, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or materialize(df, name))
    table = spark.range(10).withColumn("v", F.rand(1))
    stored = mapping.account({"in": table}, {"t": table, "rejects": spark.createDataFrame([], "resource string, violations array<string>")})
    assert stored["t"].columns == ["id", "v"] and len(plans) == 2
    assert not any("to_json" in line for plan in plans for line in plan.splitlines() if "CollectMetrics" in line)


def test_refused_files_are_listed_and_not_read(spark, tmp_path, monkeypatch):
    (tmp_path / "small.csv").write_text("x")
    (tmp_path / "large.csv").write_text("x" * 100)
    policy = IngestPolicy(max_file_bytes=50)
    monkeypatch.setattr(ingest, "inventory", lambda spark, root: inventory(spark, root, policy))
    monkeypatch.setattr(ingest, "content_digests", lambda spark, root: content_digests(spark, root, policy))
    found = QUERIES["folder_inventory"](spark, str(tmp_path))
    assert {(r.path, r.size_bytes, r.sha256) for r in found.collect()} == {
        ("small.csv", 1, hashlib.sha256(b"x").hexdigest()),
        ("large.csv", 100, None),
    }


def test_admission_filters_each_side_before_the_joins(spark):
    rng = random.Random(1)
    odd = lambda usual, *others: rng.choice(others) if rng.random() < 0.12 else usual
    both = ["route_to_coding", DISMISS]
    packets = [
        (f"P{i}", odd(True, False, None), odd(True, None), "t", odd("w", None), odd("t", None), odd("w", "v"), "h", odd("h", "x"), "p", odd(False, True, None), odd(both, [DISMISS], [], None))
        for i in range(60)
    ]
    items = [
        (f"P{i % 60}", f"f{i % 180}", odd("escalated", "suppressed", None), odd(True, False, None), odd(both, [DISMISS], [], None), "h", odd("h", "x", None))
        for i in range(200)
    ]
    requests = [
        (i, odd(f"P{i % 60}", "P?", None), odd(f"f{i % 180}", "f?", None), odd("route_to_coding", DISMISS, None), odd("evidence_confirmed", "duplicate", "bogus", None),
         odd("ok", "", " \t", None, " " * 2000 + "ok", "x" * 1001, " " + "x" * 1000), odd(["admin"], ["coder", None], ["read_only"], [], None),
         odd("t", None), odd("w", "v", None), odd("k", " ", "k" * 129, " " * 200 + "k" * 128, None))
        for i in range(3000)
    ]
    sides = (
        spark.createDataFrame(requests, "sequence bigint, packet_id string, finding_id string, action string, reason_code string, reason string, actor_roles array<string>, tenant_id string, workspace_id string, idempotency_key string"),
        spark.createDataFrame(packets, "packet_id string, packet_intact boolean, plan_intact boolean, packet_tenant string, packet_workspace string, plan_tenant string, plan_workspace string, plan_packet_hash string, packet_hash string, plan_hash string, claim_mutation_allowed boolean, permitted_actions array<string>"),
        spark.createDataFrame(items, "packet_id string, finding_id string, tier string, selected boolean, allowed_actions array<string>, item_finding_hash string, packet_finding_hash string"),
    )
    passed, checked = admitted(*sides), admit(*sides)
    want = checked.filter("reject_reason is null").drop("reject_reason")
    count = want.count()
    assert count > 100 and passed.count() == count and passed.exceptAll(want.select(*passed.columns)).isEmpty()
    assert {r[0] for r in checked.select("reject_reason").distinct().collect()} >= {None, "reason_text", "idempotency_key", "role", "not_selected"}
    # The joins are inner, each side's own checks lie below them.
    plan = passed._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftOuter" not in plan and plan.count("Join Inner") == 2


def test_decisions_store_what_they_read(spark, monkeypatch):
    stored = {}

    def spy(df, name, rows=None):
        stored.setdefault(name, df.columns)
        return materialize(df, name, rows)

    for module in (bindings, workflow, accounting):
        monkeypatch.setattr(module, "materialize", spy)
    QUERIES["decisions_second_batch"](spark, SF)
    assert not {"title", "case_id", "queue"} & {column for columns in stored.values() for column in columns}
    assert list(stored) == ["classified", "items", "admitted", "first-batch"] and "permitted_actions" not in stored["admitted"]


def test_a_round_of_decisions_has_one_join(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(decisions, "cut_lineage", lambda df: rounds.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut_lineage(df))
    rows = [(i, "t", "w", "P", f"f{i % 7}", f"k{i % 5}") for i in range(40)]
    df = spark.createDataFrame(rows, "sequence bigint, tenant_id string, workspace_id string, packet_id string, finding_id string, idempotency_key string")
    got = {r.sequence: r.status for r in decisions.resolve(df.withColumns({name: F.lit("same") for name in decisions.REQUEST_FIELDS if name not in df.columns})).collect()}
    assert {s for s, status in got.items() if status == "accepted"} == {0, 1, 2, 3, 4}
    # Winners come from the first requests of keys and findings, not from joins of all requests with them.
    assert rounds[0].count("Join") == 1
