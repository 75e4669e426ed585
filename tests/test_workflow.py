import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.functions.canonical import canonical_hash
from claimweave.operators.chains import append_chain, link_digest
from claimweave.operators.decisions import REQUEST_FIELDS, admit, decision_feedback, resolve
from claimweave.operators.outbox import mark_delivered, new_tasks, pending, route_tasks
from claimweave.operators.packets import build_packets, packet_digest, verify_chain, verify_hash
from claimweave.operators.scale import previous_in_chain, top_k_per_group
from claimweave.streaming import stream_decisions, stream_outbox
from claimweave.streaming.jobs import stored

REQUEST = (
    "sequence bigint, tenant_id string, workspace_id string, packet_id string, finding_id string, action string, reason_code string, "
    "reason string, actor_id string, actor_roles array<string>, idempotency_key string, packet_hash string, plan_hash string"
)


def request(sequence, finding="f1", key="k1", reason="ok", **change):
    row = {
        "sequence": sequence, "tenant_id": "t", "workspace_id": "w", "packet_id": "P", "finding_id": finding,
        "action": "route_to_coding", "reason_code": "evidence_confirmed", "reason": reason, "actor_id": "a",
        "actor_roles": ["coder"], "idempotency_key": key, "packet_hash": "ph", "plan_hash": "pl", **change,
    }
    return tuple(row.values())


def in_order(rows):
    """The same rules, one request after the other."""
    keys, decided, out = {}, set(), {}
    for row in sorted(rows):
        fields = dict(zip([c.split()[0] for c in REQUEST.split(", ")], row))
        same = tuple(str(fields[name]) for name in REQUEST_FIELDS)
        if fields["idempotency_key"] in keys:
            out[row[0]] = "replayed" if keys[fields["idempotency_key"]] == same else "conflict"
        elif fields["finding_id"] in decided:
            out[row[0]] = "terminal"
        else:
            keys[fields["idempotency_key"]] = same
            decided.add(fields["finding_id"])
            out[row[0]] = "accepted"
    return out


@pytest.mark.parametrize("seed", range(3))
def test_resolution_equals_one_request_after_the_other(spark, seed):
    rng = random.Random(seed)
    rows = [
        request(i, f"f{rng.randrange(12)}", f"k{0 if rng.random() < 0.3 else rng.randrange(15)}", rng.choice(["ok", "other"]))
        for i in range(80)
    ]
    got = {r.sequence: r.status for r in resolve(spark.createDataFrame(rows, REQUEST)).collect()}
    assert got == in_order(rows)


def test_admission_cascade(spark):
    packets = spark.createDataFrame(
        [("P", True, True, "t", "w", "t", "w", "ph", "ph", "pl", False, ["route_to_coding", "dismiss_with_reason"])],
        "packet_id string, packet_intact boolean, plan_intact boolean, packet_tenant string, packet_workspace string, plan_tenant string, "
        "plan_workspace string, plan_packet_hash string, packet_hash string, plan_hash string, claim_mutation_allowed boolean, permitted_actions array<string>",
    )
    items = spark.createDataFrame(
        [("P", "f1", "quick_confirm", True, ["route_to_coding", "dismiss_with_reason"], "h", "h"),
         ("P", "f2", "focused_review", False, ["route_to_coding", "dismiss_with_reason"], "h", "h"),
         ("P", "f3", "focused_review", True, ["route_to_coding", "dismiss_with_reason"], "h", "tampered"),
         ("P", "f4", "suppressed", False, [], "h", "h")],
        "packet_id string, finding_id string, tier string, selected boolean, allowed_actions array<string>, item_finding_hash string, packet_finding_hash string",
    )
    cases = {
        None: request(1),
        "reviewer_scope": request(2, tenant_id="other"),
        "action_not_permitted": request(3, action="route_to_cdi"),
        "unknown_finding": request(4, finding="zzz"),
        "finding_changed": request(5, finding="f3"),
        "tier_not_eligible": request(6, finding="f4"),
        "not_selected": request(7, finding="f2"),
        "role": request(8, actor_roles=["read_only"]),
        "reason_code_mismatch": request(9, reason_code="duplicate"),
        "reason_text": request(10, reason=" "),
        "idempotency_key": request(11, key="x" * 129),
    }
    requests = spark.createDataFrame(list(cases.values()), REQUEST).drop("packet_hash", "plan_hash")
    got = {r.sequence: r.reject_reason for r in admit(requests, packets, items).collect()}
    assert [got[row[0]] for row in cases.values()] == list(cases)


def test_feedback_keeps_zero_counts(spark):
    rows = [("t", "route_to_coding", "evidence_confirmed"), ("t", "dismiss_with_reason", "duplicate")]
    row = decision_feedback(spark.createDataFrame(rows, "tenant string, action string, reason_code string"), ["tenant"]).head()
    assert (row.total_decisions, row.accepted, row.dismissed, row.acceptance_rate, row.other_governed) == (2, 1, 1, 0.5, 0)


def test_previous_row_across_segments(spark):
    rows = [("hot" if i % 3 else f"c{i % 5}", i, f"h{i}" if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "chain string, seq bigint, h string")
    got = {r.seq: r._previous for r in previous_in_chain(df.repartition(7), ["chain"], "seq", "h", segment_rows=16).collect()}
    last, want = {}, {}
    for chain, seq, value in rows:
        want[seq] = last.get(chain)
        last[chain] = value
    assert got == want


def test_chain_append_continues_and_tampering_shows(spark):
    rows = [("hot" if i % 4 else "cold", i, f"body{i}") for i in range(200)]
    df = spark.createDataFrame(rows, "chain string, seq bigint, body string").withColumn("content", canonical_hash(body=F.col("body")))
    whole = append_chain(df, ["chain"], "seq", "content")
    first = append_chain(df.filter("seq < 90"), ["chain"], "seq", "content")
    tails = first.groupBy("chain").agg(F.max_by("record_hash", "seq").alias("tail_hash"))
    second = append_chain(df.filter("seq >= 90"), ["chain"], "seq", "content", tails)
    as_map = lambda frame: {r.seq: (r.previous_hash, r.record_hash) for r in frame.collect()}
    assert as_map(first.unionByName(second)) == as_map(whole)
    expected = None
    for row in sorted((r for r in whole.collect() if r.chain == "cold"), key=lambda r: r.seq):
        assert row.previous_hash == expected
        expected = link_digest(row.content, expected)
        assert row.record_hash == expected
    again = canonical_hash(content_hash=canonical_hash(body=F.col("body")), previous_hash=F.col("previous_hash"))
    check = lambda frame: {r.chain: r for r in verify_chain(frame, ["chain"], "seq", "record_hash", "previous_hash", again, 16).collect()}
    assert all(r.intact for r in check(whole).values())
    changed = whole.withColumn("body", F.when(F.col("seq") == 40, F.lit("forged")).otherwise(F.col("body")))
    assert (check(changed)["cold"].altered_records, check(changed)["hot"].intact) == (1, True)
    dropped = check(whole.filter("seq <> 41"))
    assert (dropped["hot"].broken_links, dropped["cold"].intact) == (1, True)


def test_leading_rows_of_a_hot_group(spark):
    rows = [("hot" if i % 10 else "cold", (i * 37) % 101, f"i{i:04d}") for i in range(1_000)]
    df = spark.createDataFrame(rows, "g string, score int, id string")
    got = {(r.g, r._rank): r.id for r in top_k_per_group(df, ["g"], [F.desc("score"), F.asc("id")], 5, "id").collect()}
    for group in ("hot", "cold"):
        best = sorted((-s, i) for g, s, i in rows if g == group)[:5]
        assert [got[(group, n + 1)] for n in range(5)] == [i for _, i in best]


ITEM = "tenant_id string, workspace_id string, packet_id string, automation_id string, finding_id string, tier string, queue string, recommended_action string"


def item(n, tier="auto_routed", queue="coding", action="route_to_coding", tenant="t"):
    return (tenant, "w", "P", f"automation-{n}", f"f{n}", tier, queue, action)


def test_outbox_is_idempotent_and_tenant_scoped(spark):
    items = spark.createDataFrame([item(1), item(2), item(3, tier="escalated"), item(4, queue="none"), item(1, tenant="u")], ITEM)
    tasks, rejects = route_tasks(items, "2026-01-01T00:00:00Z")
    assert rejects.count() == 1
    outbox = new_tasks(tasks, tasks.limit(0))
    assert outbox.count() == 3 and new_tasks(tasks, outbox).count() == 0
    route = outbox.filter("tenant_id = 't' and finding_id = 'f1'").head().route_id
    deliveries = spark.createDataFrame([("t", "w", route, 1), ("t", "w", route, 2), ("u", "w", route, 3)], "tenant_id string, workspace_id string, route_id string, sequence bigint")
    ok, bad = mark_delivered(deliveries, outbox)
    assert {r.sequence: r.violations for r in bad.collect()} == {2: ["already_delivered"], 3: ["unknown_task"]}
    assert pending(outbox, ok).count() == 2


def test_packet_tampering_fails_the_hash_check(spark):
    cases = spark.createDataFrame([("C1", "t", "w", "ch"), ("C2", "t", "w", "ch2")], "case_id string, tenant_id string, workspace_id string, case_hash string")
    findings = spark.createDataFrame([("C1", "a" * 64, True, "g")], "case_id string, finding_hash string, requires_human_review boolean, grouper_version string")
    build = lambda: build_packets(cases, findings, case="case_id", as_of="2026-01-01T00:00:00Z", engine_version="1", rule_package_hash="0")
    packets = build()
    assert packets.collect() == build().collect()
    assert [r.human_review_required for r in packets.orderBy("case_id").collect()] == [True, False]
    changed = packets.withColumn("finding_count", F.when(F.col("case_id") == "C1", 9).otherwise(F.col("finding_count")))
    assert {r.case_id: r.intact for r in verify_hash(changed, "packet_hash", packet_digest()).collect()} == {"C1": False, "C2": True}


def test_streams_run_over_several_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = T.StructType([T.StructField("n", T.LongType())])
    ident = lambda name: F.concat(F.lit(name), (F.col("n") % 20).cast("string"))

    def tasks(batch):
        rows = batch.select(
            F.lit("t").alias("tenant_id"), F.lit("w").alias("workspace_id"), F.lit("P").alias("packet_id"), ident("a").alias("automation_id"),
            ident("f").alias("finding_id"), F.lit("auto_routed").alias("tier"), F.lit("cdi").alias("queue"), F.lit("route_to_cdi").alias("recommended_action"),
        )
        return route_tasks(rows, "2026-01-01T00:00:00Z")[0]

    def requests(batch):
        return batch.select(
            F.lit("P").alias("packet_id"), ident("f").alias("finding_id"), F.col("n").alias("sequence"), canonical_hash(n=F.col("n")).alias("content_hash")
        )

    sample = spark.createDataFrame([(0,)], schema)
    task_schema = tasks(sample).schema
    base = requests(sample).schema
    decision_schema = T.StructType([*base.fields, T.StructField("previous_hash", T.StringType()), T.StructField("record_hash", T.StringType())])
    for start in (0, 10, 25):
        spark.range(start, start + 15).select(F.col("id").alias("n")).coalesce(1).write.mode("append").parquet(source)
        stream_outbox(spark, source, schema, tasks, task_schema, table=str(tmp_path / "box"), checkpoint=str(tmp_path / "c1"), files_per_trigger=1).awaitTermination()
        stream_decisions(spark, source, schema, requests, decision_schema, table=str(tmp_path / "dec"), checkpoint=str(tmp_path / "c2"), files_per_trigger=1).awaitTermination()
    assert stored(spark, str(tmp_path / "box"), task_schema).count() == 20
    decisions = sorted(stored(spark, str(tmp_path / "dec"), decision_schema).collect(), key=lambda r: r.sequence)
    assert [r.sequence for r in decisions] == list(range(20))
    previous = None
    for row in decisions:
        assert row.previous_hash == previous
        previous = row.record_hash
