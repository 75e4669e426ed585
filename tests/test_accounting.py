"""Nothing is lost unseen: headers, rejects, observed reports, digest trees, later batches and restarted streams."""

import pytest
from pyspark.sql import functions as F

from claimweave.operators.decisions import REQUEST_FIELDS, resolve
from claimweave.operators.mapping import account
from claimweave.operators.packets import altered_rows, digest_tree, tree_roots
from claimweave.sources.files import Readers, read_csv, read_csv_checked
from claimweave.streaming.jobs import stream_decision_log


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    write(tmp_path, "in/a.csv", 'id,"long\nname",note\n1,x,"a, b"\n2,,\n3\n')
    write(tmp_path, "in/b.csv", 'note,id\r\nsecond,4\r\nthird,5,6\r\n')
    write(tmp_path, "in/c.csv", "id,id\n6,7\n8,9\n")
    write(tmp_path, "in/d.csv", "")
    rows, rejects = read_csv_checked(spark, str(tmp_path / "in"))
    assert rows.columns == ["id", "long\nname", "note", "_row_number"]
    got = sorted((tuple(r) for r in rows.select("id", "`long\nname`", "note").collect()), key=str)
    assert got == [("1", "x", "a, b"), ("2", "", ""), ("3", None, None), ("4", None, "second")]
    found = sorted((r.file.rsplit("/", 1)[-1], r["_row_number"], r.violations[0]) for r in rejects.collect())
    assert found == [("b.csv", 2, "too_many_cells"), ("c.csv", 0, "duplicate_header"), ("c.csv", 1, "duplicate_header"), ("c.csv", 2, "duplicate_header"), ("d.csv", 0, "empty_file")]
    with pytest.raises(ValueError, match="unusable"):
        read_csv(spark, str(tmp_path / "in"))


def test_readers_hand_on_rejects(spark, tmp_path):
    write(tmp_path, "x/a.jsonl", '{"a": 1}\nnothing\n')
    rows, rejects = Readers().read_all(spark, str(tmp_path), {"x": {"path": "x", "format": "jsonl"}})
    assert rows["x"].count() == 1
    assert [(r["_row_number"], r.violations) for r in rejects["x"].collect()] == [(2, ["not_an_object"])]


def test_reports_are_observed_while_tables_are_written(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    rejects = spark.createDataFrame([("r", 1, ["v unmapped:7", "unknown_parent"]), ("r", 2, ["unknown_parent"])], "resource string, row_number int, violations array<string>")
    run = lambda df: {(r.side, r.table_name): r for r in account({"in": df}, {"cases": df, "rejects": rejects})["report"].collect()}
    one, turned = run(cases), run(cases.orderBy(F.desc("v")).repartition(3))
    assert one["output", "cases"].rows == 3 and one["input", "in"].rows == 3
    assert one["output", "cases"].fingerprint == turned["output", "cases"].fingerprint
    changed = run(cases.withColumn("v", F.when(F.col("k") == 1, "z").otherwise(F.col("v"))))
    assert changed["output", "cases"].fingerprint != one["output", "cases"].fingerprint
    found = account({"in": cases}, {"cases": cases, "rejects": rejects})["reject_report"].collect()
    assert sorted((r.reason, r.rows) for r in found) == [("unknown_parent", 2), ("v unmapped", 1)]


def test_digest_trees_find_altered_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("plan"), F.col("id").alias("item"), F.lit("x").alias("a"), F.col("id").alias("b"))
    now = rows.filter("item <> 17").withColumn("a", F.when(F.col("item") == 44, "y").otherwise(F.col("a")))
    now = now.unionByName(now.filter("item = 99").withColumn("item", F.lit(6000).cast("bigint")))
    got = altered_rows(rows, now, ["plan"], "item", ["item", "a", "b"]).collect()
    assert sorted((r.item, r.change) for r in got) == [(17, "removed"), (44, "altered"), (6000, "added")]
    roots = lambda df: {r.plan: r.root for r in tree_roots(digest_tree(df, ["plan"], "item", ["item", "a", "b"]), ["plan"]).collect()}
    before, after = roots(rows), roots(now)
    assert {p for p in before if before[p] != after[p]} == {2, 0} and roots(rows.repartition(7)) == before


def requests(spark, *rows):
    data = [(s, "t", "w", "P", key, finding, reason) for s, key, finding, reason in rows]
    df = spark.createDataFrame(data, "sequence bigint, tenant_id string, workspace_id string, packet_id string, idempotency_key string, finding_id string, reason string")
    return df.withColumns({name: F.lit("same") for name in REQUEST_FIELDS if name not in df.columns})


ROWS = [(1, "k1", "f1", "a"), (2, "k1", "f1", "a"), (3, "k1", "f2", "b"), (4, "k2", "f1", "a"), (5, "k2", "f2", "a"), (6, "k3", "f2", "a"), (7, "k2", "f3", "a"), (8, "k4", "f4", "a"), (9, "k4", "f4", "a")]


@pytest.mark.parametrize("cut", range(0, 10, 3))
def test_batches_of_decisions_equal_one_batch(spark, cut):
    want = {1: "accepted", 2: "replayed", 3: "conflict", 4: "terminal", 5: "accepted", 6: "terminal", 7: "conflict", 8: "accepted", 9: "replayed"}
    first = resolve(requests(spark, *ROWS).filter(F.col("sequence") <= cut))
    later = requests(spark, *ROWS).filter(F.col("sequence") > cut)
    second = resolve(later, first.filter("status = 'accepted'").select(*later.columns))
    assert {r.sequence: r.status for r in first.collect()} | {r.sequence: r.status for r in second.collect()} == want


def test_decision_stream_goes_on_behind_its_tail(spark, tmp_path):
    schema = "packet_id string, finding_id string, sequence bigint, content_hash string, expected_previous string"
    folder, options = str(tmp_path / "in"), {"table": str(tmp_path / "out"), "checkpoint": str(tmp_path / "state")}

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)
        stream = stream_decision_log(spark, folder, spark.createDataFrame([], schema).schema, lambda df: df, **options)
        stream.awaitTermination()
        return {(r.packet_id, r.finding_id, r.sequence): r for r in spark.read.parquet(options["table"]).collect()}

    one = run(("P", "f2", 20, "h2", None), ("P", "f1", 10, "h1", None), ("Q", "f1", 5, "h9", None))
    tail = one["P", "f2", 20]
    assert (tail.position, tail.previous_hash) == (2, one["P", "f1", 10].record_hash)
    # A restarted stream: a late row, a replay, a changed one, one that expects another tail and one that expects this one.
    two = run(("P", "f3", 1, "h3", tail.record_hash), ("P", "f1", 2, "h1", None), ("P", "f2", 3, "other", None), ("P", "f4", 4, "h4", "elsewhere"))
    got = {k[1:]: (r.status, r.position) for k, r in two.items() if k[0] == "P" and k[2] < 10}
    assert got == {("f3", 1): ("accepted", 3), ("f1", 2): ("replayed", None), ("f2", 3): ("terminal", None), ("f4", 4): ("stale", None)}
    assert two["P", "f3", 1].previous_hash == tail.record_hash and two["P", "f2", 20] == tail
