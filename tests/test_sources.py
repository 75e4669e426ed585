import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from claimweave.operators.checks import check_paths
from claimweave.operators.mapping import check_mapping, run_mapping
from claimweave.operators.profile import bounded_samples, column_types, drifted, profile, schema_fingerprint
from claimweave.sources.files import Readers, number_rows, over_row_budget, read_csv, read_csv_checked, read_headers, read_json, read_jsonl
from claimweave.sources.inventory import IngestPolicy, content_digests, inventory, inventory_totals, manifest_digest
from claimweave.sources.sinks import bundle_file, export_queue, nest_children, rank_by_id, write_bundles
from claimweave.sources.workbook import read_workbooks, sheet_table


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode("utf-8"))
    return str(path)


def test_csv_keeps_strings_breaks_and_empty_cells(spark, tmp_path):
    path = write(tmp_path, "a.csv", '﻿id,note,stage\n001,"line one\nline ""two""",IV\n002,,\n003,short\n004,a,b,c\n005,\n')
    ok, bad = read_csv_checked(spark, path)
    rows = sorted(ok.collect(), key=lambda r: r["_row_number"])
    assert [(r.id, r.note, r.stage, r["_row_number"]) for r in rows] == [
        ("001", 'line one\nline "two"', "IV", 1),
        ("002", "", "", 2),
        ("003", "short", None, 3),
        ("005", "", None, 5),
    ]
    assert [(r["_row_number"], r.violations) for r in bad.collect()] == [(4, ["too_many_cells"])]


@pytest.mark.parametrize("header", ["id,id", "id,", "id,_row_number"])
def test_unusable_headers(spark, tmp_path, header):
    path = write(tmp_path, "bad.csv", header + "\n1,2\n")
    with pytest.raises(ValueError, match="unusable header"):
        read_csv(spark, path)
    assert read_headers(spark, str(tmp_path))[1].count() == 1


def test_json_shapes(spark, tmp_path):
    many = write(tmp_path, "j/many.json", '[{"a": 1}, {"a": 2, "b": {"c": 3}}]')
    one = write(tmp_path, "j1/one.json", '{"a": 7}')
    assert sorted(r.a for r in read_json(spark, many)[0].collect()) == [1, 2]
    assert read_json(spark, one)[0].head().a == 7
    ok, bad = read_json(spark, write(tmp_path, "j2/bad.json", '[{"a": 1}, 5]'), schema=read_json(spark, one)[0].drop("_row_number").schema.add("_corrupt_record", "string"))
    assert ok.count() == 0 and bad.head().violations == ["not_an_object"]


def test_jsonl_skips_blank_lines_and_rejects_others(spark, tmp_path):
    path = write(tmp_path, "x.jsonl", '{"a": 1}\n\n{"a": 2}\nnot json\n')
    ok, bad = read_jsonl(spark, path)
    assert sorted(r.a for r in ok.collect()) == [1, 2] and bad.count() == 1


def test_row_numbers_follow_the_file_over_many_blocks(spark, tmp_path):
    path = write(tmp_path, "n.csv", "v\n" + "".join(f"{i:06d}\n" for i in range(1, 5_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = spark.read.option("header", True).csv(path).select(
            "v", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
        )
        assert rows.rdd.getNumPartitions() > 3
        assert number_rows(rows).filter(F.col("v").cast("bigint") != F.col("_row_number")).count() == 0
        assert over_row_budget(rows, "n", 4_999).head().rows == 5_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_inventory_and_manifest(spark, tmp_path):
    write(tmp_path, "a.csv", "x\n1\n")
    write(tmp_path, "sub/b.json", "{}")
    write(tmp_path, "c.pdf", "binary")
    artifacts, rejects = inventory(spark, str(tmp_path))
    assert {r.path: r.format for r in artifacts.collect()} == {"a.csv": "csv", "sub/b.json": "json", "c.pdf": "unsupported"}
    assert rejects.count() == 0
    small = IngestPolicy(max_files=2, max_file_bytes=5)
    assert [r.path for r in inventory(spark, str(tmp_path), small)[1].collect()] == ["c.pdf"]
    assert inventory_totals(artifacts, small).head().violations == ["too_many_files"]
    before = manifest_digest(content_digests(spark, str(tmp_path))).head()
    write(tmp_path, "c.pdf", "changed")
    after = manifest_digest(content_digests(spark, str(tmp_path))).head()
    assert before.files == 3 and before.manifest_digest != after.manifest_digest
    paths = spark.createDataFrame([("a/b.csv",), ("../x",), ("/etc",), ("a/../b",), ("~/x",), ("a\\b",), ("a..b.csv",)], "path string")
    assert sorted(r.path for r in check_paths(paths)[0].collect()) == ["a..b.csv", "a/b.csv"]


def workbook(sheets, hidden=()):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        listed = "".join(
            f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"{" state=\"hidden\"" if n in hidden else ""}/>' for i, n in enumerate(sheets, 1)
        )
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>{listed}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>shared</t></si></sst>')
        for i, body in enumerate(sheets.values(), 1):
            book.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return buffer.getvalue()


def test_workbooks(spark, tmp_path):
    text = lambda ref, value: f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    body = (
        f'<row r="1">{text("A1", " id ")}{text("B1", "n")}{text("C1", "flag")}</row>'
        f'<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2"><v>3.0</v></c><c r="C2" t="b"><v>1</v></c></row>'
        f'<row r="3"><c r="B3"><v>2.5</v></c></row>'
    )
    (tmp_path / "ok.xlsx").write_bytes(workbook({"data": body, "secret": body}, hidden=("secret",)))
    (tmp_path / "bad.xlsx").write_bytes(b"no archive")
    rows, rejects = read_workbooks(spark, str(tmp_path))
    got = sorted(sheet_table(rows, "data", ["id", "n", "flag"]).drop("file").collect(), key=lambda r: r["_row_number"])
    assert [tuple(r) for r in got] == [("shared", "3", "true", 1), (None, "2.5", None, 2)]
    assert rows.select("sheet").distinct().count() == 1 and rejects.count() == 1


def test_profile_fingerprint_and_drift(spark):
    df = spark.createDataFrame([("a", 1, None), ("", 2, None), ("a", None, None)], "s string, n int, empty string")
    got = {r.column_name: (r.inferred_types, r.missing, r.distinct_values, r.rows) for r in profile(df, "t").collect()}
    assert got == {"s": ("string", 1, 1, 3), "n": ("integer", 1, 2, 3), "empty": ("null", 3, 0, 3)}
    same = schema_fingerprint(column_types(df.filter("n = 1"), "t"), ["artifact"])
    assert same.head().fingerprint == schema_fingerprint(column_types(df, "t"), ["artifact"]).head().fingerprint
    mapping = same.select("artifact", F.col("fingerprint").alias("source_schema_fingerprint"))
    assert drifted(same, mapping).count() == 0
    wider = schema_fingerprint(column_types(df.withColumn("extra", F.lit("x")), "t"), ["artifact"])
    assert drifted(wider, mapping).count() == 1


def test_samples_cut_values_and_respect_the_total(spark):
    df = spark.createDataFrame([(i, "x" * 1_000, "y") for i in range(9)], "id long, long_text string, s string")
    rows = bounded_samples(df, "t", "id", ["long_text", "s"], rows=3, max_value=10).collect()
    assert len(rows) == 6 and rows[0].sample == "x" * 10 + "…[truncated]" and rows[0].value_truncated
    few = bounded_samples(df, "t", "id", ["s", "long_text"], rows=3, max_value=10, max_total=8).collect()
    assert [(r.row_key, r.column_name) for r in few] == [(0, "s"), (1, "s"), (2, "s")]


EXPORT = {
    "visits": "visit,person,file,came,went,ward\n V7 ,P3,K5,2025-03-02T06:30:00Z,2025-03-04T10:00:00Z,North\n",
    "letters": 'visit,letter,writer,written,body\nV7,L1,Nurse,2025-03-02T07:00:00Z,"Left wrist, swollen"\n',
    "bills": "visit,group_code,cents\nV7,500,90000\n",
    "bill_codes": "visit,code\nV7,s52.5\nV7,S52.5\n",
    "xrays": "visit,image,bone,taken,break_type,side,displaced\nV7,X1,B1,2025-03-02T08:15:00Z,double,left,Y\n",
}


def field(name, *operations):
    return {"field": name, "operations": [{"op": "trim"}, *operations]}


def moment(name):
    return {"field": name, "operations": [{"op": "datetime"}]}


VISIT = field("visit")
BREAKS = {"single": 1, "double": 2}
# The keys are the format of a mapping.
CLINIC = {
    "adapter_id": "wrist-clinic",
    "version": "3.1.0",
    "status": "approved-for-demo",
    "source_schema_fingerprint": "x",
    "resources": {name: {"path": f"{name}.csv", "format": "csv"} for name in EXPORT},
    "encounter": {
        "resource": "visits",
        "encounter_id": VISIT,
        "patient_id": field("person"),
        "case_id": field("file"),
        "admitted_at": moment("came"),
        "discharged_at": moment("went"),
        "metadata": {"ward": field("ward")},
    },
    "documents": [
        {
            "resource": "letters",
            "encounter_id": VISIT,
            "document_id": field("letter"),
            "author_role": field("writer", {"op": "lower"}),
            "recorded_at": moment("written"),
            "text": field("body"),
        }
    ],
    "claim": {
        "resource": "bills",
        "encounter_id": VISIT,
        "drg": field("group_code"),
        "allowed_amount_cents": {"field": "cents", "operations": [{"op": "integer"}]},
        "diagnoses": {"resource": "bill_codes", "encounter_id": VISIT, "value": field("code", {"op": "upper"})},
    },
    "structured_projections": [
        {
            "projection_id": "breaks",
            "resource": "xrays",
            "encounter_id": VISIT,
            "source_record_id": field("image"),
            "evidence": {
                "evidence_id": {"template": "image-{image}"},
                "document_id": {"template": "film-{image}"},
                "author_role": {"constant": "scanner"},
                "recorded_at": moment("taken"),
                "text": {"template": "{break_type} break on the {side}"},
                "field_names": ["break_type", "side"],
            },
            "entities": [
                {
                    "entity_id": {"template": "bone-{bone}"},
                    "entity_type": "BrokenBone",
                    "label": {"template": "Bone {bone}"},
                    "properties": {"displaced": {"field": "displaced", "operations": [{"op": "boolean"}]}},
                }
            ],
            "assertions": [
                {
                    "assertion_id": {"template": "seen-{image}"},
                    "subject_id": {"template": "bone-{bone}"},
                    "concept": "fracture",
                    "status": "present",
                    "documentation_status": "explicit",
                    "confidence": 1.0,
                    "attributes": {"breaks": {"field": "break_type", "operations": [{"op": "map", "values": BREAKS}]}},
                }
            ],
        }
    ],
}


def run_export(spark, folder, **changes):
    for name, text in {**EXPORT, **changes}.items():
        write(folder, f"{name}.csv", text)
    resources, unread = Readers().read_all(spark, str(folder), CLINIC["resources"])
    return run_mapping(resources, CLINIC, as_of="2026-01-01T00:00:00Z", unread=unread), resources


def test_mapping_of_an_export(spark, tmp_path):
    out, resources = run_export(spark, tmp_path)
    case = out["cases"].head()
    assert (case.encounter_id, case.admitted_at) == ("V7", "2025-03-02T06:30:00+00:00")
    claim = out["claims"].head()
    assert (claim.drg, claim.allowed_amount_cents, claim.diagnoses, claim.procedures) == ("500", 90_000, ["S52.5"], [])
    assert out["documents"].head().author_role == "nurse"
    evidence = out["evidence"].head()
    assert (evidence.source_locator.path, evidence.source_locator.row_number) == ("xrays.csv", 1)
    assert json.loads(out["assertions"].head().attributes) == {"breaks": 2}
    assert json.loads(out["entities"].head().properties) == {"displaced": True}
    assert out["rejects"].count() == 0
    report = {(r.side, r.table_name): r.rows for r in out["report"].collect()}
    assert report[("input", "bill_codes")] == 2 and report[("output", "cases")] == 1
    profiles = column_types(resources["letters"], "letters")
    none = spark.createDataFrame([], "class_id string, abstract boolean"), spark.createDataFrame([], "relation_id string")
    faults = check_mapping(spark, CLINIC, profiles, *none, {name: name for name in CLINIC["resources"]})
    errors = {r.error for r in faults.collect()}
    assert "unknown artifact bills" in errors and "unknown class BrokenBone" in errors


@pytest.mark.parametrize(
    "name, row, expected",
    [
        ("xrays", "V7,X2,B2,2025-03-02T08:15:00Z,triple,left,Y\n", "a0_attributes unmapped:triple"),
        ("letters", "V9,L2,nurse,2025-03-02T07:00:00Z,hi\n", "unknown_parent"),
        ("bills", "V7,501,5\n", "multiple_claims"),
        ("visits", "V8,P4,K6,2025-03-05T08:00:00Z,2025-03-01T16:00:00Z,North\n", "admission_after_discharge"),
        ("visits", "V8,P4,K6,2025-03-01T08:00:00Z,2025-03-05T16:00:00Z,North\n", "missing_claim V8"),
    ],
)
def test_bad_rows_become_rejects(spark, tmp_path, name, row, expected):
    out, _ = run_export(spark, tmp_path, **{name: EXPORT[name] + row})
    assert expected in {v for r in out["rejects"].collect() for v in r.violations}
    assert out["cases"].count() >= 1


def test_draft_mapping_is_refused(spark):
    with pytest.raises(ValueError, match="approved"):
        run_mapping({}, {**CLINIC, "status": "draft"}, as_of="")


def test_bundles_and_exports(spark, tmp_path):
    parents = spark.createDataFrame([(1, "C1"), (2, "C2"), (3, "C3")], "encounter_id long, case_id string")
    children = spark.createDataFrame([(1, "b", "x"), (1, "a", "y"), (2, "q", "z"), (2, "r", "z"), (2, "s", "z")], "encounter_id long, document_id string, text string")
    nested, rejects = nest_children(parents, children, "encounter_id", "documents", ["document_id"], max_items=2)
    rows = {r.encounter_id: [d.document_id for d in r.documents] for r in nested.collect()}
    assert rows == {1: ["a", "b"], 3: []} and rejects.head().violations == ["documents_over_budget"]
    write_bundles(nested, str(tmp_path / "bundles"))
    assert spark.read.json(str(tmp_path / "bundles")).count() == 2
    ranked = rank_by_id(parents.withColumn("id", F.col("encounter_id") * 100), "id", width=150)
    assert sorted((r.encounter_id, r.position) for r in ranked.collect()) == [(1, 1), (2, 2), (3, 3)]
    assert ranked.filter("encounter_id = 1").select(bundle_file(F.col("position"), F.col("case_id"))).head()[0].startswith("000001-")
    export_queue(parents.withColumn("note", F.lit('say "hi"')), str(tmp_path / "queue"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "queue")).head().note == 'say "hi"'


def test_formats_are_registered_once(spark):
    readers = Readers()
    readers.register("rows", lambda session, path: session.range(3).toDF("n"))
    rows, rejects = readers.read(spark, "", "rows")
    assert rows.count() == 3 and rejects.count() == 0
    with pytest.raises(ValueError):
        readers.register("csv", lambda session, path: None)
    with pytest.raises(ValueError):
        readers.read(spark, "", "fax")
