"""Scans, transforms, mapping runs, profiles and manifests over the test tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.functions.conditions import row_filter, variant_path
from claimweave.functions.transforms import compile_expr
from claimweave.operators.mapping import check_mapping, project_rows, run_mapping
from claimweave.operators.profile import bounded_samples, column_types, drifted, profile, schema_fingerprint
from claimweave.plans.bindings import AS_OF, events, table, text_id
from claimweave.plans.registry import query
from claimweave.session import scratch_path
from claimweave.sources.files import ROW_NUMBER, number_rows, read_csv, read_json, read_jsonl
from claimweave.sources.inventory import content_digests, inventory
from claimweave.sources.sinks import manifest
from claimweave.sources.workbook import scan_workbooks, sheet_table

# --- scans -----------------------------------------------------------------------


@query(
    "scan_csv",
    """SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS characters, sha256(text) AS text_hash FROM documents""",
)
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as delimited text with line breaks in quotes, and read back."""
    path = scratch_path(spark, "documents-csv")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text").write.option("header", True).option(
        "escape", '"'
    ).option("emptyValue", "").option("lineSep", "\n").csv(path)
    rows = read_csv(spark, path)
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "lang",
        "source",
        F.length("text").cast("bigint").alias("characters"),
        F.sha2("text", 256).alias("text_hash"),
    )


@query(
    "scan_row_numbers",
    "SELECT count(*) AS rows_read, count(*) AS highest_sum, CAST(0 AS BIGINT) AS gaps FROM lineitem",
)
def scan_row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row numbers of every file run from 1 to its number of rows without a gap."""
    path = scratch_path(spark, "lineitem-csv")
    table(spark, sf_dir, "lineitem").write.option("header", True).csv(path)
    rows = spark.read.option("header", True).csv(path).select(
        "l_orderkey", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    per_file = number_rows(rows).groupBy("_file").agg(
        F.count(F.lit(1)).alias("n"), F.max(ROW_NUMBER).alias("high"), F.countDistinct(ROW_NUMBER).alias("d"), F.min(ROW_NUMBER).alias("low")
    )
    return per_file.agg(
        F.sum("n").alias("rows_read"),
        F.sum("high").alias("highest_sum"),
        F.sum((F.col("n") - F.col("d")) + (F.col("low") - 1)).alias("gaps"),
    )


#: Rows per JSON array document that a test file holds.
_ARRAY_ROWS = 100_000


@query("scan_json", "SELECT c_custkey, c_name, c_mktsegment, c_nationkey FROM customer")
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as JSON array documents, one per file, and read back."""
    path = scratch_path(spark, "customer-json")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    arrays = customers.groupBy(F.floor(F.col("c_custkey") / _ARRAY_ROWS).alias("part")).agg(
        F.to_json(F.collect_list(F.struct(*customers.columns))).alias("value")
    )
    arrays.write.partitionBy("part").text(path)
    ok, _ = read_json(spark, path)
    return ok.select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").cast("int").alias("c_nationkey"))


@query("scan_jsonl", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice FROM orders")
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders-jsonl")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"]
    table(spark, sf_dir, "orders").select(*columns).write.json(path)
    ok, _ = read_jsonl(spark, path)
    return ok.select(*columns)


def _workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Minimal workbooks, one per Arrow batch, as test input for the scan."""
    for number, batch in enumerate(batches):
        lines = [list(batch.columns)] + batch.astype(str).values.tolist()
        body = "".join(
            f'<row r="{r}">'
            + "".join(f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in enumerate(values))
            + "</row>"
            for r, values in enumerate(lines, 1)
        )
        main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        package = "http://schemas.openxmlformats.org/package/2006/relationships"
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr(
                "xl/workbook.xml",
                f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>',
            )
            book.writestr(
                "xl/_rels/workbook.xml.rels",
                f'<Relationships xmlns="{package}"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            )
            book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        yield pd.DataFrame({"path": [f"book-{number}.xlsx"], "content": [buffer.getvalue()]})


@query("workbook_scan", "SELECT p_partkey, p_name, p_type, p_size FROM part")
def workbook_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts packed into workbooks and unpacked again."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    rows, _ = scan_workbooks(parts.mapInPandas(_workbooks, "path string, content binary"))
    return sheet_table(rows, "data", parts.columns).select(
        F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", "p_type", F.col("p_size").cast("int").alias("p_size")
    )


@query("folder_inventory")
def folder_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the data folder with format, size and content digest (paths have no SQL twin).

    A file beyond the size limit of the policy is refused: it is listed without a digest and never read, so a task reads at most that limit.
    """
    artifacts, refused = inventory(spark, sf_dir)
    listed = artifacts.unionByName(refused.drop("violations"))
    return listed.join(content_digests(spark, sf_dir).select("path", "sha256"), "path", "left")


# --- transforms ------------------------------------------------------------------


def _evaluated(df: DataFrame, keys: list[str], expressions: dict) -> DataFrame:
    """Values and errors of every expression next to the keys."""
    compiled = {name: compile_expr(expression) for name, expression in expressions.items()}
    columns = []
    for name, item in compiled.items():
        columns += [item.value.alias(name), item.error.alias(f"{name}_error")]
    return df.select(*keys, *columns)


def _field(name: str, *operations: dict) -> dict:
    return {"field": name, "operations": list(operations)}


@query(
    "row_filter_dsl",
    """SELECT o_orderkey FROM (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS status, o_orderpriority AS priority,
      CASE o_orderpriority WHEN '5-LOW' THEN '' ELSE o_orderstatus END AS note FROM orders)
    WHERE status IS DISTINCT FROM 'F' AND priority NOT IN ('1-URGENT', '2-HIGH') AND (note IS NULL OR note = '')""",
)
def row_filter_dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderstatus")).alias("note"),
    )
    conditions = [
        {"field": "status", "op": "not_eq", "value": "F"},
        {"field": "priority", "op": "not_in", "value": ["1-URGENT", "2-HIGH"]},
        {"field": "note", "op": "not_present"},
    ]
    return row_filter(source, conditions).select("o_orderkey")


@query(
    "transform_text",
    """SELECT c_custkey, lower(c_name) AS name, CAST(NULL AS VARCHAR) AS name_error, upper(nullif(c_mktsegment, 'BUILDING')) AS segment,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'not_text' END AS segment_error,
      c_name || ':' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'None') || '!' AS label, CAST(NULL AS VARCHAR) AS label_error,
      'fixed' AS kind, CAST(NULL AS VARCHAR) AS kind_error FROM customer""",
)
def transform_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        F.concat(F.lit(" \t"), "c_name", F.lit("\n ")).alias("padded"),
        F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment_raw"),
    )
    return _evaluated(
        source,
        ["c_custkey"],
        {
            "name": _field("padded", {"op": "trim"}, {"op": "lower"}),
            "segment": _field("segment_raw", {"op": "trim"}, {"op": "upper"}),
            "label": {"template": "{c_name}:{segment_raw}!"},
            "kind": {"constant": "fixed"},
        },
    )


@query(
    "transform_numeric",
    """SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) END AS units,
      CASE WHEN l_linenumber = 7 THEN 'not_integer' END AS units_error,
      CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(l_extendedprice AS BIGINT) END AS whole_price,
      CASE WHEN l_extendedprice <> floor(l_extendedprice) THEN 'inexact_integer' END AS whole_price_error,
      CASE WHEN l_linenumber <> 7 THEN l_quantity END AS amount,
      CASE WHEN l_linenumber = 7 THEN 'not_number' END AS amount_error FROM lineitem""",
)
def transform_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).alias("raw"),
        "l_extendedprice",
    )
    return _evaluated(
        source,
        ["l_orderkey", "l_partkey", "l_linenumber"],
        {
            "units": _field("raw", {"op": "integer"}),
            "whole_price": _field("l_extendedprice", {"op": "integer"}),
            "amount": _field("raw", {"op": "number"}),
        },
    )


@query(
    "transform_boolean",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS finished,
      CASE WHEN o_orderstatus = 'P' THEN 'not_boolean' END AS finished_error FROM orders""",
)
def transform_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("o_orderstatus") == "F", " Yes").when(F.col("o_orderstatus") == "O", "f ").otherwise("on")
    source = table(spark, sf_dir, "orders").select("o_orderkey", word.alias("raw"))
    return _evaluated(source, ["o_orderkey"], {"finished": _field("raw", {"op": "boolean"})})


@query(
    "transform_datetime",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00'
        WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+02:00' END AS at,
      CASE WHEN o_orderstatus = 'P' THEN 'no_time_zone' END AS at_error,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+09:00' AS local, CAST(NULL AS VARCHAR) AS local_error FROM orders""",
)
def transform_datetime(spark: SparkSession, sf_dir: str) -> DataFrame:
    date, status = F.col("o_orderdate"), F.col("o_orderstatus")
    iso = F.date_format(date, "yyyy-MM-dd'T'HH:mm:ss")
    offset = F.when(status == "F", "Z").when(status == "O", "+0200").otherwise("")
    source = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(iso, offset).alias("raw"), F.date_format(date, "dd/MM/yyyy HH:mm").alias("day")
    )
    return _evaluated(
        source,
        ["o_orderkey"],
        {
            "at": _field("raw", {"op": "datetime"}),
            "local": _field("day", {"op": "datetime", "format": "%d/%m/%Y %H:%M", "timezone": "Asia/Tokyo"}),
        },
    )


@query(
    "transform_split",
    """SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(' ' || p_name || '  ' || p_type, ' '), lambda x: trim(x)),
      lambda x: x <> ''), '|') AS words FROM part""",
)
def transform_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.lit(" "), "p_name", F.lit("  "), "p_type").alias("raw")
    )
    item = compile_expr(_field("raw", {"op": "split", "delimiter": " "}))
    return source.select("p_partkey", F.concat_ws("|", item.value).alias("words"))


@query(
    "transform_map",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS level,
      CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'unmapped:' || o_orderpriority END AS level_error
    FROM orders""",
)
def transform_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
    return _evaluated(
        table(spark, sf_dir, "orders"), ["o_orderkey"], {"level": _field("o_orderpriority", {"op": "map", "values": values})}
    )


@query(
    "open_map_paths",
    """SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, CAST(NULL AS BIGINT) AS absent FROM events""",
)
def open_map_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    opened = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("v"))
    return opened.select(
        "event_id",
        F.try_variant_get(variant_path(F.col("v"), "k").column, "$", "bigint").alias("k"),
        F.try_variant_get(variant_path(F.col("v"), "a.b").column, "$", "bigint").alias("absent"),
    )


# --- profiles --------------------------------------------------------------------

#: All columns of all given tables with the type their values have.
_TYPED_TABLES = {
    "region": "r_regionkey integer, r_name string",
    "nation": "n_nationkey integer, n_name string, n_regionkey integer",
    "customer": "c_custkey integer, c_name string, c_nationkey integer, c_acctbal number, c_mktsegment string",
    "supplier": "s_suppkey integer, s_name string, s_nationkey integer, s_acctbal number",
    "part": "p_partkey integer, p_name string, p_brand string, p_type string, p_size integer, p_retailprice number",
    "orders": "o_orderkey integer, o_custkey integer, o_orderstatus string, o_totalprice number, o_orderdate string, o_orderpriority string",
    "lineitem": "l_orderkey integer, l_partkey integer, l_suppkey integer, l_linenumber integer, l_quantity number, l_extendedprice number, "
    "l_discount number, l_tax number, l_returnflag string, l_linestatus string, l_shipdate string",
    "events": "event_id integer, ts string, user_id integer, event_type string, value number, props string",
    "documents": "doc_id integer, text string, lang string, source string, n_chars integer",
    "embeddings": "vec_id integer, embedding array, label integer",
    "pages": "page_id integer, url string, html string",
    "benchmark": "item_id integer, text string",
    "labels": "doc_id integer, quality integer, toxic integer",
    "conversations": "conv_id integer, turn integer, role string, text string",
}


def _columns_of(spec: str) -> list[tuple[str, str]]:
    return [tuple(column.split()) for column in spec.split(", ")]


def _profile_sql() -> str:
    """One row per column; an empty string counts as missing in columns of text."""
    texts = ("note", "name", "brand", "type", "segment", "status", "priority", "flag", "props", "text", "lang", "source", "url", "html", "role")
    parts = []
    for name, spec in {**_TYPED_TABLES, "events": _TYPED_TABLES["events"] + ", note string"}.items():
        source = "(SELECT *, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN props END AS note FROM events)" if name == "events" else name
        for column, kind in _columns_of(spec):
            value = f"nullif({column}, '')" if kind == "string" and column.endswith(texts) else column
            parts.append(
                f"SELECT '{name}' AS artifact, '{column}' AS column_name, '{kind}' AS inferred_types, "
                f"count(*) - count({value}) AS missing, count(DISTINCT {value}) AS distinct_values, count(*) AS rows FROM {source}"
            )
    return " UNION ALL ".join(parts)


def _noted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn(
        "note", F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", F.col("props"))
    )


@query("profile_columns", _profile_sql())
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns of all tables, and one that is empty or null in part."""
    every = profile(_noted_events(spark, sf_dir), "events")
    for name in _TYPED_TABLES:
        if name != "events":
            every = every.unionByName(profile(table(spark, sf_dir, name), name))
    return every


def _fingerprint_sql() -> str:
    rows = ", ".join(
        f"('{name}', '{column.split()[0]}', '{column.split()[1]}')" for name, spec in _TYPED_TABLES.items() for column in spec.split(", ")
    )
    filled = " UNION ALL ".join(f"SELECT '{name}' AS artifact, count(*) AS n FROM {name}" for name in _TYPED_TABLES)
    item = (
        "'{\"artifact\":\"' || artifact || '\",\"column_name\":\"' || c || '\",\"inferred_types\":\"' || t || '\"}'"
    )
    return f"""WITH cols AS (SELECT * FROM (VALUES {rows}) v(artifact, c, t) JOIN ({filled}) USING (artifact) WHERE n > 0)
    SELECT artifact, count(*) AS columns, sha256('{{"columns":[' || string_agg({item}, ',' ORDER BY c) || ']}}') AS fingerprint
    FROM cols GROUP BY artifact"""


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [column_types(table(spark, sf_dir, name), name) for name in _TYPED_TABLES]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


@query("schema_fingerprint", _fingerprint_sql())
def schema_fingerprint_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_fingerprint(_types(spark, sf_dir), ["artifact"])


@query(
    "drift_gate",
    """SELECT 'labels' AS artifact, 'labels-mapping' AS mapping_id FROM labels LIMIT 1""",
)
def drift_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mappings whose source gained a column since they were approved."""
    approved = schema_fingerprint(_types(spark, sf_dir), ["artifact"]).select(
        "artifact",
        F.concat("artifact", F.lit("-mapping")).alias("mapping_id"),
        F.col("fingerprint").alias("source_schema_fingerprint"),
    )
    grown = table(spark, sf_dir, "labels").withColumn("reviewer", F.lit("r"))
    now = _types(spark, sf_dir).filter("artifact <> 'labels'").unionByName(column_types(grown, "labels"))
    return drifted(schema_fingerprint(now, ["artifact"]), approved).select("artifact", "mapping_id")


@query(
    "bounded_samples",
    """WITH lead AS (SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 5),
    cells AS (SELECT doc_id, unnest([0, 1]) AS i, unnest(['lang', 'text']) AS column_name, unnest([lang, text]) AS v FROM lead),
    cut AS (SELECT *, CASE WHEN length(v) > 512 THEN left(v, 512) || '…[truncated]' ELSE v END AS sample FROM cells)
    SELECT 'documents' AS artifact, doc_id AS row_key, column_name, sample, length(v) > 512 AS value_truncated FROM (
      SELECT *, sum(length(column_name) + length(sample)) OVER (ORDER BY doc_id, i) AS used FROM cut) WHERE used <= 20000""",
)
def bounded_samples_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_samples(table(spark, sf_dir, "documents"), "documents", "doc_id", ["lang", "text"])


# --- mapping runs ----------------------------------------------------------------

_TRIM = [{"op": "trim"}]
MAPPING = {
    "adapter_id": "order-mapping",
    "version": "1.0.0",
    "status": "approved",
    "source_schema_fingerprint": "0" * 64,
    "resources": {name: {"path": f"{name}.csv", "format": "csv"} for name in ("encounters", "notes", "claims", "charges", "activity")},
    "encounter": {
        "resource": "encounters",
        "where": [{"field": "status", "op": "present"}],
        "case_id": {"template": "CASE-{order_id}"},
        "patient_id": {"field": "customer_id", "operations": _TRIM},
        "encounter_id": {"field": "order_id", "operations": _TRIM},
        "admitted_at": {"field": "ordered_at", "operations": [{"op": "datetime"}]},
        "discharged_at": {"constant": "2000-01-01T00:00:00Z", "operations": [{"op": "datetime"}]},
        "metadata": {"priority": {"field": "priority", "operations": [{"op": "lower"}]}},
    },
    "documents": [
        {
            "resource": "notes",
            "encounter_id": {"field": "order_id"},
            "document_id": {"template": "note:{note_id}"},
            "author_role": {"field": "role", "operations": [{"op": "trim"}, {"op": "lower"}]},
            "recorded_at": {"constant": "2026-01-01T00:00:00Z", "operations": [{"op": "datetime"}]},
            "text": {"field": "text"},
        }
    ],
    "claim": {
        "resource": "claims",
        "where": [{"field": "status", "op": "not_eq", "value": "P"}],
        "encounter_id": {"field": "order_id"},
        "drg": {"field": "priority"},
        "allowed_amount_cents": {"field": "amount", "operations": [{"op": "integer"}]},
        "charges": {
            "resource": "charges",
            "where": [{"field": "status", "op": "eq", "value": "F"}],
            "encounter_id": {"field": "order_id"},
            "value": {"field": "code", "operations": [{"op": "trim"}, {"op": "upper"}]},
        },
    },
    "structured_projections": [
        {
            "projection_id": "activity-1",
            "resource": "activity",
            "encounter_id": {"field": "user_id"},
            "source_record_id": {"field": "event_id"},
            "evidence": {
                "evidence_id": {"template": "evidence:{kind}:{k}"},
                "document_id": {"template": "source:{kind}:{k}"},
                "author_role": {"constant": "source-system"},
                "recorded_at": {"constant": "2026-01-01T00:00:00Z", "operations": [{"op": "datetime"}]},
                "text": {"template": "KIND={kind}; K={k}"},
                "field_names": ["kind", "k"],
            },
            "entities": [
                {
                    "entity_id": {"template": "kind:{kind}"},
                    "entity_type": "Device",
                    "label": {"field": "kind"},
                    "properties": {"level": {"field": "kind", "operations": [{"op": "map", "values": {"click": 1, "view": 2, "purchase": 3, "signup": 4}}]}},
                }
            ],
            "relations": [
                {
                    "relation_id": {"template": "relation:{kind}:{k}"},
                    "predicate": "hasActivity",
                    "source_id": {"constant": "root:patient"},
                    "target_id": {"template": "kind:{kind}"},
                    "assertion_status": "present",
                    "documentation_status": "explicit",
                    "confidence": 1.0,
                    "cite_evidence": True,
                }
            ],
            "assertions": [
                {
                    "assertion_id": {"template": "assertion:{event_id}"},
                    "subject_id": {"template": "kind:{kind}"},
                    "concept": "activity",
                    "status": "present",
                    "documentation_status": "explicit",
                    "confidence": 0.9,
                    "attributes": {"k": {"field": "k", "operations": [{"op": "integer"}]}},
                }
            ],
        }
    ],
}


def mapping_resources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables as an export of strings with row numbers."""
    orders = table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.lower("p_type").alias("code"))
    order_id = F.col("o_orderkey").cast("string").alias("order_id")
    return {
        "encounters": orders.select(
            order_id,
            F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("customer_id"),
            F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("ordered_at"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).otherwise("").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            (F.col("o_orderkey") + 1).alias(ROW_NUMBER),
        ),
        "notes": table(spark, sf_dir, "documents").select(
            F.col("doc_id").cast("string").alias("order_id"),
            F.col("doc_id").cast("string").alias("note_id"),
            F.upper("lang").alias("role"),
            "text",
            (F.col("doc_id") + 1).alias(ROW_NUMBER),
        ),
        "claims": orders.select(
            order_id,
            F.col("o_orderstatus").alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string").alias("amount"),
            (F.col("o_orderkey") + 1).alias(ROW_NUMBER),
        ),
        "charges": table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(
            F.col("l_orderkey").cast("string").alias("order_id"),
            "code",
            F.col("l_linestatus").alias("status"),
            F.col("l_linenumber").cast("bigint").alias(ROW_NUMBER),
        ),
        "activity": events(spark, sf_dir).select(
            F.col("user_id").cast("string").alias("user_id"),
            F.col("event_id").cast("string").alias("event_id"),
            F.col("event_type").alias("kind"),
            F.col("k").cast("string").alias("k"),
            (F.col("event_id") + 1).alias(ROW_NUMBER),
        ),
    }


_KNOWN_SQL = """known AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderdate FROM orders
      WHERE o_orderpriority <> '5-LOW' AND o_orderdate <= TIMESTAMP '2000-01-01')"""


@query(
    "mapping_cases",
    f"""WITH {_KNOWN_SQL} SELECT 'CASE-' || o_orderkey AS case_id, CAST(o_custkey AS VARCHAR) AS patient_id,
      CAST(o_orderkey AS VARCHAR) AS encounter_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS admitted_at,
      lower(o_orderpriority) AS priority FROM known""",
)
def mapping_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = run_mapping(mapping_resources(spark, sf_dir), MAPPING, as_of=AS_OF, outputs=["cases"])["cases"]
    return cases.select(
        "case_id", "patient_id", "encounter_id", "admitted_at", F.try_variant_get("metadata", "$.priority", "string").alias("priority")
    )


@query(
    "mapping_claims",
    f"""WITH {_KNOWN_SQL}, codes AS (SELECT l_orderkey, string_agg(p_type, '|' ORDER BY first_row, p_type) AS charges FROM (
        SELECT l_orderkey, p_type, min(l_linenumber) AS first_row FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY l_orderkey)
    SELECT CAST(o_orderkey AS VARCHAR) AS encounter_id, o_orderpriority AS drg, CAST(round(o_totalprice * 100) AS BIGINT) AS allowed_amount_cents,
      coalesce(charges, '') AS charges FROM known LEFT JOIN codes ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'""",
)
def mapping_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = run_mapping(mapping_resources(spark, sf_dir), MAPPING, as_of=AS_OF, outputs=["claims"])["claims"]
    return claims.select("encounter_id", "drg", "allowed_amount_cents", F.concat_ws("|", "charges").alias("charges"))


@query(
    "structured_projection",
    f"""WITH {_KNOWN_SQL} SELECT CAST(user_id AS VARCHAR) AS encounter_id, 'assertion:' || event_id AS assertion_id,
      'kind:' || event_type AS subject_id, 'evidence:' || event_type || ':' || (props->>'$.k') AS evidence_id,
      CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE event_type <> 'error' AND user_id IN (SELECT o_orderkey FROM known)""",
)
def structured_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    assertions = run_mapping(mapping_resources(spark, sf_dir), MAPPING, as_of=AS_OF, outputs=["structured"])["assertions"]
    return assertions.select(
        "encounter_id",
        "assertion_id",
        "subject_id",
        F.col("evidence_ids")[0].alias("evidence_id"),
        F.get_json_object("attributes", "$.k").cast("bigint").alias("k"),
    )


@query(
    "run_report",
    f"""WITH {_KNOWN_SQL}, acts AS (SELECT user_id, event_type, props->>'$.k' AS k, user_id IN (SELECT o_orderkey FROM known) AS ok,
        event_type = 'error' AS bad FROM events),
    good AS (SELECT * FROM acts WHERE ok AND NOT bad),
    lines AS (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F')
    SELECT 'input' AS side, 'encounters' AS table_name, count(*) AS rows FROM orders
    UNION ALL SELECT 'input', 'claims', count(*) FROM orders
    UNION ALL SELECT 'input', 'notes', count(*) FROM documents
    UNION ALL SELECT 'input', 'charges', count(*) FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION ALL SELECT 'input', 'activity', count(*) FROM events
    UNION ALL SELECT 'output', 'cases', count(*) FROM known
    UNION ALL SELECT 'output', 'documents', count(*) FROM documents WHERE doc_id IN (SELECT o_orderkey FROM known)
    UNION ALL SELECT 'output', 'claims', count(*) FROM known WHERE o_orderstatus <> 'P'
    UNION ALL SELECT 'output', 'evidence', count(*) FROM (SELECT user_id, event_type, k FROM good GROUP BY ALL HAVING count(*) = 1)
    UNION ALL SELECT 'output', 'relations', count(*) FROM (SELECT DISTINCT user_id, event_type, k FROM good)
    UNION ALL SELECT 'output', 'entities', count(*) FROM (SELECT DISTINCT user_id, event_type FROM good)
    UNION ALL SELECT 'output', 'assertions', count(*) FROM good
    UNION ALL SELECT 'output', 'rejects',
      (SELECT count(*) FROM orders WHERE o_orderpriority <> '5-LOW' AND o_orderdate > TIMESTAMP '2000-01-01')
      + (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT o_orderkey FROM known))
      + (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT o_orderkey FROM known))
      + (SELECT count(*) FROM known WHERE o_orderstatus = 'P')
      + (SELECT count(*) FROM lines WHERE l_orderkey NOT IN (SELECT o_orderkey FROM known))
      + (SELECT count(*) FROM (SELECT user_id, event_type, k FROM good GROUP BY ALL HAVING count(*) > 1))
      + (SELECT count(*) FROM acts WHERE bad) + (SELECT count(*) FROM acts WHERE NOT bad AND NOT ok)""",
)
def run_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of a whole mapping run over all tables, rejects included.

    Evidence that shares an id but comes from different rows is a conflict, as
    its locator names the row.
    """
    return run_mapping(mapping_resources(spark, sf_dir), MAPPING, as_of=AS_OF)["report"].drop("fingerprint")


@query(
    "mapping_check",
    """SELECT 'documents[0].text' AS location, 'unknown field body' AS error FROM orders LIMIT 1""",
)
def mapping_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields a mapping reads against the columns profiled in its resources."""
    resources = mapping_resources(spark, sf_dir)
    types = [column_types(df, name) for name, df in resources.items()]
    profiles = types[0]
    for part in types[1:]:
        profiles = profiles.unionByName(part)
    broken = {**MAPPING, "documents": [{**MAPPING["documents"][0], "text": {"field": "body"}}]}
    names = spark.createDataFrame([("Device", False)], "class_id string, abstract boolean")
    predicates = spark.createDataFrame([("hasActivity",)], "relation_id string")
    return check_mapping(spark, broken, profiles, names, predicates, {name: name for name in resources})


@query(
    "bundle_manifest",
    """SELECT row_number() OVER (ORDER BY o_orderkey) AS position, 'CASE-' || o_orderkey AS case_id, o_orderkey AS encounter_id,
      lpad(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR), CAST(greatest(6, length(CAST(row_number() OVER (ORDER BY o_orderkey) AS VARCHAR))) AS INTEGER), '0') || '-' || substr(sha256('CASE-' || o_orderkey), 1, 12)
        || '.source-bundle.json' AS file FROM orders""",
)
def bundle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "orders").select(
        text_id("CASE-", "o_orderkey").alias("case_id"), F.col("o_orderkey").alias("encounter_id")
    )
    return manifest(cases, "encounter_id", width=1 << 20)


@query(
    "projected_rejects",
    """SELECT event_id, 'level unmapped:error' AS violation FROM events WHERE event_type = 'error'""",
)
def projected_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose expressions fail, with the reason."""
    source = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    level = {"field": "kind", "operations": [{"op": "map", "values": {"click": 1, "view": 2, "purchase": 3, "signup": 4}}]}
    _, rejects = project_rows(source, {"level": compile_expr(level)}, keep=["event_id"])
    return rejects.select("event_id", F.col("violations")[0].alias("violation"))
