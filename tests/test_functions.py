import hashlib
import json

import pytest
from pyspark.sql import functions as F

from claimweave.functions.canonical import canonical_hash, dataset_fingerprint
from claimweave.functions.codes import apply_change, group_and_price
from claimweave.functions.conditions import Typed, compile_condition, row_filter, variant_path
from claimweave.functions.transforms import compile_expr, optional_string, required_datetime, required_string, spark_pattern


def evaluate(spark, value, operations, compiler=compile_expr, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    item = compiler({"field": "x", "operations": operations})
    return tuple(df.select(item.value.alias("v"), item.error.alias("e")).head())


def test_text_operations_strip_any_whitespace_and_refuse_null(spark):
    assert evaluate(spark, "\t Ab \n", [{"op": "trim"}, {"op": "upper"}]) == ("AB", None)
    assert evaluate(spark, None, [{"op": "trim"}]) == (None, "not_text")


@pytest.mark.parametrize(
    "raw, value, error",
    [
        ("12", 12, None),
        (" 1e3 ", 1000, None),
        ("1.5", None, "inexact_integer"),
        ("abc", None, "not_integer"),
        (None, None, "not_integer"),
    ],
)
def test_integer(spark, raw, value, error):
    assert evaluate(spark, raw, [{"op": "integer"}]) == (value, error)


def test_boolean_words(spark):
    assert evaluate(spark, " YES ", [{"op": "boolean"}]) == (True, None)
    assert evaluate(spark, "0", [{"op": "boolean"}]) == (False, None)
    assert evaluate(spark, "on", [{"op": "boolean"}])[1] == "not_boolean"
    assert evaluate(spark, True, [{"op": "integer"}], kind="boolean")[1] == "boolean_not_integer"


@pytest.mark.parametrize(
    "raw, operation, value",
    [
        ("2026-06-01T08:00:00Z", {}, "2026-06-01T08:00:00+00:00"),
        ("2026-06-01 08:00:00.120+0230", {}, "2026-06-01T08:00:00.120000+02:30"),
        ("2026-06-01T08:00:00", {"timezone": "America/New_York"}, "2026-06-01T08:00:00-04:00"),
        ("2026-12-01T08:00:00", {"timezone": "America/New_York"}, "2026-12-01T08:00:00-05:00"),
        ("01/06/2026 08:30", {"format": "%d/%m/%Y %H:%M", "timezone": "Asia/Tokyo"}, "2026-06-01T08:30:00+09:00"),
        ("01/06/2026 08:30 +0100", {"format": "%d/%m/%Y %H:%M %z"}, "2026-06-01T08:30:00+01:00"),
    ],
)
def test_datetime(spark, raw, operation, value):
    assert evaluate(spark, raw, [{"op": "datetime", **operation}]) == (value, None)


def test_datetime_errors(spark):
    assert evaluate(spark, "2026-06-01T08:00:00", [{"op": "datetime"}])[1] == "no_time_zone"
    assert evaluate(spark, "soon", [{"op": "datetime"}])[1] == "not_datetime"
    assert evaluate(spark, "2026-06-01T08:00:00", [], required_datetime)[1] == "no_utc_offset"
    with pytest.raises(ValueError):
        spark_pattern("%Q")


def test_split_map_template_and_required(spark):
    assert evaluate(spark, "a. b ..c", [{"op": "split", "delimiter": "."}])[0] == ["a", "b", "c"]
    assert evaluate(spark, "IV", [{"op": "map", "values": {"IV": "4"}}]) == ("4", None)
    assert evaluate(spark, "V", [{"op": "map", "values": {"IV": "4"}}]) == (None, "unmapped:V")
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(compile_expr({"template": "{x}:{y}!"}).value).head()[0] == "a:None!"
    assert evaluate(spark, "  ", [], required_string)[1] == "blank"
    assert evaluate(spark, "", [], optional_string) == (None, None)


def test_row_filter_treats_null_as_different(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "id int, x string")

    def ids(*conditions):
        return [r.id for r in row_filter(df, conditions).orderBy("id").collect()]

    assert ids({"field": "x", "op": "not_eq", "value": "a"}) == [2, 3]
    assert ids({"field": "x", "op": "not_in", "value": ["a", ""]}) == [2]
    assert ids({"field": "x", "op": "present"}) == [1]
    assert ids({"field": "x", "op": "not_present"}) == [2, 3]


CONDITIONS = [
    ({"field": "a.n", "op": "eq", "value": 4}, True),
    ({"field": "a.n", "op": "eq", "value": "4"}, False),
    ({"field": "a.s", "op": "eq", "value": "4"}, True),
    ({"field": "a.s", "op": "gte", "value": 1}, False),
    ({"field": "a.none", "op": "ne", "value": 1}, False),
    ({"not": {"field": "a.none", "op": "eq", "value": 1}}, True),
    ({"field": "a.none", "op": "exists", "value": False}, True),
    ({"field": "a.b.c", "op": "exists", "value": True}, True),
    ({"field": "a.l", "op": "contains", "value": "x"}, True),
    ({"field": "a.l", "op": "not_contains", "value": "y"}, True),
    ({"field": "a.none", "op": "not_contains", "value": "y"}, False),
    ({"field": "a.s2", "op": "contains", "value": "el"}, True),
    ({"field": "a.b", "op": "contains", "value": "c"}, True),
    ({"field": "a.f", "op": "gte", "value": 0}, False),
    ({"any": [{"field": "a.n", "op": "lte", "value": 3}, {"field": "a.n", "op": "in", "value": [4, 5]}]}, True),
]


@pytest.mark.parametrize("condition, expected", CONDITIONS)
def test_rule_conditions_are_two_valued(spark, condition, expected):
    body = {"n": 4, "s": "4", "s2": "hello", "l": ["x"], "b": {"c": 1}, "f": True}
    df = spark.createDataFrame([(json.dumps(body),)], "j string").select(F.parse_json("j").alias("a"))

    def resolve(path):
        return variant_path(F.col("a"), path.removeprefix("a."))

    assert df.select(compile_condition(condition, resolve)).head()[0] is expected


def test_typed_columns_and_unknown_fields(spark):
    df = spark.createDataFrame([("b", ["p", "q"])], "s string, l array<string>")
    kinds = {"s": "string", "l": "array"}
    resolve = lambda path: Typed(F.col(path), kinds[path]) if path in kinds else None
    assert df.select(compile_condition({"field": "s", "op": "gte", "value": "a"}, resolve)).head()[0]
    assert df.select(compile_condition({"field": "l", "op": "contains", "value": "q"}, resolve)).head()[0]
    assert not df.select(compile_condition({"field": "zzz", "op": "eq", "value": 1}, resolve)).head()[0]


def test_claim_change_and_price(spark):
    df = spark.createDataFrame([(["A", "B", "A"],)], "codes array<string>")
    change = apply_change(F.col("codes"), F.array(F.lit("C"), F.lit("B"), F.lit("C")), F.array(F.lit("A")))
    assert df.select(change).head()[0] == ["B", "C"]
    claims = spark.createDataFrame([(["L89.154"],), (["L89.2"],), (["X"],), ([],)], "d array<string>")
    rows = [r.g for r in claims.select(group_and_price(F.col("d")).alias("g")).collect()]
    assert [(r.group, r.cents) for r in rows] == [
        ("DEMO-290", 1_842_000),
        ("DEMO-291", 1_280_000),
        ("DEMO-292", 1_000_000),
        ("DEMO-292", 1_000_000),
    ]


def test_canonical_hash_equals_json_digest(spark):
    body = {"b": None, "a": "ü/\"", "c": [1, 2]}
    df = spark.createDataFrame([("ü/\"", None, [1, 2])], "a string, b string, c array<int>")
    want = hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert df.select(canonical_hash(b=F.col("b"), a=F.col("a"), c=F.col("c"))).head()[0] == want


def test_dataset_fingerprint_ignores_order_and_counts_copies(spark):
    rows = [(i, f"v{i % 7}") for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v string")
    one = dataset_fingerprint(df.repartition(1), ["id", "v"]).head()
    assert one == dataset_fingerprint(df.repartition(17), ["v", "id"]).head()
    assert one != dataset_fingerprint(df.unionByName(df.limit(1)), ["id", "v"]).head()
    assert one.fingerprint != dataset_fingerprint(df.withColumn("v", F.upper("v")), ["id", "v"]).head().fingerprint
