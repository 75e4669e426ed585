"""Delimited and JSON resources with dense row numbers and header checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimweave.operators.scale import reasons, split_rejects
from claimweave.session import materialize

ROW_NUMBER = "_row_number"
REJECTS = f"file string, {ROW_NUMBER} bigint, violations array<string>"
#: Rows per resource beyond which a resource is refused.
MAX_ROWS_PER_RESOURCE = 2_000_000


def header_violations(header: Column) -> Column:
    """Checks on a header line given as an array of names."""
    return reasons(
        empty_header=(F.size(header) == 0) | F.exists(header, lambda name: name == ""),
        duplicate_header=F.size(header) != F.size(F.array_distinct(header)),
        reserved_header=F.array_contains(header, ROW_NUMBER),
    )


def parse_header(line: Column) -> Column:
    """Names of a header line; a byte order mark and quotes are removed."""
    names = F.split(F.regexp_replace(line, "^﻿", ""), _CELL_BREAK)
    return F.transform(names, lambda name: F.replace(F.regexp_replace(name, '^"|"\\s*$', ""), F.lit('""'), F.lit('"')))


def read_headers(spark: SparkSession, path: str, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """``(ok, rejects)`` of the files below a folder by their header line.

    The first line of a file is the smallest line number of its first block, a
    ``min`` aggregate over the text lines.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        .withColumn("_line", F.monotonically_increasing_id())
        .filter(F.col("start") == 0)
    )
    first = lines.groupBy("file").agg(F.min_by("value", "_line").alias("line"))
    headers = first.select("file", parse_header(F.col("line")).alias("header"))
    return split_rejects(headers, header_violations(F.col("header")))


def number_rows(df: DataFrame, name: str = ROW_NUMBER) -> DataFrame:
    """Dense, 1-based physical row numbers per file (``df`` carries ``_file`` and ``_block``).

    The parsed rows are written once with their row ids, so the text is parsed a
    single time and the ids cannot change between the passes below.  A block is
    read by one task in order: the position inside it follows from the ids, and
    the blocks before it give the offset.  The offset table has one row per
    block; no global sort and no single-task window over the rows.
    """
    marked = materialize(df.withColumn("_id", F.monotonically_increasing_id()), "parsed")
    blocks = marked.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return (
        marked.join(offsets, ["_file", "_block"])
        .withColumn(name, F.col("_id") - F.col("_first") + F.col("_offset") + 1)
        .drop("_id", "_first", "_offset", "_block")
    )


def _located(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


_CORRUPT = "_corrupt_record"
#: Commas outside quotes.
_CELL_BREAK = ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"
#: A cell that is put after the last one of a record, to tell a missing cell from an empty one.
_END = "\u0001"
_CSV = {"sep": ",", "quote": '"', "escape": '"', "emptyValue": "", "mode": "PERMISSIVE"}


def csv_records(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """``(_file, _row_number, record)``: raw records of delimited files; record 0 of a file is its header.

    Files are parsed for one column only, so the parser hands over every record of more cells as it stands.
    """
    reader = spark.read.schema(f"_first string, {_CORRUPT} string").options(**_CSV).option("header", False)
    rows = reader.option("multiLine", multi_line).option("columnNameOfCorruptRecord", _CORRUPT).csv(path)
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("_first", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    raw = F.regexp_replace(F.coalesce(_CORRUPT, quoted), "\r?\n$", "")
    numbered = number_rows(_located(rows).select("_file", "_block", raw.alias("record")))
    return numbered.select("_file", (F.col(ROW_NUMBER) - 1).alias(ROW_NUMBER), "record")


def csv_layouts(records: DataFrame) -> DataFrame:
    """``(_file, header, violations)``: the column names of every file, from its own first record."""
    headers = records.filter(F.col(ROW_NUMBER) == 0).select("_file", parse_header(F.col("record")).alias("header"))
    return headers.withColumn("violations", header_violations(F.col("header")))


def read_csv_checked(spark: SparkSession, path: str, *, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)``: all cells as strings, no inference; every file is read by its own header.

    Columns are aligned by name: the result has all names of all usable headers, in order of files and places, and a
    column that a file lacks is null there.  An empty cell is ``''`` and the cells that a short row lacks are null.
    Records with too many cells are rejects (an open quote takes the rest of its file into one cell); of a file with an unusable header every record is one,
    the header itself as row 0, so rows, rejects and usable headers add up to the records.  An empty file is a reject too.
    ``multi_line`` allows line breaks inside quotes at the price of one task per file; plain files can turn
    it off to be split.
    """
    records = materialize(csv_records(spark, path, multi_line=multi_line), "records")
    layouts = materialize(csv_layouts(records), "layouts")
    usable = layouts.filter(F.size("violations") == 0)
    # One row per layout, not per file.
    distinct = usable.groupBy("header").agg(F.min("_file").alias("first")).orderBy("first").collect()
    names = list(dict.fromkeys(name for row in distinct for name in row["header"]))
    widest = max((len(row["header"]) for row in distinct), default=0)

    places = F.array(*[F.array_position("header", F.lit(name)).cast("int") for name in names]) if names else F.array().cast("array<int>")
    placed = usable.select("_file", F.size("header").alias("_width"), places.alias("_places"))
    body = records.filter(F.col(ROW_NUMBER) > 0).join(placed, "_file")
    schema = ", ".join(f"c{i} string" for i in range(widest + 1))
    parsed = F.from_csv(F.concat("record", F.lit(f',"{_END}"')), schema, _CSV)
    cells = body.withColumn("_parsed", parsed).withColumn("_cells", F.array(*[F.col(f"_parsed.c{i}") for i in range(widest + 1)]))
    # The last end mark counts the cells before it; without one there are more cells than any header has.
    back = F.array_position(F.reverse("_cells"), F.lit(_END)).cast("int")
    count = F.when(back > 0, F.lit(widest + 1) - back)
    counted = cells.withColumn("_count", count)
    too_many = F.coalesce(F.col("_count") > F.col("_width"), F.lit(True))
    filled = [
        F.when((F.get("_places", F.lit(i)) > 0) & (F.get("_places", F.lit(i)) <= F.col("_count")), F.coalesce(F.get("_cells", F.get("_places", F.lit(i)) - 1), F.lit(""))).alias(name)
        for i, name in enumerate(names)
    ]
    ok = counted.filter(~too_many).select(*filled, ROW_NUMBER)
    wrong = counted.filter(too_many).select("_file", ROW_NUMBER, "record", F.array(F.lit("too_many_cells")).alias("violations"))
    unusable = layouts.filter(F.size("violations") > 0).select("_file", "violations")
    whole = records.join(unusable, "_file").select("_file", ROW_NUMBER, "record", "violations")
    # Scans leave empty files out; the listing, which the driver holds anyway, names them.
    listed = [(name,) for name in spark.read.schema("value string").text(path).inputFiles()]
    one_slash = lambda column: F.regexp_replace(column, "^([a-z0-9]+):/+", "$1:/")
    read = layouts.select(one_slash(F.col("_file")).alias("_name"))
    hollow = spark.createDataFrame(listed, "_file string").withColumn("_name", one_slash(F.col("_file"))).join(read, "_name", "left_anti")
    hollow = hollow.select("_file", F.lit(0).alias(ROW_NUMBER), F.lit("").alias("record"), F.array(F.lit("empty_file")).alias("violations"))
    rejects = wrong.unionByName(whole).unionByName(hollow)
    return ok, rejects.select(F.col("_file").alias("file"), ROW_NUMBER, F.col("record").alias(_CORRUPT), "violations")


def read_csv(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Rows of files without any reject; a reject is an error that names the first ones."""
    rows, rejects = read_csv_checked(spark, path, multi_line=multi_line)
    first = rejects.select("file", ROW_NUMBER, "violations").limit(3).collect()
    if first:
        kind = "unusable header" if any(r[ROW_NUMBER] == 0 for r in first) else "unusable records"
        raise ValueError(f"{kind} in {path}: {[tuple(r) for r in first]}")
    return rows


def _json_schema(spark: SparkSession, path: str, multi_line: bool) -> T.StructType:
    inferred = spark.read.option("multiLine", multi_line).option("primitivesAsString", False).json(path).schema
    fields = [field for field in inferred.fields if field.name != _CORRUPT]
    return T.StructType(fields + [T.StructField(_CORRUPT, T.StringType())])


def read_json(
    spark: SparkSession, path: str, *, schema: T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """A top-level object is one row, an array many; a bad element rejects its file."""
    shape = schema or _json_schema(spark, path, True)
    return _split_corrupt(spark.read.schema(shape).option("multiLine", True).json(path))


def read_jsonl(
    spark: SparkSession, path: str, *, schema: T.StructType | None = None
) -> tuple[DataFrame, DataFrame]:
    """One object per line; blank lines are skipped, other lines that are no object are rejects."""
    shape = schema or _json_schema(spark, path, False)
    return _split_corrupt(spark.read.schema(shape).json(path))


def _split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    numbered = number_rows(_located(df))
    if _CORRUPT not in df.columns:
        numbered = numbered.withColumn(_CORRUPT, F.lit(None).cast("string"))
    ok = numbered.filter(F.col(_CORRUPT).isNull()).drop(_CORRUPT, "_file")
    rejects = numbered.filter(F.col(_CORRUPT).isNotNull()).select(
        F.col("_file").alias("file"), ROW_NUMBER, _CORRUPT, F.array(F.lit("not_an_object")).alias("violations")
    )
    return ok, rejects


def over_row_budget(df: DataFrame, resource: str, limit: int = MAX_ROWS_PER_RESOURCE) -> DataFrame:
    """One row when a resource holds more rows than the policy allows."""
    return df.agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit).select(F.lit(resource).alias("resource"), "rows")


Reader = Callable[..., "tuple[DataFrame, DataFrame] | DataFrame"]


class Readers:
    """Formats by name; further formats are registered by the caller.  Every reader gives ``(rows, rejects)``."""

    def __init__(self) -> None:
        from claimweave.sources.workbook import read_workbook_sheet

        self._readers: dict[str, Reader] = {
            "csv": read_csv_checked,
            "json": read_json,
            "jsonl": read_jsonl,
            "xlsx": read_workbook_sheet,
        }

    def register(self, name: str, reader: Reader) -> None:
        """A reader takes the session, the path and what else the resource names; it may return rows alone."""
        if not name or name in self._readers:
            raise ValueError(f"reader already registered or invalid: {name!r}")
        self._readers[name] = reader

    def read(self, spark: SparkSession, path: str, fmt: str, **options: str) -> tuple[DataFrame, DataFrame]:
        if fmt not in self._readers:
            raise ValueError(f"no reader registered for {fmt}")
        found = self._readers[fmt](spark, path, **options)
        rows, rejects = found if isinstance(found, tuple) else (found, spark.createDataFrame([], REJECTS))
        for name, kind in (("file", "string"), (ROW_NUMBER, "bigint")):
            if name not in rejects.columns:
                rejects = rejects.withColumn(name, F.lit(None).cast(kind))
        return rows, rejects.select("file", F.col(ROW_NUMBER).cast("bigint").alias(ROW_NUMBER), "violations")

    def read_all(
        self, spark: SparkSession, root: str, resources: Mapping[str, Mapping[str, str]]
    ) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        """Rows and rejects of every resource; ``run_mapping`` takes both."""
        rows, rejects = {}, {}
        for name, item in resources.items():
            options = {k: v for k, v in item.items() if k in ("sheet",)}
            rows[name], rejects[name] = self.read(spark, f"{root}/{item['path']}", item["format"], **options)
        return rows, rejects
