"""Line deduplication: lines that many documents share are dropped everywhere; DataFrame functions only.

Lines are exploded and normalised, hashed, counted once per document, and the lines
of frequent hashes are cut out of every text by their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.session import materialize

MIN_DOCUMENTS = 10
MIN_KEY_CHARS = 1

#: The characters of ``[\x20\x09-\x0D]``.
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """A line without white space at both ends and with ASCII capitals lowered; other letters stay as they are."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(*columns: Column) -> list[Column]:
    """128 bits as two columns."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("line"), *columns).alias("h2")]


def frequent_lines(
    docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_chars: int = MIN_KEY_CHARS, text_col: str = "text"
) -> DataFrame:
    """``(h1, h2, documents)`` of the line keys found in at least ``min_documents`` rows of ``docs``.

    A row counts once however often it repeats a line; counts are combined
    before the shuffle, so a line that all documents share costs one row per task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.explode(F.array_distinct(F.transform(_lines(text), line_key))).alias("key"))
    hashed = keys.filter(F.char_length("key") >= min_chars).select(*_hashes(F.col("key")))
    counted = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("documents"))
    return counted.filter(F.col("documents") >= min_documents)


def drop_frequent_lines(
    docs: DataFrame,
    min_documents: int = MIN_DOCUMENTS,
    min_chars: int = MIN_KEY_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text, n_lines, n_dropped, kept_text)`` of every row of ``docs``.

    A line whose key has at least ``min_chars`` code points and occurs in at least
    ``min_documents`` rows goes from every text; the others stay, joined by line feeds.

    Null and empty texts are one empty line. Rows are documents, so repeated rows
    count one by one and each gets its row back; null ids are treated like any other. Ids may tie.
    Other columns are ignored, whatever their names; an empty table gives an empty table.
    A text of any length works in time linear in its lines.
    """
    # Only the positions of dropped lines travel, and each text once.  Equal rows share their positions,
    # so 128 bits of id and text name a row; the two stored tables keep joins between plain exchanges,
    # which Spark can split where a line or a row is hot.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    frequent = materialize(frequent_lines(rows, min_documents, min_chars).select("h1", "h2"), "frequent-lines")

    name = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text")]
    named = rows.select("doc_id", "text", F.xxhash64(*name).alias("k1"), F.xxhash64(F.lit("row"), *name).alias("k2"))
    lines = named.select("k1", "k2", F.posexplode(_lines(F.col("text"))).alias("position", "line"))
    keyed = lines.select("k1", "k2", "position", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
    hit = keyed.select("k1", "k2", "position", *_hashes(F.col("key"))).join(frequent, ["h1", "h2"], "left_semi")
    dropped = hit.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("position")).alias("dropped"))
    dropped = materialize(dropped, "dropped-lines")

    found = named.join(dropped, ["k1", "k2"], "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    # Runs of kept lines between two dropped ones are sliced out; the split is bound once per row.
    n = F.size("dropped")

    def kept(lines: Column) -> Column:
        def run(k: Column) -> Column:
            first = F.when(k == 0, 0).otherwise(F.get(F.col("dropped"), k - 1) + 1)
            end = F.when(k == n, F.size(lines)).otherwise(F.get(F.col("dropped"), k))
            return F.slice(lines, first + 1, end - first)

        runs = F.transform(F.sequence(F.lit(0), n), run)
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), F.array_join(F.flatten(runs), "\n").alias("kept_text"))

    split = F.when(n > 0, F.get(F.transform(F.array(_lines(F.col("text"))), kept), F.lit(0)))
    whole = F.struct(F.size(_lines(F.col("text"))).cast("bigint").alias("n_lines"), F.col("text").alias("kept_text"))
    result = found.select("doc_id", "text", n.cast("bigint").alias("n_dropped"), F.coalesce(split, whole).alias("result"))
    return result.select("doc_id", "text", "result.n_lines", "n_dropped", "result.kept_text")
