"""Children, claims and code collections joined to encounters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.operators.attach import (
    attach_children,
    attach_claims,
    collect_codes,
    dedup_or_conflict,
    missing_claims,
    multiple_claims,
)
from claimweave.operators.checks import check_interval, orphans
from claimweave.plans.bindings import cents, table
from claimweave.plans.registry import query


def _encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("encounter_id"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes: the character count points at an encounter, source and language name the note."""
    return table(spark, sf_dir, "documents").select(
        F.col("n_chars").alias("encounter_id"), F.concat("source", F.lit("-"), "lang").alias("document_id"), "doc_id"
    )


_NOTES_SQL = """notes AS (SELECT n_chars AS encounter_id, source || '-' || lang AS document_id, doc_id,
  count(*) OVER (PARTITION BY n_chars, source, lang) AS copies,
  EXISTS (SELECT 1 FROM orders WHERE o_orderkey = n_chars) AS known FROM documents)"""


@query(
    "encounter_documents",
    f"WITH {_NOTES_SQL} SELECT encounter_id, document_id, doc_id FROM notes WHERE known AND copies = 1",
)
def encounter_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = attach_children(_encounters(spark, sf_dir), _notes(spark, sf_dir), "encounter_id", "document_id")
    return ok.select("encounter_id", "document_id", "doc_id")


@query(
    "document_rejects",
    f"""WITH {_NOTES_SQL} SELECT doc_id, concat_ws('|', CASE WHEN NOT known THEN 'unknown_parent' END,
      CASE WHEN copies > 1 THEN 'duplicate_id' END) AS violations FROM notes WHERE NOT known OR copies > 1""",
)
def document_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejects = attach_children(_encounters(spark, sf_dir), _notes(spark, sf_dir), "encounter_id", "document_id")
    return rejects.select("doc_id", F.concat_ws("|", "violations").alias("violations"))


@query(
    "orphan_children",
    "SELECT doc_id, n_chars FROM documents WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = n_chars)",
)
def orphan_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("n_chars"))
    return orphans(notes, parents, ["n_chars"])


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("encounter_id"), cents(F.col("l_extendedprice")).alias("amount_cents")
    )


@query(
    "missing_claims",
    "SELECT o_orderkey AS encounter_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
)
def missing_claims_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_claims(_encounters(spark, sf_dir), _lines(spark, sf_dir), "encounter_id")


@query(
    "multiple_claims",
    "SELECT l_orderkey AS encounter_id, count(*) AS claim_rows FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)
def multiple_claims_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiple_claims(_lines(spark, sf_dir), "encounter_id")


@query(
    "single_claims",
    """SELECT l_orderkey AS encounter_id, CAST(round(any_value(l_extendedprice) * 100) AS BIGINT) AS amount_cents
    FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1""",
)
def single_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encounters with exactly one claim row, together with it."""
    ok, _ = attach_claims(_encounters(spark, sf_dir), _lines(spark, sf_dir), "encounter_id")
    return ok


@query(
    "claim_collections",
    """SELECT l_orderkey, string_agg(p_type, '|' ORDER BY first_row, p_type) AS charges, count(*) AS codes FROM (
      SELECT l_orderkey, p_type, min(l_linenumber) AS first_row FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
    GROUP BY l_orderkey""",
)
def claim_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    codes = collect_codes(lines.join(part, "l_partkey"), "l_orderkey", "p_type", "l_linenumber", "charges")
    return codes.select(
        "l_orderkey",
        F.concat_ws("|", "charges").alias("charges"),
        F.size("charges").cast("bigint").alias("codes"),
    )


def _upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of a line per (order, line number): copies agree on some and conflict on others."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query(
    "conflicting_upserts",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber
    HAVING count(DISTINCT l_returnflag || l_linestatus) > 1""",
)
def conflicting_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, conflicts = dedup_or_conflict(_upserts(spark, sf_dir), ["l_orderkey", "l_linenumber"])
    return conflicts.drop("violations")


@query(
    "collapsed_upserts",
    """SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(DISTINCT l_returnflag || l_linestatus) = 1""",
)
def collapsed_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, _ = dedup_or_conflict(_upserts(spark, sf_dir), ["l_orderkey", "l_linenumber"])
    return ok


@query(
    "interval_check",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE o_orderdate > l_shipdate""",
)
def interval_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped before their order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    _, rejects = check_interval(lines.join(orders, "l_orderkey"), F.col("o_orderdate"), F.col("l_shipdate"))
    return rejects.select("l_orderkey", "l_linenumber", "l_partkey")
