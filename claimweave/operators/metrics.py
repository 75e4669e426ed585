"""Quality and workload measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate(labels: DataFrame, predictions: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of predicted against valid labelled keys, as sets.

    ``by`` must be among ``keys``; an empty denominator counts as 1.0.
    """
    expected = labels.filter("valid").select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_p"))
    predicted = predictions.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_p"))
    sides = expected.unionByName(predicted).groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_p").alias("_p"))
    counts = sides.groupBy(*by).agg(
        F.count_if((F.col("_e") == 1) & (F.col("_p") == 1)).alias("true_positives"),
        F.count_if((F.col("_e") == 0) & (F.col("_p") == 1)).alias("false_positives"),
        F.count_if((F.col("_e") == 1) & (F.col("_p") == 0)).alias("false_negatives"),
    )
    tp, fp, fn = (F.col(name) for name in ("true_positives", "false_positives", "false_negatives"))
    scored = counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r)))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(1.0))


def prediction_key(candidate_codes: Column, hypothesis_id: Column) -> Column:
    """First candidate code, else the hypothesis id."""
    return F.coalesce(F.get(candidate_codes, F.lit(0)), hypothesis_id)


def automation_summary(encounters: DataFrame, items: DataFrame, encounter: str) -> DataFrame:
    """Encounters scanned, clean, routed, suppressed and left to people, and the no-touch share.

    An encounter counts once, by the most demanding of its items.
    """
    human = F.col("tier").isin("quick_confirm", "focused_review", "escalated")
    level = F.when(human, 3).when(F.col("tier") == "auto_routed", 2).otherwise(1)
    worst = items.groupBy(encounter).agg(F.max(level).alias("_level"))
    counted = encounters.select(encounter).join(worst, encounter, "left")
    summary = counted.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("_level").isNull()).alias("clean"),
        F.count_if(F.col("_level") == 2).alias("auto_routed"),
        F.count_if(F.col("_level") == 1).alias("suppressed"),
        F.count_if(F.col("_level") == 3).alias("human"),
    )
    share = F.try_divide(F.lit(100.0) * (F.col("scanned") - F.col("human")), F.col("scanned").cast("double"))
    return summary.withColumn("no_touch_percent", F.round(share, 1))


def search_queue(
    items: DataFrame, decisions: DataFrame, *, outcome: str, query: str, fields: Sequence[str], key: str
) -> DataFrame:
    """Queue rows of an outcome whose text fields contain the query, case aside.

    Decided findings disappear from the human queue only; ``all`` keeps every row.
    """
    decided = decisions.select(key).distinct().withColumn("_decided", F.lit(True))
    marked = items.join(decided, key, "left")
    if outcome != "all":
        marked = marked.filter(F.col("outcome") == outcome)
        if outcome == "human_exception":
            marked = marked.filter(F.col("_decided").isNull())
    searchable = F.lower(F.concat_ws(" ", *fields))
    return marked.filter(F.contains(searchable, F.lit(query.lower()))).drop("_decided")


def unresolved(findings: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    return findings.join(decisions.select(key), key, "left_anti")


def display_amount(cents: Column) -> Column:
    return cents / F.lit(100.0)


def display_percent(confidence: Column) -> Column:
    return F.floor(confidence * F.lit(100.0) + F.lit(0.5)).cast("bigint")
