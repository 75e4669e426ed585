"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import materialize

#: Words of a text are runs of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A source is taken at most this many times.
EPOCHS = 3
#: Documents of one source that a window task sums up.
BUCKET_ROWS = 50_000
#: Weight of the light, middle and heavy sources at the times of training (0: begin, 1: end); linear between.
#: Light sources come rather early, heavy ones rather late.
SCHEDULES: tuple[tuple[tuple[float, float], ...], ...] = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)


def sizes(docs: DataFrame, text_col: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``target`` and ``tier`` of every source of ``(source, source_size)``.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, and share all words by weight.
    A target stops at ``epochs`` times its source; the excess is shared again by weight.  That ends
    where a common level times the weight is given to every source that has not stopped; sources stop in the
    order of capacity per weight, so running sums over that order give the level at once.
    The table has one row per source.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sources.withColumn("tier", F.pmod(position - 1, F.lit(3)).cast("int")).withColumn("weight", F.col("tier") + 1)
    whole = Window.partitionBy()
    stopping = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    here = stopping.rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("source_size") * F.lit(epochs)
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(room).over(here), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(here), F.lit(0))
    )
    # Levels rise up to the first source that does not stop, which has the final one, and fall from there on.
    leveled = weighed.withColumn("_room", room.cast("double")).withColumn("_level", level)
    free = F.col("_level") * F.col("weight") <= F.col("_room")
    final = F.max(F.when(free, F.col("_level"))).over(whole)
    target = F.least(F.col("_room"), F.coalesce(final * F.col("weight"), F.col("_room")))
    return leveled.select("source", "source_size", "tier", target.alias("target"))


def time_of(share: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """When a source whose weight follows ``schedule`` has been given ``share`` (0 to 1) of its words.

    The weight is integrated piece by piece; within a piece the integral is a parabola, whose root is the time.
    """
    pieces, given = [], 0.0
    total = sum((t2 - t1) * (w1 + w2) / 2 for (t1, w1), (t2, w2) in zip(schedule, schedule[1:], strict=False))
    for (t1, w1), (t2, w2) in zip(schedule, schedule[1:], strict=False):
        area = (t2 - t1) * (w1 + w2) / 2 / total
        slope = (w2 - w1) / (t2 - t1) / total
        rest = F.greatest(share - given, F.lit(0.0))
        if slope:
            start = w1 / total
            inner = F.sqrt(F.greatest(F.lit(start * start) + 2 * slope * rest, F.lit(0.0)))
            time = t1 + (inner - start) / slope
        else:
            time = t1 + rest * total / w1
        pieces.append((given + area, time))
        given += area
    result = pieces[-1][1]
    for end, time in reversed(pieces[:-1]):
        result = F.when(share < end, time).otherwise(result)
    return F.least(F.greatest(result, F.lit(0.0)), F.lit(1.0))


def mix(docs: DataFrame, *arguments, **options) -> DataFrame:
    """The rows of :func:`planned_mix`, range-sorted: in order of their first training time, those that are not taken last.

    A range of times is one partition, so partitions follow each other as the training does.
    """
    planned = planned_mix(docs, *arguments, **options)
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), *[F.col(name).asc_nulls_last() for name in ("doc_id", "source", "size")]]
    return planned.repartitionByRange(*order).sortWithinPartitions(*order)


def planned_mix(
    docs: DataFrame,
    epochs: int = EPOCHS,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, positions)`` of every row.

    The words of a source form a stream: its documents in a seeded order, then the same again.  The mix
    takes the first ``round(target)`` words of the stream, so ``taken`` sums to the target of the
    source, and a document is taken at most ``epochs`` times (the one where the stream ends in part).
    ``positions`` holds one training time between 0 and 1 per copy: the demand of a source up
    to a time is its integrated weight schedule, and the time of a copy is the demand
    inverted at the words of the stream before it.

    Running sums are made in buckets of the seeded order (a bounded number of rows each) with one
    row per bucket above them, so a source with a third of all rows stays parallel.  Null texts
    have size 0 and are taken 0 times; a null source is a source of its own, last in order;
    repeated rows are documents of their own; reruns agree; an empty table gives an empty table.

    ``row_col`` names a unique key of the rows that the result carries too, as ``_row``.  Texts decide the
    order of rows without an id, or of one id and size, then.
    """
    ordered_by, carried = [F.lit(seed), F.col(id_col)], []
    if row_col:
        ordered_by.append(F.when(F.col(id_col).isNull(), F.col(text_col)))
        carried = [F.xxhash64(text_col).alias("_text"), F.col(row_col).alias("_row")]
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        sizes(docs, text_col).alias("size"),
        F.xxhash64(*ordered_by).alias("_order"),
        *carried,
    )
    rows = materialize(rows, "sizes")
    # A source is spread over enough buckets of the order: a power of two by its own number of rows.
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    spread = F.greatest(F.ceil(F.log2(F.col("_rows") / BUCKET_ROWS)), F.lit(0)).cast("int")
    counted = sources.select("source", F.least(spread, F.lit(40)).alias("_bits"))
    targets = source_targets(sources.select("source", "source_size"), epochs)
    known = targets.withColumnRenamed("source", "_source").join(
        counted.withColumnRenamed("source", "_named"), F.col("_source").eqNullSafe(F.col("_named"))
    ).drop("_named")
    known = materialize(known, "sources")
    placed = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # The top bits of the order, without its sign, number the bucket.
    placed = placed.withColumn(
        "_bucket", F.expr("if(_bits = 0, 0, shiftrightunsigned(_order, 64 - _bits))").cast("bigint")
    )
    buckets = placed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_at"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"),
    )
    # Within a bucket the order is unsigned as the buckets are: the low 63 bits decide, then the id.
    inner = [F.expr("shiftrightunsigned(_order, 1)"), F.expr("_order & 1"), "doc_id", "size", *(["_text", "_row"] if row_col else [])]
    own = Window.partitionBy("source", "_bucket").orderBy(*inner).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    joined = summed.join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_at")))
    start = F.col("_base") + F.col("_own")
    wanted = F.least(F.round("target").cast("bigint"), F.col("source_size") * epochs)
    takes, times = [], []
    for copy in range(epochs):
        offset = start + F.col("source_size") * copy
        take = F.greatest(F.least(F.col("size"), wanted - offset), F.lit(0))
        takes.append(take)
        share = offset / F.greatest(wanted, F.lit(1))
        time = F.lit(None).cast("double")
        for tier, schedule in enumerate(schedules):
            time = F.when(F.col("tier") == tier, time_of(share, schedule)).otherwise(time)
        times.append(F.when(take > 0, time))
    taken = takes[0]
    for take in takes[1:]:
        taken = taken + take
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.cast("bigint").alias("taken"),
        F.array_compact(F.array(*times)).alias("positions"),
        *(["_row"] if row_col else []),
    )


def _with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a unique key of the row: its file and place there if it lies in files, else it is stored with one."""
    try:
        place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return docs.select("*", place.alias("__row"))
    except AnalysisException:
        return materialize(docs.withColumn("__row", F.struct(F.monotonically_increasing_id().alias("at"))), "keyed")


def training_order(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents as the mix takes them: one row per copy, range-sorted by training position.

    The last copy of a document that is taken in part keeps its first words.  The columns are those of ``docs``.
    Every row is taken as the mix has it: rows have a key of their own, so null and repeated ids are no matter.
    The plan is made of keys and sizes; texts are joined to it once, at the end.
    """
    keyed = _with_row(docs)
    planned = planned_mix(keyed, text_col=text_col, row_col="__row").filter(F.size("positions") > 0)
    planned = planned.select("_row", F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.col("positions").alias("_positions"))
    # The files of a Parquet scan have one row per key and place, however often they are read.
    copies = keyed.join(planned, F.col("__row") == F.col("_row")).select(
        *docs.columns, "_size", "_taken", F.posexplode("_positions").alias("_copy", "_position")
    )
    left = F.least(F.col("_size"), F.col("_taken") - F.col("_size") * F.col("_copy"))
    head = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(WORD), 0), 1, left.cast("int")), " ")
    cut = copies.withColumn(text_col, F.when(left < F.col("_size"), head).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    ordered = cut.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id")
    return ordered.select(*docs.columns)
