"""I-Match fingerprints, built from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.session import materialize

#: The band of inverse document frequencies ``ln(N / df)``: terms in 0.5 % to 20 % of the documents.
IDF_BAND = (1.6, 5.3)
#: Randomised lexicon subsets: so many of each rate, a term is in one with probability ``1 / rate``.
SUBSETS = ((16, 12), (64, 12), (256, 12))
#: Texts with fewer terms of the band are fingerprinted by all their terms.
LEAST_TERMS = 3
#: Lexicons of up to so many terms are broadcast (about 4 MB); larger ones are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: Characters of the texts that one window task orders, and bound of the number of these ranges.
RANGE_CHARS = 4_000_000
MOST_RANGES = 4096


def terms(text: Column) -> Column:
    """Distinct terms of a text: lower-case runs of letters and digits."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(texts: DataFrame, text_col: str, band: tuple[float, float] = IDF_BAND) -> tuple[DataFrame, int]:
    """``(term, code)`` of all terms of the band, and their number.

    Document frequencies are counted over all texts.  The bound of the number: ``N exp(-band[1])`` documents
    are needed for a term, so there are at most ``exp(band[1])`` (200) times the mean number of distinct terms
    of a document.  ``code`` carries, below a 40-bit hash of the term, the number of the
    cell that the term falls into for every rate.
    """
    total = texts.count()
    counted = texts.select(F.explode(terms(F.col(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(total, 1))) / F.col("df"))
    code = F.shiftleft(F.xxhash64("term").bitwiseAND(F.lit((1 << 39) - 1)), 24)
    shift = 0
    for rate, _ in SUBSETS:
        cell = F.pmod(F.xxhash64(F.lit(rate), "term"), F.lit(rate))
        code = code.bitwiseOR(F.shiftleft(cell, shift))
        shift += 8
    chosen = counted.filter(idf.between(*band)).select("term", code.alias("code"))
    chosen = materialize(chosen, "lexicon")
    return chosen, chosen.count()


def _in_cell(shift: int, rate: int, number: int):
    return lambda code: F.shiftright(code, shift).bitwiseAND(F.lit(rate - 1)) == number


def _subset_hashes(codes: Column, plain: Column) -> Column:
    """Hash of the sorted terms in every subset; an empty subset has the hash ``-``."""
    hashes = [F.xxhash64(codes)]
    shift = 0
    for rate, subsets in SUBSETS:
        for number in range(subsets):
            inside = F.filter(codes, _in_cell(shift, rate, number))
            hashes.append(F.when(F.size(inside) > 0, F.xxhash64(inside)))
        shift += 8
    few = F.size(codes) < LEAST_TERMS
    parts = []
    for i, value in enumerate(hashes):
        value = F.when(few, F.xxhash64(F.lit(i), plain)).otherwise(value)
        parts.append(F.coalesce(F.substring(F.lpad(F.hex(value), 16, "0"), 1, 8), F.lit("-")))
    return F.array_join(F.array(*parts), ".")


def likeness(one: Column, two: Column) -> Column:
    """Share of equal hashes among the subsets that hold a term of either text (0 to 1)."""
    pairs = F.zip_with(F.split(one, r"\."), F.split(two, r"\."), lambda a, b: F.when((a != "-") | (b != "-"), (a == b).cast("int")))
    real = F.array_compact(pairs)
    same = F.size(F.filter(real, lambda x: x == 1))
    return F.when(one == two, F.lit(1.0)).otherwise(F.coalesce(same / F.nullif(F.size(real), F.lit(0)), F.lit(0.0)))


def _ranges(docs: DataFrame) -> DataFrame:
    """Rows with ``_range`` and ``_guest``: ranges of the id, each with the first row of the next one as a guest.

    Borders are ids themselves: the smallest id of every range that approximate percentiles cut (any such borders
    give the same result; they only balance the ranges), so ``lead`` within a range sees every next document.  The first
    document of all is the guest of the last range.
    """
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum("n_chars"), F.lit(0)), F.min("doc_id")).first()
    wanted = max(int(size[0]) // RANGE_CHARS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    wanted = max(1, min(wanted, MOST_RANGES))
    shares = [i / wanted for i in range(1, wanted)]
    borders: list[int] = []
    if shares and size[1] is not None:
        found = sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 10 * wanted)).first()[0] or []))
        # Percentiles are doubles and may be no ids; one row per range comes back.
        cut = F.array(*[F.lit(b).cast("bigint") for b in found])
        coarse = docs.filter("doc_id is not null").groupBy(F.size(F.filter(cut, lambda b: b <= F.col("doc_id"))).alias("range"))
        borders = sorted(r["least"] for r in coarse.agg(F.min("doc_id").alias("least")).collect() if r["least"] > size[1])
    number = F.lit(0)
    known = F.array(*[F.lit(b).cast("bigint") for b in borders]) if borders else None
    if known is not None:
        # Borders are sorted, so the ranges before an id are those whose border it reaches.
        number = F.size(F.filter(known, lambda b: b <= F.col("doc_id")))
        number = F.when(F.col("doc_id").isNull(), 0).otherwise(number)
    last = len(borders)
    is_border = F.array_contains(known, F.col("doc_id")) if known is not None else F.lit(False)
    before = F.when(is_border, number - 1).when(F.col("doc_id").eqNullSafe(F.lit(size[1])) | F.col("doc_id").isNull(), F.lit(last))
    own = F.struct(number.alias("_range"), F.lit(0).alias("_guest"))
    guest = F.when(before.isNotNull(), F.struct(before.cast("int").alias("_range"), F.lit(1).alias("_guest")))
    placed = docs.withColumn("_place", F.explode(F.array_compact(F.array(own, guest))))
    return placed.select(*docs.columns, "_place._range", "_place._guest")


def fingerprints(
    docs: DataFrame, band: tuple[float, float] = IDF_BAND, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, with their likeness.

    The terms of a text whose inverse document frequency lies in ``band`` are sorted and hashed, all of
    them and those in each of several randomised subsets of the lexicon.  The subsets come at three
    rates, so long and short texts have subsets that hold a term or two.  The edited text has its
    last half replaced by the beginning of the next document (by id; after the last, the first).

    A null text is empty; a text with fewer than three terms of the band is fingerprinted by all
    its terms; equal texts have equal fingerprints; repeated ids follow each other in the order
    of their texts, and a null id comes first; an empty table gives an empty table.  The likeness to the next
    document of a repeated row is 1.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).withColumn("n_chars", F.char_length("text").cast("bigint"))
    words, size = lexicon(rows, "text", band)
    if size <= BROADCAST_TERMS:
        words = F.broadcast(words)
    by_id = Window.partitionBy("_range").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # The last document of a table of one follows itself.
    following = F.coalesce(F.lead("text").over(by_id), F.col("text"))
    placed = _ranges(rows).withColumn("_row", F.row_number().over(by_id)).withColumn("_next", following)
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next", F.lit(1), half)
    )
    both = placed.select(
        "_range",
        "_row",
        "_guest",
        "doc_id",
        "n_chars",
        F.explode(
            F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), edited.alias("text")))
        ).alias("v"),
    ).select("_range", "_row", "_guest", "doc_id", "n_chars", "v.which", "v.text")
    described = both.select(
        "_range",
        "_row",
        "_guest",
        "doc_id",
        "n_chars",
        "which",
        F.when(F.col("which") == 1, F.sha2("text", 256)).alias("sha"),
        terms(F.col("text")).alias("terms"),
    ).withColumn("plain", F.xxhash64(F.array_sort("terms")))
    exploded = described.select("_range", "_row", "which", "_guest", "doc_id", "n_chars", "sha", "plain", F.explode_outer("terms").alias("term"))
    hit = exploded.join(words, "term", "left")
    grouped = hit.groupBy("_range", "_row", "which").agg(
        F.first("_guest").alias("_guest"),
        F.first("doc_id").alias("doc_id"),
        F.first("n_chars").alias("n_chars"),
        F.first("sha").alias("sha"),
        F.first("plain").alias("plain"),
        F.sort_array(F.collect_list("code")).alias("codes"),
    )
    printed = grouped.withColumn("print", _subset_hashes(F.col("codes"), F.col("plain")))
    again = Window.partitionBy("_range").orderBy("_row", "which")
    lined = printed.withColumn("_edited", F.lead("print", 1).over(again)).withColumn("_sha", F.lead("sha", 1).over(again)).withColumn(
        "_follow", F.coalesce(F.lead("print", 2).over(again), F.col("print"))
    )
    return lined.filter("which = 0 AND _guest = 0").select(
        "doc_id",
        "n_chars",
        F.col("_sha").alias("edited_sha256"),
        F.col("print").alias("fingerprint"),
        F.col("_edited").alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("_edited")).alias("near_edited"),
        likeness(F.col("print"), F.col("_follow")).alias("near_next"),
    )
