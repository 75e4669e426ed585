"""Token ids in ORC: run-length coded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimweave.llm.tokens import ENCODE_BYTES, crc32, encoder, steps

#: Rows between two entries of the row index, and bytes of a stripe.
INDEX_ROWS = 1000
STRIPE_BYTES = 16 << 20
#: Units that the encoder keeps; nothing else holds memory while files are written.
CACHE_UNITS = 600_000

_SCHEMA = "doc_id bigint, n_tokens bigint, before bigint, ids array<int>"


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Encode every text and write its ids in ascending document order below ``path``.

    Texts are dealt by ranges of the document id and sorted before they are encoded, so file
    ``k`` holds smaller ids than file ``k + 1`` and the shuffle moves texts, not ids.
    ``before`` counts the ids of earlier rows of the same file.  Integer columns are
    run-length coded by ORC; the row index and a Bloom filter on ``doc_id`` let a reader of
    a few documents skip stripes and row groups, and stripes are read in parallel.

    Null and empty texts give only the end id (or no id); a null document id comes
    first; repeated rows are all written, ordered by their text; other columns are ignored.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        tokens = encoder(tokenizer, CACHE_UNITS)
        for batch in steps(batches, limit=ENCODE_BYTES):
            found, ends = tokens.encode_column(batch.column("text"))
            if end_id is not None:
                found, ends = np.insert(found, ends[1:], end_id), ends + np.arange(len(ends))
            lengths = np.diff(ends)
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.view("<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lengths), pa.array(before + ends[:-1]), ids],
                ["doc_id", "n_tokens", "before", "ids"],
            )
            before += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, _SCHEMA)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def stored_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, n_tokens, before, ids, file)`` as they lie in the files; ``file`` is the number of the file."""
    number = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    return spark.read.schema(_SCHEMA).orc(path).withColumn("file", number)


def with_starts(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` of ``stored_tokens`` with ``start``, the ids of all rows before, for ``before`` and ``file``.

    One row per file (its number and its sum) is all that is ordered in one place; it is read
    from the ``n_tokens`` column alone.
    """
    files = stored.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    kept = [c for c in rows.columns if c not in ("before", "file")]
    placed = rows.join(bases, "file").withColumn("start", F.col("base") + F.col("before"))
    return placed.select("doc_id", "start", *kept[1:])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` from the files; ``start`` counts the ids of all rows before.

    A filter on ``doc_id`` reaches the scan, where the index and the Bloom filter prune.
    """
    stored = stored_tokens(spark, path)
    return with_starts(stored, stored)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files, the unsigned crc32 of the little-endian 32-bit ids.

    Ids are digested where they are read, so no shuffle moves them.
    """

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            values = np.asarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")
            offsets = lists.offsets.to_numpy()
            sums = [crc32(values[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            kept = [batch.column(name) for name in ("doc_id", "n_tokens", "before", "file")]
            names = ["doc_id", "n_tokens", "before", "file", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names)

    stored = stored_tokens(spark, path)
    schema = "doc_id bigint, n_tokens bigint, before bigint, file bigint, ids_crc32 bigint"
    return with_starts(stored.mapInArrow(digest, schema), stored)
