"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.tokens import ENCODE_BYTES, encoder, steps

TOKEN_LIMIT = 1024


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row of ``docs``.

    Texts are encoded in steps of about equal bytes, long ones are cut at safe boundaries
    (``tokens.Encoder``), and only lengths leave the workers.  ``tokenizer`` is a file of the
    tokenizers library (``.json``) or of sentencepiece (``.model``, whole texts).  Null
    and empty texts have no bytes and no tokens; repeated rows are counted one by one, other
    columns are ignored, and an empty table gives an empty table.
    """

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
            count = lambda texts: [len(x) for x in model.encode([t or "" for t in texts], num_threads=1)]
        else:
            count = lambda texts: [len(ids) >> 2 for ids in encoder(tokenizer).encode(texts)]
        for batch in steps(batches, limit=ENCODE_BYTES):
            counts = count(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text")
    )
    counted = rows.mapInArrow(lengths, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
