"""Appending to hash-linked logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def link_digest(content_hash: str, previous: str | None) -> str:
    """Digest of a record: its content digest and the digest of the record before it."""
    body = {"content_hash": content_hash, "previous_hash": previous}
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def append_chain(
    df: DataFrame, keys: Sequence[str], sequence: str, content_hash: str, tails: DataFrame | None = None
) -> DataFrame:
    """Add ``previous_hash`` and ``record_hash`` along each chain, after the stored ``tails``.

    A hash chain is sequential by nature, so a chain stays in one task; the task
    streams sorted Arrow batches and holds one digest, never the chain.  ``tails``
    has ``keys`` and ``tail_hash``.
    """
    if tails is not None:
        df = df.join(tails.select(*keys, F.col("tail_hash").alias("_tail")), list(keys), "left")
    else:
        df = df.withColumn("_tail", F.lit(None).cast("string"))
    schema = T.StructType(
        [field for field in df.schema.fields if field.name != "_tail"]
        + [T.StructField("previous_hash", T.StringType()), T.StructField("record_hash", T.StringType())]
    )
    names = list(keys)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last = None, None
        for batch in batches:
            previous, hashes = [], []
            for key, tail, content in zip(batch[names].itertuples(index=False, name=None), batch["_tail"], batch[content_hash]):
                if key != current:
                    current, last = key, tail
                previous.append(last)
                last = link_digest(content, last)
                hashes.append(last)
            yield batch.drop(columns="_tail").assign(previous_hash=previous, record_hash=hashes)

    ordered = df.repartition(*names).sortWithinPartitions(*names, sequence)
    return ordered.mapInPandas(link, schema)
