"""Structured Streaming jobs whose state is a table.

Each micro-batch runs a batch operator against what earlier batches stored and
writes its result below ``batch=<id>`` in overwrite mode, so a batch that is
retried after a failure replaces its own output and nothing is written twice.
The stored table is the deduplication state: it is unbounded by contract and is
joined, never held in executor memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from claimweave.operators.chains import append_chain, link_digest
from claimweave.operators.outbox import new_tasks
from claimweave.operators.scale import first_per_group

Step = Callable[[DataFrame, DataFrame | None], DataFrame]


def stored(spark: SparkSession, table: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """Rows written so far; ``before`` leaves out a batch that is being retried."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option(
        "basePath", table
    ).parquet(table)
    return rows.filter(F.col("batch") < before).drop("batch") if before is not None else rows.drop("batch")


def _file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def incremental(stream: DataFrame, table: str, checkpoint: str, output: T.StructType, step: Step) -> StreamingQuery:
    """Run ``step(batch, earlier output)`` per micro-batch and append its result to ``table``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        earlier = stored(spark, table, output, batch_id) if batch_id > 0 else None
        step(batch, earlier).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def stream_ingest(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    transform: Callable[[DataFrame], DataFrame],
    output: T.StructType,
    key: list[str],
    order: list,
    *,
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_trigger: int = 1_000,
) -> StreamingQuery:
    """New source files through a mapping; rows whose key is stored already are left out."""

    def step(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        rows = first_per_group(transform(batch), key, order, key[-1])
        return rows if earlier is None else rows.join(earlier.select(*key), key, "left_anti")

    return incremental(_file_stream(spark, path, schema, fmt, files_per_trigger), table, checkpoint, output, step)


def stream_outbox(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    tasks: Callable[[DataFrame], DataFrame],
    output: T.StructType,
    *,
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_trigger: int = 1_000,
) -> StreamingQuery:
    """Enqueue route tasks once per (tenant, workspace, automation id), first one kept."""

    def step(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        built = tasks(batch)
        return new_tasks(built, earlier if earlier is not None else built.limit(0))

    return incremental(_file_stream(spark, path, schema, fmt, files_per_trigger), table, checkpoint, output, step)


def stream_decisions(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    requests: Callable[[DataFrame], DataFrame],
    output: T.StructType,
    *,
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_trigger: int = 1_000,
) -> StreamingQuery:
    """One decision per (packet, finding) in order of ``sequence``, linked into packet chains.

    ``requests`` yields ``packet_id, finding_id, sequence, content_hash``.
    """

    def step(batch: DataFrame, earlier: DataFrame | None) -> DataFrame:
        key = ["packet_id", "finding_id"]
        first = first_per_group(requests(batch), key, [F.asc("sequence")], "sequence")
        if earlier is None:
            return append_chain(first, ["packet_id"], "sequence", "content_hash")
        fresh = first.join(earlier.select(*key), key, "left_anti")
        tails = earlier.groupBy("packet_id").agg(F.max_by("record_hash", "sequence").alias("tail_hash"))
        return append_chain(fresh, ["packet_id"], "sequence", "content_hash", tails)

    return incremental(_file_stream(spark, path, schema, fmt, files_per_trigger), table, checkpoint, output, step)



_LOG = T.StructType(
    [
        T.StructField("packet_id", T.StringType()),
        T.StructField("finding_id", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("previous_hash", T.StringType()),
        T.StructField("record_hash", T.StringType()),
    ]
)
#: Decided findings of a packet that lie with its tail.
LISTED_FINDINGS = 1 << 12
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(row: tuple) -> tuple:
    """Sequence, finding and content, each with missing ones last."""
    return tuple((value is None or value != value, value) for value in row[:3])


class DecisionLog(StatefulProcessor):
    """Decisions of one packet as they come: its decided findings, the length and the last digest of its chain.

    Requests of a micro-batch are taken by ``sequence``.  The first for a finding is accepted and linked behind the
    chain's tail, late ones too, so a chain never changes behind its tail; a later one is ``replayed`` if its content is
    equal, else ``terminal``.  One that names the digest it expects at the tail is ``stale`` where another one is.

    The first ``listed`` findings of a packet are read and written with its tail; further ones lie in a state of their own and
    are looked up one by one, so a packet of any length takes bounded memory besides the rows of its micro-batch.
    """

    def __init__(self, listed: int = LISTED_FINDINGS) -> None:
        self.listed = listed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "position bigint, record_hash string, findings array<string>, contents array<string>")
        self.further = handle.getMapState("further", "finding_id string", "content_hash string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        # The rows of one packet in one micro-batch; their order needs them together.
        names = ["sequence", "finding_id", "content_hash", "expected_previous"]
        batch = sorted((row for frame in rows for row in zip(*[frame[name].tolist() for name in names])), key=_in_order)
        # Every call to the state store costs far more than a row: the first findings of a packet come with its tail.
        known, last, findings, contents = self.tail.get() or (0, None, [], [])
        position, decided, out = known, dict(zip(findings, contents)), []
        for sequence, finding, content, expected in batch:
            listed = finding in decided
            if listed or (position > self.listed and self.further.containsKey((finding,))):
                before = decided[finding] if listed else self.further.getValue((finding,))[0]
                out.append((key[0], finding, sequence, "replayed" if before == content else "terminal", None, None, None))
            elif expected is not None and expected != last:
                out.append((key[0], finding, sequence, "stale", None, None, None))
            else:
                record = link_digest(content, last)
                position += 1
                out.append((key[0], finding, sequence, "accepted", position, last, record))
                if position <= self.listed:
                    decided[finding] = content
                else:
                    self.further.updateValue((finding,), (content,))
                last = record
        if position > known:
            self.tail.update((position, last, list(decided), list(decided.values())))
        frame = pd.DataFrame(out, columns=_LOG.names)
        frame["position"] = frame["position"].astype("Int64")
        yield frame

    def close(self) -> None:
        pass


def stream_decision_log(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    requests: Callable[[DataFrame], DataFrame],
    *,
    table: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_trigger: int = 1_000,
) -> StreamingQuery:
    """Every request with its ``status`` and its place in the packet's chain, appended to ``table``.

    ``requests`` yields ``packet_id, finding_id, sequence, content_hash, expected_previous``.  The state lies with the
    checkpoint in the shared folder: a restarted stream goes on behind the stored tails, and a micro-batch reads the state of
    its own packets only, however many decisions are stored.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    text = lambda name: F.col(name).cast("string").alias(name)
    stream = requests(_file_stream(spark, path, schema, fmt, files_per_trigger)).select(
        text("packet_id"), text("finding_id"), F.col("sequence").cast("bigint").alias("sequence"), text("content_hash"), text("expected_previous")
    )
    logged = stream.groupBy("packet_id").transformWithStateInPandas(DecisionLog(), _LOG, "append", "none")
    return (
        logged.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
