"""Incremental runs of the batch operators over arriving files."""

from claimweave.streaming.jobs import stream_decisions, stream_ingest, stream_outbox

__all__ = ["stream_decisions", "stream_ingest", "stream_outbox"]
