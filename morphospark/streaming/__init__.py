"""Structured Streaming forms of the stream-safe curation steps."""

from morphospark.streaming.curate_stream import curate_stream, running_counts

__all__ = ["curate_stream", "running_counts"]
