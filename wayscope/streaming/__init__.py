"""Online forms of the audit."""

from .audit import audit_stream, found_blocks, found_counts, found_isolated, found_pairs, stream_settings
from .online import classify_stream

__all__ = ["audit_stream", "classify_stream", "found_blocks", "found_counts", "found_isolated", "found_pairs", "stream_settings"]
