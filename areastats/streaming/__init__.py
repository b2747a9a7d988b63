"""areastats.streaming."""
