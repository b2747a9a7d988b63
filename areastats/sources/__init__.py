"""areastats.sources."""
