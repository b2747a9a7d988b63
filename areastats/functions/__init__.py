"""areastats.functions."""
