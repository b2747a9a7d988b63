"""areastats.operators."""
