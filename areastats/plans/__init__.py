"""areastats.plans."""
