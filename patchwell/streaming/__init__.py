"""Reviews over arriving diffs."""
