"""Input tables, derived inputs and sinks."""
