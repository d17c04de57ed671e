"""Column-level building blocks: text helpers, file classes and rules."""
