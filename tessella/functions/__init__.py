"""Column-level building blocks: field lists, guarded numbers, formatting."""
