"""Column-level building blocks: JSON text, row identity, filter text, display text."""
