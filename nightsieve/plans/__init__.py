"""Shared plan fragments: range splitting, size-checked lookups, checkpoints."""
