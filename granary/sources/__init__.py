"""Readers, writers and adapters that produce the canonical tables."""
