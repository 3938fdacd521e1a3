"""Reusable physical patterns: materialised tables, connected components."""
