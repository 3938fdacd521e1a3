"""Operators: similarity joins, duplicate groups, events, store, sidecars."""
