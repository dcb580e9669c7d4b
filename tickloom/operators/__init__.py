"""Relational operators: one winner per key, histories, gates, bars, indicators."""
