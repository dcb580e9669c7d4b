"""Structured Streaming jobs; each shares its row logic with the batch side."""
