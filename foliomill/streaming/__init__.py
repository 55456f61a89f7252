"""Streaming forms of the row-local stages (an addition)."""
