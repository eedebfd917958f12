"""Readers: tables on disk, live feeds, and the tick-shaped views over the given tables."""
