"""Decisions on small metadata: which segments to merge, what a position means."""
