"""Operators on log tables: resolution, scans, rewriting, integrity, statistics, replication."""
