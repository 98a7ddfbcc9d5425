"""Relational operators: ingest, resolution, linkage, enrichment, metrics."""
