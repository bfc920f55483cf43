"""Provenance-graph analytics expressed as Spark DataFrame jobs."""
