"""Observation analytics on Spark: sections, facts with provenance, validation, search, history."""
